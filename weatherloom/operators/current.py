"""Comparison of current readings with historical norms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import season_name
from ..functions.measures import band_status
from ..functions.rows import present
from ..plans.sizing import written
from ..schema import CITY, SEASON
from .norms import city_norm, day_month_norm, season_norm

# Norm kind -> (function, width of the band in deviations).
NORMS = {
    "day_month": (day_month_norm, 3),
    "city": (city_norm, 2),
    "season": (season_norm, 2),
}


def with_norm_keys(current: DataFrame, norm: str):
    """Current readings with the key columns of a norm kind, and those keys."""
    if norm == "day_month":
        day, month = F.dayofmonth("observed_at"), F.month("observed_at")
        return current.withColumns({"day": day, "month": month}), [CITY, "day", "month"]
    if norm == "season":
        return current.withColumn(SEASON, season_name("observed_at")), [CITY, SEASON]
    if norm == "city":
        return current, [CITY]
    raise ValueError(f"unknown norm {norm!r}; choose one of {sorted(NORMS)}")


def classify(current: DataFrame, norms: DataFrame, norm: str) -> DataFrame:
    """Join current readings with ready norms and add `status`.

    A city without a norm stays, as 'normal'. Norms have one row per key, so the join repeats no
    reading; Catalyst and adaptive execution choose how to join from the real sizes.
    """
    keyed, keys = with_norm_keys(current, norm)
    status = band_status(F.col("temp_c"), F.col("lower"), F.col("upper"))
    return keyed.join(norms, keys, "left").withColumn("status", status)


def compare_current(
    current: DataFrame,
    readings: DataFrame,
    norm: str = "day_month",
    k: float | None = None,
    **options,
) -> DataFrame:
    """Each current reading with its historical band and 'above', 'below' or 'normal'.

    Runs a job that writes the current readings, or, where a column has no type, what they ask for.
    """
    if norm not in NORMS:
        raise ValueError(f"unknown norm {norm!r}; choose one of {sorted(NORMS)}")
    build, width = NORMS[norm]
    # Only the history of the cities asked for is read on, and only the norms asked for are computed.
    # What is asked for is written, as several passes over the history look it up.
    keyed, keys = with_norm_keys(current, norm)
    if "void" in dict(keyed.dtypes).values():
        asked = written(present(keyed, *keys).select(*keys).distinct(), "asked-norms")
    else:
        current = written(keyed, "current-readings")
        asked = present(current, *keys).select(*keys).distinct()
    history = readings.join(asked.select(CITY).distinct(), CITY, "left_semi")
    norms = build(history, k=width if k is None else k, only=asked, **options)
    return classify(current, norms, norm)
