"""Rolling mean and deviation over the last n rows of each series, and anomaly flags."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import outside_band
from ..functions.rows import without_nan
from ..plans.sizing import LONG_SERIES, long_series
from ..schema import CITY, SEQ, SERIES_ORDER, TEMPERATURE
from .blocks import BLOCK, OWN_BLOCK, split_series, time_blocks


def _split(rows: int) -> tuple[int, int, int]:
    """(inner, outer, rest) with rows = inner * outer + rest and few rows to look back at."""
    if rows <= 8:
        return rows, 1, 0
    parts = ((inner, rows // inner, rows % inner) for inner in range(2, rows))
    return min(parts, key=sum)


def _sum(terms) -> str:
    return " + ".join(f"({term})" for term in terms)


def with_rolling_columns(df: DataFrame, partition, order, value, mean_rows, std_rows) -> DataFrame:
    """Mean of the last `mean_rows` and sample deviation of the last `std_rows` rows of a partition.

    A frame would visit all its rows again for every row. Here a window of 30 rows is 6 windows of 5,
    each of which is computed once, at its last row, and looked up with lag: about 2 * sqrt(rows)
    steps per row. Sums of squares are combined around the means, so nothing cancels out. A missing
    value, or a look back beyond the first row, makes the result missing; so windows stay missing
    until all of their rows hold a value. Means are offsets from the current value, which makes them
    exact on constant stretches. All lags share one shuffle and one sort.
    """
    kept = df.columns
    series = f"OVER (PARTITION BY {', '.join(partition)} ORDER BY {', '.join(order)})"
    sizes = {rows: _split(rows) for rows in (mean_rows, std_rows) if rows}
    inner_sizes = {inner for inner, _, _ in sizes.values()}

    # The last rows themselves, as far as the inner windows reach.
    last = [value] + [f"_x{i}" for i in range(1, max(inner_sizes))]
    df = df.selectExpr(
        "*", *[f"lag({value}, {i}) {series} AS {x}" for i, x in enumerate(last) if i > 0]
    )

    # Mean and sum of squared deviations of each inner window, at its last row.
    means, squares = [], []
    for n in inner_sizes:
        offsets = _sum(f"{x} - {value}" for x in last[:n])
        means.append(f"{value} + ({offsets}) / {n} AS _mean{n}")
        deviations = _sum(f"({x} - _mean{n}) * ({x} - _mean{n})" for x in last[:n])
        squares.append(f"{deviations} AS _squares{n}")
    df = df.selectExpr("*", *means).selectExpr("*", *squares)

    # The inner windows, and single rows where they do not add up, that make up each window.
    lags = {}
    for rows, (n, outer, rest) in sizes.items():
        for i in range(1, outer):
            lags[f"_mean{n}_{i}"] = f"lag(_mean{n}, {i * n}) {series}"
            if rows == std_rows:
                lags[f"_squares{n}_{i}"] = f"lag(_squares{n}, {i * n}) {series}"
        for i in range(rows - rest, rows):
            lags[f"_row{i}"] = f"lag({value}, {i}) {series}"
    df = df.selectExpr("*", *[f"{lag} AS {name}" for name, lag in lags.items()])

    def parts(name, rows):
        n, outer, _ = sizes[rows]
        return [f"_{name}{n}"] + [f"_{name}{n}_{i}" for i in range(1, outer)]

    def singles(rows):
        return [f"_row{i}" for i in range(rows - sizes[rows][2], rows)]

    def mean(rows):
        n = sizes[rows][0]
        offsets = [f"{n} * ({m} - {value})" for m in parts("mean", rows)]
        offsets += [f"{x} - {value}" for x in singles(rows)]
        return f"{value} + ({_sum(offsets)}) / {rows}"

    results = []
    if mean_rows:
        results.append(f"{mean(mean_rows)} AS rolling_mean")
    if std_rows == 1:
        results.append("CAST(NULL AS DOUBLE) AS rolling_std")
    elif std_rows:
        df = df.selectExpr("*", f"{mean(std_rows)} AS _center")
        n = sizes[std_rows][0]
        terms = parts("squares", std_rows)
        terms += [f"{n} * ({m} - _center) * ({m} - _center)" for m in parts("mean", std_rows)]
        terms += [f"({x} - _center) * ({x} - _center)" for x in singles(std_rows)]
        results.append(f"sqrt(({_sum(terms)}) / {std_rows - 1}) AS rolling_std")
    return df.selectExpr(*kept, *results)


def rolling_stats(
    readings: DataFrame,
    mean_rows: int | None = 30,
    std_rows: int | None = 7,
    keys=(CITY,),
    series_rows: int = LONG_SERIES,
    value: str = TEMPERATURE,
    folder: str | None = None,
) -> DataFrame:
    """Add `rolling_mean` and `rolling_std` over the last rows of each series, in time order.

    NaN counts as a missing value, and becomes one. Rows are counted, not days. Both windows share one shuffle and one sort. Series of up to
    `series_rows` rows are one window partition; longer ones are cut into blocks. Rows without a key
    belong to no series: they keep missing values and are spread over the cluster. What long series
    need on the way is written to scratch, or to `folder` if given.
    """
    keys = list(keys)
    readings = without_nan(readings, value)
    has_key = F.lit(True)
    for key in keys:
        has_key = has_key & F.col(key).isNotNull()

    def roll(df):
        return with_rolling_columns(df, [*keys, BLOCK], SERIES_ORDER, value, mean_rows, std_rows)

    def whole(df):
        # Without a key each row is alone, told apart by seq, and can fill no frame.
        rolled = roll(df.withColumn(BLOCK, F.when(~has_key, F.col(SEQ)))).drop(BLOCK)
        for name in ("rolling_mean", "rolling_std"):
            if name in rolled.columns:
                rolled = rolled.withColumn(name, F.when(has_key, F.col(name)))
        return rolled

    long_keys, long_rows = long_series(readings, keys, series_rows, folder)
    if long_keys is None:
        return whole(readings)

    lead = max(mean_rows or 1, std_rows or 1) - 1

    def roll_blocks(blocks):
        return roll(blocks).where(F.col(BLOCK) == F.col(OWN_BLOCK)).drop(BLOCK, OWN_BLOCK)

    short = readings.join(long_keys, keys, "left_anti")
    blocks, crowded = time_blocks(readings, keys, long_keys, series_rows, lead, folder)
    rolled = whole(short).unionByName(roll_blocks(blocks))
    if crowded is not None:
        # Too many rows lie too close together in time: these are sorted and numbered.
        rest = readings.join(crowded, keys, "left_semi")
        numbered = split_series(rest, keys, SERIES_ORDER, long_rows, series_rows, lead, folder)
        rolled = rolled.unionByName(roll_blocks(numbered))
    return rolled


def flag_anomalies(rolled: DataFrame, k: float = 2, value: str = TEMPERATURE) -> DataFrame:
    """Add `is_anomaly`: strictly outside rolling_mean +/- k * rolling_std, never missing."""
    flag = outside_band(F.col(value), F.col("rolling_mean"), F.col("rolling_std"), k)
    return rolled.withColumn("is_anomaly", flag)


def rolling_anomalies(
    readings: DataFrame,
    mean_rows: int = 30,
    std_rows: int = 7,
    k: float = 2,
    keys=(CITY,),
    series_rows: int = LONG_SERIES,
    folder: str | None = None,
) -> DataFrame:
    """All readings with rolling statistics and `is_anomaly`."""
    rolled = rolling_stats(
        readings, mean_rows, std_rows, keys, series_rows=series_rows, folder=folder
    )
    return flag_anomalies(rolled, k)


def anomalies_only(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_anomaly")
