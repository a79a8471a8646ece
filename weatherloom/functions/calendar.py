"""Calendar expressions: seasons, days, epochs and date ranges."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season names by number, winter = 1 (December to February).
SEASONS = ("winter", "spring", "summer", "autumn")


def _season_array() -> Column:
    return F.array(*[F.lit(name) for name in SEASONS])


def season_number(ts) -> Column:
    """1 = winter (Dec-Feb), 2 = spring, 3 = summer, 4 = autumn."""
    return F.floor(F.month(ts) % 12 / 3).cast("int") + 1


def season_name(ts) -> Column:
    number = season_number(ts)
    # element_at takes an index that may be missing for one that never is, hence the guard.
    return F.when(number.isNotNull(), F.element_at(_season_array(), number))


def season_label(name: Column) -> Column:
    """'winter' -> 'Winter', as shown to people."""
    return F.initcap(name)


def season_number_of(name: Column) -> Column:
    """Number of a season given by name or label; NULL for anything else."""
    number = F.array_position(_season_array(), F.lower(name)).cast("int")
    return F.nullif(number, F.lit(0))


def current_season(as_of=None) -> Column:
    """Season of today in the session time zone, or of the date or timestamp `as_of`."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return season_name(day)


def calendar_date(ts) -> Column:
    return F.to_date(ts)


def month_start(ts) -> Column:
    return F.trunc(ts, "month")


def date_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def on_day_and_month(ts, day: int, month: int) -> Column:
    """The same calendar day in any year. 29 February matches leap years only."""
    return (F.dayofmonth(ts) == day) & (F.month(ts) == month)


def known_season(season) -> str:
    """The name of a season given by number, name or label; anything else is an error."""
    if isinstance(season, int) and 1 <= season <= len(SEASONS):
        return SEASONS[season - 1]
    if isinstance(season, str) and season.lower() in SEASONS:
        return season.lower()
    raise ValueError(f"unknown season {season!r}; choose one of {', '.join(SEASONS)} or 1 to 4")


def in_season(ts, season) -> Column:
    """Season derived from the timestamp, given by number, name or label."""
    return season_number(ts) == SEASONS.index(known_season(season)) + 1


def whole_days_since(ts: Column, first: Column) -> Column:
    """Whole days from `first` to `ts`, for ts >= first."""
    return F.extract(F.lit("DAY"), ts - first).cast("bigint")


def epoch_to_utc(seconds: Column) -> Column:
    """Epoch seconds as UTC wall-clock time, whatever the session time zone. Absurd values give NULL."""
    since_epoch = F.call_function("try_multiply", F.expr("INTERVAL '1' SECOND"), seconds)
    return F.call_function("try_add", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), since_epoch)


def _since_epoch(ts: Column):
    """Whole minutes since 1970 in seconds, and the seconds left over with their fraction."""
    gap = ts - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")

    def part(unit):
        return F.extract(F.lit(unit), gap)

    whole = part("DAY").cast("bigint") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60
    return whole, part("SECOND")


def utc_to_epoch(ts: Column) -> Column:
    """Inverse of `epoch_to_utc`: whole epoch seconds of a UTC wall-clock time."""
    whole, rest = _since_epoch(ts)
    return whole + F.floor(rest).cast("bigint")


def utc_instant(ts: Column) -> Column:
    """Wall-clock time read as UTC, as the TIMESTAMP that watermarks need."""
    whole, rest = _since_epoch(ts)
    return F.timestamp_micros(whole * 1000000 + (rest * 1000000).cast("bigint"))


def utc_wall_clock(instant: Column) -> Column:
    """Inverse of `utc_instant` for whole seconds."""
    return epoch_to_utc(F.unix_seconds(instant))


def date_range(start: Column, days: int) -> Column:
    """Array of `days` consecutive dates."""
    return F.sequence(start, F.date_add(start, days - 1))
