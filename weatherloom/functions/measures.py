"""Expressions on temperatures: units, bands, verdicts, labels, text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN_OFFSET = 273.15


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(KELVIN_OFFSET)


def lower_bound(mean: Column, std: Column, k: float) -> Column:
    return mean - F.lit(float(k)) * std


def upper_bound(mean: Column, std: Column, k: float) -> Column:
    return mean + F.lit(float(k)) * std


def outside_band(value: Column, mean: Column, std: Column, k: float) -> Column:
    """Strictly above or below mean +/- k * std; a missing bound is never an anomaly."""
    above = value > upper_bound(mean, std, k)
    below = value < lower_bound(mean, std, k)
    return F.coalesce(above | below, F.lit(False))


def band_status(value: Column, lower: Column, upper: Column) -> Column:
    """'above', 'below' or 'normal'; a missing value or band is 'normal'."""
    return (
        F.when(value > upper, F.lit("above"))
        .when(value < lower, F.lit("below"))
        .otherwise(F.lit("normal"))
    )


def trend_label(slope: Column) -> Column:
    return (
        F.when(slope > 0, F.lit("positive"))
        .when(slope < 0, F.lit("negative"))
        .otherwise(F.lit("none"))
    )


def payload_status(cod: Column) -> Column:
    """'ok' for 200, 'invalid_key' for 401, 'error' otherwise, 'unreadable' without a code."""
    return (
        F.when(cod == "200", F.lit("ok"))
        .when(cod == "401", F.lit("invalid_key"))
        .when(cod.isNull(), F.lit("unreadable"))
        .otherwise(F.lit("error"))
    )


def two_decimals(value: Column) -> Column:
    """Text with two decimals, rounding the exact binary value half to even."""
    return F.call_function("format_number", value, F.lit("0.00"))


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0; the last bin is closed, and a zero width gives bin 0."""
    width = (high - low) / F.lit(float(bins))
    return F.when(high == low, F.lit(0).cast("bigint")).otherwise(
        F.least(F.floor((value - low) / width), F.lit(bins - 1).cast("bigint"))
    )


def uniform(seed: int, salt: int, *keys: str) -> Column:
    """A number between 0 and 1 computed from the row's keys, in 2 ** 52 steps.

    The steps are the first 13 hexadecimal digits of the MD5 of seed, salt and the keys as text, joined
    by bars, so any engine with MD5 gives the same numbers. A missing key is an empty text.
    """
    parts = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), *parts).cast("binary"))
    steps = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double")
    return (steps + 0.5) / F.lit(float(2**52))


def normal_noise(seed: int, *keys: str) -> Column:
    """Standard normal noise (Box-Muller) computed from the row's own keys.

    It does not depend on partitioning or row order, so a recomputed task gives the same rows.
    """
    radius = F.sqrt(-2.0 * F.log(uniform(seed, 1, *keys)))
    return radius * F.cos(2.0 * F.pi() * uniform(seed, 2, *keys))
