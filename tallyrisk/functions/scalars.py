"""Column expressions used by more than one operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (greatest/least alone would swallow it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def at_least(value: Column, low: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def zero_to(value: Column, substitute: float) -> Column:
    """Replace exact zeros only; small values and NULL pass through."""
    return F.when(value == 0, F.lit(substitute)).otherwise(value)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def quick_round(value: Column, digits: int, exact=F.bround) -> Column:
    """What `exact` (`bround` or `round`) gives for a double, without a decimal for every value. Scaled values
    are off by less than 1e-3 up to 1e12: only those near a tie, and larger ones, depend on the decimal."""
    scaled = value * F.lit(10.0 ** digits)
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - whole) < 0.499)
    return F.when(clear, whole / F.lit(10.0 ** digits) + F.lit(0.0)).otherwise(exact(value, digits))  # + 0: no -0


def as_number(flag: Column) -> Column:
    return flag.cast("double")


def sha_hex(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def stable_int(value: Column, modulo: int | Column) -> Column:
    """First eight hex digits of the SHA-256, modulo a number."""
    digits = F.conv(F.substring(sha_hex(value), 1, 8), 16, 10).cast("bigint")
    return digits % modulo


def uniform(seed: int, row_key: Column, stream: str) -> Column:
    """A number in [0, 1) that depends only on seed, row and stream name.

    Twelve hex digits give 48 bits, which a double holds exactly, so the value does not
    depend on partitioning, retries or engine.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), row_key.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint") / F.lit(float(2**48))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def finite_or_zero(value: Column) -> Column:
    value = value.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def literal_lookup(key: Column, table: dict, default) -> Column:
    """A small constant table as a CASE expression; unknown or NULL keys give the default."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def typology_code(name: Column) -> Column:
    """Position of a typology in the contract's list; NULL for an unknown one."""
    at = F.array_position(F.array(*[F.lit(t) for t in schema.TYPOLOGIES]), name)
    return F.when(at > 0, (at - 1).cast("int"))


def typology_name(code: Column) -> Column:
    """The typology at a position; NULL outside the list."""
    return F.get(F.array(*[F.lit(t) for t in schema.TYPOLOGIES]), code)
