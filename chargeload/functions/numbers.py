"""Numeric and text column builders: safe casts, h:mm:ss parsing, exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(value: Column | str) -> Column:
    """Number or NULL: text is trimmed and cast; anything unparseable becomes NULL."""
    return F.trim(_col(value).cast("string")).try_cast("double")


def text_or_null(value: Column | str) -> Column:
    """Text form of a value; NULL and '' both become NULL."""
    s = _col(value).cast("string")
    return F.when(s != "", s)


def _hms_wide(value: Column | str) -> Column:
    """Minutes of 'h:mm:ss' or 'h:mm' as a decimal wide enough for any bigint parts, else NULL."""
    parts = F.split(F.trim(_col(value)), ":")
    n = F.size(parts)

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(i)).try_cast("bigint").cast("decimal(20,0)")

    h, m, s = part(1), part(2), part(3)
    three = h * F.lit(60) + m + F.when(s > 0, F.lit(1)).otherwise(F.lit(0))
    return (F.when((n == 3) & h.isNotNull() & m.isNotNull() & s.isNotNull(), three)
            .when((n == 2) & h.isNotNull() & m.isNotNull(), h * F.lit(60) + m))


def hms_minutes(value: Column | str) -> Column:
    """'h:mm:ss' → h*60 + m, plus one when seconds > 0; 'h:mm' → h*60 + m; else NULL, and
    NULL too where that is beyond an integer."""
    return _hms_wide(value).try_cast("int")


def hms_overflows(value: Column | str) -> Column:
    """Is this a duration whose minutes are beyond an integer?"""
    return F.coalesce(F.abs(_hms_wide(value)) > F.lit(2**31 - 1), F.lit(False))


def positive(value: Column | str) -> Column:
    """value > 0 as Python compares floats: NaN is not positive (Spark orders NaN above
    every number, so a bare ``> 0`` would be true for it)."""
    c = _col(value)
    return ~F.isnan(c) & (c > 0)


SNAP_SCALE = 9      # decimals kept before rounding to fewer

# Exact sums: a value is cut into limbs, whole numbers of a fixed unit, and each limb is added up as a bigint, so a sum
# does not depend on the order or grouping of the rows. Values below EXACT_LIMIT have three limbs down to 2^-58 (about
# 10^-18), larger ones, up to LARGE_LIMIT, three of their own down to 2^-24 (finer than a double there). A limb cannot overflow
# below 10^11 rows of values up to 10^6, or 10^7 rows of any values. What is beyond LARGE_LIMIT, infinite or NaN is
# added as doubles.
EXACT_LIMIT = 1e9             # below 2^30
LARGE_LIMIT = 1e27            # below 2^90
LIMB_UNITS = {"limb1": 2.0**-6, "limb2": 2.0**-32, "limb3": 2.0**-58}
LARGE_UNITS = {"large1": 2.0**52, "large2": 2.0**14, "large3": 2.0**-24}
LIMB_PARTS, LARGE_PARTS = tuple(LIMB_UNITS), tuple(LARGE_UNITS)
SUM_PARTS = (*LIMB_PARTS, *LARGE_PARTS, "other")


def is_exact(value: Column | str) -> Column:
    """Finite and below ``EXACT_LIMIT`` in size: such values are summed exactly."""
    return F.coalesce(F.abs(_col(value)) < F.lit(EXACT_LIMIT), F.lit(False))


def _below(z: Column) -> Column:
    """What a number has behind the point, in [0, 1); exact."""
    return z - F.floor(z).cast("double")


def limbs(value: Column | str) -> list[Column]:
    """The limbs of a value below ``EXACT_LIMIT``; 0 where it is beyond the range or NULL. Every step is exact in doubles."""
    c = _col(value)
    z = F.when(is_exact(c), c).otherwise(F.lit(0.0)) * F.lit(2.0**32)
    whole = F.floor(z)      # at most 62 bits
    return [F.shiftright(whole, 26), whole.bitwiseAND(F.lit((1 << 26) - 1)), F.floor(_below(z) * F.lit(2.0**26))]


def _large_limbs(value: Column | str) -> list[Column]:
    """The limbs of a value from ``EXACT_LIMIT`` up to ``LARGE_LIMIT``; NULL (which sums skip) for any other."""
    c = _col(value)
    z = c * F.lit(2.0**-52)
    y = _below(z) * F.lit(2.0**38)
    inside = (F.abs(c) >= F.lit(EXACT_LIMIT)) & (F.abs(c) < F.lit(LARGE_LIMIT))
    return [F.when(inside, x) for x in (F.floor(z), F.floor(y), F.floor(_below(y) * F.lit(2.0**38)))]


def _other(value: Column | str) -> Column:
    """The value where it is beyond all limbs, infinite or NaN, else NULL."""
    c = _col(value)
    return F.when(~F.coalesce(F.abs(c) < F.lit(LARGE_LIMIT), F.lit(False)), c)


def _sums(value: Column | str, where: Column | None = None) -> list[Column]:
    """The sums of ``SUM_PARTS``, in their order."""
    whole = limbs(value)
    if where is not None:       # rows outside are skipped, not added as zeros
        whole = [F.when(where, x) for x in whole]
    return [*[F.sum(x) for x in whole], *[F.sum(x) for x in _large_limbs(value)], F.sum(_other(value))]


def sum_parts(value: Column | str, prefix: str) -> list[Column]:
    """Aggregates ``<prefix>_<part>`` that add up a value exactly; sums of them go on adding (``merged_parts``)."""
    return [s.alias(f"{prefix}_{p}") for s, p in zip(_sums(value), SUM_PARTS, strict=True)]


def merged_parts(prefix: str) -> list[Column]:
    return [F.sum(f"{prefix}_{p}").alias(f"{prefix}_{p}") for p in SUM_PARTS]


def _total(parts: list[Column]) -> Column:
    """The double that the parts make: always the same additions, smallest unit first; NULL without any row."""
    units = list((LIMB_UNITS | LARGE_UNITS).values())
    whole, large = parts[:len(LIMB_UNITS)], parts[len(LIMB_UNITS):-1]
    added = [p.cast("double") * F.lit(u) for p, u in zip(whole, units, strict=False)]
    more = [F.coalesce(p.cast("double"), F.lit(0.0)) * F.lit(u) for p, u in zip(large, units[len(whole):], strict=True)]
    small, big = added[-1], more[-1]
    for x in reversed(added[:-1]):
        small = small + x
    for x in reversed(more[:-1]):
        big = big + x
    return small + big + F.coalesce(parts[-1], F.lit(0.0))


def parts_total(prefix: str) -> Column:
    """The sum that the parts make, as a double."""
    return _total([F.col(f"{prefix}_{p}") for p in SUM_PARTS])


def exact_sum(value: Column | str, where: Column | None = None) -> Column:
    """Sum that neither depends on the order of the rows nor fails on huge values; NULL without any row (``where``: of those it holds for)."""
    return _total(_sums(value, where))


def round_half_up(value: Column | str, digits: int) -> Column:
    """Round half away from zero on the decimal value, after snapping float noise.

    The value is first taken to ``SNAP_SCALE`` decimals so that e.g.
    13.124999999999998 (a float quotient whose exact value is 13.125) rounds as 13.125
    would. The result is a double again."""
    c = _col(value)
    # NaN, ±inf and values beyond the decimal range are passed through unrounded.
    snapped = c.try_cast(f"decimal(38,{SNAP_SCALE})")
    return F.coalesce(F.round(snapped, digits).cast("double"), c.cast("double"))


def round6(value: Column | str) -> Column:
    """Micro-unit rounding used for every reported kW / kWh figure (exact, half up)."""
    return round_half_up(value, 6)
