"""History of up to 60 periods as one bigint: bit i is period i."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PERIODS = 60
MEMORY = 12          # fixed value: periods of memory for tenure, one-time, returned, seasonal
SEASON_RETURN = 3    # fixed value: a seasonal gap closed within so many periods a year ago
FLAP_MIN = 3         # fixed value: switches within the memory that make a triple "flapping"


def _int(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def shl(value: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", value, _int(n))


def shr(value: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", value, _int(n))


def one_bit(i: Column | int) -> Column:
    return shl(F.lit(1).cast("bigint"), i)


def build_mask(condition: Column, mi: Column) -> Column:
    """Aggregate: OR of the period bits of the rows where the condition holds.

    A period outside 0..59 has no bit of its own: the row stops the job instead of setting another period's.
    """
    outside = F.raise_error(F.concat(F.lit(f"period outside 0..{MAX_PERIODS - 1}: "), mi.cast("string"))).cast("bigint")
    bit = F.when(mi.isNull(), F.lit(None).cast("bigint")).when(mi.between(0, MAX_PERIODS - 1), one_bit(mi)).otherwise(outside)
    return F.bit_or(F.when(condition, bit).otherwise(F.lit(0).cast("bigint")))


def fold(column: str) -> Column:
    """Aggregate: periods of any of the masks."""
    return F.bit_or(column)


def fold_over(column: str, window) -> Column:
    """The periods of any of a window's masks, beside each of them."""
    return F.bit_or(column).over(window)


def over(condition: Column, mi: Column, window) -> Column:
    """The mask of a window's rows, beside each of them."""
    return F.bit_or(F.when(condition, one_bit(mi)).otherwise(F.lit(0).cast("bigint"))).over(window)


def mask_bit(mask: Column, i: Column | int) -> Column:
    i = _int(i)
    return F.when(i >= 0, shr(mask, i).bitwiseAND(F.lit(1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def has_bit(mask: Column, i: Column | int) -> Column:
    return mask_bit(mask, i) == 1


def mask_range(mask: Column, lo: Column, hi: Column) -> Column:
    """Bits lo..hi of the mask; 0 when the range is empty or lies before the window."""
    start = F.greatest(lo, F.lit(0))
    window = one_bit(hi + 1) - one_bit(start)
    return F.when(hi < start, F.lit(0).cast("bigint")).otherwise(mask.bitwiseAND(window))


def any_in(mask: Column, lo: Column, hi: Column) -> Column:
    return mask_range(mask, lo, hi) != 0


def tenure_band(mask: Column, at: Column) -> Column:
    """Time in portfolio before ``at``: under 3 periods, 3 to 12, 12 and more."""
    return (F.when(~any_in(mask, at - MEMORY, at - 3), "lt3")
            .when(has_bit(mask, at - MEMORY), "12p").otherwise("3_12"))


def one_time(mask: Column, at: Column) -> Column:
    """Paid at ``at``, nothing in the memory before and the two periods after."""
    return ~any_in(mask, at - MEMORY, at - 1) & ~has_bit(mask, at + 1) & ~has_bit(mask, at + 2)


def seasonal_gap(mask: Column, at: Column) -> Column:
    """The same hole a year ago: present before it, absent in it, back soon after."""
    return (has_bit(mask, at - MEMORY - 1) & ~has_bit(mask, at - MEMORY)
            & any_in(mask, at - MEMORY + 1, at - MEMORY + SEASON_RETURN))


def flapping(b_any: Column, b_n: Column, at: Column) -> Column:
    """Often switching between salary and non-salary codes, counted on the shifted XOR."""
    flips = (b_n.bitwiseXOR(shl(b_n, 1))).bitwiseAND(b_any).bitwiseAND(shl(b_any, 1))
    return (at >= MEMORY - 1) & (F.bit_count(mask_range(flips, at - MEMORY + 1, at)) >= FLAP_MIN)


def appeared(mask: Column, lag: int) -> Column:
    """Bits of periods present now and absent ``lag`` periods earlier."""
    low = (1 << lag) - 1
    return mask.bitwiseAND(F.bitwise_not(shl(mask, lag))).bitwiseAND(F.bitwise_not(F.lit(low).cast("bigint")))


def vanished(mask: Column, lag: int, last: int) -> Column:
    """Bits of periods absent now and present ``lag`` periods earlier."""
    window = (1 << (last + 1)) - 1
    return shl(mask, lag).bitwiseAND(F.bitwise_not(mask)).bitwiseAND(F.lit(window).cast("bigint"))


def bit_positions(mask: Column, last: int) -> Column:
    """Array of the set positions, at most 60 entries, ready for ``explode``."""
    return F.filter(F.sequence(F.lit(0), F.lit(last)), lambda i: has_bit(mask, i))
