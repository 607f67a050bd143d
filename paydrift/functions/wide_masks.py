"""Histories of any number of periods: a struct of words of 60 bits, period i is bit i % 60 of word i // 60.

The same functions as in ``masks``, over words: shifts carry bits from word to word, differences and counts go word by word.
The number of words is a constant of the plan, so every function is a plain expression and needs no array of the row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import masks as mk

WORD = 60


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _low(n: int) -> Column:
    """The n lowest bits of a word."""
    return F.lit((1 << n) - 1).cast("bigint")


class Words:
    """Mask functions for histories of ``n`` words."""

    def __init__(self, n: int):
        self.n = n

    # ------------------------------------------------------------------ words
    def split(self, mask: Column) -> list[Column]:
        return [mask.getField(f"w{j}") for j in range(self.n)]

    def pack(self, words: list[Column]) -> Column:
        return F.struct(*[w.alias(f"w{j}") for j, w in enumerate(words)])

    def each(self, fn: Callable[..., Column], *masks: Column) -> Column:
        return self.pack([fn(*ws) for ws in zip(*map(self.split, masks))])

    def shifted(self, mask: Column, k: int) -> list[Column]:
        """Words of the mask moved up by k periods; what leaves a word is carried into the next."""
        q, r = divmod(k, WORD)
        words, out = self.split(mask), []
        for j in range(self.n):
            here = mk.shl(words[j - q], r).bitwiseAND(_low(WORD)) if j >= q else _zero()
            carry = mk.shr(words[j - q - 1], WORD - r) if r and j > q else _zero()
            out.append(here.bitwiseOR(carry))
        return out

    # ------------------------------------------------------------------ building
    def bits(self, mi: Column) -> list[Column]:
        """The words of one period; an unknown one has none, a period without a bit stops the job."""
        outside = F.raise_error(F.concat(F.lit(f"period outside 0..{WORD * self.n - 1}: "), mi.cast("string"))).cast("bigint")

        def word(j: int) -> Column:
            return F.when(mi.isNull(), F.lit(None).cast("bigint")).when(mi.between(WORD * j, WORD * j + WORD - 1), mk.one_bit(mi - WORD * j)).when(mi.between(0, WORD * self.n - 1), _zero()).otherwise(outside)

        return [word(j) for j in range(self.n)]

    def build_mask(self, condition: Column, mi: Column) -> Column:
        """Aggregate: the periods of the rows where the condition holds; a period without a bit stops the job."""
        return self.pack([F.bit_or(F.when(condition, b).otherwise(_zero())) for b in self.bits(mi)])

    def fold(self, column: str) -> Column:
        """Aggregate: periods of any of the masks."""
        return self.pack([F.bit_or(w) for w in self.split(F.col(column))])

    def fold_over(self, column: str, window) -> Column:
        """The periods of any of a window's masks, beside each of them."""
        return self.pack([F.bit_or(w).over(window) for w in self.split(F.col(column))])

    def over(self, condition: Column, mi: Column, window) -> Column:
        """The mask of a window's rows, beside each of them; a period without a bit stops the job."""
        return self.pack([F.bit_or(F.when(condition, F.coalesce(b, _zero())).otherwise(_zero())).over(window) for b in self.bits(mi)])

    def known_over(self, condition: Column, mi: Column, window) -> Column:
        """As ``over``, but of the rows where the condition holds only: unknown where none of them has a period."""
        return self.pack([F.bit_or(F.when(condition, b)).over(window) for b in self.bits(mi)])

    # ------------------------------------------------------------------ reading
    def mask_bit(self, mask: Column, i: Column | int) -> Column:
        i = F.lit(i) if isinstance(i, int) else i
        bit = F.when(i < 0, _zero())
        for j, word in enumerate(self.split(mask)):
            bit = bit.when(i < WORD * (j + 1), mk.shr(word, i - WORD * j).bitwiseAND(F.lit(1).cast("bigint")))
        return bit.otherwise(_zero())

    def has_bit(self, mask: Column, i: Column | int) -> Column:
        return self.mask_bit(mask, i) == 1

    def ranges(self, mask: Column, lo: Column, hi: Column) -> list[Column]:
        """Words of the mask with only the bits lo..hi."""
        out = []
        for j, word in enumerate(self.split(mask)):
            first, last = F.greatest(lo - WORD * j, F.lit(0)), F.least(hi - WORD * j, F.lit(WORD - 1))
            out.append(F.when(last < first, _zero()).otherwise(word.bitwiseAND(mk.one_bit(last + 1) - mk.one_bit(first))))
        return out

    def any_in(self, mask: Column, lo: Column, hi: Column) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), self.ranges(mask, lo, hi)) != 0

    def count_in(self, mask: Column, lo: Column, hi: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.bit_count(w) for w in self.ranges(mask, lo, hi)])

    def tenure_band(self, mask: Column, at: Column) -> Column:
        return F.when(~self.any_in(mask, at - mk.MEMORY, at - 3), "lt3").when(self.has_bit(mask, at - mk.MEMORY), "12p").otherwise("3_12")

    def one_time(self, mask: Column, at: Column) -> Column:
        return ~self.any_in(mask, at - mk.MEMORY, at - 1) & ~self.has_bit(mask, at + 1) & ~self.has_bit(mask, at + 2)

    def seasonal_gap(self, mask: Column, at: Column) -> Column:
        year = at - mk.MEMORY
        return self.has_bit(mask, year - 1) & ~self.has_bit(mask, year) & self.any_in(mask, year + 1, year + mk.SEASON_RETURN)

    def flapping(self, b_any: Column, b_n: Column, at: Column) -> Column:
        """Often switching between salary and non-salary codes: the XOR with the mask moved by one, where both periods are paid."""
        paid, codes, flips = self.shifted(b_any, 1), self.shifted(b_n, 1), []
        for now, n, before, b in zip(self.split(b_any), self.split(b_n), paid, codes):
            flips.append(n.bitwiseXOR(b).bitwiseAND(now).bitwiseAND(before))
        return (at >= mk.MEMORY - 1) & (self.count_in(self.pack(flips), at - mk.MEMORY + 1, at) >= mk.FLAP_MIN)

    # ------------------------------------------------------------------ movements
    def appeared(self, mask: Column, lag: int) -> Column:
        """Periods present now and absent ``lag`` periods earlier; the first ``lag`` periods have no earlier one."""
        out = []
        for j, (now, before) in enumerate(zip(self.split(mask), self.shifted(mask, lag))):
            early = min(max(lag - WORD * j, 0), WORD)
            out.append(now.bitwiseAND(F.bitwise_not(before)).bitwiseAND(F.bitwise_not(_low(early))))
        return self.pack(out)

    def vanished(self, mask: Column, lag: int, last: int) -> Column:
        """Periods up to ``last`` absent now and present ``lag`` periods earlier."""
        out = []
        for j, (now, before) in enumerate(zip(self.split(mask), self.shifted(mask, lag))):
            out.append(before.bitwiseAND(F.bitwise_not(now)).bitwiseAND(_low(min(max(last + 1 - WORD * j, 0), WORD))))
        return self.pack(out)

    def bit_positions(self, mask: Column, last: int) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(last)), lambda i: self.has_bit(mask, i))


def words_for(last: int) -> Words:
    """Functions for histories up to period ``last``."""
    return Words(last // WORD + 1)


def of(masks: DataFrame, column: str = "b_p"):
    """The functions that fit a table's masks: one bigint, or a struct of words."""
    kind = masks.schema[column].dataType
    return Words(len(kind.fields)) if isinstance(kind, T.StructType) else mk
