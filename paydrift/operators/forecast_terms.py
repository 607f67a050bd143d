"""Variants of the forecast's terms per organisation and month, and the pooled rates they lean on.

The panel is that of ``backtest.org_panel`` with ``region``, ``won`` (clients won by deals) and ``pipe`` (plan of the month).
Everything a variant reads lies strictly before the target month. Organisations travel as one row with their months in
order; a task stacks those of a batch to matrices of months × organisations, and a variant is a function of the rows
before a target month, worked out for all organisations of the batch at once. Level rates are one number per level and month.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table
from ..sources.scans import collect_guard
from .backtest import BACK, MIN_SEASON_OBS, ONE_OFF, RECOVERED, SEASON_DOWN, SEASON_UP

#: A month-to-month ratio is cut to these limits and not taken from a stock below the third value (fixed values).
RATIO_LOW, RATIO_HIGH, RATIO_LEAST_STOCK = 0.5, 2.0, 5
DEPTH = 12
FAMILIES = ("out", "in", "pipe")


@dataclass(frozen=True)
class Variant:
    """One way to work out a term. ``net``: contains the outflow; ``history``: contains clients won by deals."""

    family: str
    name: str
    value: Callable[[Past], np.ndarray] | None
    net: bool = False
    history: bool = False


def window_rates(pan: DataFrame, level: Sequence[str], part: str, whole: str, ks: Sequence[int | None] = (1, 3, 6, None)) -> DataFrame:
    """Share of ``part`` in ``whole`` per level over the k months before (None: all of them), 0 where nothing is known.

    Sums per level and month come first, so windows run over months only.
    """
    m = pan.groupBy(*level, "mi").agg(F.sum(part).cast("double").alias("_p"), F.sum(whole).cast("double").alias("_q"))
    w = (W.partitionBy(*level) if level else W.partitionBy(F.lit(0))).orderBy("mi")
    rates = []
    for k in ks:
        f = w.rangeBetween(W.unboundedPreceding if k is None else -k, -1)
        q = F.sum("_q").over(f)
        rates.append(F.coalesce(F.when(q > 0, F.sum("_p").over(f) / q), F.lit(0.0)).alias(f"rate_{k or 'all'}"))
    return m.select(*level, "mi", *rates)


def growth_rates(pan: DataFrame, level: Sequence[str], months: int = 3) -> DataFrame:
    """Mean monthly growth of a level's stock over the last months before the target, 0 where none is known."""
    m = pan.groupBy(*level, "mi").agg(F.sum("stock").cast("double").alias("_s"))
    w = (W.partitionBy(*level) if level else W.partitionBy(F.lit(0))).orderBy("mi")
    prev = F.max("_s").over(w.rangeBetween(-1, -1))
    m = m.withColumn("_g", F.when(prev > 0, (F.col("_s") - prev) / prev))
    return m.select(*level, "mi", F.coalesce(F.avg("_g").over(w.rangeBetween(-months, -1)), F.lit(0.0)).alias("growth"))


def plan_realisation(deals: DataFrame, limit: float = 2.0) -> DataFrame:
    """Share of the planned clients that closed months really brought (deals: mi, plan, fact); 1 without a plan."""
    m = deals.groupBy("mi").agg(F.sum("plan").cast("double").alias("_p"), F.sum("fact").cast("double").alias("_f"))
    w = W.partitionBy(F.lit(0)).orderBy("mi").rangeBetween(W.unboundedPreceding, -1)
    p = F.sum("_p").over(w)
    share = F.least(F.greatest(F.coalesce(F.sum("_f").over(w), F.lit(0.0)) / p, F.lit(0.0)), F.lit(limit))
    return m.select("mi", F.coalesce(F.when(p > 0, share), F.lit(1.0)).alias("realised"))


@dataclass
class History:
    """What variants read: organisations with their months (``rows``, as ``backtest.org_rows`` gives them) and the rates of levels."""

    by_org: DataFrame
    seg: DataFrame
    growth: dict[str, DataFrame]
    realised: DataFrame


def rows_by_org(pan: DataFrame) -> DataFrame:
    """A panel with one row per organisation, its months in order."""
    return pan.groupBy("org").agg(F.sort_array(F.collect_list(F.struct("mi", *[c for c in pan.columns if c not in ("org", "mi")]))).alias("rows"))


def by_place(df: DataFrame, level: str | None, value: str) -> dict:
    """A small table of rates by level and month; more than a short list is refused."""
    return {((r[level], r["mi"]) if level else r["mi"]): r[value] for r in collect_guard(df).to_dict("records")}


def with_history(pan: DataFrame, deals: DataFrame, by_org: DataFrame | None = None) -> History:
    """The panel by organisation beside the rates of levels. ``by_org``: the same panel where it lies by organisation already."""
    if by_org is None:
        by_org = rows_by_org(pan)
    levels = stage_table(pan.groupBy("region", "seg", "mi").agg(F.sum("outflow").alias("outflow"), F.sum("stock").alias("stock")), f"levels-{uuid4().hex}")
    growth = {name: growth_rates(levels, level) for name, level in (("whole", []), ("region", ["region"]), ("seg", ["seg"]))}
    return History(by_org, window_rates(levels, ["seg"], "outflow", "stock"), growth, plan_realisation(deals))


class Past:
    """The rows before a target row of many organisations that have the same months; matrices are rows × organisations, NaN is unknown."""

    def __init__(self, mi: np.ndarray, values: dict[str, np.ndarray], rates: dict[str, dict], levels: dict[str, np.ndarray], year: int = 12, min_fallback: float = 5.0):
        self.mi, self.v, self.rates, self.levels, self.year, self.min_fallback, self.t, self.known = mi, values, rates, levels, year, min_fallback, 0, {}
        self.rules: np.ndarray | None = None  # the rule's values where they were worked out on other rows
        there = values["present"] > 0
        was = np.vstack([np.full((1, there.shape[1]), np.nan), values["stock"][:-1]])
        both = there & np.vstack([np.zeros((1, there.shape[1]), bool), there[:-1]])
        own = lambda c: np.where(there, values[c], np.nan)
        ratio = np.clip(np.divide(values["stock"], was, out=np.full(was.shape, np.nan), where=was > 0), RATIO_LOW, RATIO_HIGH) - 1
        self.c = {"out": own("outflow"), **{c: own(c) for c in ("won", "inflow", "stock", "base") if c in values}, "delta": np.where(both, values["stock"] - was, np.nan), "ratio": np.where(both & (was >= RATIO_LEAST_STOCK), ratio, np.nan)}

    def at(self, t: int) -> Past:
        self.t, self.known = t, {}
        return self

    def once(self, key, build):
        if key not in self.known:
            self.known[key] = build()
        return self.known[key]

    @property
    def b(self) -> np.ndarray:
        return self.v["base"][self.t]

    @property
    def pipe(self) -> np.ndarray:
        return np.nan_to_num(self.v["pipe"][self.t])

    def lag(self, name: str, k: int) -> np.ndarray:
        x = self.v[name]
        return x[self.t - k] if self.t >= k else np.full(x.shape[1], np.nan)

    def rows(self, c: str, k: int | None) -> np.ndarray:
        return self.c[c][0 if k is None else max(self.t - k, 0):self.t]

    def sum(self, c: str, k: int | None) -> np.ndarray:
        return self.once(("sum", c, k), lambda: np.nansum(self.rows(c, k), 0))

    def mean(self, c: str, k: int | None) -> np.ndarray:
        n = (~np.isnan(self.rows(c, k))).sum(0)
        return np.divide(self.sum(c, k), n, out=np.zeros(len(n)), where=n > 0)

    def median(self, c: str, k: int) -> np.ndarray:
        x = np.sort(self.rows(c, k), 0)  # unknown values come last
        n = (~np.isnan(x)).sum(0)
        if not len(x):
            return np.zeros(len(n))
        low, high = (np.take_along_axis(x, np.maximum(at, 0)[None], 0)[0] for at in ((n - 1) // 2, np.minimum(n // 2, len(x) - 1)))
        return np.where(n > 0, (low + high) / 2, 0.0)

    def weighted(self, c: str, alpha: float) -> np.ndarray:
        """Exponentially weighted mean of the last months, weights of unknown months left out."""
        x = self.rows(c, DEPTH)
        w = alpha * (1 - alpha) ** np.arange(len(x) - 1, -1, -1.0)
        known = self.once(("known", c), lambda: (~np.isnan(x)).astype(float))
        num, den = w @ self.once(("filled", c), lambda: np.nan_to_num(x)), w @ known
        return np.divide(num, den, out=np.zeros(len(den)), where=den > 0)

    def rate(self, name: str) -> np.ndarray:
        """A level's rate for the target month, NaN where the level is unknown."""
        def build():
            level, rates, mi = name.partition("@")[2], self.rates[name], int(self.mi[self.t])
            if not level:
                return np.full(len(self.b), rates.get(mi, np.nan))
            number, names = self.levels[level]
            return np.array([*(rates.get((n, mi), np.nan) for n in names), np.nan])[number[self.t]]
        return self.once(("rate", name), build)

    def own_rate(self, k: int | None, lam: float) -> np.ndarray:
        """Outflow over stock of the k months before, shrunk to the segment's rate by ``lam`` clients."""
        num, den = self.sum("out", k), self.sum("stock", k)
        own = np.divide(num, den, out=np.zeros(len(den)), where=den > 0)
        if not lam:
            return own
        return (den * own + lam * np.nan_to_num(self.rate(f"rate_{k or 'all'}@seg"))) / (den + lam)

    def season(self) -> np.ndarray:
        """Seasonal ratio as in ``backtest.rule_features``: averages of the calendar month and of the one before it, else last year."""
        def average(slot: int, to: int) -> tuple[np.ndarray, int]:
            at = [u for u in range(to) if self.mi[u] % self.year == slot]
            x = self.c["stock"][at]
            n = (~np.isnan(x)).sum(0)
            return np.divide(np.nansum(x, 0), n, out=np.zeros(len(n)), where=n > 0), len(at)

        def build():
            t, before, last = self.t, self.lag("stock", self.year + 1), self.lag("stock", self.year)
            ratio = np.where(before >= self.min_fallback, last / np.maximum(before, 1.0), np.nan)
            if t:
                (cur, n_cur), (close, n_close) = average(self.mi[t] % self.year, t), average(self.mi[t - 1] % self.year, t)
                if n_cur >= MIN_SEASON_OBS and n_close >= MIN_SEASON_OBS:
                    ratio = np.where(close > 0, np.divide(cur, close, out=np.zeros(len(cur)), where=close > 0), ratio)
            return ratio
        return self.once("season", build)

    def rule(self, one_off: float = ONE_OFF, recovered: float = RECOVERED, up: float = SEASON_UP, down: float = SEASON_DOWN, persist: str = "mean") -> np.ndarray:
        """``backtest.rule_value``: season before persistent outflow; positive is outflow, capped at the stock."""
        if self.rules is not None:
            return self.rules[self.t]
        o1, o2, b, ratio, before = self.lag("outflow", 1), self.lag("outflow", 2), self.b, self.season(), self.lag("stock", self.year + 1)
        both = (o1 > 0) & (o2 > 0)
        keep = {"max": np.maximum, "min": np.minimum, "mean": lambda x, y: (x + y) / 2}[persist](o1, o2)
        per = np.where(both, keep, 0.0)
        after = np.fmax(np.fmax(self.lag("stock", 11), self.lag("stock", 10)), self.lag("stock", 9))
        rec = (self.lag("outflow", self.year) > 0) & (before > 0) & (after >= BACK * before)
        drop = np.maximum(per, b * (1 - ratio)) * np.where(rec, recovered, 1.0)
        pred = np.where(ratio > up, -b * (ratio - 1), np.where(ratio < down, drop, np.where(both, per, np.where(o1 > 0, o1 * one_off, 0.0))))
        return np.where(pred > 0, np.minimum(pred, b), pred)


def _zero(p: Past) -> np.ndarray:
    return np.zeros(len(p.b))


def out_variants() -> list[Variant]:
    """Outflow: none, the rule and its constants one at a time, shrunk rates, weighted means, medians."""
    def rule(**const) -> Callable:
        return lambda p: np.maximum(p.rule(**const), 0.0)

    found = {"none": _zero, "rule": rule()}
    found |= {f"rule_one_off{k:g}": rule(one_off=k) for k in (0.0, 0.25, 1.0)}
    found |= {f"rule_recovered{k:g}": rule(recovered=k) for k in (0.2, 0.7, 1.0)}
    found |= {f"rule_season{up:g}_{down:g}": rule(up=up, down=down) for up, down in ((1.05, 0.95), (1.2, 0.8))}
    found |= {f"rule_persist_{p}": rule(persist=p) for p in ("max", "min")}
    found |= {f"rate_k{k or 'all'}_lam{lam:g}": lambda p, k=k, lam=lam: p.own_rate(k, lam) * p.b for k in (1, 3, 6, None) for lam in (0.0, 5.0)}
    found |= {f"ewma{a:g}": lambda p, a=a: p.weighted("out", a) for a in (0.3, 0.5, 0.7)}
    found |= {f"median_k{k}": lambda p, k=k: p.median("out", k) for k in (3, 6)}
    return [Variant("out", n, v) for n, v in found.items()]


def in_variants() -> list[Variant]:
    """Inflow: none, the rule's seasonal return, won clients, growth of a level, change of stock and its ratio."""
    found = [Variant("in", "none", _zero), Variant("in", "rule_season", lambda p: np.maximum(-p.rule(), 0.0))]
    won = {f"won_mean_k{k}": lambda p, k=k: p.mean("won", k) for k in (1, 2, 3, 6)} | {f"won_median_k{k}": lambda p, k=k: p.median("won", k) for k in (3, 6)}
    won |= {f"won_ewma{a:g}": lambda p, a=a: p.weighted("won", a) for a in (0.3, 0.5, 0.7)}
    won |= {f"growth_{level}": lambda p, level=level: np.fmax(p.rate(f"growth@{level}".removesuffix("@whole")) * p.b, 0.0) for level in ("whole", "region", "seg")}
    net = {f"delta_ewma{a:g}": lambda p, a=a: p.weighted("delta", a) for a in (0.3, 0.5)}
    net |= {f"delta_median_k{k}": lambda p, k=k: p.median("delta", k) for k in (3, 6)} | {f"delta_mean_k{k}": lambda p, k=k: p.mean("delta", k) for k in (3, 6)}
    net |= {f"ratio_mean_k{k}": lambda p, k=k: p.mean("ratio", k) * p.b for k in (3, 6, 12)} | {f"ratio_ewma{a:g}": lambda p, a=a: p.weighted("ratio", a) * p.b for a in (0.3, 0.5)}

    def shrunk(p: Past, lam: float) -> np.ndarray:
        weight = p.b / (p.b + lam)
        return (weight * p.mean("ratio", 6) + (1 - weight) * p.rate("growth@seg")) * p.b

    net |= {f"ratio_shrunk_lam{lam:g}": lambda p, lam=lam: shrunk(p, lam) for lam in (20.0, 100.0)}
    return found + [Variant("in", n, v, history=True) for n, v in won.items()] + [Variant("in", n, v, net=True, history=True) for n, v in net.items()]


def pipe_variants() -> list[Variant]:
    """Plan of deals: none, a fixed share of it, the share that past months realised."""
    found = {"none": _zero} | {f"plan_x{k:g}": lambda p, k=k: p.pipe * k for k in (0.3, 0.5, 0.7, 1.0)} | {"plan_x_past": lambda p: p.pipe * p.rate("realised")}
    return [Variant("pipe", n, v) for n, v in found.items()]


def all_variants() -> list[Variant]:
    return out_variants() + in_variants() + pipe_variants()


def _numbers(x: pa.Array) -> np.ndarray:
    """A column as doubles, NaN where it is null."""
    return np.asarray(x.cast(pa.float64()).to_numpy(zero_copy_only=False), float)


def _stacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]:
    """Organisations of a batch that have the same months, together: their numbers, months, places of their rows, and all rows."""
    lists = batch.column(1)
    rows, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
    start, mi = np.cumsum(size) - size, rows.field("mi").to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(size[size > 0]):
        own = np.flatnonzero(size == n)
        place = start[own][:, None] + np.arange(n)
        months, group = np.unique(mi[place], axis=0, return_inverse=True)
        for g, m in enumerate(months):
            mine = group.ravel() == g
            yield own[mine], m, place[mine].T, rows


def term_columns(history: History, variants: Sequence[Variant], keys: Sequence[str], first: int | None = None) -> DataFrame:
    """One row per organisation and month (from ``first`` on), one column ``family:name`` per variant."""
    rates = {f"{c}@seg": by_place(history.seg, "seg", c) for c in history.seg.columns if c.startswith("rate_")} | {"realised": by_place(history.realised, None, "realised")}
    rates |= {"growth" if name == "whole" else f"growth@{name}": by_place(df, None if name == "whole" else name, "growth") for name, df in history.growth.items()}
    keep = [c for c in dict.fromkeys([*keys, "mi", "present", "stock", "base"]) if c != "org"]
    return each_month(history.by_org, [(f"{v.family}:{v.name}", v.value) for v in variants], keep, rates, None if first is None else (first, None))


def each_month(by_org: DataFrame, values: Sequence[tuple[str, Callable[[Past], np.ndarray]]], keep: Sequence[str], rates: dict[str, dict], months: tuple[int, int | None] | None = None, pairs: bool = False) -> DataFrame:
    """Values of every organisation and month (within ``months``) beside the columns ``keep``; a value that is unknown is zero.

    ``pairs``: rows of an organisation that repeat a month stand beside the rule of each of them, as a join by month would have it.
    """
    fields = by_org.schema["rows"].dataType.elementType
    keep, read = list(keep), [c for c in ("present", "stock", "base", "outflow", "inflow", "won", "pipe") if c in fields.names]
    levels = sorted({name.partition("@")[2] for name in rates} - {""})
    schema = T.StructType([by_org.schema["org"], *[T.StructField(c, fields[c].dataType) for c in keep], *[T.StructField(n, T.DoubleType()) for n, _ in values]])
    low, high = months or (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, mi, place, rows in _stacked(batch):
                x, rules = {c: _numbers(rows.field(c)).take(place) for c in read}, None
                if pairs and len(np.unique(mi)) < len(mi):
                    left, right = np.nonzero(mi[:, None] == mi)
                    order = np.lexsort((-left, right, mi[left]))  # a month's rows once per rule, the last row first
                    left, right = left[order], right[order]
                    once = Past(mi, x, rates, {})
                    with np.errstate(invalid="ignore", divide="ignore"):
                        rules = np.stack([once.at(t).rule() for t in range(len(mi))])[right]
                    mi, place, x = mi[left], place[left], {c: v[left] for c, v in x.items()}
                numbered = {}
                for c in levels:
                    coded = rows.field(c).dictionary_encode()
                    numbered[c] = (coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).take(place), coded.dictionary.to_pylist())
                past = Past(mi, x, rates, numbered)
                past.rules = rules
                for t in np.flatnonzero((mi >= (mi.min() if low is None else low)) & (mi <= (mi.max() if high is None else high))):
                    past.at(t)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        found = [pa.array(np.nan_to_num(v(past))) for _, v in values]
                    kept = rows.take(pa.array(place[t]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *[kept.field(c) for c in keep], *found], schema.names)

    return by_org.select("org", "rows").mapInArrow(run, schema)


def roll_cells(wide: DataFrame, variants: Sequence[Variant], keys: Sequence[str]) -> DataFrame:
    """All terms summed to a grain: one row per cell and month, an array of sums per family in the order of ``variants``.

    Sums are folded before the shuffle; what is shuffled is a row per task and cell, not one per organisation and term.
    """
    total = {f: F.array(*[F.sum(f"`{v.family}:{v.name}`") for v in variants if v.family == f]).alias(f"{f}_terms") for f in FAMILIES}
    return wide.groupBy(*keys, "mi").agg(*total.values())
