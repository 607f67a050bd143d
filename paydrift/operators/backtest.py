"""Forecast backtest: terms at organisation grain, rolled once per grain, combined at the small grain.

A panel is long: org, unit, seg, mi, present, stock, outflow, inflow, pipe (planned). Terms use months
strictly before the target only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as fc

ORG = ("org",)
# Fixed values of the rule formula.
ONE_OFF, RECOVERED, SEASON_UP, SEASON_DOWN, MIN_SEASON_OBS, BACK = 0.5, 0.5, 1.1, 0.9, 2, 0.95


def _w():
    return W.partitionBy("org").orderBy("mi")


def org_rows(facts: DataFrame, meta: DataFrame, first: int, last: int) -> DataFrame:
    """``org_panel`` with one row per organisation: ``rows`` holds its months in order.

    Only the months of the facts are shuffled. Months without a row, and flows, are filled in inside the array, so nothing
    of the size organisations × months is joined or sorted.
    """
    c, rest, dims = F.col, [x for x in facts.columns if x not in ("org", "mi")], [x for x in meta.columns if x != "org"]
    kind = {f.name: f.dataType for f in facts.select("mi", F.coalesce("stock", F.lit(0)).alias("stock"), *[x for x in rest if x != "stock"]).schema}
    own = F.struct(c("mi").cast("int").alias("mi"), *[(F.coalesce(x, F.lit(0)) if x == "stock" else c(x)).alias(x) for x in rest], F.lit(True).alias("present"))
    x = facts.groupBy("org").agg(F.collect_list(F.when(c("mi").between(first, last), own)).alias("_own"))
    x = x.join(meta.groupBy("org").agg(F.collect_list(F.struct(*dims)).alias("_dims")), "org")
    none = lambda m: F.struct(m.alias("mi"), *[F.lit(0 if x == "stock" else None).cast(kind[x]).alias(x) for x in rest], F.lit(False).alias("present"))
    missing = F.array_except(F.sequence(F.lit(first), F.lit(last)), c("_own.mi"))
    x = x.select("org", "_dims", F.array_sort(F.concat("_own", F.transform(missing, none))).alias("_all"))
    beside = lambda r: F.transform("_dims", lambda d: F.struct(*[r[n].alias(n) for n in ("mi", *rest, "present")], *[d[n].alias(n) for n in dims]))
    x = x.select("org", F.flatten(F.transform("_all", beside)).alias("_rows"))

    def flows(r: Column, k: Column) -> Column:
        prev = F.get("_rows", k - 1)["stock"]
        d = r["stock"] - prev
        return F.struct(*[r[n].alias(n) for n in ("mi", *rest, "present", *dims)], F.greatest(F.coalesce(-d, F.lit(0)), F.lit(0)).alias("outflow"),
                        F.greatest(F.coalesce(d, F.lit(0)), F.lit(0)).alias("inflow"), F.coalesce(prev, F.lit(0)).alias("base"))

    return x.select("org", F.transform("_rows", flows).alias("rows"))


def org_panel(facts: DataFrame, meta: DataFrame, first: int, last: int) -> DataFrame:
    """Organisation × month with a presence flag that is not the same as zero; flows from neighbouring months."""
    return org_rows(facts, meta, first, last).select("org", F.inline("rows"))


def rule_features(pan: DataFrame, min_fallback: float = 5.0, year: int = 12) -> DataFrame:
    """What the rule formula reads of an organisation's past, beside the panel: lags, last year, seasonal ratio.

    The seasonal ratio comes from earlier averages of the target's and the base's calendar months, else
    from last year.
    """
    w = _w()
    lag = lambda c, k: F.lag(c, k).over(w).cast("double")
    slot = F.pmod("mi", F.lit(year))
    same = W.partitionBy("org", "_slot").orderBy("mi").rowsBetween(W.unboundedPreceding, -1)
    x = pan.withColumn("_slot", slot).withColumn("_x", F.when(F.col("present"), F.col("stock").cast("double")))
    x = x.withColumns({"avg_cur": F.coalesce(F.avg("_x").over(same), F.lit(0.0)), "n_cur": F.count(F.lit(1)).over(same)})
    # averages of the base month's calendar slot, as known before the target: the base row itself is included
    incl = W.partitionBy("org", "_slot").orderBy("mi").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"_ac": F.coalesce(F.avg("_x").over(incl), F.lit(0.0)), "_nc": F.count(F.lit(1)).over(incl)})
    x = x.withColumns({"avg_cls": lag("_ac", 1), "n_cls": F.lag("_nc", 1).over(w)})
    ratio_idx = F.when((F.col("n_cur") >= MIN_SEASON_OBS) & (F.col("n_cls") >= MIN_SEASON_OBS) & (F.col("avg_cls") > 0), F.col("avg_cur") / F.col("avg_cls"))
    x = x.withColumns({"o1": lag("outflow", 1), "o2": lag("outflow", 2), "b": F.col("base").cast("double"), "before": lag("stock", year + 1), "fl_y": lag("stock", year), "out_y": lag("outflow", year),
                       "after": F.greatest(lag("stock", 11), lag("stock", 10), lag("stock", 9)), "r_idx": ratio_idx})
    c = F.col
    return x.withColumn("ratio", F.coalesce("r_idx", F.when(c("before") >= min_fallback, c("fl_y") / F.greatest(c("before"), F.lit(1.0)))))


def rule_value(one_off: float = ONE_OFF, recovered: float = RECOVERED, up: float = SEASON_UP, down: float = SEASON_DOWN, persist: str = "mean") -> Column:
    """The rule over ``rule_features``: season before persistent outflow; positive is outflow, capped at the stock."""
    c = F.col
    both = (c("o1") > 0) & (c("o2") > 0)
    keep = {"max": F.greatest("o1", "o2"), "min": F.least("o1", "o2"), "mean": (c("o1") + c("o2")) / 2}[persist]
    per = F.when(both, keep).otherwise(0.0)
    rec = F.coalesce((c("out_y") > 0) & (c("before") > 0) & (c("after") >= BACK * c("before")), F.lit(False))
    drop = F.greatest(per, c("b") * (1 - c("ratio"))) * F.when(rec, recovered).otherwise(1.0)
    pred = (F.when(c("ratio") > up, -c("b") * (c("ratio") - 1)).when(c("ratio") < down, drop).when(both, per).when(c("o1") > 0, c("o1") * one_off).otherwise(0.0))
    return F.when(pred > 0, F.least(pred, c("b"))).otherwise(pred)


def rule_forecast(pan: DataFrame, one_off: float = ONE_OFF, recovered: float = RECOVERED, up: float = SEASON_UP, down: float = SEASON_DOWN,
                  persist: str = "mean", min_fallback: float = 5.0, year: int = 12) -> DataFrame:
    """Rule formula: seasonal move, persistent outflow, one-off outflow per organisation and month."""
    return rule_features(pan, min_fallback, year).select("org", "mi", rule_value(one_off, recovered, up, down, persist).alias("rule"))


def pooled_rates(pan: DataFrame, part: str = "outflow") -> DataFrame:
    """Rates of segment and whole from all months before the target, by two running sums over months."""
    m = pan.where("present").groupBy("seg", "mi").agg(F.sum(part).alias("p"), F.sum("base").alias("q"))
    w = W.partitionBy("seg").orderBy("mi").rowsBetween(W.unboundedPreceding, -1)
    t = m.groupBy("mi").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    wt = W.partitionBy(F.lit(0)).orderBy("mi").rowsBetween(W.unboundedPreceding, -1)
    t = t.select("mi", fc.share(F.sum("tp").over(wt), F.sum("tq").over(wt)).alias("rate_all"))
    return m.select("seg", "mi", fc.share(F.sum("p").over(w), F.sum("q").over(w)).alias("rate_seg")).join(t, "mi")


def term_grid(pan: DataFrame, rates_out: DataFrame, rates_in: DataFrame, ks: Sequence[int] = (1, 3, 6), lams: Sequence[float] = (0.0, 5.0), alphas: Sequence[float] = (0.3, 0.5),
              plan_ks: Sequence[float] = (0.5, 1.0)) -> DataFrame:
    """Outflow, inflow and pipeline variants per organisation and month, one long frame (family, term, value)."""
    return long_terms(wide_terms(pan, rates_out, rates_in, ks, lams, alphas, plan_ks), term_names(ks, lams, alphas, plan_ks))


def term_names(ks: Sequence[int] = (1, 3, 6), lams: Sequence[float] = (0.0, 5.0), alphas: Sequence[float] = (0.3, 0.5), plan_ks: Sequence[float] = (0.5, 1.0)) -> list[tuple[str, str]]:
    names = [("out", "none"), ("out", "rule"), ("in", "none"), ("in", "rule"), ("pipe", "none")]
    for fam in ("out", "in"):
        for k in ks:
            names += [(fam, f"mean_k{k}"), *((fam, f"rate_k{k}_lam{lam:g}") for lam in lams)]
        names += [(fam, "median_k3"), *((fam, f"ewma{a:g}") for a in alphas)]
    return names + [("pipe", f"plan_k{k:g}") for k in plan_ks]


def long_terms(wide: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    rows = ", ".join(f"'{fam}', '{t}', t{i}" for i, (fam, t) in enumerate(names))
    return wide.selectExpr("org", "unit", "seg", "mi", "stock", "base", f"stack({len(names)}, {rows}) as (family, term, value)")


def wide_terms(pan: DataFrame, rates_out: DataFrame, rates_in: DataFrame, ks: Sequence[int] = (1, 3, 6), lams: Sequence[float] = (0.0, 5.0), alphas: Sequence[float] = (0.3, 0.5),
               plan_ks: Sequence[float] = (0.5, 1.0), by_org: DataFrame | None = None, months: tuple[int, int] | None = None) -> DataFrame:
    """The terms of ``term_grid`` as columns ``t0`` and on, in the order of ``term_names``; only the given months are worked out.

    Terms come from ``forecast_terms.Past``: organisations travel with their months, so nothing of the panel's size is joined or sorted.
    ``by_org``: the same panel by organisation, where it lies so already.
    """
    from . import forecast_terms as ft
    b = lambda p: p.b

    def rate(fam: str, c: str, k: int, lam: float):
        def value(p: ft.Past) -> np.ndarray:
            own = p.rate(f"{fam}@seg")
            num, den = p.sum(c, k) + lam * np.nan_to_num(own), p.sum("base", k) + lam
            return b(p) * np.nan_to_num(np.where(den != 0, num / den, own))   # no base yet: the segment's rate
        return value

    terms = [lambda p: 0 * b(p), lambda p: np.maximum(p.rule(), 0.0), lambda p: 0 * b(p), lambda p: np.maximum(-p.rule(), 0.0), lambda p: 0 * b(p)]
    for fam, c in (("out", "out"), ("in", "inflow")):
        for k in ks:
            terms += [lambda p, c=c, k=k: p.mean(c, k), *(rate(fam, c, k, lam) for lam in lams)]
        terms += [lambda p, c=c: p.median(c, 3), *(lambda p, c=c, a=a: p.weighted(c, a) for a in alphas)]
    terms += [lambda p, k=k: p.pipe * k for k in plan_ks]
    rates = {f"{fam}@seg": ft.by_place(df.select("seg", "mi", "rate_seg"), "seg", "rate_seg") for fam, df in (("out", rates_out), ("in", rates_in))}
    if by_org is None:
        by_org = ft.rows_by_org(pan)
    return ft.each_month(by_org, [(f"t{n}", v) for n, v in enumerate(terms)], ["unit", "seg", "mi", "stock", "base"], rates, months, pairs=True)


def roll_terms(terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every term summed once to a grain (unit × segment, unit, whole)."""
    return terms.groupBy(*keys, "mi", "family", "term").agg(F.sum("value").alias("value"))


def actuals(pan: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pan.groupBy(*keys, "mi").agg(F.sum("stock").alias("fact"), F.sum("base").alias("base"))


def calibrate(rolled: DataFrame, facts: DataFrame, keys: Sequence[str], limits: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Global and affine calibration of terms from past months only, the factor clipped.

    ``facts``: keys, mi, actual of the family. Sums per term and month are small; windows run over months.
    """
    j = rolled.join(facts, [*keys, "mi"])
    m = j.groupBy("family", "term", "mi").agg(F.sum("value").alias("p"), F.sum("actual").alias("a"), F.sum(F.col("value") * F.col("value")).alias("pp"), F.sum(F.col("value") * F.col("actual")).alias("pa"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("family", "term").orderBy("mi").rowsBetween(W.unboundedPreceding, -1)
    s = {c: F.sum(c).over(w) for c in ("p", "a", "pp", "pa", "n")}
    k = F.least(F.greatest(F.coalesce(F.try_divide(s["a"], s["p"]), F.lit(1.0)), F.lit(limits[0])), F.lit(limits[1]))
    det = s["n"] * s["pp"] - s["p"] * s["p"]
    slope = F.when(det > 1e-9, (s["n"] * s["pa"] - s["p"] * s["a"]) / det)
    return m.select("family", "term", "mi", k.alias("k_global"), F.coalesce(slope, F.lit(1.0)).alias("slope"), F.coalesce((s["a"] - slope * s["p"]) / s["n"], F.lit(0.0)).alias("intercept"))


def combine(rolled: DataFrame, facts: DataFrame, keys: Sequence[str], scales: Sequence[float] = (1.0,)) -> DataFrame:
    """base − out + in + pipe for every allowed combination of terms at a small grain.

    The three families are folded into one array each per (grain, month), so combinations come from
    exploding short arrays of a row, not from joining frames. A pipeline next to a seasonal inflow of the
    rule would count people twice and is left out.
    """
    one = rolled.groupBy(*keys, "mi").agg(*[F.sort_array(F.collect_list(F.when(F.col("family") == f, F.struct("term", "value")))).alias(f"_{f}") for f in ("out", "in", "pipe")])
    x = facts.join(one, [*keys, "mi"]).withColumn("o", F.explode("_out")).withColumn("i", F.explode("_in")).withColumn("p", F.explode("_pipe")).withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    ok = ~((F.col("i.term") == "rule") & (F.col("p.term") != "none"))
    pred = F.col("base") - F.col("scale") * F.col("o.value") + F.col("scale") * F.col("i.value") + F.col("p.value")
    return x.where(ok).select(*keys, "mi", F.col("o.term").alias("out_term"), F.col("i.term").alias("in_term"), F.col("p.term").alias("pipe_term"), "scale", "fact", "base", pred.alias("pred"))


COMBO = ("out_term", "in_term", "pipe_term", "scale")


def totals(pred: DataFrame, by: Sequence[str] = COMBO) -> DataFrame:
    """WAPE and bias alone: predictions are folded where they are exploded, none is written or shuffled."""
    return pred.groupBy(*by).agg(fc.share(F.sum(F.abs(F.col("pred") - F.col("fact"))), F.sum("fact")).alias("wape"), fc.share(F.sum(F.col("pred") - F.col("fact")), F.sum("fact")).alias("bias"))


def metrics(pred: DataFrame, by: Sequence[str] = COMBO) -> DataFrame:
    """WAPE, bias, p90 of the relative error, worst month, spread over months, rank correlation."""
    e = F.abs(F.col("pred") - F.col("fact"))
    x = pred.withColumns({"e": e, "rel": F.try_divide(e, F.col("fact").cast("double"))})
    m = x.groupBy(*by, "mi").agg(F.sum("e").alias("e"), F.sum("fact").alias("f")).withColumn("w", fc.share("e", "f"))
    worst = m.groupBy(*by).agg(F.max("w").alias("worst_month"), F.stddev("w").alias("std_month"))
    a = x.groupBy(*by).agg(fc.share(F.sum("e"), F.sum("fact")).alias("wape"), fc.share(F.sum(F.col("pred") - F.col("fact")), F.sum("fact")).alias("bias"), F.percentile("rel", 0.9).alias("p90"))
    return a.join(worst, list(by))


def rank_correlation(pred: DataFrame, by: Sequence[str] = ("mi",)) -> DataFrame:
    """Spearman correlation of predicted and actual change, ties by average rank."""
    by = list(by)
    x = pred.select(*by, F.round(F.col("pred") - F.col("base"), 9).alias("x"), (F.col("fact") - F.col("base")).cast("double").alias("y"))
    # equal pairs are one row with a weight, so a common value (no change) is small before any shuffle on it
    pairs = x.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    r = pairs.join(average_ranks(pairs, by, "x"), [*by, "x"]).join(average_ranks(pairs, by, "y"), [*by, "y"])
    a, b, w = F.col("rank_x"), F.col("rank_y"), F.col("w")
    s = r.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    n, sa, sb = F.col("n"), F.col("a"), F.col("b")
    spread = F.sqrt((n * F.col("aa") - sa * sa) * (n * F.col("bb") - sb * sb))
    return s.select(*by, F.try_divide(n * F.col("ab") - sa * sb, spread).alias("spearman"))


def average_ranks(rows: DataFrame, by: Sequence[str], col: str, parts: int = 200) -> DataFrame:
    """Average rank of every value of ``col`` (rows weigh ``w``) per ``by``, without sorting a whole key in one task.

    Values are cut at approximate quantiles into parts; ranks run inside a part and start after the rows of the
    parts below it. The cuts decide only where the parts lie, ranks are exact wherever they lie.
    """
    v = rows.groupBy(*by, col).agg(F.sum("w").alias("c"))
    cuts = v.groupBy(*by).agg(F.percentile_approx(col, [k / parts for k in range(1, parts)], 1000).alias("cuts"))
    v = v.join(cuts, list(by)).select(*by, col, "c", F.size(F.filter("cuts", lambda q: q <= F.col(col))).alias("part"))
    per = v.groupBy(*by, "part").agg(F.sum("c").alias("n"))
    below = per.select(*by, "part", F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("below"))
    inside = F.coalesce(F.sum("c").over(W.partitionBy(*by, "part").orderBy(col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return v.join(below, [*by, "part"]).select(*by, col, (F.col("below") + inside + (F.col("c") + 1) / 2).alias(f"rank_{col}"))


def coverage(pan: DataFrame) -> DataFrame:
    """Share of the actual ups and downs of stock that the bookkeeping columns explain."""
    d = F.col("stock") - F.col("base")
    x = pan.where("present").groupBy("mi").agg(F.sum(F.when(d > 0, d)).alias("up"), F.sum(F.when(d < 0, -d)).alias("down"), F.sum("booked_in").alias("bi"), F.sum("booked_out").alias("bo"))
    return x.select("mi", "up", "down", fc.share("bi", "up").alias("share_up"), fc.share("bo", "down").alias("share_down"))


def baselines(facts: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """Last fact, k-month trend, the plan: forecasts any formula has to beat."""
    w = W.partitionBy(*keys).orderBy("mi")
    x = facts.withColumns({"_a": F.lag("fact", 1).over(w).cast("double"), "_b": F.lag("fact", 1 + k).over(w).cast("double")})
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("pred")) for n, v in (
        ("last fact", F.col("_a")), (f"trend {k}", F.col("_a") + (F.col("_a") - F.col("_b")) / k), ("plan", F.col("plan").cast("double")))])
    return x.select(*keys, "mi", "fact", "base", F.explode(rows).alias("b")).select(*keys, "mi", "fact", "base", "b.*").where("pred is not null")


def honest_selection(pred: DataFrame, by: Sequence[str] = COMBO, first: int = 0) -> DataFrame:
    """For each month the winner of all months before it, and what it then achieved."""
    m = pred.groupBy(*by, "mi").agg(F.sum(F.abs(F.col("pred") - F.col("fact"))).alias("e"), F.sum("fact").alias("f"))
    w = W.partitionBy(*by).orderBy("mi").rowsBetween(W.unboundedPreceding, -1)
    x = m.withColumns({"past": fc.share(F.sum("e").over(w), F.sum("f").over(w)), "wape": fc.share("e", "f")}).where(F.col("past").isNotNull() & (F.col("mi") >= first))
    return x.groupBy("mi").agg(F.min_by(F.struct(*by, "past", "wape"), F.struct("past", *by)).alias("b")).select("mi", "b.*")


def ablation(pred: DataFrame, winner: dict[str, str | float]) -> DataFrame:
    """The winner with each of its terms dropped in turn."""
    rows = []
    for drop in (None, "out_term", "in_term", "pipe_term"):
        want = {k: ("none" if k == drop else v) for k, v in winner.items()}
        c = F.lit(True)
        for k, v in want.items():
            c = c & (F.col(k) == v)
        rows.append((drop or "full", c))
    label = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rows]))
    x = pred.withColumn("variant", F.explode(label))
    return x.groupBy("variant").agg(fc.share(F.sum(F.abs(F.col("pred") - F.col("fact"))), F.sum("fact")).alias("wape"))


def family_best(scores: DataFrame, family: str) -> DataFrame:
    """Best combination per term of one family."""
    return scores.groupBy(family).agg(F.min_by(F.struct(*[c for c in COMBO if c != family], "wape"), F.struct("wape", *COMBO)).alias("b")).select(family, "b.*")
