"""Every allowed combination of forecast terms, calibrated on past months and scored in one pass.

A cell is a row of a small grain (such as unit × segment) and month: ``region``, ``seg``, ``mi``, ``fact``, ``plan``, one column
per base, and the arrays ``out_terms``, ``in_terms``, ``pipe_terms`` of ``forecast_terms.roll_cells``. No prediction is
written: combinations are exploded inside a task and folded there. Calibration factors of a combination come from
sums per month; they meet the cells again as one array per (base, outflow term, month, region, segment), whose
length is the number of inflow × pipeline terms and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as fc
from .forecast_terms import Variant

CALIBRATIONS = ("none", "global", "region", "seg", "affine")
VARIANT = ("base", "out_term", "in_term", "pipe_term", "calib")
COMBINATION = ("base", "o", "i", "p")
#: A line is fitted to at least so many past cells; a factor stays within the limits (fixed values).
LEAST_CELLS, FACTOR_LOW, FACTOR_HIGH = 10, 0.5, 2.0
SINGULAR = 1e-9
#: Variants whose errors agree to so many digits are equal and ordered by name: sums are folded in any order.
DIGITS = 9


def _names(variants: Sequence[Variant], family: str) -> list[Variant]:
    return [v for v in variants if v.family == family]


def allowed(variants: Sequence[Variant], double_count: bool = False) -> Column:
    """Positions o, i, p that count nobody twice: a net change next to an outflow, or history next to a plan, would."""
    ins, outs, pipes = (_names(variants, f) for f in ("in", "out", "pipe"))
    net, history = ([n for n, v in enumerate(ins) if getattr(v, flag)] for flag in ("net", "history"))
    out_none, pipe_none = (next(n for n, v in enumerate(x) if v.name == "none") for x in (outs, pipes))
    ok = ~(F.col("i").isin(net) & (F.col("o") != out_none))
    return ok if double_count else ok & ~(F.col("i").isin(history) & (F.col("p") != pipe_none))


def _with_outflow(cells: DataFrame, bases: Sequence[str]) -> DataFrame:
    """Cells with a fact, once per base and outflow term; an unknown base counts as zero."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias("b")) for b in bases]))
    x = cells.where(F.col("fact") > 0).select("region", "seg", "mi", F.col("fact").cast("double").alias("fact"), F.col("plan").cast("double").alias("plan"),
                                              "out_terms", "in_terms", "pipe_terms", each.alias("_b"))
    x = x.select("region", "seg", "mi", "fact", "plan", "in_terms", "pipe_terms", "_b.*", F.posexplode("out_terms").alias("o", "ov"))
    return x.withColumn("rest", F.col("b") - F.col("ov")).drop("b", "ov")


def _sums(cells: DataFrame, variants: Sequence[Variant], bases: Sequence[str], double_count: bool) -> DataFrame:
    x = _with_outflow(cells, bases)
    x = x.select("region", "seg", "mi", "fact", "base", "o", "rest", "pipe_terms", F.posexplode("in_terms").alias("i", "iv"))
    x = x.select("region", "seg", "mi", "fact", "base", "o", "i", (F.col("rest") + F.col("iv")).alias("rest"), F.posexplode("pipe_terms").alias("p", "pv"))
    x = x.where(allowed(variants, double_count)).withColumn("pred", F.greatest(F.col("rest") + F.col("pv"), F.lit(0.0)))
    c = F.col
    return x.groupBy(*COMBINATION, "mi", "region", "seg").agg(
        F.sum("pred").alias("sp"), F.sum("fact").alias("sa"), F.sum(c("pred") * c("pred")).alias("spp"), F.sum(c("pred") * c("fact")).alias("spa"), F.count(F.lit(1)).cast("double").alias("n"))


def calibration_factors(cells: DataFrame, variants: Sequence[Variant], bases: Sequence[str], double_count: bool = False) -> DataFrame:
    """Factors of every combination per month, region and segment, from the months before it.

    k_global, k_region, k_seg: fact over prediction, cut to the limits, 1 without a past. slope and intercept: least squares,
    NULL with fewer than ``LEAST_CELLS`` past cells or with predictions that are all equal.
    """
    before = lambda *level: W.partitionBy(*COMBINATION, *level).orderBy("mi").rangeBetween(W.unboundedPreceding, -1)
    m = _sums(cells, variants, bases, double_count)

    def factor(*level: str) -> Column:
        p = F.sum("sp").over(before(*level))
        k = F.least(F.greatest(F.sum("sa").over(before(*level)) / p, F.lit(FACTOR_LOW)), F.lit(FACTOR_HIGH))
        return F.coalesce(F.when(p > 0, k), F.lit(1.0))

    s = {c: F.sum(c).over(before()) for c in ("sp", "sa", "spp", "spa", "n")}
    det = s["n"] * s["spp"] - s["sp"] * s["sp"]
    fit = (s["n"] >= LEAST_CELLS) & (det > SINGULAR * s["n"] * s["spp"])
    slope = F.when(fit, (s["n"] * s["spa"] - s["sp"] * s["sa"]) / det)
    x = m.withColumns({"k_global": factor(), "slope": slope, "_n": s["n"], "_p": s["sp"], "_a": s["sa"]})
    x = x.withColumns({"k_region": factor("region"), "k_seg": factor("seg"), "intercept": (F.col("_a") - F.col("slope") * F.col("_p")) / F.col("_n")})
    return x.select(*COMBINATION, "mi", "region", "seg", "k_global", "k_region", "k_seg", "slope", "intercept")


def month_errors(cells: DataFrame, variants: Sequence[Variant], bases: Sequence[str], double_count: bool = False) -> DataFrame:
    """Sums of errors per variant (combination × base × calibration) and month; what every report below reads.

    The only rows kept are one per variant and month. ``exec``: error in points of the plan where there is one; five points
    exactly (to nine digits) are not over five.
    """
    factors = calibration_factors(cells, variants, bases, double_count).groupBy("base", "o", "mi", "region", "seg").agg(
        F.collect_list(F.struct("i", "p", "k_global", "k_region", "k_seg", "slope", "intercept")).alias("f"))
    # an unknown region or segment is a group of its own, so these two keys meet null-safe
    x = _with_outflow(cells, bases).join(factors.withColumnsRenamed({"region": "_r", "seg": "_s"}), ["base", "o", "mi"]).where(
        F.col("region").eqNullSafe(F.col("_r")) & F.col("seg").eqNullSafe(F.col("_s")))
    x = x.select("base", "o", "mi", "fact", "plan", "rest", "in_terms", "pipe_terms", F.inline("f"))
    c = F.col
    x = x.withColumn("raw", F.greatest(c("rest") + F.get("in_terms", c("i")) + F.get("pipe_terms", c("p")), F.lit(0.0)))
    line = F.when(c("slope").isNotNull(), F.greatest(c("intercept") + c("slope") * c("raw"), F.lit(0.0))).otherwise(c("raw"))
    pred = {"none": c("raw"), "global": c("raw") * c("k_global"), "region": c("raw") * c("k_region"), "seg": c("raw") * c("k_seg"), "affine": line}
    x = x.select(*COMBINATION, "mi", "fact", F.when(c("plan") > 0, c("plan")).alias("plan"), *[(v - c("fact")).alias(f"e_{n}") for n, v in pred.items()])
    sums = [F.sum("fact").alias("y"), F.count("plan").alias("n_plan")]
    for n in CALIBRATIONS:
        e = F.abs(f"e_{n}")
        points = e / c("plan") * 100
        sums += [F.sum(e).alias(f"abs_{n}"), F.sum(f"e_{n}").alias(f"sign_{n}"), F.sum(points).alias(f"exec_{n}"), F.count(F.when(F.round(points, 9) > 5, 1)).alias(f"gt5_{n}")]
    g = x.groupBy(*COMBINATION, "mi").agg(*sums)
    each = F.array(*[F.struct(F.lit(n).alias("calib"), c(f"abs_{n}").alias("err"), c(f"sign_{n}").alias("sign"), c(f"exec_{n}").alias("exec"), c(f"gt5_{n}").alias("gt5")) for n in CALIBRATIONS])
    name = lambda family, at: F.get(F.array(*[F.lit(v.name) for v in _names(variants, family)]), c(at))
    return g.select("base", name("out", "o").alias("out_term"), name("in", "i").alias("in_term"), name("pipe", "p").alias("pipe_term"), "mi", "y", "n_plan", F.inline(each))


def scores(errors: DataFrame) -> DataFrame:
    """WAPE, bias, error of plan execution, share of cells off by over 5 points, worst month and spread over months."""
    w = fc.share("err", "y")
    return errors.groupBy(*VARIANT).agg(
        fc.share(F.sum("err"), F.sum("y")).alias("wape"), fc.share(F.sum("sign"), F.sum("y")).alias("bias"), fc.share(F.sum("exec"), F.sum("n_plan")).alias("exec_pp"),
        fc.share(F.sum("gt5"), F.sum("n_plan")).alias("share_gt5pp"), F.max(w).alias("wape_worst"), F.stddev_pop(w).alias("wape_std"), F.count(F.lit(1)).alias("months"))


def leaders(errors: DataFrame, n: int) -> DataFrame:
    """The n best variants by WAPE, ties by name; a report with a limit."""
    return scores(errors).orderBy(F.round("wape", DIGITS), *VARIANT).limit(n)


def month_detail(errors: DataFrame, variants: DataFrame) -> DataFrame:
    """Errors by month of the given variants: an average hides the month that failed."""
    x = errors.join(variants.select(*VARIANT), list(VARIANT))
    return x.select(*VARIANT, "mi", fc.share("err", "y").alias("wape"), fc.share("sign", "y").alias("bias"), fc.share("exec", "n_plan").alias("exec_pp"))


def honest_choice(errors: DataFrame) -> DataFrame:
    """Per month the variant that was best over all months before it, what it then achieved, and the best in hindsight."""
    past = W.partitionBy(*VARIANT).orderBy("mi").rangeBetween(W.unboundedPreceding, -1)
    x = errors.withColumns({"wape_past": fc.share(F.sum("err").over(past), F.sum("y").over(past)), "wape": fc.share("err", "y")})
    # both picks fold in one aggregation: a variant without a past month is no candidate for the first
    known = F.when(F.col("wape_past").isNotNull(), F.struct(F.round("wape_past", DIGITS), *VARIANT))
    g = x.groupBy("mi").agg(F.min_by(F.struct(*VARIANT, "wape_past", "wape"), known).alias("b"), F.min("wape").alias("wape_best"))
    return g.where("b is not null").select("mi", "b.*", "wape_best")


def without_terms(errors: DataFrame) -> DataFrame:
    """What each term of the best variant is worth: the winner, then the winner without a term, a calibration, everything."""
    score = scores(errors).select(*VARIANT, "wape", "bias", "exec_pp")
    best = score.agg(F.min_by(F.struct(*VARIANT), F.struct(F.round("wape", DIGITS), *VARIANT)).alias("w")).select("w.*")
    drops = {"winner": (), "no outflow": ("out_term",), "no inflow": ("in_term",), "no pipeline": ("pipe_term",), "no calibration": ("calib",),
             "base only": ("out_term", "in_term", "pipe_term", "calib")}
    cases = F.array(*[F.struct(F.lit(name).alias("case"), *[(F.lit("none") if v in drop else F.col(v)).alias(v) for v in VARIANT]) for name, drop in drops.items()])
    return best.select(F.inline(cases)).join(score, list(VARIANT))


def best_of_family(errors: DataFrame, family: str) -> DataFrame:
    """The best variant with each term of a family."""
    s = scores(errors).select(*VARIANT, "wape")
    return s.groupBy(family).agg(F.min_by(F.struct(*[v for v in VARIANT if v != family], "wape"), F.struct(F.round("wape", DIGITS), *VARIANT)).alias("b")).select(family, "b.*")


def naive_forecasts(cells: DataFrame, keys: Sequence[str], first: int, trends: Sequence[int] = (2, 3)) -> DataFrame:
    """Forecasts without terms, scored like variants: last fact, plan, the mart's own ``prediction``, sum of organisations (``orgs``), trends.

    Scored from month ``first`` on; earlier months are history only. A trend is the last fact grown by the mean growth of the
    last k months. A forecast that is zero everywhere has no source and is left out. Windows run over the months of one cell.
    """
    w = W.partitionBy(*keys).orderBy("mi")
    at = lambda k: F.coalesce(F.max("fact").over(w.rangeBetween(-k, -k)).cast("double"), F.lit(0.0))
    x = cells.withColumns({"_last": at(1), "_first": F.min("mi").over(W.partitionBy(*keys)), **{f"_f{k}": at(k) for k in range(1, max(trends) + 2)}})
    rows = {"last fact": F.col("_last"), "plan": F.col("plan"), "mart prediction": F.col("prediction"), "sum of organisations": F.col("orgs")}
    for k in trends:
        num = den = F.lit(0.0)
        for j in range(1, k + 1):
            was, cur, known = F.col(f"_f{j + 1}"), F.col(f"_f{j}"), F.col("mi") - j - 1 >= F.col("_first")
            num, den = num + F.when(known & (was > 0), (cur - was) / was).otherwise(0.0), den + known.cast("double")
        rows[f"trend {k}"] = F.greatest(F.col("_last") * (1 + F.coalesce(F.try_divide(num, den), F.lit(0.0))), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("pred")) for n, v in rows.items()])
    x = x.select("mi", "fact", F.when(F.col("plan") > 0, F.col("plan")).alias("plan"), F.inline(each)).where((F.col("fact") > 0) & (F.col("mi") >= first))
    e = F.col("pred") - F.col("fact")
    g = x.groupBy("name", "mi").agg(F.sum(F.abs(e)).alias("err"), F.sum(e).alias("sign"), F.sum("fact").alias("y"), F.sum(F.abs(e) / F.col("plan") * 100).alias("exec"),
                                    F.count("plan").alias("n_plan"), F.sum(F.abs("pred")).alias("size"))
    return g.groupBy("name").agg(fc.share(F.sum("err"), F.sum("y")).alias("wape"), fc.share(F.sum("sign"), F.sum("y")).alias("bias"), fc.share(F.sum("exec"), F.sum("n_plan")).alias("exec_pp"),
                                 F.max(fc.share("err", "y")).alias("wape_worst"), F.sum("size").alias("_size")).where("_size > 0").drop("_size")
