"""Pair-level anomalies: events of a period against the previous one, feature cube, scores, evidence, mart.

Roles of four periods: ``curr`` and ``prev`` this year, the same a year ago; tags a, p, ya, yp.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from .ranking import top_n_per_group

PAIR = ("org", "unit")
FEATURES = ("income", "history", "jobs")
GROUP = (*PAIR, *FEATURES)
LOST = ("threshold", "code", "same_org", "new_place", "other_job", "missing")   # fixed values: movements of leavers
PAY_EDGES = (30000, 60000, 100000, 200000)                                         # fixed values: pay bands
ALL = -1


def _n() -> Column:
    return F.count(F.lit(1))


def _sum_if(c: Column, v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.sum(F.when(c, v)), F.lit(0))


def pay_band(v: Column) -> Column:
    out = None
    for i, e in enumerate(PAY_EDGES, 1):
        out = F.when(v < e, i) if out is None else out.when(v < e, i)
    return out.otherwise(len(PAY_EDGES) + 1)


def pair_events(states: DataFrame, curr: int, prev: int, earlier: int, period: int) -> DataFrame:
    """Triples of two periods with pay band, history, job count before, and what happened to them.

    The full join of the periods and the four look-ups become one fold per triple and two
    aggregations of its result (person, person × organisation).
    """
    at = lambda m: F.col("mi") == m
    p = F.col("st") == "P"
    z = F.lit(0).cast("decimal(28,2)")
    g = states.where(F.col("mi").isin(curr, prev, earlier)).groupBy("person", *PAIR).agg(
        F.max(F.when(at(curr), F.col("st"))).alias("curr_state"), F.coalesce(F.bool_or(at(curr) & p), F.lit(False)).alias("in_curr"),
        F.coalesce(F.bool_or(at(prev) & p), F.lit(False)).alias("in_prev"), F.coalesce(F.bool_or(at(earlier) & p), F.lit(False)).alias("in_earlier"),
        F.coalesce(F.bool_or(at(prev) & (p | (F.col("fot_amt") > 0))), F.lit(False)).alias("prev_ok"), F.min("region").alias("region"),
        *[F.coalesce(F.sum(F.when(at(m), F.col(c))), z).alias(f"{t}_{n}") for t, m in (("curr", curr), ("prev", prev)) for n, c in (("rub", "pf_amt"), ("bonus", "bonus"), ("fot", "fot_amt"))])
    g = g.withColumns({f"prev_{n}": F.when(F.col("prev_ok"), F.col(f"prev_{n}")).otherwise(z) for n in ("rub", "bonus", "fot")})
    by_org = g.groupBy("person", "org").agg(F.bool_or("in_curr").alias("org_curr"), F.bool_or("in_prev").alias("org_prev"), F.bool_or(F.col("in_curr") & ~F.col("in_prev")).alias("org_new"))
    by_person = by_org.groupBy("person").agg(F.count_if("org_prev").alias("n_jobs"), F.bool_or("org_curr").alias("has_curr"), F.bool_or("org_new").alias("new_place"))
    e = g.where("in_curr or prev_ok or curr_fot > 0").join(by_org.select("person", "org", "org_curr"), ["person", "org"]).join(by_person, "person")
    move = (F.when(F.col("in_prev") & F.col("in_curr"), "continuing").when(~F.col("in_prev") & ~F.col("in_curr"), "outside_portfolio").when(~F.col("in_prev"), "added")
            .when(F.col("curr_state") == "Z", "threshold").when(F.col("curr_state") == "N", "code").when(F.col("org_curr"), "same_org")
            .when(F.col("new_place"), "new_place").when(F.col("has_curr"), "other_job").otherwise("missing"))
    inp = F.col("in_prev")
    return e.select(F.lit(period).alias("period"), "person", *PAIR, "region", F.col("in_curr").cast("int").alias("in_curr"), inp.cast("int").alias("in_prev"),
                    "curr_rub", "prev_rub", "curr_bonus", "prev_bonus", "curr_fot", "prev_fot",
                    F.when(~inp, 0).otherwise(pay_band(F.col("prev_rub"))).alias("income"), F.when(~inp, 0).when(F.col("in_earlier"), 2).otherwise(1).alias("history"),
                    F.when(~inp, 0).otherwise(F.least(F.col("n_jobs"), F.lit(4))).cast("int").alias("jobs"), move.alias("movement"))


def cube_sets(depth: int = 2) -> list[tuple[str, ...]]:
    return [part for size in range(depth + 1) for part in combinations(FEATURES, size)]


def cube(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], depth: int = 2) -> DataFrame:
    """Totals of the keys and of every 1- and 2-feature subgroup in one expand; -1 says "all"."""
    sets = [[F.col(k) for k in keys] + [F.col(f) for f in part] for part in cube_sets(depth)]
    g = df.groupingSets(sets, *[F.col(k) for k in keys], *[F.col(f) for f in FEATURES]).agg(*aggs, *[F.grouping(f).alias(f"_g_{f}") for f in FEATURES])
    return g.withColumns({f: F.when(F.col(f"_g_{f}") == 1, ALL).otherwise(F.col(f)) for f in FEATURES}).drop(*[f"_g_{f}" for f in FEATURES])


def feature_cube(events: DataFrame) -> DataFrame:
    """Money, people, stayers, bonus and leaving reasons of pairs and subgroups, both years side by side."""
    now, ago, stay = F.col("period") == 0, F.col("period") == 1, F.col("movement") == "continuing"
    aggs = [F.min("region").alias("region")]
    for c, name in (("curr", "actual"), ("prev", "prior")):
        for t, cond in (("", now), ("year_", ago)):
            aggs += [_sum_if(cond, f"{c}_rub").alias(f"{t}{name}"), _sum_if(cond, f"in_{c}").alias(f"n_{t}{name}"), _sum_if(cond & stay, f"{c}_rub").alias(f"stay_{t}{name}"),
                     _sum_if(cond & stay, f"{c}_bonus").alias(f"bonus_{t}{name}"), _sum_if(cond, f"{c}_fot").alias(f"fot_{t}{name}")]
    aggs += [F.count_if(now & stay).alias("stay_n"), F.count_if(ago & stay).alias("stay_year_n"), F.count_if(now & (F.col("prev_fot") > 0)).alias("fot_n_prior"),
             F.count_if(ago & (F.col("prev_fot") > 0)).alias("fot_n_year_prior"),
             F.bool_and((F.col("curr_fot") == F.col("curr_rub")) & (F.col("prev_fot") == F.col("prev_rub"))).alias("fot_matches_pf")]
    for m in LOST:
        hit = now & (F.col("movement") == m)
        aggs += [F.count_if(hit).alias(m), _sum_if(hit, "prev_rub").alias(f"{m}_rub")]
    return cube(events, PAIR, aggs)


def is_pair() -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) == ALL for f in FEATURES])


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def seasonal_expected(groups: DataFrame) -> DataFrame:
    """expected = prior + (year actual − year prior) for money and people; pay of stayers per head without bonus."""
    c = _d
    prior_wb = c("stay_prior") - c("bonus_prior")
    per_head = ((c("stay_year_actual") - c("bonus_year_actual")) - (c("stay_year_prior") - c("bonus_year_prior"))) * F.try_divide(c("stay_n"), c("stay_year_n"))
    return groups.withColumns({
        "expected": c("prior") + c("year_actual") - c("year_prior"), "expected_n": F.col("n_prior") + F.col("n_year_actual") - F.col("n_year_prior"),
        "stay_without_bonus": c("stay_actual") - c("bonus_actual"), "prior_without_bonus": prior_wb, "expected_stay": prior_wb + per_head,
        "fot_expected": c("fot_prior") + c("fot_year_actual") - c("fot_year_prior")})


def supported(expected: str | Column, prior: str | Column, ratio: float) -> Column:
    e, p = _d(expected), _d(prior)
    return e.between(p * ratio, p / ratio) & (e > 0)


def _score(ok: Column, actual: str, expected: str, prior: str, ratio: float) -> Column:
    return F.when(ok & supported(expected, prior, ratio), (_d(actual) - _d(expected)) / F.greatest(_d(expected), _d(prior)))


def score(groups: DataFrame, min_people: int, ratio: float) -> DataFrame:
    """Relative change, only with enough people and a base within the ratio limits, else NULL."""
    x = seasonal_expected(groups)
    both = (F.col("n_prior") >= min_people) & (F.col("n_year_prior") >= min_people)
    stay = (F.col("stay_n") >= min_people) & (F.col("stay_year_n") >= min_people)
    fot = (F.col("fot_n_prior") >= min_people) & (F.col("fot_n_year_prior") >= min_people)
    turn = F.when(both, F.greatest(F.lit(0.0), (F.col("n_prior") - F.col("stay_n")) / F.col("n_prior") - (F.col("n_year_prior") - F.col("stay_year_n")) / F.col("n_year_prior")))
    return x.withColumns({"rub_change": _score(both, "actual", "expected", "prior", ratio), "n_change": _score(both, "n_actual", "expected_n", "n_prior", ratio),
                          "stay_change": _score(stay, "stay_without_bonus", "expected_stay", "prior_without_bonus", ratio),
                          "fot_change": _score(fot, "fot_actual", "fot_expected", "fot_prior", ratio), "turnover_change": turn})


def is_signal(min_change: float) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.abs(c) >= min_change, F.lit(False)) for c in ("rub_change", "n_change", "stay_change")])


def summary_counts(scored: DataFrame, min_people: int, min_change: float) -> DataFrame:
    """Comparable pairs, gross up and down, added, stopped, seasonal, weak bases, tested groups and signals."""
    r, act, exp = F.col("rub_change"), _d("actual"), F.col("expected")
    pair = scored.where(is_pair() & ((F.col("n_actual") > 0) | (F.col("n_prior") > 0))).agg(
        _n().alias("pairs"), F.sum("n_actual").alias("n_actual"), F.sum("actual").alias("actual"), F.count_if(r.isNotNull()).alias("comparable"),
        _sum_if(r.isNotNull(), act).alias("comparable_actual"), _sum_if(r.isNotNull(), exp).alias("comparable_expected"), _sum_if(r < 0, exp - act).alias("gross_down"), _sum_if(r > 0, act - exp).alias("gross_up"),
        F.count_if((F.col("n_prior") == 0) & (F.col("n_actual") > 0)).alias("added"), F.count_if((F.col("n_prior") > 0) & (F.col("n_actual") == 0)).alias("stopped"),
        F.count_if((F.col("n_prior") >= min_people) & (F.col("n_year_prior") >= min_people) & r.isNull()).alias("weak_base"),
        F.count_if(F.coalesce((F.abs(r) < min_change) & (F.try_divide(_d("prior") - act, _d("prior")) >= min_change), F.lit(False))).alias("seasonal"))
    tested = scored.where(r.isNotNull() | F.col("n_change").isNotNull() | F.col("stay_change").isNotNull()).agg(
        F.struct(_n().alias("tested"), F.count_if(is_signal(min_change)).alias("signals")).alias("t")).scalar()
    return pair.withColumn("t", tested).select("*", "t.*").drop("t")


def shortlist(scored: DataFrame, min_people: int, min_change: float, max_pairs: int = 12, max_groups: int = 3) -> DataFrame:
    """Per level × direction the pairs with most money at stake, and the groups inside them.

    The four directions are an array per candidate, not a cross join.
    """
    sig = is_signal(min_change)
    edge = is_pair() & (((F.col("n_prior") == 0) & (F.col("n_actual") >= min_people)) | ((F.col("n_actual") == 0) & (F.col("n_prior") >= min_people)))
    c = scored.where(sig | edge).withColumns({"level": F.when(is_pair(), "pair").otherwise("group"), "sig": sig,
                                               "depth": sum((F.when(F.col(f) >= 0, 1).otherwise(0) for f in FEATURES), F.lit(0))})
    v = c.withColumn("direction", F.explode(F.array(*[F.lit(d) for d in (-1, 1, -2, 2)]))).where((F.abs("direction") == 1) | ~F.col("sig"))
    d = F.col("direction")
    one = F.abs(d) == 1
    parts = [F.when(one & (F.col("rub_change") * d >= min_change), (_d("actual") - F.col("expected")) * d),
             F.when(one & (F.col("n_change") * d >= min_change), (F.col("n_actual") - F.col("expected_n")) * d * F.try_divide(_d("prior"), _d("n_prior"))),
             F.when(one & (F.col("stay_change") * d >= min_change), (F.col("stay_without_bonus") - F.col("expected_stay")) * d),
             F.when((F.col("level") == "pair") & (d == -2) & (F.col("n_actual") == 0) & (F.col("n_prior") >= min_people), _d("prior")),
             F.when((F.col("level") == "pair") & (d == 2) & (F.col("n_prior") == 0) & (F.col("n_actual") >= min_people), _d("actual"))]
    v = v.withColumn("priority", F.greatest(*parts)).where("priority > 0")
    inside = top_n_per_group(v, ["level", "direction", *PAIR], [F.desc("priority"), F.asc("depth"), *[F.asc(f) for f in FEATURES]], max_groups, "within_pair")
    chosen = top_n_per_group(inside.where("within_pair = 1"), ["level", "direction"], [F.desc("priority"), *[F.asc(k) for k in PAIR]], max_pairs, "pos").select(*PAIR).distinct()
    return inside.join(chosen, list(PAIR), "left_semi").select(*GROUP).distinct()


def anomaly_metrics(scored: DataFrame, min_change: float) -> DataFrame:
    """Five metrics in long form: credits, recipients, stayers' pay, turnover, payroll."""
    turn = lambda n, s: F.try_divide(100.0 * (F.col(n) - F.col(s)), F.col(n).cast("double"))
    per = F.try_divide(_d("prior"), _d("n_prior"))
    none = F.lit(None).cast("double")
    rows = [("portfolio_credits", _d("prior"), _d("actual"), _d("expected"), F.col("rub_change"), none, F.col("n_prior")),
            ("recipients", _d("n_prior"), _d("n_actual"), _d("expected_n"), F.col("n_change"), per, F.col("n_prior")),
            ("continuing_pay", F.col("prior_without_bonus"), F.col("stay_without_bonus"), F.col("expected_stay"), F.col("stay_change"), none, F.col("n_prior")),
            ("turnover", none, turn("n_prior", "stay_n"), turn("n_year_prior", "stay_year_n"), F.col("turnover_change"), per, F.col("n_prior")),
            ("fot", _d("fot_prior"), _d("fot_actual"), _d("fot_expected"), F.col("fot_change"), none, F.col("fot_n_prior"))]
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), p.alias("prior"), a.alias("actual"), e.alias("expected"), s.alias("score"), r.alias("rub_per_person"), n.alias("n_prior")) for m, p, a, e, s, r, n in rows])
    x = scored.select(*GROUP, "region", "stay_n", F.explode(arr).alias("m")).select(*GROUP, "region", "stay_n", "m.*")
    outside = reduce(lambda a, b: a | b, [F.col(f) == 0 for f in FEATURES])
    return x.where(~((F.col("metric") == "fot") & outside)).where(is_pair() | F.coalesce(F.abs("score") >= min_change, F.lit(False)))


# ------------------------------------------------------------------ evidence

def matched_moves(events: DataFrame) -> DataFrame:
    """Unambiguous moves between units of one organisation: one place lost, one gained, equal amounts; both edges."""
    left, new = F.col("movement") == "same_org", F.col("movement") == "added"
    p = events.where(left | new).groupBy("period", "person", "org").agg(
        F.max(F.when(left, F.col("unit"))).alias("source"), F.max(F.when(new, F.col("unit"))).alias("target"), F.sum("prev_rub").alias("amount"), F.sum("curr_rub").alias("curr"),
        F.count_if(left).alias("nl"), F.count_if(new).alias("nn")).where("nl = 1 and nn = 1 and curr = amount and amount > 0")
    return p.select("period", "person", "org", F.explode(F.array("source", "target")).alias("unit"), "source", "target", "amount")


def move_routes(moves: DataFrame) -> DataFrame:
    return moves.where((F.col("period") == 0) & (F.col("unit") == F.col("source"))).groupBy("org", "source", "target").agg(_n().alias("people"), F.sum("amount").alias("amount"))


def daily_windows(lines: DataFrame, periods: Sequence[int], threshold, exempt: DataFrame | None, bonus_codes: Sequence, border: int = 15) -> DataFrame:
    """Half-month sums of the daily fact regrouped to eight windows, the threshold applied after.

    Window 2j is calendar month j of ``periods``, window 2j+1 the 16–15 window ending in it. One
    aggregation of the fact; a half month is then exploded to the windows it belongs to.
    """
    pos, pf, fot, fixed = F.col("amt") > 0, F.col("is_pf"), F.col("is_fot"), F.col("is_fixed")
    z = F.lit(0).cast("decimal(18,2)")
    s = lambda c: F.sum(F.when(c, F.col("amt")).otherwise(z))
    half = F.when(F.dayofmonth("day") <= border, 1).otherwise(2)
    months = sorted({m - back for m in periods for back in (0, 1)})   # no window reaches into another month
    h = lines.where(F.col("mi").isin(months)).groupBy("mi", "person", *PAIR, half.alias("half")).agg(
        s(pf).alias("sum_pf"), s(fot).alias("sum_fot"), F.bool_or(pf & pos).alias("pos_pf"), F.bool_or(fixed & pos).alias("pos_fixed"), s(pos & fixed).alias("a_fixed"),
        s(pos & pf & ~fixed).alias("a_pf"), s(pos & fot & ~fixed).alias("a_fot"), s(pos & pf & F.col("code").isin(list(bonus_codes))).alias("a_bonus"))
    wins = []
    for j, m in enumerate(periods):
        wins.append(F.when(F.col("mi") == m, F.lit(2 * j)))
        wins.append(F.when(((F.col("mi") == m) & (F.col("half") == 1)) | ((F.col("mi") == m - 1) & (F.col("half") == 2)), F.lit(2 * j + 1)))
    w = h.withColumn("w", F.explode(F.array_compact(F.array(*wins))))
    g = w.groupBy("w", "person", *PAIR).agg(*[F.sum(c).alias(c) for c in ("sum_pf", "sum_fot", "a_fixed", "a_pf", "a_fot", "a_bonus")], *[F.bool_or(c).alias(c) for c in ("pos_pf", "pos_fixed")])
    if exempt is not None:
        g = g.join(exempt.select("org").distinct().withColumn("exempt", F.lit(True)), "org", "left")
    free = F.coalesce(F.col("exempt"), F.lit(False)) if exempt is not None else F.lit(False)
    from .triples import in_portfolio
    over_pf, over_fot = free | (F.col("sum_pf") > threshold), free | (F.col("sum_fot") > threshold)
    inside = in_portfolio(threshold, free)
    out = g.select("w", "person", *PAIR, inside.alias("in_pf"), F.when(inside, F.col("a_fixed") + F.when(over_pf, F.col("a_pf")).otherwise(z)).otherwise(z).alias("pf_amt"),
                   F.when(inside & over_pf, F.col("a_bonus")).otherwise(z).alias("bonus"), (F.col("a_fixed") + F.when(over_fot, F.col("a_fot")).otherwise(z)).alias("fot_amt"))
    return out.where("in_pf or fot_amt > 0").drop("in_pf")


def daily_groups(days: DataFrame, events: DataFrame, moves: DataFrame) -> DataFrame:
    """Daily windows tagged by the monthly events and folded to the same pairs and subgroups."""
    e = events.select("period", "person", *PAIR, *FEATURES, "movement")
    m = moves.select("period", "person", *PAIR, F.lit(True).alias("moved"))
    t = (days.withColumn("period", F.when(F.col("w") < 4, 0).otherwise(1)).join(e, ["period", "person", *PAIR], "left").join(m, ["period", "person", *PAIR], "left")
         .withColumns({f: F.coalesce(f, F.lit(0)) for f in FEATURES}))
    stay, moved = F.col("movement") == "continuing", F.coalesce("moved", F.lit(False))
    w = lambda i: F.col("w") == i
    aggs = []
    for i in range(8):
        aggs += [F.count_if(w(i) & (F.col("pf_amt") > 0)).alias(f"n{i}"), _sum_if(w(i), "pf_amt").alias(f"amount{i}"), _sum_if(w(i) & stay, "pf_amt").alias(f"stay{i}"),
                 _sum_if(w(i) & stay, "bonus").alias(f"bonus{i}"), _sum_if(w(i) & moved, "pf_amt").alias(f"moved{i}")]
    aggs.append(F.bool_and(F.col("pf_amt") == F.col("fot_amt")).alias("day_fot_ok"))
    return cube(t, PAIR, aggs)


def evidence(scored: DataFrame, daily: DataFrame, stale: DataFrame, doubtful_regions: Sequence, min_change: float, ratio: float, sync: float = 1.0) -> DataFrame:
    """Border shift, unit transfer, bonus and the confirmed part of each signal.

    Only where the daily windows repeat the monthly figures, the region's data are complete and the
    pair is not stale; otherwise the reason why not.
    """
    hit = [F.coalesce(F.abs(c) >= min_change, F.lit(False)) for c in ("rub_change", "stay_change", "fot_change")]
    c = scored.where(hit[0] | hit[1] | hit[2]).join(daily, list(GROUP), "left").join(stale.select(*PAIR).distinct().withColumn("stale", F.lit(True)), list(PAIR), "left")
    names = ("actual", "prior", "year_actual", "year_prior")
    z = lambda x: F.coalesce(_d(x), F.lit(0.0))
    off = F.lit(False)
    for i, n in enumerate(names):
        off = off | (z(f"n{2 * i}") != _d(f"n_{n}"))
        for d, m in (("amount", n), ("stay", f"stay_{n}"), ("bonus", f"bonus_{n}")):
            off = off | (F.abs(z(f"{d}{2 * i}") - _d(m)) > sync)
    delta = lambda k: z(f"{k}1") - z(f"{k}3") - z(f"{k}5") + z(f"{k}7")
    reg = {n: z(f"stay{2 * i + 1}") - z(f"bonus{2 * i + 1}") for i, n in enumerate(names)}
    exp = reg["prior"] + (reg["year_actual"] - reg["year_prior"]) * F.try_divide(_d("stay_n"), _d("stay_year_n"))
    state = (F.when(F.col("stale"), "pair differs from summary").when(F.col("region").isin(list(doubtful_regions)) if doubtful_regions else F.lit(False), "region incomplete")
             .when(off, "daily and monthly differ"))
    ok = state.isNull()
    gap = reg["actual"] - exp
    real = (ok & (F.abs("stay_change") >= min_change) & (reg["actual"] > 0) & (reg["prior"] > 0) & supported(exp, reg["prior"], ratio)
            & (F.abs(gap) >= min_change * F.greatest(exp, reg["prior"])) & (gap * F.col("stay_change") > 0))
    return c.select(*GROUP, F.when(ok & F.col("rub_change").isNotNull(), _d("actual") - F.col("expected") - delta("amount")).alias("calendar_rub"), F.when(ok, delta("moved")).alias("transfer_rub"),
                    F.when(ok, delta("bonus")).alias("bonus_rub"), F.when(real, gap).alias("confirmed_rub"), ok.alias("checked"),
                    (F.col("fot_matches_pf") & F.coalesce("day_fot_ok", F.lit(True))).alias("fot_matches_pf"), state.alias("state"))


def signals(metrics: DataFrame, ev: DataFrame, min_change: float) -> DataFrame:
    """Adjustment, confirmed and open amount, so that raw = adjustment + confirmed + open."""
    money = F.col("metric").isin("portfolio_credits", "fot")
    e = ev.withColumnRenamed("fot_matches_pf", "_fot_ok").withColumn("metric", F.explode(F.array(*[F.lit(m) for m in ("portfolio_credits", "continuing_pay", "fot")])))
    e = e.where((F.col("metric") != "fot") | F.col("_fot_ok")).drop("_fot_ok")
    x = metrics.where(F.abs("score") >= min_change).join(e, [*GROUP, "metric"], "left")
    d = F.col("actual") - F.col("expected")
    raw = (F.when(F.col("metric") == "turnover", -d * F.col("n_prior") * F.col("rub_per_person") / 100).when(F.col("metric") == "recipients", d * F.col("rub_per_person")).otherwise(d))
    adj = F.when(money & F.col("checked"), F.col("calendar_rub") + F.col("transfer_rub") + F.col("bonus_rub"))
    x = x.withColumns({"delta": d, "raw_rub": raw, "adjustment": adj})
    rest, conf = F.col("delta") - F.col("adjustment"), F.col("confirmed_rub")
    share = F.when(F.coalesce(rest * conf > 0, F.lit(False)), F.signum(conf) * F.least(F.abs(rest), F.abs(conf)))
    confirmed = F.when(F.col("metric") == "continuing_pay", conf).when(money, share)
    opened = (F.when((F.col("metric") == "continuing_pay") & conf.isNotNull(), F.col("delta") - conf).when(money & F.col("checked"), rest - F.coalesce(share, F.lit(0.0))).otherwise(F.col("raw_rub")))
    return x.withColumns({"confirmed": confirmed, "open_rub": opened})


def top_contributor(sig: DataFrame) -> DataFrame:
    """Inside a signal the subgroup that carries disproportionately much of it.

    A parent is an ancestor of a child when its features are "all" or equal: each child is exploded to
    its few ancestors and joined by equality, in place of an inequality self-join.
    """
    s = sig.where(F.col("metric").isin("portfolio_credits", "continuing_pay", "fot"))
    ups = F.array_distinct(F.array(*[F.struct(*[(F.col(f) if f in keep else F.lit(ALL)).cast("int").alias(f) for f in FEATURES])
                                     for n in range(len(FEATURES)) for keep in combinations(FEATURES, n)]))
    child = s.select(*PAIR, "metric", *[F.col(f).alias(f"c_{f}") for f in FEATURES], F.col("expected").alias("c_exp"), F.col("raw_rub").alias("c_raw"), F.col("confirmed").alias("c_conf"),
                     F.col("stay_n").alias("c_stay"), F.col("n_prior").alias("c_n"), F.explode(ups).alias("up"))
    same = reduce(lambda a, b: a & b, [F.col(f"up.{f}") == F.col(f"c_{f}") for f in FEATURES])
    child = child.where(~same).select(*PAIR, "metric", *[F.col(f"up.{f}").alias(f) for f in FEATURES], *[f"c_{f}" for f in FEATURES], "c_exp", "c_raw", "c_conf", "c_stay", "c_n")
    j = s.select(*GROUP, "metric", "expected", "raw_rub", "confirmed").join(child, [*GROUP, "metric"])
    by_conf = F.col("confirmed").isNotNull()
    a, b = F.when(by_conf, F.col("confirmed")).otherwise(F.col("raw_rub")), F.when(by_conf, F.col("c_conf")).otherwise(F.col("c_raw"))
    fit = (F.col("c_exp") > 0) & (F.col("c_exp") < F.col("expected")) & (a * b > 0) & (F.abs(b) <= F.abs(a)) & (F.abs(b) * F.col("expected") > F.abs(a) * F.col("c_exp"))
    pick = F.min_by(F.struct(*[f"c_{f}" for f in FEATURES], b.alias("contribution"), F.when(by_conf, F.col("c_stay")).otherwise(F.col("c_n")).alias("people")),
                    F.struct((-F.abs(b)).alias("k"), *[f"c_{f}" for f in FEATURES]))
    return j.where(fit).groupBy(*GROUP, "metric").agg(pick.alias("t")).select(*GROUP, "metric", "t.*")


def group_key() -> Column:
    parts = [F.when(F.col(f) >= 0, F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in FEATURES]
    return F.when(is_pair(), "all").otherwise(F.concat_ws(",", *parts))


def anomaly_month(sig: DataFrame, metrics: DataFrame, min_change: float, run_id: int) -> DataFrame:
    """The mart row of each signal: status, contributor, amounts, text."""
    top = top_contributor(sig)
    whole = metrics.where(is_pair()).select(*PAIR, "metric", F.coalesce(F.abs("score") >= min_change, F.lit(False)).alias("pair_has_deviation"))
    x = sig.join(whole, [*PAIR, "metric"], "left").join(top, [*GROUP, "metric"], "left")
    conf, chk = F.coalesce("confirmed", F.lit(0.0)) != 0, F.coalesce("checked", F.lit(False))
    status = (F.when(conf, "confirmed").when(chk & (F.abs("open_rub") <= 1), "explained").when(chk, "open").when(F.col("state").isNotNull(), "check_unavailable").otherwise("awaiting_checks"))
    money = lambda c: F.concat(F.format_number(F.abs(c), 2), F.lit(" RUB"))
    signed = lambda c, label: F.when(F.col("metric").isin("portfolio_credits", "fot") & (F.abs(c) > 1), F.concat(F.lit(f" {label} "), F.when(F.col(c) < 0, "-").otherwise("+"), money(F.col(c)), F.lit(".")))
    text = fc.case_text(
        F.col("metric"), F.when(F.col("delta") < 0, " below expectation by ").otherwise(" above expectation by "),
        F.when(F.col("metric") == "recipients", F.concat(F.format_number(F.abs("delta"), 0), F.lit(" persons.")))
        .when(F.col("metric") == "turnover", F.concat(F.format_number(F.abs("delta"), 2), F.lit(" points."))).otherwise(F.concat(money(F.col("delta")), F.lit("."))),
        signed("calendar_rub", "Month border:"), signed("transfer_rub", "Moves between units:"), signed("bonus_rub", "Bonuses:"),
        F.when(conf, F.concat(F.lit(" Confirmed for the same persons: "), money(F.col("confirmed")), F.lit("."))),
        F.when(chk & (F.abs("open_rub") > 1), F.concat(F.lit(" Unexplained: "), money(F.col("open_rub")), F.lit("."))),
        F.when(F.col("state").isNotNull() & ~chk, F.concat(F.lit(" "), F.col("state"), F.lit("."))))
    child = F.concat_ws(",", *[F.when(F.col(f"c_{f}") >= 0, F.concat(F.lit(f"{f}="), F.col(f"c_{f}").cast("string"))) for f in FEATURES])
    return x.select(*PAIR, "region", "metric", group_key().alias("group_key"), F.when(F.col("contribution").isNotNull(), child).alias("contributor"), F.col("contribution").alias("contributor_rub"),
                    F.col("people").alias("contributor_people"), "pair_has_deviation", conf.alias("has_deviation"), status.alias("status"), "prior", "actual", "expected", "delta",
                    F.try_divide(100.0 * F.col("delta"), F.col("expected")).alias("delta_pct"), "raw_rub", "adjustment", "confirmed", "open_rub", text.alias("case_text"), F.lit(run_id).cast("bigint").alias("run_id"))


def write_anomaly_month(rows: DataFrame, path: str, period: str, run_id: int) -> DataFrame:
    """Replace one month of the mart, unless it was written from a newer summary."""
    from ..sources import marts
    spark = rows.sparkSession
    marts.newer_run_guard(spark, path, period, run_id)
    marts.mart_replace_period(rows, path, period, "anomaly")
    return marts.read_mart(spark, path)


def anomaly_control(mart: DataFrame, sync: float = 1.0) -> DataFrame:
    """Row counts by status, duplicate keys, rows whose sums do not add up."""
    st = F.col("status")
    off = (F.abs(F.col("actual") - F.col("expected") - F.col("delta")) > sync) | (F.abs(
        F.col("raw_rub") - F.coalesce("adjustment", F.lit(0.0)) - F.coalesce("confirmed", F.lit(0.0)) - F.col("open_rub")) > sync)
    k = mart.groupBy(*PAIR, "metric", "group_key").agg(_n().alias("n"), F.count_if("has_deviation").alias("c"), F.count_if(st == "explained").alias("e"), F.count_if(st == "open").alias("o"),
                                                       F.count_if(st.isin("awaiting_checks", "check_unavailable")).alias("w"), F.count_if(F.coalesce(off, F.lit(False))).alias("m"))
    return k.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n", "signals"), ("c", "confirmed"), ("e", "explained"), ("o", "open_cases"), ("w", "pending"), ("m", "mismatched"))],
                 F.count_if(F.col("n") > 1).alias("duplicate_keys"))


def example_pick(mart: DataFrame, n_confirmed: int = 5) -> DataFrame:
    """Control sample: largest confirmed, one explained, one open signal."""
    direct = mart.where(~F.col("metric").isin("recipients", "turnover"))
    def best(pri: int, cond: Column, amount: str, n: int) -> DataFrame:
        x = direct.where(cond).select(F.lit(pri).alias("priority"), *PAIR, "metric", "group_key", "status", F.abs(amount).alias("rank_amount"))
        return x.orderBy(F.desc_nulls_last("rank_amount"), *PAIR, "metric", "group_key").limit(n)
    return (best(1, F.col("has_deviation"), "confirmed", n_confirmed).unionByName(best(2, F.col("status") == "explained", "raw_rub", 1))
            .unionByName(best(3, F.col("status").isin("open", "awaiting_checks", "check_unavailable"), "raw_rub", 1)))


# ------------------------------------------------------------------- context

def stale_pairs(scored: DataFrame, short: DataFrame, stored: DataFrame, periods: dict[str, int], sync: float = 1.0) -> DataFrame:
    """Shortlisted pairs whose fresh figures differ from the stored summary, as signed sums.

    ``stored``: org, unit, mi, n, rub; ``periods`` maps actual / prior / year_actual / year_prior to mi.
    """
    pairs = short.select(*PAIR).distinct()
    live = scored.where(is_pair()).join(pairs, list(PAIR), "left_semi").select(*PAIR, F.explode(F.array(*[
        F.struct(F.lit(m).alias("mi"), F.col(f"n_{k}").cast("bigint").alias("n"), _d(k).alias("rub")) for k, m in periods.items()])).alias("x")).select(*PAIR, "x.*")
    old = stored.where(F.col("mi").isin(list(periods.values()))).join(pairs, list(PAIR), "left_semi").select(*PAIR, "mi", (-F.col("n")).cast("bigint").alias("n"), (-_d("rub")).alias("rub"))
    return live.unionByName(old).groupBy("mi", *PAIR).agg(F.sum("n").alias("n"), F.sum("rub").alias("rub")).where((F.col("n") != 0) | (F.abs("rub") > sync)).select(*PAIR).distinct()


def stopped_org_elsewhere(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs with no pay now: what the same organisation pays in all its units."""
    places = groups.where(is_pair() & ((F.col("n_prior") > 0) | (F.col("n_actual") > 0)))
    stopped = places.where("n_prior > 0 and n_actual = 0").join(pairs.select(*PAIR).distinct(), list(PAIR), "left_semi").select("org", F.col("unit").alias("stopped_unit"))
    return stopped.join(places.select("org", "unit", "n_prior", "n_actual", "prior", "actual"), "org")


def portfolio_bands(states: DataFrame, periods: Sequence[int]) -> DataFrame:
    """People and money by pay band of the person's whole portfolio pay."""
    p = states.where((F.col("st") == "P") & F.col("mi").isin(list(periods))).groupBy("mi", "person").agg(F.sum("pf_amt").alias("amount"))
    return p.groupBy("mi", pay_band(F.col("amount")).alias("band")).agg(_n().alias("people"), F.sum("amount").alias("amount"))


def portfolio_units(groups: DataFrame) -> DataFrame:
    return groups.where(is_pair() & ((_d("actual") > 0) | (_d("prior") > 0))).groupBy("unit").agg(F.sum("actual").alias("actual"), F.sum("prior").alias("prior"))


def entered_left(events: DataFrame) -> DataFrame:
    """Persons and money by movement of this year's comparison."""
    return events.where("period = 0").groupBy("movement").agg(_n().alias("n"), F.sum("curr_rub").alias("curr_rub"), F.sum("prev_rub").alias("prev_rub"))


def bank_leavers(states: DataFrame, curr: int, prev: int) -> DataFrame:
    f = states.where((F.col("st") == "P") & F.col("mi").isin(curr, prev)).groupBy("person").agg(F.bool_or(F.col("mi") == prev).alias("p"), F.bool_or(F.col("mi") == curr).alias("c"))
    return f.where("p and not c").select("person")


def early_pay_match(day_pay: DataFrame, states: DataFrame, leavers: DataFrame, early_day, ref_days: Sequence, periods: Sequence[int]) -> DataFrame:
    """Leavers whose exact amount of the 1st was paid on the working day before, confirmed by two earlier months.

    ``day_pay``: person, org, unit, day, pf_amt. ``ref_days`` are the 1sts of the two earlier months and
    ``periods`` their period numbers; the earlier period must hold both payments.
    """
    keys = ["person", *PAIR, "pf_amt"]
    days = [early_day, *ref_days]
    d = day_pay.where(F.col("day").isin(list(days)) & (F.col("pf_amt") > 0)).join(leavers, "person", "left_semi")
    hit = d.groupBy(*keys).agg(F.count_distinct("day").alias("k")).where(F.col("k") == len(days))
    paid = states.where((F.col("st") == "P") & F.col("mi").isin(list(periods))).groupBy("person", *PAIR).agg(
        *[F.sum(F.when(F.col("mi") == m, F.col("pf_amt"))).alias(f"m{i}") for i, m in enumerate(periods)])
    return hit.join(paid, ["person", *PAIR]).where((F.col("m0") >= 2 * F.col("pf_amt")) & (F.col("m1") >= F.col("pf_amt"))).select("person").distinct()
