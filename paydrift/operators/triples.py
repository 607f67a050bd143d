"""From payment lines to counted recipients: triples, states, persons, series.

A *triple* is (person, org, unit) in a period ``mi``. States: P in portfolio, Z salary codes below
the threshold, N paid by other codes only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("mi", "person", "org", "unit")


def _zero() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def _amount(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("amt")).otherwise(_zero()))


def triples(lines: DataFrame, keys: Sequence[str] = KEYS, adv_codes: Sequence = (), sal_codes: Sequence = (),
            bonus_codes: Sequence = ()) -> DataFrame:
    """One row per key with every sum and flag later stages need, in a single aggregation.

    Needs line flags is_pf, is_fot, is_fixed (a code that always counts). Partial aggregation
    runs before the shuffle, so a hot person or organisation shrinks to its distinct keys first.
    """
    pos = F.col("amt") > 0
    pf, fot, fixed = (F.coalesce(F.col(c), F.lit(False)) for c in ("is_pf", "is_fot", "is_fixed"))
    return lines.groupBy(*keys).agg(
        F.min("region").alias("region"), _amount(pf).alias("sum_pf"), _amount(fot).alias("sum_fot"),
        F.bool_or(pf & pos).alias("pos_pf"), F.bool_or(fixed & pos).alias("pos_fixed"), F.bool_or(pos).alias("pos_any"),
        _amount(pos & fixed).alias("a_fixed"), _amount(pos & pf & ~fixed).alias("a_pf"),
        _amount(pos & fot & ~fixed).alias("a_fot"), _amount(pos & pf & F.col("code").isin(list(bonus_codes))).alias("a_bonus"), F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(pos, F.coalesce("qty", F.lit(1))).otherwise(0)).alias("n_pay"),
        F.bool_or(F.col("code").isin(list(adv_codes))).alias("has_adv"),
        F.bool_or(F.col("code").isin(list(sal_codes))).alias("has_sal"))


def in_portfolio(threshold, exempt: Column, amount: str = "sum_pf") -> Column:
    """Counted: a fixed code was paid, or salary codes were and the sum exceeds the threshold."""
    return F.col("pos_fixed") | (F.col("pos_pf") & (exempt | (F.col(amount) > F.lit(threshold))))


def triple_state(tri: DataFrame, threshold, exempt: DataFrame | None = None) -> DataFrame:
    """State and counted amounts; ``exempt`` lists organisations free of the threshold."""
    if exempt is not None:
        tri = tri.join(exempt.select("org").distinct().withColumn("exempt", F.lit(True)), "org", "left")
        free = F.coalesce(F.col("exempt"), F.lit(False))
    else:
        free = F.lit(False)
    inside = in_portfolio(threshold, free)
    over_pf, over_fot = free | (F.col("sum_pf") > threshold), free | (F.col("sum_fot") > threshold)
    return tri.where("pos_any").withColumns({
        "exempt": free,
        "st": F.when(inside, "P").when(F.col("pos_pf"), "Z").otherwise("N"),
        "pf_amt": F.when(inside, F.col("a_fixed") + F.when(over_pf, F.col("a_pf")).otherwise(_zero())).otherwise(_zero()),
        "fot_amt": F.col("a_fixed") + F.when(over_fot, F.col("a_fot")).otherwise(_zero()),
        "bonus": F.when(over_pf, F.col("a_bonus")).otherwise(_zero()),
    })


def recipients(states: DataFrame, orgs: DataFrame, unknown: str = "not in dimension") -> DataFrame:
    """Triples in portfolio with their organisation's segment, holding and focus flag."""
    dim = orgs.select("org", "seg", "hold", "focus")
    return (states.where(F.col("st") == "P").join(dim, "org", "left")
            .withColumns({"seg": F.coalesce("seg", F.lit(unknown)), "focus": F.coalesce("focus", F.lit(False))})
            .select(*KEYS, "region", "sum_pf", "pf_amt", "has_adv", "has_sal", "seg", "hold", "focus"))


def threshold_scope(lines: DataFrame, threshold, scope: str = "org") -> DataFrame:
    """Triples counted when the sum of the chosen scope passes: the whole (period, person, org) or the triple.

    The org-level sum comes from its own aggregation of the already grouped triples and is joined
    back, so no unbounded window partition is built for a hot organisation.
    """
    tri = lines.where("is_pf").groupBy(*KEYS).agg(F.sum("amt").alias("amt"))
    if scope == "triple":
        return tri.withColumn("scope_amt", F.col("amt")).where(F.col("scope_amt") > threshold)
    wide = tri.groupBy("mi", "person", "org").agg(F.sum("amt").alias("scope_amt"))
    return tri.join(wide.where(F.col("scope_amt") > threshold), ["mi", "person", "org"])


def scope_probe(lines: DataFrame, threshold) -> DataFrame:
    """Recipients per period under both scopes of the threshold."""
    tri = lines.where("is_pf").groupBy(*KEYS).agg(F.sum("amt").alias("amt"))
    per_org = tri.groupBy("mi", "person", "org").agg(
        F.sum("amt").alias("org_amt"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("amt") > threshold).alias("n_tri"))
    return per_org.groupBy("mi").agg(
        F.sum("n_tri").alias("by_triple"), F.sum(F.when(F.col("org_amt") > threshold, F.col("n")).otherwise(0)).alias("by_org"),
        F.count_if((F.col("org_amt") > threshold) & (F.col("n_tri") == 0)).alias("only_by_org"))


def month_totals(rec: DataFrame) -> DataFrame:
    """Triples, persons, organisations and money per period, through two-stage counts."""
    per_person = rec.groupBy("mi", "person").agg(F.count(F.lit(1)).alias("n"), F.sum("pf_amt").alias("amt"))
    base = per_person.groupBy("mi").agg(F.sum("n").alias("n_triples"), F.count(F.lit(1)).alias("n_persons"),
                                        F.sum("amt").alias("amt"))
    return base.join(distinct_count(rec, ["mi"], "org", "n_orgs"), "mi")


def distinct_count(df: DataFrame, by: Sequence[str], key: str, name: str = "n") -> DataFrame:
    """Distinct keys per group as two groupings: first to the key, then count."""
    return df.groupBy(*by, key).agg(F.lit(1).alias("_")).groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def series(states: DataFrame, orgs: DataFrame, thresholds: Sequence[int], total: str = "__ALL__") -> DataFrame:
    """Period × segment, and the whole where a person counts once, at several thresholds."""
    tri = states.join(orgs.select("org", "seg"), "org", "left")
    hit = {f"t{t}": in_portfolio(t, F.col("exempt")) for t in thresholds}
    person = tri.groupBy("mi", "seg", "person").agg(
        F.count_if(F.col("st") == "P").alias("n"), *[F.count_if(c).alias(n) for n, c in hit.items()])
    sums = [F.sum("n").alias("n_triples"), F.count_if(F.col("n") > 0).alias("n_persons"),
            *[F.sum(n).alias(n) for n in hit]]
    whole = person.groupBy("mi", "person").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in hit])
    return (person.groupBy("mi", "seg").agg(*sums)
            .unionByName(whole.groupBy("mi").agg(*sums).withColumn("seg", F.lit(total))))


def threshold_sensitivity(states: DataFrame, base: int, current: int, thresholds: Sequence[int]) -> DataFrame:
    """Recipients at each threshold in two periods and the change: one pass, then unpivot."""
    two = states.where(F.col("mi").isin(base, current))
    aggs = []
    for t in thresholds:
        ok = in_portfolio(t, F.col("exempt"))
        aggs += [F.count_if(ok & (F.col("mi") == base)).alias(f"b{t}"), F.count_if(ok & (F.col("mi") == current)).alias(f"c{t}")]
    pairs = ", ".join(f"{t}, b{t}, c{t}" for t in thresholds)
    return (two.agg(*aggs).selectExpr(f"stack({len(thresholds)}, {pairs}) as (threshold, n_base, n_current)")
            .withColumn("change", F.col("n_current") - F.col("n_base")))


def load_health(lines: DataFrame, org_ok: Column, thin: float = 0.5) -> DataFrame:
    """Rows and money per period against the median period; bad ids and missing persons."""
    per = lines.groupBy("mi").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amt").alias("amt"),
        F.count_if(~F.coalesce(org_ok, F.lit(False))).alias("n_bad_org"), F.count_if(F.col("person").isNull()).alias("n_no_person"))
    mid = per.agg(F.median("n_rows").alias("m"))
    ratio = F.try_divide(F.col("n_rows"), mid.scalar())
    return per.select("*", ratio.alias("to_median"), (ratio < thin).alias("is_thin"),
                      F.try_divide("n_bad_org", "n_rows").alias("bad_share"))


def person_month(rec: DataFrame) -> DataFrame:
    """Per period and person: organisations, triples and the main place, the one with most money.

    ``min_by`` over an ordered struct replaces a window: it combines before the shuffle.
    """
    order = F.struct((-F.col("sum_pf")).alias("a"), F.col("org"), F.col("unit"))
    per_org = rec.groupBy("mi", "person", "org").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("seg", "region", "org"), order).alias("main"), F.min(order).alias("o"))
    return (per_org.groupBy("mi", "person").agg(
        F.count(F.lit(1)).alias("n_org"), F.sum("n").alias("n_triples"), F.min_by("main", "o").alias("main"))
        .select("mi", "person", "n_org", "n_triples", F.col("main.seg").alias("main_seg"),
                F.col("main.region").alias("main_region"), F.col("main.org").alias("main_org")))


def presence(lines: DataFrame, known: DataFrame) -> DataFrame:
    """All money and salary-code money per period of persons who were ever recipients."""
    per = lines.groupBy("mi", "person").agg(
        F.sum("amt").alias("amt_all"), _amount(F.coalesce(F.col("is_pf"), F.lit(False))).alias("amt_codes"))
    return per.join(known.select("person").distinct(), "person", "left_semi")


def multi_structure(rec: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Persons by number of organisations, extra organisations and extra units of one organisation."""
    keys = ["mi", *by]
    per_org = rec.groupBy(*keys, "person", "org").agg(F.count(F.lit(1)).alias("n"))
    per = per_org.groupBy(*keys, "person").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_persons"), F.sum("n").alias("n_triples"), F.sum("k").alias("n_pairs"),
        F.sum(F.col("k") - 1).alias("extra_orgs"), F.sum(F.col("n") - F.col("k")).alias("extra_units"),
        F.count_if(F.col("k") == 1).alias("one_org"), F.count_if(F.col("k") == 2).alias("two_orgs"),
        F.count_if(F.col("k") >= 3).alias("many_orgs"), F.count_if(F.col("n") > F.col("k")).alias("multi_unit"))


def code_months(lines: DataFrame, base: int, prev: int, current: int) -> DataFrame:
    """Persons and money per payment code in three periods with the short and long change."""
    per = (lines.where(F.col("mi").isin(base, prev, current) & F.col("is_pf"))
           .groupBy("mi", "code", "person").agg(F.sum("amt").alias("amt")))

    def at(mi: int, c: Column) -> Column:
        return F.sum(F.when(F.col("mi") == mi, c).otherwise(0))

    out = per.groupBy("code").agg(*[e.alias(n) for t, mi in (("base", base), ("prev", prev), ("cur", current))
                                    for n, e in ((f"n_{t}", at(mi, F.lit(1))), (f"amt_{t}", at(mi, F.col("amt"))))])
    return out.withColumns({"n_month": F.col("n_cur") - F.col("n_prev"), "n_year": F.col("n_cur") - F.col("n_base"),
                            "amt_month": F.col("amt_cur") - F.col("amt_prev"), "amt_year": F.col("amt_cur") - F.col("amt_base")})


def paytype_transition(states: DataFrame, base_periods: Sequence[int]) -> DataFrame:
    """What kinds of pay a recipient pair had and what is left of them one period later."""
    from ..functions.columns import payment_kind
    wanted = sorted(set(base_periods) | {p + 1 for p in base_periods})
    pair = states.where(F.col("mi").isin(wanted) & (F.col("pos_pf") | F.col("pos_fixed"))).groupBy("mi", "person", "org").agg(
        F.bool_or("has_adv").alias("a"), F.bool_or("has_sal").alias("s"), F.bool_or(F.col("st") == "P").alias("rec"))
    pair = pair.select("mi", "person", "org", payment_kind("a", "s").alias("kind"), "rec")
    nxt = pair.select((F.col("mi") - 1).alias("mi"), "person", "org", F.col("kind").alias("kind_next"), F.col("rec").alias("rec_next"))
    return (pair.where(F.col("rec") & F.col("mi").isin(list(base_periods))).join(nxt, ["mi", "person", "org"], "left")
            .groupBy("mi", F.col("kind"), F.coalesce("kind_next", F.lit("none")).alias("kind_next"),
                     F.coalesce(F.col("rec_next").cast("int"), F.lit(0)).alias("rec_next"))
            .agg(F.count(F.lit(1)).alias("n_pairs")))


def pay_schedule_counts(lines: DataFrame, adv_code, sal_code) -> DataFrame:
    """Persons with one advance, one salary or two payments; groups with an unknown quantity are dropped."""
    per = lines.where(F.col("code").isin(adv_code, sal_code)).groupBy("mi", "org", "person").agg(
        F.sum(F.when(F.col("code") == adv_code, F.col("qty")).otherwise(0)).alias("adv"),
        F.sum(F.when(F.col("code") == sal_code, F.col("qty")).otherwise(0)).alias("sal"),
        F.count_if(F.col("qty").isNull()).alias("unknown")).where("unknown = 0")
    return per.groupBy("mi", "org").agg(
        F.count_if((F.col("adv") == 1) & (F.col("sal") == 0)).alias("one_advance"),
        F.count_if((F.col("adv") == 0) & (F.col("sal") == 1)).alias("one_salary"),
        F.count_if(F.col("adv") + F.col("sal") == 2).alias("two_payments"), F.count(F.lit(1)).alias("n_persons"))


def threshold_cutoff_detail(lines: DataFrame, threshold) -> DataFrame:
    """Counted and cut persons and money by (period, org, code); exactly at the threshold apart from below."""
    per_code = lines.where("is_pf").groupBy("mi", "org", "person", "code").agg(F.sum("amt").alias("amt"))
    total = per_code.groupBy("mi", "org", "person").agg(F.sum("amt").alias("total"))
    t = F.col("total")
    return per_code.join(total, ["mi", "org", "person"]).groupBy("mi", "org", "code").agg(
        F.count_if(t > threshold).alias("n_counted"), F.count_if(t < threshold).alias("n_below"),
        F.count_if(t == threshold).alias("n_at"),
        F.sum(F.when(t > threshold, F.col("amt")).otherwise(_zero())).alias("amt_counted"),
        F.sum(F.when(t <= threshold, F.col("amt")).otherwise(_zero())).alias("amt_cut"))
