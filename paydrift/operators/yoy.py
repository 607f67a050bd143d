"""Year-over-year decompositions, cohorts, organisation movement, cuts by dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as fc
from . import moves as mv
from .pairs import paired
from .ranking import exact_median

GONE = ("left_bank", "below_threshold", "other_codes")
COME = ("new_to_bank", "above_threshold", "back_to_codes")


def _n() -> Column:
    return F.count(F.lit(1))


def _sum_if(cond: Column, value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(cond, v)), F.lit(0))


def decompose(flow: DataFrame) -> DataFrame:
    """was − stopped + started ± inside = became, for triples, persons and organisations.

    ``flow`` is a person flow; one aggregation, unpivoted to (component, triples, persons, orgs).
    Residual components must be 0.
    """
    out = mv.OUTSIDE
    came, left = F.col("seg_from") == out, F.col("seg_to") == out
    stay = ~came & ~left
    comp: dict[str, tuple[Column, Column, Column]] = {
        "base": (_sum_if(~came, "tr_b"), _sum_if(~came, "n_persons"), _sum_if(~came, "org_b")),
        "lost": (_sum_if(left, "tr_b"), _sum_if(left, "n_persons"), _sum_if(left, "org_b")),
        "gained": (_sum_if(came, "tr_c"), _sum_if(came, "n_persons"), _sum_if(came, "org_c")),
        "inside": (_sum_if(stay, F.col("tr_c") - F.col("tr_b")), F.lit(0), _sum_if(stay, F.col("org_c") - F.col("org_b"))),
        "current": (_sum_if(~left, "tr_c"), _sum_if(~left, "n_persons"), _sum_if(~left, "org_c"))}
    for c in GONE:
        k = left & (F.col("cause") == c)
        comp[f"lost_{c}"] = (_sum_if(k, "tr_b"), _sum_if(k, "n_persons"), _sum_if(k, "org_b"))
    for c in COME:
        k = came & (F.col("cause") == c)
        comp[f"gained_{c}"] = (_sum_if(k, "tr_c"), _sum_if(k, "n_persons"), _sum_if(k, "org_c"))
    for t in ("new1", "new2", "old", "unknown"):
        k = left & (F.coalesce("tenure", F.lit("unknown")) == t)
        comp[f"lost_tenure_{t}"] = (_sum_if(k, "tr_b"), _sum_if(k, "n_persons"), _sum_if(k, "org_b"))
    back, gap = left & (F.col("in_next") == 1), came & F.coalesce(F.col("was_before") == 1, F.lit(False))
    comp["lost_back"] = (_sum_if(back, "tr_b"), _sum_if(back, "n_persons"), _sum_if(back, "org_b"))
    comp["gained_gap"] = (_sum_if(gap, "tr_c"), _sum_if(gap, "n_persons"), _sum_if(gap, "org_c"))
    comp["gained_fresh"] = (_sum_if(came & ~gap, "tr_c"), _sum_if(came & ~gap, "n_persons"), _sum_if(came & ~gap, "org_c"))
    names = ("triples", "persons", "orgs")
    one = flow.agg(*[e.cast("bigint").alias(f"{c}__{n}") for c, es in comp.items() for n, e in zip(names, es)])
    for n in names:
        one = one.withColumn(f"residual__{n}", F.col(f"base__{n}") - F.col(f"lost__{n}") + F.col(f"gained__{n}") + F.col(f"inside__{n}") - F.col(f"current__{n}"))
    keys = [*comp, "residual"]
    return one.selectExpr(f"stack({len(keys)}, " + ", ".join(f"'{k}', " + ", ".join(f"`{k}__{n}`" for n in names) for k in keys) + ") as (component, triples, persons, orgs)")


def segment_decompose(flow: DataFrame, totals: DataFrame, b: int, c: int) -> DataFrame:
    """Per segment: −stopped + started ± other segments ± inside, against independently counted totals.

    ``flow`` is a triple flow; ``totals`` has (mi, seg, n_triples).
    """
    lost, n = F.col("side") == "lost", F.col("n_triples")
    sign = F.when(lost, -n).otherwise(n)
    g = flow.groupBy("seg").agg(
        _sum_if(F.col("cause").isin(*GONE), -n).alias("stopped"), _sum_if(F.col("cause").isin(*COME), n).alias("started"),
        _sum_if(F.col("cause") == "other_seg", sign).alias("other_seg"), _sum_if(F.col("cause") == "inside", sign).alias("inside"),
        *[_sum_if(F.col("cause") == x, n).alias(x) for x in (*GONE, *COME)])
    t = totals.where(F.col("mi").isin(b, c)).groupBy("seg").agg(_sum_if(F.col("mi") == b, "n_triples").alias("base"), _sum_if(F.col("mi") == c, "n_triples").alias("current"))
    j = t.join(g, "seg", "full_outer").na.fill(0)
    return j.withColumns({"delta": F.col("current") - F.col("base"),
                          "residual": F.col("base") + F.col("stopped") + F.col("started") + F.col("other_seg") + F.col("inside") - F.col("current")})


def flow_matrix(flow: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Persons by segment from × segment to, the outside included; columns are a fixed list."""
    cols = [*segments, mv.OUTSIDE]
    return flow.groupBy("seg_from").pivot("seg_to", cols).agg(F.sum("n_persons")).na.fill(0)


def segment_persons(flow: DataFrame) -> DataFrame:
    """Per segment: persons before and after, stopped, started, moved between segments."""
    n, out = F.col("n_persons"), mv.OUTSIDE
    rows = flow.where((F.col("seg_from") != out) | (F.col("seg_to") != out)).select(
        F.explode(F.array_distinct(F.array("seg_from", "seg_to"))).alias("seg"), "seg_from", "seg_to", "n_persons").where(F.col("seg") != out)
    here, there = F.col("seg") == F.col("seg_from"), F.col("seg") == F.col("seg_to")
    return rows.groupBy("seg").agg(
        _sum_if(here, n).alias("base"), _sum_if(there, n).alias("current"), _sum_if(here & (F.col("seg_to") == out), n).alias("stopped"),
        _sum_if(there & (F.col("seg_from") == out), n).alias("started"), _sum_if(here & ~there & (F.col("seg_to") != out), n).alias("to_other"),
        _sum_if(there & ~here & (F.col("seg_from") != out), n).alias("from_other"))


def diff_in_diff(now: DataFrame, year_ago: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each component's change minus the same change a year ago."""
    y = year_ago.select(*keys, *[F.col(v).alias(f"{v}_y") for v in values])
    j = now.select(*keys, *values).join(y, list(keys), "full_outer").na.fill(0)
    return j.withColumns({f"{v}_diff": F.col(v) - F.col(f"{v}_y") for v in values})


def drivers(did: DataFrame, value: str, key: str, k: int) -> DataFrame:
    return did.orderBy(F.desc(F.abs(value)), key).limit(k)


def temporary_vs_permanent(now: DataFrame, year_ago: DataFrame) -> DataFrame:
    """Lost triples who came back next period or not, this year against last, as contributions."""
    def fold(d: DataFrame, name: str) -> DataFrame:
        x = d.agg(F.max(F.when(F.col("component") == "lost", F.col("triples"))).alias("a"), F.max(F.when(F.col("component") == "lost_back", F.col("triples"))).alias("t"))
        return x.selectExpr(f"stack(3, 'temp', -t, 'perm', -(a - t), 'all', -a) as (kind, {name})")
    return fold(now, "cur").join(fold(year_ago, "prev"), "kind").withColumn("diff", F.col("cur") - F.col("prev"))


def ladder_table(causes: DataFrame, order: Sequence[tuple[str, str]], by: Sequence[str] = ("side",)) -> DataFrame:
    """Causes in their fixed order with kind, count and share of the whole; triples and persons side by side."""
    book = causes.sparkSession.createDataFrame([(i, c, k) for i, (c, k) in enumerate(order)], "pos int, cause string, kind string")
    total = causes.groupBy(*by).agg(F.sum("n_triples").alias("all_t"), F.sum("n_persons").alias("all_p"))
    return (causes.join(book, "cause").join(total, list(by)).select(
        *by, "pos", "cause", "kind", "n_triples", "n_persons", fc.share("n_triples", "all_t").alias("share_triples"), fc.share("n_persons", "all_p").alias("share_persons")))


# ------------------------------------------------------------------ cohorts

def cohort(pm: DataFrame, k: int, before: int) -> DataFrame:
    """Persons who are recipients in ``k`` and were not in ``before``."""
    f = pm.where(F.col("mi").isin(k, before)).groupBy("person").agg(
        F.bool_or(F.col("mi") == before).alias("was"), F.max(F.when(F.col("mi") == k, F.col("main_seg"))).alias("seg"),
        F.max(F.when(F.col("mi") == k, F.col("main_org"))).alias("org"))
    return f.where(~F.col("was") & F.col("seg").isNotNull()).drop("was")


def cohort_survival(pm: DataFrame, k: int, before: int, horizon: int = 3) -> DataFrame:
    """Newcomers of period k alive in each following period, by segment."""
    c = cohort(pm, k, before).select("person", "seg")
    alive = pm.where(F.col("mi").between(k, k + horizon)).join(c, "person").groupBy("seg", "mi").agg(_n().alias("n_alive"))
    size = alive.where(F.col("mi") == k).select("seg", F.col("n_alive").alias("size"))
    return alive.join(size, "seg").select("seg", (F.col("mi") - k).alias("age"), "size", "n_alive", fc.share("n_alive", "size").alias("survival"))


def cohort_excess(now: DataFrame, year_ago: DataFrame) -> DataFrame:
    """Extra loss of this year's cohort: its size times the drop of survival against last year's."""
    def fold(d: DataFrame, tag: str) -> DataFrame:
        return d.groupBy("age").agg(F.sum("n_alive").alias(f"alive_{tag}"), F.sum("size").alias(f"size_{tag}"))
    # the size of the whole cohort is its number of persons at age 0
    j = fold(now, "cur").join(fold(year_ago, "prev"), "age")
    s0 = now.where("age = 0").agg(F.sum("n_alive")).scalar()
    p0 = year_ago.where("age = 0").agg(F.sum("n_alive")).scalar()
    x = j.select("age", s0.alias("size"), fc.share(F.col("alive_cur"), s0).alias("surv_cur"), fc.share(F.col("alive_prev"), p0).alias("surv_prev"))
    return x.withColumn("excess_loss", F.col("size") * (F.col("surv_prev") - F.col("surv_cur")))


def cohort_by_dim(pm: DataFrame, pres: DataFrame, orgs: DataFrame, k: int, before: int, t: int) -> DataFrame:
    """The cohort's state in period t by segment, holding, industry and focus, in one grouping-sets pass."""
    c = cohort(pm, k, before).select("person", "org")
    alive = pm.where(F.col("mi") == t).select("person", F.lit(True).alias("alive"))
    paid = pres.where(F.col("mi") == t).select("person", "amt_all", "amt_codes")
    st = F.when(F.col("alive"), "alive").otherwise(mv.gone_cause(F.col("amt_all"), F.col("amt_codes")))
    a = c.join(alive, "person", "left").join(paid, "person", "left").groupBy("org", st.alias("st")).agg(_n().alias("n"))
    return dim_breakdown(a.join(orgs, "org", "left"), {"seg": "seg", "holding": "hold", "industry": "industry", "focus": "focus"}, ["st"], ["n"],
                         keep_null=("industry",), only_true=("focus",))


def dim_breakdown(df: DataFrame, dims: dict[str, str], extra: Sequence[str], sums: Sequence[str], keep_null: Sequence[str] = (),
                  only_true: Sequence[str] = ()) -> DataFrame:
    """The same sums by several dimensions as one long table (dim, key, …): one expand, one shuffle."""
    names = list(dims)
    g = df.groupingSets([[F.col(dims[n]), *[F.col(e) for e in extra]] for n in names], *[F.col(dims[n]) for n in names], *[F.col(e) for e in extra])
    out = g.agg(*[F.sum(s).alias(s) for s in sums], *[F.grouping(dims[n]).alias(f"_g_{n}") for n in names])
    dim, key, ok = None, None, F.lit(True)
    for n in names:
        here = F.col(f"_g_{n}") == 0
        dim = F.when(here, n) if dim is None else dim.when(here, n)
        k = F.col(dims[n]).cast("string")
        key = F.when(here, k) if key is None else key.when(here, k)
        if n in only_true:
            ok = ok & (~here | F.coalesce(F.col(dims[n]), F.lit(False)))
        elif n not in keep_null:
            ok = ok & (~here | F.col(dims[n]).isNotNull())
    return out.where(ok).select(dim.alias("dim"), key.alias("key"), *extra, *sums)


# ----------------------------------------------------------- organisations

def org_movement(rec: DataFrame, panel: DataFrame, b: int, c: int, min_movers: int, min_share: float, has_next: bool = True) -> DataFrame:
    """Per organisation: leavers and joiners by class, net, net without reorganisation, real cut."""
    pairs = mv.two_periods(rec, b, c, ("person", "org"))
    succ = mv.successor_orgs(rec, b, c, min_movers, min_share).select("org_from", "org_to")
    now = pairs.where("in_c").select("person", F.col("org").alias("org_to"))
    left = pairs.where("in_b and not in_c").select("person", "org")
    via = paired(left.withColumnRenamed("org", "org_from"), now, ["person"]).join(succ, ["org_from", "org_to"])
    reorg_out = via.select("person", F.col("org_from").alias("org")).distinct().withColumn("reorg", F.lit(True))
    reorg_in = via.select("person", F.col("org_to").alias("org")).distinct().withColumn("reorg", F.lit(True))
    who = panel.select("person", "in_b", "in_c", "in_cn1", "all_c", "codes_c")
    hit = F.coalesce("reorg", F.lit(False))
    out_cls = (F.when(hit, "reorg").when(F.col("in_c"), "moved").when(F.lit(has_next) & F.col("in_cn1"), "back")
               .otherwise(mv.gone_cause(F.col("all_c"), F.col("codes_c"))))
    lo = left.join(reorg_out, ["person", "org"], "left").join(who, "person").groupBy("org").agg(
        *[F.count_if(out_cls == x).alias(f"out_{x}") for x in (*GONE, "moved", "reorg", "back")])
    came = pairs.where("in_c and not in_b").select("person", "org")
    in_cls = F.when(hit, "reorg").when(F.col("in_b"), "moved").otherwise("new")
    ji = came.join(reorg_in, ["person", "org"], "left").join(who, "person").groupBy("org").agg(
        *[F.count_if(in_cls == x).alias(f"in_{x}") for x in ("new", "moved", "reorg")])
    size = pairs.groupBy("org").agg(F.count_if("in_b").alias("base_n"), F.count_if("in_c").alias("cur_n")).where("base_n > 0")
    o = size.join(lo, "org", "left").join(ji, "org", "left").na.fill(0)
    net = F.col("cur_n") - F.col("base_n")
    x = o.withColumns({"out_stopped": F.col("out_left_bank") + F.col("out_below_threshold") + F.col("out_other_codes"), "net": net,
                       "net_ex_reorg": net + F.col("out_reorg") - F.col("in_reorg") + F.col("out_back")})
    return x.withColumn("real_cut", F.when(F.col("net_ex_reorg") < 0, F.least(F.col("out_stopped"), -F.col("net_ex_reorg"))).otherwise(0))


def is_cut(min_base: int, min_real: int, min_share: float) -> Column:
    return ((F.col("base_n") >= min_base) & (F.col("net_ex_reorg") < 0) & (F.col("real_cut") >= min_real)
            & (F.col("real_cut") >= min_share * F.col("base_n")))


def org_cut_list(movement: DataFrame, rec: DataFrame, orgs: DataFrame, b: int, c: int, cut: Column, k: int) -> DataFrame:
    """Organisations with a real cut, their main region and top destination, beside totals over all of them."""
    picked = movement.where(cut)
    reg = (rec.where(F.col("mi") == b).groupBy("org", "region").agg(_n().alias("n")).groupBy("org")
           .agg(F.min_by("region", F.struct(-F.col("n"), F.col("region"))).alias("main_region")))
    pairs = mv.two_periods(rec, b, c, ("person", "org"))
    mvd = (paired(pairs.where("in_b and not in_c").select("person", F.col("org").alias("f")), pairs.where("in_c").select("person", F.col("org").alias("t")), ["person"])
           .groupBy("f", "t").agg(_n().alias("n")).groupBy(F.col("f").alias("org"))
           .agg(F.min_by(F.struct(F.col("t").alias("top_org"), F.col("n").alias("top_n")), F.struct(-F.col("n"), F.col("t"))).alias("d")))
    total = picked.agg(F.struct(_n().alias("n_picked"), F.sum("real_cut").alias("sum_real")).alias("t")).scalar()
    rows = picked.orderBy(F.desc("real_cut"), "org").limit(k)
    return (rows.join(orgs.select("org", "seg", "hold", "focus"), "org", "left").join(reg, "org", "left").join(mvd, "org", "left")
            .withColumn("t", total).select("org", "base_n", "cur_n", "out_stopped", "net_ex_reorg", "real_cut", "seg", "hold", "focus", "main_region",
                                           "d.top_org", "d.top_n", "t.n_picked", "t.sum_real"))


def org_cut_summary(movement: DataFrame, orgs: DataFrame, cut: Column, min_base: int) -> DataFrame:
    """Every organisation of the base in one class, so that the list does not hang in the air."""
    cls = (F.when(F.col("base_n") < min_base, "small").when(cut, "cut").when(F.col("out_reorg") > 0, "reorg").when(F.col("net_ex_reorg") > 0, "grew")
           .when(F.col("net_ex_reorg") == 0, "flat").when(F.col("out_stopped") == 0, "down_moved").otherwise("down_small"))
    sums = ("base_n", "cur_n", "out_stopped", "out_moved", "out_reorg", "out_back", "in_new", "in_moved", "real_cut")
    return movement.join(orgs.select("org", "seg"), "org", "left").groupBy(cls.alias("cls"), "seg").agg(_n().alias("n_orgs"), *[F.sum(s).alias(s) for s in sums])


def org_cut_break(movement: DataFrame, orgs: DataFrame, cut: Column, top: int) -> DataFrame:
    """Cut organisations by segment, holding and industry beside the whole base of the slice; top per dim."""
    x = movement.withColumn("picked", cut.cast("int")).join(orgs, "org", "left").withColumns(
        {"n_orgs_all": F.lit(1), "n_orgs": F.col("picked"), "cut_real": F.col("real_cut") * F.col("picked"), "cut_base": F.col("base_n") * F.col("picked")})
    g = dim_breakdown(x, {"seg": "seg", "holding": "hold", "industry": "industry"}, [], ["n_orgs_all", "base_n", "n_orgs", "cut_base", "cut_real", "out_stopped"], keep_null=("seg", "industry"))
    r = g.withColumn("rn", F.row_number().over(W.partitionBy("dim").orderBy(F.desc("cut_real"), F.desc("n_orgs_all"), F.asc("key"))))
    return r.where((F.col("rn") <= top) | (F.col("dim") == "seg"))


def org_hole(rec: DataFrame, m: int, min_base: int, fall: float = 0.5, back: float = 0.8) -> DataFrame:
    """Organisations that fell in m and returned in m+1: a moved pay date, not people leaving."""
    x = rec.where(F.col("mi").between(m - 1, m + 1)).groupBy("org").agg(
        *[F.count_if(F.col("mi") == k).alias(n) for n, k in (("n_prev", m - 1), ("n_cur", m), ("n_next", m + 1))])
    hit = (F.col("n_cur") <= fall * F.col("n_prev")) & (F.col("n_next") >= back * F.col("n_prev"))
    return x.where(F.col("n_prev") >= min_base).withColumns({"hit": hit.cast("int"), "hole": F.when(hit, F.col("n_prev") - F.col("n_cur")).otherwise(0)})


def org_hole_by_dim(holes: DataFrame, orgs: DataFrame) -> DataFrame:
    x = holes.join(orgs, "org", "left").withColumns({"n_orgs_base": F.lit(1), "n_orgs": F.col("hit")})
    return dim_breakdown(x, {"seg": "seg", "holding": "hold", "industry": "industry"}, [], ["n_orgs_base", "n_prev", "n_orgs", "hole"], keep_null=("seg", "industry"))


def return_pay_signature(pm: DataFrame, pres: DataFrame, m: int, width: float = 0.05) -> DataFrame:
    """Next / previous pay of persons absent in m against the steady ones: median and shares.

    The median is exact: counts per narrow ratio bucket find the middle ones, only their rows are ranked.
    """
    f = pm.where(F.col("mi").between(m - 1, m + 1)).groupBy("person").agg(*[F.bool_or(F.col("mi") == k).alias(n) for n, k in (("p", m - 1), ("c", m), ("x", m + 1))])
    pay = pres.where(F.col("mi").isin(m - 1, m + 1)).groupBy("person").agg(*[
        F.sum(F.when(F.col("mi") == k, F.col("amt_codes"))).cast("double").alias(n) for n, k in (("a0", m - 1), ("a1", m + 1))])
    r = (f.where("p and x").select("person", F.when(F.col("c"), "steady").otherwise("gap").alias("grp")).join(pay.where("a0 > 0 and a1 is not null"), "person")
         .select("grp", (F.col("a1") / F.col("a0")).alias("ratio")))
    stat = r.groupBy("grp").agg(_n().alias("n_persons"), F.avg((F.col("ratio") >= 1.6).cast("int")).alias("share_double"),
                                F.avg(F.col("ratio").between(0.7, 1.4).cast("int")).alias("share_single"))
    return stat.join(exact_median(r, ["grp"], "ratio", width), "grp").withColumnRenamed("median", "median_ratio")


# ------------------------------------------------------------------- cuts

def cut_by_dim(moves: DataFrame, rec: DataFrame, key: str, b: int, c: int, causes: Sequence[str] = ("left_bank", "below_threshold", "other_codes", "left_segment"),
               stay: str = "stayed_in_segment") -> DataFrame:
    """Losses by any dimension with causes, arrivals, moves inside, net change; shares of the whole; total row."""
    lost, cause = F.col("side") == "lost", F.col("cause")
    g = moves.groupBy(key).agg(
        *[F.count_if(lost & (cause == x)).alias(x) for x in causes], F.count_if(lost & (cause != stay)).alias("loss"),
        F.count_if(~lost & (cause != stay)).alias("arrived"), F.count_if(lost & (cause == stay)).alias("moved_out"), F.count_if(~lost & (cause == stay)).alias("moved_in"))
    t = rec.where(F.col("mi").isin(b, c)).groupBy(key).agg(F.count_if(F.col("mi") == b).alias("base"), F.count_if(F.col("mi") == c).alias("current"))
    rows = t.join(g, key, "full_outer").na.fill(0, [*causes, "loss", "arrived", "moved_out", "moved_in", "base", "current"])
    rows = rows.withColumn(key, F.col(key).cast("string")).withColumn("net", F.col("current") - F.col("base"))
    nums = [x for x in rows.columns if x != key]
    total = rows.agg(*[F.sum(x).alias(x) for x in nums]).withColumn(key, F.lit("TOTAL"))
    return rows.unionByName(total).select("*", fc.share(F.col("loss"), rows.agg(F.sum("loss")).scalar()).alias("loss_share"), fc.share("loss", "base").alias("loss_rate"))


def net_top_orgs(moves: DataFrame, k: int, stay: str = "stayed_in_segment") -> DataFrame:
    """Organisations by gained − lost, with the leading cause of loss."""
    lost, real = F.col("side") == "lost", F.col("cause") != stay
    per = moves.groupBy("org", "side", "cause").agg(_n().alias("n"))
    g = per.groupBy("org").agg(_sum_if(lost & real, "n").alias("lost"), _sum_if(~lost & real, "n").alias("gained"),
                               F.min_by(F.when(lost & real, F.col("cause")), F.when(lost & real, F.struct(-F.col("n"), F.col("cause")))).alias("lead_cause"))
    return g.withColumn("net", F.col("gained") - F.col("lost")).orderBy("net", "org").limit(k)


def multi_job_split(structure: DataFrame, b: int, c: int, by: Sequence[str] = ()) -> DataFrame:
    """Change of recipients = change of persons + of extra organisations + of extra units."""
    def d(x: str) -> Column:
        return _sum_if(F.col("mi") == c, x) - _sum_if(F.col("mi") == b, x)
    g = structure.where(F.col("mi").isin(b, c)).groupBy(*by).agg(
        d("n_triples").alias("d_triples"), d("n_persons").alias("d_persons"), d("extra_orgs").alias("d_orgs"), d("extra_units").alias("d_units"),
        fc.share(_sum_if(F.col("mi") == b, F.col("n_triples") - F.col("n_persons")), _sum_if(F.col("mi") == b, "n_persons")).alias("extra_share_b"),
        fc.share(_sum_if(F.col("mi") == c, F.col("n_triples") - F.col("n_persons")), _sum_if(F.col("mi") == c, "n_persons")).alias("extra_share_c"))
    return g.withColumn("residual", F.col("d_triples") - F.col("d_persons") - F.col("d_orgs") - F.col("d_units"))


def two_date_compare(rec: DataFrame, keys: Sequence[str], b: int, c: int) -> DataFrame:
    """Counts in both periods side by side by any keys."""
    return rec.where(F.col("mi").isin(b, c)).groupBy(*keys).agg(F.count_if(F.col("mi") == b).alias("n_b"), F.count_if(F.col("mi") == c).alias("n_c"))


def dim_yoy(pairs: DataFrame, key: str, segments: Sequence[str]) -> DataFrame:
    """Change by a dimension × segment: was, now, %, share of the whole change. ``pairs`` has n_b, n_c, seg."""
    d = F.col("n_c") - F.col("n_b")
    g = pairs.groupBy(key).agg(F.sum("n_b").alias("was"), F.sum("n_c").alias("now"), F.sum(d).alias("total"), *[_sum_if(F.col("seg") == s, d).alias(s) for s in segments])
    whole = pairs.agg(F.sum(d)).scalar()
    return g.select("*", fc.share("total", "was").alias("pct"), fc.share(F.col("total"), whole).alias("share_of_change"))


def source_agreement(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (), unknown: Sequence[str] = ("unknown",)) -> DataFrame:
    """How far two sources of the same attribute agree, weighted by current recipients."""
    def known(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.col(c).isin(list(unknown))
    n = F.col("n_c")
    both = known(a) & known(b)
    return pairs.groupBy(*by).agg(F.sum(n).alias("n"), fc.share(_sum_if(known(a), n), F.sum(n)).alias("a_known"), fc.share(_sum_if(known(b), n), F.sum(n)).alias("b_known"),
                                  _sum_if(both, n).alias("both"), fc.share(_sum_if(both & (F.col(a) == F.col(b)), n), _sum_if(both, n)).alias("agree"))


def area_match(pairs: DataFrame, geo: DataFrame) -> DataFrame:
    """Counts by how the place was found: by the pair, only by the organisation, not at all."""
    g = geo.select("org", "unit").distinct().withColumn("hit", F.lit(True))
    o = geo.select("org").distinct().withColumn("org_hit", F.lit(True))
    m = F.when(F.col("hit"), "pair").when(F.col("org_hit"), "org_only").otherwise("none")
    return pairs.join(g, ["org", "unit"], "left").join(o, "org", "left").groupBy(m.alias("match")).agg(F.sum("n_b").alias("n_b"), F.sum("n_c").alias("n_c"))
