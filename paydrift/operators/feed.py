"""Deviation feed over many slices of the summary: series, components, scan, stories, cards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .calendar import _exact

# Measures of a slice series, windows, bases, limits.
MEASURES = ("pf_recip", "pf_fl", "m_base_pf", "m_in_from_outside", "m_in_temp_outside", "m_in_from_other_org", "m_in_from_nonzp", "m_in_from_zp_out",
            "m_out_left_bank", "m_out_temp_left", "m_out_to_other_org", "m_out_to_nonzp", "m_out_zp_out", "m_lb_seasonal", "m_lb_org_stopped",
            "m_lb_one_time", "m_lb_unknown", "m_fl_in", "m_fl_out", "m_in_person_new", "m_out_person_gone", "m_in_conc", "m_out_conc",
            "ten_lt3", "ten_3_12", "ten_12p", "m_out_ten_lt3", "m_out_ten_3_12", "m_out_ten_12p", "single_pay_recip", "multi_recip",
            "y_base_pf", "y_fl_in", "y_fl_out", "y_in_person_new", "y_out_person_gone", "y_in_conc", "y_out_conc")
WINDOWS = (1, 3, 6, 12)
BASES = ("none", "y1", "y2", "avg")
Z_MIN, MIN_HISTORY, MAT_ABS, MAT_REL, SAME_STORY = 4.0, 6, 500, 0.002, 0.10
MAD_SCALE = 1.4826
# Component → group.
GROUPS = {"left": "real", "came": "real", "moves": "inside", "temp_out": "account", "temp_back": "account", "reclass": "account",
          "codes": "disputed", "threshold": "disputed", "left_unk": "unknown", "gap": "unknown"}
PERSON_PARTS = ("p_out", "p_out_extra", "p_in", "p_in_extra", "p_conc", "p_move")
# Slice types from general to special; a pair of names is a cross. The last element says the view of the segment.
SLICES = (("bank", ("k_bank",)), ("segment", ("seg_cur",)), ("segment at pay date", ("seg_rep",)), ("region", ("region",)), ("unit", ("unit",)),
          ("industry", ("industry",)), ("size", ("size",)), ("holding", ("hold_code",)), ("organisation", ("org_code",)),
          ("segment × region", ("seg_cur", "region")), ("segment × industry", ("seg_cur", "industry")),
          ("segment at pay date × region", ("seg_rep", "region")), ("segment at pay date × industry", ("seg_rep", "industry")))
PAY_VIEW = {"segment at pay date": "segment", "segment at pay date × region": "segment × region", "segment at pay date × industry": "segment × industry"}
SERIES = ("slice_type", "slice_key")


def summary_segment(summary: DataFrame) -> DataFrame:
    """Organisation's segment in a period: that of its units with history first, then most recipients."""
    g = summary.groupBy("mi", "org", "seg_rep").agg(F.min(F.when(F.col("seg_src").isin("history", "org history"), 0).otherwise(1)).alias("rank"), F.sum("pf_recip").alias("pf"))
    return g.groupBy("mi", "org").agg(F.min_by("seg_rep", F.struct("rank", (-F.col("pf")).alias("pf"), "seg_rep")).alias("seg_rep"))


def segment_conflicts(summary: DataFrame) -> DataFrame:
    """Organisations whose units have different segments in a period, by source of the segment."""
    h = F.when(F.col("seg_src").isin("history", "org history"), F.col("seg_rep"))
    a = summary.groupBy("mi", "org").agg(F.sum("pf_recip").alias("pf"), F.min(h).alias("lo"), F.max(h).alias("hi"), (F.min("seg_rep") != F.max("seg_rep")).alias("differ"))
    hist = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
    mix = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)) & F.col("differ")
    return a.groupBy("mi").agg(F.count_if(hist).alias("n_org"), F.sum(F.when(hist, F.col("pf")).otherwise(0)).alias("pf"),
                               F.count_if(mix).alias("n_mix"), F.sum(F.when(mix, F.col("pf")).otherwise(0)).alias("pf_mix"))


def slice_coverage(summary: DataFrame, orgs: DataFrame) -> DataFrame:
    """How many organisations and recipients have an industry and a holding, per period."""
    j = summary.groupBy("mi", "org").agg(F.sum("pf_recip").alias("pf")).join(orgs.select("org", "industry", "hold"), "org", "left")
    def part(c: str) -> list[Column]:
        ok = F.col(c).isNotNull()
        return [F.count_if(ok).alias(f"orgs_{c}"), F.sum(F.when(ok, F.col("pf")).otherwise(0)).alias(f"pf_{c}")]
    return j.groupBy("mi").agg(F.count(F.lit(1)).alias("n_orgs"), F.sum("pf").alias("pf"), *part("industry"), *part("hold"))


def size_class(pf_max: Column, edges: Sequence[int] = (10000, 1000, 100)) -> Column:
    a, b, c = edges
    return F.when(pf_max >= a, f"1) {a}+").when(pf_max >= b, f"2) {b}+").when(pf_max >= c, f"3) {c}+").otherwise(f"4) under {c}")


def collapse_summary(summary: DataFrame, orgs: DataFrame, hold_min: int, org_min: int, edges: Sequence[int] = (10000, 1000, 100)) -> DataFrame:
    """Summary folded to the attributes slices need; big organisations and holdings get masked codes (whole digests).

    Each measure comes with the number of active rows where it is unknown. A measure an old summary
    lacks is unknown everywhere.
    """
    code = lambda c, p: F.concat(F.lit(p), F.md5(c.cast("string")))
    om = summary.groupBy("mi", "org").agg(F.sum("pf_recip").alias("pf")).groupBy("org").agg(F.max("pf").alias("pf_max"))
    big = (om.join(orgs.select("org", "hold"), "org").where("hold is not null").groupBy("hold").agg(F.count(F.lit(1)).alias("n"), F.sum("pf_max").alias("s"))
           .where((F.col("n") >= 2) & (F.col("s") >= hold_min)).select("hold", F.lit(True).alias("big")))
    seg = summary_segment(summary).withColumnRenamed("seg_rep", "seg_org")
    j = (summary.join(om, "org", "left").join(orgs.select("org", F.col("seg").alias("seg_dim"), "hold", "industry"), "org", "left")
         .join(big, "hold", "left").join(seg, ["mi", "org"], "left"))
    active = (F.coalesce("pf_recip", F.lit(0)) > 0) | (F.coalesce("m_base_pf", F.lit(0)) > 0)
    aggs = []
    for m in MEASURES:
        v = F.col(m) if m in summary.columns else F.lit(None).cast("double")
        aggs += [F.sum(v).alias(m), F.count_if(v.isNull() & active).alias(f"nn_{m}")]
    return j.groupBy(
        "mi", F.coalesce("seg_org", F.lit("(none)")).alias("seg_rep"), F.coalesce("seg_dim", F.lit("(not in dimension)")).alias("seg_cur"), "region", "unit",
        F.coalesce("industry", F.lit("(not given)")).alias("industry"), F.when(F.col("big"), code(F.col("hold"), "holding ")).alias("hold_code"),
        size_class(F.col("pf_max"), edges).alias("size"), F.when(F.col("pf_max") >= org_min, code(F.col("org"), "org ")).alias("org_code")).agg(*aggs)


def slice_series(collapsed: DataFrame) -> DataFrame:
    """Thirteen slice types in one grouping-sets pass over the collapsed summary; NULL keys are left out."""
    df = collapsed.withColumn("k_bank", F.lit("bank")).withColumns({"region": F.col("region").cast("string"), "unit": F.col("unit").cast("string")})
    cols = list(dict.fromkeys(c for _, parts in SLICES for c in parts))
    sums = [m for m in MEASURES] + [f"nn_{m}" for m in MEASURES]
    g = df.groupingSets([[F.col("mi"), *[F.col(c) for c in parts]] for _, parts in SLICES], F.col("mi"), *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("gid"), *[F.sum(s).alias(s) for s in sums])
    bits = {c: 1 << (len(cols) - 1 - i) for i, c in enumerate(cols)}
    full = sum(bits.values())
    typ = key = None
    ok = F.lit(False)
    for name, parts in SLICES:
        here = F.col("gid") == full - sum(bits[p] for p in parts)
        k = F.concat_ws(" / ", *[F.col(p) for p in parts])
        typ, key = (F.when(here, name), F.when(here, k)) if typ is None else (typ.when(here, name), key.when(here, k))
        ok = ok | (here & reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts]))
    return g.where(ok).select(typ.alias("slice_type"), key.alias("slice_key"), "mi", *sums)


def known(series: DataFrame) -> DataFrame:
    """Measures with an unknown active row become NULL."""
    return series.select(*SERIES, "mi", *[F.when(F.col(f"nn_{m}") == 0, F.col(m).cast("double")).alias(m) for m in MEASURES])


def person_parts(fl_in: Column, fl_out: Column, in_new: Column, out_gone: Column, reported: Column, in_conc: Column, out_conc: Column) -> dict[str, Column]:
    """Change of triples = persons gone and come + their other jobs + those who stayed (jobs, moves)."""
    stay, conc = reported - (in_new - out_gone), in_conc - out_conc
    return {"p_out": -fl_out, "p_out_extra": -(out_gone - fl_out), "p_in": fl_in, "p_in_extra": in_new - fl_in, "p_conc": conc, "p_move": stay - conc}


def components(series: DataFrame) -> DataFrame:
    """Monthly components of a slice's change; their sum is the change, unknown stays unknown."""
    x = _exact(known(series), list(SERIES), ["pf_recip", "pf_fl"], (1,))
    c = F.col
    prev, temp = c("pf_recip_1"), c("m_out_temp_left").isNotNull()
    base_known = c("m_base_pf").isNotNull() & prev.isNotNull()
    parts = {"left": -(c("m_out_left_bank") - c("m_out_temp_left")), "came": c("m_in_from_outside") - c("m_in_temp_outside"),
             "moves": c("m_in_from_other_org") - c("m_out_to_other_org"), "temp_out": F.when(temp, -c("m_out_temp_left")).otherwise(0.0),
             "temp_back": c("m_in_temp_outside"), "reclass": c("m_base_pf") - prev, "codes": c("m_in_from_nonzp") - c("m_out_to_nonzp"),
             "threshold": c("m_in_from_zp_out") - c("m_out_zp_out"), "left_unk": F.when(temp, 0.0).otherwise(-c("m_out_left_bank"))}
    reported = c("pf_recip") - prev
    counted = {**parts, "left": F.when(temp, parts["left"]).otherwise(0.0)}
    parts["gap"] = reported - reduce(lambda a, b: a + b, counted.values())
    parts["left"] = F.when(temp, parts["left"])
    parts["reported"], parts["people"] = reported, c("pf_fl") - c("pf_fl_1")
    parts.update(person_parts(c("m_fl_in"), c("m_fl_out"), c("m_in_person_new"), c("m_out_person_gone"), reported, c("m_in_conc"), c("m_out_conc")))
    return x.select(*SERIES, "mi", "pf_recip", *[F.when(base_known, v).alias(n) for n, v in parts.items()])


def compare(comp: DataFrame, length: int, year: int = 12, cols: Sequence[str] = (*GROUPS, "reported")) -> DataFrame:
    """Window of ``length`` periods minus each base, one row per base."""
    w = W.partitionBy(*SERIES).orderBy("mi").rangeBetween(-(length - 1), 0)
    x = comp.withColumns({f"w_{k}": F.when(F.count(k).over(w) == length, F.sum(k).over(w)) for k in cols})
    x = _exact(x, list(SERIES), [f"w_{k}" for k in cols], (year, 2 * year))
    x = x.withColumn("level_before", F.max("pf_recip").over(W.partitionBy(*SERIES).orderBy("mi").rangeBetween(-length, -length)))

    def base(k: str, b: str) -> Column:
        y1, y2 = F.col(f"w_{k}_{year}"), F.col(f"w_{k}_{2 * year}")
        return {"none": F.when(F.col(f"w_{k}").isNotNull(), 0.0), "y1": y1, "y2": y2, "avg": (y1 + y2) / 2}[b]

    rows = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(i).alias("base_pos"), *[base(k, b).alias(f"b_{k}") for k in cols],
                              *[(F.col(f"w_{k}") - base(k, b)).alias(f"d_{k}") for k in cols]) for i, b in enumerate(BASES)])
    return x.select(*SERIES, "mi", F.lit(length).alias("length"), "level_before", F.col(f"w_reported_{year}").isNotNull().alias("has_y1"),
                    *[f"w_{k}" for k in cols], F.explode(rows).alias("r")).select("*", "r.*").drop("r")


def deviation_scan(comp: DataFrame, periods: Sequence[int], z_min: float = Z_MIN, min_history: int = MIN_HISTORY, mat_abs: float = MAT_ABS,
                   mat_rel: float = MAT_REL, year: int = 12, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Every significant deviation: slice × period × window × base.

    Reported or real deviation of at least ``z_min`` robust noises and of the material size. Without a
    base only the twelve-period window counts, unless the slice has no year ago. Incomplete ones are out.
    """
    x = reduce(lambda a, b: a.unionByName(b), [compare(comp, n, year) for n in windows])
    names = sorted(set(GROUPS.values()))
    x = x.withColumns({f"g_{g}": reduce(lambda a, b: a + b, [F.col(f"d_{k}") for k, gg in GROUPS.items() if gg == g]) for g in names})
    part = W.partitionBy(*SERIES, "length", "base")
    floor = F.greatest(F.lit(float(mat_abs)), mat_rel * F.coalesce("level_before", F.lit(0.0)))
    for v, n in (("d_reported", "noise"), ("g_real", "noise_real")):
        x = x.withColumn("_m", F.median(v).over(part)).withColumn("_a", F.abs(F.col(v) - F.col("_m")))
        x = x.withColumn(n, F.when(F.count(v).over(part) >= min_history, F.median("_a").over(part) * MAD_SCALE)).drop("_m", "_a")
    x = x.withColumns({"floor": floor, "z": F.when(F.col("noise").isNotNull(), F.col("d_reported") / F.greatest("noise", floor)),
                       "z_real": F.when(F.col("noise_real").isNotNull(), F.col("g_real") / F.greatest("noise_real", floor))})
    complete = F.col("d_reported").isNotNull() & reduce(lambda a, b: a & b, [F.col(f"g_{g}").isNotNull() for g in names if g != "real"])
    complete = complete & ((F.col("base") != "none") | (F.col("length") == year) | ~F.col("has_y1"))
    big = lambda z, v: F.coalesce((F.abs(z) >= z_min) & (F.abs(v) >= F.col("floor")), F.lit(False))
    sig, sig_r = big("z", "d_reported"), big("z_real", "g_real")
    return x.where(F.col("mi").isin(list(periods)) & complete & (sig | sig_r)).select(
        *SERIES, "mi", "length", "base", "base_pos", "z", "z_real", sig_r.alias("real_sig"), F.col("d_reported").alias("excess"), F.col("w_reported").alias("this"),
        F.col("b_reported").alias("base_value"), *[f"g_{g}" for g in names])


def duplicate_slices(series: DataFrame) -> DataFrame:
    """Slices whose series equals that of a more general slice; the first in slice order stays."""
    order: Column | None = None
    for i, (name, _) in enumerate(SLICES):
        c = F.col("slice_type") == name
        order = F.when(c, i) if order is None else order.when(c, i)
    h = series.where(F.round(F.coalesce("pf_recip", F.lit(0)), 3) != 0).groupBy(*SERIES).agg(
        F.md5(F.to_json(F.sort_array(F.collect_list(F.struct("mi", F.round(F.col("pf_recip").cast("double"), 3).alias("v")))))).alias("h")).withColumn("pos", order)
    first = h.groupBy("h").agg(F.min(F.struct("pos", "slice_key", "slice_type")).alias("f"))
    return h.join(first, "h").where((F.col("slice_type") != F.col("f.slice_type")) | (F.col("slice_key") != F.col("f.slice_key"))).select(*SERIES)


def stories(found: DataFrame, series: DataFrame, mat_abs: float = MAT_ABS, same: float = SAME_STORY) -> DataFrame:
    """One comparison per slice × period; echoes, duplicate slices and twin segment views removed.

    A slice has at most one row per period here, so the ordered pass over its overlapping windows folds
    a short array; no slice is brought to Python.
    """
    az = F.greatest(F.abs(F.coalesce("z", F.lit(0.0))), F.abs(F.coalesce("z_real", F.lit(0.0))))
    f = found.withColumn("az", az)
    cols = [c for c in f.columns if c not in (*SERIES, "mi")]
    best = f.groupBy(*SERIES, "mi").agg(
        F.min_by(F.struct(*cols), F.struct((-F.col("az")).alias("a"), "length", "base_pos")).alias("b"), F.count(F.lit(1)).alias("n_seen")).select(*SERIES, "mi", "b.*", "n_seen")
    best = best.join(duplicate_slices(series), list(SERIES), "left_anti")
    item = F.struct((-F.col("az")).alias("a"), F.col("mi").alias("hi"), (F.col("mi") - F.col("length") + 1).alias("lo"), F.signum("excess").alias("sg"))
    fold = best.groupBy(*SERIES).agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.filter(F.col("items"), lambda _: F.lit(False))

    def overlaps(k: Column, x: Column) -> Column:
        return (k["sg"] == x["sg"]) & (x["lo"] <= k["hi"]) & (k["lo"] <= x["hi"])

    kept = F.aggregate("items", empty, lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    keep = fold.select(*SERIES, F.explode(kept).alias("k")).select(*SERIES, F.col("k.hi").alias("mi"))
    best = best.join(keep, [*SERIES, "mi"], "left_semi")
    twin: Column | None = None
    for pay, cur in PAY_VIEW.items():
        twin = F.when(F.col("slice_type") == pay, cur) if twin is None else twin.when(F.col("slice_type") == pay, cur)
    now = found.where(F.col("slice_type").isin(list(PAY_VIEW.values()))).select(
        F.col("slice_type").alias("twin"), "slice_key", "mi", "length", "base", F.col("excess").alias("twin_excess"))
    j = best.withColumn("twin", twin).join(now, ["twin", "slice_key", "mi", "length", "base"], "left")
    differs = F.col("twin_excess").isNull() | (F.abs(F.col("excess") - F.col("twin_excess")) > F.greatest(F.lit(float(mat_abs)), same * F.abs("twin_excess")))
    return j.where(differs).drop("twin", "twin_excess", "base_pos")


def deviation_card(comp: DataFrame, slice_type: str, slice_key: str, mi: int, length: int, base: str, year: int = 12) -> DataFrame:
    """Components of one comparison: window, base, deviation, with groups; persons after them."""
    cols = (*GROUPS, "reported", *PERSON_PARTS)
    one = compare(comp.where((F.col("slice_type") == slice_type) & (F.col("slice_key") == slice_key)), length, year, cols).where((F.col("mi") == mi) & (F.col("base") == base))
    rows = ", ".join(f"'{k}', '{GROUPS.get(k, 'persons' if k in PERSON_PARTS else 'total')}', w_{k}, b_{k}, d_{k}" for k in cols)
    return one.selectExpr(f"stack({len(cols)}, {rows}) as (component, grp, in_window, in_base, deviation)")


def resegmentation(series: DataFrame, comp: DataFrame, mi: int, length: int = 12) -> DataFrame:
    """Recipients by current and by pay-date segment, and transfers between slices over a year."""
    pf = series.where((F.col("mi") == mi) & F.col("slice_type").isin("segment", "segment at pay date"))
    views = pf.groupBy("slice_key").agg(*[F.sum(F.when(F.col("slice_type") == t, F.col("pf_recip"))).alias(n) for t, n in (("segment", "current"), ("segment at pay date", "at_pay_date"))])
    moved = comp.where((F.col("slice_type") == "segment at pay date") & F.col("mi").between(mi - length + 1, mi)).groupBy("slice_key").agg(
        F.when(F.count("reclass") == length, F.sum("reclass")).alias("transfers"))
    return (views.where((F.coalesce("current", F.lit(0)) != 0) | (F.coalesce("at_pay_date", F.lit(0)) != 0)).join(moved, "slice_key", "left")
            .select("slice_key", "current", "at_pay_date", (F.col("current") - F.col("at_pay_date")).alias("difference"), "transfers"))
