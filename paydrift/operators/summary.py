"""Monthly summary: stocks and labelled flows per (period, org, unit), from bitmap histories.

Where a relational engine joins the history table back for every lag, here each triple's history is
one row with three masks; arrivals and departures of any lag are the set bits of a shifted mask, so
the payment fact is grouped once and the movement rows are produced without a self-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import masks as mk
from ..functions import wide_masks as wm
from .pairs import paired

TRIPLE = ("person", "org", "unit")
CELL = ("mi", "org", "unit")
# Movement labels and tenure bands.
IN_LABELS = ("in_new_bank", "in_returned", "in_from_nonzp", "in_from_zp_out", "in_oth_same_org", "in_oth_same_hold", "in_oth_other")
OUT_LABELS = ("out_to_nonzp", "out_zp_out", "out_oth_same_org", "out_oth_same_hold", "out_oth_other",
              "lb_seasonal", "lb_org_stopped", "lb_one_time", "lb_unknown")
TENURES = ("lt3", "3_12", "12p")
STOCKS = ("pf_recip", "pf_fl", "pf_amt", "fot_amt", "zp_out_recip", "nonzp_recip", "any_recip", "raw_rows", "single_pay_recip",
          "multi_recip", "multi_same_org", "multi_same_hold", "multi_other", "flapping_recip", "one_time_pf", "one_time_person",
          "ten_lt3", "ten_3_12", "ten_12p")
MEM = mk.MEMORY


def _n() -> Column:
    return F.count(F.lit(1))


def _zero(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit(0))


def triple_masks(states: DataFrame, last: int | None = None) -> DataFrame:
    """One row per triple: bits of periods paid at all, in portfolio, by non-salary codes only.

    Up to 60 periods are one bigint each; ``last``, the highest period, asks for as many words as it needs.
    """
    st, mi = F.col("st"), F.col("mi")
    k = mk if last is None or last < mk.MAX_PERIODS else wm.words_for(last)
    return states.groupBy(*TRIPLE).agg(
        k.build_mask(F.lit(True), mi).alias("b_any"), k.build_mask(st == "P", mi).alias("b_p"), k.build_mask(st == "N", mi).alias("b_n"))


def fold_masks(masks: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    k = wm.of(masks)
    return masks.groupBy(*keys).agg(k.fold("b_any").alias(f"{prefix}_any"), k.fold("b_p").alias(f"{prefix}_p"))


def person_masks(masks: DataFrame) -> DataFrame:
    return fold_masks(masks, ["person"], "pr")


def portfolio_counts(states: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return states.where(F.col("st") == "P").groupBy(*keys).agg(_n().alias(name))


def _annotated(masks: DataFrame, orgs: DataFrame) -> DataFrame:
    """Triple masks beside the masks of their person, person × org, person × holding and org."""
    if "org_p" in masks.columns:   # already annotated, as a staged table
        return masks
    k = wm.of(masks)
    by_org = masks.groupBy("org").agg(k.fold("b_p").alias("org_p"))
    # the first window puts a person's rows into one partition, where the others find them
    person, place, held = (W.partitionBy(*c) for c in (("person",), ("person", "org"), ("person", "hold")))
    x = masks.join(orgs.select("org", "hold"), "org", "left").where(F.col("person").isNotNull())
    x = x.withColumns({"pr_any": k.fold_over("b_any", person), "pr_p": k.fold_over("b_p", person)}).withColumn("po_p", k.fold_over("b_p", place))
    x = x.withColumn("ph_p", F.when(F.col("hold").isNotNull(), k.fold_over("b_p", held)))
    return x.join(by_org, "org")


def _split_share(moves: DataFrame, counts: DataFrame, lag: int, side: str) -> DataFrame:
    """Adds k_now / k_base (person's triples in both periods) and the person's number of moved triples.

    The moves are shuffled once, by the keys of the window and of both joins.
    """
    now = counts.select("mi", "person", F.col("k").alias("k_now"))
    base = counts.select((F.col("mi") + lag).alias("mi"), "person", F.col("k").alias("k_base"))
    moved = moves.where("mi is not null and person is not null").withColumn("n_moved", F.count(F.lit(1)).over(W.partitionBy("mi", "person")))
    return (moved.join(now, ["mi", "person"], "left" if side == "out" else "inner")
            .join(base, ["mi", "person"], "inner" if side == "out" else "left"))


def movement_in(masks: DataFrame, states: DataFrame, orgs: DataFrame, lag: int, last: int) -> DataFrame:
    """Label of every triple in portfolio now and not ``lag`` periods earlier."""
    k = wm.of(masks)
    h = _annotated(masks, orgs).withColumn("mi", F.explode(k.bit_positions(k.appeared(F.col("b_p"), lag), last)))
    base = F.col("mi") - lag
    was = {x: k.has_bit(F.col(x), base) for x in ("b_n", "b_any", "pr_p", "po_p", "ph_p")}
    lab = (F.when(was["b_n"], "in_from_nonzp").when(was["b_any"], "in_from_zp_out")
           .when(was["pr_p"] & was["po_p"], "in_oth_same_org").when(was["pr_p"] & F.coalesce(was["ph_p"], F.lit(False)), "in_oth_same_hold")
           .when(was["pr_p"], "in_oth_other").when(k.any_in(F.col("pr_p"), base - MEM, base - 1), "in_returned").otherwise("in_new_bank"))
    rows = h.select(*CELL, "person", "hold", lab.alias("lab"),
                    (k.mask_bit(F.col("b_p"), F.col("mi") - 2) if lag == 1 else F.lit(0).cast("bigint")).alias("in_temp"))
    r = _split_share(rows, portfolio_counts(states, ["mi", "person"], "k"), lag, "in")
    new, more = F.col("k_base").isNull(), F.col("k_now") > F.col("k_base")
    return r.select(*CELL, "person", "lab", F.when(new, 1.0 / F.col("k_now")).otherwise(0.0).alias("fl"), new.cast("bigint").alias("in_new"),
                    F.when(more, (F.col("k_now") - F.col("k_base")) / F.col("n_moved")).otherwise(0.0).alias("in_conc"), "in_temp")


def movement_out(masks: DataFrame, states: DataFrame, orgs: DataFrame, lag: int, last: int) -> DataFrame:
    """Label of every triple in portfolio ``lag`` periods earlier and not now."""
    k = wm.of(masks)
    h = _annotated(masks, orgs).withColumn("mi", F.explode(k.bit_positions(k.vanished(F.col("b_p"), lag, last), last)))
    at, base = F.col("mi"), F.col("mi") - lag
    now = {x: k.has_bit(F.col(x), at) for x in ("b_n", "b_any", "pr_p", "po_p", "ph_p", "org_p")}
    lab = (F.when(now["b_n"], "out_to_nonzp").when(now["b_any"], "out_zp_out")
           .when(now["pr_p"] & now["po_p"], "out_oth_same_org").when(now["pr_p"] & F.coalesce(now["ph_p"], F.lit(False)), "out_oth_same_hold")
           .when(now["pr_p"], "out_oth_other").when(k.seasonal_gap(F.col("b_p"), at), "lb_seasonal")
           .when(~now["org_p"], "lb_org_stopped").when(k.one_time(F.col("b_any"), base), "lb_one_time").otherwise("lb_unknown"))
    rows = h.select(*CELL, "person", "hold", lab.alias("lab"), k.mask_bit(F.col("b_p"), at + 1).alias("out_temp"),
                    k.tenure_band(F.col("b_p"), base).alias("ten"))
    r = _split_share(rows, portfolio_counts(states, ["mi", "person"], "k"), lag, "out")
    gone, fewer = F.col("k_now").isNull(), F.col("k_base") > F.col("k_now")
    return r.select(*CELL, "person", "lab", F.when(gone, 1.0 / F.col("k_base")).otherwise(0.0).alias("fl"), gone.cast("bigint").alias("out_gone"),
                    F.when(fewer, (F.col("k_base") - F.col("k_now")) / F.col("n_moved")).otherwise(0.0).alias("out_conc"), "out_temp", "ten")


def label_counts_in(moves: DataFrame) -> DataFrame:
    """One count per arrival label and cell, with person and multi-job parts."""
    lab = F.col("lab")
    return moves.groupBy(*CELL).agg(
        *[F.count_if(lab == x).alias(x) for x in IN_LABELS], F.sum("fl").alias("fl_in"), F.sum("in_new").alias("in_person_new"),
        F.sum("in_conc").alias("in_conc"), F.sum(F.when(lab.isin("in_new_bank", "in_returned"), F.col("in_temp")).otherwise(0)).alias("in_temp_outside"))


def label_counts_out(moves: DataFrame) -> DataFrame:
    lab = F.col("lab")
    return moves.groupBy(*CELL).agg(
        *[F.count_if(lab == x).alias(x) for x in OUT_LABELS], *[F.count_if(F.col("ten") == t).alias(f"out_ten_{t}") for t in TENURES],
        F.sum("fl").alias("fl_out"), F.sum("out_gone").alias("out_person_gone"), F.sum("out_conc").alias("out_conc"),
        F.sum("out_temp").alias("out_temp"), F.sum(F.when(lab.startswith("lb_"), F.col("out_temp")).otherwise(0)).alias("out_temp_left"))


def with_history(states: DataFrame, k=mk) -> DataFrame:
    """Triple rows beside their own masks. A partition holds the periods of one triple."""
    w, mi, st = W.partitionBy(*TRIPLE), F.col("mi"), F.col("st")
    return states.withColumns({"b_any": k.over(F.lit(True), mi, w), "b_p": k.over(st == "P", mi, w), "b_n": k.over(st == "N", mi, w)})


def with_histories(states: DataFrame, last: int) -> DataFrame:
    """Triple rows beside their own masks and their person's, as ``triple_masks`` and ``_annotated`` give them.

    Windows in the partition of the person: nothing is joined, and states grouped there are not shuffled again. Rows without a
    person are left out, as are persons of whom no organisation is known; rows without an organisation are not in the person's mask.
    """
    k = wm.words_for(last)
    # ordered as the windows of the triples, which need no sort of their own then
    person = W.partitionBy("person").orderBy("org", "unit").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = with_history(states.where(F.col("person").isNotNull()), k).withColumns(
        {"pr_any": k.known_over(F.col("org").isNotNull(), F.col("mi"), person), "_known": F.count("org").over(person)})
    return x.where(F.col("_known") > 0).drop("_known")


def stock(states: DataFrame, masks: DataFrame, orgs: DataFrame) -> DataFrame:
    """Nineteen stock counts per (period, org, unit).

    States of ``with_histories`` are their own masks. A person's triples of a period are counted by windows, not joined.
    """
    k = wm.of(masks)
    at, p = F.col("mi"), F.col("st") == "P"
    t = states if "pr_any" in states.columns else with_history(states, k).join(person_masks(masks), "person")
    # the windows below sort rows with flags, not with masks
    t = t.select(*CELL, "person", "region", "st", "pf_amt", "fot_amt", "n_rows", (F.col("n_pay") == 1).alias("single"),
                 k.flapping(F.col("b_any"), F.col("b_n"), at).alias("flaps"), k.one_time(F.col("b_any"), at).alias("once"),
                 k.one_time(F.col("pr_any"), at).alias("once_person"), k.tenure_band(F.col("b_p"), at).alias("ten"))
    place, held = W.partitionBy("mi", "person", "org"), W.partitionBy("mi", "person", "hold")
    person = W.partitionBy("mi", "person").orderBy("org").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    known = at.isNotNull()
    t = t.withColumns({"k_pf": F.when(known, F.count_if(p).over(person)), "n_po": F.when(known & F.col("org").isNotNull(), F.count_if(p).over(place))})
    t = t.join(orgs.select("org", "hold"), "org", "left").withColumn("n_ph", F.when(known & F.col("hold").isNotNull(), F.count_if(p).over(held)))
    many = p & (F.col("k_pf") > 1)
    one_org = F.col("n_po") == 1
    wider = F.coalesce(F.col("n_ph") > F.col("n_po"), F.lit(False))

    def cnt(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    return t.groupBy(*CELL).agg(
        F.min("region").alias("region"), cnt(p, "pf_recip"), F.sum(F.when(p, 1.0 / F.col("k_pf")).otherwise(0.0)).alias("pf_fl"),
        F.sum("pf_amt").alias("pf_amt"), F.sum("fot_amt").alias("fot_amt"), cnt(F.col("st") == "Z", "zp_out_recip"), cnt(F.col("st") == "N", "nonzp_recip"),
        _n().alias("any_recip"), F.sum("n_rows").alias("raw_rows"), cnt(p & F.col("single"), "single_pay_recip"),
        cnt(many, "multi_recip"), cnt(many & (F.col("n_po") > 1), "multi_same_org"), cnt(many & one_org & wider, "multi_same_hold"),
        cnt(many & one_org & ~wider, "multi_other"), cnt(F.col("flaps"), "flapping_recip"),
        cnt(p & F.col("once"), "one_time_pf"), cnt(p & F.col("once_person"), "one_time_person"),
        *[cnt(p & (F.col("ten") == x), f"ten_{x}") for x in TENURES])


def summary_keys(stocks: DataFrame, last: int, lags: Sequence[int] = (1, 12)) -> DataFrame:
    """Cells with triples now, or in portfolio one lag ago: each stock row is exploded to its periods."""
    ahead = F.array(*[F.when((F.col("pf_recip") > 0) & (F.col("mi") + k <= last), F.col("mi") + k) for k in lags])
    return (stocks.select("org", "unit", F.explode(F.array_compact(F.concat(F.array("mi"), ahead))).alias("mi"))
            .select(*CELL).distinct())


def segment_asof(keys: DataFrame, history: DataFrame, orgs: DataFrame, current_mi: int, not_found: str = "not found") -> DataFrame:
    """Segment of the period and current segment of each cell, with the source of the former.

    Priority: history of the cell, history of its organisation, organisation dimension, not found.
    """
    cell = history.groupBy(*CELL).agg(F.min("seg").alias("h_cell"))
    org = history.groupBy("mi", "org").agg(F.min("seg").alias("h_org"))
    cur = history.where(F.col("mi") == current_mi)
    cur_cell = cur.groupBy("org", "unit").agg(F.min("seg").alias("c_cell"))
    cur_org = cur.groupBy("org").agg(F.min("seg").alias("c_org"))
    dim = orgs.groupBy("org").agg(F.min("seg").alias("d"))
    nf = F.lit(not_found)
    return (keys.join(cell, list(CELL), "left").join(org, ["mi", "org"], "left").join(cur_cell, ["org", "unit"], "left")
            .join(cur_org, "org", "left").join(dim, "org", "left").select(
                *CELL, F.coalesce("h_cell", "h_org", "d", nf).alias("seg_rep"), F.coalesce("c_cell", "c_org", "d", nf).alias("seg_cur"),
                F.when(F.col("h_cell").isNotNull(), "history").when(F.col("h_org").isNotNull(), "org history")
                .when(F.col("d").isNotNull(), "dimension").otherwise("none").alias("seg_src")))


def segment_coverage(stocks: DataFrame, history: DataFrame) -> DataFrame:
    """Share of the portfolio whose cell has a segment in the history of that period."""
    h = history.select(*CELL).distinct().withColumn("hit", F.lit(True))
    return stocks.join(h, list(CELL), "left").groupBy("mi").agg(
        F.sum("pf_recip").alias("pf"), F.sum(F.when(F.col("hit"), F.col("pf_recip")).otherwise(0)).alias("pf_hist"))


def current_segment_period(coverage: DataFrame, ratio: float = 0.9) -> DataFrame:
    """Last full period of the history: coverage at least ``ratio`` of the median coverage."""
    s = coverage.where("pf > 0").select("mi", (F.col("pf_hist") / F.col("pf")).alias("cov"))
    mid = s.agg(F.median("cov")).scalar()
    return s.where(F.col("cov") >= ratio * mid).agg(F.max("mi").alias("mi"))


def base_columns(tag: str) -> list[str]:
    """Comparison columns of one base, in order; the yearly base has no seasonal label by definition."""
    labels = [x for x in OUT_LABELS if not (tag == "y" and x == "lb_seasonal")]
    return (["base_pf", "base_seg", "in_from_outside", "in_from_other_org", *IN_LABELS, "out_left_bank", "out_to_other_org", *labels,
             "fl_in", "fl_out", "fl_conc", "in_person_new", "out_person_gone", "in_conc", "out_conc"])


def month_summary(stocks: DataFrame, keys: DataFrame, segments: DataFrame, flows: dict[str, tuple[int, DataFrame, DataFrame]],
                  last: int, cmp0: int) -> DataFrame:
    """The wide summary. ``flows`` maps a tag to (lag, arrivals, departures) already counted by cell.

    Unknown stays NULL: comparisons before the first comparable period, memory labels without a full
    memory behind them, temporary moves without the next period.
    """
    mi = F.col("mi")
    out = keys.join(segments, list(CELL)).join(stocks, list(CELL), "left")
    memory = mi >= MEM
    sel: list[Column] = [mi, F.col("org"), F.col("unit"), F.col("seg_rep"), F.col("seg_cur"), F.col("seg_src")]
    regions = [F.col("region")]
    cols: list[Column] = []
    for s in STOCKS:
        e = _zero(s)
        if s.startswith(("ten_", "one_time")):
            e = F.when(memory, e)
        elif s == "flapping_recip":
            e = F.when(mi >= cmp0 + MEM, e)
        cols.append(e.alias(s))
    cols.append((mi + 2 > last).alias("prelim"))
    for tag, (lag, ins, outs) in flows.items():
        base = (keys.join(stocks.select(*CELL, "pf_recip", "pf_fl", "region"), list(CELL), "left").join(segments, list(CELL), "left")
                .select((mi + lag).alias("mi"), "org", "unit", F.col("pf_recip").alias(f"_{tag}_pf"), F.col("pf_fl").alias(f"_{tag}_plf"),
                        F.col("region").alias(f"_{tag}_region"), F.col("seg_rep").alias(f"_{tag}_seg")))
        tagged = lambda d: d.select(*CELL, *[F.col(c).alias(f"_{tag}_{c}") for c in d.columns if c not in CELL])  # noqa: B023,E731
        out = out.join(base, list(CELL), "left").join(tagged(ins), list(CELL), "left").join(tagged(outs), list(CELL), "left")
        regions.append(F.col(f"_{tag}_region"))
        on = mi - lag >= cmp0
        mem = on & (mi - lag - MEM >= 0)
        z = lambda c: _zero(f"_{tag}_{c}")  # noqa: B023,E731
        total = lambda names: sum((z(n) for n in names[1:]), z(names[0]))  # noqa: B023,E731
        special = {"base_pf": z("pf"), "base_seg": F.col(f"_{tag}_seg"), "in_from_outside": total(IN_LABELS[:2]),
                   "in_from_other_org": total([x for x in IN_LABELS if x.startswith("in_oth")]),
                   "out_left_bank": total([x for x in OUT_LABELS if x.startswith("lb_")]),
                   "out_to_other_org": total([x for x in OUT_LABELS if x.startswith("out_oth")]),
                   "fl_conc": (_zero("pf_fl") - z("plf")) - z("fl_in") + z("fl_out")}
        for c in base_columns(tag):
            needs_memory = c in ("in_new_bank", "in_returned") or c.startswith("lb_")
            cols.append(F.when(mem if needs_memory else on, special.get(c, z(c) if c not in special else None)).alias(f"{tag}_{c}"))
        if lag == 1:
            nxt = on & (mi + 1 <= last)
            cols += [F.when(nxt, z("out_temp")).alias(f"{tag}_out_temp"), F.when(nxt, z("out_temp_left")).alias(f"{tag}_out_temp_left"),
                     F.when(mi - 2 >= cmp0, z("in_temp_outside")).alias(f"{tag}_in_temp_outside")]
            cols += [F.when(mem, z(f"out_ten_{t}")).alias(f"{tag}_out_ten_{t}") for t in TENURES]
    return out.select(*sel, F.coalesce(*regions).alias("region"), *cols)


def build_summary(states: DataFrame, orgs: DataFrame, history: DataFrame, last: int, cmp0: int, current_mi: int,
                  lags: dict[str, int] | None = None, stage: str | None = None) -> DataFrame:
    """Triples to the wide summary.

    With ``stage`` the grouped triples, the annotated histories and the stocks are written once to the
    shared folder: four labellings and three uses of the stocks then read files and repeat no join.
    """
    from ..session import stage_table
    lags = lags or {"m": 1, "y": 12}
    keep = (lambda df, name: stage_table(df, f"{stage}/{name}")) if stage else (lambda df, name: df)
    states = keep(states, "triples")
    masks = keep(_annotated(triple_masks(states), orgs), "history")
    stocks = keep(stock(states, masks, orgs), "stocks")
    keys = summary_keys(stocks, last, tuple(lags.values()))
    flows = {t: (k, label_counts_in(movement_in(masks, states, orgs, k, last)), label_counts_out(movement_out(masks, states, orgs, k, last)))
             for t, k in lags.items()}
    return month_summary(stocks, keys, segment_asof(keys, history, orgs, current_mi), flows, last, cmp0)


def flow_pairs(outs: DataFrame, ins: DataFrame, cmp0: int, min_n: int) -> DataFrame:
    """Organisation, unit → organisation, unit matrix of persons who changed place in a period."""
    d = outs.where(F.col("lab").startswith("out_oth") & (F.col("mi") - 1 >= cmp0)).select(
        "mi", "person", F.col("org").alias("from_org"), F.col("unit").alias("from_unit"))
    a = ins.where(F.col("lab").startswith("in_oth")).select("mi", "person", F.col("org").alias("to_org"), F.col("unit").alias("to_unit"))
    return (paired(d, a, ["mi", "person"]).groupBy("mi", "from_org", "from_unit", "to_org", "to_unit").agg(_n().alias("n_recip"))
            .where(F.col("n_recip") >= min_n))


# ------------------------------------------------------------------- checks

def _sum_of(names: Sequence[str]) -> Column:
    return sum((F.col(n) for n in names[1:]), F.col(names[0]))


def identities(tags: Sequence[str] = ("m", "y"), tol: float = 0.01) -> dict[str, Column]:
    """Conditions that no summary row may meet."""
    bad: dict[str, Column] = {"any_is_sum_of_states": F.col("any_recip") != _sum_of(["pf_recip", "zp_out_recip", "nonzp_recip"]),
                              "multi_parts": F.col("multi_recip") != _sum_of(["multi_same_org", "multi_same_hold", "multi_other"]),
                              "tenure_parts": F.col("pf_recip") != _sum_of([f"ten_{t}" for t in TENURES]),
                              "multi_within_stock": F.col("multi_recip") > F.col("pf_recip"),
                              "persons_within_stock": F.col("pf_fl") > F.col("pf_recip") + tol}
    for t in tags:
        ins = [f"{t}_{x}" for x in ("in_from_outside", "in_from_nonzp", "in_from_zp_out", "in_from_other_org")]
        outs = [f"{t}_{x}" for x in ("out_left_bank", "out_to_nonzp", "out_zp_out", "out_to_other_org")]
        bad[f"{t}_stock"] = F.col("pf_recip") != F.col(f"{t}_base_pf") + _sum_of(ins) - _sum_of(outs)
        bad[f"{t}_outside_parts"] = F.col(f"{t}_in_from_outside") != _sum_of([f"{t}_in_new_bank", f"{t}_in_returned"])
        bad[f"{t}_other_in_parts"] = F.col(f"{t}_in_from_other_org") != _sum_of([f"{t}_{x}" for x in IN_LABELS if x.startswith("in_oth")])
        bad[f"{t}_other_out_parts"] = F.col(f"{t}_out_to_other_org") != _sum_of([f"{t}_{x}" for x in OUT_LABELS if x.startswith("out_oth")])
        bad[f"{t}_left_parts"] = F.col(f"{t}_out_left_bank") != _sum_of([f"{t}_{x}" for x in OUT_LABELS
                                                                         if x.startswith("lb_") and not (t == "y" and x == "lb_seasonal")])
        bad[f"{t}_left_within_base"] = _sum_of(outs) > F.col(f"{t}_base_pf")
    if "m" in tags:
        bad["m_tenure_of_leavers"] = (_sum_of([f"m_out_ten_{x}" for x in TENURES])
                                      != _sum_of([f"m_{x}" for x in ("out_left_bank", "out_to_nonzp", "out_zp_out", "out_to_other_org")]))
        bad["m_temp_within_out"] = F.col("m_out_temp_left") > F.col("m_out_left_bank")
    return bad


def identity_checks(summary: DataFrame, tags: Sequence[str] = ("m", "y")) -> DataFrame:
    """Rows breaking each identity, in one aggregation; every count must be 0."""
    bad = identities(tags)
    one = summary.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in bad.items()])
    return one.selectExpr(f"stack({len(bad)}, " + ", ".join(f"'{n}', `{n}`" for n in bad) + ") as (check, n_bad)")


# Fixed set: measures kept in a generation, each with the summary columns it adds up.
GENERATION = {
    **{m: (m,) for m in ("pf_recip", "pf_fl", "any_recip", "raw_rows", "fot_amt", "single_pay_recip", "multi_recip", "one_time_pf",
                         "m_base_pf", "m_in_from_outside", "m_in_returned", "m_in_temp_outside", "m_in_from_other_org")},
    "m_in_codes": ("m_in_from_nonzp", "m_in_from_zp_out"),
    **{m: (m,) for m in ("m_out_left_bank", "m_lb_unknown", "m_lb_seasonal", "m_lb_org_stopped", "m_lb_one_time", "m_out_to_other_org")},
    "m_out_codes": ("m_out_to_nonzp", "m_out_zp_out"),
    **{m: (m,) for m in ("m_out_temp", "m_out_temp_left", "m_fl_in", "m_fl_out", "m_fl_conc", "y_base_pf", "y_in_from_outside", "y_in_from_other_org")},
    "y_in_codes": ("y_in_from_nonzp", "y_in_from_zp_out"),
    **{m: (m,) for m in ("y_out_left_bank", "y_out_to_other_org")},
    "y_out_codes": ("y_out_to_nonzp", "y_out_zp_out"), "y_fl_conc": ("y_fl_conc",),
}


def generation(summary: DataFrame, run_id: int, tracked: DataFrame | None = None) -> DataFrame:
    """Summary folded to atoms (segment × region × unit) and, for tracked organisations, to their cells."""
    meas = [F.sum(_sum_of(cols)).alias(m) for m, cols in GENERATION.items()]
    atom = summary.groupBy("mi", "seg_rep", "region", "unit").agg(*meas).withColumns({"lvl": F.lit("atom"), "org": F.lit(None).cast(summary.schema["org"].dataType)})
    out = atom
    if tracked is not None:
        org = (summary.join(tracked.select("org"), "org", "left_semi").groupBy("mi", "seg_rep", "region", "unit", "org").agg(*meas)
               .withColumn("lvl", F.lit("org")))
        out = atom.unionByName(org)
    return out.withColumn("run_id", F.lit(run_id).cast("bigint"))


def journal(summary: DataFrame, states: DataFrame, run_id: int, checks_ok: bool, total: str = "bank") -> DataFrame:
    """Totals of a run by slice (whole, region, both segments) with exact distinct persons."""
    slices = {"bank": F.lit(total), "region": F.col("region").cast("string"), "seg_rep": F.col("seg_rep"), "seg_cur": F.col("seg_cur")}

    def exploded(df: DataFrame) -> DataFrame:
        return df.withColumn("s", F.explode(F.array(*[F.struct(F.lit(t).alias("slice_type"), v.alias("slice_value")) for t, v in slices.items()]))).select("*", "s.*")

    seg = summary.select(*CELL, "seg_rep", "seg_cur")
    placed = states.where(F.col("st") == "P").join(seg, list(CELL))
    persons = (exploded(placed).select("mi", "slice_type", "slice_value", "person").distinct()
               .groupBy("mi", "slice_type", "slice_value").agg(_n().alias("persons")))
    rows = exploded(summary).groupBy("mi", "slice_type", "slice_value").agg(*[F.sum(c).alias(c) for c in ("pf_recip", "any_recip", "raw_rows", "fot_amt")])
    on = [rows[c].eqNullSafe(persons[c]) for c in ("mi", "slice_type", "slice_value")]
    return rows.join(persons, on, "left").select(
        F.lit(run_id).cast("bigint").alias("run_id"), rows["mi"], rows["slice_type"], rows["slice_value"], "pf_recip", "persons", "any_recip",
        "raw_rows", "fot_amt", F.lit(checks_ok).alias("checks_ok"))


def revisions(now: DataFrame, journal_rows: DataFrame) -> DataFrame:
    """Periods whose whole-bank total changed since the last run that passed its checks."""
    ok = journal_rows.where("checks_ok")
    prev = ok.where((F.col("run_id") == ok.agg(F.max("run_id")).scalar()) & (F.col("slice_type") == "bank")).select("mi", F.col("pf_recip").alias("pf_before"))
    cur = now.groupBy("mi").agg(F.sum("pf_recip").alias("pf_now"))
    return cur.join(prev, "mi").where("pf_now <> pf_before").withColumn("change", F.col("pf_now") - F.col("pf_before"))


def underload_regions(stocks: DataFrame, gap: float = 0.9, measure: str = "raw_rows", lag_year: int | None = None) -> DataFrame:
    """Regions whose ratio to the previous period is clearly worse than the whole's (and than their own a year ago)."""
    reg = stocks.groupBy("mi", "region").agg(F.sum(measure).alias("v"))
    allr = reg.groupBy("mi").agg(F.sum("v").alias("a"))

    def ratio(df: DataFrame, col: str, keys: list[str], name: str) -> DataFrame:
        prev = df.select((F.col("mi") + 1).alias("mi"), *keys, F.col(col).alias("p"))
        return df.join(prev, ["mi", *keys]).select("mi", *keys, (F.col(col) / F.col("p")).alias(name))

    rr = ratio(reg, "v", ["region"], "ratio")
    j = rr.join(ratio(allr, "a", [], "bank_ratio"), "mi")
    bad = F.col("ratio") < gap * F.col("bank_ratio")
    if lag_year:
        j = j.join(rr.select((F.col("mi") + lag_year).alias("mi"), "region", F.col("ratio").alias("ratio_year")), ["mi", "region"])
        bad = bad & (F.col("ratio") < gap * F.col("ratio_year"))
    return j.where(bad)


def tie_out(a: DataFrame, b: DataFrame, value: str, tol: float, keys: Sequence[str] = ("mi",)) -> DataFrame:
    """Two independent totals side by side: difference and whether it stays within the tolerance."""
    j = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "full_outer")
    diff = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return j.select(*keys, "a", "b", diff.alias("diff"), (F.abs(diff) <= tol * F.greatest(F.abs(F.coalesce("b", F.lit(0))), F.lit(1))).alias("ok"))
