"""Movement between a base period ``b`` and a current period ``c``: who left, who came, and why.

The two periods are folded into one row per key by conditional aggregation instead of anti joins:
one shuffle by the key gives both sides, and partial aggregation absorbs hot keys.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from .pairs import paired

ONE = "n"
TRIPLE = ("person", "org", "unit")
OUTSIDE = "outside"


def _n() -> Column:
    return F.count(F.lit(1))


def _at(mi: int) -> Column:
    return F.col("mi") == mi


def two_periods(df: DataFrame, b: int, c: int, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per key with in_b / in_c; carried attributes come from the base side when present."""
    return df.where(F.col("mi").isin(b, c)).groupBy(*keys).agg(
        F.bool_or(_at(b)).alias("in_b"), F.bool_or(_at(c)).alias("in_c"),
        *[F.coalesce(F.min(F.when(_at(b), F.col(x))), F.min(x)).alias(x) for x in carry])


def lost_gained(df: DataFrame, b: int, c: int, keys: Sequence[str] = TRIPLE, carry: Sequence[str] = ()) -> DataFrame:
    """Keys present in exactly one of the two periods, with the side they are on."""
    return (two_periods(df, b, c, keys, carry).where(F.col("in_b") != F.col("in_c"))
            .select(F.when(F.col("in_b"), "lost").otherwise("gained").alias("side"), *keys, *carry))


# ------------------------------------------------------------------- ladders

def gone_cause(amt_all: Column, amt_codes: Column) -> Column:
    """Why a person is no recipient in the later period; the first rule that holds."""
    return (F.when(F.coalesce(amt_all, F.lit(0)) <= 0, "left_bank").when(amt_codes > 0, "below_threshold")
            .otherwise("other_codes"))


def come_cause(amt_all: Column, amt_codes: Column) -> Column:
    return (F.when(F.coalesce(amt_all, F.lit(0)) <= 0, "new_to_bank").when(amt_codes > 0, "above_threshold")
            .otherwise("back_to_codes"))


def segment_status(lines: DataFrame, orgs: DataFrame, rec: DataFrame, segment: str, b: int, c: int) -> DataFrame:
    """Per person and both periods: recipient of the segment, seen anywhere, money inside the segment."""
    inside = F.col("seg") == segment
    paid = (lines.where(_at(b) | _at(c)).join(orgs.select("org", "seg"), "org", "left")
            .groupBy("mi", "person").agg(
                F.bool_or(F.col("amt") > 0).alias("seen"),
                F.sum(F.when(inside, F.col("amt"))).alias("all_s"),
                F.sum(F.when(inside & F.col("is_pf"), F.col("amt"))).alias("codes_s")))
    mine = rec.where((_at(b) | _at(c)) & inside).select("mi", "person").distinct().withColumn("is_rec", F.lit(True))
    u = paid.unionByName(mine, allowMissingColumns=True)
    aggs = []
    for tag, mi in (("b", b), ("c", c)):
        aggs += [F.coalesce(F.bool_or(F.when(_at(mi), F.col("is_rec"))), F.lit(False)).alias(f"rec_{tag}"),
                 F.coalesce(F.bool_or(F.when(_at(mi), F.col("seen"))), F.lit(False)).alias(f"seen_{tag}"),
                 F.max(F.when(_at(mi), F.col("all_s"))).alias(f"all_{tag}"),
                 F.max(F.when(_at(mi), F.col("codes_s"))).alias(f"codes_{tag}")]
    return u.groupBy("person").agg(*aggs)


def _segment_ladder(tag: str, gone: bool, with_stay: bool) -> Column:
    names = (("left_bank", "below_threshold", "other_codes", "left_segment") if gone
             else ("new_to_bank", "above_threshold", "back_to_codes", "from_segment"))
    rest = (F.when(~F.col(f"seen_{tag}"), names[0]).when(F.col(f"codes_{tag}") > 0, names[1])
            .when(F.col(f"all_{tag}") > 0, names[2]).otherwise(names[3]))
    return F.when(F.col(f"rec_{tag}"), "stayed_in_segment").otherwise(rest) if with_stay else rest


def segment_moves(rec: DataFrame, status: DataFrame, segment: str, b: int, c: int, keys: Sequence[str] = TRIPLE,
                  carry: Sequence[str] = ("region", "pf_amt")) -> DataFrame:
    """Lost and gained recipients of one segment, each with exactly one cause."""
    m = lost_gained(rec.where(F.col("seg") == segment), b, c, keys, carry).join(status, "person", "left")
    cause = F.when(F.col("side") == "lost", _segment_ladder("c", True, True)).otherwise(_segment_ladder("b", False, True))
    return m.select("side", *keys, *carry, cause.alias("cause"))


def segment_person_moves(status: DataFrame) -> DataFrame:
    """Persons who stopped or started being recipients of the segment, by the shorter ladder."""
    lost = F.col("rec_b") & ~F.col("rec_c")
    cause = F.when(lost, _segment_ladder("c", True, False)).otherwise(_segment_ladder("b", False, False))
    return status.where(F.col("rec_b") != F.col("rec_c")).select(
        F.when(lost, "lost").otherwise("gained").alias("side"), "person", cause.alias("cause"))


def cause_totals(moves: DataFrame, by: Sequence[str] = ("side", "cause"), amount: str | None = None) -> DataFrame:
    aggs = [F.sum("k").alias("n_triples"), _n().alias("n_persons")]
    inner = [_n().alias("k")]
    if amount:
        inner.append(F.sum(amount).alias("amt"))
        aggs.append(F.sum("amt").alias("amt"))
    return moves.groupBy(*by, "person").agg(*inner).groupBy(*by).agg(*aggs)


# -------------------------------------------------------------- person panel

def person_panel(rec: DataFrame, pm: DataFrame, pres: DataFrame, b: int, c: int) -> DataFrame:
    """Everything the flow reports need about a person around b → c, in one row and one shuffle.

    Person-period, presence and recipient rows are stacked and folded by conditional aggregates,
    in place of a full join and five left joins. ``segs_*`` hold at most one entry per segment name.
    """
    near = sorted({b - 2, b - 1, b, c, c + 1})
    u = (pm.where(F.col("mi").isin(near)).select("mi", "person", "main_seg", "n_org", "n_triples", F.lit(True).alias("is_rec"))
         .unionByName(pres.where(F.col("mi").isin(b, c)).select("mi", "person", "amt_all", "amt_codes"), allowMissingColumns=True)
         .unionByName(rec.where(F.col("mi").isin(b, c)).groupBy("mi", "person", "seg").agg(F.bool_or("focus").alias("focus")),
                      allowMissingColumns=True))

    def at(mi: int, col: str) -> Column:
        return F.max(F.when(_at(mi), F.col(col)))

    def present(mi: int) -> Column:
        return F.coalesce(at(mi, "is_rec"), F.lit(False))

    aggs = [present(b - 2).alias("in_bp2"), present(b - 1).alias("in_bp1"), present(c + 1).alias("in_cn1")]
    for tag, mi in (("b", b), ("c", c)):
        aggs += [present(mi).alias(f"in_{tag}"), at(mi, "main_seg").alias(f"seg_{tag}"),
                 at(mi, "n_org").alias(f"org_{tag}"), at(mi, "n_triples").alias(f"tr_{tag}"),
                 at(mi, "amt_all").alias(f"all_{tag}"), at(mi, "amt_codes").alias(f"codes_{tag}"),
                 F.collect_set(F.when(_at(mi), F.col("seg"))).alias(f"segs_{tag}"),
                 F.coalesce(F.bool_or(F.when(_at(mi), F.col("focus"))), F.lit(False)).alias(f"focus_{tag}")]
    return u.groupBy("person").agg(*aggs)


def _tenure(loaded: Collection[int], b: int) -> Column:
    if b - 1 not in loaded:
        return F.lit(None).cast("string")
    older = (F.lit(None).cast("string") if b - 2 not in loaded
             else F.when(~F.col("in_bp2"), "new2").otherwise("old"))
    return F.when(~F.col("in_bp1"), "new1").otherwise(older)


def _known(loaded: Collection[int], mi: int, col: str) -> Column:
    return fc.tri_state(mi in loaded, F.col(col))


def person_flow(panel: DataFrame, b: int, c: int, loaded: Collection[int]) -> DataFrame:
    """Persons by main segment from → to, cause, tenure of leavers, came-back and next-period flags."""
    came, left = ~F.col("in_b"), ~F.col("in_c")
    cause = (F.when(came, come_cause(F.col("all_b"), F.col("codes_b")))
             .when(left, gone_cause(F.col("all_c"), F.col("codes_c"))).otherwise("stay"))
    rows = panel.where("in_b or in_c").select(
        F.coalesce("seg_b", F.lit(OUTSIDE)).alias("seg_from"), F.coalesce("seg_c", F.lit(OUTSIDE)).alias("seg_to"),
        cause.alias("cause"), F.when(~came, _tenure(loaded, b)).alias("tenure"),
        F.when(came, _known(loaded, b - 1, "in_bp1")).alias("was_before"), _known(loaded, c + 1, "in_cn1").alias("in_next"),
        "tr_b", "tr_c", "org_b", "org_c")
    return rows.groupBy("seg_from", "seg_to", "cause", "tenure", "was_before", "in_next").agg(
        _n().alias("n_persons"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tr_b", "tr_c", "org_b", "org_c")])


def triple_flow(rec: DataFrame, panel: DataFrame, b: int, c: int, loaded: Collection[int], focus_only: bool = False) -> DataFrame:
    """Lost and gained triples by segment: inside, another segment (or organisation), or a cause."""
    flow = lost_gained(rec, b, c, TRIPLE, ("seg", "focus"))
    if focus_only:
        flow = flow.where("focus")
    lost = F.col("side") == "lost"

    def other(x: str) -> Column:
        return F.when(lost, F.col(f"{x}_c")).otherwise(F.col(f"{x}_b"))

    inside = other("focus") if focus_only else F.array_contains(other("segs"), F.col("seg"))
    cause = (F.when(inside, "inside").when(other("in"), "other_org" if focus_only else "other_seg")
             .when(lost, gone_cause(F.col("all_c"), F.col("codes_c")))
             .otherwise(come_cause(F.col("all_b"), F.col("codes_b"))))
    by = ["side", "cause", "tenure", "in_next"] + ([] if focus_only else ["seg"])
    rows = flow.join(panel, "person", "left").select(
        "side", "seg", "person", cause.alias("cause"), F.when(lost, _tenure(loaded, b)).alias("tenure"),
        _known(loaded, c + 1, "in_cn1").alias("in_next"))
    return cause_totals(rows, by)


def stop_size(rec: DataFrame, panel: DataFrame, b: int, c: int) -> DataFrame:
    """Leavers of the bank by how many left the same organisation: one or two alone, more together."""
    lost = (lost_gained(rec, b, c, TRIPLE, ("seg", "focus")).where(F.col("side") == "lost")
            .join(panel.where("in_c").select("person"), "person", "left_anti"))
    per = lost.groupBy("org", "person").agg(F.min("seg").alias("seg"), F.bool_or("focus").alias("focus"), _n().alias("n_tr"))
    org = per.groupBy("org").agg(F.min("seg").alias("seg"), F.bool_or("focus").alias("focus"), _n().alias("n"), F.sum("n_tr").alias("n_tr"))
    edges, last = fc.STOP_BANDS
    return org.groupBy("seg", "focus", fc.band("n", edges, last).alias("bucket")).agg(
        _n().alias("n_orgs"), F.sum("n").alias("n_persons"), F.sum("n_tr").alias("n_triples")).withColumn(
        "kind", F.when(F.col("bucket").isin("1", "2"), "individual").otherwise("corporate"))


def focus_totals(rec: DataFrame) -> DataFrame:
    """Triples, pairs, persons and organisations of the highlighted group per period."""
    x = rec.where("focus").groupBy("mi", "person", "org").agg(_n().alias("n"))
    per = x.groupBy("mi", "person").agg(F.sum("n").alias("n"), _n().alias("k"))
    out = per.groupBy("mi").agg(F.sum("n").alias("n_triples"), F.sum("k").alias("n_pairs"), _n().alias("n_persons"))
    orgs = x.groupBy("mi", "org").agg(F.lit(1).alias("_")).groupBy("mi").agg(_n().alias("n_orgs"))
    return out.join(orgs, "mi")


# --------------------------------------------------------- where people went

def org_migration(rec: DataFrame, lines: DataFrame, b: int, c: int, min_movers: int, reorg_share: float = 0.3) -> DataFrame:
    """Organisations people moved to after losing one, without those they already had."""
    had = two_periods(rec, b, c, ("person", "org"))
    lost = had.where("in_b and not in_c").select("person", F.col("org").alias("org_from"))
    seen = lines.where(_at(c) & (F.col("amt") > 0)).select("person", "org").distinct()
    new = seen.join(had.where("in_b").select("person", "org"), ["person", "org"], "left_anti").withColumnRenamed("org", "org_to")
    moves = paired(lost, new, ["person"]).groupBy("org_from", "org_to").agg(_n().alias("n_persons")).where(F.col("n_persons") >= min_movers)
    losers = lost.groupBy("org_from").agg(_n().alias("n_lost"))
    return (moves.join(losers, "org_from").withColumn("share", fc.share("n_persons", "n_lost"))
            .withColumn("is_reorg", F.col("share") >= reorg_share))


def successor_orgs(rec: DataFrame, b: int, c: int, min_movers: int, min_share: float) -> DataFrame:
    """Organisation pairs where enough leavers of one are now paid by the other."""
    flow = two_periods(rec, b, c, ("person", "org"))
    left = flow.where("in_b and not in_c").select("person", F.col("org").alias("org_from"))
    now = flow.where("in_c").select("person", F.col("org").alias("org_to"))
    pair = paired(left, now, ["person"]).groupBy("org_from", "org_to").agg(_n().alias("n_moved"))
    return (pair.join(left.groupBy("org_from").agg(_n().alias("n_left")), "org_from")
            .where((F.col("n_moved") >= min_movers) & (F.col("n_moved") >= min_share * F.col("n_left"))))


def leaver_segments(lines: DataFrame, orgs: DataFrame, person_moves: DataFrame, c: int) -> DataFrame:
    """To which segments the persons went who left the segment."""
    gone = person_moves.where((F.col("side") == "lost") & (F.col("cause") == "left_segment")).select("person")
    seen = lines.where(_at(c) & (F.col("amt") > 0)).join(orgs.select("org", "seg"), "org", "left")
    per = seen.join(gone, "person", "left_semi").select(F.coalesce("seg", F.lit("not in dimension")).alias("seg"), "person").distinct()
    return per.groupBy("seg").agg(_n().alias("n_persons"))


def leaver_orgs(lines: DataFrame, orgs: DataFrame, rec: DataFrame, person_moves: DataFrame, segment: str, b: int, c: int,
                top: int = 10) -> DataFrame:
    """Organisations that took them: main place by money, same unit or not, share of the top ten."""
    gone = person_moves.where((F.col("side") == "lost") & (F.col("cause") == "left_segment")).select("person")
    units = rec.where(_at(b) & (F.col("seg") == segment)).select("person", "unit").distinct().withColumn("same", F.lit(True))
    place = (lines.where(_at(c)).join(gone, "person", "left_semi").join(orgs.select("org", "seg"), "org", "left")
             .where(F.coalesce("seg", F.lit("")) != segment).groupBy("person", "org", "unit").agg(F.sum("amt").alias("amt")).where("amt > 0"))
    main = place.groupBy("person").agg(F.min_by(F.struct("org", "unit"), F.struct(-F.col("amt"), F.col("org"), F.col("unit"))).alias("m"))
    g = (main.select("person", "m.org", "m.unit").join(units, ["person", "unit"], "left").groupBy("org")
         .agg(_n().alias("n_persons"), F.count("same").alias("n_same_unit")))
    best = g.orderBy(F.desc("n_persons"), "org").limit(top)
    total = g.agg(F.sum("n_persons")).scalar()
    top10 = g.orderBy(F.desc("n_persons"), "org").limit(10).agg(F.sum("n_persons")).scalar()
    return best.select("*", total.alias("total"), fc.share(top10, total).alias("top10_share"))


def replacement_codes(lines: DataFrame, orgs: DataFrame, person_moves: DataFrame, segment: str, c: int) -> DataFrame:
    """Non-salary codes paid inside the segment to leavers whose salary codes ended, by code and organisation."""
    gone = person_moves.where((F.col("side") == "lost") & (F.col("cause") == "other_codes")).select("person")
    mine = orgs.where(F.col("seg") == segment).select("org")
    return (lines.where(_at(c) & ~F.col("is_pf")).join(mine, "org", "left_semi").join(gone, "person", "left_semi")
            .groupBy("code", "org", "person").agg(F.sum("amt").alias("amt"))
            .groupBy("code", "org").agg(_n().alias("n_persons"), F.sum("amt").alias("amt")))


def stayed_split(moves: DataFrame, rec: DataFrame, orgs: DataFrame, segment: str, c: int) -> DataFrame:
    """Of lost triples whose person stays in the segment: share in the same region, holding, unit.

    Each of a person's n destinations weighs 1/n.
    """
    dest = rec.where(_at(c) & (F.col("seg") == segment)).select("person", *[F.col(x).alias(f"{x}_to") for x in ("org", "unit", "region", "hold")])
    w = 1.0 / F.col("n_dest")
    same_hold = F.when(F.col("hold").isNull(), F.col("org") == F.col("org_to")).otherwise(F.coalesce(F.col("hold") == F.col("hold_to"), F.lit(False)))
    s = (moves.where((F.col("side") == "lost") & (F.col("cause") == "stayed_in_segment")).join(orgs.select("org", "hold"), "org", "left")
         .join(dest.groupBy("person").agg(_n().alias("n_dest")), "person").join(dest, "person"))

    def part(ok: Column) -> Column:
        return F.sum(F.when(ok, w).otherwise(0.0))

    return s.groupBy("org").agg(F.sum(w).alias("n_triples"), part(F.col("region") == F.col("region_to")).alias("same_region"),
                                part(same_hold).alias("same_holding"), part(F.col("unit") == F.col("unit_to")).alias("same_unit"))


def multi_job_situations(moves: DataFrame, rec: DataFrame, lines: DataFrame, segment: str, b: int, c: int) -> DataFrame:
    """For persons who stay in the segment: why one of their jobs vanished or appeared."""
    mine = rec.where(F.col("seg") == segment)
    pairs = two_periods(mine, b, c, ("person", "org"))
    org = two_periods(mine, b, c, ("org",)).select("org", F.col("in_b").alias("o_b"), F.col("in_c").alias("o_c"))
    paid = lines.where(_at(b) | _at(c)).groupBy("person", "org").agg(*[
        F.sum(F.when(_at(mi) & cond, F.col("amt"))).alias(f"{n}_{t}")
        for t, mi in (("b", b), ("c", c)) for n, cond in (("all", F.lit(True)), ("codes", F.col("is_pf")))])
    j = (moves.where(F.col("cause") == "stayed_in_segment").join(pairs, ["person", "org"], "left")
         .join(org, "org", "left").join(paid, ["person", "org"], "left"))

    def other(x: str) -> Column:
        return F.when(F.col("side") == "lost", F.col(f"{x}_c")).otherwise(F.col(f"{x}_b"))

    why = (F.when(F.coalesce(other("in"), F.lit(False)), "same_org").when(~F.coalesce(other("o"), F.lit(False)), "org_stopped")
           .when(other("codes") > 0, "below").when(other("all") > 0, "other_codes").otherwise("no_pay"))
    return j.select("side", "person", "org", "unit", why.alias("situation"))


def stopped_org_targets(situations: DataFrame, rec: DataFrame, segment: str, c: int, top: int) -> DataFrame:
    """Stopped organisations of the staying persons with the place most of them moved to."""
    rows = situations.where((F.col("side") == "lost") & F.col("situation").isin("org_stopped", "no_pay"))
    src = rows.groupBy("situation", "org").agg(_n().alias("n_triples"))
    now = rec.where(_at(c) & (F.col("seg") == segment)).select("person", F.col("org").alias("org_to")).distinct()
    dst = (rows.where(F.col("situation") == "org_stopped").select("situation", "org", "person").distinct().join(now, "person")
           .groupBy("situation", "org", "org_to").agg(_n().alias("n_to"))
           .groupBy("situation", "org").agg(F.min_by(F.struct("org_to", "n_to"), F.struct(-F.col("n_to"), F.col("org_to"))).alias("d"))
           .select("situation", "org", "d.org_to", "d.n_to"))
    from .ranking import top_n_per_group
    return top_n_per_group(src, ["situation"], [F.desc("n_triples"), F.asc("org")], top, "pos").join(dst, ["situation", "org"], "left")


# ------------------------------------------------------------- single leavers

def season_confirmed(pm: DataFrame, b: int, c: int) -> DataFrame:
    """Absent this period in both years though paid the period before in both; and who came back."""
    near = [b - 1, b, b + 1, c - 1, c, c + 1]
    flags = pm.where(F.col("mi").isin(near)).groupBy("person").agg(
        F.min(F.when(_at(b - 1), F.col("main_seg"))).alias("seg"),
        *[F.bool_or(_at(m)).alias(f"in_{t}") for t, m in (("bp", b - 1), ("b", b), ("bn", b + 1), ("cp", c - 1), ("c", c), ("cn", c + 1))])
    no_b, no_c = ~F.col("in_b"), ~F.col("in_c")
    return flags.where("in_bp and in_cp").groupBy("seg").agg(
        _n().alias("n_prev_both"), F.count_if(no_b).alias("n_gone_base"), F.count_if(no_c).alias("n_gone_cur"),
        F.count_if(no_b & no_c).alias("n_seasonal"), F.count_if(no_b & F.col("in_bn")).alias("n_back_base"),
        F.count_if(no_c & F.col("in_cn")).alias("n_back_cur"))


def tenure_of_leavers(person_moves: DataFrame, rec: DataFrame, segment: str, b: int) -> DataFrame:
    """Periods in the segment before leaving, by cause."""
    ten = (rec.where((F.col("mi") <= b) & (F.col("seg") == segment)).select("person", "mi").distinct()
           .groupBy("person").agg(_n().alias("k")))
    edges, last = fc.TENURE_BANDS
    return (person_moves.where(F.col("side") == "lost").join(ten, "person", "left")
            .groupBy("cause", fc.band(F.coalesce("k", F.lit(0)), edges, last).alias("bucket")).agg(_n().alias("n_persons")))


def exit_pattern(person_moves: DataFrame, lines: DataFrame, first: int, c: int, drop: float) -> DataFrame:
    """How leavers of the bank went: abruptly, after smaller sums, after fewer payments, or too short to say.

    The last five paid periods are picked per person from an array of at most one entry per period.
    """
    gone = person_moves.where((F.col("side") == "lost") & (F.col("cause") == "left_bank")).select("person")
    m = (lines.where(F.col("mi").between(first, c)).join(gone, "person", "left_semi").groupBy("person", "mi")
         .agg(F.sum("amt").alias("amt"), F.sum("qty").alias("qty")).where("amt > 0"))
    per = m.groupBy("person").agg(F.max("mi").alias("last_mi"), F.sort_array(F.collect_list(F.struct(
        (-F.col("mi")).alias("k"), F.col("amt").cast("double").alias("amt"), F.col("qty").cast("double").alias("qty")))).alias("h"))

    def mean(x: str, start: int, n: int) -> Column:
        part = F.transform(F.slice("h", start, n), lambda r: r[x])
        return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.size(part))

    f = per.select("last_mi", mean("amt", 1, 2).alias("a1"), mean("amt", 3, 3).alias("a0"),
                   mean("qty", 1, 2).alias("q1"), mean("qty", 3, 3).alias("q0"))
    pattern = (F.when(F.col("a0").isNull() | (F.col("a0") <= 0), "short").when(F.col("a1") < drop * F.col("a0"), "amt")
               .when(F.col("q1") < drop * F.col("q0"), "qty").otherwise("abrupt"))
    ratio = F.when(F.col("a0") > 0, F.col("a1") / F.col("a0"))
    return f.groupBy(pattern.alias("pattern"), "last_mi").agg(
        _n().alias("n_persons"), F.sum(ratio).alias("sum_ratio"), F.count(ratio).alias("n_ratio"))


def pay_level(moves: DataFrame, rec: DataFrame, segment: str, b: int, min_org: int) -> DataFrame:
    """Recipients of the base period by pay against their organisation's average, by what became of them."""
    base = rec.where(_at(b) & (F.col("seg") == segment))
    avg = base.groupBy("org").agg(F.avg(F.col("pf_amt").cast("double")).alias("m"), _n().alias("k")).where(F.col("k") >= min_org)
    fate = moves.where(F.col("side") == "lost").select("person", "org", "unit", "cause")
    r = F.col("pf_amt").cast("double") / F.col("m")
    bucket = F.when(r < 0.5, 1).when(r < 0.8, 2).when(r < 1.2, 3).when(r < 2.0, 4).otherwise(5)
    return (base.join(avg, "org").join(fate, ["person", "org", "unit"], "left")
            .groupBy(F.coalesce("cause", F.lit("retained")).alias("fate"), bucket.alias("bucket")).agg(_n().alias("n_triples")))


def below_depth(person_moves: DataFrame, rec: DataFrame, lines: DataFrame, orgs: DataFrame, segment: str, b: int, c: int, threshold) -> DataFrame:
    """How far below the threshold: by level and by change against the base period."""
    gone = person_moves.where((F.col("side") == "lost") & (F.col("cause") == "below_threshold")).select("person")
    base = (rec.where(_at(b) & (F.col("seg") == segment)).join(gone, "person", "left_semi").groupBy("person", "org")
            .agg(F.sum("pf_amt").alias("a")).groupBy("person").agg(F.max("a").alias("amt_b")))
    mine = orgs.where(F.col("seg") == segment).select("org")
    cur = (lines.where(_at(c) & F.col("is_pf")).join(mine, "org", "left_semi").join(gone, "person", "left_semi")
           .groupBy("person", "org").agg(F.sum("amt").alias("a")).groupBy("person").agg(F.max("a").alias("amt_c")))
    now = F.coalesce(F.col("amt_c").cast("double"), F.lit(0.0))
    was = F.col("amt_b").cast("double")
    level = F.when(now >= 0.8 * threshold, 1).when(now >= 0.4 * threshold, 2).otherwise(3)
    change = F.when(now >= 0.8 * was, 1).when(now >= 0.5 * was, 2).otherwise(3)
    return base.join(cur, "person", "left").groupBy(level.alias("level"), change.alias("change")).agg(_n().alias("n_persons"))


def survival(rec: DataFrame, b: int, last: int) -> DataFrame:
    """The base period's triples still alive in each later period; share and loss per period."""
    cohort = rec.where(_at(b)).select("person", "org", "unit")
    alive = (rec.where(F.col("mi").between(b, last)).join(cohort, ["person", "org", "unit"], "left_semi")
             .groupBy("mi", "person").agg(_n().alias("k")).groupBy("mi").agg(F.sum("k").alias("n_alive"), _n().alias("n_persons")))
    prev = alive.select((F.col("mi") + 1).alias("mi"), F.col("n_alive").alias("p"))
    start = alive.where(_at(b)).agg(F.max("n_alive")).scalar()
    return alive.join(prev, "mi", "left").select(
        "mi", "n_alive", "n_persons", fc.share(F.col("n_alive"), start).alias("share"), (F.col("p") - F.col("n_alive")).alias("lost"))


def org_status(rec: DataFrame, lines: DataFrame, b: int, c: int) -> DataFrame:
    """Per organisation: base and current recipients, any money now, agreements kept and new.

    The agreement of a payment line is column ``agreement``.
    """
    n = rec.where(_at(b) | _at(c)).groupBy("org").agg(F.count_if(_at(b)).alias("n_base"), F.count_if(_at(c)).alias("n_cur"))
    money = lines.where(_at(c)).groupBy("org").agg(F.sum("amt").alias("amt_now"))
    agr = two_periods(lines.where(F.col("agreement").isNotNull()), b, c, ("org", "agreement")).groupBy("org").agg(
        F.count_if("in_b").alias("agr_base"), F.count_if(F.col("in_b") & F.col("in_c")).alias("agr_kept"), F.count_if("in_c").alias("agr_cur"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return n.where("n_base > 0").join(money, "org", "left").join(agr, "org", "left").select(
        "org", "n_base", "n_cur", zero("amt_now"), zero("agr_base"), zero("agr_kept"), zero("agr_cur"))


def org_exit_class(status: DataFrame, moves: DataFrame, min_base: int = 10, mass: float = 0.5) -> DataFrame:
    """Did the organisation leave or its people: class of each organisation and state of its agreements."""
    lost = moves.where(F.col("side") == "lost").groupBy("org").agg(
        F.count_if(F.col("cause") == "left_bank").alias("left_bank"), F.count_if(F.col("cause") != "stayed_in_segment").alias("loss"))
    j = status.join(lost, "org", "left").fillna(0, ["left_bank", "loss"])
    stopped = (F.col("n_cur") == 0) & (F.col("amt_now") <= 0)
    massive = F.col("left_bank") >= mass * F.col("n_base")
    cls = (F.when(F.col("n_base") < min_base, "small").when(stopped & massive, "left_entirely")
           .when(stopped, "stopped_people_stayed").when(massive, "mass_exit").otherwise("individual"))
    agr = (F.when(F.col("agr_base") == 0, "no_data").when(stopped, "stopped").when(F.col("agr_kept") > 0, "same")
           .when(F.col("agr_cur") > 0, "changed").otherwise("stopped"))
    return j.select("org", cls.alias("cls"), agr.alias("agreements"), "n_base", "n_cur", "left_bank", "loss",
                    fc.share("left_bank", "n_base").alias("left_share"))


def org_exit_summary(classes: DataFrame, by: Sequence[str] = ("cls",)) -> DataFrame:
    total = classes.agg(F.sum("left_bank")).scalar()
    return classes.groupBy(*by).agg(_n().alias("n_orgs"), F.sum("n_base").alias("n_base"), F.sum("left_bank").alias("left_bank"),
                                    F.sum("loss").alias("loss")).withColumn("share_left", fc.share(F.col("left_bank"), total))
