"""The watch as a cascade over levels: organisations, their rest in atoms, atoms, units and regions, segments and the whole.

Every level is scanned on what it is: organisations by their own totals, the rest of an atom without its tracked organisations,
atoms and larger places by everything in them. A place's signal is dropped when signals shown on lower levels explain it; a
signal carries a scope (segment, region, unit; null where it lies in several), and lies in a place when the place's scope
columns are equal. All of that is joins on scope columns and sums by place, never a loop over cards.

Inputs are two tables by month ``mi``: ``atoms`` (seg, region, unit) and ``org_cells`` (org, seg, region, unit), both with base,
the flows, temp_left, stopped, single_pay and raw_rows; ``orgs`` names each organisation's peers (org, grp, region).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage_table
from . import watch as wa

#: Flows and the sign with which they change the portfolio.
FLOWS = {"in_new": 1, "in_other": 1, "out_left": -1, "out_other": -1}
#: Flows by which people move between units of one organisation.
MOVES = ("out_other", "in_other")
CELL = ("seg", "region", "unit")
#: Scope columns that a place of each level fixes.
PLACES = {"atom": CELL, "unit": ("unit",), "region": ("region",), "seg": ("seg",), "whole": ()}
#: Levels of signals that can lie in a place of a level. Organisations and the rest are disjoint, the others overlap with them.
INSIDE = {"atom": ("org", "rest"), "unit": ("org", "rest", "atom"), "region": ("org", "rest", "atom", "unit"), "seg": ("org",), "whole": ("org",)}
#: Noises of a cell that its moves must pass, and by which a pair widens the opposite cell.
NOISES = 4.0
COVER_SHARE, STOP_SHARE, LABEL_SHARE = 0.7, 0.5, 0.5


def _sum(c: str) -> Column:
    return F.sum(c).alias(c)


# ------------------------------------------------------------------ moves between units of one organisation
def cell_deviations(org_cells: DataFrame, mi: int, hist: int = wa.HIST, noises: float = NOISES) -> DataFrame:
    """Each cell of the month with its moves' deviation from the median of its past months, and the noise of that.

    The past of a cell is at most ``hist`` rows, so its medians are taken over an array.
    """
    past = org_cells.where((F.col("mi") >= mi - hist) & (F.col("mi") < mi)).groupBy("org", *CELL).agg(*[F.collect_list(f).alias(f"h_{f}") for f in MOVES])
    x = org_cells.where(F.col("mi") == mi).select("org", *CELL, *MOVES).join(past, ["org", *CELL], "left")
    for f in MOVES:
        x = x.withColumn(f"m_{f}", wa._array_median(f"h_{f}")).withColumn(f"s_{f}", wa.MAD_SCALE * wa._array_median(F.transform(f"h_{f}", lambda v: F.abs(v - F.col(f"m_{f}")))))
        middle = F.coalesce(f"m_{f}", F.lit(0.0))
        x = x.withColumns({f"d_{f}": F.col(f) - middle, f"s_{f}": F.greatest(F.coalesce(f"s_{f}", F.lit(0.0)), F.sqrt(middle + 1))})
    return x.select("org", *CELL, *[F.col(f"d_{f}").alias(f) for f in MOVES], (F.col("d_out_other") - F.col("d_in_other")).alias("net"),
                    (noises * F.sqrt(F.pow("s_out_other", F.lit(2)) + F.pow("s_in_other", F.lit(2)))).alias("uncertainty"))


def unit_moves(org_cells: DataFrame, mi: int, people: float = wa.MIN_PEOPLE, matched: float = 0.6, hist: int = wa.HIST, noises: float = NOISES) -> DataFrame:
    """org, cell, flow, matched, explained: people who left one unit of an organisation for another of the same segment and region.

    Units that lost and units that gained are sorted by size and laid on one line, each as an interval of its cumulative sum; a
    pair matches by the length on which its intervals overlap, as a greedy pairing of the sorted lists does. A unit has one
    row, so it is never paired with itself. Every pair widens what it explains by the opposite cell's uncertainty, up to what
    was observed. Organisations whose matched moves are fewer than ``people`` are left out.
    """
    group = ["org", "seg", "region"]
    dev = cell_deviations(org_cells, mi, hist, noises)
    x = dev.where(F.abs("net") >= people + F.col("uncertainty")).withColumn("side", F.when(F.col("net") > 0, "out_other").otherwise("in_other")).withColumn("size", F.abs("net"))
    both = x.groupBy(*group).agg(*[F.coalesce(F.sum(F.when(F.col("side") == f, F.col("size"))), F.lit(0.0)).alias(f"t_{f}") for f in MOVES])
    low, high = F.least(*[f"t_{f}" for f in MOVES]), F.greatest(*[f"t_{f}" for f in MOVES])
    x = x.join(both.where((low > 0) & (low >= matched * high)).select(*group), group, "left_semi")
    line = W.partitionBy(*group, "side").orderBy(F.desc("size"), "unit").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("upto", F.sum("size").over(line)).withColumn("cell", F.struct("unit", "uncertainty"))
    ends = W.partitionBy(*group).orderBy("upto", "side", "unit")
    here = ends.rowsBetween(0, W.unboundedFollowing)
    pieces = x.select(*group, (F.col("upto") - F.coalesce(F.lag("upto").over(ends), F.lit(0.0))).alias("n"),
                      *[F.first(F.when(F.col("side") == f, F.col("cell")), ignorenulls=True).over(here).alias(f) for f in MOVES])
    pieces = pieces.where("n > 0 and out_other is not null and in_other is not null")
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("flow"), F.col(f"{a}.unit").alias("unit"), F.col(f"{b}.uncertainty").alias("more")) for a, b in (MOVES, MOVES[::-1])]))
    parts = pieces.withColumn("s", sides).groupBy(*group, "s.flow", "s.unit").agg(F.sum("n").alias("matched"), F.sum("s.more").alias("more"))
    seen = dev.select("org", *CELL, F.explode(F.array(*[F.struct(F.lit(f).alias("flow"), F.greatest(F.col(f), F.lit(0.0)).alias("seen")) for f in MOVES])).alias("o")).select("org", *CELL, "o.*")
    out = parts.join(seen, [*group, "unit", "flow"]).select("org", *CELL, "flow", "matched", F.least("seen", F.col("matched") + F.col("more")).alias("explained"))
    large = out.where("flow = 'out_other'").groupBy("org").agg(F.sum("explained").alias("n")).where(F.col("n") >= people)
    return out.join(large, "org", "left_semi")


# ------------------------------------------------------------------ scopes and cover
def org_scopes(org_cells: DataFrame, mi: int) -> DataFrame:
    """Where an organisation lies this month and the month before (null: in several places), and whether people were away."""
    def one(c: str, m: int) -> Column:
        here = F.when(F.col("mi") == m, F.col(c))
        return F.when(F.min(here) == F.max(here), F.min(here))

    away = F.coalesce(F.sum(F.when(F.col("mi") == mi - 1, F.col("temp_left"))), F.lit(0)) > 0
    return org_cells.where(F.col("mi").isin(mi - 1, mi)).groupBy("org").agg(*[one(c, mi).alias(c) for c in CELL], *[one(c, mi - 1).alias(f"was_{c}") for c in CELL], away.alias("returns"))


def explained(parents: DataFrame, level: str, cards: DataFrame, moves: DataFrame, scopes: DataFrame) -> DataFrame:
    """key, flow, amount: how much of each parent the signals inside it explain, in its direction.

    A signal counts where its whole scope lies in the parent; moves between units count by the cells that lie in it. One key
    counts once, with its largest amount. Levels overlap, so the largest of their sums counts, where organisations and the
    rest, which are disjoint, are one sum. For people who came anew after an absence, last month's scope must lie there too.
    """
    place = list(PLACES[level])
    rows = cards.where(F.col("level").isin(*INSIDE[level])).select(F.col("level").alias("kind"), F.col("key").alias("child"), "flow", "d", *CELL, *[f"was_{c}" for c in CELL], "returns")
    total = moves.groupBy("org", "flow").agg(F.sum("explained").alias("d")).join(scopes, "org")
    rows = rows.unionByName(total.select(F.lit("org").alias("kind"), F.col("org").cast("string").alias("child"), "flow", "d", *CELL, *[f"was_{c}" for c in CELL], "returns"))
    still = F.lit(True)
    for c in place:
        still = still & F.coalesce(F.col(f"was_{c}") == F.col(c), F.lit(False))
    rows = rows.where((F.col("kind") != "org") | (F.col("flow") != "in_new") | ~F.col("returns") | still).select("kind", "child", "flow", "d", *place)
    local = moves.groupBy("org", "flow", *place).agg(F.sum("explained").alias("d")).select(F.lit("org").alias("kind"), F.col("org").cast("string").alias("child"), "flow", "d", *place)
    rows = rows.unionByName(local).withColumn("sign", F.signum("d")).where("sign <> 0")
    own = parents.select("key", "flow", F.signum("d").alias("sign"), *place)
    found = own.join(rows, ["flow", "sign", *place]).groupBy("key", "flow", "kind", "child").agg(F.max(F.abs("d")).alias("d"))
    by_kind = found.groupBy("key", "flow", "kind").agg(F.sum("d").alias("d"))
    group = F.when(F.col("kind").isin("org", "rest"), "disjoint").otherwise(F.col("kind"))
    return by_kind.groupBy("key", "flow", group.alias("kind")).agg(F.sum("d").alias("d")).groupBy("key", "flow").agg(F.max("d").alias("amount"))


def with_cover(parents: DataFrame, level: str, cards: DataFrame, moves: DataFrame, scopes: DataFrame, share: float = COVER_SHARE) -> DataFrame:
    """Parents with the explained amount, and whether it hides them: ``share`` of the deviation, and less than ``floor`` of the score left."""
    j = parents.join(explained(parents, level, cards, moves, scopes), ["key", "flow"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    return j.withColumn("covered", (F.col("amount") >= share * F.abs("d")) & (F.col("score") - F.col("amount") < F.col("floor")))


# ------------------------------------------------------------------ the cascade
def kept(fn: Callable[[Cascade], DataFrame]) -> cached_property:
    """A table of the cascade that later levels read: worked out when it is first asked for, then read back."""
    return cached_property(lambda self: self.keep(fn.__name__, lambda: fn(self)))


def _stages() -> Callable[[str, Callable[[], DataFrame]], DataFrame]:
    run = f"cascade-{uuid4().hex}"
    return lambda name, build: stage_table(build(), f"{run}/{name}")


@dataclass
class Cascade:
    """One month of the watch. ``z`` holds the limits of organisations, rests and atoms; ``place_z`` those of larger places.

    Levels and scans that others read are written once by ``keep``, to the shared folder unless the caller has a place of its
    own: asking for a level runs the jobs of those before it.
    """

    atoms: DataFrame
    org_cells: DataFrame
    orgs: DataFrame
    mi: int
    flows: Sequence[str] = tuple(FLOWS)
    z: float = 4.0
    place_z: float = 4.0
    season_z: float = 4.0
    people: float = wa.MIN_PEOPLE
    share: float = wa.MIN_SHARE
    min_base: float = 5000
    min_mean: float = wa.MIN_NULL_MEAN
    cal_base: float = 5000
    cal_share: float = 0.6
    under_base: float = 1000
    under_z: float = 2.0
    under_share: float = 0.6
    rows_drop: float = 0.97
    noises: float = NOISES
    keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = field(default_factory=_stages)

    def floor(self, base: str = "base") -> Column:
        return wa.floor_of(F.col(base), self.people, self.share)

    # -------------------------------------------------- panels
    @kept
    def _common(self) -> DataFrame:
        return wa.calendar_months(self.atoms, self.cal_base, self.cal_share)

    def melted(self, pan: DataFrame) -> DataFrame:
        """A row for each key, flow and month; leavers without the calendar's part. Keys and peers are named with their flow."""
        value = {f: F.col(f).cast("double") - (wa.calendar_part() if f == "out_left" else 0) for f in self.flows}
        flows = F.explode(F.array(*[F.struct(F.lit(f).alias("flow"), v.alias("value")) for f, v in value.items()]))
        x = pan.join(self._common, "mi", "left").select("key", "grp", "region", "mi", "base", flows.alias("e"))
        return x.select(*[F.concat_ws("|", "e.flow", c).alias(c) for c in ("key", "grp")], "region", "mi", "base", "e.*")

    def scan(self, pan: DataFrame) -> DataFrame:
        """Expectation by peers, limits at ``z`` and excess of every key, flow and month."""
        x = wa.row_offset(wa.peer_expected(self.melted(pan), "value", self.min_base, within=["flow"]), "value")
        s = wa.log_count_interval(x, "value", self.z, min_mean=self.min_mean).where("supported")
        return s.select(F.substring_index("key", "|", 1).alias("flow"), F.expr("substring(key, instr(key, '|') + 1)").alias("key"), "mi", "base", "obs", "expected", "z", (F.col("obs") - F.col("expected")).alias("d"),
                        F.greatest(F.col("obs") - F.col("upper"), F.col("lower") - F.col("obs")).alias("score"), (F.greatest(F.col("upper") - F.col("expected"), F.col("expected") - F.col("lower")) / self.z).alias("sd"))

    def best(self, scan: DataFrame, level: str) -> DataFrame:
        """The month's signals of a level: the flow with the largest score of each key that passes the floor."""
        hit = scan.where(F.col("mi") == self.mi).withColumn("floor", self.floor()).where("score >= floor")
        return hit.groupBy("key").agg(F.max_by(F.struct("flow", "base", "obs", "expected", "d", "score", "floor"), F.struct("score", "flow")).alias("b")).select(F.lit(level).alias("level"), "key", "b.*")

    @cached_property
    def _sums(self) -> list[Column]:
        return [_sum(c) for c in ("base", *self.flows, "temp_left", "single_pay", "raw_rows")]

    @cached_property
    def atom_panel(self) -> DataFrame:
        return self.atoms.withColumns({"key": F.concat_ws("/", *[F.col(c).cast("string") for c in CELL]), "grp": F.col("seg")})

    @cached_property
    def rest_panel(self) -> DataFrame:
        """Atoms without their tracked organisations; a negative rest counts as none."""
        own = self.org_cells.groupBy(*CELL, "mi").agg(*[F.sum(c).alias(f"o_{c}") for c in ("base", *self.flows, "temp_left")])
        j = self.atom_panel.join(own, [*CELL, "mi"], "left")
        return j.withColumns({c: F.greatest(F.col(c) - F.coalesce(f"o_{c}", F.lit(0)), F.lit(0)) for c in ("base", *self.flows, "temp_left")})

    @cached_property
    def org_panel(self) -> DataFrame:
        return self.org_cells.groupBy("org", "mi").agg(*[_sum(c) for c in ("base", *self.flows, "temp_left", "stopped")]).join(self.orgs.select("org", "grp", "region"), "org").withColumn("key", F.col("org").cast("string"))

    # -------------------------------------------------- evidence
    @kept
    def moves(self) -> DataFrame:
        return unit_moves(self.org_cells, self.mi, self.people, noises=self.noises)

    @kept
    def scopes(self) -> DataFrame:
        return org_scopes(self.org_cells, self.mi)

    @kept
    def atom_scan(self) -> DataFrame:
        return self.scan(self.atom_panel)

    @kept
    def under(self) -> DataFrame:
        """Regions whose last load is incomplete."""
        scored = self.atom_scan.where("flow = 'out_left'").select("key", "mi", "base", "z")
        return wa.underload(scored, self.atom_panel, self.mi, self.under_base, self.under_z, self.under_share, self.rows_drop).select("region")

    def _named_under(self, cards: DataFrame) -> DataFrame:
        """Leavers in a region with an incomplete load are labelled so."""
        u = self.under.select("region", F.lit(True).alias("_u"))
        label = F.when(F.col("label").isNull() & (F.col("flow") == "out_left") & F.col("_u"), "underload").otherwise(F.col("label"))
        return cards.join(u, "region", "left").withColumn("label", label).drop("_u")

    # -------------------------------------------------- levels
    @kept
    def org_level(self) -> DataFrame:
        x = self.best(self.scan(self.org_panel), "org")
        stops = self.org_panel.where(F.col("mi") == self.mi).select("key", "stopped")
        amount = self.moves.groupBy(F.col("org").cast("string").alias("key"), "flow").agg(F.sum("explained").alias("moved"))
        x = x.join(stops, "key", "left").join(amount, ["key", "flow"], "left").withColumn("moved", F.coalesce("moved", F.lit(0.0)))
        recode = F.col("flow").isin(*MOVES) & (F.col("d") > 0) & (F.col("moved") >= COVER_SHARE * F.col("d")) & (F.col("score") - F.col("moved") < F.col("floor"))
        stop = (F.col("flow") == "out_left") & (F.col("d") > 0) & (F.coalesce("stopped", F.lit(0)) >= STOP_SHARE * F.col("d"))
        x = x.withColumn("label", F.when(recode, "recode").when(stop, "stop")).drop("stopped", "moved")
        return self._named_under(x.join(self.scopes.withColumn("key", F.col("org").cast("string")).drop("org"), "key", "left"))

    def _cell_cards(self, cards: DataFrame) -> DataFrame:
        cells = self.atom_panel.where(F.col("mi") == self.mi).select("key", *CELL)
        x = cards.join(cells, "key").withColumns({f"was_{c}": F.col(c) for c in CELL}).withColumns({"returns": F.lit(False), "label": F.lit(None).cast("string")})
        return self._named_under(x)

    @kept
    def rest_level(self) -> DataFrame:
        """Signals of what tracked organisations leave of an atom; the floor is that of the whole atom."""
        whole = self.atom_panel.where(F.col("mi") == self.mi).select("key", F.col("base").alias("whole"))
        return self._cell_cards(self.best(self.scan(self.rest_panel).join(whole, "key").withColumn("base", F.col("whole")).drop("whole"), "rest"))

    @kept
    def atom_signals(self) -> DataFrame:
        """Signals of whole atoms, with what organisations and rests explain of them."""
        return with_cover(self._cell_cards(self.best(self.atom_scan, "atom")), "atom", self.low_cards, self.moves, self.scopes)

    @cached_property
    def low_cards(self) -> DataFrame:
        return self.org_level.where("label is null or label <> 'recode'").unionByName(self.rest_level)

    @cached_property
    def atom_level(self) -> DataFrame:
        return self.atom_signals.where("not covered").drop("covered", "amount")

    def place_scores(self, level: str) -> DataFrame:
        """Sums of the atoms of each place: deviation, and noise from the atoms' or from the place's own past."""
        place = list(PLACES[level])
        cells = self.atom_panel.select("key", "mi", *place)
        x = self.atom_scan.where((F.col("mi") >= self.mi - wa.HIST) & (F.col("mi") <= self.mi)).join(cells, ["key", "mi"])
        m = x.groupBy(*place, "flow", "mi").agg(*[_sum(c) for c in ("d", "base", "obs", "expected")], F.sqrt(F.sum(F.pow("sd", F.lit(2)))).alias("sd"))
        past = F.collect_list(F.when(F.col("mi") < self.mi, F.col("d")))
        now = [F.max(F.when(F.col("mi") == self.mi, F.col(c))).alias(c) for c in ("d", "base", "obs", "expected", "sd")]
        p = m.groupBy(*place, "flow").agg(past.alias("r"), *now).where("d is not null").withColumn("middle", wa._array_median("r"))
        own = F.coalesce(wa.MAD_SCALE * wa._array_median(F.transform("r", lambda v: F.abs(v - F.col("middle")))), F.lit(0.0))
        p = p.withColumn("score", F.abs("d") - self.place_z * F.greatest("sd", own)).withColumn("floor", self.floor())
        return p.select(F.lit(level).alias("level"), F.concat_ws("/", *[F.col(c).cast("string") for c in place]).alias("key"), *place, "flow", "base", "obs", "expected", "d", "score", "floor")

    def place_signals(self, level: str, cards: DataFrame) -> DataFrame:
        return with_cover(self.place_scores(level).where("score >= floor"), level, cards, self.moves, self.scopes)

    def _place_cards(self, level: str, signals: DataFrame) -> DataFrame:
        """Kept signals of a place; its region is that of all its atoms, else null."""
        where = self.atom_panel.where(F.col("mi") == self.mi).groupBy(*PLACES[level]).agg(*[F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in CELL if c not in PLACES[level]])
        x = signals.where("not covered").drop("covered", "amount").join(where, list(PLACES[level]))
        x = x.withColumns({f"was_{c}": F.col(c) for c in CELL}).withColumns({"returns": F.lit(False), "label": F.lit(None).cast("string")})
        return self._named_under(x)

    @kept
    def unit_level(self) -> DataFrame:
        return self._place_cards("unit", self.place_signals("unit", self.low_cards.unionByName(self.atom_level)))

    @cached_property
    def region_level(self) -> DataFrame:
        return self._place_cards("region", self.place_signals("region", self.low_cards.unionByName(self.atom_level).unionByName(self.unit_level)))

    @cached_property
    def temporal_level(self) -> DataFrame:
        """Segments and the whole against the same month a year ago; labelled when moves or incomplete loads explain them."""
        x = None
        adjusted = self.atom_panel.join(self._common, "mi", "left").withColumn("out_left", F.col("out_left") - wa.calendar_part())
        for level in ("seg", "whole"):
            place = list(PLACES[level])
            for f in self.flows:
                s = wa.seasonal_rate(adjusted, f, self.mi, place, self.season_z, self.people, self.share).where("signal")
                s = s.select(F.lit(level).alias("level"), (F.col("seg") if place else F.lit("whole")).alias("key"), (F.col("seg") if place else F.lit(None).cast("string")).alias("seg"), F.lit(f).alias("flow"),
                             "base", F.col("obs").cast("double").alias("obs"), "expected", F.col("delta").alias("d"), F.col("excess").alias("score"), F.lit(float(self.people)).alias("floor"))
                x = s if x is None else x.unionByName(s)
        nothing = self.org_level.where("false")
        both = [with_cover(x.where(F.col("level") == level), level, nothing, self.moves, self.scopes) for level in ("seg", "whole")]
        late = self.atom_scan.where((F.col("mi") == self.mi) & (F.col("flow") == "out_left")).join(self.atom_panel.where(F.col("mi") == self.mi).select("key", *CELL), "key").join(self.under, "region", "left_semi")
        under = late.groupBy("seg").agg(F.sum("d").alias("late"))
        total = under.agg(F.sum("late").alias("late")).withColumn("level", F.lit("whole"))
        seg = both[0].join(under, "seg", "left")
        whole = both[1].join(total, "level", "left")
        label = F.when(F.col("covered"), "recode").when((F.col("flow") == "out_left") & (F.coalesce("late", F.lit(0.0)) >= LABEL_SHARE * F.abs("d")) & F.col("late").isNotNull(), "underload")
        return seg.unionByName(whole).withColumn("label", label).drop("late", "covered", "amount")

    CARD = ("level", "key", "flow", "base", "obs", "expected", "delta", "score", "label")

    def as_cards(self, signals: DataFrame) -> DataFrame:
        """Signals as they are shown: the deviation with the sign of its effect on the portfolio."""
        sign = F.create_map(*[x for f, s in FLOWS.items() for x in (F.lit(f), F.lit(s))])
        return signals.withColumn("delta", sign[F.col("flow")] * F.col("d")).select(*self.CARD)

    @property
    def underload_cards(self) -> DataFrame:
        return self.under.select(F.lit("region").alias("level"), F.col("region").cast("string").alias("key"), F.lit("out_left").alias("flow"),
                                 *[F.lit(None).cast("double").alias(c) for c in ("base", "obs", "expected")], F.lit(0.0).alias("delta"), F.lit(0.0).alias("score"), F.lit("underload").alias("label"))

    def cards(self) -> DataFrame:
        """All cards of the month; ``ranking.top_k`` by score gives the report's list."""
        out = None
        for x in (self.org_level, self.rest_level, self.atom_level, self.unit_level, self.region_level, self.temporal_level):
            c = self.as_cards(x).withColumns({n: F.col(n).cast("double") for n in ("base", "obs", "expected", "delta", "score")})
            out = c if out is None else out.unionByName(c)
        return out.unionByName(self.underload_cards)
