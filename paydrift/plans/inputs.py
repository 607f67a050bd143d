"""Frames the registered queries read, all derived from the given tables.

``ledger`` reads the event table as a payment ledger (period = day, person = user, organisation =
event type); ``payroll`` reads line items as monthly payments (organisation = supplier region).
The SQL twins of these frames are the stages registered at the bottom.
"""

from __future__ import annotations

from functools import cached_property
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import triples as tr
from ..sources.scans import conform
from .registry import cte

THRESHOLD = 20
LAST = 29
CMP0 = 2
CURRENT_MI = 27
EXEMPT = "signup"
START = "2024-01-01"


_STAGED: dict[tuple[str, str], DataFrame] = {}


class Ledger:
    """Payment lines with their dimension and the stages every report starts from."""

    def __init__(self, lines: DataFrame, orgs: DataFrame, exempt: DataFrame, threshold: int = THRESHOLD):
        self.lines, self.orgs, self.exempt, self.threshold = lines, orgs, exempt, threshold

    @cached_property
    def triples(self) -> DataFrame:
        return tr.triple_state(tr.triples(self.lines, adv_codes=(0,), sal_codes=(1,)), self.threshold, self.exempt)

    @cached_property
    def recipients(self) -> DataFrame:
        return tr.recipients(self.triples, self.orgs)

    @cached_property
    def person_month(self) -> DataFrame:
        return tr.person_month(self.recipients)

    @cached_property
    def presence(self) -> DataFrame:
        return tr.presence(self.lines, self.recipients)


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def staged(self, name: str, build) -> DataFrame:
        """A stage several reports share: written once per session and input folder, then read.

        Long pipelines are cut here on purpose; the files lie in the shared folder, so a lost executor
        costs a read and not the lineage behind it.
        """
        from hashlib import md5

        from ..session import stage_table
        key = f"{md5(self.dir.encode()).hexdigest()[:12]}/{name}"
        done = (self.spark.sparkContext.applicationId, key)
        if done not in _STAGED:
            _STAGED[done] = stage_table(build(), key)
        return _STAGED[done]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ------------------------------------------------------------- ledger
    @cached_property
    def main(self) -> Ledger:
        return Ledger(self.lines, self.orgs, self.exempt)

    @cached_property
    def wide(self) -> Ledger:
        """The same ledger with many organisations: event type and a group of persons."""
        def widen(df: DataFrame, group: Column) -> DataFrame:
            return df.withColumn("org", F.concat_ws("-", "org", group.cast("string")))

        groups = F.explode(F.sequence(F.lit(0), F.lit(3)))
        return Ledger(widen(self.lines, F.floor(F.col("person") / 2) % 4),
                      widen(self.orgs.withColumn("g", groups), F.col("g")).drop("g"),
                      widen(self.exempt.withColumn("g", groups), F.col("g")).drop("g"))

    def __getattr__(self, name: str):
        if name in ("triples", "recipients", "person_month", "presence"):
            return getattr(self.main, name)
        raise AttributeError(name)

    @cached_property
    def lines(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        ev = self.table("events").select(
            F.to_date("ts").alias("day"), "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("amt"),
            k.alias("k"))
        return conform(ev, {
            "period": F.col("day"), "mi": F.datediff("day", F.lit(START).cast("date")),
            "person": F.col("user_id"), "org": F.col("event_type"),
            "unit": ((F.col("user_id") % 2) * 10 + F.col("k") % 2).cast("int"),
            "region": (F.col("user_id") % 2).cast("int"), "code": (F.col("k") % 5).cast("int"),
            "amt": F.col("amt"), "qty": F.lit(1),
        }).withColumns({"is_pf": F.col("code") <= 2, "is_fot": F.col("code") <= 3, "is_fixed": F.col("code") == 2})

    @cached_property
    def exempt(self) -> DataFrame:
        return self.table("events").where(F.col("event_type") == EXEMPT).select(F.col("event_type").alias("org")).distinct()

    @cached_property
    def orgs(self) -> DataFrame:
        """One row per organisation: segment, holding, focus flag, industry."""
        o = F.col("org")
        return self.table("events").select(F.col("event_type").alias("org")).distinct().select(
            o, F.when(o.isin("view", "click"), "retail").when(o == "purchase", "corp").otherwise("public").alias("seg"),
            F.when(o.isin("view", "click"), "H1").when(o.isin("purchase", "signup"), "H2").alias("hold"),
            o.isin("view", "error").alias("focus"),
            F.when(o.isin("view", "error"), "it").otherwise("trade").alias("industry"))

    @cached_property
    def seg_history(self) -> DataFrame:
        """Segment history of pairs by period, with holes, as a source would deliver it."""
        return (self.lines.where((F.col("mi") + F.col("unit")) % 7 != 0).select("mi", "org", "unit").distinct()
                .select("mi", "org", "unit", F.when(F.col("org") == "click", F.when(F.col("mi") < 15, "retail")
                        .otherwise("corp")).when(F.col("org") == "purchase", "corp").otherwise("public").alias("seg"))
                .where(F.col("org") != "error"))

    @cached_property
    def summary(self) -> DataFrame:
        """The published monthly summary: built once per session, checked, then read by every report."""
        from hashlib import md5

        from ..operators import summary as sm
        from ..session import shared_dir
        from ..sources import marts
        path = f"{shared_dir(self.spark)}/summary/{self.spark.sparkContext.applicationId}/{md5(self.dir.encode()).hexdigest()[:12]}"
        if marts.current_version(self.spark, path) is None:
            built = sm.build_summary(self.triples, self.orgs, self.seg_history, LAST, CMP0, CURRENT_MI, stage=f"summary-{uuid4().hex}")
            if not marts.mart_swap({"summary": built}, path, 1, lambda w: sm.identity_checks(w["summary"]).where("n_bad > 0").isEmpty()):
                raise marts.GateError("summary breaks an identity")
        return marts.read_current(self.spark, path, "summary")

    @cached_property
    def atoms(self) -> DataFrame:
        from ..operators import summary as sm
        return sm.generation(self.summary, 1).drop("lvl", "org", "run_id")

    # ------------------------------------------------------------ payroll
    @cached_property
    def payroll(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linestatus", "l_returnflag",
                                           F.to_date("l_shipdate").alias("day"),
                                           F.col("l_extendedprice").cast("decimal(18,2)").alias("amt"))
        # orders are hashed, a part of them in each task: lines are never sorted, and never sent whole to every task
        od = self.table("orders").select("o_orderkey", "o_custkey").hint("shuffle_hash")
        sup = self.table("supplier").select("s_suppkey", "s_nationkey")
        na = self.table("nation").select("n_nationkey", "n_regionkey")
        j = (li.join(od, li.l_orderkey == od.o_orderkey).join(sup, li.l_suppkey == sup.s_suppkey)
             .join(na, sup.s_nationkey == na.n_nationkey))
        return conform(j, {
            "period": F.last_day("day"), "day": F.col("day"),
            "mi": ((F.year("day") - 1995) * 12 + F.month("day") - 1).cast("int"),
            "person": F.col("o_custkey"), "org": F.col("n_regionkey").cast("int"),
            "unit": F.when(F.col("l_linestatus") == "O", 1).otherwise(0), "code": F.col("l_returnflag"),
            "amt": F.col("amt"), "part": F.col("l_partkey"),
        })

    @cached_property
    def payroll_by_person(self) -> DataFrame:
        """The payroll with all lines of a person in one partition: groupings and windows by person and more share its one shuffle."""
        return self.payroll.repartition("person")


# ------------------------------------------------------------------ SQL twins
cte("lines", """
 SELECT CAST(ts AS DATE) AS period, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS mi,
        user_id AS person, event_type AS org,
        CAST((user_id % 2) * 10 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS INTEGER) AS unit,
        CAST(user_id % 2 AS INTEGER) AS region,
        CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS code,
        CAST(value AS DECIMAL(18,2)) AS amt, 1 AS qty FROM events""")
cte("orgs", """
 SELECT DISTINCT event_type AS org,
   CASE WHEN event_type IN ('view','click') THEN 'retail' WHEN event_type = 'purchase' THEN 'corp' ELSE 'public' END AS seg,
   CASE WHEN event_type IN ('view','click') THEN 'H1' WHEN event_type IN ('purchase','signup') THEN 'H2' END AS hold,
   event_type IN ('view','error') AS focus,
   CASE WHEN event_type IN ('view','error') THEN 'it' ELSE 'trade' END AS industry
 FROM events""")
cte("lines_w", "SELECT * REPLACE (org || '-' || ((person // 2) % 4) AS org) FROM lines", "lines")
cte("orgs_w", "SELECT org || '-' || g AS org, seg, hold, focus, industry FROM orgs, range(4) r(g)", "orgs")
for w in ("", "_w"):
    cte("tri" + w, f"""
     SELECT *, CASE WHEN pos_fixed OR (pos_pf AND (org LIKE 'signup%' OR sum_pf > 20)) THEN 'P' WHEN pos_pf THEN 'Z' ELSE 'N' END AS st,
       CASE WHEN pos_fixed OR (pos_pf AND (org LIKE 'signup%' OR sum_pf > 20))
            THEN a_fixed + CASE WHEN org LIKE 'signup%' OR sum_pf > 20 THEN a_pf ELSE 0 END ELSE 0 END AS pf_amt,
       a_fixed + CASE WHEN org LIKE 'signup%' OR sum_fot > 20 THEN a_fot ELSE 0 END AS fot_amt
     FROM (SELECT mi, person, org, unit, min(region) AS region,
         sum(CASE WHEN code <= 2 THEN amt ELSE 0 END) AS sum_pf, sum(CASE WHEN code <= 3 THEN amt ELSE 0 END) AS sum_fot,
         bool_or(code <= 2 AND amt > 0) AS pos_pf, bool_or(code = 2 AND amt > 0) AS pos_fixed, bool_or(amt > 0) AS pos_any,
         sum(CASE WHEN amt > 0 AND code = 2 THEN amt ELSE 0 END) AS a_fixed,
         sum(CASE WHEN amt > 0 AND code IN (0,1) THEN amt ELSE 0 END) AS a_pf,
         sum(CASE WHEN amt > 0 AND code IN (0,1,3) THEN amt ELSE 0 END) AS a_fot,
         count(*) AS n_rows, CAST(sum(CASE WHEN amt > 0 THEN qty ELSE 0 END) AS BIGINT) AS n_pay,
         bool_or(code = 0) AS has_adv, bool_or(code = 1) AS has_sal
       FROM lines{w} GROUP BY 1, 2, 3, 4) WHERE pos_any""", "lines" + w)
    cte("rec" + w, f"""
     SELECT t.mi, t.person, t.org, t.unit, t.region, t.sum_pf, t.pf_amt, t.has_adv, t.has_sal, o.seg, o.hold, o.focus
     FROM tri{w} t LEFT JOIN orgs{w} o USING (org) WHERE st = 'P'""", "tri" + w, "orgs" + w)
    cte("pm" + w, f"""
     SELECT mi, person, count(DISTINCT org) AS n_org, count(*) AS n_triples,
       arg_min(seg, k) AS main_seg, arg_min(region, k) AS main_region, arg_min(org, k) AS main_org
     FROM (SELECT *, row_number() OVER (PARTITION BY mi, person ORDER BY sum_pf DESC, org, unit) AS k FROM rec{w})
     GROUP BY 1, 2""", "rec" + w)
    cte("presence" + w, f"""
     SELECT mi, person, sum(amt) AS amt_all, sum(CASE WHEN code <= 2 THEN amt ELSE 0 END) AS amt_codes
     FROM lines WHERE person IN (SELECT person FROM rec{w}) GROUP BY 1, 2""", "lines" + w, "rec" + w)
cte("seghist", """
 SELECT DISTINCT mi, org, unit, CASE WHEN org = 'click' THEN CASE WHEN mi < 15 THEN 'retail' ELSE 'corp' END
   WHEN org = 'purchase' THEN 'corp' ELSE 'public' END AS seg
 FROM lines WHERE (mi + unit) % 7 <> 0 AND org <> 'error'""", "lines")
cte("payroll", """
 SELECT CAST(last_day(CAST(l_shipdate AS DATE)) AS DATE) AS period, CAST(l_shipdate AS DATE) AS day,
   CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS mi, o_custkey AS person,
   n_regionkey AS org, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS unit, l_returnflag AS code,
   CAST(l_extendedprice AS DECIMAL(18,2)) AS amt, l_partkey AS part
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey""")
