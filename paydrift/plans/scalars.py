"""Queries over the scalar and text functions, run on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import text as tx
from .registry import cte, query

cte("ord", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus, o_orderpriority, o_totalprice FROM orders")


def orders(i):
    return i.table("orders").withColumn("d", F.to_date("o_orderdate"))


@query("safe_org_id", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey * 1000 END AS org_id FROM orders""")
def _(i):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("ID"), F.col("o_custkey"))).otherwise((F.col("o_custkey") * 1000).cast("string"))
    return orders(i).select("o_orderkey", fc.safe_org_id(raw).alias("org_id"))


@query("restore_digits", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(length(CAST(o_custkey AS VARCHAR)), 5) AS INTEGER), '0') AS org FROM orders")
def _(i):
    return orders(i).select("o_orderkey", fc.restore_digits("o_custkey", F.lit(5)).alias("org"))


@query("pseudonym", "SELECT c_custkey, md5(concat_ws(':', c_custkey, c_nationkey, 'salt')) AS masked FROM customer")
def _(i):
    return i.table("customer").select("c_custkey", fc.pseudonym(["c_custkey", "c_nationkey"], "salt").alias("masked"))


@query("null_key_sentinel", "SELECT coalesce(nullif(c_nationkey, 3), -1)::BIGINT AS unit, count(*) AS n FROM customer GROUP BY 1")
def _(i):
    return i.table("customer").groupBy(fc.null_key_sentinel(F.nullif("c_nationkey", F.lit(3))).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query("split_code", """SELECT o_orderkey, CAST(o_custkey % 90 AS BIGINT) AS region, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS BIGINT) END AS unit FROM orders""")
def _(i):
    unit = F.when(F.col("o_orderkey") % 4 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string"))
    code = F.concat_ws("_", F.lpad((F.col("o_custkey") % 90).cast("string"), 3, "0"), unit, F.lit("001"))
    return orders(i).select("o_orderkey", fc.split_code(code, 1).alias("region"), fc.split_code(code, 2).alias("unit"))


@query("recode_unit", """SELECT c_custkey, CAST(CASE WHEN c_nationkey = 8 THEN 9038 WHEN c_custkey % 7 = 3 THEN 8557
 WHEN c_mktsegment = 'BUILDING' AND c_custkey % 7 = 5 THEN 8646 ELSE c_custkey % 7 END AS BIGINT) AS unit FROM customer""")
def _(i):
    u = F.col("c_custkey") % 7
    return i.table("customer").select("c_custkey", fc.recode(u, [
        (F.col("c_nationkey") == 8, 9038), (u == 3, 8557), ((F.col("c_mktsegment") == "BUILDING") & (u == 5), 8646)]).alias("unit"))


@query("normalise_segment", """SELECT CASE WHEN c_mktsegment = 'BUILDING' OR c_custkey % 11 = 0 THEN 'not set' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'AUTO'
 WHEN c_mktsegment = 'HOUSEHOLD' THEN 'HOME' ELSE c_mktsegment END AS seg, count(*) AS n FROM customer GROUP BY 1""")
def _(i):
    raw = F.when(F.col("c_mktsegment") == "BUILDING", "  ").when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment"))
    return i.table("customer").groupBy(fc.normalise_name(raw, {"AUTOMOBILE": "AUTO", "HOUSEHOLD": "HOME"}, "not set").alias("seg")).agg(F.count(F.lit(1)).alias("n"))


@query("relevance", """SELECT o_orderkey FROM ord WHERE (((d >= DATE '1997-01-01' AND o_orderstatus = 'F' AND o_orderpriority <> '5-LOW')
 OR d BETWEEN DATE '1996-11-01' AND DATE '1996-12-31')) AND o_custkey NOT IN (0, 7)""", "ord")
def _(i):
    return orders(i).where(fc.relevance("d", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"), strict_from="1997-01-01",
                                        open_from="1996-11-01", main_kind="F", bad_flag="5-LOW", bad_orgs=["0", "7"])).select("o_orderkey")


@query("exclude_orgs", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2))")
def _(i):
    bad = i.table("customer").where(F.col("c_nationkey").isin(1, 2)).select(F.col("c_custkey").alias("o_custkey"))
    return i.table("orders").join(bad, "o_custkey", "left_anti").select("o_orderkey")


@query("exempt_orgs", "SELECT c_custkey AS org FROM customer WHERE c_nationkey = 5 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(i):
    c = i.table("customer").select(F.col("c_custkey").alias("org"), "c_nationkey", "c_mktsegment")
    return c.where("c_nationkey = 5").select("org").union(c.where("c_mktsegment = 'MACHINERY'").select("org")).distinct()


@query("month_arithmetic", """SELECT o_orderkey, strftime(last_day(d), '%Y-%m-%d') AS me, strftime(last_day(date_trunc('month', d) + INTERVAL 3 MONTH), '%Y-%m-%d') AS m3,
 strftime(last_day(date_trunc('month', d) - INTERVAL 12 MONTH), '%Y-%m-%d') AS m12, strftime(last_day(date_trunc('month', d) + INTERVAL 2 MONTH), '%Y-%m-%d') AS valid_to,
 CAST((year(d) - 1995) * 12 + month(d) - 1 AS BIGINT) AS diff FROM ord""", "ord")
def _(i):
    return orders(i).select("o_orderkey", fc.month_end("d").alias("me"), fc.month_shift("d", 3).alias("m3"), fc.month_shift("d", -12).alias("m12"),
                            fc.valid_to("d").alias("valid_to"), fc.month_diff("d", F.lit("1995-01-10").cast("date")).alias("diff"))


@query("plan_month", """WITH x AS (SELECT o_orderkey, d, o_orderkey % 14 AS n FROM ord), y AS (SELECT *, CASE WHEN n BETWEEN 1 AND 12 THEN (n - month(d) + 12) % 12 END AS o FROM x)
 SELECT o_orderkey, CAST(o AS BIGINT) AS off, CASE WHEN o <= 2 THEN strftime(last_day(date_trunc('month', d) + to_months(CAST(o AS INTEGER))), '%Y-%m-%d') END AS m FROM y""", "ord")
def _(i):
    n = (F.col("o_orderkey") % 14).cast("int")
    return orders(i).select("o_orderkey", fc.plan_month_offset(n, "d").alias("off"), fc.plan_month(n, "d").alias("m"))


@query("plan_month_rejected", """SELECT count(*) AS n_all, count(*) FILTER (WHERE n NOT BETWEEN 1 AND 12) AS n_bad_number,
 count(*) FILTER (WHERE n BETWEEN 1 AND 12 AND (n - month(d) + 12) % 12 > 2) AS n_far FROM (SELECT d, o_orderkey % 14 AS n FROM ord)""", "ord")
def _(i):
    off = fc.plan_month_offset((F.col("o_orderkey") % 14).cast("int"), "d")
    return orders(i).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(off.isNull()).alias("n_bad_number"), F.count_if(off > 2).alias("n_far"))


@query("month_window_index", """SELECT DISTINCT strftime(last_day(d), '%Y-%m-%d') AS period,
 (year(d) * 12 + month(d)) - (SELECT min(year(d) * 12 + month(d)) FROM ord) AS mi FROM ord""", "ord")
def _(i):
    p = orders(i).select(fc.month_end("d").alias("period")).distinct()
    return p.select("period", (fc.month_no("period") - p.agg(F.min(fc.month_no("period"))).scalar()).alias("mi"))


@query("month_time_left", """SELECT DISTINCT strftime(d, '%Y-%m-%d') AS d, round(least(greatest((date_diff('day', d, last_day(d)) + 1) / day(last_day(d)), 0), 1), 4) AS left_share FROM ord""", "ord")
def _(i):
    return orders(i).select("d", fc.month_time_left("d", fc.month_end("d")).alias("left_share")).distinct()


@query("shifted_window", """SELECT DISTINCT strftime(last_day(d), '%Y-%m-%d') AS period, strftime(date_trunc('month', d) - INTERVAL 1 MONTH + INTERVAL 15 DAY, '%Y-%m-%d') AS f,
 strftime(date_trunc('month', d) + INTERVAL 14 DAY, '%Y-%m-%d') AS t FROM ord""", "ord")
def _(i):
    f, t = fc.shifted_window("d")
    return orders(i).select(fc.month_end("d").alias("period"), f.alias("f"), t.alias("t")).distinct()


@query("early_pay_dates", """WITH p AS (SELECT DISTINCT last_day(d) AS period, last_day(d) + 1 AS nx FROM ord)
 SELECT strftime(period, '%Y-%m-%d') AS period, CASE WHEN isodow(nx) >= 6 THEN strftime(nx - CAST(isodow(nx) - 5 AS INTEGER), '%Y-%m-%d') END AS pay,
   CASE WHEN isodow(CAST(nx - INTERVAL 1 MONTH AS DATE)) < 6 THEN strftime(nx - INTERVAL 1 MONTH, '%Y-%m-%d') END AS ref1,
   CASE WHEN isodow(CAST(nx - INTERVAL 2 MONTH AS DATE)) < 6 THEN strftime(nx - INTERVAL 2 MONTH, '%Y-%m-%d') END AS ref2 FROM p""", "ord")
def _(i):
    return orders(i).select(fc.month_end("d").alias("period")).distinct().select(
        "period", fc.early_pay_date("period").alias("pay"), fc.early_pay_reference("period", 1).alias("ref1"), fc.early_pay_reference("period", 2).alias("ref2"))


_AREA = """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(code AS VARCHAR) || '001', 8, '0') ELSE lpad(CAST(code AS VARCHAR) || '001002', 11, '0') END AS full8
   FROM (SELECT c_custkey, c_nationkey * 1000 + c_custkey % 40 AS code FROM customer)), y AS (SELECT c_custkey, substr(full8, 1, 5) AS code5 FROM x)"""


def _codes(i):
    code = (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 40)
    raw = F.when(F.col("c_custkey") % 2 == 0, code * 1000 + 1).otherwise(code * 1000000 + 1002)
    # numbers of at most eight digits belong to the short code, longer ones to the long code
    long = F.col("c_custkey") % 2 == 1
    padded = F.when(long & (F.length(raw.cast("string")) <= 8), F.substring(F.lpad(raw.cast("string"), 11, "0"), 1, 5)).otherwise(fc.pad_area_code(raw))
    return i.table("customer").select("c_custkey", padded.alias("code5"))


@query("pad_area_code", _AREA + " SELECT c_custkey, code5 FROM y")
def _(i):
    return _codes(i)


@query("area_names", _AREA + """, d AS (SELECT lpad(CAST(s_nationkey * 1000 + s_suppkey % 40 AS VARCHAR), 5, '0') AS code5, min(s_name) AS dn FROM supplier GROUP BY 1),
 z AS (SELECT c_custkey, y.code5, dn, CASE WHEN substr(y.code5, 1, 3) = '010' THEN 'nested area' ELSE coalesce(n_name, 'subject ' || substr(y.code5, 1, 2)) END AS subject
   FROM y LEFT JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = substr(y.code5, 1, 2) AND n_nationkey <> 4 LEFT JOIN d ON d.code5 = y.code5)
 SELECT c_custkey, code5, subject, subject || ': ' || CASE WHEN code5 LIKE '%000' THEN 'no district' ELSE coalesce(dn, 'code ' || code5) END AS district FROM z""")
def _(i):
    sub = i.table("nation").where("n_nationkey <> 4").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code2"), F.col("n_name").alias("subject_name"))
    dist = (i.table("supplier").groupBy(F.lpad((F.col("s_nationkey") * 1000 + F.col("s_suppkey") % 40).cast("string"), 5, "0").alias("code5"))
            .agg(F.min("s_name").alias("district_name")))
    return tx.area_names(_codes(i), "code5", "code", sub, dist, {"010": "nested area"})


@query("json_attributes", """SELECT o_orderkey, '{"d":"' || strftime(d, '%Y-%m-%d') || '","amt":' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',"flag":'
 || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS j FROM ord""", "ord")
def _(i):
    return orders(i).select("o_orderkey", fc.json_attributes(d=F.col("d"), amt=F.floor("o_totalprice"),
                                                             flag=F.nullif("o_orderstatus", F.lit("F"))).alias("j"))


@query("bands", """SELECT CASE WHEN c_acctbal < 0 THEN '<0' WHEN c_acctbal < 1000 THEN '0-1k' WHEN c_acctbal < 5000 THEN '1-5k' ELSE '5k+' END AS b,
 CASE WHEN k < 1 THEN '0' WHEN k < 2 THEN '1' WHEN k < 6 THEN '2-5' WHEN k < 21 THEN '6-20' WHEN k < 101 THEN '21-100' ELSE '100+' END AS step, count(*) AS n
 FROM (SELECT c_acctbal, c_custkey % 150 AS k FROM customer) GROUP BY 1, 2""")
def _(i):
    return i.table("customer").groupBy(fc.band("c_acctbal", [(0, "<0"), (1000, "0-1k"), (5000, "1-5k")], "5k+").alias("b"),
                                       fc.band(F.col("c_custkey") % 150, *fc.STEP_BANDS).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("tri_state", "SELECT o_orderkey, CASE WHEN d < DATE '2000-01-01' THEN CAST(o_orderstatus = 'F' AS BIGINT) END AS flag FROM ord", "ord")
def _(i):
    return orders(i).select("o_orderkey", fc.tri_state(F.col("d") < "2000-01-01", F.col("o_orderstatus") == "F").alias("flag"))


@query("case_text", "SELECT o_orderkey, concat(o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN ' closed' END, ' by ', o_custkey) AS t FROM orders")
def _(i):
    return orders(i).select("o_orderkey", fc.case_text(F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", " closed"), F.lit(" by "), F.col("o_custkey").cast("string")).alias("t"))


@query("task_flags", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END, o_orderstatus <> 'F') AS in_progress,
 o_orderpriority ILIKE '%urgent%' AS overdue, o_totalprice > 300000 OR o_orderkey % 3 = 0 AS deal_expected,
 o_totalprice > 300000 AND d >= DATE '1998-01-01' AS fresh_deal FROM ord""", "ord")
def _(i):
    from ..operators.worklist import task_flags
    k = F.col("o_orderkey")
    t = orders(i).select("o_orderkey", F.when(k % 5 > 0, k % 5 == 1).alias("is_task_in_progress"), (F.col("o_orderstatus") == "F").alias("is_task_closed"),
                         F.col("o_orderpriority").alias("task_text_status"), F.when(F.col("o_totalprice") > 300000, 1).alias("plan_staff_deal_qty"),
                         F.when(k % 3 == 0, "D").alias("deal_code"), F.col("d").alias("deal_create_dttm"), F.lit(None).cast("string").alias("task_comment"),
                         F.lit(" ").alias("task_questionnaire"))
    return task_flags(t, "1998-01-01", "%urgent%").select("o_orderkey", "in_progress", "overdue", "deal_expected", "fresh_deal")


# --------------------------------------------------------------- text rules

_RULES = (("fasteners", ("BOLT", "SCREW", "NUT")), ("red goods", ("RED", "DARK RED")), ("small goods", ("SMALL", "TINY")))
_CLS = """SELECT p_partkey, CASE WHEN regexp_matches(x, '[^A-Z0-9](BOLT|SCREW|NUT)[^A-Z0-9]') THEN 'fasteners' WHEN regexp_matches(x, '[^A-Z0-9](DARK RED|RED)[^A-Z0-9]') THEN 'red goods'
 WHEN regexp_matches(x, '[^A-Z0-9](SMALL|TINY)[^A-Z0-9]') THEN 'small goods' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'unknown' END AS cls
 FROM (SELECT *, ' ' || upper(p_name) || ' ' AS x FROM part)"""


def _classified(i):
    cls = tx.classify_by_rules(tx.norm_name("p_name"), [(n, tx.whole_words(w)) for n, w in _RULES], "unknown", hint=F.col("p_type"), hints={"PROMO": "promo"})
    return i.table("part").select("p_partkey", cls.alias("cls"))


@query("classify_by_rules", _CLS)
def _(i):
    return _classified(i)


@query("classification_coverage", f"SELECT count(*) FILTER (WHERE cls <> 'unknown') AS n_known, count(*) AS n_total, round(count(*) FILTER (WHERE cls <> 'unknown') / count(*), 4) AS share FROM ({_CLS})")
def _(i):
    return tx.classification_coverage(_classified(i), "cls", "unknown")


@query("rule_book_on_parts", """WITH t AS (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS w FROM part),
 m AS (SELECT p_partkey, min(length(w)) AS n FROM part JOIN t ON CASE WHEN length(w) % 2 = 0 THEN list_contains(string_split(upper(p_name), ' '), w) ELSE contains(upper(p_name), w) END GROUP BY 1)
 SELECT p_partkey, coalesce('length ' || n, 'unknown') AS cls FROM part LEFT JOIN m USING (p_partkey)""")
def _(i):
    """A rule book that comes as a table: words of each length, whole or as stems, first rule wins."""
    n = F.length("w")
    words = i.table("part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("w")).where("w <> ''").distinct()
    book = words.groupBy(n.alias("position")).agg(F.concat_ws("|", F.sort_array(F.collect_set("w"))).alias("words")).select(
        "position", F.concat(F.lit("length "), F.col("position").cast("string")).alias("label"), F.when(F.col("position") % 2 == 0, "word").otherwise("stem").alias("kind"), "words")
    return i.table("part").select("p_partkey", tx.classify_by_rules(tx.norm_name("p_name"), tx.rules_from_table(book), "unknown").alias("cls"))


@query("code_kinds", """SELECT DISTINCT p_name AS name, CASE WHEN p_name ILIKE '%ring%' THEN 'adv' WHEN p_name ILIKE 'red%' THEN 'sal' ELSE 'other' END AS kind FROM part""")
def _(i):
    return tx.code_kinds(i.table("part").select(F.col("p_name").alias("name")).distinct(), advance="(?iu)ring", salary="(?iu)^red")


@query("mask_person_names", """SELECT p_partkey, CASE WHEN NOT regexp_matches(p_name, '(^|[^a-z])ring([^a-z]|$)') THEN p_name END AS p_name,
 regexp_matches(p_name, '(^|[^a-z])ring([^a-z]|$)') AS p_name_hidden FROM part""")
def _(i):
    return tx.mask_person_names(i.table("part").select("p_partkey", "p_name"), ["p_name"], ["(?iu)(?<![a-z])ring(?![a-z])"])


@query("mask_tokens", """WITH t AS (SELECT name, row_number() OVER (ORDER BY md5(name)) AS k FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name <> 'red bolt'))
 SELECT p_partkey, coalesce('PART-' || CASE WHEN k < 10 THEN '0' ELSE '' END || k, p_name) AS p_name FROM part LEFT JOIN t ON t.name = p_name""")
def _(i):
    return tx.mask_tokens(i.table("part").select("p_partkey", "p_name"), "p_name", "PART", ["red bolt"])


@query("leak_check", """WITH d AS (SELECT doc_id, ' ' || regexp_replace(text, '[^А-Яа-яЁёA-Za-z0-9]+', ' ', 'g') || ' ' AS t FROM documents),
 n AS (SELECT DISTINCT regexp_extract(regexp_replace(text, '[^А-Яа-яЁёA-Za-z0-9]+', ' ', 'g'), '^ ?([^ ]+( [^ ]+){0,2})', 1) AS name FROM benchmark)
 SELECT doc_id, name FROM d, n WHERE name <> '' AND contains(t, ' ' || name || ' ')""")
def _(i):
    names = i.table("benchmark").select(F.regexp_extract(F.regexp_replace("text", r"[^А-Яа-яЁёA-Za-z0-9]+", " "), "^ ?([^ ]+( [^ ]+){0,2})", 1).alias("name")).where("name <> ''").distinct()
    return tx.leak_check(i.table("documents"), "text", "doc_id", names)


_NORM = "regexp_replace(regexp_replace(lower(replace(coalesce(text, ''), '<br>', ' ')), '\\s+', ' ', 'g'), '^[ .;:!?]+|[ .;:!?]+$', '', 'g')"


@query("meaningful_text", f"""SELECT conv_id, turn, CASE WHEN n = '' THEN 'empty' WHEN n IN ('the', 'of the') THEN 'template' WHEN length(n) < 60 THEN 'short' ELSE 'ok' END AS verdict
 FROM (SELECT conv_id, turn, {_NORM} AS n FROM conversations)""")
def _(i):
    return i.table("conversations").select("conv_id", "turn", tx.meaningful("text", {"the": "", "of the": ""}, 60).alias("verdict"))


_QA = r"""SELECT doc_id, question, min(pos) AS pos, arg_max(answer, pos) AS answer FROM (
  SELECT doc_id, pos, regexp_replace(split_part(chunk, chr(10), 1), '^\s+|\s+$', '', 'g') AS question,
    CASE WHEN contains(chunk, chr(10)) THEN regexp_replace(substr(chunk, strpos(chunk, chr(10)) + 1), '^\s+|\s+$', '', 'g') ELSE '' END AS answer
  FROM (SELECT doc_id, pos, regexp_replace(chunk, '^\s+|\s+$', '', 'g') AS chunk FROM (
     SELECT doc_id, unnest(a) AS chunk, unnest(range(len(a))) AS pos FROM (SELECT doc_id, string_split(text, '. ') AS a FROM documents))) WHERE chunk <> '')
 WHERE question <> '' GROUP BY 1, 2"""


@query("parse_questionnaire", f"SELECT doc_id, md5(question) AS question, pos, md5(answer) AS answer FROM ({_QA})")
def _(i):
    qa = tx.questionnaire(i.table("documents"), ["doc_id"], "text", r"\. ")
    return qa.select("doc_id", F.md5("question").alias("question"), "pos", F.md5("answer").alias("answer"))


_BOOK = {"": ("r0", "a0", "work")}


@query("outflow_reason", f"""WITH q AS ({_QA}), h AS (SELECT doc_id, pos, answer, {_NORM.replace('text', 'answer')} AS ans FROM q WHERE contains(lower(question), 'the') OR contains(lower(question), 'le ')),
 f AS (SELECT doc_id, arg_min(ans, pos) AS ans, arg_min(answer, pos) AS answer FROM h WHERE ans <> '' GROUP BY 1)
 SELECT doc_id, md5(answer) AS reason, '' AS action, 'work' AS verdict, true AS needs_review FROM f""")
def _(i):
    qa = tx.questionnaire(i.table("documents"), ["doc_id"], "text", r"\. ")
    return tx.outflow_reason(qa, ["doc_id"], _BOOK, ("the", "le "), {}).withColumn("reason", F.md5("reason"))


# Rule words picked from the vocabulary of the texts.
_NOTE_RULES = ((("then", "ther"), "r1", "a1", "work", True), (("eaux",), "r2", "a2", "work", False), (("ing",), "r3", "a3", "no_point", False))
_NEG = ("the ", "of ")


def _note_case(col: str) -> str:
    def hit(p):
        return (f"(strpos(n, '{p}') > 0 AND NOT (" + " OR ".join(
            f"contains(substr(n, greatest(strpos(n, '{p}') - 26, 1), least(strpos(n, '{p}') - 1, 26)), '{c}')" for c in _NEG) + "))")
    return "CASE " + " ".join(f"WHEN {' OR '.join(hit(p) for p in ps)} THEN '{r if col == 'reason' else a if col == 'action' else v}'"
                              for ps, r, a, v, _ in _NOTE_RULES) + " END"


@query("note_rules", f"""SELECT doc_id, reason, {_note_case('action')} AS action, {_note_case('verdict')} AS verdict, reason = 'r1' AS needs_review
 FROM (SELECT *, {_note_case('reason')} AS reason FROM (SELECT doc_id, {_NORM} AS n FROM documents)) WHERE reason IS NOT NULL""")
def _(i):
    r = tx.note_rule("text", _NOTE_RULES, _NEG)
    return i.table("documents").select("doc_id", r.alias("r")).where("r is not null").select("doc_id", "r.*")


@query("reason_themes", f"SELECT reason, count(*) AS n FROM (SELECT {_note_case('reason')} AS reason FROM (SELECT {_NORM} AS n FROM documents)) WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 2")
def _(i):
    return tx.reason_themes(i.table("documents").select(tx.note_rule("text", _NOTE_RULES, _NEG).alias("r")), "r", 2)


@query("latest_deadline", """WITH x AS (SELECT o_orderkey, year(d) * 12 + month(d) AS a, CASE WHEN o_orderkey % 3 = 0 THEN 2000 * 12 + o_custkey % 12 + 1 END AS b,
  CASE WHEN o_orderkey % 5 = 0 THEN 1998 * 12 + (o_custkey % 4 + 1) * 3 END AS c, CASE WHEN o_orderkey % 7 = 0 THEN 1999 * 12 + 8 END AS e FROM ord),
 y AS (SELECT o_orderkey, list_max(list_filter([a, b, c, e], lambda v: v > 1998 * 12 + 6)) AS m FROM x)
 SELECT o_orderkey, lpad(CAST((m - 1) % 12 + 1 AS VARCHAR), 2, '0') || '.' || CAST((m - 1) // 12 AS VARCHAR) AS due FROM y WHERE m IS NOT NULL""", "ord")
def _(i):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    note = F.concat_ws(" ", F.lit("Paid"), F.date_format("d", "dd.MM.yyyy"), F.when(k % 3 == 0, F.concat(F.lit("next"), F.lit(" "), (u % 12 + 1).cast("string"), F.lit("/2000"))),
                       F.when(k % 5 == 0, F.concat(F.lit("or"), F.lit(" "), (u % 4 + 1).cast("string"), F.lit(" quarter"))), F.when(k % 7 == 0, F.lit("до августа 1999 г")))
    d = tx.latest_deadline(note, F.lit(1998), F.lit(6), quarter="quarter")
    return orders(i).select("o_orderkey", d.alias("due")).where("due is not null")


@query("agency_on_names", """SELECT o_orderkey % 5 AS k, count(*) AS n FROM orders GROUP BY 1""")
def _(i):
    named = F.element_at(F.array(*[F.lit(x) for x in ("МБОУ СОШ № 5", "ГБУЗ «ЦРБ»", "УМВД по району", "ООО Ромашка", "Администрация округа")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    code = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x in ("Образование", "Здравоохранение", "Силовые ведомства", tx.rw.UNCLASSIFIED, "Органы власти")]),
                                          F.array(*[F.lit(x) for x in range(5)])), tx.agency(named))
    return orders(i).groupBy(code.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("governance_level_on_names", "SELECT o_orderkey % 4 AS k, count(*) AS n FROM orders GROUP BY 1")
def _(i):
    named = F.element_at(F.array(*[F.lit(x) for x in ("ФГБОУ ВО Университет", "ГБУЗ «ЦРБ»", "МБОУ СОШ № 5", "ООО Ромашка")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    code = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x in ("Федеральное", "Региональное", "Муниципальное", "Коммерция")]),
                                          F.array(*[F.lit(x) for x in range(4)])), tx.governance_level(named))
    return orders(i).groupBy(code.alias("k")).agg(F.count(F.lit(1)).alias("n"))
