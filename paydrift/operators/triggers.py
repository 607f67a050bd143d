"""Task triggers: one row per (unit, org, trigger) with JSON attributes, monthly and weekly.

``metrics`` has unit, org, mi, fot_amt, fl_qty, np_cnt, new_fl_cnt, potential, share; ``month_ago`` is
counted from the end period.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc

PAIR = ("unit", "org")
# Trigger names and types.
NAMES = {
    "single_order": ("ЕПП флаг", "Вспомогательный"),
    "pay_below_peers": ("Ср чек ниже среднего", "Вспомогательный"),
    "negative_potential": ("Отрицательный потенциал", "Основной"),
    "first_credit": ("Кп первое зачисление", "Основной"),
    "seasonal_activity": ("Сезонный тип деятельности", "Основной"),
    "high_turnover": ("Высокая текучка", "Основной"),
    "agreement_no_credit": ("Есть договор нет зачисления", "Вспомогательный"),
    "contact_policy": ("Контактная политика 4 месяца", "Основной"),
    "apps_paper_1m": ("Бумажные заявления из ВСП или МП СБОЛ за прошлый месяц", "Вспомогательный"),
    "apps_electronic_1m": ("Электронные заявления из ВСП или МП СБОЛ за прошлый месяц", "Вспомогательный"),
    "apps_paper_3m": ("Бумажные заявления из ВСП или МП СБОЛ за последние три месяца", "Вспомогательный"),
    "apps_electronic_3m": ("Электронные заявления из ВСП или МП СБОЛ за последние три месяца", "Вспомогательный"),
    "outflow_1m": ("По клиенту был отток в прошлом месяце, численность", "Основной"),
    "outflow_3m": ("По клиенту был отток в последние три месяца", "Основной"),
    "share_over_90": ("Доля по клиенту больше 90%", "Вспомогательный"),
    "week_with_agreement": ("Заявление из ВСП с договором без зачислений", "Основной"),
    "week_no_agreement": ("Заявление из ВСП без договора и зачислений", "Основной"),
}


def _out(df: DataFrame, key: str | Column, **attrs: Column) -> DataFrame:
    if isinstance(key, str):
        name, kind = (F.lit(x) for x in NAMES[key])
    else:
        name = kind = None
        for k, (n, t) in NAMES.items():
            name = F.when(key == k, n) if name is None else name.when(key == k, n)
            kind = F.when(key == k, t) if kind is None else kind.when(key == k, t)
    return df.select(*PAIR, name.alias("trigger_name"), kind.alias("trigger_type"), fc.json_attributes(**attrs).alias("attributes"))


def _dec(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def stage_metrics(metrics: DataFrame, end: int, depth: int = 24) -> DataFrame:
    ago = F.lit(end) - F.col("mi")
    return metrics.withColumn("month_ago", ago).where(F.col("month_ago").between(0, depth - 1))


def single_order(base: DataFrame, month: str, flag_value: str) -> DataFrame:
    """Every row of the pair carries the single-payment-order flag."""
    g = base.where(F.col("unit").isNotNull()).groupBy("unit", fc.safe_org_id(F.col("org_text")).alias("org")).agg(
        F.bool_and(F.coalesce(F.col("flag") == flag_value, F.lit(False))).alias("all_flag"), F.sum("fl_count").alias("n"))
    return _out(g.where("all_flag and org is not null"), "single_order", month=F.lit(month), epp_cnt=F.col("n"))


def pay_below_peers(m: DataFrame, industry: DataFrame, month: str, limit: float = 0.8, months: int = 6) -> DataFrame:
    """Six-month pay per head at most 0.8 of the unit × industry average, both from sums.

    The peer sums are a second aggregation of the grouped clients, joined back by a small key.
    """
    c = (m.where(F.col("month_ago").between(0, months - 1) & (F.col("fl_qty") != 0)).join(industry, "org").groupBy("unit", "org", "industry")
         .agg(F.sum("fot_amt").alias("fot"), F.sum("fl_qty").alias("fl")))
    peers = c.groupBy("unit", "industry").agg(F.try_divide(F.sum("fot"), F.sum("fl").cast("decimal(20,0)")).alias("avg_salary"))
    j = c.join(peers, ["unit", "industry"]).withColumn("client_salary", F.try_divide(F.col("fot"), F.col("fl").cast("decimal(20,0)")))
    return _out(j.where(F.col("client_salary").cast("double") <= limit * F.col("avg_salary").cast("double")), "pay_below_peers", month=F.lit(month),
                avg_salary=_dec(F.col("avg_salary")), client_salary=_dec(F.col("client_salary")))


def negative_potential(m: DataFrame, month: str) -> DataFrame:
    return _out(m.where("month_ago = 0 and np_cnt > potential"), "negative_potential", month=F.lit(month), np_cnt=F.col("np_cnt"))


def first_credit(m: DataFrame, month: str) -> DataFrame:
    """Pays now, twelve rows with zero before."""
    now = F.col("month_ago") == 0
    g = m.where(F.col("month_ago").between(0, 12)).groupBy(*PAIR).agg(
        F.bool_or(now & (F.col("fot_amt") > 0)).alias("pays"), F.max(F.when(now, F.col("fl_qty"))).alias("fl"),
        F.count_if(F.col("month_ago").between(1, 12) & (F.col("fot_amt") == 0)).alias("zeros"))
    return _out(g.where("pays and zeros = 12"), "first_credit", month=F.lit(month), fl_cnt=F.col("fl"))


def seasonal_activity(m: DataFrame, month: str, growth: float = 0.1) -> DataFrame:
    """Growth of at least 10 % from month −11 to −10 and from −23 to −22."""
    at = {"y1b": 11, "y1": 10, "y2b": 23, "y2": 22}
    g = m.where(F.col("month_ago").isin(list(at.values()))).groupBy(*PAIR).agg(*[F.max(F.when(F.col("month_ago") == k, F.col("fl_qty"))).alias(n) for n, k in at.items()])

    def up(now: str, base: str) -> Column:
        return F.when(F.col(base) > 0, F.col(now) / F.col(base) - 1) >= growth
    return _out(g.where(up("y1", "y1b") & up("y2", "y2b")), "seasonal_activity", month=F.lit(month),
                fl_uplift=_dec(((F.col("y1") - F.col("y1b")) + (F.col("y2") - F.col("y2b"))) / 2))


def high_turnover(m: DataFrame, month: str) -> DataFrame:
    """Hires, yet the net gain is under a fifth of them and the stock fell: both months in one aggregation."""
    now, prev = F.col("month_ago") == 0, F.col("month_ago") == 1
    g = m.where(now | prev).groupBy(*PAIR).agg(*[F.max(F.when(now, F.col(c))).alias(c) for c in ("new_fl_cnt", "np_cnt", "fl_qty")], F.max(F.when(prev, F.col("fl_qty"))).alias("fl_prev"))
    hit = g.where("new_fl_cnt > 0 and np_cnt < 0.2 * new_fl_cnt and fl_qty < fl_prev")
    return _out(hit, "high_turnover", month=F.lit(month), nfl_cnt=F.col("new_fl_cnt"), np_cnt=F.col("np_cnt"), portf_last_m=F.col("fl_prev"), portf_cur_m=F.col("fl_qty"))


def agreement_no_credit(m: DataFrame, agreements: DataFrame, month: str, today, months: int = 6) -> DataFrame:
    """Six zero months and a live agreement at least six months old."""
    g = m.where(F.col("month_ago").between(0, months - 1)).groupBy(*PAIR).agg(F.bool_or(F.col("month_ago") == 0).alias("cur"), F.count_if(F.col("fot_amt") == 0).alias("zeros"))
    day = F.lit(today).cast("date")
    live = agreements.where(F.col("end_dt").isNull() | (F.col("end_dt") >= day)).groupBy("org").agg(F.min("start_dt").alias("start_dt")).where(F.col("start_dt") <= F.add_months(day, -months))
    return _out(g.where(F.col("cur") & (F.col("zeros") == months)).join(live, "org", "left_semi"), "agreement_no_credit", month=F.lit(month))


def contact_policy(m: DataFrame, tasks: DataFrame, start, months: int = 3) -> DataFrame:
    """No closed task by the role for three months, or never."""
    last = tasks.groupBy(*PAIR).agg(F.max("closed_at").alias("last"))
    j = m.where("month_ago = 0").select(*PAIR).join(last, list(PAIR), "left")
    old = F.col("last").isNull() | (F.col("last") < F.add_months(F.lit(start).cast("date"), -months))
    return _out(j.where(old), "contact_policy", task_close_date=F.date_format("last", "yyyy-MM-dd"))


def last_credit(enrolments: DataFrame, applications: DataFrame) -> DataFrame:
    """Latest salary credit of the persons who applied."""
    return enrolments.join(applications.select("person").distinct(), "person", "left_semi").groupBy("person").agg(F.max("day").alias("last_enrl"))


def application_pairs(apps: DataFrame, credits: DataFrame) -> DataFrame:
    """Applications by pair and kind: last month and last three months, with a credit after, first date."""
    one, paid = F.col("month_ago") == 0, F.coalesce(F.col("last_enrl") >= F.col("app_dt"), F.lit(False))
    return apps.join(credits, "person", "left").groupBy(*PAIR, "is_electronic").agg(
        F.count_if(one).alias("cnt_1m"), F.min(F.when(one, F.col("app_dt"))).alias("first_1m"), F.count_if(one & paid).alias("paid_1m"),
        F.count(F.lit(1)).alias("cnt_3m"), F.min("app_dt").alias("first_3m"), F.count_if(paid).alias("paid_3m"))


def application_triggers(pairs: DataFrame, month: str) -> DataFrame:
    kind = F.when(F.col("is_electronic"), "apps_electronic").otherwise("apps_paper")
    a = _out(pairs.where("cnt_1m > 0"), F.concat(kind, F.lit("_1m")), month=F.lit(month), app_cnt=F.col("cnt_1m"), app_with_zachisl_cnt=F.col("paid_1m"), first_app_date=F.col("first_1m"))
    b = _out(pairs, F.concat(kind, F.lit("_3m")), month=F.lit(month), app_cnt_3m=F.col("cnt_3m"), app_with_zachisl_cnt_3m=F.col("paid_3m"), first_app_date=F.col("first_3m"))
    return a.unionByName(b)


def _fell(min_outflow: int) -> Column:
    return (F.col("outflow_qty") >= min_outflow) & (F.col("payees") < F.col("prev_payees"))


def outflow_last_month(fact: DataFrame, end: int, month: str, min_outflow: int = 3) -> DataFrame:
    d = F.col("prev_payees") - F.col("payees")
    return _out(fact.where((F.col("mi") == end) & _fell(min_outflow)), "outflow_1m", month=F.lit(month), portf_last_m=F.col("prev_payees"), portf_cur_m=F.col("payees"),
                churn_cnt=d, churn_pct=_dec(fc.share(d, "prev_payees")))


def outflow_three_months(fact: DataFrame, end: int, month: str, min_outflow: int = 3) -> DataFrame:
    g = fact.where(F.col("mi").between(end - 2, end) & _fell(min_outflow)).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("mi") == end - 2, F.col("prev_payees"))).alias("was"), F.max(F.when(F.col("mi") == end, F.col("payees"))).alias("now"))
    return _out(g.where("n = 3"), "outflow_3m", month=F.lit(month), portf_3m_ago=F.col("was"), portf_cur_m=F.col("now"), churn_pct_3m=_dec(fc.share(F.col("was") - F.col("now"), "was")))


def share_over_90(m: DataFrame, month: str, limit: float = 0.9) -> DataFrame:
    return _out(m.where((F.col("month_ago") == 0) & (F.col("share") > limit)), "share_over_90", month=F.lit(month), fl_cnt=F.col("fl_qty"), fl_dolay=_dec(F.col("share")))


def weekly_applications(apps: DataFrame, agreements: DataFrame, credits: DataFrame, week_start, today) -> DataFrame:
    """Mon–Sun week: pairs with applications not followed by a credit, with or without an agreement."""
    first = F.date_trunc("week", F.lit(week_start).cast("timestamp")).cast("date")
    live = agreements.where(F.col("end_dt").isNull() | (F.col("end_dt") >= F.lit(today).cast("date"))).select("org").distinct().withColumn("agr", F.lit(True))
    paid = F.coalesce(F.col("last_enrl") >= F.col("app_dt"), F.lit(False))
    g = (apps.where(F.col("app_dt").between(first, F.date_add(first, 6))).join(live, "org", "left").join(credits, "person", "left").groupBy(*PAIR)
         .agg(F.coalesce(F.bool_or("agr"), F.lit(False)).alias("agr"), F.min("app_dt").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(paid).alias("k")).where("n > k"))
    return _out(g, F.when(F.col("agr"), "week_with_agreement").otherwise("week_no_agreement"), first_app_date=F.col("first"), app_cnt=F.col("n"),
                app_with_zachisl_cnt=F.col("k"), app_no_zachisl_cnt=F.col("n") - F.col("k"))


def union_triggers(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_triggers(parts: Sequence[DataFrame], gate: DataFrame, path: str, period: str, owner: str) -> DataFrame:
    """Gates, union, then replace this owner's rows of the period. Returns the mart.

    ``gate`` comes from ``source_gate``; a missing source, an empty stage or a repeated
    (unit, org, trigger) stops the run before the mart is touched.
    """
    from ..session import stage_table
    from ..sources import marts
    missing = marts.first_missing(gate).first()
    if missing:
        raise marts.GateError(f"no data in {missing['source']}; latest date {missing['last_date']}")
    stage = stage_table(union_triggers(parts), f"triggers/{owner}/{period}/{uuid4().hex}")
    marts.stage_gate(stage, [*PAIR, "trigger_name"])
    marts.mart_replace_period(stage, path, period, owner)
    return marts.read_mart(stage.sparkSession, path)
