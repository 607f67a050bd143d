"""Text rules as column expressions: ordered classification, note rules, checklists, deadlines, masking."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rule_words as rw
from .columns import _c

LETTERS = "А-ЯЁA-Z0-9"


# ------------------------------------------------------------ classification

def norm_name(text) -> Column:
    """Upper case, Ё as Е, quotes and punctuation to single spaces."""
    t = F.translate(F.upper(_c(text)), "Ё", "Е")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[\"'«»№.,()]+", " "), r"\s+", " "))


def whole_words(words: Sequence[str]) -> str:
    """Pattern of any of the words, not inside a longer one. Longer words are tried first."""
    body = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return f"(?<![{LETTERS}])(?:{body})(?![{LETTERS}])"


def stems(parts: Sequence[str]) -> str:
    return "|".join(re.escape(p) for p in parts)


def classify_by_rules(text: Column, rules: Sequence[tuple[str, str]], unknown: str = rw.UNCLASSIFIED, *,
                      override: Column | None = None, override_value: str = "", hint: Column | None = None,
                      hints: Mapping[str, str] | None = None) -> Column:
    """First matching (label, pattern) wins; an override goes before, a hint column after the name."""
    out = F.when(override if override is not None else F.lit(False), override_value)
    for label, pattern in rules:
        out = out.when(text.rlike(pattern), label)
    for value, label in (hints or {}).items():
        out = out.when(F.trim(hint) == value, label)
    return out.otherwise(unknown)


def agency(name, is_force=None, industry=None) -> Column:
    rules = [(label, whole_words(words)) for label, words in rw.AGENCY_WORDS]
    force = F.coalesce(_c(is_force), F.lit(False)) if is_force is not None else None
    return classify_by_rules(F.coalesce(norm_name(name), F.lit("")), rules, override=force, override_value=rw.AGENCY_WORDS[0][0],
                             hint=_c(industry) if industry is not None else None, hints=rw.AGENCY_HINTS if industry is not None else None)


def governance_level(name) -> Column:
    return classify_by_rules(F.coalesce(norm_name(name), F.lit("")), [(label, whole_words(words)) for label, words in rw.LEVEL_WORDS])


def rules_from_table(rules: DataFrame, limit: int = 1000) -> list[tuple[str, str]]:
    """A rule book (position, label, kind word/stem, words split by '|') as ordered patterns.

    The industry book and any other long book come in as a table; its size is checked.
    """
    from ..sources.scans import collect_guard
    rows = collect_guard(rules.orderBy("position"), limit)
    return [(r.label, whole_words(r.words.split("|")) if r.kind == "word" else stems(r.words.split("|"))) for r in rows.itertuples()]


def classification_coverage(df: DataFrame, col: str, unknown: str = rw.UNCLASSIFIED) -> DataFrame:
    known = F.count_if(F.col(col) != unknown)
    return df.agg(known.alias("n_known"), F.count(F.lit(1)).alias("n_total"), F.try_divide(known, F.count(F.lit(1))).alias("share"))


def code_kinds(codes: DataFrame, name: str = "name", advance: str = r"(?iu)аванс", salary: str = r"(?iu)^\s*(заработн|зарплат)") -> DataFrame:
    """Which payment codes are advances and which are salary, by their name."""
    n = F.coalesce(F.col(name), F.lit(""))
    return codes.withColumn("kind", F.when(n.rlike(advance), "adv").when(n.rlike(salary), "sal").otherwise("other"))


# ------------------------------------------------------------------- masking

_CYR = "А-Яа-яЁё"
# Marks of a personal name inside an organisation name.
PERSON_MARKS = (
    rf"(?iu)(?<![{_CYR}])(?:ИП|КФХ|ГКФХ|ИЧП|ЧП)(?![{_CYR}])",
    rf"(?iu)индивидуальн[{_CYR}]*\s+предпринимател",
    rf"(?iu)крестьянск[{_CYR}]*\s*\(?\s*фермерск",
    rf"(?iu)(?<![{_CYR}])глава(?![{_CYR}])",
    rf"(?iu)(?<![{_CYR}])(?:адвокат|нотариус)",
    rf"(?iu)[{_CYR}]+(?:ович|евич|ьич|овна|евна|ична|инична)(?![{_CYR}])",
    rf"(?iu)(?<![{_CYR}])(?:оглы|кызы|улы|уулу)(?![{_CYR}])",
    rf"(?<![{_CYR}])[А-ЯЁ]\.\s?[А-ЯЁ]\.",
)


def has_person_name(name, marks: Sequence[str] = PERSON_MARKS) -> Column:
    """One match for the marks that ignore case and one for the rest."""
    flag = "(?iu)"
    groups = ([m.removeprefix(flag) for m in marks if m.startswith(flag)], [m for m in marks if not m.startswith(flag)])
    hit = F.lit(False)
    for prefix, own in zip((flag, ""), groups):
        if own:
            hit = hit | _c(name).rlike(prefix + "|".join(f"(?:{m})" for m in own))
    return F.coalesce(hit, F.lit(False))


def mask_person_names(df: DataFrame, cols: Sequence[str], marks: Sequence[str] = PERSON_MARKS) -> DataFrame:
    """Names containing a personal name become NULL, beside a flag telling hidden from missing."""
    for c in cols:
        hidden = has_person_name(c, marks)
        clean = F.trim(F.col(c))
        df = df.withColumns({f"{c}_hidden": hidden, c: F.when(~hidden & (clean != ""), clean)})
    return df


def token_map(df: DataFrame, col: str, kind: str, placeholders: Sequence[str] = ()) -> DataFrame:
    """Every distinct name with its token KIND-01, KIND-02, …

    Numbers follow the order of md5(name): counts of 4,096 hash buckets give each bucket its offset,
    so numbering needs no global sort and no single task sees all names.
    """
    from pyspark.sql import Window as W
    name = F.trim(F.col(col))
    names = df.select(name.alias("name")).where((F.col("name") != "") & ~F.col("name").isin(list(placeholders))).distinct()
    h = names.withColumns({"h": F.md5("name"), "b": F.substring(F.md5("name"), 1, 3)})
    per = h.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    offset = per.select("b", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("b")) - F.col("n")).alias("before"))
    k = F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h"))
    return h.join(offset, "b").select("name", F.concat(F.lit(kind + "-"), F.when(k < 10, F.lpad(k.cast("string"), 2, "0")).otherwise(k.cast("string"))).alias("token"))


def mask_tokens(df: DataFrame, col: str, kind: str, placeholders: Sequence[str] = ()) -> DataFrame:
    tokens = token_map(df, col, kind, placeholders).withColumnRenamed("name", "_name")
    return (df.join(tokens, F.trim(F.col(col)) == F.col("_name"), "left")
            .withColumn(col, F.coalesce("token", F.trim(F.col(col)))).drop("_name", "token"))


def leak_check(texts: DataFrame, text_col: str, id_col: str, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Real names that occur as whole words in finished texts.

    Names are matched as word runs: a text yields its distinct runs of exactly the lengths the names
    have, so the check is an equi-join however many names there are. No names: no rows.
    """
    clean = lambda c: F.trim(F.regexp_replace(c, r"[^А-Яа-яЁёA-Za-z0-9]+", " "))
    book = names.select(F.col(name_col), clean(F.col(name_col)).alias("gram")).where("gram <> ''").distinct()
    # every length that a name has, as one array in a scalar subquery
    sizes = book.agg(F.array_sort(F.collect_set(F.size(F.split("gram", " "))))).scalar()
    t = texts.select(F.col(id_col), F.split(clean(F.col(text_col)), " ").alias("w"), sizes.alias("ks"))
    per = t.select(id_col, "w", F.explode("ks").alias("k")).where(F.size("w") >= F.col("k"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))
    grams = per.select(id_col, F.explode(F.array_distinct(runs)).alias("gram"))
    return grams.join(book, "gram").select(id_col, name_col).distinct()


# --------------------------------------------------------------------- notes

def norm_text(text) -> Column:
    t = F.lower(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "<br>", " "))
    t = F.regexp_replace(t, r"\s+", " ")
    return F.regexp_replace(t, r"^[ .;:!?]+|[ .;:!?]+$", "")


def meaningful(text, templates: Iterable[str] | None = None, min_length: int = rw.MIN_LENGTH) -> Column:
    """Reason for rejecting a note: empty, template, short; 'ok' when it says something."""
    n = norm_text(text)
    known = list((rw.TEMPLATES if templates is None else templates))
    return F.when(n == "", "empty").when(n.isin(known), "template").when(F.length(n) < min_length, "short").otherwise("ok")


def questionnaire(df: DataFrame, ids: Sequence[str], col: str, marker: str = r"(?m)^\s*\d+\.\s*") -> DataFrame:
    """Numbered checklist to rows: question (first line) and answer (the rest). The last answer of a repeated question counts."""
    def clean(c: Column) -> Column:
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    rows = df.select(*ids, F.posexplode(F.split(F.col(col), marker)).alias("pos", "chunk")).withColumn("chunk", clean(F.col("chunk"))).where("chunk <> ''")
    q, a = clean(F.split_part("chunk", F.lit("\n"), F.lit(1))), F.regexp_replace(F.col("chunk"), r"^[^\n]*\n?", "")
    return (rows.select(*ids, "pos", q.alias("question"), clean(a).alias("answer")).where("question <> ''")
            .groupBy(*ids, "question").agg(F.min("pos").alias("pos"), F.max_by("answer", "pos").alias("answer")))


def outflow_reason(qa: DataFrame, ids: Sequence[str], reasons: Mapping[str, tuple[str, str, str]] | None = None,
                   hints: Sequence[str] = rw.OUTFLOW_QUESTIONS, templates: Iterable[str] | None = None) -> DataFrame:
    """Reason of leaving from the checklist: first answered reason question; unknown reasons are flagged."""
    reasons = rw.OUTFLOW_REASONS if reasons is None else reasons
    spark = qa.sparkSession
    book = spark.createDataFrame([(k, *v) for k, v in reasons.items()], "ans string, reason string, action string, verdict string")
    ask = F.lit(False)
    for h in hints:
        ask = ask | F.contains(F.lower("question"), F.lit(h))
    ans = norm_text("answer")
    known = list(rw.TEMPLATES if templates is None else templates)
    hit = qa.where(ask).withColumn("ans", ans).where((F.col("ans") != "") & ~F.col("ans").isin(known))
    first = hit.groupBy(*ids).agg(F.min_by(F.struct("ans", "answer"), "pos").alias("f")).select(*ids, "f.ans", "f.answer")
    free = F.col("reason").isNull()
    return first.join(book, "ans", "left").select(
        *ids, F.coalesce("reason", "answer").alias("reason"), F.coalesce("action", F.lit("")).alias("action"),
        F.coalesce("verdict", F.lit("work")).alias("verdict"), free.alias("needs_review"))


def _hit(text: Column, pattern: str, negations: Sequence[str], window: int) -> Column:
    """First occurrence of the pattern without a negation cue just before it."""
    pos = F.regexp_instr(text, F.lit(pattern))
    left = F.substring(text, F.greatest(pos - window, F.lit(1)), F.least(pos - 1, F.lit(window)))
    negated = F.lit(False)
    for cue in negations:
        negated = negated | F.contains(left, F.lit(cue))
    return (pos > 0) & ~negated


def note_rule(text, rules=rw.KEYWORDS, negations: Sequence[str] = rw.NEGATIONS, window: int = rw.NEGATION_WINDOW) -> Column:
    """Struct (reason, action, verdict, needs_review) of the first rule that holds, else NULL."""
    n = norm_text(text)
    out: Column | None = None
    for patterns, reason, action, verdict, review in rules:
        ok = F.lit(False)
        for p in patterns:
            ok = ok | _hit(n, f"(?U){p}", negations, window)
        value = F.struct(F.lit(reason).alias("reason"), F.lit(action).alias("action"), F.lit(verdict).alias("verdict"), F.lit(review).alias("needs_review"))
        out = F.when(ok, value) if out is None else out.when(ok, value)
    return out


def reason_themes(df: DataFrame, rule_col: str, k: int = 4) -> DataFrame:
    """Most frequent reasons of a set of notes."""
    r = df.select(F.col(rule_col)["reason"].alias("reason")).where("reason is not null")
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def latest_deadline(text, ref_year, ref_month, stems_: Sequence[tuple[str, int]] = rw.MONTH_STEMS, quarter: str = r"(?:квартал|кв\b)") -> Column:
    """Latest month a text names, if later than the reference month; as MM.YYYY."""
    n, ry = norm_text(text), _c(ref_year)
    ref = ry * 12 + _c(ref_month)

    def year(raw: Column) -> Column:
        y = raw.try_cast("int")
        return F.when(y.isNull(), ry).when(y < 100, y + 2000).otherwise(y)

    def found(pattern: str, month: int | None, yr: int | None, by: int = 1) -> Column:
        whole = F.regexp_extract_all(n, F.lit(pattern), F.lit(0))
        return F.transform(whole, lambda m: (year(F.regexp_extract(m, pattern, yr)) if yr else ry) * 12 + F.regexp_extract(m, pattern, month).cast("int") * by)

    sep = r"[.\-/]"
    parts = [found(rf"(?U)\b\d{{1,2}}{sep}(0?[1-9]|1[0-2]){sep}(\d{{2,4}})\b", 1, 2), found(rf"(?U)\b(0?[1-9]|1[0-2]){sep}(\d{{4}})\b", 1, 2),
             found(rf"(?U)\b([1-4])\s*(?:-?\w{{0,2}})?\s*{quarter}", 1, None, 3)]
    names = "|".join(s for s, _ in stems_)
    spelled = rf"(?U)\b({names})\w*(?:\s+(\d{{4}})\s*г?)?"

    def named(m: Column) -> Column:
        mo: Column | None = None
        for s, num in stems_:
            c = m.rlike(f"^{s}")
            mo = F.when(c, num) if mo is None else mo.when(c, num)
        return year(F.regexp_extract(m, spelled, 2)) * 12 + mo

    parts.append(F.transform(F.regexp_extract_all(n, F.lit(spelled), F.lit(0)), named))
    latest = F.array_max(F.filter(F.concat(*parts), lambda v: v > ref))
    month = F.pmod(latest - 1, F.lit(12)) + 1
    return F.when(latest.isNotNull(), F.format_string("%02d.%d", month.cast("int"), ((latest - month) / 12).cast("int")))


# ---------------------------------------------------------------- area names

def area_names(df: DataFrame, code5: str, kind: str, subjects: DataFrame, districts: DataFrame, nested: Mapping[str, str] | None = None,
               no_area: str = "no territory", no_district: str = "no district") -> DataFrame:
    """Region and district of a five-digit code: nested areas by three digits, '000' is no district.

    ``subjects`` (code2, subject_name) and ``districts`` (code5, district_name) are plain dimensions.
    """
    c = F.col(code5)
    ok = F.length(c) == 5
    sub: Column | None = None
    for code, name in (nested or {}).items():
        cond = F.substring(c, 1, 3) == code
        sub = F.when(cond, name) if sub is None else sub.when(cond, name)
    plain = F.coalesce("subject_name", F.concat(F.lit("subject "), F.substring(c, 1, 2)))
    subject = F.when(~F.coalesce(ok, F.lit(False)), no_area).otherwise(plain if sub is None else F.coalesce(sub, plain))
    out = (df.join(subjects.select(F.col("code2").alias("_c2"), "subject_name"), F.substring(c, 1, 2) == F.col("_c2"), "left")
           .join(districts.select(F.col("code5").alias("_c5"), "district_name"), c == F.col("_c5"), "left")
           .withColumn("subject", subject))
    tail = F.when(c.endswith("000"), no_district).otherwise(F.coalesce("district_name", F.concat(F.lit(kind + " "), c)))
    dist = F.when(F.coalesce(ok, F.lit(False)), F.concat_ws(": ", F.col("subject"), tail)).otherwise(no_area)
    return out.withColumn("district", dist).drop("_c2", "_c5", "subject_name", "district_name")
