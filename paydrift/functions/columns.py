"""Column expressions used by every job: ids, periods, bands, codes, three-valued flags.

Each function takes and returns ``Column`` objects, so all of it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = Column | str


def _c(x: ColLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- identifiers

def safe_org_id(text: ColLike, max_digits: int = 12) -> Column:
    """Digit-only text as bigint; anything else is NULL instead of a cast error."""
    t = _c(text)
    return F.when(t.rlike(rf"^[0-9]{{1,{max_digits}}}$"), t.try_cast("bigint"))


def restore_digits(org_id: ColLike, digits: ColLike) -> Column:
    """Numeric id back to text with the leading zeros it had in the source."""
    s = _c(org_id).cast("string")
    return F.lpad(s, F.greatest(F.length(s), _c(digits)), F.lit("0"))


def pseudonym(ids: Sequence[ColLike], salt: str) -> Column:
    """Stable masked key of one or several ids: the whole digest, so that two ids never share a key."""
    parts = [_c(i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts, F.lit(salt)))


def null_key_sentinel(key: ColLike, value: int = -1) -> Column:
    return F.coalesce(_c(key), F.lit(value))


def split_code(text: ColLike, part: int, sep: str = "_") -> Column:
    """Numeric part of a composite code; a missing or non-numeric part is NULL."""
    return F.split_part(_c(text), F.lit(sep), F.lit(part)).try_cast("int")


def pad_area_code(code: ColLike) -> Column:
    """Municipal code to its five-digit district: 8 or 11 significant places, zero padded."""
    s = _c(code).cast("string")
    width = F.when(F.length(s) > 8, 11).otherwise(8)
    return F.substring(F.lpad(s, width, F.lit("0")), 1, 5)


# --------------------------------------------------------------------- recode

def recode(value: ColLike, rules: Sequence[tuple[Column, object]]) -> Column:
    """Ordered recode: the first rule whose condition holds gives the value."""
    out: Column | None = None
    for condition, result in rules:
        new = result if isinstance(result, Column) else F.lit(result)
        out = F.when(condition, new) if out is None else out.when(condition, new)
    return _c(value) if out is None else out.otherwise(_c(value))


def normalise_name(name: ColLike, names: Mapping[str, str], blank: str, other: str | None = None) -> Column:
    """Long name to short name; blanks get their own label, unlisted names stay (or ``other``)."""
    t = F.trim(_c(name))
    out = F.when(t.isNull() | (t == ""), F.lit(blank))
    for long, short in names.items():
        out = out.when(t == long, F.lit(short))
    return out.otherwise(t if other is None else F.lit(other))


def relevance(day: ColLike, kind: ColLike, flag: ColLike, org: ColLike, *, strict_from: str, open_from: str,
              main_kind: str, bad_flag: str, bad_orgs: Sequence[str]) -> Column:
    """Row filter with effective dates: strict rules from one date, none in the open span before it."""
    d = _c(day)
    strict = (d >= F.lit(strict_from).cast("date"))
    open_span = d.between(F.lit(open_from).cast("date"), F.date_sub(F.lit(strict_from).cast("date"), 1))
    ok = ((strict & (_c(kind) == main_kind) & (_c(flag) != bad_flag)) | open_span) & ~_c(org).isin(*bad_orgs)
    return F.coalesce(ok, F.lit(False))


# -------------------------------------------------------------------- periods

def month_end(day: ColLike) -> Column:
    return F.last_day(_c(day))


def month_shift(day: ColLike, months: int | Column) -> Column:
    """Shift by whole months and stay on a month end."""
    return F.last_day(F.add_months(_c(day), months))


def valid_to(day: ColLike, months: int = 2) -> Column:
    """Last day an action of this date stays valid."""
    return month_shift(day, months)


def month_no(day: ColLike) -> Column:
    return F.year(_c(day)) * 12 + F.month(_c(day)) - 1


def month_diff(a: ColLike, b: ColLike) -> Column:
    return month_no(a) - month_no(b)


def plan_month(number: ColLike, created: ColLike, max_offset: int = 2) -> Column:
    """Month number without a year to the nearest month end at or after creation.

    Offsets above ``max_offset`` are refused (NULL); count them with ``plan_month_offset``.
    """
    off = plan_month_offset(number, created)
    return F.when(off <= max_offset, month_shift(created, off))


def plan_month_offset(number: ColLike, created: ColLike) -> Column:
    n = _c(number)
    return F.when(n.between(1, 12), F.pmod(n - F.month(_c(created)), F.lit(12)).cast("int"))


def month_time_left(today: ColLike, period: ColLike) -> Column:
    """Share of the month's calendar days not yet over; today counts as left."""
    total = F.dayofmonth(F.last_day(_c(period)))
    left = F.datediff(F.last_day(_c(period)), _c(today)) + 1
    return F.least(F.greatest(left / total, F.lit(0.0)), F.lit(1.0))


def shifted_window(period: ColLike, border_day: int = 15) -> tuple[Column, Column]:
    """The window from the day after ``border_day`` of the previous month to it in this month."""
    first = F.trunc(_c(period), "month")
    return (F.date_add(F.add_months(first, -1), border_day), F.date_add(first, border_day - 1))


def early_pay_date(period: ColLike) -> Column:
    """When the 1st after this month falls on a weekend: the last Friday before it, else NULL."""
    nxt = F.add_months(F.trunc(_c(period), "month"), 1)
    wd = F.weekday(nxt)
    return F.when(wd >= 5, F.date_sub(nxt, wd - 4))


def early_pay_reference(period: ColLike, back: int) -> Column:
    """An earlier month's 1st usable as a reference: only when it was a weekday."""
    day = F.add_months(F.trunc(_c(period), "month"), 1 - back)
    return F.when(F.weekday(day) < 5, day)


# --------------------------------------------------------------------- labels

def band(value: ColLike, edges: Sequence[tuple[float, str]], last: str) -> Column:
    """Ordered buckets: first upper bound (exclusive) above the value wins; NULL stays NULL."""
    v = _c(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for upper, label in edges:
        out = out.when(v < upper, label)
    return out.otherwise(last)


# Fixed bucket bounds.
PAY_BANDS = ([(30000, "<30k"), (60000, "30-60k"), (100000, "60-100k"), (200000, "100-200k")], "200k+")
STEP_BANDS = ([(1, "0"), (2, "1"), (6, "2-5"), (21, "6-20"), (101, "21-100")], "100+")
STOP_BANDS = ([(2, "1"), (3, "2"), (10, "3-9"), (50, "10-49")], "50+")
TENURE_BANDS = ([(1, "0"), (2, "1"), (4, "2-3"), (7, "4-6"), (13, "7-12"), (25, "13-24")], "25+")
SIZE_BANDS = ([(1, "0"), (10, "1-9"), (100, "10-99"), (1000, "100-999")], "1000+")


def tri_state(has_data: ColLike | bool, hit: Column) -> Column:
    """NULL when the neighbouring period is not loaded, else 0 or 1."""
    known = F.lit(has_data) if isinstance(has_data, bool) else _c(has_data)
    return F.when(known, F.coalesce(hit, F.lit(False)).cast("int"))


def payment_kind(has_adv: ColLike, has_sal: ColLike) -> Column:
    a, s = F.coalesce(_c(has_adv), F.lit(False)), F.coalesce(_c(has_sal), F.lit(False))
    return F.when(a & s, "both").when(s, "sal").when(a, "adv").otherwise("other")


def json_attributes(**named: Column) -> Column:
    """JSON object text; NULL values are kept as JSON nulls, dates as yyyy-MM-dd."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in named.items()]),
                     {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"})


def case_text(*parts: Column) -> Column:
    """Sentence of optional parts: missing ones are left out instead of voiding the text."""
    return F.concat_ws("", *parts)


def sum_known(value: ColLike, active: Column | None = None) -> Column:
    """Sum that is unknown as soon as one active row is unknown."""
    v = _c(value)
    act = F.lit(True) if active is None else active
    return F.when(F.count_if(v.isNull() & act) == 0, F.sum(v))


def share(part: ColLike, whole: ColLike) -> Column:
    return F.try_divide(_c(part).cast("double"), _c(whole).cast("double"))
