"""Registry of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
#: Costly stages that several later ones read: worked out once per statement.
ONCE = frozenset({"summ", "coll", "sl", "kn", "cmpn"})


def cte(name: str, body: str, *needs: str) -> None:
    """A named SQL stage for the oracles; ``needs`` are the stages it reads."""
    CTES[name] = (needs, body)


def with_stages(needs: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in CTES[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS {'MATERIALIZED ' * (n in ONCE)}({CTES[n][1]})" for n in order]
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(parts + [body[15:]])
    if body[:5].upper() == "WITH ":
        body = body[5:]
        return "WITH " + ", ".join(parts + [body]) if parts else "WITH " + body
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Engine-neutral output types: bigint, rounded double, ISO date text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] | str = (), digits: int = 4):
    """Register ``fn(inputs) -> DataFrame`` under a name, with its SQL check."""
    needs = (needs,) if isinstance(needs, str) else tuple(needs)

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda inputs: plain(fn(inputs), digits)
        if oracle is not None:
            ORACLES[name] = with_stages(needs, oracle)
        return fn

    return deco
