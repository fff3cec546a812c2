"""Query registry: a Spark callable per name and, where SQL can say it, the same in ANSI SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import OFF_GRID, fix

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def cte(name: str, body: str, columns: str = "") -> None:
    CTES[name] = (columns, body)


def fork(prefix: str, names: list[str], also: list[str] = ()) -> None:
    """Copies of common table expressions under prefixed names; references between them, and to those in
    ``also``, go to the prefixed ones."""
    known = re.compile(r"\b(" + "|".join([*names, *also]) + r")\b")
    for n in names:
        columns, body = CTES[n]
        cte(prefix + n, known.sub(lambda m: prefix + m[1], body), columns)


def full_sql(body: str) -> str:
    """Prefix a query with the common table expressions it mentions, in order."""
    order: list[str] = []

    def visit(text: str, seen: tuple = ()):
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in CTES and word not in order and word not in seen:
                visit(CTES[word][1], (*seen, word))
                if word not in order:
                    order.append(word)

    visit(body)
    if not order:
        return body
    parts = []
    for n in order:
        columns, text = CTES[n]
        kind = "" if columns else " MATERIALIZED"
        parts.append(f"{n}{columns} AS{kind} ({text})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def tidy(df: DataFrame, *names: str, digits: int = 6, nine=()) -> DataFrame:
    """Select result columns: doubles rounded to 6 places, integers as bigint.

    Values with exactly seven decimals (prices with slippage, percents of a round start
    equity) would sit on rounding ties, so the columns in ``nine`` keep 9 places."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def shape(n):
        t = types[n]
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return fix(n, 9 if n in nine else digits).alias(n)
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(n).cast("bigint").alias(n)
        if isinstance(t, T.ArrayType):
            el = lambda x: fix(x).cast("string") if isinstance(t.elementType, T.DoubleType) else x.cast("string")
            return F.array_join(F.transform(n, el), ",").alias(n)
        return F.col(n)

    return df.select(*[shape(n) for n in (names or df.columns)])


def r6(expr: str, name: str | None = None, digits: int = 6) -> str:
    off = OFF_GRID * 10.0 ** -digits
    return f"round(({expr})::DOUBLE + {off!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS {name or expr}"
