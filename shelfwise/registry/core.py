"""Registration of queries and composition of their check SQL from shared CTEs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.registry.ctes import CTES
from shelfwise.sources import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BODIES: dict[str, Callable[[bindings.Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`; `ids` lists the inventory lines it covers."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, root: fn(bindings.load(spark, root))
        SURVEY_IDS[name] = ids
        BODIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql)
        return fn

    return wrap


def compose(body: str) -> str:
    """Prefix `body` with the CTEs it mentions, directly or through other CTEs."""
    needed: set[str] = set()

    def visit(text: str):
        for word in set(re.findall(r"\bx_\w+", text)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(body)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    if not parts:
        return body
    lead = re.match(r"\s*WITH\s", body)
    own = ",\n" + body[lead.end():] if lead else "\n" + body
    return "WITH RECURSIVE " + ",\n".join(parts) + own


def ts_text(column: Column | str) -> Column:
    """Timestamps leave a query as text, so both engines hash the same value."""
    column = F.col(column) if isinstance(column, str) else column
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def long(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("bigint")


def r(column: Column | str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits)
