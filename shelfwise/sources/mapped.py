"""Canonical tables over a store with folders and column names of its own, by a declared mapping.

The second binding beside `bindings`: jobs take its `MappedTables` wherever they take `bindings.Tables`. Reads are lazy, with declared
schemas, so Spark reads only the columns a job uses.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources import bindings, snapshots

# The columns that jobs may use of each canonical table, and their types.
CANONICAL: dict[str, dict[str, str]] = {
    "categories": {"category_id": "bigint", "name": "string", "parent_id": "bigint"},
    "products": {"product_id": "bigint", "category_id": "bigint", "slug": "string", "name": "string", "description": "string", "brand": "string", "price": "double",
                 "sale_price": "double", "discount_percentage": "double", "stock_quantity": "int", "ingredients": "string", "is_active": "int"},
    "product_tags": {"product_id": "bigint", "tag_id": "bigint"},
    "tags": {"tag_id": "bigint", "name": "string"},
    "users": {"user_id": "bigint", "preferred_category_id": "bigint", "age_group": "string"},
    "events": {"event_id": "bigint", "user_id": "bigint", "product_id": "bigint", "action_type": "string", "action_time": "timestamp_ntz"},
    "orders": {"order_id": "bigint", "user_id": "bigint", "status": "string", "created_at": "timestamp_ntz"},
    "order_items": {"order_id": "bigint", "line": "int", "product_id": "bigint", "quantity": "double", "unit_price": "double"},
    "carts": {"cart_id": "bigint", "user_id": "bigint"},
    "cart_items": {"cart_id": "bigint", "product_id": "bigint", "quantity": "double"},
    "reviews": {"user_id": "bigint", "product_id": "bigint", "rating": "double", "created_at": "timestamp_ntz"},
    "embeddings": {"product_id": "bigint", "embedding": "array<float>"},
    "searches": {"event_id": "bigint", "user_id": "bigint", "matched_product_id": "bigint", "search_term": "string", "action_time": "timestamp_ntz"},
    "chatbot": {"user_id": "bigint", "summary": "string"},
    "user_turns": {"user_id": "bigint", "turn": "bigint", "text": "string"},
}


@dataclass(frozen=True)
class Stored:
    """Where a canonical table comes from: the folder below the root, its stored columns as DDL, what makes each canonical column
    (an SQL expression over stored ones; a column left out has its own name), and which rows count."""

    folder: str
    schema: str
    columns: Mapping[str, str] = field(default_factory=dict)
    where: str | None = None


def same_names(tables: tuple[str, ...] = tuple(CANONICAL)) -> dict[str, Stored]:
    """The mapping of a snapshot that was saved under canonical names."""
    return {name: Stored(name, ", ".join(f"{c} {kind}" for c, kind in CANONICAL[name].items())) for name in tables}


class UnboundTable(KeyError):
    """A job asked for a table that the store does not have."""


@dataclass(frozen=True)
class MappedTables:
    """The members of `bindings.Tables`, read from JSON folders as `snapshots.save` writes them.

    Rows that do not fit the stored schema fail the job, as do values that cannot become the canonical type; a NULL stays NULL, and an empty
    folder gives an empty table. Stored columns that the mapping does not name are not read."""

    spark: SparkSession
    root: str
    mapping: Mapping[str, Stored]

    def __post_init__(self):
        for name, stored in self.mapping.items():
            unknown = set(stored.columns) - set(CANONICAL.get(name, ()))
            if name not in CANONICAL or unknown:
                raise ValueError(f"the mapping names what no job knows: {name} {sorted(unknown)}")

    def table(self, name: str) -> DataFrame:
        if name not in self.mapping:
            raise UnboundTable(f"the store under {self.root} has no table for {name}")
        stored = self.mapping[name]
        rows = snapshots.read(self.spark, self.root, {stored.folder: stored.schema})[stored.folder]
        if stored.where:
            rows = rows.where(stored.where)
        return rows.select(*[F.expr(stored.columns.get(c, f"`{c}`")).cast(kind).alias(c) for c, kind in CANONICAL[name].items()])


def _member(name: str) -> cached_property:
    member = cached_property(lambda self: self.table(name))
    member.__set_name__(MappedTables, name)
    return member


for _name in CANONICAL:
    setattr(MappedTables, _name, _member(_name))


def load(spark: SparkSession, root: str, mapping: Mapping[str, Stored] | None = None) -> bindings.Tables | MappedTables:
    """The tables under `root`: the benchmark files, or with a mapping the store that it describes."""
    return bindings.load(spark, root) if mapping is None else MappedTables(spark, root.rstrip("/"), dict(mapping))
