"""Text helpers: normalisation, slugs, product passages, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    return F.lower(F.trim(text))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def _sentence(prefix: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(prefix), value, F.lit(".")))


def product_text(name: Column, brand: Column, category: Column, parent: Column, tags: Column,
                 description: Column, ingredients: Column) -> Column:
    """One passage per product; missing parts are left out."""
    path = F.when(parent.isNotNull() & (parent != ""), F.concat(parent, F.lit(" > "), category)).otherwise(category)
    named = F.when(category.isNotNull() & (category != ""), path)
    parts = [
        name,
        _sentence("Brand: ", brand),
        _sentence("Category: ", named),
        _sentence("Tags: ", F.array_join(tags, ", ")),
        description,
        _sentence("Ingredients: ", ingredients),
    ]
    kept = [F.when(F.trim(p) != "", F.trim(p)) for p in parts]
    return F.concat_ws(" ", *kept)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
