"""Small helpers for functions that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cuts batches into small ones, so that Python objects of few texts exist at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def per_batch(df: DataFrame, columns: dict[str, str], fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """`fn` turns each small batch of the given columns (new name -> column) into columns of `schema`; no shuffle."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in slices(batches):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names)

    return df.select(*[F.col(_quoted(c)).alias(n) for n, c in columns.items()]).mapInArrow(run, schema)


def by_hash(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """About `rows` rows of `df` (all where it has fewer), the same ones on every run: those whose hash is below a limit."""
    share = min(1.0, rows / max(1, df.count()))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
