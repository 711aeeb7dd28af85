"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes runs over the text. A chunk ends where the hash matches a mask: a strict one until the
chunk has the normal size and a lax one after it, so that sizes stay near the normal one; it ends in any case at the largest
size. Boundaries depend on nearby bytes only, so an insertion shifts the text but changes only the chunks around it. A
fingerprint is the set of chunk digests with their lengths; likeness of two is the length of their shared chunks over the
length of the smaller set (containment).
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import hashing
from shelfwise.llm.arrow import per_batch, slices, texts
from shelfwise.llm.ranges import range_number

SMALLEST, NORMAL, LARGEST = 32, 128, 512
_STRICT, _LAX = np.uint64(0x1FF << 40), np.uint64(0x1F << 40)
_GEAR = hashing.constants(256, 71)
_WIDTH = 32
_BLOCK = 1 << 20
#: Ranges of documents per shuffle partition when each is put next to its successor.
RANGES_PER_PARTITION = 4


def _marks(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions after which the strict and the lax mask match."""
    strict, lax = [], []
    for at in range(0, len(data), _BLOCK):
        lead = min(at, _WIDTH)
        h = _GEAR[data[at - lead:at + _BLOCK]]
        step = 1
        while step < _WIDTH:  # sums over windows of 2, 4, ... bytes
            h[step:] += h[:-step] << np.uint64(step)
            step *= 2
        h = h[lead:]
        hit = np.flatnonzero((h & _LAX) == 0)
        lax.append(hit + at + 1)
        strict.append(hit[(h[hit] & _STRICT) == 0] + at + 1)
    return np.concatenate(strict).tolist(), np.concatenate(lax).tolist()


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of some bytes."""
    if not len(data):
        return []
    strict, lax = _marks(data)
    out, start, n = [], 0, len(data)
    i = j = 0
    while n - start > SMALLEST:
        i = bisect_left(strict, start + SMALLEST, i)
        if i < len(strict) and strict[i] <= start + NORMAL:
            end = strict[i]
        else:
            j = bisect_left(lax, start + NORMAL + 1, j)
            end = min(lax[j] if j < len(lax) else n, start + LARGEST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_set(text: str) -> dict[int, int]:
    """Digest -> length of the distinct chunks of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.array(cuts(data), np.int64)
    starts = np.append(0, ends[:-1])[:len(ends)]
    digests = hashing.passages(data, starts, ends)
    return dict(zip((digests >> np.uint64(24)).tolist(), (ends - starts).tolist()))


def written(chunks: dict[int, int]) -> str:
    """Digest and length of each chunk in hexadecimal, by digest."""
    return " ".join(f"{d:010x}{n:03x}" for d, n in sorted(chunks.items()))


def read(fingerprint: str) -> dict[int, int]:
    return {int(x[:10], 16): int(x[10:], 16) for x in fingerprint.split()}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared length over the smaller length; 1 for two empty texts and 0 for one."""
    least = min(sum(a.values()), sum(b.values()))
    if not least:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    return min(1.0, sum(n for d, n in a.items() if d in b) / least)


def fingerprint(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) per row; NULL counts as empty, whose fingerprint is the empty string. No shuffle."""

    def run(batch):
        rows = texts(batch)
        return {"id": batch.column("id"), "n_chars": pa.array([len(t) for t in rows], "int64"), "fingerprint": [written(chunk_set(t)) for t in rows]}

    return per_batch(df, {"id": id_column, "text": text_column}, run, f"id {dict(df.dtypes)[id_column]}, n_chars bigint, fingerprint string").withColumnRenamed("id", id_column)


def edited(text: str, following: str) -> str:
    """`text` with its second half, rounded down, replaced by as many first characters of `following`, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _with_next(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (range, id, text, lead) in descending order of ids, dealt by range of id. Each range is closed by a copy of the first row of
    the next one (lead = true), and the last by that of the first, so no row needs another task."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("down", F.bitwise_not(F.col("id")))  # rises as ids fall
    points = rows.where("id IS NOT NULL").approxQuantile("down", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    number = range_number(F.col("down"), sorted({int(p) for p in points}), "bigint")
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), F.lit(n + 1)).otherwise(number)).drop("down")
    firsts = rows.groupBy("range").agg(F.max("id").alias("id")).collect()  # one id per range
    order = sorted(firsts, key=lambda r: r["range"])
    if not order:
        return rows.withColumn("lead", F.lit(False))
    before = [(order[i - 1]["range"], r["range"], r["id"]) for i, r in enumerate(order)]
    heads = spark.createDataFrame(before, "prior int, range int, id bigint")
    lead = rows.join(F.broadcast(heads), (heads["range"] == rows["range"]) & heads["id"].eqNullSafe(rows["id"]))
    lead = lead.groupBy(heads["prior"].alias("range")).agg(F.min(rows["text"]).alias("text")).select("range", F.lit(None).cast("bigint").alias("id"), "text", F.lit(True).alias("lead"))
    return rows.select("range", "id", "text", F.lit(False).alias("lead")).union(lead)


def compare_with_edited(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness to the edited text's),
    near_next (to the next document's). The next document is the one with the next smaller id, for the last the first;
    rows with the same id follow each other by their text, rows with NULL ids come last. A table of one row follows
    itself. NULL text counts as empty."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _with_next(df, id_column, text_column).repartition(n, "range").sortWithinPartitions("range", "lead", F.col("id").desc_nulls_last(), "text")

    def run(batches):
        held = None
        for batch in slices(batches):
            out = []
            for group, node, text, lead in zip(*[batch.column(c).to_pylist() for c in ("range", "id", "text", "lead")]):
                mine = chunk_set(text)
                if held is not None and held[0] == group:
                    _, doc, before, own = held
                    new = edited(before, text)
                    changed = chunk_set(new)
                    out.append((doc, len(before), sha256(new.encode()).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, mine)))
                held = None if lead else (group, node, text, mine)
            columns = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
