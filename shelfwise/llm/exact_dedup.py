"""Exact deduplication by content sort, in DataFrame operations only.

Rows are ordered by (first characters of the normalised text, its SHA-256, id). Splitters sampled from those keys cut the
order into ranges of even size; the id is part of the key, so a group of copies of any size is cut like anything else. Each
range is sorted (externally where it must be) and every row is compared in full with its neighbour before it; equal
neighbours form a run. A group cut by splitters consists of runs at the edges of ranges: only these, two per range at most,
are grouped once more by their full text. The row with the smallest id of a group stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.ranges import range_number
from shelfwise.sources.stage import stage

#: Ranges per shuffle partition, so that ranges dealt by hash still fill partitions evenly.
RANGES_PER_PARTITION = 4
#: Sampled keys per range: a bound on what comes to the driver, which holds no more than this many short keys per range.
SAMPLES_PER_RANGE = 20
_HEAD = 24


def normalised(text: Column) -> Column:
    """NULL counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _key(norm: Column, sha: Column, row_id: Column) -> Column:
    """Sort key as text. Ids are shifted to be positive and padded; a NULL id sorts after all others."""
    shifted = F.lpad((row_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.substring(norm, 1, _HEAD), F.lit("\x00"), sha, F.coalesce(shifted, F.lit("~")))


def _ranges(df: DataFrame, n: int) -> Column:
    """Number of the range that `_key` falls into, by n - 1 sampled splitters."""
    rows = df.count()
    wanted = n * SAMPLES_PER_RANGE
    sample = df if rows <= wanted else df.sample(fraction=min(1.0, 1.1 * wanted / rows), seed=7)
    norm = normalised(F.col("_text"))
    keys = sorted(r[0] for r in sample.select(_key(norm, F.sha2(norm, 256), F.col("_id"))).collect())
    splitters = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    return range_number(F.col("_key"), splitters, "string")


def mark_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept, text_sha256, and the columns in `carry` (none by default).

    Texts are equal when identical after `normalised`; NULL and empty texts are one group. `kept` is true for one row of a
    group, the first by id; of repeated rows with the same id and text one stays, and rows with NULL ids come last. keep_id
    is NULL only for a group of NULL ids. An empty table gives no rows. Ids are integers. Other columns of any name may be
    present."""
    spark = df.sparkSession
    carry = list(carry or [])
    rows = df.select(F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = _ranges(rows.select("_id", "_text"), partitions * RANGES_PER_PARTITION)
    norm = normalised(F.col("_text"))
    dealt = (rows.withColumn("_norm", norm).withColumn("_key", _key(F.col("_norm"), F.sha2("_norm", 256), F.col("_id"))).withColumn("_bucket", bucket)
             .drop("_norm", "_key").repartition(partitions, "_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_key", "_norm")
    runs = (dealt.withColumn("_norm", norm).withColumn("_sha", F.sha2("_norm", 256)).withColumn("_key", _key(F.col("_norm"), F.col("_sha"), F.col("_id")))
            .withColumn("_before", F.lag("_norm").over(order)).withColumn("_last", F.lead("_bucket").over(order).isNull())
            .withColumn("_new", F.col("_before").isNull() | (F.col("_before") != F.col("_norm")))
            .withColumn("_run", F.sum(F.col("_new").cast("bigint")).over(order))
            .withColumn("_head", F.last(F.when(F.col("_new"), F.struct("_id")), ignorenulls=True).over(order)["_id"])
            .withColumn("_edge", F.when(F.col("_before").isNull() | F.col("_last"), F.col("_norm"))))
    # A row that starts its run may stay; whether it does is known once cut groups are put together.
    runs = stage(runs.select("_id", "_bucket", "_run", "_head", "_new", "_sha", "_edge", *[f"_c{i}" for i in range(len(carry))]), "content_runs")
    sizes = runs.groupBy("_bucket", "_run").agg(F.count(F.lit(1)).alias("_n"), F.first("_head").alias("_h"))
    edges = runs.where("_edge IS NOT NULL").select("_bucket", "_run", "_edge").distinct().join(sizes, ["_bucket", "_run"])
    # Rows of `cut`: at most two per range, without texts; the number of ranges is a setting and not the size of the data.
    groups = edges.groupBy("_edge").agg(F.min("_h").alias("_keep"), F.sum("_n").alias("_size"), F.min(F.struct("_bucket", "_run")).alias("_first")).where(F.col("_first").isNotNull())
    cut = edges.join(groups, "_edge").select("_bucket", "_run", "_keep", "_size", (F.struct("_bucket", "_run") == F.col("_first")).alias("_leads"))
    run_size = F.count(F.lit(1)).over(Window.partitionBy("_bucket", "_run"))
    out = runs.withColumn("_n", run_size).join(F.broadcast(cut), ["_bucket", "_run"], "left")
    spans = F.col("_size").isNotNull()
    return out.select(F.col("_id").alias(id_column), F.when(spans, F.col("_keep")).otherwise(F.col("_head")).alias("keep_id"),
                      F.coalesce("_size", "_n").alias("group_size"), (F.col("_new") & F.coalesce("_leads", F.lit(True))).alias("kept"),
                      F.col("_sha").alias("text_sha256"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def drop_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all its columns."""
    marked = mark_duplicates(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]), f"c{df.columns.index(id_column)}",
                             f"c{df.columns.index(text_column)}", [f"c{i}" for i in range(len(df.columns))])
    named = marked.where("kept")
    width = len(named.columns) - len(df.columns)
    return named.toDF(*[f"_{i}" for i in range(width)], *[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
