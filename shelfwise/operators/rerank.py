"""Deduplication and greedy diversity re-ranking, many lists per Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.params import Reranking


def deduplicate(candidates: DataFrame, key: str) -> DataFrame:
    """First occurrence of each product by position."""
    first = W.partitionBy(key, "product_id").orderBy("position")
    return candidates.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _padded(column: pa.ListArray, offsets: np.ndarray, width: int, fill, encode: bool) -> np.ndarray:
    flat = column.flatten()
    if encode:  # equal labels get equal codes, NULL gets -1
        codes = pc.fill_null(pc.dictionary_encode(flat).indices.cast(pa.int64()), -1)
        flat = codes
    values = flat.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.full((len(lengths), width), fill, dtype=np.float64 if not encode else np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(values)) - np.repeat(offsets[:-1], lengths)
    out[row, col] = values
    return out


def _greedy_orders(params: Reranking):
    """For each list, the order in which candidates are picked: at every step the largest score minus the
    penalty for categories and brands already picked, the earliest position winning ties. All lists of a batch
    advance together, one numpy step per pick."""

    def run(batches):
        for batch in batches:
            scores_col = batch.column(batch.schema.get_field_index("scores"))
            lengths = pc.list_value_length(scores_col).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            width = int(lengths.max()) if len(lengths) else 0
            score = _padded(scores_col, offsets, width, -np.inf, False)
            cat = _padded(batch.column(batch.schema.get_field_index("categories")), offsets, width, -1, True)
            brand = _padded(batch.column(batch.schema.get_field_index("brands")), offsets, width, -1, True)
            open_ = np.isfinite(score)
            cat_seen, brand_seen = np.zeros(score.shape), np.zeros(score.shape)
            picks = np.empty(score.shape, dtype=np.int32)
            rows = np.arange(score.shape[0])
            for step in range(width):
                penalty = params.diversity_strength * (cat_seen * params.category_repetition_penalty + brand_seen * params.brand_repetition_penalty)
                best = np.argmax(np.where(open_, score - penalty, -np.inf), axis=1)
                picks[:, step] = best
                open_[rows, best] = False
                c, b = cat[rows, best][:, None], brand[rows, best][:, None]
                cat_seen += (cat == c) & (c >= 0)
                brand_seen += (brand == b) & (b >= 0)
            within = np.arange(width)[None, :] < lengths[:, None]
            orders = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(picks[within] if width else np.array([], dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), orders], names=["key", "picks"])

    return run


def diversify(candidates: DataFrame, key: str, params: Reranking) -> DataFrame:
    """`candidates`: key, position, product_id, score, source, category_name, brand; lists are bounded by the
    pool size. Returns key, rank (from 1), product_id, score, source."""
    packed = candidates.groupBy(F.col(key).alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("position", "product_id", "score", "source", "category_name", "brand"))).alias("c"))
    lists = packed.select("key", F.col("c.score").alias("scores"), F.col("c.category_name").alias("categories"), F.col("c.brand").alias("brands"),
                          F.col("c.product_id").alias("ids"), F.col("c.source").alias("sources"))
    key_type = candidates.schema[key].dataType.simpleString()

    # the picks travel with the list, so no join is needed to put both together again
    def run(batches):
        def only(batch):
            return batch.select(["key", "scores", "categories", "brands"])
        for batch in batches:
            (done,) = list(_greedy_orders(params)(iter([only(batch)])))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in _positions(batch, ("key", "scores", "ids", "sources"))] + [done.column(1)],
                                             names=["key", "scores", "ids", "sources", "picks"])

    out = lists.mapInArrow(run, f"key {key_type}, scores array<double>, ids array<bigint>, sources array<string>, picks array<int>")
    ranked = out.select("key", "scores", "ids", "sources", F.posexplode("picks").alias("pos", "i"))
    return ranked.select(F.col("key").alias(key), (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("ids")[F.col("i")].alias("product_id"),
                         F.col("scores")[F.col("i")].alias("score"), F.col("sources")[F.col("i")].alias("source"))


def _positions(batch, names):
    return [batch.schema.get_field_index(n) for n in names]


def rerank(candidates: DataFrame, key: str, params: Reranking) -> DataFrame:
    return diversify(deduplicate(candidates, key), key, params)
