"""Nearest-item search as a blocked matrix product over Spark partitions.

Items are cut into blocks of bounded size, queries into chunks; a few blocks form a shelf, and every (shelf, chunk) pair is one
group. Its task multiplies one block after the other with slabs of its queries and keeps only the best k per query, so a query
travels once per shelf and not once per block, and its hits leave once per shelf. The lists of several shelves merge in a window that
Spark limits to k rows per query before its shuffle. Exact search sends a query to every block; cell search
(approximate) sends it to the blocks of the cells nearest to it; bounded search (exact) sends it to the blocks of those cells
that can hold one of its best k.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.vectors import checked
from shelfwise.params import RetrievalParams
from shelfwise.sources.stage import stage

_SUB = 1 << 20  # blocks of one cell are numbered cell * _SUB + part
_SLACK = 1e-7  # covers rounding of angles and scores in bounds
_SHELF_BLOCKS = 16  # blocks of one shelf
_GROUP_CHUNKS = 4  # query chunks that meet a shelf together
_SLAB = 1 << 21  # entries of a matrix of scores or angles held at a time


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-12, None)


def _slabs(rows: int, width: int):
    """Slices of `rows` rows, so that a matrix of `width` columns over one of them stays small."""
    step = max(1, _SLAB // max(1, width))
    return (slice(start, min(rows, start + step)) for start in range(0, rows, step))


def _best_rows(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Places of the k best entries of every row, by row and rank, and their ranks from 0; equal scores go to the lower id."""
    order = np.lexsort((ids, -scores, row))
    sorted_rows = row[order]
    start = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    keep = rank < k
    return order[keep], rank[keep]


def _without_copies(ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Items (ids ascend) without those that have k equal vectors before them: no list of k reaches these."""
    rows = np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * m.itemsize))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    places, _ = _best_rows(group, ids, np.zeros(len(ids)), k)
    places.sort()
    return ids[places], m[places]


class _Best:
    """The k best items so far of every query of a group; items come block by block.

    Scores in single precision pick the candidates, with room for their rounding; those that remain are scored in double
    precision, pair by pair, so that equal vectors have equal scores in any block."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.length = np.linalg.norm(q, axis=1)
        self.still = self.length == 0
        self.scaled = (q / np.where(self.still, 1.0, self.length)[:, None]).astype(np.float32)
        self.scores = np.full((len(q), k), -np.inf)
        self.ids = np.zeros((len(q), k), np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        """Offer the items (ids ascend) to the queries `rows`."""
        ids, m = _without_copies(ids, m, self.k)
        still = rows[self.still[rows]]  # equal to all items, so the first ones are the best
        self._merge(np.repeat(still, min(self.k, len(ids))), np.tile(ids[:self.k], len(still)), np.zeros(len(still) * min(self.k, len(ids))))
        rows = rows[~self.still[rows]]
        longest = np.linalg.norm(m, axis=1).max() or 1.0
        scaled = (m / longest).astype(np.float32).T
        room = np.float32((m.shape[1] + 8) * 2.0 ** -22)
        for part in _slabs(len(rows), len(ids)):
            at = rows[part]
            near = self.scaled[at] @ scaled
            least = (self.scores[at, -1] / (self.length[at] * longest)).astype(np.float32)
            open_ = np.flatnonzero(np.isneginf(least))
            if len(open_) and self.k < len(ids):
                least[open_] = np.partition(near[open_], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            # over one flat array: a matrix is searched for the few places that are left several times slower than it is multiplied
            row, col = np.divmod(np.flatnonzero((near >= (least - room)[:, None]).ravel()), len(ids))
            del near
            exact = np.empty(len(row))
            for few in _slabs(len(row), m.shape[1]):
                exact[few] = np.einsum("ij,ij->i", self.q[at[row[few]]], m[col[few]])
            row = at[row]
            keep = exact >= self.scores[row, -1]
            self._merge(row[keep], ids[col[keep]], exact[keep])

    def _merge(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        held = np.repeat(touched, self.k)
        row, ids = np.concatenate([held, row]), np.concatenate([self.ids[touched].ravel(), ids])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        places, rank = _best_rows(row, ids, scores, self.k)
        self.ids[row[places], rank], self.scores[row[places], rank] = ids[places], scores[places]


_HITS = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("rank", pa.int64())])


def _group_kernel(k: int, cosine: bool):
    """`left`: query_id, vector, blocks (those that the query visits, NULL for all); `right`: item_id, vector, block."""
    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _HITS.empty_table()
        right = right.sort_by([("block", "ascending"), ("item_id", "ascending")])
        q = _matrix(left.column("vector"))
        best = _Best(_unit(q) if cosine else q, k)
        wanted = left.column("blocks").combine_chunks()
        wants_all = wanted.null_count == len(wanted)
        if not wants_all:
            seeker, sought = (x.to_numpy(zero_copy_only=False) for x in (pc.list_parent_indices(wanted), pc.list_flatten(wanted)))
        block = right.column("block").to_numpy()
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(block)]):
            rows = np.arange(len(q)) if wants_all else seeker[sought == block[start]]
            if len(rows):
                part = right.slice(start, end - start)
                m = _matrix(part.column("vector"))
                best.add(rows, part.column("item_id").to_numpy(), _unit(m) if cosine else m)
        row, col = np.nonzero(best.scores > -np.inf)
        return pa.Table.from_arrays([left.column("query_id").combine_chunks().take(pa.array(row)), pa.array(best.ids[row, col]), pa.array(best.scores[row, col]), pa.array(col + 1)], schema=_HITS)

    return match


def _chunks(n_queries: int, params: RetrievalParams, parallelism: int) -> int:
    return max(1, math.ceil(n_queries / (params.query_chunk_rows * _GROUP_CHUNKS)), min(parallelism, math.ceil(n_queries / 128)))


def _match(queries: DataFrame, items: DataFrame, k: int, chunks: int, cosine: bool) -> DataFrame:
    """`queries` (query_id, vector, shelf, blocks), `items` (item_id, vector, shelf, block)."""
    q = queries.select("shelf", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"), "query_id", "vector", "blocks")
    m = items.select("shelf", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "item_id", "vector", "block")
    return q.groupBy("shelf", "chunk").cogroup(m.groupBy("shelf", "chunk")).applyInArrow(
        _group_kernel(k, cosine), "query_id bigint, item_id bigint, score double, rank bigint")


def _shelf(block) -> Column:
    return F.floor(block / F.lit(_SHELF_BLOCKS)).cast("bigint")


def _merge(hits: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return hits.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def _sides(queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without rows that have no vector. A vector with a value that is not finite fails the job: in a partial
    sort it would displace the best items of every query."""
    return (checked(queries.where("vector IS NOT NULL").select("query_id", "vector"), "vector"),
            checked(items.where("vector IS NOT NULL").select("item_id", "vector"), "vector"))


def exact_topk(queries: DataFrame, items: DataFrame, k: int, params: RetrievalParams = RetrievalParams(), cosine: bool = True,
               allowed: DataFrame | None = None) -> DataFrame:
    """The k best items per query (query_id, item_id, score, rank) by cosine or inner product; k is capped by
    the catalog by itself. `allowed` (item_id) restricts the items before the search."""
    if k <= 0:
        raise ValueError(f"a search for {k} items finds nothing")
    queries, items = _sides(queries, items)
    if allowed is not None:
        items = items.join(allowed, "item_id", "left_semi")
    blocks = max(1, math.ceil(items.count() / params.item_block_rows))
    chunks = _chunks(queries.count(), params, queries.sparkSession.sparkContext.defaultParallelism)
    shelves = math.ceil(blocks / _SHELF_BLOCKS)
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("bigint")).withColumn("shelf", _shelf(F.col("block")))
    sent = queries.withColumn("blocks", F.lit(None).cast("array<bigint>")).withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shelves - 1).cast("bigint"))))
    hits = _match(sent, placed, k, chunks, cosine)
    return hits if shelves == 1 else _merge(hits, k)


def cell_topk(queries: DataFrame, items: DataFrame, k: int, params: RetrievalParams = RetrievalParams(), seed: int = 42,
              allowed: DataFrame | None = None) -> DataFrame:
    """Approximate search: items are clustered into about sqrt(items) cells, a query visits the `probed_cells` nearest to it
    and is scored exactly inside them. May return fewer than k."""
    queries, items = _sides(queries, items)
    if allowed is not None:
        items = items.join(allowed, "item_id", "left_semi")
    cells = max(1, math.isqrt(items.count()))
    units = items.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    if cells == 1:  # k-means needs two clusters
        return exact_topk(queries, items, k, params)
    model = KMeans(k=cells, seed=seed, maxIter=10, initMode="k-means||", distanceMeasure="cosine").fit(units.select("features"))
    centers = _unit(np.array(model.clusterCenters(), dtype=np.float64))
    visit = min(params.probed_cells, len(centers))
    placed = model.transform(units).select("item_id", "vector", F.col("prediction").cast("bigint").alias("cell"))

    def nearest_cells(batches):
        for batch in batches:
            q = _unit(_matrix(pa.Table.from_batches([batch]).column("vector")))
            order = np.concatenate([np.argsort(-(q[part] @ centers.T), axis=1, kind="stable")[:, :visit] for part in _slabs(len(q), len(centers))] or [np.zeros((0, visit), np.int64)])
            cells = pa.ListArray.from_arrays(np.arange(0, order.size + 1, visit, dtype=np.int32), pa.array(order.reshape(-1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(params.item_block_rows)).cast("bigint").alias("parts"))
    placed = placed.join(parts, "cell").withColumn("block", F.col("cell") * _SUB + F.pmod(F.xxhash64("item_id"), F.col("parts")))
    vec_type = queries.schema["vector"].dataType.simpleString()
    routed = queries.mapInArrow(nearest_cells, f"query_id bigint, vector {vec_type}, cells array<bigint>")
    routed = routed.select("query_id", "vector", F.explode("cells").alias("cell")).join(parts, "cell")
    routed = routed.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda p: F.col("cell") * _SUB + p)))
    chunks = _chunks(queries.count(), params, queries.sparkSession.sparkContext.defaultParallelism)
    routed = routed.withColumn("shelf", F.col("block")).withColumn("blocks", F.lit(None).cast("array<bigint>"))
    return _merge(_match(routed, placed.withColumn("shelf", F.col("block")), k, chunks, True), k)


def _placed(items: DataFrame, params: RetrievalParams) -> tuple[DataFrame, "_Cells"]:
    """Items (item_id, vector, cell, angle, block, shelf) in cells around items chosen by hash, about the root of the catalogue and at most
    `search_cells` many, and what the routing knows of the cells. Items without a direction, whose cosine is 0 with everything, are
    a cell of their own, the last one."""
    count = items.count()
    cells = min(params.search_cells, max(1, math.isqrt(count)))
    drawn = items.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("item_id"), "item_id").limit(cells).select("vector").toArrow()
    centres = _unit(_matrix(drawn.column("vector"))) if drawn.num_rows else np.zeros((0, 0))
    zero = len(centres)

    def nearest(batches):
        for batch in batches:
            m = _matrix(pa.Table.from_batches([batch]).column("vector"))
            still = ~m.any(axis=1)
            cell, angle = np.zeros(len(m), np.int64), np.zeros(len(m))
            for part in _slabs(len(m), zero) if zero else ():
                cosine = np.clip(_unit(m[part]) @ centres.T, -1, 1)
                cell[part] = cosine.argmax(axis=1)
                angle[part] = np.arccos(cosine[np.arange(len(cosine)), cell[part]])
            cell[still], angle[still] = zero, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    kind = items.schema["vector"].dataType.simpleString()
    placed = stage(items.select("item_id", "vector").mapInArrow(nearest, f"item_id bigint, vector {kind}, cell bigint, angle double"), "search_cells")
    radius, size = np.zeros(zero + 1), np.zeros(zero + 1, np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("items"), F.max("angle").alias("radius")).collect():  # a row per cell
        radius[r["cell"]], size[r["cell"]] = r["radius"], r["items"]
    model = _Cells(centres, radius, size, params.item_block_rows)
    places = items.sparkSession.createDataFrame([(c, int(model.first[c]), int(model.parts[c])) for c in range(zero + 1)], "cell bigint, first bigint, parts bigint")
    placed = placed.join(F.broadcast(places), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("parts"))).drop("first", "parts")
    return placed.withColumn("shelf", _shelf(F.col("block"))), model


class _Cells:
    """Cells packed into blocks: neighbouring small ones share a block, a large one has several of its own (`first` and the next, `parts` of them)."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, size: np.ndarray, rows: int):
        self.centres, self.radius = centres, radius
        self.first, self.parts = np.zeros(len(size), np.int64), np.maximum(1, -(-size // rows))
        cell_of, block_of, held, block, filled = [], [], [], -1, rows
        for c in [*_chained(centres), len(size) - 1]:
            if size[c] == 0:
                continue
            if self.parts[c] > 1 or filled + size[c] > rows:
                self.first[c], block, filled = block + 1, block + self.parts[c], rows if self.parts[c] > 1 else 0
                held += [0] * self.parts[c]
            else:
                self.first[c] = block
            filled += size[c]
            for b in range(self.first[c], self.first[c] + self.parts[c]):
                cell_of.append(c)
                block_of.append(b)
                held[b] += size[c] // self.parts[c]
        self.cell_of, self.held = np.array(cell_of, np.int64), np.array(held, np.int64)
        self.starts = np.searchsorted(np.array(block_of, np.int64), np.arange(len(held)))

    def best_possible(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the cosine with any item of each block: no item is closer than its cell's centre less the cell's radius."""
        best = np.zeros((len(q), len(self.radius)))
        if len(self.centres):
            angle = np.arccos(np.clip(_unit(q) @ self.centres.T, -1, 1))
            best[:, :-1] = np.cos(np.maximum(0.0, angle - self.radius[:-1])) + _SLACK
            best[~q.any(axis=1)] = 0.0
        return np.maximum.reduceat(best[:, self.cell_of], self.starts, axis=1) if len(self.starts) else np.zeros((len(q), 0))


def _chained(centres: np.ndarray) -> list[int]:
    """Numbers of the centres, each followed by the nearest of those that are left."""
    left, out = np.ones(len(centres), bool), []
    while len(out) < len(centres):
        at = int(np.argmax(np.where(left, centres @ centres[out[-1]], -np.inf))) if out else 0
        left[at] = False
        out.append(at)
    return out


def _routed(queries: DataFrame, model: _Cells, k: int, visited: bool) -> DataFrame:
    """(query_id, vector, blocks), a row per query. First visit: the blocks that promise most, as many as hold k items. Later (`visited`,
    with the k-th score so far in `least`, NaN where there are fewer): all others whose bound reaches that score."""
    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            q = _matrix(t.column("vector"))
            least = t.column("least").to_numpy() if visited else None
            sizes, blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in _slabs(len(q), len(model.radius)):
                best = model.best_possible(q[part])
                order = np.argsort(-best, axis=1, kind="stable")
                before = np.cumsum(model.held[order], axis=1) - model.held[order]
                first = np.zeros(best.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                chosen = ~first & ((best >= least[part, None]) | np.isnan(least[part])[:, None]) if visited else first
                sizes.append(chosen.sum(axis=1))
                blocks.append(np.nonzero(chosen)[1])
            offsets = np.cumsum(np.r_[0, np.concatenate(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(blocks).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["query_id", "vector", "blocks"])

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.mapInArrow(run, f"query_id bigint, vector {kind}, blocks array<bigint>")


def bounded_topk(queries: DataFrame, items: DataFrame, k: int, params: RetrievalParams = RetrievalParams(), allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact search by cosine that skips cells of items: the hits of `exact_topk`, and the visits (query_id, cell, items).

    Two passes of branch and bound over blocks of neighbouring cells. The first scores each query against the blocks that promise most and
    gives a lower bound of its k-th score. The second visits only those other blocks whose best possible cosine reaches that bound, so
    its work follows the catalogue's shape: clustered vectors cost a few blocks, evenly spread ones all of them. A query
    travels with the list of its blocks, once per shelf and pass, so even then nothing is sent more than twice as often as by `exact_topk`."""
    if k <= 0:
        raise ValueError(f"a search for {k} items finds nothing")
    queries, items = _sides(queries, items)
    if allowed is not None:
        items = items.join(allowed, "item_id", "left_semi")
    placed, model = _placed(items, params)
    chunks = _chunks(queries.count(), params, queries.sparkSession.sparkContext.defaultParallelism)

    def visit(routed):
        shelves = F.array_distinct(F.transform("blocks", _shelf))
        return _merge(_match(routed.withColumn("shelf", F.explode(shelves)), placed, k, chunks, True), k)

    first = stage(_routed(queries, model, k, False), "first_blocks")
    found = stage(visit(first), "first_hits")
    bound = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    # NaN: nothing known yet
    second = stage(_routed(queries.join(bound, "query_id", "left").select("query_id", "vector", F.coalesce("least", F.lit(float("nan"))).alias("least")), model, k, True), "other_blocks")
    held = placed.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("items"))
    seen = first.select("query_id", "blocks").union(second.select("query_id", "blocks")).select("query_id", F.explode("blocks").alias("block"))
    columns = ["query_id", "item_id", "score", "rank"]
    return _merge(found.select(columns).union(visit(second).select(columns)), k), seen.join(held, "block").select("query_id", "cell", "items")


def nearest_items(queries: DataFrame, items: DataFrame, k: int, params: RetrievalParams = RetrievalParams(), allowed: DataFrame | None = None) -> DataFrame:
    """The exact k best items per query by cosine. A catalogue of one shelf is multiplied as a whole, which takes each query there once;
    a larger one is searched by bounds. Both give the same hits."""
    if items.count() <= params.item_block_rows * _SHELF_BLOCKS:
        return exact_topk(queries, items, k, params, allowed=allowed)
    return bounded_topk(queries, items, k, params, allowed)[0]


def pool_size(params: RetrievalParams, limit: int, catalog_size: int) -> int:
    """Candidates to retrieve for a list of `limit`: a multiple of it and never few, as far as the catalog reaches."""
    if min(limit, catalog_size) < 1:
        raise ValueError(f"no candidates for a list of {limit} from {catalog_size} products")
    wanted = max(params.min_candidate_pool, params.candidate_pool_multiplier * limit)
    return min(wanted, catalog_size)


def ranked_rows(lists: DataFrame) -> DataFrame:
    """Parallel arrays (query_id, item_ids, scores) to ranked rows."""
    return lists.select("query_id", F.posexplode(F.arrays_zip("item_ids", "scores")).alias("pos", "s")).select(
        "query_id", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("s.item_ids").alias("item_id"), F.col("s.scores").alias("score"))


def with_known_products(hits: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits present in the current catalog, and the count of those that are not, per query."""
    ids = catalog.select(F.col("product_id").alias("item_id"))
    dropped = hits.join(ids, "item_id", "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("dropped"))
    return hits.join(ids, "item_id", "left_semi"), dropped
