"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set of word shingles gives a signature of trees * depth minima. Each tree orders the documents by its own part
of the signature. Documents that share the first `base` values of a tree form a region; in it a document's candidate is
its neighbour in the order, the one with the longest common prefix, so large regions are read at the greater depth where they fall
apart. Candidates are confirmed on full sets, confirmed links join groups, and the orders are read again with whole groups counted as
one neighbour, until a round adds few links. Then regions of few documents are compared in full at the base depth, and the documents of
all others, regions of many groups or with linked groups of several documents, go to one exact join on their rarest shingles.

Documents with the same set are one node throughout. A pair of similarity 0.8 misses all 12 regions with probability
(1 - 0.8^2)^12 < 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import hashing
from shelfwise.llm.arrow import per_batch, slices, texts
from shelfwise.llm.components import components
from shelfwise.sources.stage import stage

WIDTH = 5
PERCENT = 80
TREES = 12
DEPTH = 6
BASE = 2
#: Regions of up to so many groups and one more are compared in full.
NEIGHBOURS = 8
#: Bits of the largest id filter that is sent to the tasks (32 MB); ids beyond an eighth of it are found by a join instead.
FILTER_BITS = 1 << 28
_ROWS = 2048
_CANDIDATES = "a bigint, b bigint, tree int, key binary, id bigint, n bigint, comp bigint"


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> bytes:
    """Upper halves of the minima, big-endian, so that bytes sort as the values do."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _ROWS):
        np.minimum(least, (shingles[at:at + _ROWS, None] * multipliers[None, :]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _sets(rows: list[str], width: int) -> Iterator[np.ndarray]:
    hashes, first = hashing.words([t.encode() for t in rows])
    for i in range(len(rows)):
        yield hashing.shingles(hashes[first[i]:first[i + 1]], width)


def sketches(df: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(id, n, digest, signature) per row; digest and signature are NULL for texts without words."""
    multipliers = hashing.constants(TREES * DEPTH, 11)

    def run(batch):
        n, digest, sig = [], [], []
        for s in _sets(texts(batch), width):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s, multipliers) if len(s) else None)
        return {"id": batch.column("id"), "n": pa.array(n, "int64"), "digest": pa.array(digest, "binary"), "signature": pa.array(sig, "binary")}

    return per_batch(df.withColumn("_id", F.col(id_column).cast("bigint")), {"id": "_id", "text": text_column}, run, "id bigint, n bigint, digest binary, signature binary")


def _regions(batches):
    """Of rows in tree order, those that share their first values with a row before or after them. The first and last row of
    a task are kept, as their neighbours may be elsewhere."""
    head = 4 * BASE
    for batch in batches:
        if not batch.num_rows:
            continue
        trees = np.asarray(batch.column("tree")).astype(np.int64)
        keys = np.frombuffer(b"".join(k[:head] for k in batch.column("key").to_pylist()), f"S{head}")
        raw = np.frombuffer(keys.tobytes(), ">u8")
        same = (raw[1:] == raw[:-1]) & (trees[1:] == trees[:-1])
        keep = np.zeros(batch.num_rows, bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] = keep[-1] = True
        yield batch.filter(pa.array(keep))


def _filter_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (hashing.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _region_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents in `ids`, and of a few others. Texts don't move: each task keeps those whose id is in
    a bitmap of the ids. Only where the ids are too many for a bitmap of bounded size are the texts joined."""
    wanted = ids.count()
    bits = 1 << max(10, (16 * wanted).bit_length())
    if 8 * wanted > FILTER_BITS:
        return per_batch(docs.join(ids, "id", "left_semi"), {"id": "id", "text": "text"}, lambda batch: _set_columns(batch, width), "id bigint, shingles array<bigint>")
    bits = min(bits, FILTER_BITS)

    def slots(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_filter_slots(np.asarray(batch.column(0)), bits))], ["slot"])

    words = ids.mapInArrow(slots, "slot bigint").groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in slices(batches):
            batch = batch.filter(pa.compute.is_valid(batch.column("id")))
            slot = _filter_slots(np.asarray(batch.column("id")), bits)
            batch = batch.filter(pa.array((sent.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) == 1))
            out = _set_columns(batch, width)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return docs.mapInArrow(run, "id bigint, shingles array<bigint>")


def _set_columns(batch, width):
    sets = [s.view(np.int64) for s in _sets(texts(batch), width)]
    return {"id": batch.column("id"), "shingles": pa.array(sets, pa.list_(pa.int64()))}


def _ordered(rows: DataFrame) -> DataFrame:
    """Dealt by range of the tree order; ids are part of it, so equal signatures never pile up in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "tree", "key", "n", "id").sortWithinPartitions("tree", "key", "n", "id")


def _pairs(batches, neighbours: int, percent: int, edges: bool):
    """Candidate pairs (a, b) of rows in tree order: a row with the nearest rows before it of up to `neighbours` other groups
    in its region. With `edges` also the rows near either end of the task, one for each of so many groups, which may have
    neighbours in other tasks."""
    head = 4 * BASE
    recent: list[tuple] = []
    first: list[tuple] = []
    opening: set | None = set() if edges else None
    region = None
    out: set[tuple[int, int]] = set()
    for batch in slices(batches, 10_000):
        for row in zip(*[batch.column(c).to_pylist() for c in ("tree", "key", "id", "n", "comp")]):
            tree, key, node, n, comp = row
            if (tree, key[:head]) != region:
                if region is not None:
                    opening = None
                region, recent = (tree, key[:head]), []
            if opening is not None and comp not in opening:
                opening.add(comp)
                first.append(row)
                if len(opening) > neighbours:
                    opening = None
            for other in recent:
                if other[4] != comp and 100 * min(n, other[3]) >= percent * max(n, other[3]):
                    out.add((min(node, other[2]), max(node, other[2])))
            recent = [row] + [r for r in recent if r[4] != comp][:neighbours - 1] if neighbours > 1 else [row]
        if len(out) > 20_000:
            yield _rows(out, [])
            out = set()
    yield _rows(out, first + recent if edges else [])


def _rows(pairs, edge):
    n, m = len(pairs), len(edge)
    pairs = list(pairs)
    cols = [[p[0] for p in pairs] + [None] * m, [p[1] for p in pairs] + [None] * m]
    cols += [[None] * n + [r[i] for r in edge] for i in (0, 1, 2, 3, 4)]
    kinds = ["int64", "int64", "int32", "binary", "int64", "int64", "int64"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["a", "b", "tree", "key", "id", "n", "comp"])


def _candidates(rows: DataFrame, neighbours: int, percent: int) -> DataFrame:
    """Distinct pairs. Rows at the ends of tasks, a bounded number for each task, are compared once more in order."""
    found = stage(_ordered(rows).mapInArrow(lambda b: _pairs(b, neighbours, percent, True), _CANDIDATES), "forest_pairs")
    ends = found.where("a IS NULL").select("tree", "key", "id", "n", "comp").distinct().coalesce(1).sortWithinPartitions("tree", "key", "n", "id")
    more = ends.mapInArrow(lambda b: _pairs(b, neighbours, percent, False), _CANDIDATES)
    return found.where("a IS NOT NULL").select("a", "b").union(more.select("a", "b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b").withColumn("i", shared.cast("bigint"))
            .where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b"))


def _grouped(regions: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return regions.withColumn("comp", F.col("id"))
    return regions.join(groups.toDF("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _split(rows: DataFrame, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """Of the regions with several groups: the rows of those that the orders compare in full, with up to `neighbours` + 1 groups of one
    row each, and the distinct (id, comp) of all others."""
    rows = rows.withColumn("head", F.substring("key", 1, 4 * BASE))
    groups = rows.groupBy("tree", "head", "comp").agg(F.count(F.lit(1)).alias("members"))
    regions = groups.groupBy("tree", "head").agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("members")).where("groups > 1")
    regions = stage(regions.select("tree", "head", ((F.col("groups") > neighbours + 1) | (F.col("members") > F.col("groups"))).alias("crowded")), "region_sizes")
    small = rows.join(regions.where("NOT crowded"), ["tree", "head"], "left_semi").drop("head")
    return small, rows.join(regions.where("crowded"), ["tree", "head"], "left_semi").select("id", "comp").distinct()


def _exact_pairs(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of documents (id, comp) of different groups, among them every pair that reaches `percent`.

    In one order of all shingles, rarest first, two such sets share one of their first n - ceil(percent * n / 100) + 1, and their
    common part is at most what follows the first shared one. Shingles of one document only come first in the order; they are
    counted, not kept. So a passage that many documents share is behind these places unless it makes up nearly all of a text."""
    row = F.xxhash64("id", "shingles")
    own = sets.join(docs, "id").select(row.alias("row"), "id", "comp", F.size("shingles").cast("bigint").alias("n"), "shingles")
    tokens = stage(own.select("row", F.explode("shingles").alias("token")), "tokens")
    members = stage(own.select("row", "id", "comp", "n").distinct(), "members")
    counts = stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1"), "token_counts")
    shared = tokens.join(counts, "token").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("docs", "token"))).alias("shared"))
    places = F.size("shared") + 1 - F.expr(f"cast(({percent} * n + 99) div 100 as int)")
    prefixes = shared.join(members, "row").withColumn("places", places).where("places > 0")
    listed = prefixes.select("id", "comp", "n", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), F.col("places"))).alias("at", "x"))
    postings = stage(listed.select("id", "comp", "n", (F.col("m") - F.col("at")).alias("rest"), F.col("x.token").alias("token")), "postings")
    # Rows of a token's largest group meet those of others only, so the members of a group are not paired. Of a pair the smaller set
    # has the token early enough for a partner of its own size, and only such rows are met.
    sizes = postings.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token", "largest")
    several = stage(postings.join(largest, "token").withColumns({"most": F.expr("comp = largest"), "early": F.expr(f"{100 + percent} * rest >= {2 * percent} * n")}), "several")

    def met(small, large):
        return small.where("early").alias("a").join(large.alias("b"), F.expr(f"""a.token = b.token AND a.comp <> b.comp AND (a.n < b.n OR a.n = b.n AND a.id < b.id)
            AND 100 * a.n >= {percent} * b.n AND {100 + percent} * least(a.rest, b.rest) >= {percent} * (a.n + b.n)""")).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))

    return met(several.where("NOT most"), several).union(met(several.where("most"), several.where("NOT most"))).distinct()


def near_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per row of `df`: id, n_shingles, component_id (the smallest id reachable over links), kept (id = component_id).

    Two documents are linked when 100 * shared shingles >= percent * all shingles of both. Texts without words (or NULL)
    have no shingles and no links. Rows with the same id count as one document; a row with a NULL id is linked with nothing
    and stays. An empty table gives no rows. Ids are integers; other columns are not read."""
    per_row = stage(sketches(df, id_column, text_column, width), "sketches")
    known = per_row.where("id IS NOT NULL AND digest IS NOT NULL")
    # staged, so that Spark can split the join of a very common set with it
    nodes = stage(known.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes")
    parts = F.array(*[F.substring("signature", 4 * DEPTH * t + 1, 4 * DEPTH) for t in range(TREES)])
    forest = nodes.select("id", "n", F.posexplode(parts).alias("tree", "key")).select("tree", "key", "id", "n")
    regions = stage(_ordered(forest).mapInArrow(_regions, "tree int, key binary, id bigint, n bigint"), "regions")
    sets = stage(_region_sets(df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")), regions.select("id").distinct(), width), "shingle_sets")
    # Rows that share an id but not a set tie their nodes together.
    owners = known.select("id", "digest").join(nodes.select("digest", F.col("id").alias("node")), "digest").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    groups, tried, found = None, None, 0
    while True:
        # at first the row before, later also the nearest one before it of another group
        pairs = _candidates(_grouped(regions, groups), 1 if groups is None else 2, percent)
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        new = stage(_confirmed(pairs, sets, percent), "links")
        count = new.count()
        found += count
        if count:
            groups = components(new if groups is None else new.union(groups.toDF("a", "b")))
        if not count or 10 * count < found:
            break
    small, crowded = _split(stage(_grouped(regions, groups), "grouped_regions"), neighbours)
    rest = _candidates(small, neighbours, percent).union(_exact_pairs(stage(crowded, "crowded"), sets, percent)).distinct()
    new = stage(_confirmed(stage(rest.join(tried, ["a", "b"], "left_anti"), "pairs"), sets, percent), "links")
    if not new.isEmpty():
        groups = components(new if groups is None else new.union(groups.toDF("a", "b")))
    edges = owners if groups is None else owners.union(groups.toDF("a", "b"))
    final = components(edges)
    out = per_row.select("id", "n").join(final.toDF("id", "component_id"), "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
