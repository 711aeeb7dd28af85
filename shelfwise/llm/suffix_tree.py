"""Language-model scores from a probabilistic suffix tree over bytes.

A text is its lower-cased words, a space behind each and an end mark at the end. A context is up to DEPTH bytes before a byte. The tree
keeps a context if it is frequent enough (a fixed share of all positions, which bounds the tree whatever the corpus) and its
next-byte distribution diverges enough from that of its suffix, the context one byte shorter; suffixes of kept contexts are
kept too. Distributions are smoothed towards the suffix's (Witten-Bell). A byte is scored by the longest kept context that
ends before it. The probability of a token, which is a word with its space or the end mark, is the mean of two: the product over its
bytes, and its smoothed share of all training tokens. Unknown words are one token of the second part, as in the base
score, so both scores measure the same events; by the first part alone a word is worth less than all unknown words together.

Counts of all contexts and words come from one grouped count over the whole training part: tasks count their own text, and
the sums are shuffled by key. Words above a fixed share of the corpus travel to the tasks, again a bounded number; rarer ones are
looked up by a join.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import hashing
from shelfwise.llm.arrow import slices, texts
from shelfwise.llm.perfect_hash import PerfectHash
from shelfwise.sources.stage import stage

DEPTH = 5
#: Contexts with a smaller share of all positions are not kept, so at most 1 / SHARE of each length are.
SHARE = 4e-6
#: Least divergence, in nats summed over a context's occurrences, and in nats per occurrence.
GAIN, DIVERGENCE = 16.0, 0.005
#: Words with at least this share of all tokens are sent to the tasks: at most 1 / FREQUENT words.
FREQUENT = 2e-7
#: Weight of the tree in a token's probability; the rest is its share of all tokens.
TREE = 0.5
WORD, GRAM, DOCS = 0, 1, 2
_HELD = 1 << 22
_MEMO_BITS = 20
_U = np.uint64


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _sequences(rows: list[str]) -> list[bytes]:
    return [b" ".join([*t.encode().lower().split(), b"\n"]) for t in rows]


def grams(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(each byte with the DEPTH before it, the last byte lowest; where each text starts, then the end). Before a text stand zeros
    and one end mark."""
    lead = b"\0" * (DEPTH - 1) + b"\n"
    parts = _sequences(rows)
    data = np.frombuffer(b"".join(lead + p for p in parts), np.uint8).astype(_U)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes + DEPTH)
    inside = np.ones(len(data), bool)
    for j in range(DEPTH):
        inside[ends - sizes - 1 - j] = False
    at = np.flatnonzero(inside)
    out = np.zeros(len(at), _U)
    for j in range(DEPTH + 1):
        out |= data[at - j] << _U(8 * j)
    return out, np.append(0, np.cumsum(sizes))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


class _Counter:
    """Counts of 64-bit keys in bounded memory: what grows too large is handed out."""

    def __init__(self):
        self.raw: list[np.ndarray] = []
        self.waiting = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray):
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting >= _HELD:
            self._compact()

    def _compact(self):
        if self.raw:
            keys, n = np.unique(np.concatenate(self.raw), return_counts=True)
            self.parts = [_summed([*self.parts, (keys, n)])]
            self.raw, self.waiting = [], 0

    def full(self) -> bool:
        return bool(self.parts) and len(self.parts[0][0]) >= _HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._compact()
        out = self.parts[0] if self.parts else (np.zeros(0, _U), np.zeros(0, np.int64))
        self.parts = []
        return out


def _counted(kind: int, keys: np.ndarray, n: np.ndarray):
    for at in range(0, len(keys), 100_000):
        k = keys[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[at:at + 100_000].astype(np.int64))], ["kind", "key", "n"])


def count(rows: DataFrame) -> DataFrame:
    """(kind, key, n) over the training texts: word hashes, grams, and the number of texts."""

    def run(batches):
        counters, docs = {WORD: _Counter(), GRAM: _Counter()}, 0
        for batch in slices(batches):
            train = [t for i, t in zip(batch.column("id").to_pylist(), texts(batch)) if not held_out(i)]
            docs += len(train)
            if train:
                counters[WORD].add(hashing.words([t.encode() for t in train])[0])
                counters[GRAM].add(grams(train)[0])
            for kind, counter in counters.items():
                if counter.full():
                    yield from _counted(kind, *counter.take())
        for kind, counter in counters.items():
            yield from _counted(kind, *counter.take())
        yield from _counted(DOCS, np.zeros(1, _U), np.array([docs]))

    return rows.mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class SuffixTree:
    """Kept contexts by length: sorted keys and back-off weights, and sorted context-with-byte keys and log10 probabilities."""

    root: np.ndarray
    contexts: list[np.ndarray] = field(default_factory=list)
    back_off: list[np.ndarray] = field(default_factory=list)
    entries: list[np.ndarray] = field(default_factory=list)
    log10: list[np.ndarray] = field(default_factory=list)
    memo: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return {**self.__dict__, "memo": None}

    def fresh(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte."""
        out = np.zeros(len(g))
        left = np.arange(len(g))
        for length in range(len(self.contexts), 0, -1):
            contexts, entries = self.contexts[length - 1], self.entries[length - 1]
            if not len(contexts):
                continue
            own = g[left] & _U((1 << 8 * (length + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, own >> _U(8)), len(contexts) - 1)
            known = contexts[at] == own >> _U(8)
            place = np.minimum(np.searchsorted(entries, own), len(entries) - 1)
            found = known & (entries[place] == own)
            out[left[found]] += self.log10[length - 1][place[found]]
            lost = known & ~found
            out[left[lost]] += self.back_off[length - 1][at[lost]]
            left = left[~found]
        out[left] += self.root[(g[left] & _U(255)).astype(np.int64)]
        return out

    def scores(self, g: np.ndarray) -> np.ndarray:
        """The same, through a table of the last grams met at each hash."""
        if self.memo is None:
            self.memo = np.full(1 << _MEMO_BITS, np.iinfo(np.uint64).max, _U), np.zeros(1 << _MEMO_BITS)
        keys, values = self.memo
        slot = (hashing.mix(g) >> _U(64 - _MEMO_BITS)).astype(np.int64)
        out = values[slot]
        miss = np.flatnonzero(keys[slot] != g)
        if len(miss):
            new, back = np.unique(g[miss], return_inverse=True)
            fresh = self.fresh(new)
            out[miss] = fresh[back]
            at = (hashing.mix(new) >> _U(64 - _MEMO_BITS)).astype(np.int64)
            keys[at], values[at] = new, fresh
        return out


def _levels(counts: DataFrame, positions: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length 0 to DEPTH, the (context with byte, count) of contexts with at least SHARE of all positions."""
    out = []
    table = counts
    for length in range(DEPTH, -1, -1):
        table = stage(table.groupBy(F.col("key").bitwiseAND((1 << 8 * (length + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")), "suffix_counts") if length < DEPTH else table
        context = F.shiftright("key", 8)
        frequent = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total")).where(F.col("total") >= SHARE * positions).select("context")
        kept = table.withColumn("context", context).join(frequent, "context", "left_semi").select("key", "n").toArrow()
        keys, n = kept.column("key").to_numpy().astype(_U), kept.column("n").to_numpy().astype(np.float64)
        order = np.argsort(keys)
        out.append((keys[order], n[order]))
    return out[::-1]


def grow(counts: DataFrame) -> SuffixTree:
    """The tree from the summed grams. Only entries of frequent contexts reach the driver, a number bounded by SHARE."""
    positions = counts.agg(F.sum("n")).first()[0] or 0
    levels = _levels(counts, positions)
    root = np.zeros(256)
    root[levels[0][0].astype(np.int64)] = levels[0][1]
    tree = SuffixTree(np.log10((root + 0.5) / (root.sum() + 128)))
    kept: list[np.ndarray] = []
    shares = []
    for length in range(1, DEPTH + 1):
        keys, n = levels[length]
        context = keys >> _U(8)
        names, first = np.unique(context, return_index=True)
        total = np.add.reduceat(n, first) if len(n) else n
        size = np.diff(np.append(first, len(keys)))
        above, above_n = levels[length - 1]
        parent = keys & _U((1 << 8 * length) - 1)
        parent_total = np.zeros(len(keys))
        if len(keys):
            up_names, up_first = np.unique(above >> _U(8), return_index=True)
            up_total = np.add.reduceat(above_n, up_first)
            parent_total = up_total[np.searchsorted(up_names, parent >> _U(8))]
        parent_n = above_n[np.searchsorted(above, parent)] if len(keys) else n
        each = np.repeat(total, size)
        gain = n * np.log((n / each) / (parent_n / parent_total)) if len(keys) else n
        gain = np.add.reduceat(gain, first) if len(gain) else gain
        kept.append(names[(gain >= GAIN) & (gain >= DIVERGENCE * total)])
        shares.append((keys, n, names, first, total, size))
    for length in range(DEPTH - 1, 0, -1):  # suffixes of kept contexts
        kept[length - 1] = np.union1d(kept[length - 1], kept[length] & _U((1 << 8 * length) - 1))
    for length in range(1, DEPTH + 1):
        keys, n, names, first, total, size = shares[length - 1]
        stays = np.isin(names, kept[length - 1])
        rows = np.repeat(stays, size)
        keys, n, each, kinds = keys[rows], n[rows], np.repeat(total, size)[rows], np.repeat(size, size)[rows]
        shorter = 10 ** tree.fresh(keys & _U((1 << 8 * length) - 1)) if len(keys) else n
        tree.entries.append(keys)
        tree.log10.append(np.log10((n + kinds * shorter) / (each + kinds)))
        tree.contexts.append(names[stays])
        tree.back_off.append(np.log10(size[stays] / (total[stays] + size[stays])))
    return tree


def score(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `df`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod 5 is 1 are held out of training; a NULL id is not. NULL and empty texts are one token,
    the end. Repeated rows count and score each. Without training texts every token has base probability 1 and every byte the
    same one. An empty table gives no rows. Ids are integers; other columns are not read."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    counts = stage(count(rows), "corpus_counts")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    docs = sums[DOCS]["n"] if DOCS in sums else 0
    tokens = docs + (sums[WORD]["n"] if WORD in sums else 0)
    distinct = (sums[WORD]["distinct"] if WORD in sums else 0) + (docs > 0)
    tree = grow(counts.where(F.col("kind") == GRAM).select("key", "n"))
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    common = words.where(F.col("n") >= FREQUENT * tokens).toArrow()
    model = spark.sparkContext.broadcast((tree, common.column("word").to_numpy().view(_U), common.column("n").to_numpy()))
    space = tokens + 0.5 * (distinct + 1)

    def run(batches):
        tree, keys, n = model.value
        table = PerfectHash(keys)
        name, share = np.zeros(max(1, len(keys)), _U), np.empty(max(1, len(keys)))
        at = table(keys)
        name[at], share[at] = keys, (n + 0.5) / space
        counter = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            ids, text = batch.column("id").to_pylist(), texts(batch)
            h, first = hashing.words([t.encode() for t in text])
            g, _ = grams(text)
            last = g & _U(255)
            ends = np.flatnonzero((last == 32) | (last == 10))
            spelled = np.add.reduceat(tree.scores(g), np.append(0, ends[:-1] + 1))
            closing = last[ends] == 10
            doc = np.repeat(np.arange(len(text)), np.diff(first))
            at = table(h)
            hit = (at >= 0) & (name[at] == h)
            total = np.log10(TREE * 10 ** spelled[closing] + (1 - TREE) * (docs + 0.5) / space)
            spelled = spelled[~closing]
            own = share[at[hit]]
            total += np.bincount(doc[hit], weights=np.log10(TREE * 10 ** spelled[hit] + (1 - TREE) * own), minlength=len(text))
            base = np.log10((docs + 0.5) / space) + np.bincount(doc[hit], weights=np.log10(own), minlength=len(text))
            rest = ~hit
            lists = pa.array(np.append(0, np.cumsum(np.bincount(doc[rest], minlength=len(text)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(range(counter, counter + len(text)), pa.int64()), pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(np.diff(first) + 1),
                                              pa.array(np.bincount(doc[hit], minlength=len(text)) + int(docs > 0)), pa.array(base), pa.array(total),
                                              pa.ListArray.from_arrays(lists, pa.array(h[rest].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(spelled[rest]))],
                                             ["row", "id", "held_out", "n_tokens", "known", "base", "total", "rare", "spelled"])
            counter += len(text)

    schema = "row bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, base double, total double, rare array<bigint>, spelled array<double>"
    scored = stage(rows.mapInArrow(run, schema), "text_scores")
    share = (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(space)
    looked = (scored.select("row", F.explode(F.arrays_zip("rare", "spelled")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.spelled").alias("spelled"))
              .join(words, "word", "left").groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(share)).alias("base_more"),
                                                             F.sum(F.log10(TREE * F.pow(F.lit(10.0), "spelled") + (1 - TREE) * share)).alias("total_more")))
    out = scored.join(looked, "row", "left")
    none = F.lit(0.0)
    return out.select(F.col("id").alias(id_column), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
                      (F.col("base") + F.coalesce("base_more", none)).alias("base_score"), (F.col("total") + F.coalesce("total_more", none)).alias("score"))
