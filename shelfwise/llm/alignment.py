"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which ids go with which.

Both encodings of a text cover the same bytes, so each is a rising list of end offsets. The shorter list drives a galloping
intersection: from its proportional place in the longer list every end is searched in exponential steps and then by halves
between the last two. Common ends cut the text into groups of tokens, and the difference of two neighbouring ranks is the
range of the other side's tokens that a token overlaps.

Two tokens that end together are linked; the bytes of one are then a suffix of the other's. So the pairs that can ever be
linked follow from the vocabularies alone: they are numbered once, corpus-wide counts are a vector of that length (some
hundred thousand numbers, whatever the corpus), and documents refer to pairs by number.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.arrow import per_batch, texts
from shelfwise.llm.wordbpe import _byte_symbols, load
from shelfwise.sources.stage import stage

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
#: Unbroken white space of this length makes the pattern engine of the fast encoder give up; such texts go to the other one.
_LONG_SPACE = 10_000


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the pairs of ids that can end together."""

    def __init__(self, a_name: str, b_name: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = load(a_name)
        self.library.encode_special_tokens = True
        spec = json.loads(self.library.to_str())
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(_byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # The merges of this vocabulary come in the order of its ids, so ids serve as ranks; the encoder is the same but faster.
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_name if os.path.isabs(b_name) else public_tokenizers.path(b_name))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.pieces.get_piece_size()) for p in (self.pieces.id_to_piece(i),)]
        self.a_size, self.b_size = np.array([len(t) for t in self.a_bytes]), np.array([len(t) for t in self.b_bytes])
        self.pairs = self._pairs()
        # Each id as text with what follows it inside a group and at its end: A inside, A last, B inside, B last.
        a, b = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.shown = np.array([x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b], object)

    def _pairs(self) -> np.ndarray:
        """Rising keys a * (size of B) + b of all pairs of ids where the bytes of one are a suffix of the other's."""
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for index, tokens in ((of_a, self.a_bytes), (of_b, self.b_bytes)):
            for i, token in enumerate(tokens):
                if token:
                    index.setdefault(token, []).append(i)
        width = len(self.b_bytes)
        found = {a * width + b for token, ids in of_a.items() for at in range(len(token)) for b in of_b.get(token[at:], ()) for a in ids}
        found |= {a * width + b for token, ids in of_b.items() for at in range(len(token)) for a in of_a.get(token[at:], ()) for b in ids}
        return np.array(sorted(found), np.int64)

    def encode(self, rows: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; none where either side's bytes are not those of a space and the text."""
        none = np.zeros(0, np.int64)
        out = []
        for text, b in zip(rows, self.pieces.encode_as_ids(rows)):
            if not text:
                out.append((none, none))
                continue
            whole = " " + text
            raw = whole.encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                out.append((none, none))
                continue
            a = self._a(whole)
            same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw
            out.append((a, np.array(b, np.int64)) if same else (none, none))
        return out

    def _a(self, whole: str) -> np.ndarray:
        if len(whole) >= _LONG_SPACE and any(len(run) >= _LONG_SPACE for run in _spaces(whole)):
            return np.array(self.library.encode(whole, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(whole, allowed_special=set(), disallowed_special=()).astype(np.int64)


def _spaces(text: str):
    import re
    return re.findall(r"\s{%d,}" % _LONG_SPACE, text)


@lru_cache(maxsize=1)
def vocabularies(a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY) -> Vocabularies:
    return Vocabularies(a_name, b_name)


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many values of `long` are below each of `short` (both rise). Every search leaves its own place `start` in steps
    that double until the value is passed, then halves what lies between; all searches advance together."""
    n = len(long)
    low, high = np.full(len(short), -1, np.int64), np.full(len(short), n, np.int64)
    if not n:
        return np.zeros(len(short), np.int64)
    start = np.clip(start, 0, n - 1)
    right = long[start] < short
    low[right], high[~right] = start[right], start[~right]
    for open_, sign in ((np.flatnonzero(right), 1), (np.flatnonzero(~right), -1)):
        step = 1
        while len(open_):
            at = start[open_] + sign * step
            inside = (at < n) if sign > 0 else (at >= 0)
            open_, at = open_[inside], at[inside]
            below = long[at] < short[open_]
            low[open_[below]], high[open_[~below]] = at[below], at[~below]
            open_ = open_[below if sign > 0 else ~below]
            step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        at = (low[open_] + high[open_]) // 2
        below = long[at] < short[open_]
        low[open_[below]], high[open_[~below]] = at[below], at[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


class Aligned:
    """The alignment of a batch of texts, laid end to end: each text's tokens of both sides cover the same bytes."""

    def __init__(self, encoded: list[tuple[np.ndarray, np.ndarray]], v: Vocabularies):
        none = [np.zeros(0, np.int64)]
        self.a, self.b = (np.concatenate(none + [e[side] for e in encoded]) for side in (0, 1))
        self.a_first, self.b_first = (np.append(0, np.cumsum([len(e[side]) for e in encoded], dtype=np.int64)) for side in (0, 1))
        a_ends, b_ends = np.cumsum(v.a_size[self.a]), np.cumsum(v.b_size[self.b])
        # the shorter list drives
        self.driver = "a" if len(a_ends) <= len(b_ends) else "b"
        sides = ((a_ends, self.a_first), (b_ends, self.b_first))
        (short, s_first), (long, l_first) = sides if self.driver == "a" else sides[::-1]
        doc = np.repeat(np.arange(len(encoded)), np.diff(s_first))
        place = np.arange(len(short)) - s_first[doc]
        start = l_first[doc] + place * np.diff(l_first)[doc] // np.maximum(1, np.diff(s_first)[doc])
        rank = gallop(short, long, start)
        common = rank < len(long)
        common[common] = long[rank[common]] == short[common]
        mine, other = np.flatnonzero(common), rank[common]
        self.a_common, self.b_common = (mine, other) if self.driver == "a" else (other, mine)
        # A driving token overlaps the other side's tokens from the first that ends after its start to the first that ends at or after its end.
        self.overlap_from = np.append(0, (rank + common)[:-1])[:len(rank)]
        self.overlap_to = rank
        self.s_first, self.l_first = s_first, l_first
        self.groups = np.searchsorted(self.a_common, self.a_first)  # first group of each text, then their number


def _ints(values, offsets):
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def align(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> DataFrame:
    """One row per row of `df`: id; a_ids, b_ids (space + text by A, text by B); a_cuts, b_cuts (places of the tokens that end
    together: the last ones of each group); driver ('a' or 'b': the side whose ends were searched in the other's) and
    overlap_from, overlap_to (for each driving token the first and last place of the other side's tokens it overlaps).

    Texts that are NULL, empty, or that one side does not give back byte by byte have no tokens. Repeated rows give repeated
    results, NULL ids stay, an empty table gives no rows, and columns of other names are not read. Narrow: no shuffle."""

    def run(batch):
        v = vocabularies(a_vocabulary, b_vocabulary)
        x = Aligned(v.encode(texts(batch)), v)
        doc_a, doc_l = np.repeat(x.a_first[:-1], np.diff(x.groups)), np.repeat(x.l_first[:-1], np.diff(x.s_first))
        doc_b = np.repeat(x.b_first[:-1], np.diff(x.groups))
        return {"id": batch.column("id"), "a_ids": _ints(x.a, x.a_first), "b_ids": _ints(x.b, x.b_first), "a_cuts": _ints(x.a_common - doc_a, x.groups),
                "b_cuts": _ints(x.b_common - doc_b, x.groups), "driver": [x.driver] * batch.num_rows,
                "overlap_from": _ints(x.overlap_from - doc_l, x.s_first), "overlap_to": _ints(x.overlap_to - doc_l, x.s_first)}

    arrays = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_cuts", "b_cuts"))
    schema = f"id {dict(df.dtypes)[id_column]}, {arrays}, driver string, overlap_from array<int>, overlap_to array<int>"
    return per_batch(df, {"id": id_column, "text": text_column}, run, schema).withColumnRenamed("id", id_column)


def linked(df: DataFrame, id_column: str, text_column: str, a_vocabulary: str, b_vocabulary: str) -> DataFrame:
    """(id, n_a, n_b, groups_sha256, links) per row; links are numbers of pairs, in order. Narrow."""

    def run(batch):
        v = vocabularies(a_vocabulary, b_vocabulary)
        x = Aligned(v.encode(texts(batch)), v)
        keys = x.a[x.a_common] * len(v.b_bytes) + x.b[x.b_common]
        digests = _group_digests(x, v)
        return {"id": batch.column("id"), "n_a": pa.array(np.diff(x.a_first)), "n_b": pa.array(np.diff(x.b_first)), "groups_sha256": digests,
                "links": _ints(np.searchsorted(v.pairs, keys), x.groups)}

    schema = f"id {dict(df.dtypes)[id_column]}, n_a bigint, n_b bigint, groups_sha256 string, links array<int>"
    return per_batch(df, {"id": id_column, "text": text_column}, run, schema)


def _group_digests(x: Aligned, v: Vocabularies) -> list[str]:
    """Digest of `a1,a2|b1;a3|b2,b3` per text; '' without tokens."""
    na, nb = len(v.a_bytes), len(v.b_bytes)
    a_last, b_last = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
    a_last[x.a_common], b_last[x.b_common] = True, True
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_before, b_before = np.append(0, x.a_common + 1), np.append(0, x.b_common + 1)  # tokens in earlier groups
    order = np.empty(len(x.a) + len(x.b), np.int64)
    order[np.arange(len(x.a)) + b_before[a_group]] = x.a + na * a_last
    order[np.arange(len(x.b)) + a_before[b_group + 1]] = x.b + 2 * na + nb * b_last
    shown = v.shown[order].tolist()
    cuts = (x.a_first + x.b_first).tolist()
    return [sha256("".join(shown[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(cuts, cuts[1:])]


def link_counts(links: DataFrame, a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> DataFrame:
    """(pair, a_id, b_id, n, best) of all pairs in the `links` column of `links`: n links hold the pair; best says whether no
    other A id has more with its B id. Tasks count in one vector each, so the shuffle follows the vocabularies."""

    def count(batches):
        v = vocabularies(a_vocabulary, b_vocabulary)
        total = np.zeros(len(v.pairs), np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
        pair = np.flatnonzero(total)
        a, b = np.divmod(v.pairs[pair], len(v.b_bytes))
        for at in range(0, len(pair), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part].astype(t)) for x, t in ((pair, np.int32), (a, np.int32), (b, np.int32), (total[pair], np.int64))], ["pair", "a_id", "b_id", "n"])

    counted = links.select("links").mapInArrow(count, "pair int, a_id int, b_id int, n bigint").groupBy("pair", "a_id", "b_id").agg(F.sum("n").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> DataFrame:
    """One row per row of `df`: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of an A and a B token that end at the same byte, so every group has one; its count is the number of links
    of all texts with the same two ids, and it is best when no other A id has a higher count with that B id (ties are all
    best). Odd input is treated as in `align`: texts without tokens have zeros and an empty digest; an empty table gives no rows."""
    spark = df.sparkSession
    rows = stage(linked(df, id_column, text_column, a_vocabulary, b_vocabulary), "linked")
    # At most as many rows as there are suffix pairs of the two vocabularies, however large the corpus.
    counts = link_counts(rows, a_vocabulary, b_vocabulary).select("pair", "n", "best").toArrow()
    size = len(vocabularies(a_vocabulary, b_vocabulary).pairs)
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    pair = counts.column("pair").to_numpy()
    n[pair], best[pair] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    sent = spark.sparkContext.broadcast((n, best))

    def run(batch):
        n, best = sent.value
        links = batch.column("links")
        size = links.value_lengths().to_numpy(zero_copy_only=False)
        cuts = np.append(0, np.cumsum(size))
        pair = links.flatten().to_numpy()
        sums = [np.append(0, np.cumsum(table[pair]))[cuts] for table in (best, n)]
        return {"id": batch.column("id"), "n_a": batch.column("n_a"), "n_b": batch.column("n_b"), "n_groups": pa.array(size, pa.int64()), "n_links": pa.array(size, pa.int64()),
                "n_best": pa.array(np.diff(sums[0])), "count_sum": pa.array(np.diff(sums[1])), "groups_sha256": batch.column("groups_sha256")}

    schema = f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) + ", groups_sha256 string"
    return per_batch(rows, {c: c for c in rows.columns}, run, schema).withColumnRenamed("id", id_column)
