"""Byte-level BPE with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. First tier: all pre-tokens of a batch are hashed at once and
looked up in a minimal perfect hash of the vocabulary; a pre-token that is itself a token has its id right there. Second tier: the
others are merged byte by byte with a heap of candidate pairs over a linked list, n log n for a pre-token of n bytes, and
kept in a bounded memo.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm import hashing
from shelfwise.llm.arrow import per_batch, texts
from shelfwise.llm.perfect_hash import PerfectHash
from shelfwise.llm.wordbpe import Memo

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class ByteBpe:
    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import regex
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        with open(name if os.path.isabs(name) else public_tokenizers.path(name), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        tokens = list(self.ranks)
        ends = np.cumsum([len(t) for t in tokens])
        keys = hashing.passages(np.frombuffer(b"".join(tokens), np.uint8), np.append(0, ends[:-1]), ends)
        self.hash = PerfectHash(keys)
        at = self.hash(keys)
        self.key, self.id = np.empty_like(keys), np.empty(len(keys), np.uint32)
        self.key[at], self.id[at] = keys, np.fromiter(self.ranks.values(), np.uint32)
        self.missed = Memo(lambda piece: np.array(self.merge(piece), "<u4").tobytes())

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair with the lowest rank merges first, the leftmost of equals."""
        n, ranks = len(piece), self.ranks
        after = list(range(1, n + 1))  # start of the next part, which is this part's end
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not live[i] or after[i] >= n or after[after[i]] != end:
                continue
            live[after[i]] = False
            after[i] = end
            if end < n:
                before[end] = i
                r = ranks.get(piece[i:after[end]])
                if r is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            j = before[i]
            if j >= 0:
                r = ranks.get(piece[j:end])
                if r is not None:
                    heapq.heappush(heap, (r, j, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def encode(self, rows: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        data, ends, first, size = [], [], [0], 0
        for text in rows:
            raw = text.encode()
            chars = np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), np.int64))
            if len(raw) != len(text):
                starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                chars = np.append(starts, len(raw))[chars]
            ends.append(chars + size)
            first.append(first[-1] + len(chars))
            data.append(raw)
            size += len(raw)
        whole = b"".join(data)
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        start = np.append(0, end[:-1])[:len(end)]
        keys = hashing.passages(np.frombuffer(whole, np.uint8), start, end)
        at = self.hash(keys)
        hit = (at >= 0) & (self.key[at] == keys)
        lost = np.flatnonzero(~hit)
        missed = [self.missed[whole[s:e]] for s, e in zip(start[lost].tolist(), end[lost].tolist())]
        count = np.ones(len(end), np.int64)
        count[lost] = [len(m) // 4 for m in missed]
        place = np.append(0, np.cumsum(count))
        ids = np.empty(place[-1], "<u4")
        single = np.zeros(len(ids), bool)
        single[place[:-1][hit]] = True
        ids[single] = self.id[at[hit]]
        ids[~single] = np.frombuffer(b"".join(missed), "<u4")
        cuts = place[first]
        return [ids[cuts[i]:cuts[i + 1]] for i in range(len(rows))]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def byte_bpe(name: str = VOCABULARY) -> ByteBpe:
    return ByteBpe(name)


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) per row; NULL and empty texts have no ids. Repeated rows give repeated results. Narrow: no shuffle."""

    def run(batch):
        return {"id": batch.column("id"), "ids": pa.array([x.view(np.int32) for x in byte_bpe(vocabulary).encode(texts(batch))], pa.list_(pa.int32()))}

    return per_batch(df, {"id": id_column, "text": text_column}, run, f"id {dict(df.dtypes)[id_column]}, ids array<int>").withColumnRenamed("id", id_column)


def decode(df: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, bytes binary) per row; NULL ids decode to no bytes."""

    def run(batch):
        return {"id": batch.column("id"), "bytes": pa.array([byte_bpe(vocabulary).decode(np.array(x or [], np.uint32)) for x in batch.column("ids").to_pylist()], pa.binary())}

    return per_batch(df, {"id": id_column, "ids": ids_column}, run, f"id {dict(df.dtypes)[id_column]}, bytes binary").withColumnRenamed("id", id_column)


def digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Encoding and decoding in one pass, as digests: id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded bytes
    are the text's)."""

    def run(batch):
        rows, bpe = texts(batch), byte_bpe(vocabulary)
        encoded = bpe.encode(rows)
        decoded = [bpe.decode(x) for x in encoded]
        return {"id": batch.column("id"), "n_tokens": pa.array([len(x) for x in encoded], "int64"), "ids_sha256": [sha256(x.tobytes()).hexdigest() for x in encoded],
                "decoded_sha256": [sha256(x).hexdigest() for x in decoded], "round_trip": [x == t.encode() for x, t in zip(decoded, rows)]}

    return per_batch(df, {"id": id_column, "text": text_column}, run,
                     f"id {dict(df.dtypes)[id_column]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_column)
