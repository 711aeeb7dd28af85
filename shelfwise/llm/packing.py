"""Packing of documents into sequences by the sum-of-squares rule.

A document's ids are cut into full windows, which are sequences of their own, and a remainder shorter than a window. Each
remainder goes, as it comes, to the fill level whose choice keeps the sum over levels of (open windows at that level)^2
least; the counts live in one array over the levels. At the end of a task the windows still open are poured together by
cutting, and what is then left, less than one window, is cut into powers of two, which need no padding. So a task's only
state is the array and the open windows; there is no shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import wordbpe
from shelfwise.llm.arrow import slices, texts

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Open windows that one task keeps at most; beyond it the fullest level is poured out by cutting, as at the end of a task.
OPEN_WINDOWS = 20_000

PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Packer:
    """Places pieces into windows and returns finished ones as (sequence number, [(piece, offset)])."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit = window, open_windows
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.level = np.zeros(window + 1, np.int64)
        self.n_open = 0

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of `size` < window into a window; the window if that filled it. Moving a window from level h to
        h + size changes the sum of squares by 2 * (level[h + size] - level[h] + 1); opening one adds
        2 * level[size] + 1; filling one up removes 2 * level[h] - 1."""
        fits = self.window - size
        change = 2 * (self.level[size:self.window + 1] - self.level[:fits + 1] + 1)
        change[fits] = 1 - 2 * self.level[fits]
        change[0] = 2 * self.level[size] + 1
        shut = self.level[:fits + 1] == 0
        shut[0] = False
        change[shut] = np.iinfo(np.int64).max
        best = int(fits - np.argmin(change[::-1]))  # of equal choices the fullest window
        if best:
            contents = self.open[best].pop()
            self.level[best] -= 1
            self.n_open -= 1
        else:
            contents = []
        contents.append((piece, best))
        if best + size == self.window:
            return contents
        self.open[best + size].append(contents)
        self.level[best + size] += 1
        self.n_open += 1
        return None

    def emptied(self) -> list[tuple]:
        """All pieces of open windows, which are then closed."""
        pieces = [piece for level in reversed(self.open) for contents in level for piece, _ in contents]
        self.open = [[] for _ in range(self.window)]
        self.level[:] = 0
        self.n_open = 0
        return pieces


def pour(pieces: list[tuple], window: int, sizes: list[int]):
    """Fill windows of the given `sizes`, then of `window`, with pieces (id, start, ids, doc tokens), cutting where a window is full.
    Yields windows as lists of (piece, offset); the last may be short."""
    sizes = list(reversed(sizes))
    room = sizes.pop() if sizes else window
    full, contents = room, []
    for doc, start, ids, total in pieces:
        while ids:
            part, ids = ids[:4 * room], ids[4 * room:]
            contents.append(((doc, start, part, total), full - room))
            start += len(part) // 4
            room -= len(part) // 4
            if not room:
                yield contents
                full = room = sizes.pop() if sizes else window
                contents = []
    if contents:
        yield contents


def powers(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `window` is a power of two. NULL
    and empty texts give the end id alone; repeated rows are packed each; an empty table gives no row. Other columns are
    not read. Sequence ids hold the task's number in their upper bits and are the same when a task runs again."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    tail = int(end_id).to_bytes(4, "little")

    def run(batches):
        packer, done, rows = Packer(window), TaskContext.get().partitionId() << 40, []

        def finish(contents):
            nonlocal done
            for (doc, start, ids, total), offset in contents:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, done, offset))
            done += 1

        def drain(last):
            pieces = packer.emptied()
            total = sum(len(p[2]) for p in pieces) // 4
            whole = total // window
            for contents in pour(pieces, window, [window] * whole + powers(total - whole * window)):
                finish(contents)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [p.split()[0] for p in PIECES.split(", ")])
            rows.clear()
            return out

        for batch in slices(batches):
            for doc, text in zip(batch.column("id").to_pylist(), texts(batch)):
                ids = wordbpe.encode(vocabulary, text) + tail
                total = len(ids) // 4
                cut = total - total % window
                for at in range(0, cut, window):
                    finish([((doc, at, ids[4 * at:4 * (at + window)], total), 0)])
                if cut < total:
                    filled = packer.place((doc, cut, ids[4 * cut:], total), total - cut)
                    if filled:
                        finish(filled)
                    if packer.n_open > packer.limit:
                        drain(False)
            if rows:
                yield flush()
        drain(True)
        if rows:
            yield flush()

    out = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, PIECES)
    return out.withColumnRenamed("id", id_column)
