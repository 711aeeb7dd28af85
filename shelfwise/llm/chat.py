"""Conversations formatted by a compiled template, and read back from the formatted text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import slices
from shelfwise.llm.templates import Template

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Marks that a text may not hold as they are: this template's own and those common elsewhere.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (f"{{% for m in messages %}}{TURN}{{{{ m.role | escape }}}}{BODY}"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
            f"{END}{{% endfor %}}")
#: Characters after which a conversation's output continues in another row, at the end of a turn.
PART_CHARS = 1 << 20

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles backslashes, then puts one behind the first character of each control string; `unescape` is its inverse."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def _template(source: str) -> Template:
    return Template(source, {"escape": escape, "trim": str.strip})


def format_conversations(df: DataFrame, template: str = TEMPLATE, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, part, formatted, learn): a conversation's output in order of `part` (one row but for very long ones), and the spans
    [start, end) of `formatted`, in code points, under the loss mask.

    Turns go by number, then role and text, so repeated rows and ties are kept in a defined order; NULL turns come first,
    NULL roles and texts count as empty, and rows with a NULL conversation are one. An empty table gives no rows. One shuffle, by conversation;
    a task streams its conversations and holds one part at a time."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(conversation).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        compiled = _template(template)
        each = (r for b in slices(batches) for r in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text")]))
        for conv, turns in groupby(each, key=lambda r: r[0]):
            part, out, spans, size = 0, [], [], 0
            for piece, learn in compiled.render({"role": r, "text": t} for _, r, t in turns):
                out.append(piece)
                if learn:
                    spans.append([size, size + len(piece)])
                size += len(piece)
                if size >= PART_CHARS and piece.endswith(END) and not learn:
                    yield _part(conv, part, out, spans)
                    part, out, spans, size = part + 1, [], [], 0
            if out or not part:
                yield _part(conv, part, out, spans)

    return rows.mapInArrow(lambda batches: _gathered(run(batches)), "conv_id bigint, part int, formatted string, learn array<array<int>>")


def _part(conv, part, out, spans):
    return conv, part, "".join(out), spans


def _gathered(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 1 << 20:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _batch(rows):
    types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "part", "formatted", "learn"])


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in a formatted text."""
    for turn in formatted.split(END)[:-1]:
        role, _, body = turn.removeprefix(TURN).partition(BODY)
        yield unescape(role), unescape(body)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rows of `format_conversations` as they stand: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. No shuffle: a conversation's parts follow each other in one task."""

    def run(batches):
        done = []
        each = (r for b in slices(batches) for r in zip(*[b.column(c).to_pylist() for c in ("conv_id", "formatted", "learn")]))
        for conv, parts in groupby(each, key=lambda r: r[0]):
            turns, loss, n, chars, size = sha256(), sha256(), 0, 0, 0
            for _, text, spans in parts:
                size += len(text)
                for role, body in turns_of(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for start, end in spans:
                    learned = unescape(text[start:end])
                    chars += len(learned)
                    loss.update(learned.encode())
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(done) == 1000:
                yield _digests(done)
                done = []
        yield _digests(done)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digests(rows):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if "sha" in n else pa.int64()) for i, n in enumerate(names)], names)
