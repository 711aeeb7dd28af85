"""Numbers the ranges that sampled splitters cut an order into."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_number(key: Column, splitters: list, kind: str) -> Column:
    """How many of the rising `splitters` (of SQL type `kind`) are at or before `key`: found in two steps of about sqrt(n)
    comparisons each."""
    step = max(1, math.isqrt(len(splitters)))
    blocks = [splitters[i:i + step] for i in range(0, len(splitters), step)]
    if not blocks:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(blocks)), f"array<array<{kind}>>")
    tops = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), f"array<{kind}>")
    block = F.size(F.filter(tops, lambda s: s <= key))
    inside = F.size(F.filter(F.element_at(table, F.greatest(block, F.lit(1))), lambda s: s <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)
