"""Embedding whitening from exact integer moments.

Entries become integers. Inside a task every dimension is shifted to start at zero and cut into bit planes; a plane's bits over
the rows are packed into 64-bit words. The cross-product of two dimensions is then the sum over pairs of their planes of
2^(p + q) times the number of rows where both bits are set, which an AND and a bit count give exactly. Tasks emit one exact
sum per pair of dimensions; grouped sums of these (as many as there are pairs, whatever the rows) are centred as integers,
and only their quotients by the number of rows become floating point numbers, of which the eigenvectors are taken.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import slices

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows that are packed at once: 128 words for each bit plane.
ROWS = 8192
#: Quantised entries lie within +-2^61, so that their differences are longs.
_LIMIT = 1 << 61
_LONG = (1 << 63) - 1
#: Sums travel as two decimals, value = high * 2^60 + low.
_PART, _SUM = 1 << 60, "decimal(38,0)"


def usable(df: DataFrame, vector_column: str) -> DataFrame:
    """Rows whose vector has only finite entries, `vector` as array<double>, and the length that most of them have (of equally common ones the
    largest). NULL and empty vectors, and those with NULL or non-finite entries, are left out, as are vectors of another length."""
    entry_ok = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = df.withColumn("vector", F.col(vector_column).cast("array<double>")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(entry_ok, F.lit(False)))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("vector") == (lengths["size"] if lengths else 0))


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1,000,000 as longs; beyond +-2^61 the nearest of these bounds."""
    scaled = np.floor(vectors * SCALE)
    return np.clip(scaled, -float(_LIMIT), float(_LIMIT)).astype(np.int64) + OFFSET


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
    return quantised(flat.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, 0), np.int64)


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact sums over rows of y_i * y_j for non-negative integers y (rows x dimensions), as Python integers."""
    n, d = y.shape
    bits = int(y.max(initial=0)).bit_length()
    planes, owner, power = [], [], []
    for p in range(bits):
        plane = ((y >> p) & 1).astype(np.uint8)
        some = np.flatnonzero(plane.any(axis=0))
        packed = np.packbits(plane[:, some].T, axis=1)
        words = np.zeros((len(some), -(-packed.shape[1] // 8) * 8), np.uint8)
        words[:, :packed.shape[1]] = packed
        planes.append(words.view(np.uint64))
        owner.append(some)
        power.append(np.full(len(some), p))
    total = np.zeros((d, d), object)
    if not planes:
        return total
    words, owner, power = np.concatenate(planes), np.concatenate(owner), np.concatenate(power)
    wide = 2 * bits + n.bit_length() >= 63
    sums = total if wide else np.zeros((d, d), np.int64)
    for r in range(len(words)):
        both = np.bitwise_count(words[r] & words[r:]).sum(axis=1, dtype=np.int64)
        weight = power[r] + power[r:]
        value = both.astype(object) * (1 << weight.astype(object)) if wide else both << weight
        # planes p and q of one dimension meet once here but twice in its square; of two dimensions their lower triangle is added below
        np.add.at(sums, (np.full(len(value), owner[r]), owner[r:]), value)
        if len(value) > 1:
            np.add.at(sums, (owner[r + 1:], np.full(len(value) - 1, owner[r])), value[1:])
    return sums.astype(object)


def _partial_sums(batches):
    """Rows (i, j, high, low): the value is the sum of x_i * x_j, or of x_i where j is -1, or the number of rows where i is -1."""
    n, first, second = 0, None, None
    for batch in slices(batches, ROWS):
        if not batch.num_rows:
            continue
        x = _matrix(batch)
        low = x.min(axis=0)
        y = x - low
        ones, low = y.astype(object).sum(axis=0) if y.max() > 1 << 48 else y.sum(axis=0).astype(object), low.astype(object)
        moved = np.multiply.outer(low, ones)
        products = cross_products(y) + moved + moved.T + x.shape[0] * np.multiply.outer(low, low)
        n += x.shape[0]
        first = ones + x.shape[0] * low if first is None else first + ones + x.shape[0] * low
        second = products if second is None else second + products
    if n:
        d = len(first)
        rows = [(-1, -1, n)] + [(i, -1, first[i]) for i in range(d)] + [(i, j, second[i, j]) for i in range(d) for j in range(i, d)]
        for at in range(0, len(rows), 50_000):
            i, j, value = zip(*rows[at:at + 50_000])
            parts = zip(*(divmod(int(v), _PART) for v in value))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())] + [pa.array(list(map(Decimal, p)), pa.decimal128(38, 0)) for p in parts], ["i", "j", "high", "low"])


@dataclass
class Whitening:
    """Exact moments and the components they give. `vectors` holds a unit eigenvector per column, `values` falls."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def sound(self) -> np.ndarray:
        """Components with an eigenvalue above rounding error; the others have no direction to speak of."""
        return self.values > max(self.trace, 0.0) * len(self.values) * np.finfo(float).eps


def fit(vectors: DataFrame) -> Whitening | None:
    """Components of the column `vector` (all of one length) of a table; None for an empty one. What reaches the driver is one sum
    per pair of dimensions."""
    rows = vectors.select("vector").mapInArrow(_partial_sums, f"i int, j int, high {_SUM}, low {_SUM}").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    if not rows:
        return None
    found = {(r["i"], r["j"]): int(r["high"]) * _PART + int(r["low"]) for r in rows}
    n, d = found[-1, -1], max(i for i, _ in found) + 1
    s = [found[i, -1] for i in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * found[i, j] - s[i] * s[j]) / (n * n)  # one rounding, of an exact quotient
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, s, columns[:, order], values[order], float(np.trace(covariance)))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exactly: longs where they fit, Python integers elsewhere."""
    base = [s // model.n for s in model.sums]
    rest = [s - b * model.n for s, b in zip(model.sums, base)]
    big = max(abs(int(x.max()) - min(base)), abs(int(x.min()) - max(base)), 1) * model.n + model.n > _LONG
    kind = object if big else np.int64
    return (x.astype(kind) - np.array(base, kind)) * model.n - np.array(rest, kind)


def _project(x: np.ndarray, model: Whitening, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, whitened): the projections over the square roots of the eigenvalues; NaN for components without a direction."""
    z = _centred(x, model)
    scale = np.full(k, np.nan)
    sound = model.sound[:k]
    scale[sound] = 1 / np.sqrt(model.values[:k][sound])
    return z, (z.astype(np.float64) / model.n) @ model.vectors[:, :k] * scale


def _deviation(z: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where one is no long."""
    if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 2.0 ** 62:
        return (z * z).sum(axis=1).tolist()
    return [v if v <= _LONG else None for v in (sum(int(c) ** 2 for c in row) for row in z)]


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with a direction: one pass for
    their means, one for the products of what is left; k and k^2 grouped sums."""
    sound = np.flatnonzero(model.sound[:k])
    if not len(sound):
        return 0.0
    sent = vectors.sparkSession.sparkContext.broadcast((model, k, sound))

    def passes(mean):
        def run(batches):
            model, k, sound = sent.value
            total = None
            for batch in slices(batches, ROWS):
                if batch.num_rows:
                    w = _project(_matrix(batch), model, k)[1][:, sound]
                    part = w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean)
                    total = part if total is None else total + part
            if total is not None:
                flat = total.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

        rows = vectors.select("vector").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        return np.array([r["value"] for r in sorted(rows)]) / model.n

    mean = passes(None)
    return float(np.abs(passes(mean).reshape(len(sound), len(sound)) - np.eye(len(sound))).max())


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of `df` and component (numbered from 1 by falling eigenvalue, at most `components`): id, component, n
    (rows), deviation (sum over dimensions of (n x - S)^2; NULL where that is no long), whitened, explained (share of the
    trace), identity_error.

    Which rows are usable: see `usable`. Repeated rows and NULL ids count like any others; an empty table, or one without
    usable rows, gives no rows; other columns are not read. Components whose eigenvalue is zero but for rounding, as with
    one row or constant dimensions, have no direction: whitened is NULL there and identity_error leaves them out."""
    rows = usable(df.select(F.col(id_column).alias("id"), F.col(vector_column).alias("given")), "given")
    kind = dict(df.dtypes)[id_column]
    model = fit(rows)
    if model is None:
        empty = f"{id_column} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], empty)
    k = min(components, len(model.values))
    error = identity_error(rows, model, k)
    sent = df.sparkSession.sparkContext.broadcast(model)
    explained = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches):
        for batch in slices(batches, ROWS):
            if batch.num_rows:
                z, w = _project(_matrix(batch), sent.value, k)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviation(z), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), from_pandas=True))], ["id", "deviation", "whitened"])

    white = rows.select("id", "vector").mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return (white.select(F.col("id").alias(id_column), "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(id_column, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
                    F.lit(error).alias("identity_error")))
