"""Perceptrons: fitted on rows of any number, as a Column with weights that SQL can repeat, and over whole batches.

The Column is for small networks and for checks; wide ones score faster by batches (`scored`).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLAB = 1 << 10  # rows of a batch that go through the network together
_PACKED = 64  # rows that are kept as one
_MEMORY = 10  # steps that L-BFGS remembers


@dataclass(frozen=True)
class Perceptron:
    """Inputs are centred and scaled, hidden layers are logistic, and the two last outputs compete as in softmax. A layer is
    (weights by output and input, biases)."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    layers: tuple[tuple[tuple[tuple[float, ...], ...], tuple[float, ...]], ...]

    def score(self, inputs: list[Column]) -> Column:
        """Probability of the second class; NULL where an input is NULL."""
        if len(inputs) != len(self.mean):
            raise ValueError(f"the model has {len(self.mean)} inputs, not {len(inputs)}")
        x = F.array(*[(c.cast("double") - m) * s for c, m, s in zip(inputs, self.mean, self.scale)])
        for weights, biases in self.layers[:-1]:
            x = F.transform(_layer(x, weights, biases), lambda z: 1 / (1 + F.exp(-z)))
        last = _layer(x, *self.layers[-1])
        return 1 / (1 + F.exp(last[0] - last[1]))

    def scored(self, rows: DataFrame, inputs: list[str], keep: list[str], name: str = "model_score") -> DataFrame:
        """The columns `keep` of `rows` and the probability of the second class. An input that is NULL fails the job."""
        if len(inputs) != len(self.mean):
            raise ValueError(f"the model has {len(self.mean)} inputs, not {len(inputs)}")
        mean, scale = np.array(self.mean), np.array(self.scale)
        layers = [(np.array(w).T, np.array(b)) for w, b in self.layers]

        def run(batches):
            for batch in batches:
                x = (_columns(batch, inputs) - mean) * scale
                p = np.empty(len(x))
                for start in range(0, len(x), _SLAB):
                    last = _activations(x[start:start + _SLAB], layers)[-1]
                    p[start:start + _SLAB] = _logistic(last[:, 1] - last[:, 0])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p)], names=[*keep, name])

        kinds = dict(rows.dtypes)
        picked = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in inputs])
        return picked.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keep], f"{name} double"]))


def _layer(x: Column, weights, biases) -> Column:
    rows = F.from_json(F.lit(json.dumps([[*map(float, row), float(bias)] for row, bias in zip(weights, biases)])), "array<array<double>>")
    # each row is the weights of one output and, behind them, its bias
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, F.concat(x, F.array(F.lit(1.0))), lambda w, v: w * v), F.lit(0.0), lambda a, b: a + b))


def compiled(model: PipelineModel) -> Perceptron:
    """From a fitted pipeline of assembler, scaler and multilayer perceptron."""
    _, scaler, net = model.stages
    sizes, flat = net.getLayers(), net.weights.toArray().tolist()
    mean = scaler.mean.toArray().tolist() if scaler.getWithMean() else [0.0] * sizes[0]
    scale = [1 / s if s else 0.0 for s in scaler.std.toArray().tolist()] if scaler.getWithStd() else [1.0] * sizes[0]
    layers, at = [], 0
    for inputs, outputs in zip(sizes, sizes[1:]):
        # stored input by input, all outputs of one input together, then the biases
        weights = tuple(tuple(flat[at + i * outputs + o] for i in range(inputs)) for o in range(outputs))
        at += inputs * outputs
        layers.append((weights, tuple(flat[at:at + outputs])))
        at += outputs
    return Perceptron(tuple(mean), tuple(scale), tuple(layers))


# --- fitting -------------------------------------------------------------------------------------
def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
    if np.isnan(x).any():
        raise ValueError("an input of the network is NULL or not a number")
    return x


def _logistic(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # an exponential beyond the type's range gives the limit 0
        return 1 / (1 + np.exp(-z))


def _activations(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Inputs, the output of every hidden layer, and the last layer before its softmax. Weights are (inputs, outputs)."""
    out = [x]
    for n, (w, b) in enumerate(layers, 1):
        z = out[-1] @ w + b
        out.append(_logistic(z) if n < len(layers) else z)
    return out


def _unpacked(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for inputs, outputs in zip(sizes, sizes[1:]):
        layers.append((flat[at:at + inputs * outputs].reshape(inputs, outputs), flat[at + inputs * outputs:at + (inputs + 1) * outputs]))
        at += (inputs + 1) * outputs
    return layers


def _loss_and_gradient(x: np.ndarray, second: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Sum of the cross entropy over rows, and its gradient; `second` is true for rows of the second class."""
    acts = _activations(x, layers)
    margin = (acts[-1][:, 1] - acts[-1][:, 0]).astype(np.float64)
    loss = np.logaddexp(0.0, np.where(second, -margin, margin)).sum()
    off = (_logistic(margin) - second).astype(x.dtype)
    delta, parts = np.column_stack([-off, off]), []
    for n in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(acts[n].T @ delta).ravel(), delta.sum(axis=0)]).astype(np.float64))
        if n:
            delta = (delta @ layers[n][0].T) * acts[n] * (1 - acts[n])
    return loss, np.concatenate(parts[::-1])


def _lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tolerance: float) -> np.ndarray:
    """Minimum of `value` by limited-memory quasi-Newton steps, each shortened until it lowers the value enough."""
    x, (f, g) = start, value(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        d, kept = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d -= a * y
            kept.append(a)
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y), a in zip(steps, reversed(kept)):
            d += (a - (y @ d) / (s @ y)) * s
        slope, length = -(g @ d), 1.0
        while True:
            nx = x - length * d
            nf, ng = value(nx)
            if nf <= f + 1e-4 * length * slope or length < 1e-3:
                break
            length /= 2
        if not nf < f:
            break
        s, y = nx - x, ng - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[1 - _MEMORY:], (s, y)]
        done = f - nf <= tolerance * max(abs(f), abs(nf))
        x, f, g = nx, nf, ng
        if done:
            break
    return x


def _packed(rows: np.ndarray) -> pa.Array:
    """The bytes of the rows of a matrix, `_PACKED` rows a value."""
    rows = np.ascontiguousarray(rows)
    at = np.minimum(np.arange(0, len(rows) + _PACKED, _PACKED), len(rows)) * (rows.nbytes // max(1, len(rows)))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(rows)])


def _unpacked_rows(values: pa.Array, kind: type) -> np.ndarray:
    _, at, data = values.buffers()
    ends = np.frombuffer(at, np.int32)[[values.offset, values.offset + len(values)]]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[1]].view(kind)


def _moments(rows: DataFrame, inputs: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and sample standard deviations; the sums of each task are merged pairwise, without cancellation."""
    def run(batches):
        for batch in batches:
            x = _columns(batch, inputs)
            if len(x):
                mean = x.mean(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in (mean, ((x - mean) ** 2).sum(axis=0))]], names=["n", "mean", "m2"])

    def merge(batches):
        n, mean, m2 = 0, np.zeros(len(inputs)), np.zeros(len(inputs))
        for batch in batches:
            for r in batch.to_pylist():
                step, total = np.array(r["mean"]) - mean, n + r["n"]
                m2 += np.array(r["m2"]) + step ** 2 * (n * r["n"] / total)
                mean, n = mean + step * (r["n"] / total), total
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m2.tolist()], pa.list_(pa.float64()))], names=["n", "mean", "m2"])

    kind = "n bigint, mean array<double>, m2 array<double>"
    sums = rows.select(*inputs).mapInArrow(run, kind)
    one = sums.mapInArrow(merge, kind).where("n > 0").coalesce(1).mapInArrow(merge, kind).first()  # a row per task before the last step
    return one["n"], np.array(one["mean"]), np.sqrt(np.array(one["m2"]) / max(one["n"] - 1, 1))


def fit(rows: DataFrame, inputs: list[str], label: str, hidden: tuple[int, ...], max_iter: int, seed: int, tolerance: float = 1e-6) -> Perceptron:
    """A network with logistic hidden layers and two outputs on the standardised `inputs`, by full-batch L-BFGS: every step adds up
    the gradient of all rows in Spark tasks. `label` is 0 or 1.

    Rows are kept packed, scaled and as single-precision bytes, and go through the network in matrices; sums over rows
    are in double precision. The driver gets one sum per partition of the kept rows, of which there are at most as many as tasks at a time."""
    spark = rows.sparkSession
    picked = rows.select((F.col(label) > 0).alias(label), *[F.col(c).cast("double").alias(c) for c in inputs])
    n, mean, spread = _moments(picked, inputs)
    width = len(inputs)
    if n == 0:
        raise ValueError("no rows to fit a perceptron on")
    scale = np.divide(1.0, spread, out=np.zeros(width), where=spread > 0)
    sizes = [width, *hidden, 2]

    def pack(batches):
        for batch in batches:
            x = ((_columns(batch, inputs) - mean) * scale).astype(np.float32)
            second = batch.column(label).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([_packed(x), _packed(second)], names=["x", "second"])

    kept = picked.mapInArrow(pack, "x binary, second binary").coalesce(spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def add(batches):
            layers = [(w.astype(np.float32), b.astype(np.float32)) for w, b in _unpacked(flat, sizes)]
            loss, gradient = 0.0, np.zeros(len(flat))
            for batch in batches:
                x = _unpacked_rows(batch.column("x"), np.float32).reshape(-1, width)
                second = _unpacked_rows(batch.column("second"), np.uint8) > 0
                for start in range(0, len(x), _SLAB):
                    part, g = _loss_and_gradient(x[start:start + _SLAB], second[start:start + _SLAB], layers)
                    loss, gradient = loss + part, gradient + g
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"])

        sums = kept.mapInArrow(add, "loss double, gradient binary").collect()  # one row per partition of the kept rows
        return sum(r["loss"] for r in sums) / n, sum(np.frombuffer(bytes(r["gradient"])) for r in sums) / n

    rng = np.random.default_rng(seed)  # the range of starting weights is Glorot's for logistic units
    start = np.concatenate([np.concatenate([4 * rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(sizes, sizes[1:])])
    try:
        best = _lbfgs(value, start, max_iter, tolerance)
    finally:
        kept.unpersist()
    layers = tuple((tuple(map(tuple, w.T.tolist())), tuple(b.tolist())) for w, b in _unpacked(best, sizes))
    return Perceptron(tuple(mean.tolist()), tuple(scale.tolist()), layers)
