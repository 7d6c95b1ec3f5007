"""Heads with hidden layers, fitted in rounds and epochs with a written history.

A row has one vector per head. Each head is a perceptron of its own (ReLU between
layers); the logits of all heads side by side are one answer with one cross-entropy. A
round is one pass for all heads: every task adds up the gradient of its rows as one vector,
the vectors are added in two levels, and the driver sees their sum only.

Each epoch is a written row with its weights, the state of the optimiser and the metrics of
both sides, so a job that was stopped goes on after the last written epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from moodmill.session import durable

SEED = 228
FAN_IN = 16  # tasks of the first level of a sum
_SIDES = ("Train", "Val")
# The usual constants of the Adam optimiser.
_DECAY = (0.9, 0.999)
_EPSILON = 1e-8


@dataclass(frozen=True)
class HeadNetwork:
    """``heads`` perceptrons with layers ``sizes``, the input first, and all their weights as one vector.

    The vector has, per layer, the matrices of all heads (input by output, row by row), then
    their biases.
    """

    heads: int
    sizes: tuple[int, ...]
    weights: np.ndarray

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        pairs = zip(self.sizes, self.sizes[1:])
        return [s for a, b in pairs for s in ((self.heads, a, b), (self.heads, 1, b))]

    def layers(self) -> list[np.ndarray]:
        found = np.split(self.weights, np.cumsum([np.prod(s) for s in self.shapes])[:-1])
        return [w.reshape(s) for w, s in zip(found, self.shapes)]

    @classmethod
    def random(cls, heads: int, sizes: tuple[int, ...], seed: int = SEED) -> HeadNetwork:
        """Weights drawn from the seed, of a spread that falls with the number of inputs; biases are zero."""
        rng = np.random.default_rng(seed)
        empty = cls(heads, tuple(sizes), np.zeros(0))
        drawn = [rng.normal(0, np.sqrt(2 / s[1]), s) if i % 2 == 0 else np.zeros(s) for i, s in enumerate(empty.shapes)]
        return cls(heads, tuple(sizes), np.concatenate([d.ravel() for d in drawn]))

    def forward(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The input (heads x rows x dim), the output of every layer, each before the next one's matrix."""
        parts = self.layers()
        states = [vectors]
        for i in range(0, len(parts), 2):
            out = states[-1] @ parts[i] + parts[i + 1]
            states.append(np.maximum(out, 0) if i + 2 < len(parts) else out)
        return states

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        """Rows x (heads x outputs)."""
        out = self.forward(vectors)[-1]
        return out.transpose(1, 0, 2).reshape(out.shape[1], -1)

    def gradient(self, vectors: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the gradients of the cross-entropy, and per row the loss and whether the answer is right."""
        states = self.forward(vectors)
        rows = np.arange(len(target))
        out = states[-1].transpose(1, 0, 2).reshape(len(target), -1)
        loss, share = _cross_entropy(out, target)
        right = out.argmax(axis=1) == target
        share[rows, target] -= 1
        back = share.reshape(len(target), self.heads, -1).transpose(1, 0, 2)
        parts, found = self.layers(), []
        for i in range(len(parts) - 2, -1, -2):
            found += [back.sum(axis=1).ravel(), (states[i // 2].transpose(0, 2, 1) @ back).ravel()]
            if i:
                back = (back @ parts[i].transpose(0, 2, 1)) * (states[i // 2] > 0)
        return np.concatenate(found[::-1]), loss, right


def _cross_entropy(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logits.max(axis=1, keepdims=True)
    share = np.exp(logits - top)
    total = share.sum(axis=1, keepdims=True)
    own = logits[np.arange(len(target)), target]
    return np.log(total[:, 0]) + top[:, 0] - own, share / total


def side_by_side(features: DataFrame, keys: list[str], heads: int, vector: str = "vector", head: str = "head") -> DataFrame:
    """``keys, vectors``: the vectors of all heads of a row, from one row per head. A head that lacks is an error."""
    item = F.struct(F.col(head).alias("head"), F.col(vector).alias("vector"))
    # A group is the heads of one row.
    rows = features.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    whole = F.transform("_items", lambda x: x["head"]) == F.sequence(F.lit(0), F.lit(heads - 1))
    failed = F.raise_error(F.lit(f"a row does not have the heads 0 to {heads - 1} once each"))
    vectors = F.transform("_items", lambda x: x["vector"].cast("array<double>"))
    return rows.select(*keys, F.when(whole, vectors).otherwise(failed.cast("array<array<double>>")).alias("vectors"))


def _matrix(column: pa.ListArray, heads: int, dim: int) -> np.ndarray:
    """The vectors of a batch as heads x rows x dim."""
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * heads * dim:
        raise ValueError(f"rows do not have {heads} vectors of {dim} numbers")
    return flat.reshape(len(column), heads, dim).transpose(1, 0, 2)


def gradient_sums(rows: DataFrame, network: HeadNetwork) -> np.ndarray:
    """Gradient of the train rows; then number, loss and right answers of the train rows, and of the others.

    ``rows`` holds ``vectors, target, is_val``. Only the sum comes to the driver.
    """
    size = len(network.weights)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2 * 3)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0), network.heads, network.sizes[0])
            target = batch.column(1).to_numpy(zero_copy_only=False)
            is_val = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for side in (False, True):
                own = np.flatnonzero(is_val == side)
                if not len(own):
                    continue
                gradient, loss, right = network.gradient(vectors[:, own], target[own])
                if not side:
                    total[:size] += gradient
                total[size + 3 * side : size + 3 * side + 3] += len(own), loss.sum(), right.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2 * 3)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    each = rows.select("vectors", "target", "is_val").mapInArrow(of_task, "sums binary")
    first = each.repartition(FAN_IN).mapInArrow(added, "sums binary")
    return np.frombuffer(bytes(first.repartition(1).mapInArrow(added, "sums binary").first().sums))


class History:
    """The epochs of one fit in a folder: each is written once when it is done."""

    _SCHEMA = (
        "epoch int, heads int, sizes array<int>, weights array<double>, momentum array<double>, spread array<double>, "
        "steps int, metrics array<struct<loop:string,n:bigint,loss:double,top1:double>>"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.epochs = 0
        while self._done(self.epochs):
            self.epochs += 1

    def _at(self, epoch: int) -> str:
        return f"{self.path}/{epoch:05d}"

    def _done(self, epoch: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(epoch)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def write(self, *row) -> None:
        self.spark.createDataFrame([(self.epochs, *row)], self._SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            self._at(self.epochs)
        )
        self.epochs += 1

    def read(self, epoch: int):
        return self.spark.read.schema(self._SCHEMA).parquet(self._at(epoch)).first()

    def network(self, epoch: int) -> HeadNetwork:
        row = self.read(epoch)
        return HeadNetwork(row.heads, tuple(row.sizes), np.array(row.weights))

    def table(self) -> DataFrame:
        """``epoch, loop, n, loss, top1, is_best``: a row per epoch and side; best is the first with the least loss of ``Val``."""
        if not self.epochs:
            return self.spark.createDataFrame([], "epoch int, loop string, n bigint, loss double, top1 double, is_best boolean")
        rows = self.spark.read.schema(self._SCHEMA).parquet(*map(self._at, range(self.epochs)))
        flat = rows.select("epoch", F.inline("metrics"))
        best = self.best_epoch()
        return flat.select("*", F.coalesce(F.col("epoch") == F.lit(best), F.lit(False)).alias("is_best"))

    def best_epoch(self) -> int | None:
        """The first epoch with the least loss of the validation side; None without one. A row per epoch is read."""
        found = []
        for epoch in range(self.epochs):
            loss = {m.loop: m.loss for m in self.read(epoch).metrics}["Val"]
            if loss is not None:
                found.append((loss, epoch))
        return min(found)[1] if found else None


def fit_epochs(
    rows: DataFrame, heads: int, sizes: tuple[int, ...], path: str, epochs: int, rounds: int = 5, rate: float = 0.01,
    seed: int = SEED, start: HeadNetwork | None = None,
) -> History:
    """Fit up to ``epochs`` epochs of ``rounds`` rounds each on ``vectors, target, is_val``; returns the history at ``path``.

    Epochs that the folder holds are not fitted again; the fit goes on with the last one's weights and
    state. ``start`` gives the first weights, otherwise the seed does. Rows whose
    target or vectors are null, wholly or in part, are left out. Without train rows the weights stay; a side
    without rows has null metrics. A target outside the logits is an error.
    """
    spark = rows.sparkSession
    history = History(spark, path)
    if history.epochs >= epochs:
        return history
    holes = F.exists("vectors", lambda v: v.isNull() | F.exists(v, lambda x: x.isNull()))
    whole = rows.where(F.col("target").isNotNull() & F.col("vectors").isNotNull() & ~holes)
    answers = heads * sizes[-1]
    bad = (F.col("target") < 0) | (F.col("target") >= answers)
    checked = F.when(bad, F.raise_error(F.lit(f"a target is not below {answers}")).cast("int")).otherwise(
        F.col("target").cast("int")
    )
    kept = durable(
        whole.select(
            F.col("vectors").cast("array<array<double>>").alias("vectors"), checked.alias("target"),
            F.coalesce("is_val", F.lit(False)).alias("is_val"),
        ),
        "training-rows",
    )
    if history.epochs:
        last = history.read(history.epochs - 1)
        network = history.network(history.epochs - 1)
        momentum, spread, steps = np.array(last.momentum), np.array(last.spread), last.steps
        if (network.heads, network.sizes) != (heads, tuple(sizes)):
            raise ValueError("the folder holds the history of another network")
    else:
        network = start or HeadNetwork.random(heads, tuple(sizes), seed)
        momentum, spread, steps = np.zeros_like(network.weights), np.zeros_like(network.weights), 0
    sums = gradient_sums(kept, network)
    while history.epochs < epochs:
        for _ in range(rounds):
            gradient = sums[: len(network.weights)] / max(1.0, sums[len(network.weights)])
            steps += 1
            momentum = _DECAY[0] * momentum + (1 - _DECAY[0]) * gradient
            spread = _DECAY[1] * spread + (1 - _DECAY[1]) * gradient**2
            step = momentum / (1 - _DECAY[0] ** steps) / (np.sqrt(spread / (1 - _DECAY[1] ** steps)) + _EPSILON)
            network = HeadNetwork(heads, tuple(sizes), network.weights - rate * step)
            # One pass gives the metrics of these weights and the gradient of the next round.
            sums = gradient_sums(kept, network)
        metrics = []
        for side, (n, loss, right) in zip(_SIDES, sums[len(network.weights) :].reshape(2, 3).tolist()):
            metrics.append((side, int(n), loss / n if n else None, 100 * right / n if n else None))
        history.write(
            heads, list(map(int, sizes)), network.weights.tolist(), momentum.tolist(), spread.tolist(), steps, metrics
        )
    return history


def network_predict(network: HeadNetwork, rows: DataFrame) -> DataFrame:
    """Add ``logits`` and ``prediction`` to rows with ``vectors``; both are null where a vector lacks."""
    holes = F.exists("vectors", lambda v: v.isNull() | F.exists(v, lambda x: x.isNull()))
    whole = F.coalesce(F.col("vectors").isNotNull() & ~holes, F.lit(False))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(names.index("vectors")), network.heads, network.sizes[0])
            logits = network.logits(vectors)
            columns = [*batch.columns, pa.array(list(logits), pa.list_(pa.float64())), pa.array(logits.argmax(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "logits", "prediction"])

    doubles = rows.withColumn("vectors", F.col("vectors").cast("array<array<double>>"))
    out = StructType([*doubles.schema.fields, StructField("logits", ArrayType(DoubleType())), StructField("prediction", IntegerType())])
    rest = doubles.where(~whole).withColumn("logits", F.lit(None).cast("array<double>")).withColumn(
        "prediction", F.lit(None).cast("int")
    )
    return doubles.where(whole).mapInArrow(run, out).unionByName(rest)
