"""Loss, accuracy and training history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from moodmill.functions.vectors import log_sum_exp
from moodmill.operators.ordering import prefix_scan

# Fixed value: the score that the first epoch has to beat.
START_SCORE = 100000.0


def _loss(logits: Column, target: Column) -> Column:
    return log_sum_exp(logits) - F.element_at(logits, target + 1).cast("double")


def _in_top(logits: Column, target: Column, k: int) -> Column:
    own = F.element_at(logits, target + 1)
    above = F.filter(logits, lambda x, i: (x > own) | ((x == own) & (i < target)))
    return own.isNotNull() & (F.size(above) < k)


def cross_entropy(df: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    """One row: mean ``loss`` over all rows, and ``n``."""
    return df.agg(F.avg(_loss(F.col(logits), F.col(target))).alias("loss"), F.count("*").alias("n"))


def topk_accuracy(
    df: DataFrame, ks: tuple[int, ...] = (1, 3), logits: str = "logits", target: str = "target"
) -> DataFrame:
    """One row: percent of rows whose target is among the ``k`` highest logits, as ``top<k>``."""
    return df.agg(
        *[
            (F.avg(_in_top(F.col(logits), F.col(target), k).cast("int")) * 100).alias(f"top{k}")
            for k in ks
        ]
    )


def batch_metrics(
    df: DataFrame, keys: list[str], logits: str = "logits", target: str = "target"
) -> DataFrame:
    """Per batch: ``loss, top1, top3`` and the number of rows ``n``."""
    z, t = F.col(logits), F.col(target)
    return df.groupBy(*keys).agg(
        F.avg(_loss(z, t)).alias("loss"),
        (F.avg(_in_top(z, t, 1).cast("int")) * 100).alias("top1"),
        (F.avg(_in_top(z, t, 3).cast("int")) * 100).alias("top3"),
        F.count("*").alias("n"),
    )


def _mean(value: str, n: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n))


def weighted_average(
    df: DataFrame, keys: list[str], value: str = "value", n: str = "n", batch: str = "batch"
) -> DataFrame:
    """Per group: the last value, the weighted sum, the count and the mean."""
    return df.groupBy(*keys).agg(
        F.max_by(value, batch).alias("last"),
        F.sum(F.col(value) * F.col(n)).alias("sum"),
        F.sum(n).alias("count"),
        _mean(value, n).alias("avg"),
    )


def running_average(
    df: DataFrame, keys: list[str], value: str = "value", n: str = "n", batch: str = "batch"
) -> DataFrame:
    """Add ``avg``: the weighted mean of the group up to and with each batch."""
    scanned = prefix_scan(
        df, keys, batch, {"_sum": ("sum", F.col(value) * F.col(n)), "_count": ("sum", F.col(n))}
    )
    return scanned.withColumn("avg", F.try_divide("_sum", "_count")).drop("_sum", "_count")


def epoch_summary(
    df: DataFrame, keys: list[str], values: tuple[str, ...] = ("loss", "top1", "top3"),
    loop: str = "loop", loops: tuple[str, ...] = ("Train", "Val"), n: str = "n",
) -> DataFrame:
    """Per epoch: the weighted mean of each metric and loop, as ``<loop>_<metric>``."""
    own = [F.when(F.col(loop) == name, F.col(n)) for name in loops]
    return df.groupBy(*keys).agg(
        *[
            F.try_divide(F.sum(F.col(v) * rows), F.sum(rows)).alias(f"{name.lower()}_{v}")
            for name, rows in zip(loops, own)
            for v in values
        ]
    )


def best_epochs(
    df: DataFrame, keys: list[str], value: str = "val_loss", epoch: str = "epoch",
    start: float = START_SCORE,
) -> DataFrame:
    """Add ``best_score``, the smallest value so far, and ``is_best``, whether the epoch set it."""
    scanned = prefix_scan(df, keys, epoch, {"_before": ("min", F.col(value))}, inclusive=False)
    before = F.least(F.col("_before"), F.lit(start))
    return scanned.select(
        *df.columns,
        F.least(F.col(value), before).alias("best_score"),
        (F.col(value) < before).alias("is_best"),
    )
