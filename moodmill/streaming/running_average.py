"""Running means of metrics that arrive while a model is trained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from moodmill.operators.ordering import prefix_scan
from moodmill.session import durable
from moodmill.streaming.incremental import drain

FILES_PER_BATCH = 200


def running_average_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    keys: list[str],
    value: str = "value",
    n: str = "n",
    batch: str = "batch",
    files_per_batch: int = FILES_PER_BATCH,
) -> None:
    """The running mean of metrics that arrive as Parquet files below ``source``; returns when none is left.

    Each micro-batch goes through the same scan as ``running_average``; groups continue from
    their state after the micro-batch before: the sums, the count and the last value of ``batch``. Below
    ``target`` lie ``rows`` (the columns of the source and ``avg``), ``late`` (rows whose ``batch`` is not
    after the last one of their group, or is null, which would change answers already given) and ``state``, a
    folder per micro-batch each. A repeated micro-batch reads the state before it and overwrites its
    own folders, so a failure doubles nothing. A null value adds to the count and not to the sum, as
    in ``running_average``; groups may be null. A state is a row per group.
    """
    schema = spark.read.parquet(source).schema
    measures = {"_sum": ("sum", F.col(value) * F.col(n)), "_count": ("sum", F.col(n))}

    def step(rows: DataFrame, number: int) -> None:
        groups = rows.select(*keys).schema.fields
        fields = [*groups, *T.StructType.fromDDL("_before_sum double, _before_count bigint").fields]
        stated = T.StructType([*fields, T.StructField("_last", schema[batch].dataType)])
        before = f"{target}/state/{number - 1:06d}"
        state = spark.read.schema(stated).parquet(before) if number else spark.createDataFrame([], stated)
        known = state.select(
            *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_before_sum", "_before_count", "_last"
        )
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
        placed = durable(rows.join(known, same, "left").drop(*[f"_key_{i}" for i in range(len(keys))]), "stream-rows")
        late = F.col(batch).isNull() | F.coalesce(F.col(batch) <= F.col("_last"), F.lit(False))
        own = [F.col(f"`{f.name}`") for f in schema.fields]
        folder = f"{number:06d}"
        placed.where(late).select(*own).write.mode("overwrite").parquet(f"{target}/late/{folder}")
        new = prefix_scan(placed.where(~late), keys, batch, measures)
        total = [_plus(F.col(f"_before_{x}"), F.col(f"_{x}")) for x in ("sum", "count")]
        new.select(*own, F.try_divide(*total).alias("avg")).write.mode("overwrite").parquet(f"{target}/rows/{folder}")
        gained = placed.where(~late).groupBy(*keys).agg(
            *[F.sum(c).alias(name) for name, (_, c) in measures.items()], F.max(batch).alias("_top")
        )
        # The rows of a group in the old state and in this micro-batch, at most two.
        old = state.select(*keys, "_before_sum", "_before_count", "_last")
        both = old.unionByName(gained.select(
            *keys, F.col("_sum").cast("double").alias("_before_sum"), F.col("_count").cast("bigint").alias("_before_count"),
            F.col("_top").alias("_last"),
        ))
        both.groupBy(*keys).agg(
            F.sum("_before_sum").alias("_before_sum"), F.sum("_before_count").alias("_before_count"), F.max("_last").alias("_last")
        ).write.mode("overwrite").parquet(f"{target}/state/{number:06d}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    drain(files, step, checkpoint)


def _plus(a: Column, b: Column) -> Column:
    """The sum, in which a null counts as nothing; null if both are."""
    return F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))
