"""Dense ordinals and running aggregates without a one-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from moodmill.session import durable

_ROW_BITS = 33


def with_ordinal(df: DataFrame, order_by: list[Column], name: str = "ordinal") -> DataFrame:
    """Add the dense 0-based rank of each row in the given order.

    A range sort places the rows, each partition numbers its own, and the row
    counts of the partitions before it are added. The sorted table is written
    once, so the partition numbers cannot change between the two steps. The
    order must be total for an even spread and a repeatable answer.
    """
    placed = durable(
        df.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()), "ordinal"
    )
    part = F.shiftright("_at", _ROW_BITS)
    # One row per partition of the sort, whatever the size of the table.
    sizes = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    counts = [sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)]
    starts = ",".join(f"{s}L" for s in accumulate([0, *counts[:-1]]))
    offset = F.get(F.expr(f"array({starts})"), part.cast("int"))
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(name, (offset + row).cast("long")).drop("_at")


def prefix_scan(
    df: DataFrame,
    group: list[str],
    order: str,
    measures: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` or ``min`` per group in the order of a column, nulls first.

    ``measures`` maps an output name to ``(kind, column)``. A range sort places the rows,
    so a partition holds consecutive rows whatever the values of ``order`` are, and a
    group of any size lies in neighbouring partitions. Rows are scanned within their
    partition; only the group that goes on from the partition before gets a carry, one
    row per partition. Values of ``order`` are unique within a group; groups may be null.
    """
    kinds = {"sum": (F.sum, lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))),
             "min": (F.min, lambda a, b: F.least(a, b))}
    at = F.monotonically_increasing_id()
    placed = durable(df.orderBy(*[F.col(g).asc() for g in group], F.col(order).asc()).withColumn("_at", at), "scan")
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    totals = placed.groupBy(*group, "_part").agg(
        *[kinds[kind][0](c).alias(f"_t_{name}") for name, (kind, c) in measures.items()]
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_part").alias("_of"), *[F.col(g).alias(f"_group_{i}") for i, g in enumerate(group)],
        F.lag("_part").over(Window.partitionBy(*group).orderBy("_part")).alias("_from"),
        *[kinds[kind][0](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in measures.items()],
    ).where(F.col("_from").isNotNull()).drop("_from")
    last = 0 if inclusive else -1
    inside = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, last)
    same = F.col("_part") == F.col("_of")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{i}"))
    # At most one row per partition: the group that continues there.
    joined = placed.join(F.broadcast(carried), same, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            kinds[kind][1](F.col(f"_c_{name}"), kinds[kind][0](c).over(inside)).alias(name)
            for name, (kind, c) in measures.items()
        ],
    )
