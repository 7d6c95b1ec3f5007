"""Equi-joins with dictionary-like tables that hold under skew and growth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from moodmill.session import durable

BROADCAST_BYTES = 64 * 1024 * 1024
PIECES = 8  # broadcasts of one table, at most; they are in the memory of the driver and of each executor
HOT_SHARE = 0.001
SALTS = 64
_NARROW = (T.FloatType, T.IntegerType)


def _width(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * (4 if isinstance(field.dataType.elementType, _NARROW) else 8) + 24
    return F.lit(16)


def table_bytes(table: DataFrame) -> int:
    """In-memory size of a table, by one aggregate over it."""
    width = sum((_width(f) for f in table.schema.fields), F.lit(16)).cast("long")
    return table.agg(F.sum(width).alias("b")).first().b or 0


def hot_keys(facts: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold at least ``share`` of the rows: ``1/share`` of them at most."""
    counts = durable(facts.groupBy(key).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    least = max(2, int(total * share))
    found = [r[0] for r in counts.where((F.col("n") >= least) & F.col(key).isNotNull()).collect()]
    return found


def _in_pieces(facts: DataFrame, table: DataFrame, key: str, how: str, n: int) -> DataFrame:
    """A left or inner join with ``n`` broadcasts, each of the keys of one hash part; the facts do not move."""
    rest = [f"`{c}`" for c in table.columns if c != key]
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    parts = durable(table.where(F.col(key).isNotNull()).withColumn("_part", part), "pieces", partition_by="_part")
    joined = facts
    for i in range(n):
        piece = parts.where(F.col("_part") == i).select(key, F.struct(*rest).alias(f"_piece_{i}"))
        joined = joined.join(F.broadcast(piece), key, "left")
    # A key is in one piece only.
    found = F.coalesce(*[F.col(f"_piece_{i}") for i in range(n)])
    kept = [key, *[f"`{c}`" for c in facts.columns if c != key]]
    whole = joined.select(*kept, found.alias("_found"))
    return (whole.where(F.col("_found").isNotNull()) if how == "inner" else whole).select(*kept, "_found.*")


def lookup(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    hot_share: float = HOT_SHARE,
    salts: int = SALTS,
    bucketed: bool = False,
    frequent: Callable[[], list] | None = None,
) -> DataFrame:
    """Join ``facts`` with ``table`` on one key column.

    A table whose measured size is within ``max_bytes`` is broadcast, so the facts
    do not move. One of up to ``PIECES`` times that with arrays is broadcast in pieces, for left and inner joins:
    facts stay with those of the same group, and the vectors that the table has for them are not shuffled.
    A larger one is joined by a shuffle in which the keys that hold
    more than ``hot_share`` of the facts are salted: their facts spread over
    ``salts`` reducers and their table rows are repeated once per salt. Facts without
    a key match nothing and are spread as well.

    ``bucketed`` says that the table is stored in buckets of the key, one row per key. Beyond ``max_bytes``
    it then stays where it is and only facts move: those of frequent keys, and those without a key, meet a
    broadcast of the table rows of the frequent keys, ``1/hot_share`` at most; the others are shuffled to the
    buckets. The facts are evaluated once for each of the two. All ways give the same rows.

    ``frequent`` gives the frequent keys of the facts, where they are known without counting them; it is asked
    only for a table that is not broadcast.
    """
    size = table_bytes(table)
    if size <= max_bytes:
        return facts.join(F.broadcast(table), key, how)
    wide = any(isinstance(f.dataType, T.ArrayType) for f in table.schema.fields if f.name != key)
    if wide and not bucketed and how in ("left", "inner") and size <= PIECES * max_bytes:
        return _in_pieces(facts, table, key, how, -(-size // max_bytes))
    hot = frequent() if frequent else hot_keys(facts, key, hot_share)
    if bucketed:
        often = F.col(key).isNull() | F.col(key).isin(hot)
        few = F.broadcast(table.where(F.col(key).isin(hot)))
        return facts.where(~often).join(table, key, how).unionByName(facts.where(often).join(few, key, how))
    # A salt from the row itself is the same on every retry of the task.
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)).cast("int")
    salted = facts.withColumn("_salt", F.when(F.col(key).isNull() | F.col(key).isin(hot), spread).otherwise(F.lit(0)))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    repeated = table.withColumn(
        "_salt", F.explode(F.when(F.col(key).isin(hot), every).otherwise(F.array(F.lit(0))))
    )
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
