"""Arithmetic on array columns, and per-dimension aggregates over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

MAX_AGGREGATES = 256  # numbers of one aggregation; beyond, plans and generated code would grow too large
SLICE = 64  # numbers of an aggregation of slices


def dot(c: Column, weights: list[float] | Column) -> Column:
    """Inner product of an array column with fixed weights or another array column."""
    other = weights if isinstance(weights, Column) else double_array(weights)
    products = F.zip_with(c, other, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def double_array(values: list[float]) -> Column:
    """A constant ``ARRAY<DOUBLE>``."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")


def nonlinear(score: Column, kind: str) -> Column:
    """The bounding function of the attention scores."""
    if kind == "tanh":
        return F.tanh(score)
    if kind == "relu":
        return F.greatest(score, F.lit(0.0))
    raise ValueError(f"unknown non-linearity {kind!r}")


def log_sum_exp(c: Column) -> Column:
    """Stable ``log(sum(exp(x)))`` of an array column."""
    top = F.array_max(c).cast("double")
    total = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    return top + F.log(total)


def per_dimension(aggregate: Callable[[Column], Column], c: Column, dim: int) -> Column:
    """Aggregate each dimension on its own and put the results back into an array.

    Numeric buffers keep the aggregation in the hash aggregate with partial sums
    before the shuffle; an aggregate over whole vectors would fall back to sorting.
    """
    return F.array(*[aggregate(F.get(c, F.lit(i)).cast("double")) for i in range(dim)])


def checked(c: Column, dim: int) -> Column:
    """The vector; an error if it has another size or a null element. A null vector stays null."""
    right = (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull())
    failed = F.raise_error(F.concat(F.lit(f"not a vector of {dim} numbers: "), F.to_json(c)))
    return F.when(c.isNull() | right, c.cast("array<double>")).otherwise(failed.cast("array<double>"))


def with_checked(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The rows with their vectors checked, once each: aggregates over many numbers would repeat a check within them."""
    return df.withColumn(vector, checked(F.col(vector), dim))


def mean_vector(c: Column, dim: int, weight: Column | None = None) -> Column:
    """Mean of the vectors of a group, weighted if there is a ``weight``; null if it has none.

    The vectors come from ``with_checked``; null ones are left out.
    """
    if weight is None:
        n = F.count(c)
        mean = per_dimension(lambda v: F.try_divide(F.sum(v), n), c, dim)
    else:
        own = weight.cast("double")
        total = F.sum(F.when(c.isNotNull(), own))
        mean = per_dimension(lambda v: F.try_divide(F.sum(own * v), total), c, dim)
    return F.when(F.count(c) > 0, mean)


def max_vector(c: Column, dim: int) -> Column:
    """Elementwise maximum of the vectors of a group, by the rules of ``mean_vector``."""
    return F.when(F.count(c) > 0, per_dimension(F.max, c, dim))


def grouped_vectors(
    df: DataFrame, keys: list[str], dim: int, named: dict[str, tuple[str, Callable[[Column, int], Column]]],
    further: dict[str, Column] | None = None,
) -> DataFrame:
    """Group by ``keys``; per name an aggregate of a vector column, given that column and its size, and ``further`` plain ones.

    With more than ``MAX_AGGREGATES`` numbers in all, vectors are cut into slices that are aggregated as rows of
    their own, each step before the shuffle by sums of numbers too, and put together again; an aggregate
    over whole vectors would sort all steps.
    """
    further = further or {}
    plain = [c.alias(name) for name, c in further.items()]
    if dim * len(named) <= MAX_AGGREGATES:
        return df.groupBy(*keys).agg(*[f(F.col(c), dim).alias(name) for name, (c, f) in named.items()], *plain)
    width = max(1, min(SLICE, MAX_AGGREGATES) // len(named))
    n = -(-dim // width)
    start = F.col("_slice") * width + 1
    sliced = df.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns(
        {c: F.slice(F.col(c), start, F.lit(width)) for c, _ in named.values()}
    )
    each = sliced.groupBy(*keys, "_slice").agg(*[f(F.col(c), width).alias(name) for name, (c, f) in named.items()], *plain)
    ordered = F.array_sort(F.collect_list(F.struct("_slice", *named, *further)))
    gathered = each.groupBy(*keys).agg(ordered.alias("_slices"))
    return gathered.select(
        *keys,
        *[F.slice(F.flatten(F.transform("_slices", lambda s: s[name])), 1, dim).alias(name) for name in named],
        *[F.get("_slices", F.lit(0))[name].alias(name) for name in further],
    )
