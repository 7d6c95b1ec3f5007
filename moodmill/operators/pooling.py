"""Pooling of sequences of vectors.

Steps are rows ``(keys..., pos, seq_len, vector)``. Each pooling is one
aggregation with partial sums per task, so long sequences never meet in one place.
Steps beyond the length are masked, not dropped: every sequence has a row in the
result, with a null vector if nothing of it counts. Keys may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from moodmill.functions.vectors import dot, grouped_vectors, max_vector, mean_vector, nonlinear, with_checked

_SPAN = 256.0  # exp of it, times any number of steps, is a double


def _kept(steps: DataFrame, include_padding: bool, dim: int) -> DataFrame:
    if not include_padding:
        steps = steps.withColumn("vector", F.when(F.col("pos") < F.col("seq_len"), F.col("vector")))
    return with_checked(steps, dim)


def _weighted_by(weight: str):
    return lambda c, size: mean_vector(c, size, F.col(weight))


def pool_mean(
    steps: DataFrame, keys: list[str], dim: int, include_padding: bool = True, times: str | None = None
) -> DataFrame:
    """Mean over the steps. ``times`` names a column that says how often a step stands in its sequence."""
    weight = F.col(times) if times else None
    mean = ("vector", lambda c, size: mean_vector(c, size, weight))
    return grouped_vectors(_kept(steps, include_padding, dim), keys, dim, {"vector": mean})


def pool_max(steps: DataFrame, keys: list[str], dim: int, include_padding: bool = True) -> DataFrame:
    """Elementwise maximum over the steps."""
    return grouped_vectors(_kept(steps, include_padding, dim), keys, dim, {"vector": ("vector", max_vector)})


def pool_attention(
    steps: DataFrame, keys: list[str], weights: list[float], dim: int, nonlinearity: str = "tanh",
    times: str | None = None,
) -> DataFrame:
    """Sum of the steps before ``seq_len``, weighted by a softmax of their scores.

    A masked and renormalised softmax is a softmax over the kept steps, and a
    weighted mean with ``exp(score)`` as weight is the softmax sum.
    """
    return pool_attention_multi(steps, keys, [weights], dim, nonlinearity, times).drop("head")


def pool_attention_multi(
    steps: DataFrame, keys: list[str], weights: list[list[float]], dim: int, nonlinearity: str = "tanh",
    times: str | None = None,
) -> DataFrame:
    """One attention pooling per head: ``keys, head, vector``.

    All heads share one pass and one shuffle; rows are not multiplied by heads. Scores of
    ``relu`` have no upper bound: steps are first pooled by the multiple of ``_SPAN`` that
    their score exceeds, weighted by ``exp`` of the rest, and the pooled vectors of a
    sequence are then weighted by their distance from its highest multiple. So no step is
    shuffled to meet the highest score, and none overflows.
    """
    heads = range(len(weights))
    scored = _kept(steps, False, dim).select(
        *keys, "vector", (F.col(times) if times else F.lit(1)).alias("_times"),
        *[nonlinear(dot(F.col("vector"), w), nonlinearity).alias(f"_score_{h}") for h, w in zip(heads, weights)],
    )
    levels = [f"_level_{h}" for h in heads] if nonlinearity == "relu" else []
    shifts = [F.lit(0.0) for _ in heads]
    if levels:
        shifts = [_SPAN * F.col(level) for level in levels]
        scored = scored.withColumns(
            {level: F.coalesce(F.floor(F.col(f"_score_{h}") / _SPAN), F.lit(0)) for h, level in enumerate(levels)}
        )
    weighted = scored.select(
        *keys, *levels, "vector",
        *[(F.col("_times") * F.exp(F.col(f"_score_{h}") - shifts[h])).alias(f"_weight_{h}") for h in heads],
    )
    pooled = grouped_vectors(
        weighted, [*keys, *levels], dim, {f"_head_{h}": ("vector", _weighted_by(f"_weight_{h}")) for h in heads},
        {f"_weight_{h}": F.sum(F.when(F.col("vector").isNotNull(), F.col(f"_weight_{h}"))) for h in heads if levels},
    )
    if levels:
        counted = [F.when(F.col(f"_head_{h}").isNotNull(), F.col(level)) for h, level in enumerate(levels)]
        tops = [F.max(c).over(Window.partitionBy(*keys)) for c in counted]
        below = pooled.select(
            "*", *[(F.exp(_SPAN * (c - top)) * F.col(f"_weight_{h}")).alias(f"_share_{h}") for h, (c, top) in enumerate(zip(counted, tops))]
        )
        pooled = grouped_vectors(
            below, keys, dim, {f"_head_{h}": (f"_head_{h}", _weighted_by(f"_share_{h}")) for h in heads}
        )
    stacked = F.array(*[F.col(f"_head_{h}") for h in heads])
    return pooled.select(*keys, F.posexplode(stacked).alias("head", "vector"))
