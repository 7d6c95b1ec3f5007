"""URL filters: listed rules, and association rules that FP-growth mines from labels.

A listed rule is a host and the beginning of a path; the longest one that fits decides.
Other URLs are judged by mined rules: the tokens of labelled unwanted URLs are transactions,
Spark's FP-growth finds their combinations, and the wanted URLs that have them are
counted. Rules need a least support and confidence; one that a shorter rule with at
least its confidence implies is pruned. A rule stands in an inverted index under its
rarest token, so a URL meets only rules one of whose tokens it has.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from moodmill.llm.common import durable

# The listed rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

MIN_ROWS = 20  # unwanted pages of a rule, whatever else is labelled
MIN_CONFIDENCE = 0.8
MAX_ANTECEDENT = 4  # up to which the test searches plainly; mining has no such bound


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; null if none does. The list is part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments with digits as ``#``, names of parameters, the fragment."""
    rest = F.coalesce(_rest(url), F.lit(""))
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(
        F.split(F.regexp_replace(path_of(url), "[0-9]+", "#"), "/"), lambda x: F.concat(F.lit("path:"), x)
    )
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^[^=]*", 0)))
    fragment = F.array(F.concat(F.lit("fragment:"), F.regexp_extract(rest, "#(.*)$", 1)))
    every = F.array_distinct(F.flatten(F.array(labels, segments, names, fragment)))
    return F.filter(every, lambda x: ~x.rlike("^[a-z]+:$"))


def _classes(patterns: DataFrame, least: int) -> DataFrame:
    """``token, name, bad, good``: tokens of at least ``least`` unwanted rows; those that stand in the same rows share a name."""
    tokens = F.col("tokens")
    each = patterns.select(F.explode(tokens).alias("token"), "bad", "good", F.xxhash64(tokens).alias("x"), F.xxhash64(F.lit(1), tokens).alias("y"))
    counted = each.groupBy("token").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    ).where(F.col("bad") >= least)
    counted = durable(counted, "url-tokens")
    named = counted.groupBy("x", "y", "bad", "good").agg(F.min("token").alias("name"))
    return durable(counted.join(named, ["x", "y", "bad", "good"]).select("token", "name", "bad", "good"), "url-classes")


def _counted_sets(patterns: DataFrame, least: int) -> DataFrame:
    """``tokens, bad, good``: every combination in at least ``least`` unwanted rows, and its rows."""
    bad = patterns.where(F.col("bad") > 0).select("tokens", F.explode(F.expr("sequence(1L, bad)"))).select("tokens")
    bad = durable(bad, "transactions")
    n = bad.count()
    # A little below, so that rounding does not ask for a row more.
    model = FPGrowth(itemsCol="tokens", minSupport=min(1.0, (least - 0.5) / n)).fit(bad)
    sets = durable(model.freqItemsets.select(F.sort_array("items").alias("tokens"), F.col("freq").alias("bad")), "url-sets")
    good = patterns.where(F.col("good") > 0).select(F.monotonically_increasing_id().alias("_row"), F.col("tokens").alias("_tokens"), "good")
    good = durable(good, "wanted")
    often = good.select(F.explode("_tokens").alias("token"), "good").groupBy("token").agg(F.sum("good").alias("freq"))
    # A set stands under its rarest token of the wanted rows; one with a token that none has is met by none.
    under = (
        sets.select("tokens", F.explode("tokens").alias("token")).join(often, "token", "left")
        .groupBy("tokens").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token")).alias("least"))
        .select("tokens", F.col("least.token").alias("_token"))
    )
    met = (
        good.select("_tokens", "good", F.explode("_tokens").alias("_token")).join(under, "_token")
        .where(F.size(F.array_except("tokens", "_tokens")) == 0).groupBy("tokens").agg(F.sum("good").alias("good"))
    )
    return durable(sets.join(met, "tokens", "left").select("tokens", "bad", F.coalesce("good", F.lit(0)).alias("good")), "url-counted")


def _unimplied(sets: DataFrame) -> DataFrame:
    """``tokens, bad, confidence`` of the sets whose confidence is above that of each of their proper parts."""
    sets = sets.select("tokens", "bad", (F.col("bad") / (F.col("bad") + F.col("good"))).alias("confidence"))
    longest = sets.agg(F.max(F.size("tokens")).alias("n")).first().n or 0
    best = durable(sets.where(F.size("tokens") == 1).withColumn("before", F.lit(-1.0)), "url-best")
    kept = best
    for size in range(2, longest + 1):
        # All parts of a set that is frequent are frequent: those with one token less carry the best of the others.
        own = sets.where(F.size("tokens") == size)
        parts = own.select(F.col("tokens").alias("whole"), F.explode("tokens").alias("token")).select(
            "whole", F.expr("filter(whole, x -> x != token)").alias("tokens")
        )
        before = parts.join(best, "tokens").groupBy("whole").agg(F.max(F.greatest("confidence", "before")).alias("before"))
        best = durable(own.join(before, own["tokens"] == before["whole"]).drop("whole"), "url-best")
        kept = kept.unionByName(best)
    return kept.where(F.col("confidence") > F.col("before")).drop("before")


def mined_rules(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``tokens, confidence, support, rarest``: combinations that come with unwanted URLs.

    ``labelled`` holds ``url, unwanted`` (boolean), a row per labelled page. Support is
    that of the combination together with the label. All tokens of a URL count, and a
    rule may have any number of them. Without labels there is no rule.
    """
    items = labelled.where(F.col("unwanted").isNotNull()).select(F.sort_array(url_tokens(F.col("url"))).alias("tokens"), "unwanted")
    patterns = durable(
        items.groupBy("tokens").agg(F.count_if("unwanted").alias("bad"), F.count_if(~F.col("unwanted")).alias("good")), "patterns"
    )
    spark = labelled.sparkSession
    n = patterns.agg(F.sum(F.col("bad") + F.col("good")).alias("n")).first().n
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double, rarest string")
    if not n:
        return none
    least = max(min_rows, 1)
    # A token below the support is in no rule; of tokens in the same rows a rule has one, in turn.
    classes = _classes(patterns, least)
    if classes.isEmpty():
        return none
    short = (
        patterns.withColumn("_row", F.monotonically_increasing_id()).select("_row", "bad", "good", F.explode("tokens").alias("token"))
        .join(classes.select("token", "name"), "token").groupBy("_row", "bad", "good").agg(F.sort_array(F.collect_set("name")).alias("tokens"))
        .groupBy("tokens").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    rules = durable(_unimplied(_counted_sets(durable(short, "patterns"), least)).where(F.col("confidence") >= min_confidence), "rules")
    # Each member of a class stands for it in turn.
    members = classes.groupBy("name").agg(F.sort_array(F.collect_list("token")).alias("members"))
    choices = (
        rules.select("tokens", "bad", "confidence", F.explode("tokens").alias("name")).join(members, "name")
        .groupBy("tokens", "bad", "confidence").agg(F.collect_list("members").alias("choices"))
    )
    every = F.aggregate(
        "choices", F.array(F.array().cast("array<string>")),
        lambda made, one: F.flatten(F.transform(made, lambda m: F.transform(one, lambda t: F.concat(m, F.array(t))))),
    )
    kept = durable(
        choices.select(F.explode(every).alias("tokens"), "confidence", (F.col("bad") / F.lit(n)).alias("support"))
        .withColumn("tokens", F.sort_array("tokens")),
        "rules",
    )
    rarest = (
        kept.select("tokens", F.explode("tokens").alias("token"))
        .join(classes.select("token", (F.col("bad") + F.col("good")).alias("freq")), "token")
        .groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    )
    return durable(kept.join(rarest, "tokens").select("tokens", "confidence", "support", "rarest"), "url-rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, mined``: for each distinct URL that a rule fits, its rule with the greatest confidence."""
    known = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("_tokens", url_tokens(F.col("url")))
    index = rules.withColumnRenamed("rarest", "_token")
    met = (
        known.select("url", "_tokens", F.explode("_tokens").alias("_token")).join(index, "_token")
        .where(F.size(F.array_except("tokens", "_tokens")) == 0)
    )
    order = F.struct("confidence", "support", F.concat_ws(" ", "tokens").alias("name"))
    return met.groupBy("url").agg(F.max(order).alias("best")).select("url", F.col("best.name").alias("mined"))


def judged_urls(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, mined``; ``mined`` names the association rule that blocks.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is
    allowed. Repeated rows are judged alike. Columns of these names are replaced.
    """
    added = ("host", "path", "rule", "verdict", "mined")
    names = [c for c in pages.columns if c not in added]
    found = durable(matches(pages.select("url"), mined_rules(labelled)), "url-matches")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select(*[F.col(f"`{c}`") for c in names], host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": rule, "verdict": verdict})
    return (
        split.join(found.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left").drop("_url")
        .withColumn("verdict", F.coalesce("verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")))
    )
