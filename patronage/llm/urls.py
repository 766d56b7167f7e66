"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest.

Everything runs as DataFrame expressions and Spark's own tree trainer. Features of a URL: length, path depth, ratio of
digits, entropy of its characters, number of parameters, hyphens and labels of the host, and for its last label and last
two labels the smoothed share of blocked URLs and the logarithm of the number of labelled URLs.

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no rule, and is judged by its
features; equal URLs get equal verdicts; input columns beside the key and ``url`` are ignored. Without labelled URLs of
both classes there is nothing to learn and the method allows.
"""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.shared import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pseudo-observations that draw the statistics of a rare suffix towards the overall share.
SMOOTHING = 20.0
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_last_rate", "f_last_n", "f_pair_rate", "f_pair_n"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list) -> Column:
    """The longest rule that fits, else null. ``rules``: (verdict, host/path) pairs; a policy list written by hand."""
    chosen = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features and the two suffixes of the host."""
    u, host = F.coalesce(F.col(url), F.lit("")), F.col("host")
    n = F.length(u)
    labels = F.split(host, r"\.")
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))
    return urls.select(
        "*",
        n.cast("double").alias("f_length"),
        F.regexp_count(F.col("path"), F.lit("[^/]+")).cast("double").alias("f_depth"),
        F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0).alias("f_digits"),
        F.when(n > 0, entropy).otherwise(0.0).alias("f_entropy"),
        F.regexp_count(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit("[^&;]+")).cast("double").alias("f_params"),
        F.regexp_count(host, F.lit("-")).cast("double").alias("f_hyphens"),
        F.size(labels).cast("double").alias("f_labels"),
        F.element_at(labels, -1).alias("last"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("pair"),
    )


def suffix_statistics(labelled: DataFrame, suffix: str, overall: float) -> DataFrame:
    """(suffix, rate, n): one row per suffix among the labelled URLs; ``label`` is 1.0 for blocked, ``overall`` its mean."""
    counts = labelled.groupBy(suffix).agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    rate = (F.col("blocked") + SMOOTHING * overall) / (F.col("n") + SMOOTHING)
    return counts.select(suffix, rate.alias(f"f_{suffix}_rate"), F.log1p("n").alias(f"f_{suffix}_n"))


def with_statistics(urls: DataFrame, statistics: dict, overall: float) -> DataFrame:
    for suffix, rows in statistics.items():
        urls = urls.join(rows, suffix, "left").fillna({f"f_{suffix}_rate": overall, f"f_{suffix}_n": 0.0})
    return urls


def train(labelled: DataFrame, rounds: int = 12, depth: int = 3, seed: int = 7):
    """Boosted trees from rows with the features and ``label``; the trainer bins and aggregates over all rows in Spark."""
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False)
    return trees.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled))


def judge(pages: DataFrame, key: str, rules: list, threshold: float = 0.5) -> DataFrame:
    """Verdicts (``key``, host, path, rule, verdict, score); the URLs that a rule decides are the labelled ones.

    ``score`` is the model's probability that a URL is to be blocked, and decides where no rule fits.
    """
    seen = pages.select(key, "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    verdicts = {rule: verdict for verdict, rule in rules}
    fitting = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    rows = settle(lexical(fitting).withColumn("label", F.when(by_rule == "block", 1.0).when(by_rule == "allow", 0.0)).drop("url"))
    labelled = rows.where(F.col("label").isNotNull())
    blocked, n = labelled.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if 0 < blocked < n:
        statistics = {s: settle(suffix_statistics(labelled, s, blocked / n)) for s in ("last", "pair")}
        complete = with_statistics(rows, statistics, blocked / n)
        model = train(complete.where(F.col("label").isNotNull()))
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(complete))
        score = vector_to_array("probability")[1]
    else:
        scored, score = rows, F.lit(0.0)
    by_method = F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(key, "host", "path", "rule", F.coalesce(F.when(F.col("label") == 1.0, F.lit("block")).when(F.col("label") == 0.0, F.lit("allow")), by_method).alias("verdict"), score.alias("score"))
