"""URL filters: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

Each URL becomes the expressions ``suffix-of-host + prefix-of-path`` whose shape (number of host labels, length of the
path) occurs among the rules.  Expressions and rules meet in an equi-join on the first 32 bits of SHA-256; full digests
confirm the match, and the longest rule decides.  Spark plans the join from the rule table's size: a small rule list is
broadcast under ``spark.sql.autoBroadcastJoinThreshold``, a large one is shuffled and a hot prefix is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits of the hexadecimal digest that the equi-join uses.
PREFIX_HEX = 8
#: Stands between host and path in what is hashed; no host holds it.
BETWEEN = "#"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> distinct (rule, digest, short, verdict).

    Rules without a host, or whose host has a sign that ends hosts, never fit and go; of equal rules with different verdicts ``block`` stays.
    """
    return (
        rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where(r"host <> '' and not host rlike '[/?#]' and verdict is not null")
        .groupBy(F.concat("host", "path").alias("rule"), "host", "path").agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("digest", F.sha2(F.concat("host", F.lit(BETWEEN), "path"), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        .withColumn("labels", F.size(F.split("host", r"\.", -1)))
        .withColumn("path_length", F.char_length("path"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``pages``; returns its columns plus host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and all subdomains when the URL's path
    starts with the rule's path; the longest rule (host and path together, ties to the greater text) wins.  Where none
    fits, rule is null and the verdict is ``default``.  A null URL or one without ``://`` has an empty host and path and
    gets ``default``.  Repeated rows are each judged; columns of ``pages`` with clashing names are replaced.
    """
    rules = rule_table(rules)
    # The shapes are as many as there are label counts and path lengths of rules, whatever the number of rules.
    shapes = rules.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("path_length")).alias("lengths")).first()
    judged = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    keep = [c for c in judged.columns if c not in ("rule", "verdict")]
    if not shapes.labels:
        return judged.select(*keep, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, lengths = (F.array(*[F.lit(int(x)) for x in xs]) for xs in shapes)
    parts = F.split("host", r"\.", -1)
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat(h, F.lit(BETWEEN), p), 256))))
    numbered = judged.withColumn("_row", F.monotonically_increasing_id())
    asked = numbered.select(*[F.col(c) for c in keep], "_row", F.explode_outer(expressions).alias("_digest")).withColumn("_short", F.substring("_digest", 1, PREFIX_HEX))
    found = asked.join(rules.select("short", "digest", F.col("rule").alias("_rule"), "rule_verdict"), F.col("_short") == F.col("short"), "left")
    hit = F.when(F.col("_digest") == F.col("digest"), F.struct(F.char_length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("rule_verdict").alias("verdict")))
    best = found.groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], F.max(hit).alias("_best"))
    return best.select(*keep, F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
