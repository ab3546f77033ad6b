"""Allow and block rules over URLs, by expanded expressions and short hash prefixes.

Each rule is an expression: a host and a path prefix, written as one string. A
URL is expanded into every such expression it could fit: the suffixes of its
host at label borders and the prefixes of its path, for the label counts and
path lengths that occur among the rules. Expressions meet rules in an equi-join
on the first 8 hex digits of their SHA-256, the full digest is confirmed, and
the longest rule wins (then the longer host, then block).

Everything is DataFrame code. The list of label counts and path lengths is
collected: hosts have at most 127 labels and URLs a bounded length, so it does
not grow with the number of rules. The rule table itself is joined, with Spark's
own size check for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8

# The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def compiled(rules: DataFrame) -> DataFrame:
    """Digest, digest prefix and rank of every rule; a repeated rule blocks if any copy does.

    rank packs length of the rule, length of its host and the block bit, so that
    the largest rank among the rules that fit one URL names a single rule.
    """
    host = F.translate("host", UPPER, LOWER)
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(host.alias("r_host"), F.col("path").alias("r_path"), (F.col("action") == "block").alias("blocks"))
        .groupBy("r_host", "r_path")
        .agg(F.max(F.when(F.col("blocks"), 1).otherwise(0)).alias("block"))
        .select(
            F.sha2(F.concat("r_host", "r_path"), 256).alias("r_digest"),
            (
                F.shiftleft((F.length("r_host") + F.length("r_path")).cast("long"), 24)
                + F.shiftleft(F.length("r_host").cast("long"), 1)
                + F.col("block")
            ).alias("r_rank"),
            F.size(F.split("r_host", r"\.", -1)).alias("r_labels"),
            F.length("r_path").alias("r_path_length"),
        )
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_HEX))
    )


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of host suffix + path prefix for the given label counts and path lengths."""
    parts = F.split(host, r"\.", -1)
    count = F.size(parts)
    hosts = F.array(*[F.when(count >= k, F.array_join(F.slice(parts, count - k + 1, k), ".")) for k in labels])
    paths = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.filter(both, lambda e: e.isNotNull())


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A page no rule fits is allowed. Null urls and urls without `://` have empty
    host and path. Repeated rows each get their row; other columns of `pages`
    are not read, so their names cannot clash. Empty rules allow everything.
    """
    rules = compiled(rules)
    shape = rules.agg(F.collect_set("r_labels"), F.collect_set("r_path_length")).first()
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path")
    )
    if not shape[0]:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    best = (
        urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(shape[0]), sorted(shape[1]))).alias("e"))
        .withColumn("digest", F.sha2("e", 256))
        .join(rules, F.substring("digest", 1, PREFIX_HEX) == F.col("r_prefix"))
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(F.max("r_rank").alias("rank"))
        .withColumnsRenamed({"host": "b_host", "path": "b_path"})
    )
    host_length = F.shiftright("rank", 1).bitwiseAND(F.lit((1 << 23) - 1)).cast("int")
    rule_length = F.shiftright("rank", 24).cast("int")
    rule = F.concat(
        F.substring("host", F.length("host") - host_length + 1, host_length), F.substring("path", F.lit(1), rule_length - host_length)
    )
    blocked = F.col("rank").bitwiseAND(F.lit(1)) == 1
    return urls.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select(
        "page_id",
        "host",
        "path",
        F.when(F.col("rank").isNotNull(), rule).alias("rule"),
        F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
