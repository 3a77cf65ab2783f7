"""URL rules by equi-joins on short hash prefixes of host-suffix and path-prefix expressions.

Each URL becomes the expressions of its host's suffixes (by labels) with its path's prefixes (of the lengths that rules
have). Expressions and rules meet on the first four bytes of their SHA-256; full digests then confirm a match, and the
longest rule wins.

Defined cases: a null url or one without "://" has an empty host and path and no rule; an empty path matches rules with
an empty path only; of rules of equal length the one with the longer host wins, then block; a rule given twice counts
once; rows that repeat a page_id are each judged; very long urls are taken whole; columns other than page_id and url are
ignored, whatever their names; without rules every url gets the default verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path as the contract cuts them; both empty without a scheme."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"(?s)^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, host, path, verdict) from ("block" or "allow", "host/path") pairs."""
    rows = []
    for verdict, text in sorted(set(rules)):
        host, slash, path = text.partition("/")
        rows.append((text, host.translate(str.maketrans(UPPER, LOWER)), slash + path, verdict))
    return spark.createDataFrame(rows, "rule string, host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages."""
    digest = F.sha2(F.concat("host", F.lit("\n"), "path").cast("binary"), 256)
    held = stored(rules.select("rule", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", digest.alias("rule_digest")), "rules")
    held = held.withColumn("short", F.substring("rule_digest", 1, 8))
    shape = held.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    host, path = host_and_path(F.col("url").cast("string"))
    # The id within a task tells repeated rows apart; the table is written so that it stays the same.
    rows = stored(pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")), "urls")
    if not shape["n"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    most = F.least(F.size(labels), F.lit(shape["labels"]))
    suffixes = rows.filter("host != ''").select("row", "path", F.explode(F.transform(F.sequence(F.lit(1), most), lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)))).alias("host"))
    lengths = F.array(*(F.lit(n) for n in sorted(shape["lengths"])))
    each = suffixes.select("row", "host", F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("path"))
    keyed = each.select("row", digest.alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    met = keyed.join(broadcast_if_small(held, shape["n"], BROADCAST_ROWS), "short").filter(F.col("digest") == F.col("rule_digest"))
    order = F.struct(F.length("rule").alias("l"), F.length("rule_host").alias("h"), (F.col("verdict") == "block").cast("int").alias("b"), F.col("rule").alias("r"))
    best = met.groupBy("row").agg(F.max_by(F.struct("rule", "verdict"), order).alias("won"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict"))
