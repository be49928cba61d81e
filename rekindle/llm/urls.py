"""URL filter lists: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each distinct (host, path) expands into expressions ``suffix + prefix`` for the label counts and path
depths that occur in the rules. They meet the rules by equi-join on the first 32 bits of a SHA-256 digest,
then the full digest confirms, and the longest rule decides. All in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to / ? # or the end, A-Z lower-cased) and path (then up to ? or #)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _keys(df: DataFrame, expression: Column) -> DataFrame:
    digest = F.sha2(expression.cast("binary"), 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))


def rule_table(spark, rules=RULES) -> DataFrame:
    """host, path, verdict, digest, short, rule text of the given (host, path, verdict) tuples."""
    from rekindle.session import local_table

    rows = local_table(spark, [tuple(r) for r in rules], "host string, path string, verdict string")
    return _keys(rows, F.concat_ws("\0", "host", "path"))


def expressions(parts: DataFrame, rules=RULES) -> DataFrame:
    """(host, path, digest, short) of every host suffix x path prefix that a rule of this list could equal.

    Suffixes have the label counts that rules have. Prefixes end after as many slashes as a rule path
    holds; rule paths that end elsewhere add prefixes of their lengths. So a host of ten thousand labels or a very long
    path gives no more expressions than the list has shapes.
    """
    labels = sorted({r[0].count(".") + 1 for r in rules})
    depths = sorted({r[1].count("/") for r in rules if r[1].endswith("/")})
    lengths = sorted({len(r[1]) for r in rules if not r[1].endswith("/")})
    n_labels = F.size(F.split("host", r"\."))
    suffixes = F.array(*[F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in labels])
    cuts = [F.when(F.regexp_count("path", F.lit("/")) >= d, F.concat(F.substring_index("path", "/", d), F.lit("/"))) for d in depths]
    cuts += [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    hosts = parts.select("host", "path", F.explode(F.array_distinct(F.array_compact(suffixes))).alias("suffix"))
    both = hosts.select("host", "path", "suffix", F.explode(F.array_distinct(F.array_compact(F.array(*cuts)))).alias("prefix"))
    return _keys(both, F.concat_ws("\0", "suffix", "prefix")).select("host", "path", "digest", "short")


def judge(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``; other columns are not read.

    A rule fits its host and all subdomains, if the path starts with the rule's path. The longest rule (host and
    path together, then the longer host, then block) wins. Without a rule: null and ``default``. A null url or one
    without ``://`` has empty parts. Repeated rows stay. Two rules of one host and path: block wins.
    The rule list is a parameter on the driver; its table is broadcast only if Spark finds it small enough.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    known = rule_table(spark, rules).select(
        F.col("short"), F.col("digest").alias("rule_digest"), F.col("verdict").alias("rule_verdict"),
        F.concat("host", "path").alias("rule_text"), F.length("host").alias("host_size"),
    )
    met = expressions(rows.select("host", "path").distinct(), rules).join(known, "short").filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule_text"), "host_size", (F.col("rule_verdict") == "block").cast("int"), "rule_text", "rule_verdict")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule_text").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def op9_urls(spark, folder: str) -> DataFrame:
    from rekindle.llm.base import table

    return judge(table(spark, folder, "pages"))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(h, w, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, h || w AS rule, v,
         row_number() OVER (PARTITION BY host, path, page_id ORDER BY length(h || w) DESC) AS rn
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, w)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE rn = 1
"""
