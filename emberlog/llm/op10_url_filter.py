"""URL filters, native: host-suffix and path-prefix expressions joined on short hash prefixes.

A URL expands into host suffixes (``a.b.com``, ``b.com``, ``com``) times prefixes of its path; an expression's 32-bit hash
prefix is the equi-join key, the full SHA-256 digest confirms it, and the longest rule (host and path together) wins; of equally
long ones, block wins, then the rule's text order. Rules have shapes (labels of the host, length of the path), and a URL has one
expression of each shape: while rules are few enough to broadcast and of few shapes, each shape is one broadcast join and pages are never
shuffled. Else all expressions of each distinct URL are made and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: The rules of the production query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Rules up to this many are broadcast; beyond, the join shuffles both sides on the hash prefix.
BROADCAST_RULES = 200_000
#: Shapes of rules up to this many are a join each.
SHAPES = 32


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def url_parts(url):
    """(host, path) columns: host after the first ``://`` up to / ? # with A-Z lower-cased; path up to ? or #. Null or no ``://``: both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", most_shapes: int = SHAPES) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages`` (column url).

    Null, empty and schemeless URLs have empty host and path, no rule and the default verdict. Rows that repeat stay
    as many rows; columns of ``pages`` named like the four results are replaced by them. Empty tables give empty results
    (no rules: all default). A rule with a null host or path fits nothing.
    """
    spark = pages.sparkSession
    rules = rules.where("rule_host is not null and rule_path is not null").select(
        F.translate("rule_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"), "rule_path", F.coalesce("rule_verdict", F.lit("block")).alias("rule_verdict")
    )
    n_rules = rules.limit(BROADCAST_RULES + 1).count()
    shape = [F.size(F.split("rule_host", r"\.")).alias("m"), F.length("rule_path").alias("n")]
    # Shapes are bounded by hosts' and paths' lengths, so this list is short however many rules there are.
    shapes = sorted((r.m, r.n) for r in rules.select(*shape).distinct().collect())
    expression = F.concat("rule_host", F.lit("\n"), "rule_path")
    rules = rules.select(F.sha2(expression, 256).alias("__digest"), *shape, F.concat("rule_host", "rule_path").alias("__rule"), F.col("rule_verdict").alias("__verdict"))
    rules = rules.groupBy("__digest").agg(F.min("__rule").alias("__rule"), F.max("__verdict").alias("__verdict"), F.first("m").alias("m"), F.first("n").alias("n")).withColumn("__prefix", F.substring("__digest", 1, 8))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, F.col("url").alias("__url"))
    host, path = url_parts(F.col("__url"))
    parts = parts.select(*kept, host.alias("host"), path.alias("path"))
    few = n_rules <= BROADCAST_RULES and len(shapes) <= most_shapes
    out = _by_shape(parts, rules, shapes) if few else _by_expression(parts, rules, sorted({n for _, n in shapes}), n_rules <= BROADCAST_RULES)
    return out.select(*kept, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def _found():
    return F.struct(F.length("__rule").alias("n"), F.col("__verdict").alias("verdict"), F.col("__rule").alias("rule"))


def _by_shape(parts: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``parts`` (host, path) with __best: a broadcast join for each shape, and the best of what they found."""
    labels, best = F.split("host", r"\."), [F.lit(None).cast("struct<n:int,verdict:string,rule:string>")] * 2
    for i, (m, n) in enumerate(shapes):
        fits = (F.col("host") != "") & (F.size(labels) >= m) & (F.length("path") >= n)
        expression = F.concat(F.array_join(F.slice(labels, -m, m), "."), F.lit("\n"), F.substring("path", 1, n))
        parts = parts.withColumn("__d", F.when(fits, F.sha2(expression, 256)))
        own = F.broadcast(rules.where((F.col("m") == m) & (F.col("n") == n)).select(F.col("__prefix").alias("__p"), F.col("__digest").alias("__full"), _found().alias(f"__best{i}")))
        parts = parts.join(own, (F.substring("__d", 1, 8) == F.col("__p")) & (F.col("__d") == F.col("__full")), "left").drop("__d", "__p", "__full")
        best.append(F.col(f"__best{i}"))
    return parts.withColumn("__best", F.greatest(*best))


def _by_expression(parts: DataFrame, rules: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """The same by all expressions of every distinct (host, path): repeated URLs are judged once; those without a host are not joined."""
    rules = F.broadcast(rules) if broadcast else rules
    some = parts.where("host != ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    wide = some.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("__h"), prefixes.alias("__p")).select("host", "path", "__h", F.explode("__p").alias("__p"))
    wide = wide.withColumn("__digest_url", F.sha2(F.concat("__h", F.lit("\n"), "__p"), 256)).withColumn("__prefix", F.substring("__digest_url", 1, 8))
    hits = wide.join(rules.drop("m", "n"), "__prefix").where("__digest_url = __digest")
    judged = hits.groupBy("host", "path").agg(F.max(_found()).alias("__best"))
    none = parts.where("host = ''").withColumn("__best", F.lit(None).cast("struct<n:int,verdict:string,rule:string>"))
    return some.join(judged, ["host", "path"], "left").select(*parts.columns, "__best").unionByName(none)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH p AS (
  SELECT page_id, row_number() OVER () AS rn,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
q AS (SELECT page_id, rn, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
m AS (SELECT q.rn, r.rule_host || r.rule_path AS rule, r.rule_verdict,
             row_number() OVER (PARTITION BY q.rn ORDER BY length(r.rule_host || r.rule_path) DESC, r.rule_verdict DESC, r.rule_host || r.rule_path DESC) AS k
      FROM q JOIN r ON (q.host = r.rule_host OR ends_with(q.host, '.' || r.rule_host)) AND starts_with(q.path, r.rule_path))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.rule_verdict, 'allow') AS verdict
FROM q LEFT JOIN m ON q.rn = m.rn AND m.k = 1
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES))

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE = {"op10_url_filter": SQL}
