"""URL filters as a sort-merge range join.

A host's labels, reversed and each closed by a dot, make a canonical key
(`org.example.`); a rule's key is a prefix of the keys that it fits, so each rule
is an interval of the sorted keys, and intervals either nest or are disjoint. One
sorted sweep over hosts and another over paths keep the stack of open rules: at
each nesting depth the rule opened last is the only one that can still be open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, load, stored

#: Fixed values of the query: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: The verdict where no rule fits: the rules name what is blocked.
DEFAULT = "allow"


def split_url(df: DataFrame) -> DataFrame:
    """Adds host and path: both empty for null or without `://`."""
    has = F.coalesce(F.instr("url", "://") > 0, F.lit(False))
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.when(has, host).otherwise("")).withColumn("path", F.when(has, path).otherwise(""))


def host_key(host: Column) -> Column:
    """a.example.org -> org.example.a."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, intervals: DataFrame, part: list[str], depth: int, salts: int, spread: Column) -> DataFrame:
    """For each point (part, key, ...) the open intervals (part, lo, level, payload) as array `open`.

    Both are dealt by part and a salt, so that a hot part is spread over `salts` tasks;
    the intervals, which are few, go to every salt. Points keep all their columns.
    """
    others = [c for c in points.columns if c not in (*part, "key")]
    p = points.select(*part, "key", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("level"), F.lit(None).cast(intervals.schema["payload"].dataType).alias("payload"), F.struct(*others).alias("point"))
    i = intervals.select(*part, F.col("lo").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), "level", "payload", F.lit(None).cast(p.schema["point"].dataType).alias("point"))
    order = Window.partitionBy(*part, "salt").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [F.last(F.when(F.col("level") == d, F.struct(F.col("key").alias("lo"), "payload")), ignorenulls=True).over(order).alias(f"at{d}") for d in range(1, depth + 1)]
    swept = p.unionByName(i).select("*", *stack).where("side = 1")
    still_open = F.array(*[F.when(F.startswith(F.col("key"), F.col(f"at{d}.lo")), F.col(f"at{d}.payload")) for d in range(1, depth + 1)])
    return swept.select(*part, "key", "point.*", F.array_compact(still_open).alias("open"))


def depth_of(intervals: DataFrame) -> int:
    return intervals.agg(F.max("level")).first()[0] or 0


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each url of `pages` (page_id, url).

    rules (host, path, verdict): a rule fits its host and all subdomains if the url's
    path starts with the rule's; the longest (host and path together, then host, then
    verdict 'block') wins. Defined cases: a null url, or one without `://`, has empty
    host and path and the default verdict; rules with a null or empty host never fit,
    a null rule path is empty; exact repeats of (page_id, url) come back as often as
    given; other columns of pages are not used; empty tables give an empty result or
    default verdicts.
    """
    spark = pages.sparkSession
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = rules.where("host <> ''").select(F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    # one rule for each host and path; block wins over allow
    own = stored(own.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("rule_host", host_key(F.col("host"))))

    top = F.substring_index("key", ".", 1).alias("top")
    hosts = own.select("rule_host").distinct().select(F.substring_index("rule_host", ".", 1).alias("top"), F.col("rule_host").alias("lo"), (F.size(F.split("rule_host", r"\.")) - 1).alias("level"), F.col("rule_host").alias("payload"))
    # nesting depth of a rule's path among the paths of the same host
    prefixes = own.select("rule_host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).select("rule_host", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    level = prefixes.join(own.select("rule_host", F.col("path").alias("prefix")), ["rule_host", "prefix"]).groupBy("rule_host", "path").agg(F.count("*").cast("int").alias("level"))
    paths = own.join(level, ["rule_host", "path"]).select("rule_host", F.col("path").alias("lo"), "level", F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), "verdict", F.concat("host", "path").alias("rule")).alias("payload"))

    urls = split_url(pages.select("page_id", "url")).groupBy("page_id", "url", "host", "path").agg(F.count("*").cast("int").alias("times"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("top", F.substring_index("key", ".", 1))
    by_host = sweep(urls, hosts, ["top"], max(1, depth_of(hosts)), salts, F.struct("page_id", "url"))
    tries = by_host.select("page_id", "url", "host", "path", "times", F.explode_outer("open").alias("rule_host")).withColumn("key", F.col("path"))
    by_path = sweep(tries, paths, ["rule_host"], max(1, depth_of(paths)), salts, F.struct("page_id", "url"))
    best = by_path.groupBy("page_id", "url", "host", "path", "times").agg(F.max(F.array_max("open")).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_i")).drop("_i")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = {
    "op3_url_filter": """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, url, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, r,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT p.*, rhost, rpath, rverdict, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, rverdict DESC) AS k
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
}
