"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule is a host and a path prefix; it fits the host and all its subdomains where the url's path starts with the
rule's path. Reversed hosts ("com.example.www") turn "host and its subdomains" into a prefix at a label boundary, so a
url meets rules under at most as many such prefixes as the longest rule has labels. Under one prefix a rule covers the
key interval [path, path + 0xFF], and these intervals nest or are disjoint. A sorted sweep over interval starts, ends
and urls carries the top of the stack of active rules: a start puts its rule on top, an end puts back the rule around it.

A prefix that holds many urls is dealt over several sweeps (salts), each with the rules of that prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hub_join, saved

#: Urls of one host prefix that one sweep takes before a further one is opened.
URLS_A_SWEEP = 2_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end; empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _top(rule: Column, verdict: Column, size: Column) -> Column:
    return F.struct(rule.alias("rule"), verdict.alias("verdict"), size.alias("size"))


NEW = ("host", "path", "rule", "verdict")


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of urls.

    rules: host string, path string, verdict string. The longest fitting rule (host and path together, then host)
    wins; of rules that are the same but for the verdict, the greatest verdict ("block" over "allow"). Null or
    unparsable urls have empty host and path, no rule and the default verdict. Repeated rows stay repeated; columns of
    urls that clash with the new names are replaced; empty tables give empty results.
    """
    named_as = [c for c in urls.columns if c not in NEW]
    keep = [f"column {k}" for k in range(len(named_as))]  # the steps' own names are free
    pages = urls.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(named_as, keep, strict=True)], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))

    known = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(reversed_host(F.col("host")).alias("prefix"), "path", "verdict", F.concat("host", "path").alias("rule"), (F.length("host") + F.length("path")).alias("size"))
    )
    # the rule around each rule: the longest other rule of the same prefix whose path starts this one's
    inner = known.select("prefix", F.col("path").alias("inner"), F.explode(F.when(F.length("path") > 0, F.sequence(F.lit(0), F.length("path") - 1)).otherwise(F.array().cast("array<int>"))).alias("n"))
    inner = inner.select("prefix", "inner", F.expr("substring(inner, 1, n)").alias("path"))
    around = inner.join(known, ["prefix", "path"]).groupBy("prefix", "inner").agg(F.max_by(_top(F.col("rule"), F.col("verdict"), F.col("size")), F.length("path")).alias("outer"))
    nested = known.join(around.withColumnRenamed("inner", "path"), ["prefix", "path"], "left")

    labels = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0  # one number
    keys = pages.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("urls"))
    parts = F.reverse(F.split("host", r"\.", -1))
    under = keys.select("host", "path", "urls", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.greatest(F.lit(labels), F.lit(1)))), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("prefix"))
    under = under.join(known.select("prefix").distinct(), "prefix", "left_semi")

    most = 4 * int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sweeps = under.groupBy("prefix").agg(F.least(F.lit(most), F.ceil(F.count("*") / URLS_A_SWEEP)).cast("int").alias("sweeps"))
    dealt = nested.join(sweeps, "prefix").withColumn("salt", F.explode(F.expr("sequence(0, sweeps - 1)")))
    point = F.col("path").cast("binary")
    none = _top(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    nothing, none_ = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    marks = dealt.select("prefix", "salt", point.alias("at"), F.lit(0).alias("kind"), nothing.alias("host"), nothing.alias("path"), none_.alias("urls"), _top(F.col("rule"), F.col("verdict"), F.col("size")).alias("top"))
    marks = marks.unionByName(dealt.select("prefix", "salt", F.concat(point, F.unhex(F.lit("FF"))).alias("at"), F.lit(0).alias("kind"), nothing.alias("host"), nothing.alias("path"), none_.alias("urls"), F.coalesce("outer", none).alias("top")))
    asked = under.join(sweeps, "prefix").select("prefix", F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int").alias("salt"), point.alias("at"), F.lit(1).alias("kind"), "host", "path", "urls", F.lit(None).cast(marks.schema["top"].dataType).alias("top"))
    sweep = Window.partitionBy("prefix", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asked).withColumn("top", F.last("top", ignorenulls=True).over(sweep)).where("kind = 1 AND top.rule IS NOT NULL")
    best = met.groupBy("host", "path").agg(F.max_by("top", F.struct(F.col("top.size"), F.length("prefix"))).alias("top"), F.first("urls").alias("urls"))
    best = saved(best, "judged")  # hub_join reads it three times
    # urls that very many rows have, and rows without a host, are never gathered by their key
    key = F.struct("host", "path").alias("key")
    judged = hub_join(pages.where("host <> ''").select("*", key), best.select(key, "top", "urls"), "key", "urls", "left")
    out = (*keep, "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
    judged = judged.select(*out).unionByName(pages.where("host = ''").select(*keep, "host", "path", nothing.alias("rule"), F.lit(default).alias("verdict")))
    return judged.toDF(*named_as, *NEW)


#: The rules of the registered query: host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    values = ", ".join("('{}', '{}', '{}')".format(*r) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules_table(spark)).drop("url")


ORACLE = r"""
WITH parsed AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""
