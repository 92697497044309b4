"""The given star-schema tables as entities, series and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.filters import of_kind
from .operators.grid import to_tags

MARKERS = ("region", "nation", "customer", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers in one wide table; every 17th key of the latter two has no nation."""
    t = lambda n: table(spark, sf_dir, n)
    yes = F.lit(True)
    region = t("region").select(_id("region", "r_regionkey").alias("id"), F.col("r_name").alias("dis"), yes.alias("region"))
    nation = t("nation").select(_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("dis"), yes.alias("nation"), _id("region", "n_regionkey").alias("regionRef"))
    at = lambda p: F.when(F.col(f"{p}key") % 17 != 0, _id("nation", p[:2] + "nationkey"))
    customer = t("customer").select(_id("customer", "c_custkey").alias("id"), F.col("c_name").alias("dis"), yes.alias("customer"), at("c_cust").alias("nationRef"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    supplier = t("supplier").select(_id("supplier", "s_suppkey").alias("id"), F.col("s_name").alias("dis"), yes.alias("supplier"), at("s_supp").alias("nationRef"), F.col("s_acctbal").alias("acctbal"))
    out = region
    for other in (nation, customer, supplier):
        out = out.unionByName(other, allowMissingColumns=True)
    return of_kind(out, **dict.fromkeys(MARKERS, "marker"))


ENTITIES_SQL = """
entities AS (
  SELECT 'region-' || r_regionkey AS id, r_name AS dis, true AS region, NULL::BOOLEAN AS nation, NULL::BOOLEAN AS customer, NULL::BOOLEAN AS supplier, NULL AS "regionRef", NULL AS "nationRef", NULL::DOUBLE AS acctbal, NULL AS mktsegment FROM region
  UNION ALL SELECT 'nation-' || n_nationkey, n_name, NULL, true, NULL, NULL, 'region-' || n_regionkey, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer-' || c_custkey, c_name, NULL, NULL, true, NULL, NULL, CASE WHEN c_custkey % 17 <> 0 THEN 'nation-' || c_nationkey END, c_acctbal, c_mktsegment FROM customer
  UNION ALL SELECT 'supplier-' || s_suppkey, s_name, NULL, NULL, NULL, true, NULL, CASE WHEN s_suppkey % 17 <> 0 THEN 'nation-' || s_nationkey END, s_acctbal, NULL FROM supplier)"""


def tag_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in tag-map form."""
    return to_tags(entities(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series: one for each user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("").alias("customer_id"), _id("point", "user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("val"), "event_type", "event_id")


SERIES_SQL = "series AS (SELECT '' AS customer_id, 'point-' || user_id AS id, ts, value AS val, event_type, event_id FROM events)"


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions' starts: a customer's state changes with each day's last order."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey", "o_orderdate").agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey").alias("s"))
    return last.select(F.lit("").alias("customer_id"), _id("customer", "o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("start_datetime"), F.col("s.o_orderstatus").alias("status"), F.col("s.o_orderpriority").alias("priority"))


STATES_SQL = """
states AS (
  SELECT '' AS customer_id, 'customer-' || o_custkey AS id, o_orderdate AS start_datetime, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority
  FROM orders GROUP BY o_custkey, o_orderdate),
versions AS (
  SELECT *, coalesce(lead(start_datetime) OVER (PARTITION BY customer_id, id ORDER BY start_datetime) - INTERVAL 1 MICROSECOND, TIMESTAMP '9999-12-31 23:59:59') AS end_datetime FROM states)"""


def snapshots(spark: SparkSession, sf_dir: str, count: int = 4) -> DataFrame:
    """Full snapshots of customers, some missing and some changed from one to the next."""
    c = table(spark, sf_dir, "customer").select(F.lit("").alias("customer_id"), _id("customer", "c_custkey").alias("id"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("acctbal"))
    each = c.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).where((F.col("k") + F.col("n")) % 7 != 0)
    taken = F.timestamp_seconds(F.lit(1704067200) + F.col("n") * 86400)
    return each.select("customer_id", "id", taken.alias("taken"), (F.col("acctbal") + F.floor((F.col("k") % 3 + F.col("n")) / 3)).alias("acctbal"))


SNAPSHOTS_SQL = """
snapshots AS (
  SELECT '' AS customer_id, 'customer-' || c_custkey AS id, TIMESTAMP '2024-01-01' + to_days(n::INTEGER) AS taken, c_acctbal + ((c_custkey % 3 + n) // 3) AS acctbal
  FROM customer, range(4) AS r(n) WHERE (c_custkey + n) % 7 <> 0)"""


def second_snapshot(wide: DataFrame) -> DataFrame:
    """Another state of the entities: every 10th key of customers and suppliers gone, every 7th changed, new ones added."""
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    big = F.coalesce("customer", "supplier", F.lit(False))
    left = wide.where(~(big & (k % 10 == 0)))
    changed = left.withColumn("acctbal", F.when(big & (k % 7 == 0), F.col("acctbal") + 1).otherwise(F.col("acctbal")))
    changed = changed.withColumn("mktsegment", F.when(big & (k % 7 == 1), F.lit(None)).otherwise(F.col("mktsegment")))
    new = wide.where(big & (k % 11 == 0)).withColumn("id", F.concat("id", F.lit("-new")))
    return of_kind(changed.unionByName(new), **dict.fromkeys(MARKERS, "marker"))


SECOND_SQL = """
keyed AS (SELECT *, regexp_extract(id, '([0-9]+)$', 1)::BIGINT AS k, coalesce(customer, supplier, false) AS big FROM entities),
second AS (
  SELECT id, dis, region, nation, customer, supplier, "regionRef", "nationRef", CASE WHEN big AND k % 7 = 0 THEN acctbal + 1 ELSE acctbal END AS acctbal, CASE WHEN big AND k % 7 = 1 THEN NULL ELSE mktsegment END AS mktsegment
  FROM keyed WHERE NOT (big AND k % 10 = 0)
  UNION ALL SELECT id || '-new', dis, region, nation, customer, supplier, "regionRef", "nationRef", acctbal, mktsegment FROM keyed WHERE big AND k % 11 = 0)"""


def tags_sql(name: str, source: str) -> str:
    """SQL for the exploded tags (id, tag, v) of one of the wide tables, as text."""
    cols = {c: f"CASE WHEN {c} THEN 'M' END" for c in MARKERS} | {c: f'"{c}"' for c in ("dis", "regionRef", "nationRef", "mktsegment")} | {"acctbal": "acctbal::VARCHAR"}
    each = " UNION ALL ".join(f"SELECT id, '{c}' AS tag, {e} AS v FROM {source} WHERE {e} IS NOT NULL" for c, e in sorted(cols.items()))
    return f"{name} AS ({each})"
