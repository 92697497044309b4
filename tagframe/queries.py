"""The registered queries of the library, and the same in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from .functions import kinds, ranges, tz, units, zinc
from .jobs import series as ts
from .jobs import stored
from .jobs import versions as ver
from .model import ENTITIES_SQL, SECOND_SQL, SERIES_SQL, SNAPSHOTS_SQL, STATES_SQL, tags_sql
from .operators import diff, filters, graph, grid
from .sources import formats
from .sources.shared import shared_path
from .streaming import live, state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def us(c: str):
    return F.unix_micros(c).alias(c)


def _filter(name: str, text: str, condition: str, limit: int = 0, joins: str = "", mapped: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = model.tag_entities(spark, d) if mapped else model.entities(spark, d)
        out = filters.where(e, text, limit)
        return out.select("id", F.col("tags")["dis"]["str"].alias("dis"), F.col("tags")["acctbal"]["num"].alias("acctbal")) if mapped else out.select("id", "dis", "acctbal")

    tail = f" ORDER BY e.id LIMIT {limit}" if limit else ""
    QUERIES[name] = run
    SQL[name] = f"WITH {ENTITIES_SQL} SELECT e.id, e.dis, e.acctbal FROM entities e {joins} WHERE {condition}{tail}"


_TWO = 'LEFT JOIN entities n ON e."nationRef" = n.id LEFT JOIN entities r ON n."regionRef" = r.id'
_filter("filter_path", 'customer and nationRef->regionRef->dis == "ASIA" and acctbal > 5000', "e.customer AND r.dis = 'ASIA' AND e.acctbal > 5000", joins=_TWO)
_filter("filter_path_tag_map", 'customer and nationRef->regionRef->dis == "ASIA" and acctbal > 5000', "e.customer AND r.dis = 'ASIA' AND e.acctbal > 5000", joins=_TWO, mapped=True)
_filter("filter_has_not", "(customer or supplier) and not nationRef", '(e.customer OR e.supplier) AND e."nationRef" IS NULL')
_filter("filter_missing_path", "not nationRef->regionRef and acctbal", 'n."regionRef" IS NULL AND e.acctbal IS NOT NULL', joins=_TWO)
_filter("filter_missing_path_tag_map", "not nationRef->regionRef and acctbal", 'n."regionRef" IS NULL AND e.acctbal IS NOT NULL', joins=_TWO, mapped=True)
_filter("filter_precedence", 'mktsegment == "BUILDING" or supplier and acctbal <= 0', "coalesce(e.mktsegment = 'BUILDING', false) OR coalesce(e.supplier AND e.acctbal <= 0, false)")
_filter("filter_not_equal", 'mktsegment != "BUILDING"', "e.mktsegment <> 'BUILDING'")
_filter("filter_not_equal_tag_map", 'mktsegment != "BUILDING" and nationRef != @nation-3', "e.mktsegment <> 'BUILDING' AND e.\"nationRef\" <> 'nation-3'", mapped=True)
_filter("filter_null", "mktsegment == N and acctbal != N", "e.mktsegment IS NULL AND e.acctbal IS NOT NULL")
_filter("filter_ref", "nationRef == @nation-3 or regionRef == @region-2", "e.\"nationRef\" = 'nation-3' OR e.\"regionRef\" = 'region-2'")
_filter("filter_kind_mismatch", 'acctbal != "x" and dis != 3', "e.acctbal IS NOT NULL AND e.dis IS NOT NULL")
_filter("filter_limit", "acctbal >= 1000", "e.acctbal >= 1000", limit=25)
_filter("filter_all", "", "true")
_filter("filter_or_paths", 'nationRef->dis == "NATION_7" or nationRef->regionRef->dis == "EUROPE" or regionRef->dis == "EUROPE"', "coalesce(n.dis = 'NATION_7', false) OR coalesce(r.dis = 'EUROPE', false) OR coalesce(x.dis = 'EUROPE', false)", joins=_TWO + ' LEFT JOIN entities x ON e."regionRef" = x.id')


@query("filter_nested", "SELECT event_id, user_id FROM events WHERE (props::JSON ->> '$.k')::DOUBLE > 50")
def filter_nested(spark, d):
    e = model.table(spark, d, "events").withColumn("props", F.from_json("props", "k double"))
    return filters.where(e.withColumn("id", F.col("event_id")), "props->k > 50").select("event_id", "user_id")


def _event_tags(spark, d):
    """events as tag maps with a dict and a list."""
    e = model.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    props = F.concat(F.lit('{"k":"n:'), F.format_string("%.6f", k), F.lit('","user":"r:point-'), F.col("user_id").cast("string"), F.lit('"}'))
    pair = F.concat(F.lit('["n:'), (F.col("user_id") % 3).cast("string"), F.lit('.000000","s:'), "event_type", F.lit('"]'))
    tags = F.create_map(F.lit("props"), kinds.value("dict", props), F.lit("pair"), kinds.value("list", pair), F.lit("type"), kinds.string(F.col("event_type")))
    return e.select(F.col("event_id").cast("string").alias("id"), "event_id", tags.cast(kinds.TAGS).alias("tags"))


@query("filter_nested_tag_map", "SELECT event_id FROM events WHERE (props::JSON ->> '$.k')::DOUBLE > 50 AND user_id <> 7")
def filter_nested_tag_map(spark, d):
    return filters.where(_event_tags(spark, d), "props->k > 50 and props->user != @point-7 and not props->nothing").select("event_id")


@query("filter_list_equal", "SELECT event_id FROM events WHERE user_id % 3 = 1 AND event_type = 'click' OR user_id = 9 AND (props::JSON ->> '$.k')::DOUBLE = 3")
def filter_list_equal(spark, d):
    return filters.where(_event_tags(spark, d), 'pair == [1, "click"] or props == {k: 3, user: @point-9}').select("event_id")


@query("filter_datetime", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_totalprice > 100000")
def filter_datetime(spark, d):
    o = model.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return filters.where(o, "o_orderdate >= 1996-01-01T00:00:00 and o_orderdate < 1997-01-01T00:00:00 and o_totalprice > 100000").select(F.col("id").alias("o_orderkey"))


@query("filter_tenant", "SELECT c_custkey AS id, c_name AS dis FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def filter_tenant(spark, d):
    c = model.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("dis"), F.col("c_mktsegment").alias("customer_id"), F.col("c_acctbal").alias("acctbal"))
    return filters.where(c, "acctbal > 0", tenant="BUILDING").select("id", "dis")


@query("read_by_ids", f"WITH {ENTITIES_SQL} SELECT id, dis FROM entities WHERE id IN (SELECT 'customer-' || o_custkey FROM orders WHERE o_totalprice > 300000)")
def read_by_ids(spark, d):
    ids = model.table(spark, d, "orders").where("o_totalprice > 300000").select(F.concat(F.lit("customer-"), "o_custkey").alias("id"))
    return filters.by_ids(model.entities(spark, d), ids).select("id", "dis")


@query("select_keep", f"WITH {ENTITIES_SQL} SELECT dis, id, NULL::VARCHAR AS nothing FROM entities")
def select_keep(spark, d):
    return grid.selected(model.entities(spark, d), "dis,id,nothing")


@query("select_drop", f"WITH {ENTITIES_SQL} SELECT id, dis, \"regionRef\", \"nationRef\", acctbal, mktsegment FROM entities")
def select_drop(spark, d):
    return grid.selected(model.entities(spark, d), "!region,!nation,!customer,!supplier")


def _text():
    return F.when(F.col("value.kind") == "number", F.lit(None)).otherwise(F.col("value.str"))



@query("tags_exploded", f"WITH {ENTITIES_SQL}, {tags_sql('tags', 'entities')} SELECT id, tag, CASE WHEN tag <> 'acctbal' THEN v END AS text, CASE WHEN tag = 'acctbal' THEN v::DOUBLE END AS num FROM tags")
def tags_exploded(spark, d):
    return grid.exploded(model.tag_entities(spark, d)).select("id", "tag", _text().alias("text"), F.col("value.num").alias("num"))


@query("tags_wide_again", f"WITH {ENTITIES_SQL} SELECT id, dis, customer, acctbal, \"nationRef\" FROM entities")
def tags_wide_again(spark, d):
    return grid.to_wide(model.tag_entities(spark, d), {"dis": "str", "customer": "marker", "acctbal": "float", "nationRef": "ref"})


@query("purge_tags", f"WITH {ENTITIES_SQL} SELECT id, 'dis' AS tag, dis AS text, NULL::DOUBLE AS num FROM entities UNION ALL SELECT id, 'acctbal', NULL, acctbal FROM entities WHERE acctbal IS NOT NULL")
def purge_tags(spark, d):
    return grid.exploded(grid.purged(model.tag_entities(spark, d), ["dis", "acctbal"])).select("id", "tag", _text().alias("text"), F.col("value.num").alias("num"))


@query("extend_columns", f"WITH {ENTITIES_SQL}, {tags_sql('tags', 'entities')} SELECT tag, count(*) AS entities FROM tags GROUP BY tag")
def extend_columns(spark, d):
    return grid.all_tags(model.tag_entities(spark, d))


@query("pack_columns", f"WITH {ENTITIES_SQL} SELECT id, dis, nation, \"regionRef\" FROM entities WHERE nation")
def pack_columns(spark, d):
    return grid.packed(model.entities(spark, d).where("nation"))


@query("tag_values", f"WITH {ENTITIES_SQL} SELECT DISTINCT mktsegment AS value FROM entities WHERE mktsegment IS NOT NULL")
def tag_values(spark, d):
    return grid.tag_values(model.entities(spark, d), "mktsegment")


@query("repeated_ids", "SELECT o_custkey AS id, count(*) AS rows FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_ids(spark, d):
    return grid.repeated_ids(model.table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("marker_tags", f"WITH {ENTITIES_SQL} SELECT id, CASE WHEN region THEN 'region' WHEN nation THEN 'nation' WHEN customer THEN 'customer' ELSE 'supplier' END AS markers FROM entities")
def marker_tags(spark, d):
    return grid.markers(model.tag_entities(spark, d)).select("id", F.array_join("markers", ",").alias("markers"))


@query("sorted_page", f"WITH {ENTITIES_SQL} SELECT id, dis FROM entities ORDER BY dis, id LIMIT 50 OFFSET 20")
def sorted_page(spark, d):
    return grid.page(model.entities(spark, d).select("id", "dis"), 20, 70, "dis", "id")


@query("delete_rows", f"WITH {ENTITIES_SQL} SELECT id, dis FROM entities WHERE NOT (coalesce(customer, false) AND \"nationRef\" IS NULL)")
def delete_rows(spark, d):
    e = model.entities(spark, d)
    return grid.without(e, filters.where(e, "customer and not nationRef")).select("id", "dis")


@query("upsert_rows", f"WITH {ENTITIES_SQL}, {SECOND_SQL} SELECT id, acctbal FROM second UNION ALL SELECT id, acctbal FROM entities WHERE id NOT IN (SELECT id FROM second)")
def upsert_rows(spark, d):
    e = model.entities(spark, d)
    return grid.upserted(e, model.second_snapshot(e)).select("id", "acctbal")


@query("display_names", f"WITH {ENTITIES_SQL} SELECT id, CASE WHEN customer THEN id ELSE dis END AS name FROM entities")
def display_names(spark, d):
    e = model.entities(spark, d)
    return e.select("id", grid.display_name(kinds.ref(F.col("id")), F.when(F.col("customer").isNull(), F.col("dis"))).alias("name"))


# diff, patch, merge


def _two(spark, d):
    e = model.entities(spark, d)
    return grid.to_tags(e), grid.to_tags(model.second_snapshot(e))


_BOTH = f"WITH {ENTITIES_SQL}, {SECOND_SQL}, {tags_sql('a', 'entities')}, {tags_sql('b', 'second')}"
_CHANGES = """, c AS (
  SELECT coalesce(a.id, b.id) AS id, coalesce(a.tag, b.tag) AS tag, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.id = b.id AND a.tag = b.tag WHERE a.v IS DISTINCT FROM b.v),
o AS (SELECT id, tag, CASE WHEN id NOT IN (SELECT id FROM entities) THEN 'insert' WHEN id NOT IN (SELECT id FROM second) THEN 'delete' WHEN old IS NULL THEN 'add' WHEN new IS NULL THEN 'drop' ELSE 'change' END AS op, old, new FROM c)"""


@query("diff_changes", f"{_BOTH}{_CHANGES} SELECT id, tag, op, CASE WHEN tag <> 'acctbal' THEN old END AS old_text, CASE WHEN tag <> 'acctbal' THEN new END AS new_text, CASE WHEN tag = 'acctbal' THEN old::DOUBLE END AS old_num, CASE WHEN tag = 'acctbal' THEN new::DOUBLE END AS new_num FROM o")
def diff_changes(spark, d):
    text = lambda c: F.when(F.col(f"{c}.kind") != "number", F.col(f"{c}.str")).alias(f"{c}_text")
    return diff.changes(*_two(spark, d)).select("id", "tag", "op", text("old"), text("new"), F.col("old.num").alias("old_num"), F.col("new.num").alias("new_num"))


@query("diff_patch", f"{_BOTH}{_CHANGES} SELECT DISTINCT id, 'remove_' AS tag, 'remove' AS kind FROM o WHERE op = 'delete' UNION ALL SELECT id, tag, CASE WHEN op = 'drop' THEN 'remove' WHEN tag = 'acctbal' THEN 'number' WHEN tag IN ('customer', 'supplier') THEN 'marker' WHEN tag LIKE '%Ref' THEN 'ref' ELSE 'str' END AS kind FROM o WHERE op <> 'delete'")
def diff_patch(spark, d):
    return grid.exploded(diff.patch_of(*_two(spark, d))).select("id", "tag", F.col("value.kind").alias("kind"))


@query("patch_law", f"WITH {ENTITIES_SQL}, {SECOND_SQL} SELECT id, acctbal, mktsegment, \"nationRef\" FROM second")
def patch_law(spark, d):
    a, b = _two(spark, d)
    return grid.to_wide(diff.patched(a, diff.patch_of(a, b)), {"acctbal": "float", "mktsegment": "str", "nationRef": "ref"})


@query("merge_grids", f"WITH {ENTITIES_SQL}, {SECOND_SQL} SELECT coalesce(a.id, b.id) AS id, coalesce(b.acctbal, a.acctbal) AS acctbal, coalesce(b.mktsegment, a.mktsegment) AS mktsegment FROM entities a FULL JOIN second b ON a.id = b.id")
def merge_grids(spark, d):
    return grid.to_wide(diff.patched(*_two(spark, d)), {"acctbal": "float", "mktsegment": "str"})


_ROWS = ["l_returnflag", "l_linestatus", "l_quantity"]


def _rows(spark, d):
    rows = model.table(spark, d, "lineitem")
    return rows.select(*_ROWS), rows.where("l_linenumber <> 3").select(*_ROWS[:2], F.when(F.col("l_linenumber") == 5, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"))


_LR = "WITH l AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem), r AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = 5 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_linenumber <> 3)"


@query("diff_rows", f"{_LR} SELECT *, true AS remove_ FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, false FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)")
def diff_rows(spark, d):
    return diff.row_patch(*_rows(spark, d))


@query("patch_rows", f"{_LR} SELECT * FROM r")
def patch_rows(spark, d):
    left, right = _rows(spark, d)
    return diff.rows_patched(left, diff.row_patch(left, right))


@query("approximate_equality", f"{_BOTH}{_CHANGES} SELECT id, tag FROM o")
def approximate_equality(spark, d):
    return diff.mismatches(*_two(spark, d))


@query("approximate_rows", "SELECT l_orderkey, l_linenumber, l_extendedprice AS price, 'left' AS side FROM lineitem WHERE l_linenumber = 3 UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN l_extendedprice ELSE l_extendedprice + 0.01 END, side FROM lineitem, (VALUES ('left'), ('right')) v(side) WHERE l_linenumber = 2 AND side = 'left' UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice + 0.01, 'right' FROM lineitem WHERE l_linenumber = 2")
def approximate_rows(spark, d):
    """Prices a little off match, also across the limits of cells; prices a cent off do not."""
    rows = model.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    right = rows.where("l_linenumber <> 3").withColumn("price", F.when(F.col("l_linenumber") == 2, F.col("price") + 0.01).otherwise(F.col("price") + 5e-7))
    return diff.same_rows(rows, right, 1e-6).withColumn("price", F.round("price", 3))


SQL["approximate_rows"] = f"SELECT l_orderkey, l_linenumber, round(price, 3) AS price, side FROM ({SQL['approximate_rows']})"


@query("merge_sources", f"""{_BOTH}, u AS (SELECT 'a' AS source, * FROM a UNION ALL SELECT 'b', * FROM b), g AS (SELECT id, tag, count(DISTINCT v) AS n, min(v) AS v FROM u GROUP BY id, tag),
m AS (SELECT id, tag, tag AS plain, v FROM g WHERE n = 1 UNION ALL SELECT id, u.tag || '^' || source, u.tag, u.v FROM u JOIN g USING (id, tag) WHERE n > 1),
s AS (SELECT id, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT id, source FROM u) GROUP BY id)
SELECT id, tag, CASE WHEN plain <> 'acctbal' THEN v END AS text, CASE WHEN plain = 'acctbal' THEN v::DOUBLE END AS num, sources FROM m JOIN s USING (id)""")
def merge_sources(spark, d):
    a, b = _two(spark, d)
    rows = a.withColumn("source", F.lit("a")).unionByName(b.withColumn("source", F.lit("b")))
    return grid.exploded(diff.merged_sources(rows), "id", "sources").select("id", "tag", _text().alias("text"), F.col("value.num").alias("num"), F.array_join("sources", ",").alias("sources"))


# versions


def _versions(spark, d):
    return ver.closed(model.order_states(spark, d))


@query("version_intervals", f"WITH {STATES_SQL} SELECT id, epoch_us(start_datetime) AS start_datetime, epoch_us(end_datetime) AS end_datetime, status FROM versions")
def version_intervals(spark, d):
    return _versions(spark, d).select("id", us("start_datetime"), us("end_datetime"), "status")


@query("version_as_of", f"WITH {STATES_SQL} SELECT id, status, priority FROM versions WHERE start_datetime <= TIMESTAMP '1996-06-01 23:59:59' AND end_datetime >= TIMESTAMP '1996-06-01 23:59:59'")
def version_as_of(spark, d):
    import datetime as dt

    return ver.as_of(_versions(spark, d), dt.date(1996, 6, 1)).select("id", "status", "priority")


_V = "versions WHERE start_datetime <= TIMESTAMP '1997-01-01 12:00:00' AND end_datetime >= TIMESTAMP '1997-01-01 12:00:00'"


@query("version_filter", f"WITH {STATES_SQL}, v AS (SELECT *, 'customer-' || (regexp_extract(id, '([0-9]+)$', 1)::BIGINT // 2) AS \"parentRef\" FROM {_V}) SELECT v.id FROM v JOIN v p ON v.\"parentRef\" = p.id WHERE v.status = 'O' AND p.status <> 'O'")
def version_filter(spark, d):
    """A reference between versioned entities: both sides are as of the same time."""
    rows = ver.as_of(_versions(spark, d), "1997-01-01 12:00:00")
    parent = F.floor(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") / 2)
    return filters.where(rows.withColumn("parentRef", F.concat(F.lit("customer-"), parent.cast("string"))), 'status == "O" and parentRef->status != "O"').select("id")


@query("version_dates", f"WITH {STATES_SQL} SELECT DISTINCT epoch_us(start_datetime) AS start_datetime FROM versions")
def version_dates(spark, d):
    return ver.version_dates(_versions(spark, d)).select(us("start_datetime"))


@query("version_latest", f"WITH {STATES_SQL} SELECT id, arg_max(status, start_datetime) AS status FROM states GROUP BY id")
def version_latest(spark, d):
    return ver.latest(model.order_states(spark, d), ("id",), "start_datetime").select("id", "status")


@query(
    "version_history",
    f"""WITH {SNAPSHOTS_SQL}, t AS (SELECT taken, lead(taken) OVER (ORDER BY taken) AS nx FROM (SELECT DISTINCT taken FROM snapshots)),
r AS (SELECT s.*, nx, lag(acctbal) OVER w AS pa, lag(nx) OVER w AS pn FROM snapshots s JOIN t USING (taken) WINDOW w AS (PARTITION BY id ORDER BY taken)),
f AS (SELECT *, sum(CASE WHEN pn IS NULL OR pn <> taken OR pa IS DISTINCT FROM acctbal THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY taken) AS run FROM r)
SELECT id, epoch_us(min(taken)) AS start_datetime, epoch_us(CASE WHEN max(taken) = TIMESTAMP '2024-01-04' THEN TIMESTAMP '9999-12-31 23:59:59' ELSE max(nx) - INTERVAL 1 MICROSECOND END) AS end_datetime, min(acctbal) AS acctbal FROM f GROUP BY id, run""",
)
def version_history(spark, d):
    return ver.history(model.snapshots(spark, d), F.struct("acctbal")).select("id", us("start_datetime"), us("end_datetime"), "acctbal")


_NOW = "2020-01-01 00:00:00"


@query(
    "version_update",
    f"""WITH {STATES_SQL}, n AS (SELECT 'customer-' || c_custkey AS id, c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 = 0),
o AS (SELECT v.*, n.c_custkey AS k, c_mktsegment FROM versions v LEFT JOIN n ON v.id = n.id AND end_datetime = TIMESTAMP '9999-12-31 23:59:59')
SELECT id, epoch_us(start_datetime) AS start_datetime, epoch_us(CASE WHEN k IS NULL THEN end_datetime ELSE TIMESTAMP '{_NOW}' - INTERVAL 1 MICROSECOND END) AS end_datetime, status FROM o
UNION ALL SELECT id, epoch_us(TIMESTAMP '{_NOW}'), epoch_us(TIMESTAMP '9999-12-31 23:59:59'), c_mktsegment FROM o WHERE k IS NOT NULL AND k % 10 <> 0
UNION ALL SELECT id, epoch_us(TIMESTAMP '{_NOW}'), epoch_us(TIMESTAMP '9999-12-31 23:59:59'), c_mktsegment FROM n WHERE c_custkey % 10 <> 0 AND id NOT IN (SELECT id FROM states)""",
)
def version_update(spark, d):
    c = model.table(spark, d, "customer").where("c_custkey % 5 = 0")
    patch = c.select(F.lit("").alias("customer_id"), F.concat(F.lit("customer-"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), (F.col("c_custkey") % 10 == 0).alias("gone"))
    return ver.changed(_versions(spark, d), patch, _NOW, F.col("gone")).select("id", us("start_datetime"), us("end_datetime"), "status")


@query(
    "version_patch",
    f"""{_BOTH}{_CHANGES}, h AS (SELECT DISTINCT id FROM o),
v AS (SELECT id, tag, v, TIMESTAMP '2019-01-01' AS s, CASE WHEN id IN (SELECT id FROM h) THEN TIMESTAMP '{_NOW}' - INTERVAL 1 MICROSECOND ELSE TIMESTAMP '9999-12-31 23:59:59' END AS e FROM a
UNION ALL SELECT id, tag, v, TIMESTAMP '{_NOW}', TIMESTAMP '9999-12-31 23:59:59' FROM b WHERE id IN (SELECT id FROM h))
SELECT id, epoch_us(s) AS start_datetime, epoch_us(e) AS end_datetime, tag, CASE WHEN tag <> 'acctbal' THEN v END AS text, CASE WHEN tag = 'acctbal' THEN v::DOUBLE END AS num FROM v""",
)
def version_patch(spark, d):
    """A diff of tag maps applied to their versions."""
    a, b = _two(spark, d)
    tenant = F.lit("").alias("customer_id")
    versions = a.select(tenant, "id", F.lit("2019-01-01").cast("timestamp").alias("start_datetime"), F.lit(ver.END).cast("timestamp").alias("end_datetime"), "tags")
    out = ver.changed(versions, diff.patch_of(a, b).select(tenant, "id", "tags"), _NOW)
    return grid.exploded(out, "id", "start_datetime", "end_datetime").select("id", us("start_datetime"), us("end_datetime"), "tag", _text().alias("text"), F.col("value.num").alias("num"))


@query(
    "version_metadata",
    """WITH m AS (SELECT o_orderpriority AS customer_id, date_trunc('month', o_orderdate) AS taken, max(o_orderstatus) || min(o_orderstatus) AS metadata, CASE WHEN count(*) % 2 = 0 THEN 'a' ELSE 'b' END AS cols FROM orders GROUP BY 1, 2),
r AS (SELECT *, lag(metadata) OVER w AS pm, lag(cols) OVER w AS pc, lead(taken) OVER w AS nx, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY customer_id ORDER BY taken)),
f AS (SELECT *, sum(CASE WHEN n = 1 OR pm <> metadata OR pc <> cols THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY taken) AS run FROM r)
SELECT customer_id, min(metadata) AS metadata, min(cols) AS cols, epoch_us(min(taken)) AS start_datetime, epoch_us(coalesce(arg_max(nx, taken) - INTERVAL 1 MICROSECOND, CASE WHEN max(run) = max(max(run)) OVER (PARTITION BY customer_id) THEN TIMESTAMP '9999-12-31 23:59:59' END)) AS end_datetime FROM f GROUP BY customer_id, run""",
)
def version_metadata(spark, d):
    o = model.table(spark, d, "orders").select(F.col("o_orderpriority").alias("customer_id"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("taken"), "o_orderstatus")
    m = o.groupBy("customer_id", "taken").agg(F.concat(F.max("o_orderstatus"), F.min("o_orderstatus")).alias("metadata"), F.when(F.count("*") % 2 == 0, "a").otherwise("b").alias("cols"))
    return ver.metadata_history(m).select("customer_id", "metadata", "cols", us("start_datetime"), us("end_datetime"))


_SHIP = "ships AS (SELECT l_orderkey, l_linenumber, 'customer-' || o_custkey AS id, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _ships(spark, d):
    li = model.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("ts"))
    o = model.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("customer-"), "o_custkey").alias("id"))
    return li.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "id", "ts")


_AT = f"WITH {STATES_SQL}, {_SHIP} SELECT l_orderkey, l_linenumber, status FROM ships s LEFT JOIN versions v ON s.id = v.id AND v.start_datetime <= s.ts AND s.ts <= v.end_datetime"


@query("point_in_time_join", _AT)
def point_in_time_join(spark, d):
    return ver.at_each_time(_ships(spark, d), _versions(spark, d)).select("l_orderkey", "l_linenumber", "status")


@query("point_in_time_window", _AT)
def point_in_time_window(spark, d):
    return ver.at_each_time_by_window(_ships(spark, d), _versions(spark, d), "status").select("l_orderkey", "l_linenumber", "status")


@query("purge_tenant", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def purge_tenant(spark, d):
    return ver.purged(model.table(spark, d, "customer").withColumn("customer_id", F.col("c_mktsegment")), "BUILDING").select("c_custkey")


# series


@query("series_range", f"WITH {SERIES_SQL}, b AS (SELECT min(ts) + (max(ts) - min(ts)) / 4 AS lo FROM series) SELECT id, epoch_us(ts) AS ts, val, lag(epoch_us(ts)) OVER (PARTITION BY id ORDER BY ts) AS before FROM series WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00'")
def series_range(spark, d):
    """Points with the time of the one before, as the rows themselves are ordered."""
    points = ts.by_time(ts.read(model.series(spark, d), "2024-01-05 00:00:00", "2024-02-01 00:00:00", version="2024-01-20 12:00:00")).select("id", us("ts"), "val")

    def before(batches):
        last = (None, None)
        for t in batches:
            previous = []
            for key, at in zip(t["id"].to_pylist(), t["ts"].to_pylist(), strict=True):
                previous.append(last[1] if last[0] == key else None)
                last = (key, at)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(previous, pa.int64())], [*t.schema.names, "before"])

    return points.mapInArrow(before, "id string, ts bigint, val double, before bigint")


@query("series_bounds", f"WITH {SERIES_SQL} SELECT 'point-' || c_custkey AS id, epoch_us(coalesce(min(ts), TIMESTAMP '2024-01-01')) AS his_start, epoch_us(coalesce(max(ts), TIMESTAMP '2024-01-01')) AS his_end, count(ts) AS points FROM customer LEFT JOIN series ON id = 'point-' || c_custkey GROUP BY c_custkey")
def series_bounds(spark, d):
    ids = model.table(spark, d, "customer").select(F.concat(F.lit("point-"), "c_custkey").alias("id"))
    return ts.bounds(model.series(spark, d), ids, "2024-01-01 00:00:00").select("id", us("his_start"), us("his_end"), "points")


@query("series_of_filter", f"WITH {ENTITIES_SQL}, {SERIES_SQL} SELECT id, event_id, val FROM series WHERE replace(id, 'point-', 'customer-') IN (SELECT e.id FROM entities e LEFT JOIN entities n ON e.\"nationRef\" = n.id LEFT JOIN entities r ON n.\"regionRef\" = r.id WHERE e.customer AND r.dis = 'ASIA')")
def series_of_filter(spark, d):
    e = filters.where(model.entities(spark, d), 'customer and nationRef->regionRef->dis == "ASIA"')
    return ts.of_entities(model.series(spark, d), e.select(F.replace("id", F.lit("customer-"), F.lit("point-")).alias("id"))).select("id", "event_id", "val")


@query("series_with_history", f"WITH {SERIES_SQL} SELECT 'point-' || c_custkey AS id, count(ts) AS points FROM customer LEFT JOIN series ON id = 'point-' || c_custkey GROUP BY c_custkey")
def series_with_history(spark, d):
    return ts.with_history(model.table(spark, d, "customer").select(F.concat(F.lit("point-"), "c_custkey").alias("id")), model.series(spark, d))


@query("series_numeric", f"WITH {SERIES_SQL} SELECT id, min(k) = max(k) AND max(k) = 'number' AS numeric FROM (SELECT id, CASE WHEN event_type = 'purchase' THEN 'str' ELSE 'number' END AS k FROM series) GROUP BY id")
def series_numeric(spark, d):
    return ts.numeric_series(model.series(spark, d).withColumn("kind", F.when(F.col("event_type") == "purchase", "str").otherwise("number")))


_NEW = "new AS (SELECT id, ts, val + 1 AS val FROM series WHERE event_id % 5 = 0)"


def _new(spark, d):
    s = model.series(spark, d).select("id", "ts", "val", "event_id")
    return s.select("id", "ts", "val"), s.where("event_id % 5 = 0").select("id", "ts", (F.col("val") + 1).alias("val"))


@query("series_replace_period", f"WITH {SERIES_SQL}, {_NEW}, b AS (SELECT id, min(ts) AS lo, max(ts) AS hi FROM new GROUP BY id) SELECT s.id, epoch_us(ts) AS ts, val FROM series s LEFT JOIN b ON s.id = b.id WHERE lo IS NULL OR ts < lo OR ts > hi UNION ALL SELECT id, epoch_us(ts), val FROM new")
def series_replace_period(spark, d):
    return ts.period_replaced(*_new(spark, d)).select("id", us("ts"), "val")


@query("series_prepend_older", f"WITH {SERIES_SQL}, {_NEW}, b AS (SELECT id, min(ts) AS lo FROM new GROUP BY id) SELECT id, epoch_us(ts) AS ts, val FROM new UNION ALL SELECT s.id, epoch_us(ts), val FROM series s LEFT JOIN b ON s.id = b.id WHERE lo IS NULL OR ts < lo")
def series_prepend_older(spark, d):
    s, new = _new(spark, d)
    return ts.older_prepended(new, s).select("id", us("ts"), "val")


def _values(spark, d):
    """Events as values of several kinds, one kind for each series but for a few strays."""
    k = F.pmod(F.regexp_extract("id", r"(\d+)$", 1).cast("int") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0), F.lit(5))
    v = F.when(k == 0, kinds.number(F.col("val"), F.lit("kW"))).when(k == 1, kinds.string(F.col("event_type"))).when(k == 2, kinds.value("bool", (F.col("val") > 50).cast("string"), num=(F.col("val") > 50).cast("double"))).when(k == 3, kinds.value("date", F.to_date("ts").cast("string"))).otherwise(kinds.datetime(F.date_trunc("second", "ts")))
    return model.series(spark, d).select("id", "ts", "event_id", v.cast(kinds.TAG_VALUE).alias("val"))


_VALUES = """v AS (SELECT id, ts, event_id, val, event_type, (regexp_extract(id, '([0-9]+)$', 1)::INT + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) % 5 AS k FROM series),
f AS (SELECT id, arg_min(k, ts) AS fk FROM v GROUP BY id)"""


@query(
    "series_to_store",
    f"""WITH {SERIES_SQL}, {_VALUES} SELECT event_id, ['number', 'str', 'bool', 'date', 'datetime'][fk + 1] AS hs_type, CASE WHEN fk = 0 THEN 'kW' END AS unit, CASE WHEN k = fk AND k = 0 THEN val END AS val_double, CASE WHEN k = fk AND k = 1 THEN event_type END AS val_varchar,
CASE WHEN k = fk AND k = 2 THEN val > 50 END AS val_boolean, CASE WHEN k = fk AND k = 3 THEN date_diff('day', DATE '1970-01-01', ts::DATE) + 719163 WHEN k = fk AND k = 4 THEN epoch_us(date_trunc('second', ts)) // 1000000 END AS val_bigint FROM v JOIN f USING (id)""",
)
def series_to_store(spark, d):
    return ts.to_store(_values(spark, d)).select("event_id", "hs_type", "unit", "val_double", "val_varchar", "val_boolean", "val_bigint")


@query("series_from_store", f"WITH {SERIES_SQL}, {_VALUES} SELECT event_id, CASE WHEN k = fk THEN ['number', 'str', 'bool', 'date', 'datetime'][k + 1] END AS kind, CASE WHEN k = fk AND k = 0 THEN val WHEN k = fk AND k = 2 THEN (val > 50)::INT::DOUBLE END AS num, CASE WHEN k = fk AND k = 4 THEN epoch_us(date_trunc('second', ts)) END AS at FROM v JOIN f USING (id)")
def series_from_store(spark, d):
    back = ts.from_store(ts.to_store(_values(spark, d)))
    return back.select("event_id", F.col("val.kind").alias("kind"), F.col("val.num").alias("num"), F.unix_micros("val.ts").alias("at"))


@query("series_casts", f"WITH {SERIES_SQL}, {_VALUES} SELECT event_id, CASE WHEN k = 0 THEN trunc(val)::BIGINT WHEN k = 2 THEN (val > 50)::BIGINT END AS int, CASE WHEN k = 0 THEN val WHEN k = 2 THEN (val > 50)::INT::DOUBLE END AS float, CASE WHEN k = 0 THEN val <> 0 WHEN k = 2 THEN val > 50 END AS bool, CASE WHEN k IN (3, 4) THEN strftime(ts, '%Y-%m-%d') END AS date FROM v")
def series_casts(spark, d):
    return ts.typed_casts(_values(spark, d)).select("event_id", "int", "float", "bool", F.col("date").cast("string").alias("date"))


@query("series_target_column", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'VARCHAR' WHEN user_id % 3 = 1 THEN 'BOOLEAN' ELSE 'DOUBLE' END AS target FROM events")
def series_target_column(spark, d):
    s = model.series(spark, d)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("int") % 3
    points = s.select("id").distinct().select("id", F.when(k == 0, "Str").when(k == 1, "Bool").alias("kind"))
    return ts.with_target_column(s, points).select("event_id", "target")


@query("series_sources", f"WITH {SERIES_SQL} SELECT id, event_id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, row_number() OVER (ORDER BY id, event_id % 2, ts DESC) - 1 AS place FROM series")
def series_sources(spark, d):
    """All points with their place in the order for display."""
    s = model.series(spark, d)
    rows = ts.newest_first(ts.from_sources(even=s.where("event_id % 2 = 0"), odd=s.where("event_id % 2 = 1"))).select("id", "event_id", "source")
    return ts.placed(rows).select("id", "event_id", "source", "place")


@query(
    "point_levels",
    """WITH w AS (SELECT user_id AS id, event_id % 17 + 1 AS level, arg_max(event_id, ts) AS last, max(ts) AS last_at FROM events GROUP BY 1, 2),
h AS (SELECT id, level, value AS val FROM w JOIN events e ON e.event_id = last WHERE last % 9 <> 0 AND (last % 4 <> 0 OR last_at + INTERVAL 5 DAY >= TIMESTAMP '2024-01-25'))
SELECT id, level, val, level = min(level) OVER (PARTITION BY id) AS in_force FROM h""",
)
def point_levels(spark, d):
    e = model.table(spark, d, "events")
    writes = e.select(F.col("user_id").alias("id"), (F.col("event_id") % 17 + 1).alias("level"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("val"), F.col("event_type").alias("who"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 4 == 0, 5 * 86400).alias("duration_s"))
    return ts.last_per_level(writes, "2024-01-25 00:00:00").select("id", "level", "val", "in_force")


# scalar functions


@query("unit_conversion", "SELECT event_id, CASE WHEN event_type = 'view' THEN (value - 32) * 5 / 9 WHEN event_type = 'click' THEN value * 1000 WHEN event_type = 'purchase' THEN NULL ELSE value END AS converted FROM events")
def unit_conversion(spark, d):
    e = model.table(spark, d, "events").select("event_id", "value", "event_type")
    pair = lambda a, b: F.when(F.col("event_type") == "view", a[0]).when(F.col("event_type") == "click", a[1]).when(F.col("event_type") == "purchase", a[2]).otherwise(b)
    e = e.withColumn("unit", pair(("°F", "kW", "kW"), "m")).withColumn("target", pair(("°C", "W", "°C"), "m"))
    return units.converted(e, "value", "unit", "target").select("event_id", F.round("converted", 6).alias("converted"))


SQL["unit_conversion"] = SQL["unit_conversion"].replace("SELECT event_id, CASE", "SELECT event_id, round(CASE", 1).replace("END AS converted", "END, 6) AS converted")


@query("time_zones", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'America/New_York' ELSE 'Europe/Paris' END AS tz_full FROM events")
def time_zones(spark, d):
    e = model.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "New_York").otherwise("Paris").alias("tz"))
    return tz.with_full_zone(e, "tz").select("event_id", "tz_full")


@query("date_ranges", "SELECT event_id, epoch_us(CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) WHEN event_id % 3 = 1 THEN date_trunc('day', ts) ELSE TIMESTAMP '2024-01-01 06:00:00' END) AS start, epoch_us(CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) + INTERVAL 1 DAY WHEN event_id % 3 = 1 THEN date_trunc('day', ts) + INTERVAL 3 DAY - INTERVAL 1 MICROSECOND ELSE date_trunc('day', ts) + INTERVAL 1 DAY END) AS end FROM events")
def date_ranges(spark, d):
    e = model.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.date_format("ts", "yyyy-MM-dd")
    text = F.when(F.col("event_id") % 3 == 0, day).when(F.col("event_id") % 3 == 1, F.concat(day, F.lit(","), F.date_format(F.col("ts") + F.expr("INTERVAL 2 DAYS"), "yyyy-MM-dd"))).otherwise(F.lit("2024-01-01T06:00:00,today"))
    start, end = ranges.range_columns(text, F.col("ts"))
    return e.select("event_id", F.unix_micros(start).alias("start"), F.unix_micros(end).alias("end"))


@query("period_days", "SELECT o_orderkey, len(generate_series(o_orderdate, max(l_shipdate), INTERVAL 1 DAY)) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate HAVING max(l_shipdate) >= o_orderdate")
def period_days(spark, d):
    li = model.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    both = model.table(spark, d, "orders").join(li, "o_orderkey").where("last >= o_orderdate")
    return both.select("o_orderkey", F.size(ranges.days_between(F.col("o_orderdate"), F.col("last"))).cast("bigint").alias("days"))


@query("tagged_text", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'ref' WHEN 2 THEN 'date' ELSE 'marker' END AS kind, CASE event_id % 4 WHEN 1 THEN 'point-' || user_id WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN 'M' END AS text, CASE WHEN event_id % 4 = 0 THEN round(value, 6) END AS num, CASE event_id % 4 WHEN 0 THEN 'n:' || printf('%.6f', value) || ' kW' WHEN 1 THEN 'r:point-' || user_id || ' P' WHEN 2 THEN 'd:' || strftime(ts, '%Y-%m-%d') ELSE 'm:' END AS again FROM events")
def tagged_text(spark, d):
    e = model.table(spark, d, "events")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.format_string("n:%.6f kW", "value")).when(k == 1, F.concat(F.lit("r:point-"), F.col("user_id").cast("string"), F.lit(" P"))).when(k == 2, F.concat(F.lit("d:"), F.date_format("ts", "yyyy-MM-dd"))).otherwise("m:")
    v = e.select("event_id", kinds.decode_tagged(text).alias("v"))
    return v.select("event_id", F.col("v.kind").alias("kind"), F.when(F.col("v.kind") != "number", F.col("v.str")).alias("text"), F.col("v.num").alias("num"), kinds.encode_tagged(F.col("v")).alias("again"))


@query("refs_and_bytes", "SELECT user_id, event_id, 'point-' || user_id AS name, upper(hex(event_type)) AS bytes FROM events")
def refs_and_bytes(spark, d):
    e = model.table(spark, d, "events")
    name = kinds.parse_ref(F.concat(F.lit("@point-"), F.col("user_id").cast("string"), F.lit(' "P"')))["str"]
    return e.select("user_id", "event_id", name.alias("name"), kinds.hex_of_xstr(F.lit("b64"), F.base64(F.col("event_type").cast("binary"))).alias("bytes"))


# graph

_EDGES = 'edges AS (SELECT id AS from_id, "regionRef" AS to_id, \'regionRef\' AS relation FROM entities WHERE "regionRef" IS NOT NULL UNION ALL SELECT id, "nationRef", \'nationRef\' FROM entities WHERE "nationRef" IS NOT NULL)'


@query("graph_edges", f"WITH {ENTITIES_SQL}, {_EDGES} SELECT * FROM edges")
def graph_edges(spark, d):
    return graph.edges(model.tag_entities(spark, d))


@query("graph_dangling", f"WITH {ENTITIES_SQL}, {_EDGES} SELECT * FROM edges WHERE to_id NOT IN (SELECT id FROM entities WHERE id <> 'nation-3')")
def graph_dangling(spark, d):
    e = model.entities(spark, d)
    return graph.dangling(graph.wide_edges(e, ["regionRef", "nationRef"]), e.where("id <> 'nation-3'"))


@query("graph_relations", f"WITH {ENTITIES_SQL}, {_EDGES} SELECT DISTINCT relation FROM edges")
def graph_relations(spark, d):
    return graph.relations(graph.edges(model.tag_entities(spark, d)))


@query("graph_degrees", f"WITH {ENTITIES_SQL}, {_EDGES} SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id")
def graph_degrees(spark, d):
    return graph.degrees(graph.wide_edges(model.entities(spark, d), ["regionRef", "nationRef"]))


@query(
    "graph_site_edges",
    """WITH e AS (SELECT l_orderkey AS from_id, 'supplier-' || l_suppkey AS to_id, 'siteRef' AS relation FROM lineitem UNION ALL SELECT l_orderkey, 'part-' || l_partkey, 'partRef' FROM lineitem WHERE l_partkey % 4 = 0)
SELECT * FROM e WHERE relation <> 'siteRef' UNION ALL SELECT s.* FROM (SELECT * FROM e WHERE relation = 'siteRef') s ANTI JOIN (SELECT DISTINCT from_id FROM e WHERE relation <> 'siteRef') o ON s.from_id = o.from_id""",
)
def graph_site_edges(spark, d):
    li = model.table(spark, d, "lineitem")
    wide = li.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("supplier-"), "l_suppkey").alias("siteRef"), F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("part-"), "l_partkey")).alias("partRef"))
    return graph.without_site_edges(graph.wide_edges(wide, ["siteRef", "partRef"]))


# files and streams


_PART = 50_000  # entities, or points, of a part of a file


def _file_round_trip(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, tags = shared_path(spark, f"grids-{name}"), ["id", "dis", "customer", "supplier", "nationRef", "acctbal", "mktsegment"]
        e = formats.spread(model.entities(spark, d).where("customer OR supplier"), _PART, "id")
        rows = grid.to_tags(filters.of_kind(e.withColumn("key", F.col("id")).withColumn("id", F.col("id")), id="ref"), "key", values={"id": kinds.ref(F.col("id"), F.col("dis"))})
        formats.write_grids(rows, path, name, tags)
        back = formats.READERS[name](spark, path, all_files=True)
        return back.select("id", F.col("tags")["id"]["dis"].alias("dis"), F.col("tags")["nationRef"]["str"].alias("nation"), F.col("tags")["acctbal"]["num"].alias("acctbal"), F.col("tags")["mktsegment"]["str"].alias("segment"), F.size("tags").alias("tags"))

    QUERIES[f"files_{name}"] = run
    SQL[f"files_{name}"] = f"WITH {ENTITIES_SQL} SELECT id, dis, \"nationRef\" AS nation, acctbal, mktsegment AS segment, 4 + (\"nationRef\" IS NOT NULL)::INT + (mktsegment IS NOT NULL)::INT AS tags FROM entities WHERE customer OR supplier"


for _name in ("zinc", "trio", "json", "hayson", "csv"):
    _file_round_trip(_name)


@query("files_nested", "SELECT 'point-' || user_id AS id, epoch_us(ts) AS ts, value AS val, '[\"n:' || (user_id % 5) || '.000000\",\"s:' || event_type || '\"]' AS pair FROM events")
def files_nested(spark, d):
    """Points of users as nested grids, written as Zinc and read back."""
    path = f"{shared_path(spark, 'nested')}/town.zinc"
    e = model.table(spark, d, "events")
    row = F.concat(F.lit('{"ts":"t:'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z UTC","val":"n:'), F.format_string("%.6f", "value"), F.lit('","pair":["n:'), (F.col("user_id") % 5).cast("string"), F.lit('.000000","s:'), "event_type", F.lit('"]}'))
    rows = formats.spread(e, _PART, "user_id").groupBy("user_id").agg(F.array_join(F.collect_list(row), ",").alias("rows"))
    text = F.concat(F.lit('{"meta":{"ver":"3.0"},"cols":[{"name":"ts"},{"name":"val"},{"name":"pair"}],"rows":['), "rows", F.lit("]}"))
    name = F.concat(F.lit("point-"), F.col("user_id").cast("string"))
    tags = F.create_map(F.lit("id"), kinds.ref(name), F.lit("history"), kinds.value("grid", text))
    formats.write_grids(rows.select(name.alias("id"), tags.cast(kinds.TAGS).alias("tags")), path, "zinc", ["id", "history"], with_nested=True)
    back = formats.read_grids(spark, path.rsplit("/", 1)[0])
    held = back.select("id", F.explode(F.from_json(F.col("tags")["history"]["str"], "rows ARRAY<MAP<STRING, STRING>>").rows).alias("row"))
    return held.select("id", F.unix_micros(kinds.decode_tagged(F.col("row")["ts"])["ts"]).alias("ts"), kinds.decode_tagged(F.col("row")["val"])["num"].alias("val"), F.col("row")["pair"].alias("pair"))


SQL["files_nested"] = SQL["files_nested"].replace("value AS val", "round(value, 6) AS val")


@query(
    "snapshot_import",
    f"""{_BOTH}{_CHANGES}, h AS (SELECT DISTINCT id FROM o),
v AS (SELECT id, acctbal, TIMESTAMP '2024-01-01' AS s, CASE WHEN id IN (SELECT id FROM h) THEN TIMESTAMP '2024-02-01' - INTERVAL 1 MICROSECOND ELSE TIMESTAMP '9999-12-31 23:59:59' END AS e FROM entities
UNION ALL SELECT id, acctbal, TIMESTAMP '2024-02-01', TIMESTAMP '9999-12-31 23:59:59' FROM second WHERE id IN (SELECT id FROM h))
SELECT 'town' AS name, id, epoch_us(s) AS start_datetime, epoch_us(e) AS end_datetime, acctbal, 0 AS points FROM v
UNION ALL SELECT 'his', 'region-' || (user_id % 5), epoch_us(min(ts)), epoch_us(max(ts)), round(max(value), 6), count(*) FROM events GROUP BY user_id % 5""",
)
def snapshot_import(spark, d):
    """A folder of dated snapshots and series files, imported as entity versions and points."""
    path, (a, b) = shared_path(spark, "import"), _two(spark, d)
    tags = ["id", "dis", "acctbal", "nationRef", "regionRef", "mktsegment", *model.MARKERS, "hisURI"]
    uri = F.when(F.col("id").startswith("region-"), F.map_from_arrays(F.array(F.lit("hisURI")), F.array(kinds.value("uri", F.concat(F.lit("his-"), F.regexp_extract("id", r"(\d+)$", 1), F.lit(".csv"))))))
    with_id = lambda df: df.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("id"), kinds.ref(F.col("id"))), F.coalesce(uri, F.create_map().cast(kinds.TAGS))))
    a, b = formats.spread(a, _PART, "id"), formats.spread(b, _PART, "id")
    formats.write_grids(with_id(a), f"{path}/town-2024-01-01.zinc", "zinc", tags)
    formats.write_grids(with_id(b), f"{path}/town-2024-02-01.hayson.json", "hayson", tags)
    e = model.table(spark, d, "events").withColumn("u", F.col("user_id") % 5)
    for u in range(5):  # five series files
        rows = e.where(F.col("u") == u).select(F.lit("x").alias("id"), F.create_map(F.lit("ts"), kinds.datetime(F.col("ts").cast("timestamp")), F.lit("val"), kinds.number(F.col("value"))).cast(kinds.TAGS).alias("tags"))
        formats.write_grids(rows, f"{path}/his/his-{u}.csv", "csv", ["ts", "val"])
    files = ver.list_files(spark, path)
    read = formats.read_grids(spark, path)
    read.write.parquet(f"{path}-read")  # files are parsed once, for entities and series
    grids = spark.read.schema(read.schema).parquet(f"{path}-read")
    versions = ver.import_snapshots(grids.where("id IS NOT NULL"), files.where(~F.col("path").contains("/his/")))
    latest = ver.as_of(versions, "2024-03-01 00:00:00").where(F.col("tags")["hisURI"].isNotNull())
    points = ts.import_all(latest.select("id", "tags"), grids.where("id IS NULL"))
    out = versions.select("name", "id", us("start_datetime"), us("end_datetime"), F.col("tags")["acctbal"]["num"].alias("acctbal"), F.lit(0).cast("bigint").alias("points"))
    return out.unionByName(points.groupBy(F.lit("his").alias("name"), "id").agg(F.unix_micros(F.min("ts")).alias("start_datetime"), F.unix_micros(F.max("ts")).alias("end_datetime"), F.round(F.max("val.num"), 6).alias("acctbal"), F.count("*").alias("points")))


@query("lake_read", "SELECT DISTINCT epoch_us(date_trunc('second', ts)) AS ts, value AS val FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND date_trunc('second', ts) < TIMESTAMP '2024-01-12'")
def lake_read(spark, d):
    import datetime as dt

    path = shared_path(spark, "lake")
    e = model.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "value", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))
    e.repartition("year", "month", "day").write.partitionBy("year", "month", "day").parquet(path)
    spec = {"date_part_keys": {"year_col": "year", "month_col": "month", "day_col": "day"}, "hs_value_column": {"value": "float"}, "hs_date_column": {"time": "%Y-%m-%d %H:%M:%S"}}
    return ts.read_lake(spark, path, spec, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12)).select(us("ts"), "val")


def _stream(spark, d):
    """events as a stream of points."""
    files = f"{d}/events.parquet"
    schema = spark.read.parquet(files).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files.replace("events.parquet", "[e]vents.parquet"))
    return e.select(F.concat(F.lit("point-"), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("val"))


def _ran(df: DataFrame, name: str, mode: str, feeds: tuple = (lambda: None,)) -> DataFrame:
    """Runs a stream over what is there now, into a table that keeps every row given out; with feeds, anew after each of them."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    store = lambda batch, n: batch.write.mode("append").parquet(f"{path}/rows")
    for k, feed in enumerate(feeds, 1):
        feed()
        # what ends between two feeds is found with the next one's rows
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(k == len(feeds)).lower())
        q = df.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def _fed(path: str, rows: DataFrame, each: list) -> tuple:
    """A new folder for a stream, and what adds to it the rows of each condition in turn, as many files as there are tasks."""
    rows.sparkSession.createDataFrame([], rows.schema).write.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return tuple(lambda k=k: rows.where(k).select(*columns).write.mode("append").parquet(path) for k in each)


@query("stream_his_write", "SELECT 'point-' || user_id AS id, epoch_us(ts) AS ts, arg_max(value, value) AS val FROM events GROUP BY user_id, ts")
def stream_his_write(spark, d):
    return _ran(live.his_write(_stream(spark, d), "3650 days"), "his", "append").select("id", us("ts"), "val")


@query(
    "stream_watch",
    """WITH e AS (SELECT *, event_id % 4 AS batch FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
l AS (SELECT batch, user_id, max(ts) AS ts, arg_max(round(value / 25), ts) AS val FROM e GROUP BY batch, user_id),
n AS (SELECT *, max(ts) OVER w AS best, arg_max(val, ts) OVER w AS now FROM l WINDOW w AS (PARTITION BY user_id ORDER BY batch)),
g AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY batch) AS before FROM n)
SELECT 'w' || (user_id % 2) AS watch, 'point-' || user_id AS id, epoch_us(best) AS ts, now AS val FROM g WHERE before IS NULL OR before <> now""",
)
def stream_watch(spark, d):
    """Only what changed since the batch before, in four batches."""
    path = shared_path(spark, "watched")
    e = model.table(spark, d, "events")
    rows = e.select(F.concat(F.lit("point-"), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") / 25).alias("val"), (F.col("event_id") % 4).alias("batch"))
    feeds = _fed(path, rows, [F.col("batch") == k for k in range(4)])
    c = model.table(spark, d, "customer")
    subs = c.select(F.concat(F.lit("w"), (F.col("c_custkey") % 2).cast("string")).alias("watch"), F.concat(F.lit("point-"), F.col("c_custkey").cast("string")).alias("id"), F.lit(1e9).alias("lease_s"))
    points = spark.readStream.schema("id string, ts timestamp, val double").parquet(path)
    return _ran(live.watch(points, subs, delay="3650 days"), "watch", "update", feeds).select("watch", "id", us("ts"), "val")


# what is changed in place, and what else has no query above


@query("approximate_nested", "SELECT event_id::VARCHAR AS id, 'props' AS tag FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id::VARCHAR, 'pair' FROM events WHERE event_id % 7 = 0")
def approximate_nested(spark, d):
    """Dicts and lists whose numbers are a little off are alike; those a hundredth off, or with another text, are not."""
    e = _event_tags(spark, d)
    k = F.get_json_object(F.col("tags")["props"]["str"], "$.k")
    number = F.substring(k, 3, 30).cast("double") + F.when(F.col("event_id") % 5 == 0, 0.01).otherwise(4e-7)
    props = F.replace(F.col("tags")["props"]["str"], F.concat(F.lit('"'), k, F.lit('"')), F.concat(F.lit('"n:'), F.format_string("%.7f", number), F.lit('"')))
    pair = F.when(F.col("event_id") % 7 == 0, F.replace(F.col("tags")["pair"]["str"], F.lit('"s:'), F.lit('"s:un'))).otherwise(F.col("tags")["pair"]["str"])
    other = e.select("id", F.create_map(F.lit("props"), kinds.value("dict", props), F.lit("pair"), kinds.value("list", pair), F.lit("type"), F.col("tags")["type"]).cast(kinds.TAGS).alias("tags"))
    return diff.mismatches(e.select("id", "tags"), other)


@query(
    "version_patch_chain",
    f"""WITH {STATES_SQL}, n AS (SELECT 'customer-' || c_custkey AS id, k, TIMESTAMP '{_NOW}' + to_days(k::INTEGER) AS tm, c_custkey % 7 = k AS gone FROM customer, (VALUES (1), (2), (3)) v(k) WHERE c_custkey % (k + 1) = 0),
o AS (SELECT * FROM versions WHERE end_datetime = TIMESTAMP '9999-12-31 23:59:59'), f AS (SELECT id, min(tm) AS tm FROM n GROUP BY id),
e AS (SELECT *, lead(tm) OVER w AS nx, coalesce(max(gone::INT) OVER (PARTITION BY id ORDER BY tm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM n WINDOW w AS (PARTITION BY id ORDER BY tm)),
r AS (SELECT id, start_datetime AS s, end_datetime AS t, status, priority FROM versions WHERE end_datetime < TIMESTAMP '9999-12-31 23:59:59'
UNION ALL SELECT o.id, start_datetime, coalesce(f.tm - INTERVAL 1 MICROSECOND, end_datetime), status, priority FROM o LEFT JOIN f ON o.id = f.id
UNION ALL SELECT e.id, e.tm, coalesce(nx - INTERVAL 1 MICROSECOND, TIMESTAMP '9999-12-31 23:59:59'), 'P' || k, CASE WHEN ended = 0 THEN o.priority END FROM e LEFT JOIN o ON e.id = o.id WHERE NOT gone)
SELECT id, epoch_us(s) AS start_datetime, epoch_us(t) AS end_datetime, status, priority FROM r""",
)
def version_patch_chain(spark, d):
    """Three patches of a stored table of versions, folded in one merge, which is then asked for again."""
    path = shared_path(spark, "versions")
    stored.create_versions(_versions(spark, d), path)
    c, patches = model.table(spark, d, "customer"), None
    for k in (1, 2, 3):
        at = F.lit(_NOW).cast("timestamp") + F.expr(f"INTERVAL {k} DAYS")
        one = c.where(F.col("c_custkey") % (k + 1) == 0).select(F.lit("").alias("customer_id"), F.concat(F.lit("customer-"), "c_custkey").alias("id"), at.alias("at"), F.lit(f"P{k}").alias("status"), (F.col("c_custkey") % 7 == k).alias("gone"))
        patches = one if patches is None else patches.unionByName(one)
    for _ in range(2):
        stored.merge_patches(patches, path, 1, F.col("gone"))
    return stored.read_versions(spark, path).select("id", us("start_datetime"), us("end_datetime"), "status", "priority")


@query(
    "series_writes",
    """WITH p AS (SELECT 'point-' || user_id AS id, ts, max(value) AS val, min(event_id % 4) AS part FROM events GROUP BY user_id, ts),
a AS (SELECT id, ts, val FROM p WHERE part IN (0, 1)),
u AS (SELECT id, ts, val + 1000 AS val FROM p WHERE part = 1 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'),
b AS (SELECT * FROM u UNION ALL SELECT * FROM a WHERE (id, ts) NOT IN (SELECT (id, ts) FROM u)),
n AS (SELECT id, ts, val FROM p WHERE part = 2 AND ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-15'), w AS (SELECT id, min(ts) AS lo, max(ts) AS hi FROM n GROUP BY id),
c AS (SELECT b.* FROM b LEFT JOIN w ON b.id = w.id WHERE lo IS NULL OR ts < lo OR ts > hi UNION ALL SELECT * FROM n),
f AS (SELECT id, min(ts) AS first FROM c GROUP BY id),
s AS (SELECT id, ts - to_days(3) AS ts, val FROM p WHERE part = 3)
SELECT id, epoch_us(ts) AS ts, val FROM c UNION ALL SELECT s.id, epoch_us(s.ts), s.val FROM s LEFT JOIN f ON s.id = f.id WHERE first IS NULL OR s.ts < first""",
)
def series_writes(spark, d):
    """A stored series: points written twice, a period replaced, older points put before it, and a late repeat of the first batch."""
    path = shared_path(spark, "series")
    p = model.series(spark, d).groupBy("customer_id", "id", "ts").agg(F.max("val").alias("val"), F.min(F.col("event_id") % 4).alias("part"))
    part = lambda k: p.where(F.col("part") == k).drop("part")
    between = lambda df, a, b: df.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
    stored.create_series(part(0).unionByName(part(1)), path)
    newer = between(part(1), "2024-01-10", "2024-01-20").withColumn("val", F.col("val") + 1000)
    stored.write_points(newer, path, 1)
    stored.replace_period(between(part(2), "2024-01-12", "2024-01-15"), path, 2)
    stored.write_points(newer, path, 1)
    stored.prepend_older(part(3).withColumn("ts", F.col("ts") - F.expr("INTERVAL 3 DAYS")), path, 3)
    return stored.read_series(spark, path).select("id", us("ts"), "val")


@query("point_in_time_buckets", _AT)
def point_in_time_buckets(spark, d):
    """The same where points of many events have their time cut into buckets."""
    return ver.at_each_time_in_buckets(_ships(spark, d), _versions(spark, d), hot=20).select("l_orderkey", "l_linenumber", "status")


@query(
    "lake_read_all",
    """WITH e AS (SELECT user_id % 5 AS site, date_trunc('second', ts) AS ts, round(value, 6) AS val, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND date_trunc('second', ts) < TIMESTAMP '2024-01-12')
SELECT DISTINCT 'meter-' || site AS id, epoch_us(ts) AS ts, val, NULL AS kind FROM e WHERE site <> 3 UNION ALL SELECT DISTINCT 'station-' || site, epoch_us(ts), val, event_type FROM e WHERE site <> 3""",
)
def lake_read_all(spark, d):
    """Points in two tables of a lake, one with a single value column and one with two, each read once for all its points."""
    import datetime as dt

    path = shared_path(spark, "lakes")
    e = model.table(spark, d, "events").select((F.col("user_id") % 5).alias("site"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "value", "event_type", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))
    parts = ["site", "year", "month", "day"]
    for name, rows in (("meters", e.drop("event_type")), ("stations", e)):
        rows.repartition(*parts).write.partitionBy(*parts).parquet(f"{path}/{name}")
    days = {"year_col": "year", "month_col": "month", "day_col": "day"}
    rows = [(f"{kind}-{k}", f"{path}/{kind}s", {"site": str(k)}, days, {"value": "float"} if kind == "meter" else {"value": "float", "event_type": "str"}, {"time": "%Y-%m-%d %H:%M:%S"}) for kind in ("meter", "station") for k in range(5) if k != 3]
    out = ts.read_lake_all(spark.createDataFrame(rows, ts.LAKE), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12))
    inside = lambda k: kinds.decode_tagged(F.get_json_object("val.str", f"$.{k}"))
    return out.select("id", us("ts"), F.coalesce("val.num", inside("value")["num"]).alias("val"), inside("event_type")["str"].alias("kind"))


@query(
    "zone_of_offset",
    """WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INTEGER) AS ts, make_date(year(o_orderdate), 4, 1) AS a, make_date(year(o_orderdate), 10, 31) AS b FROM orders),
r AS (SELECT *, CASE WHEN ts >= (a + ((7 - dayofweek(a)) % 7)::INTEGER)::TIMESTAMP + INTERVAL 7 HOURS AND ts < (b - dayofweek(b)::INTEGER)::TIMESTAMP + INTERVAL 6 HOURS THEN -14400 ELSE -18000 END AS off FROM o)
SELECT o_orderkey, off AS given, off AS found FROM r""",
)
def zone_of_offset(spark, d):
    """New York's offset, in and out of summer time, and that of the zone which is found for it."""
    o = model.table(spark, d, "orders").select("o_orderkey", F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600).alias("ts"))
    offset = lambda zone: (F.unix_seconds(tz.local_time(F.col("ts"), zone)) - F.unix_seconds("ts")).cast("int")
    named = tz.with_full_zone(tz.with_zone_of_offset(o.withColumn("given", offset(F.lit("America/New_York"))), "ts", "given"), "tz_short")
    return named.select("o_orderkey", "given", offset(F.col("tz_full")).alias("found"))


def _dealt(path: str, rows: DataFrame, time: str, like: DataFrame) -> tuple:
    """Rows in four batches, by the quarters of the days of `like`, as feeds of a stream that reads one after the other."""
    spark = rows.sparkSession
    days = like.select(F.to_date(time if time in like.columns else "ts").alias("day")).distinct()  # one row for each day
    days = days.withColumn("batch", F.ntile(4).over(Window.orderBy("day")))
    dealt = rows.withColumn("day", F.to_date(time)).join(F.broadcast(days), "day").drop("day")
    dealt.write.partitionBy("batch").parquet(f"{path}-all")  # made once, for all batches
    return _fed(path, spark.read.schema(dealt.schema).parquet(f"{path}-all"), [F.col("batch") == k for k in range(1, 5)])


@query(
    "stream_point_levels",
    """WITH w AS (SELECT user_id AS id, 1 + event_id % 3 AS level, CASE WHEN event_id % 11 <> 0 THEN value END AS val, ts AS tm, CASE WHEN event_id % 2 = 0 THEN ts + to_seconds(3600 * (1 + event_id % 40)) + INTERVAL 1 MICROSECOND END AS until
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
v AS (SELECT *, lead(tm) OVER (PARTITION BY id, level ORDER BY tm) AS nx FROM w),
h AS (SELECT id, level, val, tm AS s, least(coalesce(nx, TIMESTAMP '9999-01-01'), coalesce(until, TIMESTAMP '9999-01-01')) AS e FROM v WHERE val IS NOT NULL),
t AS (SELECT id, tm AS t FROM w UNION SELECT id, until FROM w WHERE until < (SELECT max(tm) FROM w) AND val IS NOT NULL),
f AS (SELECT t.id, t.t, arg_min(h.level, h.level) AS level, arg_min(h.val, h.level) AS val FROM t LEFT JOIN h ON t.id = h.id AND h.s <= t.t AND t.t < h.e GROUP BY t.id, t.t),
g AS (SELECT *, row_number() OVER p AS n, lag(level) OVER p AS pl, lag(val) OVER p AS pv FROM f WINDOW p AS (PARTITION BY id ORDER BY t))
SELECT 'point-' || id AS id, epoch_us(t) AS "at", level::INTEGER AS level, val FROM g WHERE (n = 1 AND level IS NOT NULL) OR (n > 1 AND (level IS DISTINCT FROM pl OR val IS DISTINCT FROM pv))""",
)
def stream_point_levels(spark, d):
    """Every change of the value in force, from writes that come in four batches and from durations that end."""
    path = shared_path(spark, "writes")
    e = model.table(spark, d, "events")
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))).where("_n = 1")
    writes = e.select(F.concat(F.lit("point-"), F.col("user_id").cast("string")).alias("id"), (F.col("event_id") % 3 + 1).cast("int").alias("level"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("val"), F.lit("u").alias("who"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 2 == 0, 3600 * (1 + F.col("event_id") % 40) + F.lit(1e-6)).alias("duration_s"))
    feeds = _dealt(path, writes, "at", writes)
    stream = spark.readStream.schema(writes.schema).parquet(path)
    return _ran(state.priority_arrays(stream), "levels", "append", feeds).select("id", us("at"), "level", "val")


@query(
    "stream_watch_leases",
    """WITH p AS (SELECT user_id AS id, ts, max(round(value / 25)) AS val FROM events GROUP BY user_id, ts),
s AS (SELECT DISTINCT user_id AS id, 'w' || (user_id % 3) AS watch, TIMESTAMP '2024-01-05' + to_hours((user_id % 5)::INTEGER) AS s, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-12' END AS r, CASE WHEN user_id % 7 = 0 THEN TIMESTAMP '2024-01-18' END AS u FROM events),
a AS (SELECT *, least(coalesce(u, TIMESTAMP '9999-01-01'), coalesce(r, s) + to_days(10)) AS e FROM s),
c AS (SELECT *, lag(val) OVER (PARTITION BY id ORDER BY ts) AS before FROM p)
SELECT watch, 'point-' || a.id AS id, epoch_us(max(ts)) AS ts, arg_max(val, ts) AS val, 'sub' AS reason FROM a JOIN p ON a.id = p.id AND ts <= s GROUP BY watch, a.id
UNION ALL SELECT watch, 'point-' || a.id, epoch_us(max(ts)), arg_max(val, ts), 'refresh' FROM a JOIN p ON a.id = p.id AND ts <= r GROUP BY watch, a.id
UNION ALL SELECT watch, 'point-' || a.id, epoch_us(ts), val, 'change' FROM a JOIN c ON a.id = c.id AND ts > s AND ts <= e AND before IS DISTINCT FROM val""",
)
def stream_watch_leases(spark, d):
    """Watches of all points that subscribe, are refreshed, run out after their lease or are ended, in four batches."""
    path, e = shared_path(spark, "watches"), model.table(spark, d, "events")
    name = F.concat(F.lit("point-"), F.col("user_id").cast("string"))
    points = e.select(name.alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") / 25).alias("val")).groupBy("id", "ts").agg(F.max("val").alias("val"))
    users = e.select("user_id").distinct()
    at = lambda day: F.lit(f"2024-01-{day}").cast("timestamp")
    event = lambda rows, kind, when: rows.select(name.alias("id"), when.alias("at"), F.lit(kind).alias("kind"), F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("watch"), F.lit(864_000.0).alias("lease_s"))
    asked = event(users, "sub", F.timestamp_seconds(F.unix_seconds(at("05")) + F.col("user_id") % 5 * 3600))
    asked = asked.unionByName(event(users.where("user_id % 2 = 0"), "refresh", at("12"))).unionByName(event(users.where("user_id % 7 = 0"), "unsub", at("18")))
    given, told = _dealt(f"{path}/points", points, "ts", points), _dealt(f"{path}/asked", asked, "at", points)
    feeds = tuple(lambda p=p, a=a: (p(), a()) for p, a in zip(given, told, strict=True))
    read = lambda part, df: spark.readStream.schema(df.schema).parquet(f"{path}/{part}")
    return _ran(state.watches(read("points", points), read("asked", asked)), "given", "append", feeds).select("watch", "id", us("ts"), "val", "reason")


# readers, kinds and helpers


@query("snapshot_newest", "SELECT 'town-' || (c_custkey % 5) AS name, max(TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INTEGER)) AS version FROM customer WHERE TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INTEGER) <= TIMESTAMP '2024-02-10' GROUP BY 1")
def snapshot_newest(spark, d):
    """Of many dated files of each name the newest up to a date."""
    c = model.table(spark, d, "customer")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 60).cast("int")), "yyyy-MM-dd")
    files = c.select(F.concat(F.lit("s3://b/town-"), (F.col("c_custkey") % 5).cast("string"), F.lit("-"), day, F.lit(".zinc.gz")).alias("path"), F.lit("2000-01-01").cast("timestamp").alias("modified"))
    return ver.newest_snapshot(files, "2024-02-10 00:00:00").select("name", "version")


@query("filter_compiled", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 100 AND c_mktsegment <> 'BUILDING' OR c_name = 'Customer#000000007'")
def filter_compiled(spark, d):
    """A filter as one boolean column, within other conditions."""
    c = model.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("dis"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return c.where(filters.compile_filter('acctbal > 100 and segment != "BUILDING"', c) | filters.compile_filter('dis == "Customer#000000007"', c)).select("id")


@query("patch_metadata", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'b' END AS changed, CASE WHEN c_custkey % 5 = 0 THEN 'yes' ELSE 'no' END AS dropped FROM customer")
def patch_metadata(spark, d):
    """What changed between two metadata maps of each row, as a patch: new values, and REMOVE for what is gone."""
    c = model.table(spark, d, "customer")
    text = lambda x: kinds.string(F.lit(x))
    left = c.select(F.col("c_custkey").cast("string").alias("id"), F.create_map(F.lit("dis"), text("a"), F.lit("old"), text("x")).cast(kinds.TAGS).alias("tags"))
    right = c.select(F.col("c_custkey").cast("string").alias("id"), F.map_filter(F.create_map(F.lit("dis"), F.when(F.col("c_custkey") % 3 == 0, text("b")).otherwise(text("a")), F.lit("old"), F.when(F.col("c_custkey") % 5 != 0, text("x"))), lambda k, v: v.isNotNull()).cast(kinds.TAGS).alias("tags"))
    patch = diff.patch_of(left, right)
    out = left.select("id").join(patch, "id", "left")
    return out.select(F.col("id").cast("bigint").alias("id"), F.col("tags")["dis"]["str"].alias("changed"), F.when(F.col("tags")["old"]["kind"] == "remove", "yes").otherwise("no").alias("dropped"))


@query("zinc_escapes", "SELECT l_orderkey, l_linenumber, l_returnflag || ' \"' || chr(10) || '\\' || l_linestatus || '$é' AS text FROM lineitem")
def zinc_escapes(spark, d):
    """Texts with quotes, line ends, backslashes and letters beyond ASCII, to Zinc and back."""
    li = model.table(spark, d, "lineitem")
    text = F.concat("l_returnflag", F.lit(' "\n\\'), "l_linestatus", F.lit("$é"))
    return li.select("l_orderkey", "l_linenumber", zinc.decode_zinc(zinc.encode_zinc(kinds.string(text)))["str"].alias("text"))


@query("coordinates", "SELECT c_custkey, round(c_acctbal % 90, 6) AS lat, round(c_custkey % 180, 6)::DOUBLE AS lng FROM customer")
def coordinates(spark, d):
    """Latitude and longitude, to Zinc and back, with six digits."""
    c = model.table(spark, d, "customer")
    v = kinds.value("coord", kinds.coord_text(F.col("c_acctbal") % 90, (F.col("c_custkey") % 180).cast("double")))
    back = kinds.typed(zinc.decode_zinc(zinc.encode_zinc(v)), "coord")
    return c.select("c_custkey", F.round(back["lat"], 6).alias("lat"), F.round(back["lng"], 6).alias("lng"))


@query("files_compressed", "SELECT 'customer-' || c_custkey AS id, c_name AS dis, c_acctbal AS acctbal FROM customer")
def files_compressed(spark, d):
    """A compressed CSV file that begins with a mark of its byte order."""
    path = f"{shared_path(spark, 'packed')}/town.csv"
    c = model.table(spark, d, "customer")
    lines = c.select(F.concat(F.lit("@customer-"), F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit(","), F.col("c_acctbal").cast("string")).alias("value"))
    head = spark.range(1).select(F.lit("\ufeffid,dis,acctbal").alias("value"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions(F.col("value").startswith("@")).write.option("compression", "gzip").text(path)
    back = formats.read_csv(spark, path)
    return back.select("id", F.col("tags")["dis"]["str"].alias("dis"), F.col("tags")["acctbal"]["num"].alias("acctbal"))


@query("relational_json", "SELECT 'customer-' || c_custkey AS id, c_name AS dis, round(c_acctbal, 6) AS acctbal, 'nation-' || c_nationkey AS nation FROM customer")
def relational_json(spark, d):
    """A table whose rows hold entities as JSON, as a database gives them."""
    c = model.table(spark, d, "customer")
    fields = [F.lit('{"id":"r:customer-'), F.col("c_custkey").cast("string"), F.lit('","dis":"s:'), F.col("c_name"), F.lit('","acctbal":"n:'), F.format_string("%.6f", "c_acctbal"), F.lit('","nationRef":"r:nation-'), F.col("c_nationkey").cast("string"), F.lit('"}')]
    t = formats.entities_from_json(c.select(F.concat(*fields).alias("entity")))
    return t.select(F.col("tags")["id"]["str"].alias("id"), F.col("tags")["dis"]["str"].alias("dis"), F.col("tags")["acctbal"]["num"].alias("acctbal"), F.col("tags")["nationRef"]["str"].alias("nation"))


@query("files_by_blocks", f"WITH {ENTITIES_SQL} SELECT id, dis, acctbal FROM entities WHERE customer OR supplier")
def files_by_blocks(spark, d):
    """All entities in one Zinc file, with texts over lines, which is read in many blocks."""
    path = f"{shared_path(spark, 'large')}/town.zinc"
    e = model.entities(spark, d).where("customer OR supplier")
    tags = F.create_map(F.lit("id"), kinds.ref(F.col("id")), F.lit("dis"), kinds.string(F.col("dis")), F.lit("doc"), kinds.value("list", F.concat(F.lit('["s:a, ['), F.col("id"), F.lit('","n:1.000000"]'))), F.lit("acctbal"), kinds.number(F.col("acctbal")))
    formats.write_grids(e.select("id", F.map_filter(tags, lambda k, v: v.isNotNull()).cast(kinds.TAGS).alias("tags")).coalesce(1), path, "zinc", ["id", "dis", "doc", "acctbal"], with_nested=True)
    back = formats.read_zinc(spark, path)
    return back.where(F.col("tags")["doc"]["kind"] == "list").select("id", F.col("tags")["dis"]["str"].alias("dis"), F.col("tags")["acctbal"]["num"].alias("acctbal"))
