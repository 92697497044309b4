"""Diff, patch, merge and equality of entity tables.

Tag-map form has `id, tags`. A patch has one row per changed id: tags hold new values, REMOVE for dropped tags, and a
`remove_` tag where the whole entity goes. Rows are matched by hashes first, so only entities that differ are exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds
from .grid import tag_hash
from .matching import unmatched

GONE = "remove_"


def changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, tag, op, old, new) of every tag that differs; op: add, change, drop, and for whole entities insert, delete."""
    a = left.select("id", F.col("tags").alias("a"))
    b = right.select("id", F.col("tags").alias("b"))
    both = a.join(b, "id", "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | (tag_hash(F.col("a")) != tag_hash(F.col("b"))))
    empty = F.create_map().cast(kinds.TAGS)
    zipped = F.map_entries(F.map_zip_with(F.coalesce("a", empty), F.coalesce("b", empty), lambda k, x, y: F.struct(x.alias("old"), y.alias("new"))))
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete")
    rows = both.select("id", op.alias("whole"), F.explode_outer(zipped).alias("e")).select("id", "whole", F.col("e.key").alias("tag"), F.col("e.value.old").alias("old"), F.col("e.value.new").alias("new"))
    one = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "drop").otherwise("change")
    return rows.where(F.col("whole").isNotNull() | ~kinds.same(F.col("old"), F.col("new"))).select("id", "tag", F.coalesce("whole", one).alias("op"), "old", "new")


def patch_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """The patch that turns left into right; entities that are the same give no row."""
    a, b = left.select("id", F.col("tags").alias("a")), right.select("id", F.col("tags").alias("b"))
    both = a.join(b, "id", "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | (tag_hash(F.col("a")) != tag_hash(F.col("b"))))
    changed = F.map_filter(F.map_zip_with("a", "b", lambda k, x, y: F.when(y.isNull(), kinds.removed()).when(~kinds.same(x, y), y)), lambda k, v: v.isNotNull())
    gone = F.create_map(F.lit(GONE), kinds.removed())
    return both.select("id", F.when(F.col("b").isNull(), gone).when(F.col("a").isNull(), F.col("b")).otherwise(changed).cast(kinds.TAGS).alias("tags"))


def patched(left: DataFrame, patch: DataFrame) -> DataFrame:
    """left with a patch (or simply other rows, whose tags win) applied."""
    a, p = left.select("id", F.col("tags").alias("a")), patch.select("id", F.col("tags").alias("p"))
    both = a.join(p, "id", "full_outer").where(F.coalesce(~F.map_contains_key("p", F.lit(GONE)), F.lit(True)))
    empty = F.create_map().cast(kinds.TAGS)
    return both.select("id", tags_patched(F.coalesce("a", empty), F.coalesce("p", empty)).alias("tags"))


def tags_patched(tags: Column, patch: Column) -> Column:
    """One tag map with the tags of another in their place; those that are REMOVE there go."""
    return F.map_filter(F.map_zip_with(tags, patch, lambda k, x, y: F.coalesce(y, x)), lambda k, v: v["kind"] != "remove")


def row_patch(left: DataFrame, right: DataFrame) -> DataFrame:
    """For rows without id: right's columns and `remove_`; equal rows match one to one, however often they repeat."""
    columns = [c for c in right.columns]
    left = left.select(*columns)
    removed = left.exceptAll(right).withColumn(GONE, F.lit(True))
    return removed.unionByName(right.exceptAll(left).withColumn(GONE, F.lit(False)))


def rows_patched(left: DataFrame, patch: DataFrame) -> DataFrame:
    """Removes one equal row for each row marked `remove_`, and adds the others."""
    columns = [c for c in patch.columns if c != GONE]
    return left.select(*columns).exceptAll(patch.where(F.col(GONE)).select(*columns)).unionByName(patch.where(~F.col(GONE)).select(*columns))


def metadata_patch(left: dict, right: dict, remove: object = None) -> dict:
    """What changed between two small metadata dictionaries; dropped keys have the value `remove`."""
    return {k: v for k, v in right.items() if k not in left or left[k] != v} | {k: remove for k in left if k not in right}


def column_metadata_patch(left: T.StructType, right: T.StructType, remove: object = None) -> dict:
    """The same for each column of two schemas; a dropped column is `remove` as a whole."""
    a, b = ({f.name: f.metadata or {} for f in s.fields} for s in (left, right))
    out = {c: metadata_patch(a.get(c, {}), m, remove) for c, m in b.items() if c not in a or a[c] != m}
    return out | {c: remove for c in a if c not in b}


#: Scalars within the JSON of lists, dicts and grids: a quote inside a text has a backslash, so these begin no text's inside.
_NUMBERS, _COORDS = r'(?<=[\[,:])"n:(-?\d[\d.eE+-]*)', r'(?<=[\[,:])"c:(-?[\d.]+),(-?[\d.]+)'
_INSTANTS = r'(?<=[\[,:])("(?:t:\d{4}-\d\d-\d\dT|h:)\d\d:\d\d:\d\d)\.\d+'


def _nested_alike(a: Column, b: Column, near: Callable[[Column, Column], Column]) -> Column:
    """The same for JSON of nested values, however deep: equal but for numbers and coordinates, which are near, each to each."""
    shape = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _NUMBERS, '"n:'), _COORDS, '"c:'), _INSTANTS, "$1")
    figures = lambda s: F.concat(*[F.regexp_extract_all(s, F.lit(p), k) for p, k in ((_NUMBERS, 1), (_COORDS, 1), (_COORDS, 2))])
    close = F.forall(F.zip_with(figures(a), figures(b), lambda x, y: near(x.cast("double"), y.cast("double"))), lambda ok: F.coalesce(ok, F.lit(False)))
    return (a == b) | ((shape(a) == shape(b)) & close)


def alike(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Approximate equality of two values: numbers and coordinates within a tolerance, instants and times by the second; lists, dicts and grids by all they hold."""
    seconds = lambda v: F.regexp_replace(v["str"], r"\.\d+$", "")
    at = lambda v, k: F.split(v["str"], ",")[k].cast("double")
    near = lambda x, y: F.abs(x - y) <= tolerance * 1.000001
    same_kind = a["kind"] == b["kind"]
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(same_kind & (a["kind"] == "number"), (near(a["num"], b["num"]) | a["num"].eqNullSafe(b["num"])) & a["unit"].eqNullSafe(b["unit"]))
        .when(same_kind & a["kind"].isin("datetime", "time"), seconds(a) == seconds(b))
        .when(same_kind & (a["kind"] == "coord"), near(at(a, 0), at(b, 0)) & near(at(a, 1), at(b, 1)))
        .when(same_kind & a["kind"].isin("list", "dict", "grid"), _nested_alike(a["str"], b["str"], near))
        .otherwise(kinds.same(a, b))
    )


def mismatches(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(id, tag) where two tables are not approximately equal; none: they are, whatever the order of rows.

    An entity that one side lacks gives a row for each of its tags, and one with tag null if it has none.
    """
    a, b = left.select("id", F.col("tags").alias("a")), right.select("id", F.col("tags").alias("b"))
    empty = F.create_map().cast(kinds.TAGS)
    both = a.join(b, "id", "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | (F.xxhash64(F.map_entries("a")) != F.xxhash64(F.map_entries("b"))))
    zipped = F.map_entries(F.map_zip_with(F.coalesce("a", empty), F.coalesce("b", empty), lambda k, x, y: F.struct(x.alias("x"), y.alias("y"))))
    rows = both.select("id", (F.col("a").isNull() | F.col("b").isNull()).alias("lone"), F.explode_outer(zipped).alias("e"))
    return rows.where(F.col("lone") | ~alike(F.col("e.value.x"), F.col("e.value.y"), tolerance)).select("id", F.col("e.key").alias("tag"))


def same_rows(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows of either side without a partner on the other, for rows without id: (columns of right, side).

    Partners have equal columns, but fractions may differ by the tolerance, and timestamps count by the second. As many
    rows as can be have a partner, one to one; so there is a row on neither side just where the tables are the same. Null,
    NaN and the infinities match their like.
    """
    fractions = [c for c in right.columns if isinstance(right.schema[c].dataType, T.FractionalType)]
    plain = lambda df: df.select(*[F.date_trunc("second", c).alias(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c) for c in right.columns])
    a, b = plain(left), plain(right)
    if not fractions:
        return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    return unmatched(a, b, fractions, tolerance)


def merged_sources(rows: DataFrame) -> DataFrame:
    """(source, id, tags) of several sources -> (id, tags, sources): equal tags once, conflicting ones as `tag^source`.

    One shuffle, by id: tags are grouped by name, and then again by entity, where the rows of an id already are.
    """
    each = rows.repartition("id").select("id", "source", F.explode_outer(F.map_entries("tags")).alias("e"))
    having = F.array_sort(F.collect_list(F.when(F.col("e.value").isNotNull(), F.struct("source", F.col("e.value").alias("value")))))
    tags = each.groupBy("id", F.col("e.key").alias("tag")).agg(having.alias("having"), F.collect_set("source").alias("sources"))
    key = lambda v: F.struct(v.kind.alias("kind"), v.str.alias("str"))
    entry = lambda name, v: F.struct(name.alias("key"), v.alias("value"))
    tag, first = F.col("tag"), F.get("having", F.lit(0))
    alike_ = F.forall("having", lambda x: key(x.value).eqNullSafe(key(first.value)))
    entries = F.when(alike_, F.array(entry(tag, first.value))).otherwise(F.transform("having", lambda x: entry(F.concat(tag, F.lit("^"), x.source), x.value)))
    found = tags.select("id", "sources", F.when(tag.isNotNull() & (F.size("having") > 0), entries).alias("entries"))
    out = found.groupBy("id").agg(F.map_from_entries(F.flatten(F.collect_list("entries"))).alias("tags"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return out.select("id", F.col("tags").cast(kinds.TAGS).alias("tags"), "sources")
