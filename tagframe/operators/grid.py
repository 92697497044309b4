"""Entity tables in tag-map form (`id, tags MAP<STRING, TAG_VALUE>`) and wide form: columns, rows, sorts and counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds


def to_tags(wide: DataFrame, key: str = "id", keep: tuple[str, ...] = (), values: Mapping[str, Column] | None = None) -> DataFrame:
    """Wide form to tag map. values: how a column becomes a TAG_VALUE where its type does not tell."""
    values = dict(values or {})
    skip = {key, *keep}
    for f in wide.schema.fields:
        if f.name in skip or f.name in values:
            continue
        c, kind = F.col(f"`{f.name}`"), (f.metadata or {}).get("kind")
        if kind == "ref" or f.name.endswith("Ref"):
            values[f.name] = kinds.ref(c.cast("string"))
        elif kind == "marker":
            values[f.name] = kinds.marker(c)
        elif isinstance(f.dataType, T.NumericType):
            values[f.name] = kinds.number(c)
        elif isinstance(f.dataType, T.BooleanType):
            values[f.name] = F.when(c.isNotNull(), kinds.value("bool", c.cast("string"), num=c.cast("double")))
        elif isinstance(f.dataType, T.DateType):
            values[f.name] = F.when(c.isNotNull(), kinds.value("date", c.cast("string")))
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            values[f.name] = kinds.datetime(c.cast("timestamp"))
        else:
            values[f.name] = F.when(c.isNotNull(), kinds.value(kind or "str", c.cast("string")))
    pairs = [F.struct(F.lit(n).alias("key"), v.cast(kinds.TAG_VALUE).alias("value")) for n, v in sorted(values.items())]
    tags = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))
    return wide.select(key, *keep, tags.alias("tags"))


def to_wide(entities: DataFrame, tags: Mapping[str, str], key: str = "id") -> DataFrame:
    """Tag map to wide form. tags: the typed reading of each tag (see kinds.typed), or `marker`."""
    read = lambda t, how: F.when(F.col("tags")[t]["kind"] == "marker", True) if how == "marker" else kinds.typed(F.col("tags")[t], how)
    return entities.select(key, *[read(t, how).alias(t) for t, how in tags.items()])


def exploded(entities: DataFrame, *keys: str) -> DataFrame:
    """(keys, tag, value): the form that can be grouped, joined and compared."""
    return entities.select(*(keys or ("id",)), F.explode("tags").alias("tag", "value"))


def regrouped(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, tag, value) back to tag maps."""
    return rows.groupBy(*(keys or ("id",))).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "value")), lambda a, b: F.when(a.tag < b.tag, -1).when(a.tag > b.tag, 1).otherwise(0))).alias("tags"))


def tag_hash(tags: Column) -> Column:
    """One number for a tag map, whatever its order; refs count by name, as equality does."""
    pairs = F.transform(F.map_entries(tags), lambda e: F.struct(e.key.alias("tag"), e.value.kind.alias("kind"), e.value.str.alias("str")))
    return F.xxhash64(F.array_sort(pairs))


def selected(df: DataFrame, spec: str) -> DataFrame:
    """`a,b` keeps these columns in this order (unknown ones are empty); `!a,!b` drops them; signs do not mix."""
    names = [n.strip() for n in spec.split(",") if n.strip()]
    minus = [n[1:] for n in names if n.startswith("!")]
    if not names:
        return df
    if minus and len(minus) < len(names):
        raise ValueError("a selection either keeps or drops columns")
    if minus:
        return df.drop(*minus)
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def selected_tags(entities: DataFrame, spec: str) -> DataFrame:
    """The same for tag maps."""
    names = [n.strip() for n in spec.split(",") if n.strip()]
    minus = [n[1:] for n in names if n.startswith("!")]
    if minus and len(minus) < len(names):
        raise ValueError("a selection either keeps or drops tags")
    if not names:
        return entities
    return entities.withColumn("tags", F.map_filter("tags", (lambda k, v: ~k.isin(minus)) if minus else (lambda k, v: k.isin(names))))


def purged(entities: DataFrame, columns: list[str]) -> DataFrame:
    """Drops the tags that are not declared."""
    return selected_tags(entities, ",".join(columns)) if columns else entities.withColumn("tags", F.map_filter("tags", lambda k, v: F.lit(False)))


def all_tags(entities: DataFrame) -> DataFrame:
    """(tag, entities): every tag that some row has, with the number of rows."""
    return exploded(entities).where("value IS NOT NULL").groupBy("tag").agg(F.count("*").alias("entities"))


def packed(wide: DataFrame) -> DataFrame:
    """Keeps the columns that some row uses; one pass counts them all."""
    counts = wide.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in wide.columns]).first()
    return wide.select(*[F.col(f"`{c}`") for c in wide.columns if counts[c]])


def tag_values(df: DataFrame, tag: str, tenant: str | None = None) -> DataFrame:
    """Distinct values of a column in order, without null."""
    if tenant is not None:
        df = df.where(F.col("customer_id") == tenant)
    return df.select(F.col(f"`{tag}`").alias("value")).where("value IS NOT NULL").distinct().orderBy("value")


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Ids that more than one row has: an entity table must give none."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def markers(entities: DataFrame) -> DataFrame:
    """(id, markers): the names of each entity's marker tags, in order."""
    return entities.select("id", F.array_sort(F.map_keys(F.map_filter("tags", lambda k, v: v.kind == "marker"))).alias("markers"))


def page(df: DataFrame, start: int, end: int | None, *order: str) -> DataFrame:
    """Rows [start, end) in an order."""
    out = df.orderBy(*(order or ("id",))).offset(start)
    return out if end is None else out.limit(max(0, end - start))


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Deletes rows by id."""
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def upserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Replaces rows by id, and adds those with new ids."""
    return without(df, rows).unionByName(rows, allowMissingColumns=True)


def display_name(identity: Column, dis: Column) -> Column:
    """Display text of an entity: that of its id, else its dis tag, else the id's name."""
    return F.coalesce(identity["dis"], dis, identity["str"])
