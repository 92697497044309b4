"""The graph that references make of an entity table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(entities: DataFrame) -> DataFrame:
    """(from_id, to_id, relation) for every reference tag but id."""
    rows = entities.select(F.col("id").alias("from_id"), F.explode("tags").alias("relation", "value"))
    return rows.where((F.col("value.kind") == "ref") & (F.col("relation") != "id")).select("from_id", F.col("value.str").alias("to_id"), "relation")


def wide_edges(entities: DataFrame, relations: list[str]) -> DataFrame:
    """The same from reference columns of a wide table."""
    each = F.array(*[F.struct(F.col(r).alias("to_id"), F.lit(r).alias("relation")) for r in relations])
    return entities.select(F.col("id").alias("from_id"), F.inline(F.filter(each, lambda e: e.to_id.isNotNull())))


def dangling(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose target is in no table."""
    return links.join(entities.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id", "relation")


def relations(links: DataFrame) -> DataFrame:
    return links.select("relation").distinct()


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree): edges that begin or end at each entity; hubs are summed in parts before they meet."""
    return links.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def without_site_edges(links: DataFrame, relation: str = "siteRef") -> DataFrame:
    """Drops the siteRef edges of entities that have another edge."""
    other = F.max(F.col("relation") != relation).over(Window.partitionBy("from_id"))
    return links.withColumn("other", other).where((F.col("relation") != relation) | ~F.col("other")).drop("other")
