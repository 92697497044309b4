"""Grid files: Zinc, Trio, tagged JSON, Hayson and CSV, read in one scan per format and written in parallel.

Readers give (file, id, tags). Zinc, Trio and CSV files of any size are read by as many tasks as they have blocks. Scalars
are decoded by expressions; Python splits records into cells and makes JSON of nested values. Writers give every part its own header, so each part is a grid file of its own, and a folder that
is named like a grid file counts as one file, whose parts are in it.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds, nested, zinc
from . import splits

#: What a file's suffix says of its format.
SUFFIXES = {".hayson.json": "hayson", ".zinc": "zinc", ".trio": "trio", ".json": "json", ".csv": "csv"}
BOM = "\ufeff"


def grid_file(path: Column) -> Column:
    """The file that a path belongs to: the folder of a part that Spark wrote, else the path itself."""
    return F.regexp_replace(path, r"/part-[^/]*$", "")


def format_of(path: Column) -> Column:
    """The format that a path's suffix names, with or without .gz; null if none."""
    bare = F.regexp_replace(grid_file(path), r"\.gz$", "")
    out = F.lit(None).cast("string")
    for suffix, name in reversed(SUFFIXES.items()):
        out = F.when(bare.endswith(suffix), name).otherwise(out)
    return out


def _texts(spark: SparkSession, path: str, name: str, all_files: bool = False) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    if not all_files:  # decided by the names, before any content is read
        rows = rows.where(format_of(F.col("_metadata.file_path")) == name)
    return rows.select(grid_file(F.col("_metadata.file_path")).alias("file"), F.regexp_replace(F.ltrim("value"), f"^{BOM}", "").alias("text"))


def _records(spark: SparkSession, path: str, name: str, all_files: bool = False) -> DataFrame:
    """(file, header, record) of all files of a format, or of all files whatever their names."""
    rows = splits.records(spark, path, name, None if all_files else format_of(F.col("file")) == name)
    return rows.withColumn("file", grid_file(F.col("file")))


def _entities(rows: DataFrame) -> DataFrame:
    """(file, tags) -> (file, id, tags): nulls left out, id by its name."""
    tags = F.map_filter("tags", lambda k, v: v.isNotNull())
    return rows.select("file", tags.alias("tags")).select("file", F.col("tags")["id"]["str"].alias("id"), "tags")


def read_json(spark: SparkSession, path: str, all_files: bool = False, hayson: bool = False) -> DataFrame:
    """Tagged JSON, or Hayson: {meta, cols, rows: [{tag: value}]}. all_files: whatever their suffix, here and below."""
    rows = _texts(spark, path, "hayson" if hayson else "json", all_files)
    parsed = rows.select("file", F.explode(F.from_json("text", "rows ARRAY<MAP<STRING, STRING>>").rows).alias("row"))
    decode = (lambda k, v: kinds.bound(_requoted(v), zinc.decode_hayson)) if hayson else (lambda k, v: kinds.decode_tagged(v))
    return _entities(parsed.select("file", F.transform_values("row", decode).alias("tags")))


def _requoted(v: Column) -> Column:
    """from_json gives strings without quotes and everything else as JSON: quotes again what is no other JSON value."""
    other = v.rlike(r"^(\{|\[)") | v.isin("true", "false", "null") | v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    return F.when(v.isNull() | other, v).otherwise(F.concat(F.lit('"'), zinc.escape(v), F.lit('"')))


def grid_metadata(spark: SparkSession, path: str, name: str = "json") -> DataFrame:
    """(file, ver, meta): metadata of each grid file in tagged JSON, Hayson or Zinc."""
    rows = _texts(spark, path, name)
    if name == "zinc":
        first = F.split("text", "\r?\n", 2)[0]
        return rows.select("file", F.regexp_extract(first, r'ver:"([^"]*)"', 1).alias("ver"), F.trim(F.regexp_replace(first, r'^ver:"[^"]*"', "")).alias("meta"))
    meta = F.from_json("text", "meta MAP<STRING, STRING>").meta
    return rows.select("file", meta["ver"].alias("ver"), F.to_json(meta).alias("meta"))


def _csv(spark: SparkSession, path: str, file: Column) -> DataFrame:
    raw = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    cells = F.map_from_arrays(F.array(*[F.lit(c.lstrip(BOM)) for c in raw.columns]), F.array(*[F.col(f"`{c}`") for c in raw.columns]))
    return _entities(raw.select(file.alias("file"), F.transform_values(cells, lambda k, v: zinc.decode_csv(v)).alias("tags")))


_CELLS = "file string, tags array<string>, cells array<string>"


def _celled(columns: Callable[[list[str]], list[str]], split: Callable[[str], list[str]]):
    """A mapInArrow function over (file, header, record): (file, tags, cells), as many cells as the header has columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, known = pa.list_(pa.string()), (None, [])
        for batch in batches:
            names, cells = [], []
            for header, record in zip(batch["header"].to_pylist(), batch["record"].to_pylist(), strict=True):
                if header != known[0]:
                    known = (header, columns(header))
                names.append(known[1])
                cells.append([*split(record), *[""] * len(known[1])][: len(known[1])])
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(names, strings), pa.array(cells, strings)], ["file", "tags", "cells"])

    return run


def _csv_cells(record: str) -> list[str]:
    row = next(csv.reader(io.StringIO(record, newline="")), [])
    return [nested.nested_json(c) if c[:1] in ("[", "{") or c.startswith("<<") else c for c in row]


def _csv_names(header: list[str]) -> list[str]:
    return [c.strip() for c in next(csv.reader(io.StringIO(header[0], newline="")), [])]


def _zinc_cells(record: str) -> list[str]:
    return [nested.nested_json(c) if c.lstrip()[:1] in ("[", "{", "<") else c for c in nested.split(record, ",")]


def _zinc_names(header: list[str]) -> list[str]:
    return [c["name"] for c in nested.header(header)[1]]


def read_csv(spark: SparkSession, path: str, all_files: bool = False) -> DataFrame:
    """CSV, each file with its own header of tags, all in one scan. all_files: one header for all, read by Spark itself."""
    if all_files:
        return _csv(spark, path, grid_file(F.col("_metadata.file_path")))
    rows = _records(spark, path, "csv").mapInArrow(_celled(_csv_names, _csv_cells), _CELLS)
    return _entities(rows.select("file", F.transform_values(F.map_from_arrays("tags", "cells"), lambda k, v: zinc.decode_csv(v)).alias("tags")))


def read_zinc(spark: SparkSession, path: str, all_files: bool = False) -> DataFrame:
    """Zinc: all grids of each file; nested lists, dicts and grids may go over lines."""
    rows = _records(spark, path, "zinc", all_files).mapInArrow(_celled(_zinc_names, _zinc_cells), _CELLS)
    return _entities(rows.select("file", F.transform_values(F.map_from_arrays("tags", "cells"), lambda k, v: zinc.decode_zinc(v)).alias("tags")))


def zinc_columns(spark: SparkSession, path: str) -> DataFrame:
    """(file, tag, meta): the columns of each grid of Zinc files, with their metadata as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(file, c["name"], json.dumps({k: v for k, v in c.items() if k != "name"}, ensure_ascii=False, separators=(",", ":"))) for file, text in zip(batch["file"].to_pylist(), batch["text"].to_pylist(), strict=True) for _, columns, _ in nested.grids(text) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in range(3)], ["file", "tag", "meta"])

    return _texts(spark, path, "zinc").mapInArrow(run, "file string, tag string, meta string")


def _trio_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["file"], pa.array([nested.trio_lines(t) for t in batch["text"].to_pylist()], pa.string())], ["file", "text"])


def read_trio(spark: SparkSession, path: str, all_files: bool = False) -> DataFrame:
    """Trio: `tag: value` lines, records between lines of dashes, bare tags as markers, indented lines continue a value.

    Python makes JSON of nested values (`Zinc:` blocks, lists, dicts); records without them only pass it once, to be found.
    """
    texts = _records(spark, path, "trio", all_files).select("file", F.col("record").alias("text"))
    has = F.col("text").rlike(r"(?m)^\w+:\s*(Zinc:\s*$|[\[{<])")
    texts = texts.where(~has).unionByName(texts.where(has).mapInArrow(_trio_texts, "file string, text string"))
    text = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"(?m)^//.*$", ""), r"\n[ \t]+", "\u0001")
    records = texts.select("file", text.alias("text")).where(F.col("text").rlike(r"\S"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    name = lambda x: F.trim(F.split(x, ":", 2)[0])
    rest = lambda x: F.when(x.contains(":"), F.trim(F.split(x, ":", 2)[1])).otherwise("M")
    joined = lambda v: F.replace(F.regexp_replace(v, "^\u0001", ""), F.lit("\u0001"), F.lit("\n"))
    tags = F.map_from_arrays(F.transform(lines, name), F.transform(lines, lambda x: joined(rest(x))))
    return _entities(records.select("file", F.transform_values(tags, lambda k, v: F.when(v.contains("\n"), kinds.value("str", v)).otherwise(zinc.decode_zinc(v))).alias("tags")))


READERS = {"zinc": read_zinc, "trio": read_trio, "csv": read_csv, "json": read_json, "hayson": lambda spark, path, all_files=False: read_json(spark, path, all_files, hayson=True)}


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """All grid files below a path, whatever their formats."""
    out = None
    for read in READERS.values():
        one = read(spark, path)
        out = one if out is None else out.unionByName(one)
    return out


def _framed(lines: DataFrame, head: str, foot: str, joint: str) -> DataFrame:
    """Text lines with a head before and a foot behind those of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            values = batch["value"].to_pylist()
            if values:
                out = [head] if first and head else []
                out += [v if first and k == 0 or not joint else joint + v for k, v in enumerate(values)]
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if not first and foot:
            yield pa.RecordBatch.from_arrays([pa.array([foot], pa.string())], ["value"])

    return lines.mapInArrow(run, "value string")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literals(values: pd.Series) -> pd.Series:
    return values.map(lambda row: nested.zinc_literals(list(row)))


def lines(entities: DataFrame, name: str, tags: list[str], with_nested: bool = False) -> DataFrame:
    """One text line (or record) for each entity."""
    # one expression for all tags: a scalar's encoder is long, and must not be repeated for each of them
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), F.col("tags")[t].alias("value")) for t in tags])
    if with_nested and name in ("zinc", "csv", "trio"):  # what lists, dicts and grids are in Zinc
        texts = _literals(F.transform(pairs, lambda e: F.when(e["value"]["kind"].isin("list", "dict", "grid"), e["value"]["str"])))
        entities = entities.withColumn("_literals", texts)
        shown = lambda e, i: F.when(F.get("_literals", i).isNotNull(), e["value"].withField("str", F.get("_literals", i))).otherwise(e["value"])
        pairs = F.transform(pairs, lambda e, i: F.struct(e["tag"].alias("tag"), shown(e, i).alias("value")))
    there = F.filter(pairs, lambda e: e["value"].isNotNull())
    if name == "zinc":
        return entities.select(F.array_join(F.transform(pairs, lambda e: F.when(e["value"].isNull(), "").otherwise(zinc.encode_zinc(e["value"]))), ",").alias("value"))
    if name == "csv":
        quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        cells_ = F.transform(pairs, lambda e: zinc.encode_csv(e["value"]))
        return entities.select(F.array_join(F.transform(cells_, quoted), ",").alias("value"))
    if name == "trio":
        block = lambda e: F.concat(e["tag"], F.lit(": Zinc:\n  "), F.regexp_replace(F.regexp_replace(e["value"]["str"], r"^<<\n|\n>>$", ""), "\n", "\n  "))
        line = lambda e: F.when(e["value"]["kind"] == "marker", e["tag"]).when(e["value"]["str"].startswith("<<\n"), block(e)).otherwise(F.concat(e["tag"], F.lit(": "), zinc.encode_zinc(e["value"])))
        return entities.select(F.concat(F.array_join(F.transform(there, line), "\n"), F.lit("\n---")).alias("value"))
    plain = lambda c: F.when(c["kind"].isin("bool", "list", "dict", "grid"), c["str"]).otherwise(F.concat(F.lit('"'), zinc.escape(kinds.encode_tagged(c)), F.lit('"')))
    encode = zinc.encode_hayson if name == "hayson" else plain
    pair = lambda e: F.concat(F.lit('"'), e["tag"], F.lit('":'), encode(e["value"]))
    return entities.select(F.concat(F.lit("{"), F.array_join(F.transform(there, pair), ","), F.lit("}")).alias("value"))


def write_grids(entities: DataFrame, path: str, name: str, tags: list[str], mode: str = "errorifexists", with_nested: bool = False) -> None:
    """Writes entities as files of one format, a grid in each part. A path that ends in the format's suffix reads as one file.

    with_nested: there may be lists, dicts or grids among the values, whose Zinc takes a step in Python.
    """
    heads = {
        "zinc": ('ver:"3.0"\n' + ",".join(tags), "", ""),
        "csv": (",".join(tags), "", ""),
        "trio": ("", "", ""),
    }
    columns = ",".join(f'{{"name":"{t}"}}' for t in tags)
    head, foot, joint = heads.get(name, (f'{{"meta":{{"ver":"3.0"}},"cols":[{columns}],"rows":[', "]}", ","))
    _framed(lines(entities, name, tags, with_nested), head, foot, joint).write.mode(mode).text(path)


#: Rows of a part, at least, on the average.
LEAST = 1_000


def spread(entities: DataFrame, most: int, *keys: str) -> DataFrame:
    """Deals entities to parts to be written: four for each core, and more where one would hold over `most` rows.

    Encoding and reading cost far more than a shuffle, and small tables come in one or two tasks. Parts well below a core's
    share are read as one block each, in one pass, and a part of JSON is held as one row.
    """
    n = entities.count()
    parts = max(4 * entities.sparkSession.sparkContext.defaultParallelism, -(-n // most))
    return entities.repartition(max(1, min(parts, n // LEAST)), *keys)


def write_tables(path: str, entities: DataFrame | None = None, metadata: DataFrame | None = None, series: DataFrame | None = None, mode: str = "overwrite") -> None:
    """The three-table layout as parquet: entities by tenant, metadata, series by day."""
    if entities is not None:
        entities.write.mode(mode).partitionBy("customer_id").parquet(f"{path}/entities")
    if metadata is not None:
        metadata.write.mode(mode).parquet(f"{path}/metadata")
    if series is not None:
        series.withColumn("day", F.to_date("ts")).repartition("day", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("id", "ts").write.mode(mode).partitionBy("day").parquet(f"{path}/series")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def entities_from_json(rows: DataFrame, column: str = "entity") -> DataFrame:
    """A relational table whose entities are tagged JSON objects -> tag maps."""
    tags = F.transform_values(F.from_json(column, "MAP<STRING, STRING>"), lambda k, v: kinds.decode_tagged(v))
    return rows.withColumn("tags", F.map_filter(tags, lambda k, v: v.isNotNull())).drop(column)
