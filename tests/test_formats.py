import gzip
import json

import pytest
from pyspark.sql import functions as F

from tagframe.functions import kinds, nested, zinc
from tagframe.jobs import series
from tagframe.sources import formats

TEXTS = ["m:", "z:", "-:", "true", "n:1.500000 kW", "n:-2.000000", "n:INF", "s:a: b", "u:http://x", "r:a.b c d", "d:2021-02-03", "h:10:20:30", "t:2021-02-03T04:05:06.000000Z UTC", "c:1.500000,-2.000000", "b:text/plain"]


def kind_and_text(rows):
    return [(r.v.kind, r.v.str, r.v.num, r.v.unit, r.v.dis) if r.v else None for r in rows]


def test_tagged_scalars_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    out = df.select("t", kinds.decode_tagged(F.col("t")).alias("v")).withColumn("again", kinds.encode_tagged(F.col("v")))
    assert [r.again for r in out.collect()] == TEXTS
    xstr = spark.range(1).select(kinds.decode_tagged(F.lit("x:b64:3q0=")).alias("a"), kinds.decode_tagged(F.lit("x:hex:dead")).alias("b")).first()
    assert xstr.a.str == xstr.b.str == "DEAD"


@pytest.mark.parametrize(("decode", "encode"), [(zinc.decode_zinc, zinc.encode_zinc), (zinc.decode_csv, zinc.encode_csv), (zinc.decode_hayson, zinc.encode_hayson)])
def test_every_kind_round_trips(spark, decode, encode):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, 's:q"uo\\te\n', "s:é", "s:T", "s:12"]], "t string").coalesce(1).select(kinds.decode_tagged(F.col("t")).alias("v"))
    a, b = df.collect(), df.select(decode(encode(F.col("v"))).alias("v")).collect()
    assert kind_and_text(a) == kind_and_text(b)


@pytest.mark.parametrize(
    ("text", "want"),
    [("M", ("marker", "M")), ("N", None), ("", None), ("T", ("bool", "true")), ('"a\\u00e9\\n\\$"', ("str", "aé\n$")), ("`x`", ("uri", "x")), ('@a "D d"', ("ref", "a")), ("1_000.5°F", ("number", "1000.5 °F")), ("2021-02-03", ("date", "2021-02-03")), ("10:20", ("time", "10:20:00")), ("C(1,2)", ("coord", "1.000000,2.000000")), ('b64("3q0=")', ("xstr", "DEAD")), ("[1,2]", ("list", "[1,2]")), ("{a:1}", ("dict", "{a:1}"))],
)
def test_zinc_literals(spark, text, want):
    v = spark.range(1).select(zinc.decode_zinc(F.lit(text)).alias("v")).first().v
    assert (v and (v.kind, v.str)) == want


def test_split():
    assert nested.split('1,"a,b",[1,2],{x:"]"},C(1,2),<<a,b>>,,`u,v`,@r "d,e"', ",") == ["1", '"a,b"', "[1,2]", '{x:"]"}', "C(1,2)", "<<a,b>>", "", "`u,v`", '@r "d,e"']


NESTED = [
    ("[1, 2]", '["n:1.000000","n:2.000000"]'),
    ('[1kW,"a, b",[T,N],{x:"]"}]', '["n:1.000000 kW","s:a, b",[true,null],{"x":"s:]"}]'),
    ('{a b:2 c:"x y", d:@r "D d" e:@q f}', '{"a":"m:","b":"n:2.000000","c":"s:x y","d":"r:r D d","e":"r:q","f":"m:"}'),
    ("{a:{b:1 c:[1,2]} d}", '{"a":{"b":"n:1.000000","c":["n:1.000000","n:2.000000"]},"d":"m:"}'),
    ("[]", "[]"),
    ("{}", "{}"),
    ('<<\nver:"3.0" dis:"g"\nts,val unit:"kW"\n2021-01-01T00:00:00Z UTC,1\n>>', '{"meta":{"ver":"3.0","dis":"s:g"},"cols":[{"name":"ts"},{"name":"val","unit":"s:kW"}],"rows":[{"ts":"t:2021-01-01T00:00:00.000000Z UTC","val":"n:1.000000"}]}'),
    ('[C(1,2),hex("DEAD"),b64("3q0="),`u`,2021-01-01,10:20,NA,R,M,-INF]', '["c:1.000000,2.000000","x:hex:dead","x:hex:dead","u:u","d:2021-01-01","h:10:20:00","z:","-:","m:","n:-INF"]'),
]


@pytest.mark.parametrize(("text", "want"), NESTED)
def test_nested_literals(text, want):
    assert nested.nested_json(text) == want
    assert nested.nested_json(nested.literal(json.loads(want))) == want


def test_grids_over_lines_and_blank_lines(spark, tmp_path):
    text = 'ver:"3.0" x:1\nid dis:"I",his\n@a "A",<<\nver:"3.0"\nts,val\n2021-01-01T00:00:00Z UTC,1\n\n>>\n@b,[1, 2]\n\nver:"3.0"\nid,q\n@c,3\n'
    (tmp_path / "x.zinc").write_text(text)
    got = {r.id: {k: (v.kind, v.str) for k, v in r.tags.items() if k != "id"} for r in formats.read_zinc(spark, str(tmp_path)).collect()}
    assert got["b"] == {"his": ("list", '["n:1.000000","n:2.000000"]')} and got["c"] == {"q": ("number", "3.0")}
    assert got["a"]["his"][0] == "grid" and set(got) == {"a", "b", "c"}
    points = series.import_nested(formats.read_zinc(spark, str(tmp_path)), "his").collect()
    assert [(p.id, p.ts.isoformat(), p.val.num) for p in points] == [("a", "2021-01-01T00:00:00", 1.0)]
    assert {(r.tag, r.meta) for r in formats.zinc_columns(spark, str(tmp_path)).collect()} == {("id", '{"dis":"s:I"}'), ("his", "{}"), ("id", "{}"), ("q", "{}")}


def test_trio_zinc_block(spark, tmp_path):
    (tmp_path / "x.trio").write_text('id: @a\nhistory: Zinc:\n  ver:"3.0"\n  ts,val\n  2021-01-01T00:00:00Z UTC,1\nlist: [1, 2]\nsite\n---\n')
    row = formats.read_trio(spark, str(tmp_path)).first()
    assert row.tags["history"].kind == "grid" and row.tags["list"].str == '["n:1.000000","n:2.000000"]' and row.tags["site"].kind == "marker"


@pytest.mark.parametrize("name", ["zinc", "trio", "csv", "json"])
def test_nested_values_round_trip(spark, tmp_path, name):
    rows = [(str(k), kind, want) for k, (_, want) in enumerate(NESTED) for kind in [{"[": "list", "{": "dict"}[want[0]] if "rows" not in want else "grid"]]
    df = spark.createDataFrame(rows, "id string, kind string, text string")
    tags = F.create_map(F.lit("id"), kinds.ref(F.col("id")), F.lit("v"), kinds.value(F.col("kind"), F.col("text")))
    suffix = next(s for s, n in formats.SUFFIXES.items() if n == name)
    formats.write_grids(df.select("id", tags.cast(kinds.TAGS).alias("tags")), f"{tmp_path}/all{suffix}", name, ["id", "v"], with_nested=True)
    got = {(r.id, r.tags["v"].kind, r.tags["v"].str) for r in formats.read_grids(spark, str(tmp_path)).collect()}
    assert got == set(rows)


def test_a_folder_of_all_kinds_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n@a,1\n")
    (tmp_path / "b.csv").write_text('\ufeffy,id\n"two, 2",@b\n')
    with gzip.open(tmp_path / "c.zinc.gz", "wt") as f:
        f.write('ver:"3.0"\nid,z\n@c,3\n')
    (tmp_path / "d.hayson.json").write_text('{"meta":{"ver":"3.0"},"cols":[{"name":"id"}],"rows":[{"id":{"_kind":"Ref","val":"d"}}]}')
    (tmp_path / "readme.md").write_text("no grid")
    got = {r.id: (r.file.rsplit("/", 1)[-1], {k: v.str for k, v in r.tags.items() if k != "id"}) for r in formats.read_grids(spark, str(tmp_path)).collect()}
    assert got == {"a": ("a.csv", {"x": "1.0"}), "b": ("b.csv", {"y": "two, 2"}), "c": ("c.zinc.gz", {"z": "3.0"}), "d": ("d.hayson.json", {})}


@pytest.fixture(scope="module")
def entities(spark):
    rows = [("a", {"id": "r:a Alpha", "site": "m:", "area": "n:12.500000 ft²", "dis": 's:It, "is"', "on": "true"}), ("b", {"id": "r:b", "siteRef": "r:a", "at": "d:2021-02-03"})]
    df = spark.createDataFrame(rows, "id string, t map<string,string>")
    return df.select("id", F.transform_values("t", lambda k, v: kinds.decode_tagged(v)).alias("tags"))


@pytest.mark.parametrize("name", ["zinc", "trio", "json", "hayson", "csv"])
def test_files_round_trip(spark, entities, tmp_path, name):
    tags = ["id", "site", "area", "dis", "on", "siteRef", "at"]
    formats.write_grids(entities.coalesce(1), f"{tmp_path}/{name}", name, tags)
    suffix = next(s for s, n in formats.SUFFIXES.items() if n == name)
    part = next((tmp_path / name).glob("part-*.txt"))
    text = part.read_text()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / f"town{suffix}").write_text("﻿" + text)
    got = {r.id: {k: (v.kind, v.str, v.num, v.unit, v.dis) for k, v in r.tags.items()} for r in formats.READERS[name](spark, f"{tmp_path}/in").collect()}
    want = {r.id: {k: (v.kind, v.str, v.num, v.unit, v.dis) for k, v in r.tags.items()} for r in entities.collect()}
    assert got == want


def test_trio_text(spark, tmp_path):
    (tmp_path / "x.trio").write_text('// note\ndis: "A"\nsite\narea: 10ft²\ndoc:\n  one\n  two\n---\n-----\ndis: Plain text here\nid: @b "B"\n')
    rows = sorted(formats.read_trio(spark, str(tmp_path)).collect(), key=lambda r: r.id or "")
    assert rows[0].tags["site"].kind == "marker" and rows[0].tags["area"].unit == "ft²" and rows[0].tags["doc"].str == "one\ntwo"
    assert rows[1].id == "b" and rows[1].tags["dis"].str == "Plain text here"


def test_tables(spark, entities, tmp_path):
    e = entities.withColumn("customer_id", F.lit("c"))
    series = spark.range(5).select(F.lit("p").alias("id"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.col("id").cast("double").alias("val"))
    formats.write_tables(str(tmp_path), e, None, series)
    assert formats.read_table(spark, str(tmp_path), "entities").count() == 2
    assert formats.read_table(spark, str(tmp_path), "series").where("day = '1970-01-03'").count() == 1
    rows = spark.createDataFrame([("a", '{"id":"r:a","n":"n:1.0","x":null}')], "id string, entity string")
    assert formats.entities_from_json(rows).first().tags.keys() == {"id", "n"}


def test_entities_are_spread_over_parts_before_they_are_written(spark, tmp_path):
    from tagframe import queries
    from tagframe.sources import formats

    rows = spark.range(8_000).select(F.col("id").cast("string").alias("id")).coalesce(1)
    assert formats.spread(rows, 50_000, "id").rdd.getNumPartitions() == 8 and formats.spread(rows.limit(10), 50_000, "id").rdd.getNumPartitions() == 1
    assert formats.spread(rows, 100, "id").rdd.getNumPartitions() == 8  # never under LEAST rows
    files, made = [], formats.write_grids
    try:
        formats.write_grids = lambda entities, path, *more, **named: (made(entities, path, *more, **named), files.append(len(spark.read.text(path, wholetext=True).collect())))
        back = queries.QUERIES["files_hayson"](spark, "/root/testdata/sf0.1")
    finally:
        formats.write_grids = made
    assert files[0] >= 10 and back.count() == 16_000
