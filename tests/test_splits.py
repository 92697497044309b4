import csv
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from tagframe.functions import nested
from tagframe.sources import formats, splits


def whole_csv(text):
    """All rows of a text, read at once."""
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
    return [[*r, *[""] * len(rows[0])][: len(rows[0])] for r in rows[1:]]


def whole_zinc(text):
    return [(tuple(c["name"] for c in columns), tuple(row)) for _, columns, rows in nested.grids(text) for row in rows]


def csv_text(rnd, rows):
    cell = lambda: rnd.choice(["", "x", "12", 'say ""hi""', "é漢", "a,b", "line\nbreak", "\n\n", '""', "5' 2"])
    out = ["id,a,b,c"]
    for k in range(rows):
        cells = [cell() for _ in range(rnd.choice([2, 3, 3, 4]))]
        out.append(",".join([f"r{k}", *[f'"{c}"' if set(c) & set(',\n"') else c for c in cells]]))
        if rnd.random() < 0.1:
            out.append("")
    return rnd.choice(["", "﻿"]) + "\n".join(out) + rnd.choice(["", "\n"])


def zinc_text(rnd, grids):
    cell = lambda: rnd.choice(["", "M", "12kW", '"a, \\"b\\" ["', "`http://x,y`", '@r "D, d"', "[1,2]", "[1,\n2,[3]]", "{a b:2}", '<<\nver:"3.0"\nts,val\n2021-01-01T00:00:00Z UTC,1\n\n>>', '"]"', "C(1,2)", '"over\nlines ["'])
    out = []
    for g in range(grids):
        out += [f'ver:"3.0" dis:"grid {g}"', ",".join(["id", *[f"t{g}x{k} dis:\"T\"" for k in range(rnd.randint(1, 3))]])]
        out += [",".join([f"@g{g}r{k}", *[cell() for _ in range(rnd.randint(1, 3))]]) for k in range(rnd.choice([0, 1, 5, 30]))]
        out += [""] * rnd.randint(1, 2)
    return "\n".join(out) + "\n"


@pytest.fixture(params=["64b", "300b", "2k"])
def small_blocks(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_of_split_files_are_those_of_whole_ones(spark, tmp_path, small_blocks):
    rnd = random.Random(3)
    texts = {f"c{k}.csv": csv_text(rnd, rnd.choice([0, 1, 40])) for k in range(3)} | {f"z{k}.zinc": zinc_text(rnd, rnd.choice([1, 6])) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    with gzip.open(tmp_path / "packed.csv.gz", "wt", newline="") as f:
        f.write(texts["c1.csv"])
    base = F.element_at(F.split("file", "/"), -1)
    rows = splits.records(spark, str(tmp_path), "csv", F.col("file").rlike(r"\.csv(\.gz)?$")).select(base.alias("file"), "header", "record").collect()
    for name in ("c0.csv", "c1.csv", "c2.csv", "packed.csv.gz"):
        want = whole_csv(texts.get(name, texts["c1.csv"]))
        got = [formats._csv_cells(r.record) for r in rows if r.file == name]
        assert sorted([*r, *[""] * 4][:4] for r in got) == sorted(want), name
        assert all(formats._csv_names(r.header) == ["id", "a", "b", "c"] for r in rows)
    rows = splits.records(spark, str(tmp_path), "zinc", F.col("file").endswith(".zinc")).select(base.alias("file"), "header", "record").collect()
    for name in ("z0.zinc", "z1.zinc", "z2.zinc"):
        got = [(tuple(formats._zinc_names(r.header)), tuple(formats._zinc_cells(r.record))) for r in rows if r.file == name]
        assert sorted(got) == sorted(whole_zinc(texts[name])), name


def test_trio_records_over_blocks(spark, tmp_path, small_blocks):
    text = "".join(f"id: @r{k}\ndis: \"name {k}\"\ntext:\n  first line\n  second line {k}\nhis: Zinc:\n  ver:\"3.0\"\n  ts,val\n  2021-01-01T00:00:00Z UTC,{k}\nsite\n---\n" for k in range(20)) + "id: @last\nsite\n"
    (tmp_path / "x.trio").write_text(text)
    rows = {r.id: r.tags for r in formats.read_trio(spark, str(tmp_path)).collect()}
    assert len(rows) == 21 and rows["r7"]["dis"].str == "name 7" and rows["r7"]["text"].str == "first line\nsecond line 7"
    assert all(rows[f"r{k}"]["his"].kind == "grid" and f'"val":"n:{k}.000000"' in rows[f"r{k}"]["his"].str for k in range(20)) and rows["last"]["site"].kind == "marker"


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.zinc").write_text('ver:"3.0"\nid,dis,val\n' + "".join(f'@p{k},"point {k}",{k}kW\n' for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = formats.read_zinc(spark, str(tmp_path))
        spread = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(spread) > 4 and sum(r["count"] for r in spread) == 20_000
        assert rows.select(F.sum(F.col("tags")["val"]["num"])).first()[0] == sum(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
