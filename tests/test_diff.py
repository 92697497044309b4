import random

from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.operators import diff, graph, grid, matching


def table(spark, rows):
    """rows: {id: {tag: number or text or True}}."""
    flat = [(i, t, v if isinstance(v, float) else None, v if isinstance(v, str) else None, v is True) for i, tags in rows.items() for t, v in tags.items()]
    df = spark.createDataFrame(flat, "id string, tag string, n double, s string, m boolean")
    value = F.when(F.col("m"), kinds.value("marker", F.lit("M"))).when(F.col("n").isNotNull(), kinds.number(F.col("n"))).otherwise(kinds.string(F.col("s")))
    return grid.regrouped(df.select("id", "tag", value.cast(kinds.TAG_VALUE).alias("value")))


def plain(df):
    return {r.id: {k: True if v.kind == "marker" else v.num if v.kind == "number" else v.str for k, v in r.tags.items()} for r in df.collect()}


def test_patch_law_on_random_tables(spark):
    rnd = random.Random(8)
    for _ in range(4):
        make = lambda: {f"i{k}": {t: rnd.choice([1.0, 2.0, "x", True]) for t in "abcd" if rnd.random() < 0.6} | {"z": 0.0} for k in range(8) if rnd.random() < 0.7}
        a, b = make(), make()
        left, right = table(spark, a), table(spark, b)
        patch = diff.patch_of(left, right)
        assert plain(diff.patched(left, patch)) == b
        assert diff.mismatches(diff.patched(left, patch), right).count() == 0
        assert diff.patch_of(left, left).count() == 0
        ops = {(r.id, r.tag): r.op for r in diff.changes(left, right).collect()}
        for i in a.keys() & b.keys():
            for t in a[i].keys() | b[i].keys():
                want = None if a[i].get(t) == b[i].get(t) and type(a[i].get(t)) is type(b[i].get(t)) else "add" if t not in a[i] else "drop" if t not in b[i] else "change"
                assert ops.get((i, t)) == want


def test_rows_without_id_match_one_to_one(spark):
    left = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    right = spark.createDataFrame([(1, 2), (5, 6)], "a int, b int")
    patch = diff.row_patch(left, right)
    assert sorted(tuple(r) for r in patch.collect()) == [(1, 2, True), (3, 4, True), (5, 6, False)]
    assert sorted(tuple(r) for r in diff.rows_patched(left, patch).collect()) == [(1, 2), (5, 6)]


def test_approximate_equality(spark):
    one = lambda v: spark.range(1).select(F.lit("i").alias("id"), F.create_map(F.lit("t"), v.cast(kinds.TAG_VALUE)).alias("tags"))
    num = lambda x, u=None: kinds.number(F.lit(x), None if u is None else F.lit(u))
    at = lambda s: kinds.datetime_text(F.lit(s), F.lit("UTC"))
    same = [(num(1.0), num(1.0 + 9e-7)), (num(1.0, "m"), num(1.0 + 9e-7, "m")), (at("2021-01-01T00:00:00.1"), at("2021-01-01T00:00:00.2")), (kinds.value("coord", F.lit("1.000000,2.000000")), kinds.value("coord", F.lit("1.000001,2.000000")))]
    other = [(num(1.0), num(1.1)), (num(1.0, "m"), num(1.0, "s")), (at("2021-01-01T00:00:00"), at("2021-01-01T00:00:01")), (num(1.0), kinds.string(F.lit("1.0")))]
    assert all(diff.mismatches(one(a), one(b)).count() == 0 for a, b in same)
    assert all(diff.mismatches(one(a), one(b)).count() == 1 for a, b in other)


def test_metadata_patches(spark):
    assert diff.metadata_patch({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}, "R") == {"b": 3, "c": 4}
    assert diff.metadata_patch({"a": 1}, {}, "R") == {"a": "R"}
    a = spark.range(1).withMetadata("id", {"x": 1}).withColumn("old", F.lit(1)).schema
    assert diff.column_metadata_patch(a, spark.range(1).withMetadata("id", {"y": 2}).schema, "R") == {"id": {"y": 2, "x": "R"}, "old": "R"}


def test_merged_sources(spark):
    a, b = table(spark, {"i": {"x": 1.0, "y": "p"}}), table(spark, {"i": {"x": 1.0, "y": "q", "z": True}, "j": {"x": 2.0}})
    rows = a.withColumn("source", F.lit("A")).unionByName(b.withColumn("source", F.lit("B")))
    got = diff.merged_sources(rows)
    assert plain(got) == {"i": {"x": 1.0, "y^A": "p", "y^B": "q", "z": True}, "j": {"x": 2.0}}
    assert {r.id: r.sources for r in got.collect()} == {"i": ["A", "B"], "j": ["B"]}


def test_grid_columns_and_rows(spark):
    df = table(spark, {"i": {"x": 1.0, "m": True}, "j": {"y": "a"}})
    assert {r.tag: r.entities for r in grid.all_tags(df).collect()} == {"x": 1, "m": 1, "y": 1}
    assert plain(grid.purged(df, ["x"])) == {"i": {"x": 1.0}, "j": {}}
    assert plain(grid.selected_tags(df, "!x,!y")) == {"i": {"m": True}, "j": {}}
    assert plain(grid.upserted(df, table(spark, {"j": {"q": 5.0}, "k": {"q": 6.0}}))) == {"i": {"x": 1.0, "m": True}, "j": {"q": 5.0}, "k": {"q": 6.0}}
    assert {r.id: r.markers for r in grid.markers(df).collect()} == {"i": ["m"], "j": []}
    wide = grid.to_wide(df, {"x": "float", "m": "marker", "none": "str"})
    assert grid.packed(wide).columns == ["id", "x", "m"]
    assert grid.selected(wide, "x,new").columns == ["x", "new"]


def test_graph(spark):
    links = spark.createDataFrame([("a", "s", "siteRef"), ("a", "e", "equipRef"), ("b", "s", "siteRef")], "from_id string, to_id string, relation string")
    assert sorted((r.from_id, r.to_id) for r in graph.without_site_edges(links).collect()) == [("a", "e"), ("b", "s")]
    assert {r.id: r.degree for r in graph.degrees(links).collect()} == {"a": 2, "b": 1, "s": 2, "e": 1}
    assert [r.to_id for r in graph.dangling(links, spark.createDataFrame([("s",)], "id string")).collect()] == ["e"]


def unmatched(left, right, tolerance):
    """How many rows of each side the largest matching leaves, by plain augmenting paths."""
    near = lambda a, b: all((p is None and q is None) or (p is not None and q is not None and (p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= tolerance))) for p, q in zip(a, b))
    taken = {}

    def place(i, seen):
        for j, b in enumerate(right):
            if j not in seen and near(left[i], b):
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    n = sum(place(i, set()) for i in range(len(left)))
    return len(left) - n, len(right) - n


def test_a_matching_is_not_stopped_by_the_nearest(spark):
    """Each nearest pair taken first would leave two rows; equal rows taken first would, too."""
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double")
    assert diff.same_rows(frame([0.0, 9e-7]), frame([4e-7, 1.5e-6])).count() == 0
    assert diff.same_rows(frame([1.0, 2.0]), frame([0.0, 1.0]), 1.0).count() == 0


def test_matchings_are_as_large_as_can_be(spark):
    rnd = random.Random(8)
    for fractions, n in ((1, 60), (2, 40), (3, 30), (9, 25)):
        grid_ = lambda: float(rnd.randint(0, 14 if fractions == 1 else 4)) / 2
        rows = lambda: [(rnd.choice(["a", "b", None]), *(rnd.choice([None, float("nan")]) if rnd.random() < 0.02 else grid_() if k < 3 else rnd.choice([0.0, 0.5]) for k in range(fractions))) for _ in range(n)]
        left, right = rows(), rows()
        schema = "k string, " + ", ".join(f"x{k} double" for k in range(fractions))
        got = diff.same_rows(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(3), 0.5).groupBy("side").count().collect()
        plain = lambda t: [tuple("nan" if x != x else x for x in r) for r in t]
        assert {r.side: r["count"] for r in got} == {s: c for s, c in zip(("left", "right"), unmatched(plain(left), plain(right), 0.5)) if c}, fractions


def test_runs_go_on_over_the_limits_of_tasks(spark):
    """One run of near values through all tasks, with one row too many on the left."""
    n = 3000
    left = spark.range(n + 1).select((F.col("id") / 10).alias("x"))
    right = spark.range(n).select((F.col("id") / 10 + 0.05).alias("x"))
    assert [r.side for r in diff.same_rows(left, right, 0.06).collect()] == ["left"]
    assert diff.same_rows(left, left.union(left), 0.0).count() == n + 1


def test_rows_with_a_cell_of_their_own_are_not_sorted(spark, monkeypatch):
    """Pairs and lone rows are settled by the grouping; only the few near a border are sorted and go to Python."""
    sorted_, grouped, n = [], matching.grouped, 20_000
    monkeypatch.setattr(matching, "grouped", lambda rows, tolerance: sorted_.append(rows.count()) or grouped(rows, tolerance))
    left = spark.range(n).select("id", (F.col("id") / 100).alias("x"))
    right = left.where("id % 7 <> 3").withColumn("x", F.when(F.col("id") % 7 == 2, F.col("x") + 0.01).otherwise(F.col("x") + 5e-7))
    got = {r.side: r["count"] for r in diff.same_rows(left, right).groupBy("side").count().collect()}
    twos, threes = sum(k % 7 == 2 for k in range(n)), sum(k % 7 == 3 for k in range(n))
    assert got == {"left": twos + threes, "right": twos}
    assert sum(sorted_) < n / 50


def test_cells_lose_no_partner(spark):
    """Values at the borders of cells, far out, not finite and in copies, and as many partners as there can be."""
    rnd, side = random.Random(3), matching.CELL
    places = [k * side + d for k in (-3, 0, 1, 700) for d in (-1.2, -0.7, -0.1, 0.0, 0.2, 0.9, 1.6, 300.0, 300.9)] + [2.0**52, 2.0**52 + 1, 1e300, -1e300, -0.0, None, float("nan"), float("inf"), float("-inf")]
    rows = lambda n: [(rnd.choice(["a", None]), rnd.choice(places)) for _ in range(n)]
    left, right = rows(150), rows(140)
    frame = lambda t: spark.createDataFrame(t, "k string, x double")
    got = diff.same_rows(frame(left), frame(right), 1.0).collect()
    plain = lambda t: [tuple("nan" if x != x else str(x) if x in (float("inf"), float("-inf")) else x for x in r) for r in t]
    assert tuple(sum(r.side == s for r in got) for s in ("left", "right")) == unmatched(plain(left), plain(right), 1.0)
    for s, t in (("left", left), ("right", right)):
        found = [str((r.k, r.x + 0.0 if r.x is not None else None)) for r in got if r.side == s]
        given = [str((k, x + 0.0 if x is not None else None)) for k, x in t]
        assert all(found.count(v) <= given.count(v) for v in found)


def test_cells_keep_the_types_of_rows(spark):
    """Lists beside decimals, floats and times without zone; rows come back as they were."""
    table = lambda t: spark.createDataFrame(t, "tags string, n string, f string, at string").selectExpr("split(tags, ' ') tags", "cast(n as decimal(20,8)) n", "cast(f as float) f", "cast(at as timestamp_ntz) at")
    left = table([("a b", "1.0", "0.5", "2020-01-01 00:00:00.000001"), ("a b", "1.0", "0.5", "2020-01-01 00:00:00.000002"), ("c", "7.0", None, None), ("c", "7.0", None, None)])
    right = table([("a b", "1.0000005", "0.5", "2020-01-01 00:00:00.000001"), ("c", "7.0000005", None, None), ("c", "8.0", None, None)])
    got = diff.same_rows(left, right)
    assert got.columns == [*right.columns, "side"] and [got.schema[c].dataType.simpleString() for c in right.columns] == [f.dataType.simpleString() for f in right.schema]
    assert sorted((r.side, r.tags, float(r.n), r.f, r["at"] and r["at"].microsecond) for r in got.collect()) == [("left", ["a", "b"], 1.0, 0.5, 2), ("left", ["c"], 7.0, None, None), ("right", ["c"], 8.0, None, None)]


def test_nested_values_are_alike(spark):
    one = lambda kind, text: spark.range(1).select(F.lit("i").alias("id"), F.create_map(F.lit("t"), kinds.value(kind, F.lit(text)).cast(kinds.TAG_VALUE)).alias("tags"))
    same = [('["n:1.000000 kW","s:a"]', '["n:1.0000005 kW","s:a"]'), ('{"a":{"b":["n:1.000000"]},"t":"t:2020-01-01T00:00:00.100000Z UTC"}', '{"a":{"b":["n:0.9999995"]},"t":"t:2020-01-01T00:00:00.900000Z UTC"}'), ('["c:1.000000,2.000000"]', '["c:1.000001,2.000000"]'), ("[]", "[]")]
    other = [('["n:1.000000"]', '["n:1.100000"]'), ('["n:1.000000 kW"]', '["n:1.000000 W"]'), ('["n:1.000000"]', '["n:1.000000","n:1.000000"]'), ('{"a":"n:1.000000"}', '{"b":"n:1.000000"}'), ('["s:x,\\"n:1"]', '["s:x,\\"n:1.0000001"]'), ('["n:1.000000"]', '["s:1.000000"]')]
    kind = lambda t: "dict" if t[0] == "{" else "list"
    assert [diff.mismatches(one(kind(a), a), one(kind(b), b)).count() for a, b in same] == [0] * len(same)
    assert [diff.mismatches(one(kind(a), a), one(kind(b), b)).count() for a, b in other] == [1] * len(other)
