import random

import pytest
from pyspark.sql import functions as F

from tagframe.functions import filterlang as lang
from tagframe.functions import kinds
from tagframe.operators import filters, grid

ROWS = [
    ("@site", None, True, None, "X", "75001", "Paris", None, None),
    ("@ahu", "@site", None, True, None, None, None, 0.0, "kW"),
    ("@vav", "@ahu", None, None, None, None, None, 20.5, "kW"),
    ("@lost", "@nowhere", None, None, None, None, None, -3.0, None),
]


@pytest.fixture(scope="module")
def entities(spark):
    df = spark.createDataFrame(ROWS, "id string, siteRef string, site boolean, ahu boolean, equip string, zip string, geoCity string, curVal double, u string")
    df = df.withColumns({c: F.regexp_replace(c, "^@", "") for c in ("id", "siteRef")})
    return filters.of_kind(df, site="marker", ahu="marker")


def both(entities):
    tags = grid.to_tags(entities.drop("u"), values={"curVal": kinds.number(F.col("curVal"))})
    return [entities, tags]


CASES = [
    ("site", {"site"}),
    ("not site", {"ahu", "vav", "lost"}),
    ('geoCity == "Paris"', {"site"}),
    ('geoCity != "Paris"', set()),
    ("curVal == 0", {"ahu"}),
    ("curVal != 0", {"vav", "lost"}),
    ("curVal > 0", {"vav"}),
    ("curVal <= 0", {"ahu", "lost"}),
    ("curVal >= -3 and curVal < 20.5", {"ahu", "lost"}),
    ('siteRef->geoCity == "Paris"', {"ahu"}),
    ('siteRef->siteRef->geoCity == "Paris"', {"vav"}),
    ("siteRef->geoCity", {"ahu"}),
    ("not siteRef->geoCity", {"site", "vav", "lost"}),
    ("siteRef == @ahu", {"vav"}),
    ("siteRef != @ahu", {"ahu", "lost"}),
    ("site or ahu and curVal > 0", {"site"}),
    ("(site or ahu) and not curVal", {"site"}),
    ("not site and not ahu", {"vav", "lost"}),
    ("siteRef->site or geoCity", {"site", "ahu"}),
    ("zip == 75001", set()),
    ("zip != 75001", {"site"}),
    ('curVal == "x"', set()),
    ('curVal != "x"', {"ahu", "vav", "lost"}),
    ('curVal < "x"', set()),
    ("equip == N", {"ahu", "vav", "lost"}),
    ("equip != N", {"site"}),
    ("site == M", {"site"}),
    ("missing", set()),
    ("not missing", {"site", "ahu", "vav", "lost"}),
    ("missing == 3 or missing != 3", set()),
    ("", {"site", "ahu", "vav", "lost"}),
]


@pytest.mark.parametrize(("text", "ids"), CASES)
def test_where_in_both_forms(entities, text, ids):
    for df in both(entities):
        assert {r.id for r in filters.where(df, text).collect()} == ids, (text, df.columns)


def test_plans_of_tag_map_paths_grow_by_the_same_amount_each_step(entities):
    tags = both(entities)[1]
    sizes = [len(filters.where(tags, "siteRef->" * k + 'geoCity == "Paris"')._jdf.queryExecution().analyzed().toString()) for k in range(1, 6)]
    steps = [b - a for a, b in zip(sizes, sizes[1:], strict=False)]
    assert max(steps) < 1.2 * min(steps) and max(sizes) < 200_000, sizes


def test_paths_through_dicts_and_references_in_turn(spark):
    text = kinds.string
    rows = spark.createDataFrame([("a", "b", '{"x":{"y":"s:deep","r":"r:b"},"n":"n:2.000000 kW"}'), ("b", None, None), ("c", "a", '["s:x"]')], "id string, to string, d string")
    tags = F.map_filter(F.create_map(F.lit("toRef"), kinds.ref(F.col("to")), F.lit("d"), F.when(F.col("d").startswith("["), kinds.value("list", F.col("d"))).otherwise(kinds.value("dict", F.col("d"))), F.lit("dis"), text(F.concat(F.lit("name "), "id"))), lambda k, v: v["str"].isNotNull())
    df = rows.select("id", tags.cast(kinds.TAGS).alias("tags"))
    for filter_text, ids in [('d->x->y == "deep"', {"a"}), ('d->x->r->dis == "name b"', {"a"}), ('toRef->d->x->r->dis == "name b"', {"c"}), ("d->n == 2kW", {"a"}), ("d->n > 1 and not d->x->z", {"a"}), ("toRef->d->n >= 2", {"c"}), ("not d->x->y", {"b", "c"})]:
        assert {r.id for r in filters.where(df, filter_text).collect()} == ids, filter_text


def test_limit_and_tenant(spark, entities):
    assert [r.id for r in filters.where(entities, "curVal", limit=2).collect()] == ["ahu", "lost"]
    df = entities.withColumn("customer_id", F.lit("a")).unionByName(entities.withColumn("customer_id", F.lit("b")).withColumn("geoCity", F.lit("Lyon")))
    got = filters.where(df, 'siteRef->geoCity == "Lyon"', tenant="b").collect()
    assert {(r.customer_id, r.id) for r in got} == {("b", "ahu"), ("b", "vav")}
    assert {(r.customer_id, r.id) for r in filters.where(df, 'siteRef->geoCity == "Paris"').collect()} == {("a", "ahu")}


def test_nested_dicts_and_quantities(spark):
    df = spark.createDataFrame([(1, {"a": 5.0}, (3.0, "kW")), (2, {"b": 1.0}, (3.0, "W"))], "id int, d map<string,double>, q struct<val:double,unit:string>")
    assert {r.id for r in filters.where(df, "d->a == 5").collect()} == {1}
    assert {r.id for r in filters.where(df, "not d->a").collect()} == {2}
    assert {r.id for r in filters.where(df, "q == 3kW").collect()} == {1}
    assert {r.id for r in filters.where(df, "q != 3kW").collect()} == {2}
    assert {r.id for r in filters.where(df, "q >= 3").collect()} == {1, 2}
    assert df.where(filters.compile_filter("d->a", df)).count() == 1


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("a == 1", "number", 1.0), ("a == -1.5e3", "number", -1500.0), ("a == 50°F", "number", 50.0), ('a == "x\\"y\\u00e9"', "str", 'x"yé'), ("a == `http://x`", "uri", "http://x"), ("a == @p:x.y-z", "ref", "p:x.y-z"),
        ("a == 2021-02-03", "date", "2021-02-03"), ("a == 10:20", "time", "10:20:00"), ("a == 2021-02-03T10:20:30Z UTC", "datetime", "2021-02-03T10:20:30Z"), ("a == C(1.5,-2)", "coord", "1.500000,-2.000000"), ('a == hex("dead")', "xstr", "DEAD"), ('a == b64("3q0=")', "xstr", "DEAD"),
        ("a == true", "bool", "true"), ("a == F", "bool", "false"), ("a == M", "marker", "M"), ("a == NA", "na", "NA"), ("a == [1,2]", "list", "[1,2]"),
    ],
)
def test_literals(text, kind, value):
    got = lang.parse(text).literal
    assert got.kind == kind and (got.num if kind == "number" else got.text) == value


@pytest.mark.parametrize("text", ["a ==", "(a", "a)", "a b", "not (a)", "a -> ", "== 3", "a == b", "a and", "$x"])
def test_errors(text):
    with pytest.raises(lang.FilterError):
        lang.parse(text)


def test_and_binds_tighter_and_left():
    assert lang.parse("a or b and c") == lang.Or(lang.Has(("a",)), lang.And(lang.Has(("b",)), lang.Has(("c",))))
    assert lang.parse("a and b and c") == lang.And(lang.And(lang.Has(("a",)), lang.Has(("b",))), lang.Has(("c",)))


def interpret(node, row, table):
    """Plain meaning of a filter on dictionaries."""
    if isinstance(node, lang.And | lang.Or):
        a, b = interpret(node.left, row, table), interpret(node.right, row, table)
        return (a and b) if isinstance(node, lang.And) else (a or b)
    at, value = row, None
    for k, name in enumerate(node.path):
        value = at.get(name) if at else None
        at = table.get(value) if k < len(node.path) - 1 else at
        if value is None:
            break
    if isinstance(node, lang.Has):
        return value is not None
    if isinstance(node, lang.Missing):
        return value is None
    if value is None:
        return False
    x = node.literal.num if node.literal.kind == "number" else node.literal.text
    kind = "number" if isinstance(value, float) else "ref" if node.path[-1] == "ref" else "str"
    if kind != node.literal.kind:
        return node.op == "!="
    return {"==": value == x, "!=": value != x, "<": value < x, "<=": value <= x, ">": value > x, ">=": value >= x}[node.op]


def test_random_filters_against_an_interpreter(spark):
    rnd = random.Random(6)
    rows = [{"id": f"i{k}", "a": rnd.choice([None, 1.0, 2.0, 3.0]), "s": rnd.choice([None, "x", "y"]), "ref": rnd.choice([None, "i0", "i1", "i7", "gone"])} for k in range(12)]
    df = filters.of_kind(spark.createDataFrame([tuple(r.values()) for r in rows], "id string, a double, s string, ref string"), ref="ref")
    table = {r["id"]: r for r in rows}

    def term():
        path = "->".join(["ref"] * rnd.choice([0, 0, 1, 2]) + [rnd.choice(["a", "s", "ref"])])
        if rnd.random() < 0.4:
            return rnd.choice(["", "not "]) + path
        return f"{path} {rnd.choice(['==', '!=', '<', '>='])} {rnd.choice(['1', '2', chr(34) + 'x' + chr(34), '@i1'])}"

    texts = [f"{term()} {rnd.choice(['and', 'or'])} ({term()} {rnd.choice(['and', 'or'])} {term()})" for _ in range(12)]
    for text in texts:
        node = lang.parse(text)
        assert {r.id for r in filters.where(df, text).collect()} == {r["id"] for r in rows if interpret(node, r, table)}, text


def test_rows_without_a_reference_are_spread_over_tasks(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    for name, value in zip(names, ("-1", "false"), strict=True):
        spark.conf.set(name, value)
    try:
        held = F.concat(F.lit('{"k":"n:'), F.col("id").cast("string"), F.lit('.000000"}'))
        rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.create_map(F.lit("props"), kinds.value("dict", held)).cast(kinds.TAGS).alias("tags"))
        sizes = filters.where(rows, "props->k >= 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sum(r["count"] for r in sizes) == 400 and max(r["count"] for r in sizes) < 200
