"""Filters over entity tables: the tree becomes one boolean column, and one left join for each reference step.

Two forms of table are read: wide (a typed column for each tag; the kind of a tag comes from the column's type or from
`kind` in its metadata) and tag map (`tags MAP<STRING, TAG_VALUE>`). A missing tag makes every comparison false, `!=`
included; kinds that differ are unequal and have no order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filterlang as lang
from ..functions import kinds
from ..functions.filterlang import And, Compare, Has, Missing, Node, Or


def of_kind(df: DataFrame, **named: str) -> DataFrame:
    """Notes the kind of wide columns that their type does not tell (ref, uri, marker, time, coord, xstr, bin)."""
    for name, kind in named.items():
        df = df.withMetadata(name, {**(df.schema[name].metadata or {}), "kind": kind})
    return df


def column_kind(field: T.StructField) -> str:
    noted = (field.metadata or {}).get("kind")
    if noted:
        return noted
    if field.name == "id" or field.name.endswith("Ref"):
        return "ref"
    t = field.dataType
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return "datetime"
    if isinstance(t, T.StructType) and set(t.names) == {"val", "unit"}:
        return "number"
    if isinstance(t, T.MapType | T.StructType):
        return "dict"
    return "list" if isinstance(t, T.ArrayType) else "str"


def _order(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _compare_value(v: Column, op: str, x: lang.Literal) -> Column:
    """v: a TAG_VALUE."""
    if x.kind == "null":
        return v.isNull() if op == "==" else v.isNotNull()
    kind, text = v["kind"], v["str"]
    if op in ("==", "!="):
        if x.kind == "number":
            equal = (kind == "number") & (v["num"] == x.num) & v["unit"].eqNullSafe(F.lit(x.unit))
        elif x.kind == "datetime":
            equal = (kind == "datetime") & (v["ts"] == F.lit(x.stored).cast("timestamp"))
        else:
            equal = (kind == x.kind) & (text == x.stored)
        return v.isNotNull() & (F.coalesce(equal, F.lit(False)) if op == "==" else ~F.coalesce(equal, F.lit(False)))
    if x.kind == "number":
        held = _order(op, v["num"], F.lit(x.num))
    elif x.kind == "datetime":
        held = _order(op, v["ts"], F.lit(x.stored).cast("timestamp"))
    else:
        held = _order(op, text, F.lit(x.stored))
    return F.coalesce((kind == x.kind) & held, F.lit(False))


def _compare_column(c: Column, kind: str, data: T.DataType, op: str, x: lang.Literal) -> Column:
    if x.kind == "null":
        return c.isNull() if op == "==" else c.isNotNull()
    if kind != x.kind:
        return c.isNotNull() if op == "!=" else F.lit(False)
    if isinstance(data, T.StructType) and kind == "number":
        held = _order(op, c["val"], F.lit(x.num))
        if op in ("==", "!="):
            equal = (c["val"] == x.num) & c["unit"].eqNullSafe(F.lit(x.unit))
            held = equal if op == "==" else ~F.coalesce(equal, F.lit(False))
        return c.isNotNull() & F.coalesce(held, F.lit(False))
    if kind == "number":
        if x.unit and op in ("==", "!="):
            return c.isNotNull() if op == "!=" else F.lit(False)
        other = F.lit(x.num)
    elif kind == "bool":
        other = F.lit(x.stored == "true")
    elif kind in ("date", "datetime"):
        other = F.lit(x.stored).cast(data)
    elif kind == "list" and isinstance(data, T.ArrayType):
        if op not in ("==", "!="):
            return F.lit(False)
        other = F.array(*[F.lit(v) for v in plain_values(x.stored)]).cast(data)
    elif kind == "marker":
        return F.coalesce(c, F.lit(False)) if op == "==" else F.lit(False)
    elif kind == "xstr" and isinstance(data, T.BinaryType):
        other = F.unhex(F.lit(x.stored))
    else:
        other = F.lit(x.stored)
    return _order(op, c, other)  # null counts as false under and / or; the bare comparison reaches the scan


def plain_values(text: str) -> list:
    """The values of a list literal as an array column holds them: numbers, flags, and the text of everything else."""
    out = []
    for v in json.loads(text):
        if isinstance(v, str) and v[:2] == "n:":
            v = float(v[2:].split(" ")[0])
        elif isinstance(v, str):
            v = v[2:].split(" ")[0] if v[:2] == "r:" else v[2:]
        out.append(v)
    return out


class _Plan:
    """The joins and columns that a filter needs on one table."""

    def __init__(self, entities: DataFrame, targets: DataFrame, tenant: str | None):
        self.mapped = "tags" in entities.columns and isinstance(entities.schema["tags"].dataType, T.MapType)
        self.df, self.targets, self.tenant = entities, targets, tenant
        self.steps: dict[tuple[str, ...], str] = {}
        self.values: dict[tuple[str, ...], str] = {}  # tag maps: the column that holds the value at the end of a path
        self.needed: dict[tuple[str, ...], set[str]] = {}

    def need(self, paths: list[tuple[str, ...]]) -> None:
        for path in paths:
            for k in range(1, len(path)):
                self.needed.setdefault(path[:k], set()).add(path[k])

    def nested(self, prefix: tuple[str, ...]) -> bool:
        """Whether the step goes into a nested dict rather than to another entity."""
        field = self.field(prefix)
        return not self.mapped and field is not None and isinstance(field.dataType, T.MapType | T.StructType) and column_kind(field) != "ref" and "val" not in getattr(field.dataType, "names", ())

    def field(self, path: tuple[str, ...]) -> T.StructField | None:
        schema = (self.df if len(path) == 1 else self.targets).schema if len(path) <= 1 or not self.nested(path[:-1]) else None
        if schema is None:
            above = self.field(path[:-1]).dataType
            if isinstance(above, T.MapType):
                return T.StructField(path[-1], above.valueType)
            return above[path[-1]] if path[-1] in above.names else None
        return schema[path[-1]] if path[-1] in schema.names else None

    def column(self, path: tuple[str, ...]) -> Column:
        if self.mapped:
            return F.col("tags")[path[0]] if len(path) == 1 else F.col(self.values[path])
        if len(path) > 1 and self.nested(path[:-1]):
            return self.column(path[:-1])[path[-1]]
        if self.field(path) is None:
            return F.lit(None)
        return F.col(f"`{path[0]}`") if len(path) == 1 else F.col(self.steps[path[:-1]])[path[-1]]

    def join(self) -> None:
        """One left join for each distinct path prefix that is a reference.

        In tag maps whether a step goes to another entity or into a dict is each row's own: after the join every tag that is
        asked of the step becomes a column, which the next step reads by name, so plans grow by the same amount each step.
        """
        for n, prefix in enumerate(sorted(self.needed, key=lambda p: (len(p), p))):
            if self.nested(prefix):
                continue
            name = f"__step{n}"
            source = self.column(prefix)
            keys = ["customer_id"] if self.tenant is None and "customer_id" in self.targets.columns and "customer_id" in self.df.columns else []
            needed = sorted(self.needed[prefix])
            if self.mapped:
                found = self.targets.select(F.col("id").alias(f"{name}_id"), F.map_filter("tags", lambda k, v: k.isin(needed)).alias(name), *[F.col(k).alias(f"{name}_{k}") for k in keys])
                source = F.when(source["kind"] == "ref", source["str"])
            else:
                tags = [t for t in needed if t in self.targets.columns]
                found = self.targets.select(F.col("id").alias(f"{name}_id"), F.struct(F.lit(True).alias("__there"), *[F.col(f"`{t}`") for t in tags]).alias(name), *[F.col(k).alias(f"{name}_{k}") for k in keys])
            # rows without a reference would all go to one task: each gets a key of its own, which is no id's
            lone = F.xxhash64("id").cast("string") if "id" in self.df.columns else F.lit("")
            held = F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.concat(F.lit("-"), lone)) == F.concat(F.lit("+"), F.col(f"{name}_id").cast("string"))
            for k in keys:
                held = held & (F.col(k) == F.col(f"{name}_{k}"))
            self.df = self.df.join(found, held, "left").drop(f"{name}_id", *[f"{name}_{k}" for k in keys])
            self.steps[prefix] = name
            if self.mapped:
                at = self.column(prefix)
                for k, tag in enumerate(needed):
                    inside = F.when(at["kind"] == "dict", kinds.bound(F.get_json_object(at["str"], f"$.{tag}"), kinds.decode_tagged))
                    self.df = self.df.withColumn(f"{name}_{k}", F.coalesce(F.col(name)[tag], inside))
                    self.values[(*prefix, tag)] = f"{name}_{k}"
                self.df = self.df.drop(name)

    def condition(self, node: Node) -> Column:
        if isinstance(node, And):
            return self.condition(node.left) & self.condition(node.right)
        if isinstance(node, Or):
            return self.condition(node.left) | self.condition(node.right)
        c = self.column(node.path)
        if isinstance(node, Has):
            return c.isNotNull()
        if isinstance(node, Missing):
            return c.isNull()
        if self.mapped:
            compare = lambda v: _compare_value(v, node.op, node.literal)
            return compare(c) if len(node.path) == 1 else kinds.bound(c, compare)
        field = self.field(node.path)
        if field is None:
            return F.lit(node.literal.kind == "null" and node.op == "==")
        return _compare_column(c, column_kind(field), field.dataType, node.op, node.literal)


def compile_filter(text: str, entities: DataFrame) -> Column:
    """A boolean column for a filter without reference steps."""
    node = lang.parse(text)
    if node is None:
        return F.lit(True)
    plan = _Plan(entities, entities, None)
    plan.need(lang.paths(node))
    if any(not plan.nested(p) for p in plan.needed):
        raise lang.FilterError("reference paths need joins: use where()")
    return F.coalesce(plan.condition(node), F.lit(False))


def where(entities: DataFrame, text: str, limit: int = 0, targets: DataFrame | None = None, tenant: str | None = None) -> DataFrame:
    """The entities that a filter keeps, at most `limit` of them (0: all) in the order of id.

    targets: where references lead to (by default the same table). tenant: restricts both sides to one customer_id.
    References that lead nowhere make the rest of their path missing. Needs unique ids in targets.
    """
    targets = entities if targets is None else targets
    if tenant is not None:
        entities, targets = entities.where(F.col("customer_id") == tenant), targets.where(F.col("customer_id") == tenant)
    node = lang.parse(text)
    out = entities
    if node is not None:
        plan = _Plan(entities, targets, tenant)
        plan.need(lang.paths(node))
        plan.join()
        out = plan.df.where(plan.condition(node)).select(*[F.col(f"`{c}`") for c in entities.columns])
    return out.orderBy("id").limit(limit) if limit else out


def by_ids(entities: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """The entities with these ids; a table of ids joins instead of being listed."""
    if isinstance(ids, DataFrame):
        return entities.join(ids.select("id").distinct(), "id", "left_semi")
    return entities.where(F.col("id").isin(ids))
