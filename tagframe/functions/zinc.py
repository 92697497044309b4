"""Zinc, CSV, Trio and Hayson scalars as expressions: text to TAG_VALUE and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinds
from .kinds import TAG_VALUE, value

_NUMBER = r"^(-?\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)([^\d\s\"`(\[{].*)?$"
_REF = r'^@([a-zA-Z0-9_:\-.~]+)(?: "(.*)")?$'
_COORD = r"^C\(\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\)$"
_XSTR = r'^([a-zA-Z]\w*)\("(.*)"\)$'
_DATE, _TIME = r"^\d{4}-\d\d-\d\d$", r"^\d\d:\d\d(:\d\d(\.\d+)?)?$"
_DATETIME = r"^(\d{4}-\d\d-\d\dT\S+)(?: (\S+))?$"


def unescape(text: Column) -> Column:
    """\\n \\t \\" \\\\ \\uXXXX and so on; JSON's reader knows them all but \\$ and \\`."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\([$`])", "$1"), "\n", r"\\n")
    return F.when(text.contains("\\"), F.get_json_object(F.concat(F.lit('["'), plain, F.lit('"]')), "$[0]")).otherwise(text)


def escape(text: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def decode_zinc(raw: Column) -> Column:
    """A Zinc literal; empty and N are null, unreadable text is a plain string. Lists, dicts and grids keep their text, which readers make JSON first."""
    text = F.trim(raw)
    num = F.replace(F.regexp_extract(text, _NUMBER, 1), F.lit("_"), F.lit("")).try_cast("double")
    special = F.when(text == "INF", float("inf")).when(text == "-INF", float("-inf")).when(text == "NaN", float("nan"))
    inner = unescape(F.substring(text, 2, F.length(text) - 2))
    lat, lng = F.regexp_extract(text, _COORD, 1).try_cast("double"), F.regexp_extract(text, _COORD, 2).try_cast("double")
    encoding = F.lower(F.regexp_extract(text, _XSTR, 1))
    return (
        F.when(text.isNull() | text.isin("", "N"), F.lit(None).cast(TAG_VALUE))
        .when(text == "M", value("marker", F.lit("M")))
        .when(text == "R", kinds.removed())
        .when(text == "NA", value("na", F.lit("NA")))
        .when(text.isin("T", "F"), value("bool", F.when(text == "T", "true").otherwise("false"), num=(text == "T").cast("double")))
        .when(special.isNotNull(), value("number", text, special))
        .when(text.rlike(r'^".*"$') | text.rlike(r'(?s)^"[^"]*"$'), value("str", inner))
        .when(text.rlike("^`.*`$"), value("uri", inner))
        .when(text.rlike(_REF), value("ref", _part(text, _REF, 1), dis=unescape(_part(text, _REF, 2))))
        .when(text.rlike(_DATE), value("date", text))
        .when(text.rlike(_TIME), value("time", kinds.iso_time(text)))
        .when(text.rlike(_DATETIME), kinds.datetime_text(_part(text, _DATETIME, 1), _part(text, _DATETIME, 2)))
        .when(text.rlike(_COORD), value("coord", kinds.coord_text(lat, lng)))
        .when(text.rlike(_XSTR) & encoding.isin("hex", "b64"), value("xstr", kinds.hex_of_xstr(encoding, F.regexp_extract(text, _XSTR, 2)), unit=encoding))
        .when(text.rlike(_XSTR) & (encoding == "bin"), value("bin", F.regexp_extract(text, _XSTR, 2)))
        .when(num.isNotNull(), kinds.number(num, _part(text, _NUMBER, 2)))
        .when(text.startswith("["), value("list", text))
        .when(text.rlike(kinds.GRID_JSON), value("grid", text))
        .when(text.startswith("{"), value("dict", text))
        .otherwise(value("str", text))
    )


def _iso(v: Column) -> Column:
    return F.date_format(v["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def encode_zinc(v: Column) -> Column:
    """A TAG_VALUE as a Zinc literal; null as N."""
    kind, text = v["kind"], v["str"]
    quoted = lambda c: F.concat(F.lit('"'), escape(c), F.lit('"'))
    out = F.when(v.isNull(), "N").when(kind == "bool", F.when(text == "true", "T").otherwise("F"))
    out = out.when(kind == "number", F.concat(kinds.number_text(v["num"]), F.coalesce(v["unit"], F.lit(""))))
    out = out.when(kind == "str", quoted(text)).when(kind == "uri", F.concat(F.lit("`"), text, F.lit("`")))
    out = out.when(kind == "ref", F.concat(F.lit("@"), text, F.coalesce(F.concat(F.lit(" "), quoted(v["dis"])), F.lit(""))))
    out = out.when(kind == "datetime", F.concat(_iso(v), F.lit(" "), F.coalesce(v["tz"], F.lit("UTC"))))
    out = out.when(kind == "coord", F.concat(F.lit("C("), text, F.lit(")"))).when(kind == "xstr", F.concat(F.lit('hex("'), F.lower(text), F.lit('")')))
    return out.when(kind == "bin", F.concat(F.lit('Bin("'), text, F.lit('")'))).otherwise(text)


def decode_csv(cell: Column) -> Column:
    """A CSV cell: empty is null, ✓ a marker, true and false, @ref and its display text, else a Zinc literal or plain text."""
    return (
        F.when(cell.isNull() | (cell == ""), F.lit(None).cast(TAG_VALUE))
        .when(cell == "✓", value("marker", F.lit("M")))
        .when(cell.isin("true", "false"), value("bool", cell, num=(cell == "true").cast("double")))
        .when(cell.startswith("@"), value("ref", F.regexp_extract(cell, r"^@(\S+)", 1), dis=_part(cell, r"^@\S+ (.*)$", 1)))
        .otherwise(decode_zinc(cell))
    )


def encode_csv(v: Column) -> Column:
    kind = v["kind"]
    out = F.when(v.isNull(), "").when(kind == "marker", "✓").when(kind == "bool", v["str"])
    out = out.when(kind == "ref", F.concat(F.lit("@"), v["str"], F.coalesce(F.concat(F.lit(" "), v["dis"]), F.lit(""))))
    # text that could be read as something else is quoted
    plain = ~v["str"].rlike(r'^$|^[\s"`@\[{<✓\d-]|\s$|^(M|N|R|NA|T|F|INF|NaN|true|false)$|^\w+\(')
    return out.when((kind == "str") & plain, v["str"]).otherwise(encode_zinc(v))


def decode_hayson(json: Column) -> Column:
    """JSON text of one value: a bare scalar, an array, an object, or an object with `_kind`."""
    get = lambda k: F.when(json.contains("_kind"), F.get_json_object(json, f"$.{k}"))
    fields = F.struct(json.alias("json"), F.lower(get("_kind")).alias("kind"), get("val").alias("val"))
    return kinds.bound(fields, _hayson)


def _hayson(fields: Column) -> Column:
    json, kind, val = fields["json"], fields["kind"], fields["val"]
    get = lambda k: F.get_json_object(json, f"$.{k}")
    special = F.when(val == "INF", float("inf")).when(val == "-INF", float("-inf")).when(val == "NaN", float("nan"))
    num = F.coalesce(special, val.try_cast("double"))
    encoding = F.lower(get("type"))
    return (
        F.when(json.isNull() | (json == "null"), F.lit(None).cast(TAG_VALUE))
        .when(json.rlike(kinds.GRID_JSON), value("grid", json))
        .when(json.startswith("{") & kind.isNull(), value("dict", json))
        .when(json.startswith("["), value("list", json))
        .when(kind == "marker", value("marker", F.lit("M")))
        .when(kind == "na", value("na", F.lit("NA")))
        .when(kind == "remove", kinds.removed())
        .when(kind.isin("number", "num"), kinds.number(num, get("unit")))
        .when(kind == "ref", value("ref", val, dis=get("dis")))
        .when(kind == "date", value("date", val))
        .when(kind == "time", value("time", kinds.iso_time(val)))
        .when(kind == "datetime", kinds.datetime_text(val, get("tz")))
        .when(kind == "uri", value("uri", val))
        .when(kind == "bin", value("bin", val))
        .when(kind == "xstr", value("xstr", kinds.hex_of_xstr(encoding, val), unit=encoding))
        .when(kind == "coord", value("coord", kinds.coord_text(get("lat").try_cast("double"), get("lng").try_cast("double"))))
        .when(json.isin("true", "false"), value("bool", json, num=(json == "true").cast("double")))
        .when(json.startswith('"'), value("str", F.get_json_object(F.concat(F.lit("["), json, F.lit("]")), "$[0]")))
        .when(json.try_cast("double").isNotNull(), kinds.number(json.try_cast("double")))
        .otherwise(value("str", json))
    )


def encode_hayson(v: Column) -> Column:
    """A TAG_VALUE as Hayson text."""
    kind, text = v["kind"], v["str"]
    quoted = lambda c: F.concat(F.lit('"'), escape(c), F.lit('"'))

    def one(name: str, *fields: tuple[str, Column]) -> Column:
        more = [F.coalesce(F.concat(F.lit(f',"{k}":'), c), F.lit("")) for k, c in fields]
        return F.concat(F.lit(f'{{"_kind":"{name}"'), *more, F.lit("}"))

    finite = ~F.isnan(v["num"]) & (F.abs(v["num"]) != float("inf"))
    out = F.when(v.isNull(), "null").when(kind == "marker", one("Marker")).when(kind == "na", one("NA")).when(kind == "remove", one("Remove"))
    out = out.when(kind.isin("bool", "list", "dict", "grid"), text).when(kind == "str", quoted(text))
    out = out.when(kind == "number", one("Num", ("val", F.when(finite, v["num"].cast("string")).otherwise(quoted(kinds.number_text(v["num"])))), ("unit", quoted(v["unit"]))))
    out = out.when(kind == "ref", one("Ref", ("val", quoted(text)), ("dis", quoted(v["dis"])))).when(kind == "datetime", one("DateTime", ("val", quoted(_iso(v))), ("tz", quoted(v["tz"]))))
    out = out.when(kind == "coord", one("Coord", ("lat", F.split(text, ",")[0]), ("lng", F.split(text, ",")[1]))).when(kind == "xstr", one("XStr", ("type", F.lit('"hex"')), ("val", quoted(F.lower(text)))))
    for k, name in (("date", "Date"), ("time", "Time"), ("uri", "Uri"), ("bin", "Bin")):
        out = out.when(kind == k, one(name, ("val", quoted(text))))
    return out
