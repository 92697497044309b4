"""Nested Zinc literals (lists, dicts, grids) as JSON whose scalars are tagged texts, as the other formats have them.

`[1kW, "a"]` is `["n:1.000000 kW","s:a"]`, `{a b:2}` is `{"a":"m:","b":"n:2.000000"}`, and a grid is an object with meta,
cols and rows. Keys of dicts are in order and there is no white space, so equal values have equal texts.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import re

_OPEN, _CLOSE = {"[": "]", "{": "}", "<<": ">>", "(": ")"}, {"]", "}", ">>", ")"}
_PART = re.compile(r'"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`|<<|>>|[\[\](){},\n]|[^"`\[\](){},<>\n]+|.', re.S)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_NUMBER = re.compile(r"(-?\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)([^\d\s].*)?$", re.S)
_COORD = re.compile(r"C\(\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\)$")
_CALL = re.compile(r'([a-zA-Z]\w*)\("(.*)"\)$', re.S)
#: One-word literals.
_WORDS = {"M": "m:", "NA": "z:", "R": "-:", "INF": "n:INF", "-INF": "n:-INF", "NaN": "n:NaN"}


def split(text: str, at: str) -> list[str]:
    """A text at the marks (, or a line's end) that lie in no quotes and no brackets."""
    out, depth, now = [], 0, []
    for part in _PART.findall(text):
        if part == at and depth <= 0:
            out.append("".join(now))
            now = []
            continue
        depth += (part in _OPEN) - (part in _CLOSE)
        now.append(part)
    return [*out, "".join(now)]


def end_of(text: str, start: int) -> int:
    """Where the nested literal that begins at start ends."""
    depth, at = 0, start
    for m in _PART.finditer(text, start):
        depth += (m[0] in _OPEN) - (m[0] in _CLOSE)
        at = m.end()
        if depth <= 0:
            break
    return at


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text)


def _moment(text: str) -> str | None:
    when, _, zone = text.partition(" ")
    try:
        at = dt.datetime.fromisoformat(when)
    except ValueError:
        return None
    at = at.astimezone(dt.timezone.utc) if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return f"t:{at:%Y-%m-%dT%H:%M:%S.%f}Z" + (f" {zone}" if zone else "")


def tagged(text: str) -> object:
    """What a literal is in JSON; nested ones by what they hold."""
    text = text.strip()
    if text in ("", "N"):
        return None
    if text in ("T", "F", "true", "false"):
        return text in ("T", "true")
    if text in _WORDS:
        return _WORDS[text]
    if text[0] == "[" and text[-1] == "]":
        items = split(text[1:-1].strip().rstrip(","), ",")
        return [tagged(x) for x in items] if items != [""] else []
    if text[0] == "{" and text[-1] == "}":
        return dict(sorted(pairs(text[1:-1]).items()))
    if text.startswith("<<") and text.endswith(">>"):
        return grid(text[2:-2])
    if text[0] == '"':
        return f"s:{unescape(text[1:-1])}"
    if text[0] == "`":
        return f"u:{unescape(text[1:-1])}"
    if text[0] == "@":
        name, _, dis = text[1:].partition(" ")
        return f"r:{name}" + (f" {unescape(dis.strip()[1:-1])}" if dis.strip() else "")
    if re.match(r"\d{4}-\d\d-\d\dT", text) and (found := _moment(text)):
        return found
    if re.match(r"\d{4}-\d\d-\d\d$", text):
        return f"d:{text}"
    if re.match(r"\d\d:\d\d(:\d\d(\.\d+)?)?$", text):
        return f"h:{text}" if text.count(":") == 2 else f"h:{text}:00"
    if m := _COORD.match(text):
        return f"c:{float(m[1]):.6f},{float(m[2]):.6f}"
    if m := _CALL.match(text):
        kind = m[1].lower()
        if kind in ("hex", "b64"):
            return f"x:hex:{m[2].lower() if kind == 'hex' else base64.b64decode(m[2]).hex()}"
        return f"b:{m[2]}" if kind == "bin" else f"s:{text}"
    if m := _NUMBER.match(text):
        return f"n:{float(m[1].replace('_', '')):.6f}" + (f" {m[2].strip()}" if m[2] else "")
    return f"s:{text}"


def pairs(text: str) -> dict[str, object]:
    """`a b:2, c:"x"` as a dict: names alone are markers; commas are allowed."""
    out, at = {}, 0
    name = re.compile(r"[\s,]*([a-zA-Z_]\w*)(\s*:)?")
    while m := name.match(text, at):
        at = m.end()
        if not m[2]:
            out[m[1]] = "m:"
            continue
        while at < len(text) and text[at].isspace():
            at += 1
        start, depth = at, 0
        for part in _PART.finditer(text, at):
            if depth <= 0 and part[0] == ",":
                break
            depth += (part[0] in _OPEN) - (part[0] in _CLOSE)
            # without commas a value ends at the blank before the next name, unless that is a ref's or a time's
            cut = re.search(r"\s(?=[a-zA-Z_]\w*\s*(?::|$))", part[0]) if depth <= 0 and part[0][0] not in '"`' and not text[start:].startswith(("@", '"', "`")) else None
            at = part.start() + cut.start() if cut else part.end()
            if cut or depth <= 0 and part[0] in (*_CLOSE,):
                break
            if depth <= 0 and text[start] in '"`':
                break
        value = text[start:at].strip()
        if value.startswith("@") and (r := re.match(r'@[a-zA-Z0-9_:\-.~]+(?: "(?:[^"\\]|\\.)*")?', text[start:])):
            value, at = r[0], start + r.end()
        out[m[1]] = tagged(value)
    return out


def grid(text: str) -> dict[str, object]:
    """A grid as {meta, cols, rows}; metadata of columns stand beside their names."""
    lines = [x for x in split(text.replace("\r\n", "\n").strip("\n"), "\n") if x.strip()]
    meta, columns = header(lines)
    rows = [{c["name"]: v for c, x in zip(columns, split(line, ","), strict=False) if (v := tagged(x)) is not None} for line in lines[2:]]
    return {"meta": meta, "cols": columns, "rows": rows}


def header(lines: list[str]) -> tuple[dict[str, object], list[dict[str, object]]]:
    """Metadata and columns from the first two lines of a grid."""
    meta = pairs(lines[0]) if lines else {}
    meta = {k: v[2:] if k == "ver" and isinstance(v, str) else v for k, v in meta.items()}
    columns = []
    for column in split(lines[1], ",") if len(lines) > 1 else []:
        name, _, more = column.strip().partition(" ")
        columns.append({"name": name, **pairs(more)})
    return meta, columns


def nested_json(text: str) -> str:
    """The JSON of a nested literal."""
    return json.dumps(tagged(text), ensure_ascii=False, separators=(",", ":"))


def grids(text: str) -> list[tuple[dict, list[dict], list[list[str]]]]:
    """(metadata, columns, cells of each row) of all grids of a text; blank lines stand between grids."""
    out, head = [], []
    for line in split(text.replace("\r\n", "\n"), "\n"):
        if not line.strip():
            head = []
        elif len(head) < 2:
            head.append(line)
            if len(head) == 2:
                out.append((*header(head), []))
        else:
            out[-1][2].append([nested_json(c) if c.lstrip()[:1] in ("[", "{", "<") else c for c in split(line, ",")])
    return out


def trio_lines(text: str) -> str:
    """A Trio text with each `tag: Zinc:` block, and each nested literal, as JSON in one line."""
    out, lines, at = [], text.replace("\r\n", "\n").split("\n"), 0
    while at < len(lines):
        line, at = lines[at], at + 1
        name, colon, rest = line.partition(":")
        rest = rest.strip()
        if colon and rest == "Zinc:" and not line[:1].isspace():
            block = []
            while at < len(lines) and (lines[at][:1].isspace() or not lines[at].strip() and at + 1 < len(lines) and lines[at + 1][:1].isspace()):
                block.append(lines[at].strip())
                at += 1
            line = f"{name}: {json.dumps(grid(chr(10).join(block)), ensure_ascii=False, separators=(',', ':'))}"
        elif colon and rest[:1] in ("[", "{", "<") and end_of(rest, 0) == len(rest):
            line = f"{name}: {nested_json(rest)}"
        out.append(line)
    return "\n".join(out)


def literal(value: object) -> str:
    """The Zinc literal of JSON as above."""
    if value is None:
        return "N"
    if isinstance(value, bool):
        return "T" if value else "F"
    if isinstance(value, list):
        return f"[{','.join(map(literal, value))}]"
    if isinstance(value, dict):
        if "rows" in value and "cols" in value:
            marks = lambda d: "".join(f" {k}" if v == "m:" else f" {k}:{literal(v)}" for k, v in d.items())
            meta = {k: v for k, v in value.get("meta", {}).items() if k != "ver"}
            lines = [f'ver:"{value.get("meta", {}).get("ver", "3.0")}"{marks(meta)}', ",".join(c["name"] + marks({k: v for k, v in c.items() if k != "name"}) for c in value["cols"])]
            lines += [",".join(literal(row[c["name"]]) if c["name"] in row else "" for c in value["cols"]) for row in value["rows"]]
            return "<<\n" + "\n".join(lines) + "\n>>"
        return f"{{{','.join(k if v == 'm:' else f'{k}:{literal(v)}' for k, v in value.items())}}}"
    kind, text = value[:2], value[2:]
    if value in ("m:", "z:", "-:"):
        return {"m:": "M", "z:": "NA", "-:": "R"}[value]
    quoted = lambda t: json.dumps(t, ensure_ascii=False).replace("$", "\\$")
    if kind == "n:":
        return text.replace(" ", "", 1)
    if kind == "r:":
        name, _, dis = text.partition(" ")
        return f"@{name}" + (f" {quoted(dis)}" if dis else "")
    if kind == "x:":
        return f'hex("{text.partition(":")[2]}")'
    return {"u:": f"`{text}`", "d:": text, "h:": text, "t:": text, "c:": f"C({text})", "b:": f'Bin("{text}")'}.get(kind) or quoted(text if kind == "s:" else value)


def zinc_literals(texts: list[str | None]) -> list[str | None]:
    return [None if t is None else literal(json.loads(t)) for t in texts]
