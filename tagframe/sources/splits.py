"""Text files of records that go over lines, read by many tasks each.

Spark deals a large file to tasks in blocks, by lines; but a line may lie inside a quoted text or a nested grid, and a
block in the middle of a file lacks the header of its grid. For files of more than one block two passes find out what a
block needs to know. The first gives what a block does to the state of the lexer, for each state that it may begin in;
along a file this makes the state at the start of every block. The second, with that state, gives the first and last
records of a block; along a file this makes the header in force at the start of every block, and the record that the block
before left open. Both give one small row for each block. Then every block gives out the records that end in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested

BOM = "﻿"
State = tuple[str, int]  # the quote that is open, and how many brackets are


class Lexer:
    """Where records end. heads: how many records make a header; grids: whether a blank record begins a new one."""

    heads, grids = 0, False
    quotes: tuple[str, ...] = ("",)

    def after(self, line: str, state: State) -> State:
        """The state behind a line that begins in a state."""
        raise NotImplementedError

    def ends(self, line: str, state: State) -> bool:
        """Whether a record ends with a line that leaves a state."""
        return not state[0] and state[1] <= 0


class Csv(Lexer):
    heads, quotes = 1, ("", '"')
    _close = re.compile(r'(?:[^"]|"")*"(?!")')

    def after(self, line: str, state: State) -> State:
        at, inside = 0, bool(state[0])
        while True:
            if inside:
                m = self._close.match(line, at)
                if not m:
                    return '"', 0
                at, inside = m.end(), False
            elif line[at : at + 1] == '"':
                at, inside = at + 1, True
                continue
            at = line.find(",", at) + 1
            if not at:
                return "", 0


class Zinc(Lexer):
    heads, grids, quotes = 2, True, ("", '"', "`")
    _part = re.compile(r'"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`|<<|>>|[\[\](){}"`]|[^"`\[\](){}<>]+|.', re.S)
    _close = {q: re.compile(rf"(?:[^{q}\\]|\\.)*{q}", re.S) for q in '"`'}
    _step = {**dict.fromkeys(("[", "{", "<<", "("), 1), **dict.fromkeys(("]", "}", ">>", ")"), -1)}

    def after(self, line: str, state: State) -> State:
        (quote, depth), at, line = state, 0, line + "\n"
        if quote:
            m = self._close[quote].match(line)
            if not m:
                return state
            at = m.end()
        for m in self._part.finditer(line, at):
            if m[0] in ('"', "`"):  # a text that does not end in this line
                return m[0], depth
            depth += self._step.get(m[0], 0)
        return "", depth


class Trio(Lexer):
    """Records end at a line of dashes, which belongs to none."""

    _dashes = re.compile(r"-+\s*$")

    def after(self, line: str, state: State) -> State:
        return state

    def ends(self, line: str, state: State) -> bool:
        return bool(self._dashes.match(line))


LEXERS = {"csv": Csv(), "zinc": Zinc(), "trio": Trio()}


@dataclass
class _Block:
    file: str
    start: int
    last: bool
    info: dict
    state: State = ("", 0)


_LINES = ("file", "start", "last", "value")


def _blocks(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[_Block, bool, list[str]]]:
    """The lines of blocks as they come, in runs of one block: (block, whether the run is its first, lines)."""
    block, again = None, None
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("file", "start", "last", *more)]
        lines, at = batch["value"].to_pylist(), 0
        while at < len(lines):
            key = (columns[0][at], columns[1][at])
            end = at + 1
            while end < len(lines) and columns[1][end] == key[1] and columns[0][end] == key[0]:
                end += 1
            fresh = key != again
            if fresh:
                block, again = _Block(*key, columns[2][at], dict(zip(more, (c[at] for c in columns[3:]), strict=True))), key
            yield block, fresh, [(x or "").removesuffix("\r") for x in lines[at:end]]
            at = end


def _bare(block: _Block, fresh: bool, lines: list[str]) -> list[str]:
    """A file's first line without its mark of the byte order."""
    return [lines[0].removeprefix(BOM), *lines[1:]] if fresh and block.start == 0 and lines else lines


_MOVES = "file string, start bigint, quote string, to_quote string, depth int"


def _moves(lexer: Lexer):
    """What each block does to the state, for each quote that may be open at its start."""

    def rows(block: _Block, states: dict[str, State]) -> list[tuple]:
        return [(block.file, block.start, q, *s) for q, s in states.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, block, states = [c.split()[0] for c in _MOVES.split(", ")], [], None, {}
        for now, fresh, lines in _blocks(batches):
            if fresh:
                out += rows(block, states) if block else []
                block, states = now, {q: (q, 0) for q in lexer.quotes}
            for line in _bare(now, fresh, lines):
                states = {q: lexer.after(line, s) for q, s in states.items()}
        out += rows(block, states) if block else []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()))], names)

    return run


_STATES = "file string, start bigint, quote string, depth int"


def _states(key: tuple, moves: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each block of one file."""
    out, state = [], ("", 0)
    for start, rows in moves.sort_values("start").groupby("start"):
        out.append((key[0], start, *state))
        move = rows[rows["quote"] == state[0]].iloc[0]
        state = (move["to_quote"], state[1] + int(move["depth"]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STATES.split(", ")])


_ENDS = "file string, start bigint, ended boolean, blank boolean, firsts array<string>, head array<string>, tail array<string>"


def _ends(lexer: Lexer):
    """The records of each block that a later block may need: its first ones, the header after its last blank record, and the open one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ENDS.split(", ")]
        strings, out, found = pa.list_(pa.string()), [], None

        for block, fresh, lines in _blocks(batches, ("quote", "depth")):
            if fresh:
                block.state = (block.info["quote"] or "", block.info["depth"] or 0)
                found = {"file": block.file, "start": block.start, "ended": False, "blank": False, "firsts": [], "head": [], "tail": []}
                out.append(found)
            for line in _bare(block, fresh, lines):
                block.state = lexer.after(line, block.state)
                found["tail"].append(line)
                if lexer.ends(line, block.state):
                    record, found["tail"] = "\n".join(found["tail"]), []
                    if lexer.grids and not record.strip() and found["ended"]:
                        found["blank"], found["head"] = True, []
                    elif found["blank"] and len(found["head"]) < lexer.heads:
                        found["head"].append(record)
                    elif not found["blank"] and len(found["firsts"]) <= lexer.heads:
                        found["firsts"].append(record)
                    found["ended"] = True
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), strings, strings, strings)
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, kinds, strict=True)], names)

    return run


_NEEDS = "file string, start bigint, quote string, depth int, header array<string>, open array<string>"


def _needs(lexer: Lexer):
    def run(key: tuple, ends: pd.DataFrame) -> pd.DataFrame:
        """The header in force at the start of each block of one file, and the lines of the record that is open there."""
        out, header, left = [], [], []
        for r in ends.sort_values("start").itertuples():
            out.append((r.file, r.start, r.quote, r.depth, list(header), list(left)))
            if not r.ended:
                left = [*left, *r.tail]
                continue
            firsts = list(r.firsts)
            if firsts and left:
                firsts[0] = "\n".join([*left, firsts[0]])
            for record in firsts:
                if lexer.grids and not record.strip():
                    header = []
                elif record.strip() and len(header) < lexer.heads:
                    header = [*header, record]
            header = list(r.head) if r.blank else header
            left = list(r.tail)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _NEEDS.split(", ")])

    return run


_RECORDS = "file string, header array<string>, record string"


def _records(lexer: Lexer):
    """The records that end in each block, with the header in force; the last block of a file also gives what is left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, header, left, out = None, [], [], []

        def closed(record: str) -> None:
            nonlocal header
            if not record.strip():
                header = [] if lexer.grids else header
            elif len(header) < lexer.heads:
                header = [*header, record]
            else:
                out.append((block.file, header, record))

        for now, fresh, lines in _blocks(batches, ("quote", "depth", "header", "open")):
            if fresh:
                if block is not None and block.last and left:
                    closed("\n".join(left))
                block = now
                block.state = (block.info["quote"] or "", block.info["depth"] or 0)
                header, left = list(block.info["header"] or []), list(block.info["open"] or [])
            for line in _bare(block, fresh, lines):
                block.state = lexer.after(line, block.state)
                if lexer.heads or not lexer.ends(line, block.state):
                    left.append(line)
                if lexer.ends(line, block.state):
                    closed("\n".join(left))
                    left = []
            if len(out) >= 10_000:
                yield _rows(out)
                out.clear()
        if block is not None and block.last and left:
            closed("\n".join(left))
        yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.list_(pa.string()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["file", "header", "record"])


def records(spark: SparkSession, path: str, name: str, kept: Column | None = None) -> DataFrame:
    """(file, header, record) of all files below a path for which `kept` (of the path `file`) holds, in a format of LEXERS.

    header has the records that head the grid that a record is in; blank records and headers are left out. Files that are
    one block (small, or compressed) are read once. The rows for blocks of larger files, one for each
    spark.sql.files.maxPartitionBytes of text, are copied to all tasks, as lines must stay in their order.
    """
    lexer = LEXERS[name]
    raw = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    meta = F.col("_metadata")
    lines = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), (meta["file_block_start"] + meta["file_block_length"] >= meta["file_size"]).alias("last"), "value")
    lines = lines if kept is None else lines.where(kept)
    parts = lines.where((F.col("start") > 0) | ~F.col("last"))  # decided by the metadata of blocks, before lines are read
    on = ["file", "start"]
    states = parts.mapInArrow(_moves(lexer), _MOVES).groupBy("file").applyInPandas(_states, _STATES)
    ends = parts.join(F.broadcast(states), on, "left").select(*_LINES, "quote", "depth").mapInArrow(_ends(lexer), _ENDS)
    needs = ends.join(states, on).groupBy("file").applyInPandas(_needs(lexer), _NEEDS)
    return lines.join(F.broadcast(needs), on, "left").select(*_LINES, "quote", "depth", "header", "open").mapInArrow(_records(lexer), _RECORDS)
