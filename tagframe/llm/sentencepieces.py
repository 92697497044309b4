"""SentencePiece encoding and decoding with a BPE model, as a streaming Viterbi pass.

A path through a text's lattice of pieces is a BPE encoding exactly where each two neighbours encode as these two pieces
("may meet"; found by merging their few characters once, and remembered). So the transition allows or forbids, one
piece survives at each boundary, and its backpointer is the boundary before it. A later piece begins at most the longest
piece's length back, so only that many paths survive; what they share is committed and let go, and a text of any length
takes a window of memory. Ids equal those of the public library; scores rank merges here and are not summed.

No piece has a space mark behind another character, so all paths meet there: texts are taken apart at such places, and
words seen before are looked up. New words of a slice take the pass side by side, one boundary of all of them at a time;
words longer than the window take it as a stream. A character that the model does not have becomes its UTF-8 bytes' pieces.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import combed, slices, table

MODEL = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
#: Words and pairs of pieces that a worker remembers; the older half goes first. It changes speed alone.
WORDS, PAIRS = 400_000, 1_000_000
#: Characters between two looks for a boundary to commit at.
LOOK = 64
MARK = "▁"


class Pieces:
    """A model from the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(m.vocab_size())
        plain = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.rank = {m.id_to_piece(i): -m.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank) or any(c not in self.rank for p in self.rank for c in p):
            raise ValueError("the model has pieces across words, or without their characters")
        if m.encode("A  ﬁ") != m.encode("A  ") + [m.piece_to_id("ﬁ")] and "ﬁ" in self.rank or m.decode(m.encode(" a")) != " a":
            raise ValueError("only models that leave texts as they are and mark their start are supported")
        self.id = {p: m.piece_to_id(p) for p in self.rank}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if m.is_unknown(self.byte[0]):
            raise ValueError("the model has no pieces for bytes")
        self.longest = max(map(len, self.rank))
        self.id = {p: i for p, i in self.id.items() if len(p) == 1 or self.merged(p) == [p]}  # others never come out
        self.back = [b""] * m.vocab_size()
        for p, i in self.id.items():
            self.back[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.back[i] = bytes([b])
        self.meets: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.within = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.piece = [m.id_to_piece(i) for i in ids]
        size = np.array([len(b) for b in self.back])
        self.flat = np.frombuffer(b"".join(self.back), np.uint8), np.cumsum(size) - size, size
        # the pieces read backwards, as a tree in one table
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in sorted({c for p in self.id for c in p})]] = np.arange(1, len({c for p in self.id for c in p}) + 1)
        steps, ends = [{}], [-1]
        for p, i in self.id.items():
            node = 0
            for c in reversed(p):
                c = int(self.symbol[ord(c)])
                if c not in steps[node]:
                    steps[node][c] = len(steps)
                    steps.append({}), ends.append(-1)
                node = steps[node][c]
            ends[node] = i
        self.base, self.table = combed(steps)
        self.ends = np.array(ends, np.int32)
        self.keys, self.met, self.held = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, bool), 0

    def many_meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_meet for many pairs of ids, from a table of what was asked before."""
        key = a.astype(np.int64) * len(self.piece) + b
        at = self.places(key)
        new = np.unique(key[self.keys[at] < 0])
        if len(new):
            if self.held + len(new) > PAIRS:
                self.keys, self.met, self.held = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, bool), 0
                new = np.unique(key)
            while 2 * (self.held + len(new)) > len(self.keys):
                old, met = self.keys[self.keys >= 0], self.met[self.keys >= 0]
                self.keys, self.met = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.keys), bool)
                self.put(old, met)
            found = []
            for x, y in zip((new // len(self.piece)).tolist(), (new % len(self.piece)).tolist(), strict=True):
                x, y = self.piece[x], self.piece[y]
                found.append(x + y not in self.rank and self.merged(x + y) == [x, y])
            self.put(new, np.array(found))
            self.held += len(new)
            at = self.places(key)
        return self.met[at]

    def places(self, key: np.ndarray) -> np.ndarray:
        """Where each key is in the table, or the free place where it would be."""
        mask = len(self.keys) - 1
        at = (key * 0x9E3779B1 >> 15) & mask
        go = np.arange(len(key))
        while len(go):
            there = self.keys[at[go]]
            go = go[(there >= 0) & (there != key[go])]
            at[go] = (at[go] + 1) & mask
        return at

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Adds keys that are not in the table."""
        go = np.arange(len(key))
        while len(go):
            at = self.places(key[go])
            self.keys[at] = key[go]  # of keys that meet at one place the last stays
            stay = self.keys[at] == key[go]
            self.met[at[stay]] = value[go[stay]]
            go = go[~stay]

    def side_by_side(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each of some words of at most LOOK characters, as int32 bytes."""
        words = sorted(words, key=len, reverse=True)
        size = np.array([len(w) for w in words])
        code = np.zeros((len(words), size[0]), np.int32)
        code[np.arange(size[0]) < size[:, None]] = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        last, back = (np.full((len(words), size[0] + 1), -1, np.int32) for _ in range(2))
        for i in range(size[0]):
            go = np.arange(np.searchsorted(-size, -i, "left"))
            piece, start = np.full(len(go), -1, np.int32), np.full(len(go), i, np.int32)
            node = np.zeros(len(go), np.int64)
            for j in range(i, -1, -1):
                got = self.table[self.base[node] + code[go, j]]
                on = got >> 32 == node
                go, node = go[on], got[on] & 0xFFFFFFFF
                if not len(go):
                    break
                end = self.ends[node]
                some = np.flatnonzero(end >= 0)
                before = last[go[some], j]
                ok = before < 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.many_meet(before[ask], end[some[ask]])
                won = some[ok]
                piece[go[won]], start[go[won]] = end[won], j
                stay = np.ones(len(go), bool)
                stay[won] = False
                go, node = go[stay], node[stay]
            last[: len(piece), i + 1], back[: len(piece), i + 1] = piece, start
        rows, at, parts = np.arange(len(words)), size.copy(), []
        while len(rows):
            parts.append((rows, at, last[rows, at]))
            at = back[rows, at].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        rows, at, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, rows))
        rows, at, ids = rows[order], at[order], ids[order]
        ends = np.searchsorted(rows, np.arange(len(words) + 1)).tolist()
        odd = set(rows[ids < 0].tolist())
        data = ids.tobytes()
        out = [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
        for k in odd:  # with characters that become bytes
            each = [(int(i),) if i >= 0 else [self.byte[b] for b in words[k][e - 1].encode("utf-8", "surrogatepass")] for i, e in zip(ids[ends[k] : ends[k + 1]], at[ends[k] : ends[k + 1]], strict=True)]
            out[k] = array("i", [i for x in each for i in x]).tobytes()
        return dict(zip(words, out, strict=True))

    def merged(self, text: str) -> list[str]:
        """The pieces of a few characters by merging: best score first, leftmost of equals."""
        parts, never, get = list(text), float("inf"), self.rank.get
        score = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while score and (best := min(score)) < never:
            at = score.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del score[at]
            if at:
                score[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(score):
                score[at] = get(parts[at] + parts[at + 1], never)
        return parts

    def may_meet(self, a: str, b: str) -> bool:
        if self.pairs >= PAIRS:
            self.meets, self.pairs = {}, 0
        self.pairs += 1
        found = self.meets.setdefault(a, {})[b] = a + b not in self.rank and self.merged(a + b) == [a, b]
        return found

    def extend(self, text: str, back: list[int], last: list[str], start: int) -> None:
        """Goes on from boundary start to the end of text: the surviving piece at each boundary and where it begins."""
        known, longest, may_meet = self.id, self.longest, self.may_meet
        after = [self.meets.get(x) if x else None for x in last]
        for i in range(start + 1, len(text) + 1):
            for j in range(i - 1, max(-1, i - 1 - longest), -1):
                piece = text[j:i]
                if piece in known:
                    if not last[j]:
                        break
                    ok = after[j].get(piece) if after[j] else None
                    if ok is None:
                        ok = may_meet(last[j], piece)
                        after[j] = self.meets[last[j]]
                    if ok:
                        break
            else:
                j, piece = i - 1, ""  # no piece: its bytes, which meet anything
            back.append(j)
            last.append(piece)
            after.append(self.meets.get(piece))

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in parts of any size, given back as soon as they are certain."""
        text, back, last = "", [0], [""]  # from the last committed boundary on; last: the piece that ends there
        for part in chars:
            for k in range(0, len(part), LOOK):
                start = len(text)
                text += part[k : k + LOOK]
                self.extend(text, back, last, start)
                # where the surviving paths have come together
                ends = list(range(max(0, len(text) - self.longest + 1), len(text) + 1))
                while ends[0] != ends[-1]:
                    ends = sorted({*ends[:-1], back[ends[-1]]})
                if done := ends[0]:
                    yield from self.path(text, back, last, done)
                    text, back, last = text[done:], [0, *(b - done for b in back[done + 1 :])], last[done:]
        yield from self.path(text, back, last, len(text))

    def path(self, text: str, back: list[int], last: list[str], end: int) -> list[int]:
        out = []
        while end:
            if last[end]:
                out.append(self.id[last[end]])
            else:
                out += [self.byte[b] for b in reversed(text[end - 1].encode("utf-8", "surrogatepass"))]
            end = back[end]
        return out[::-1]

    def cut(self, word: str) -> list[str]:
        """A word's parts: where no piece holds two neighbours, all paths meet between them."""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.within]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def word(self, word: str) -> bytes:
        """The ids of a part that begins and ends where all paths meet, as int32 bytes."""
        found = self.words.get(word)
        if found is None:
            found = self.older.get(word)
        if found is None:
            parts = self.cut(word)
            found = b"".join(map(self.word, parts)) if len(parts) > 1 else array("i", self.stream((word,))).tobytes()
        return found

    def apart(self, text: str | None) -> list[str]:
        """The words of a text."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if MARK * 2 in marked or marked[-1] == MARK else [MARK + w for w in marked[1:].split(MARK)]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [self.apart(t) for t in texts]
        found = [list(map(self.words.get, ws)) for ws in words]
        new = {w for ws, ids in zip(words, found, strict=True) if None in ids for w, x in zip(ws, ids, strict=True) if x is None}
        short = {p for w in new for p in ([w] if len(w) <= LOOK else self.cut(w)) if len(p) <= LOOK}
        kept = {w: x for w in short if (x := self.older.get(w)) is not None}
        if len(self.words) + len(short) > WORDS // 2:
            self.words, self.older = {}, self.words
        self.words.update(kept)
        short = list(short - kept.keys())
        for k in range(0, len(short), 1 << 16):
            self.words.update(self.side_by_side(short[k : k + (1 << 16)]))
        word = self.word
        return [np.frombuffer(b"".join(ids if None not in ids else [x or word(w) for w, x in zip(ws, ids, strict=True)]), np.int32) for ws, ids in zip(words, found, strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, nulls and ids that the model does not have give nothing."""
        data = b"".join([self.back[i] for i in ids if i is not None and 0 <= i < len(self.back)])
        return data[data[:1] == b" " :].decode("utf-8", "replace")


    def given_back(self, ids: list[np.ndarray], texts: list[str | None]) -> list[bool]:
        """For each text whether its ids decode to it; the bytes of all are laid side by side first."""
        flat, first, size = self.flat
        every = np.concatenate([*ids, np.zeros(0, np.int32)])
        ends = np.cumsum(size[every])
        begin = np.concatenate(([0], ends))[np.cumsum([0, *map(len, ids)])].tolist()
        got = flat[np.repeat(first[every] - (ends - size[every]), size[every]) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return [got[a:b] == (b" " + t.encode("utf-8", "surrogatepass") if t else b"") for t, a, b in zip(texts, begin, begin[1:], strict=False)]


@lru_cache(2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(each: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each) if each else np.zeros(0, np.int32)))


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """docs(text, ...) with ids array<int>, n_tokens and round_trip added; clashing columns are replaced.

    round_trip tells whether decoding gives the text back, which holds but for U+2581, which is read as a space. Null
    and empty texts have no ids and count as given back. Repeated rows stay, empty tables stay empty.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # half a megabyte, whatever the documents
    docs = docs.drop("ids", "n_tokens", "round_trip")
    schema = docs.selectExpr("*", "array(0) AS ids", "0L AS n_tokens", "true AS round_trip").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared.value)
        for batch in slices(batches, "text"):
            texts = batch["text"].to_pylist()
            ids = p.encode_all(texts)
            same = p.given_back(ids, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)], [*batch.schema.names, "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """rows(ids, ...) with text added (null where ids is null); ids that the model does not have give nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared.value)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return rows.mapInArrow(run, rows.selectExpr("*", "cast(null AS string) AS text").schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, model_bytes()).select("doc_id", "n_tokens", "ids", "round_trip")
