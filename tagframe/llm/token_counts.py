"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A document is split into pre-tokens, whose token counts add up to its own. Leaves hold runs of LEAF pre-tokens; inner
nodes hold the sums of characters and tokens below them. An edit finds its leaf by the sums of characters, goes back CONTEXT
pre-tokens (the pattern looks ahead, never behind, and over no more than these), splits again from there until a new
boundary falls on an old one behind the edit, and puts the new pre-tokens in the place of the old ones. Only these are
encoded; only the sums above them change.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

RANKS = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: how this vocabulary splits texts into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, CONTEXT = 32, 2
#: Pre-tokens whose counts a worker remembers; the older half goes first. It changes speed alone.
WORDS = 800_000


class Counter:
    """Token counts of pre-tokens, from the bytes of a file of ranks."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.counts.get(word)
        if n is None:
            n = self.older.get(word) or len(self.encoding.encode_ordinary(word))
            if len(word) <= 64:
                if len(self.counts) >= WORDS // 2:
                    self.counts, self.older = {}, self.counts
                self.counts[word] = n
        return n


@lru_cache(2)
def counter(ranks: bytes) -> Counter:
    return Counter(ranks)


class Document:
    """A text, its pre-tokens in leaves, and the tree of sums over them."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        self.build(text)

    def build(self, text: str) -> None:
        self.text = text
        words = self.counter.split.findall(text)
        get, count = self.counter.counts.get, self.counter.count
        counts = [get(w) or count(w) for w in words]
        lengths = list(map(len, words))
        self.encoded += len(text)
        self.leaves = [(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(words), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (n, c) in enumerate(self.leaves, self.size):
            self.chars[k], self.tokens[k] = sum(n), sum(c)
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, place where it starts) of the character at a place; past the end the last leaf that holds any."""
        place = max(0, min(place, self.chars[1] - 1))
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def put(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        node = leaf + self.size
        self.chars[node], self.tokens[node] = sum(lengths), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Puts `inserted` in the place of `removed` characters from start; both are cut to the text."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(start + removed, len(self.text)))
        if start == end and not inserted:
            return
        self.text = self.text[:start] + inserted + self.text[end:]
        moved = len(inserted) - (end - start)
        if not self.chars[1]:
            self.build(self.text)
            return
        # the leaf and pre-token to begin with: CONTEXT pre-tokens before the one that holds the character before the edit
        leaf, at = self.find(start - 1)
        lengths, counts = map(list, self.leaves[leaf])
        first, k = at, 0
        while k < len(lengths) - 1 and first + lengths[k] <= start - 1:
            first += lengths[k]
            k += 1
        while k < CONTEXT and leaf:
            leaf -= 1
            before = self.leaves[leaf]
            lengths, counts, k = before[0] + lengths, before[1] + counts, k + len(before[0])
            at -= sum(before[0])
        begin = max(0, k - CONTEXT)
        place = at + sum(lengths[:begin])
        # old boundaries from there on, read from as many leaves as it takes
        last, bound = leaf, at + sum(lengths)
        while last + 1 < len(self.leaves) and sum(map(len, (x[0] for x in self.leaves[leaf : last + 1]))) < len(lengths):
            last += 1
        old, j = place, begin
        new_lengths, new_counts = [], []
        here = place
        for m in self.counter.split.finditer(self.text, place):
            while True:  # the first old boundary at or behind this place
                while j < len(lengths) and (old < end or old + moved < here):
                    old += lengths[j]
                    j += 1
                if (old >= end and old + moved >= here) or last + 1 >= len(self.leaves):
                    break
                last += 1
                lengths, counts = lengths + self.leaves[last][0], counts + self.leaves[last][1]
            if here >= start + len(inserted) and old >= end and old + moved == here:
                break
            word = m.group()
            new_lengths.append(len(word))
            new_counts.append(self.counter.count(word))
            self.encoded += len(word)
            here = m.end()
        else:  # all is new up to the end
            j = len(lengths)
            last = len(self.leaves) - 1
        for k in range(leaf + 1, last + 1):
            self.put(k, [], [])
        self.put(leaf, lengths[:begin] + new_lengths + lengths[j:], counts[:begin] + new_counts + counts[j:])
        if len(self.leaves[leaf][0]) > 16 * LEAF:
            encoded = self.encoded
            self.build(self.text)
            self.encoded = encoded  # its counts are known; only the tree is new


_OUT = "n_edits bigint, n_tokens_before bigint, n_tokens bigint, n_chars_after bigint, n_chars_encoded bigint"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def token_counts(docs: DataFrame, ranks: bytes) -> DataFrame:
    """docs(text, edits array<struct<start,removed,inserted>>, ...) with counts before and after the edits added.

    Edits apply in their order, each to the text that the ones before it left; they are cut to that text, nulls in them
    count as 0 or empty, and null edits are skipped. Null texts are empty. n_chars_encoded counts what edits encoded
    anew. text and edits are left out of the result; other clashing columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # under a megabyte, whatever the documents
    keep = [c for c in docs.columns if c not in ("text", "edits", *_NAMES)]
    rows = docs.select(*keep, "text", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shared.value)
        for batch in slices(batches, "text"):
            out = []
            for text, edits in zip(batch["text"].to_pylist(), batch["edits"].to_pylist(), strict=True):
                d = Document(text or "", c)
                before, d.encoded = d.count, 0
                edits = [e for e in edits or () if e is not None]
                for e in edits:
                    d.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                out.append((len(edits), before, d.count, len(d.text), d.encoded))
            values = np.array(out, np.int64).reshape(-1, len(_NAMES))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(values[:, k]) for k in range(len(_NAMES)))], [*keep, *_NAMES])

    schema = rows.select(*keep, *[F.lit(0).cast("bigint").alias(n) for n in _NAMES]).schema
    return rows.mapInArrow(run, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs(doc_id, ...) with the rows of edits(doc_id, seq, start, removed, inserted) of each as its column edits.

    They are in the order of seq; those of equal seq (null first) in that of start, removed and inserted.
    """
    each = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "removed", "inserted"))), lambda e: F.struct(e.start.alias("start"), e.removed.alias("removed"), e.inserted.alias("inserted"))).alias("edits"))
    return docs.drop("edits").join(each, "doc_id", "left")


def revision(text: str = "text", key: str = "doc_id") -> F.Column:
    """Three edits of each text at places drawn from a hash of its key: a cut, a passage put in capitals, a passage moved."""
    n = F.length(text) + 1
    at = lambda k: F.pmod(F.xxhash64(key, F.lit(k)), n).cast("int")
    edit = lambda start, removed, inserted: F.struct(start.alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))
    return F.array(edit(at(1), 40, F.lit("")), edit(at(2), 25, F.upper(F.substring(F.col(text), at(2) + 1, F.lit(25)))), edit(at(3), 0, F.substring(F.col(text), at(4) + 1, F.lit(60))))


def rank_bytes(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", revision())
    return token_counts(docs, rank_bytes()).select("doc_id", *_NAMES)
