"""Fill-in-middle: each text is cut into prefix, middle and suffix at token ends, and put in another order.

A token is white space and the word after it, or white space that ends a text. A rolling hash cuts texts into chunks by
their content, so passages that texts share give the same chunks. Each task remembers for a chunk's bytes a summary: its
characters, whether it begins and ends inside a word, and where tokens end within. Summaries add up along a text: two
chunks meet at a token's end where the first ends with a letter of a word and the second begins with white space. So the
number of tokens of a text, and the chunk in which its k-th token ends, follow from the summaries, and only bytes of
chunks not seen before are looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_name, mixed, slices, table, utf8

#: Bytes of a chunk: at least, at most, and as a power of two on average beyond the least. They change speed alone.
LEAST, MOST, POWER = 64, 4096, 9
#: Bytes of chunks that a task remembers; the older half goes first. It changes speed alone.
MEMORY = 16 << 20
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN, SPM = 42, 50, 80
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_WINDOW, _BLOCK = 32, 1 << 20


def chunk_marks(data: np.ndarray) -> np.ndarray:
    """Places of data where a chunk may begin: a hash of the 32 bytes before is rare, and no character is cut."""
    out = []
    for start in range(0, len(data), _BLOCK):
        begin = max(0, start - _WINDOW)
        h, m = _GEAR[data[begin : start + _BLOCK]], 1
        while m < _WINDOW:  # the hash of 2 m bytes is that of the last m and, shifted by m, that of the m before
            longer = h.copy()
            longer[m:] += h[:-m] << np.uint32(m)
            h, m = longer, 2 * m
        at = np.flatnonzero(h >> np.uint32(32 - POWER) == 0) + begin + 1
        out.append(at[at > start])
    at = np.concatenate(out) if out else np.zeros(0, np.int64)
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


class Chunks:
    """Summaries of chunks by their bytes: (characters, begins in a word, ends in a word, token ends within)."""

    def __init__(self, most: int = MEMORY):
        self.most, self.held, self.hits = most, 0, 0
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def summary(self, chunk: bytes) -> tuple[int, bool, bool, np.ndarray]:
        found = self.young.get(chunk)  # a dictionary compares the bytes themselves, so equal hashes never mix texts
        if found is not None:
            self.hits += 1
            return found
        found = self.old.get(chunk)
        if found is None:
            data = np.frombuffer(chunk, np.uint8)
            solid = ~SPACE[data]
            found = (int(np.count_nonzero((data & 0xC0) != 0x80)), bool(solid[0]), bool(solid[-1]), (np.flatnonzero(solid[:-1] & ~solid[1:]) + 1).astype(np.int32))
        else:
            self.hits += 1
        if self.held >= self.most // 2:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[chunk] = found
        self.held += len(chunk) + 4 * len(found[3]) + 200
        return found


class Text:
    """The chunks of one text and what their summaries add up to."""

    def __init__(self, data: bytes, bounds: list[int], chunks: Chunks):
        self.data, self.starts, self.parts, self.ended, self.chars = data, bounds, [], [], [0]
        ended, inside = 0, False
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = chunks.summary(data[a:b])
            lead = inside and not part[1]
            ended += lead + len(part[3])
            inside = part[2]
            self.parts.append((lead, part[3]))
            self.ended.append(ended)
            self.chars.append(self.chars[-1] + part[0])
        #: The end of a text ends its last token.
        self.tokens = ended + 1 if self.parts else 0

    def characters(self, k: int) -> int:
        """Characters up to the end of the k-th token."""
        if k <= 0:
            return 0
        if k >= self.tokens:
            return self.chars[-1]
        c = bisect_left(self.ended, k)
        lead, ends = self.parts[c]
        rank = k - (self.ended[c - 1] if c else 0) - lead - 1
        if rank < 0:
            return self.chars[c]
        start = self.starts[c]
        piece = np.frombuffer(self.data[start : start + int(ends[rank])], np.uint8)
        return self.chars[c] + int(np.count_nonzero((piece & 0xC0) != 0x80))


def chunk_bounds(data: np.ndarray, marks: list[int], start: int, end: int) -> list[int]:
    """Where the chunks of data[start:end] begin, and end."""
    out, at = [start], start
    while end - at > LEAST:
        k = bisect_left(marks, at + LEAST)
        following = min(marks[k] if k < len(marks) else end, end)
        if following > at + MOST:
            following = at + MOST
            while (data[following] & 0xC0) == 0x80:
                following -= 1
        if following >= end:
            break
        out.append(following)
        at = following
    return [*out, end] if end > start else [start]


_CUTS = "n bigint, prefix_chars bigint, middle_chars bigint"


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    chunks = Chunks()
    for text, h1, h2 in batches:
        out = np.zeros((len(text), 3), np.int64)
        done = 0
        for part in slices([pa.RecordBatch.from_arrays([text, h1, h2], ["text", "h1", "h2"])], "text"):
            data, offsets = utf8(part["text"])
            marks = chunk_marks(data).tolist()
            whole, first, second = data.tobytes(), part["h1"].to_pylist(), part["h2"].to_pylist()
            for k in range(part.num_rows):
                a, b = int(offsets[k]), int(offsets[k + 1])
                t = Text(whole, chunk_bounds(data, marks, a, b), chunks)
                x, y = sorted((first[k] % (t.tokens + 1), second[k] % (t.tokens + 1)))
                prefix = t.characters(x)
                out[done] = (t.tokens, prefix, t.characters(y) - prefix)
                done += 1
        yield pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], ["n", "prefix_chars", "middle_chars"])


def _udf() -> Column:
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _cuts(batches)

    return F.arrow_udf(cuts, _CUTS)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 drawn from a row's key: the groups of eight digits of a hash; a null key draws as an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """docs(doc_id, text, ...) with n (tokens), form, prefix_chars, middle_chars and output added.

    `plain` in a hundred rows, empty ones and those that contain a mark stay as they are (form plain, lengths null). Of
    the others `spm` in a hundred begin with the suffix, the rest with the prefix. Null texts are empty. Rows are
    independent: repeated rows have equal results, and rows may share a doc_id or have none. Columns of docs named like
    the new ones are replaced. No shuffle: texts go once through a vectorized function that gives back three numbers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = free_name(docs, "cuts")
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = docs.drop(*[c for c in NEW if c in docs.columns]).withColumn(at, _udf()(F.col("text"), h1, h2))
    stays = (text == "") | (h3 % 100 >= 100 - plain)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        stays = stays | text.contains(mark)
    form = F.when(stays, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    a, m = F.col(f"{at}.prefix_chars").cast("int"), F.col(f"{at}.middle_chars").cast("int")
    prefix, middle = F.substring(text, F.lit(1), a), F.substring(text, a + 1, m)
    suffix = F.substring(text, a + m + 1, F.length(text))
    rows = rows.withColumn("n", F.col(f"{at}.n")).withColumn("form", form)
    moved = F.col("form") != "plain"
    rows = rows.withColumn("prefix_chars", F.when(moved, F.col(f"{at}.prefix_chars"))).withColumn("middle_chars", F.when(moved, F.col(f"{at}.middle_chars")))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text)
    return rows.withColumn("output", output).drop(at)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts that contain a mark are never moved, so the marks are where they were put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
n AS (SELECT *, len(t)::BIGINT AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:], '') AS suf FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
