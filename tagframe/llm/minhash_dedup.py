"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. Every whole text becomes its set of word shingles (64-bit hashes). One hash deals the set over BINS bins; the least
   value of a bin is one MinHash. An empty bin borrows from the first full bin in an order of its own, drawn once for
   all sets (optimal densification). BANDS groups of ROWS bins are the bucket keys.
2. Texts with equal sets are one class from here on, so copies never meet pairwise.
3. In each bucket one class is the centre and gets an edge to each other member: as many edges as members, not pairs.
   Edges are confirmed on the full sets. Members of a bucket that lie in several components after that are compared in
   full (see `rest`), so that stars lose no link of a bucket.
4. Components of the confirmed links give each document the least doc_id it can reach.

All this goes by rows, which are numbered when they are first written; doc_id is only what the result names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hub_join, mixed, saved, slices, table, utf8, word_hashes
from .components import components

BINS, BANDS, ROWS = 128, 25, 5
#: Members and shingles of a block's side in `rest`, about.
BLOCK, SHINGLES = 1024, 4 << 20

_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: For each bin, the order in which it tries the others when it is empty.
_ORDER = np.stack([np.concatenate(([i], np.random.default_rng(1000 + i).permutation(np.delete(np.arange(BINS), i)))) for i in range(BINS)], 1)


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """For each string its sorted distinct shingle hashes; with 1 to width - 1 words the whole sequence is the one."""
    words, rows, _, _ = word_hashes(*utf8(text))
    counts = np.bincount(rows, minlength=len(text))
    first = np.concatenate(([0], np.cumsum(counts)))
    chain = words.copy()
    for k in range(1, width):
        chain[: max(0, len(words) - k)] = mixed(chain[: max(0, len(words) - k)] * _A + words[k:])
    out = []
    for i, n in enumerate(counts):
        a = first[i]
        if n >= width:
            out.append(np.unique(chain[a : a + n - width + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[a : a + n]:
                    h = h * _B + w
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def densified(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS MinHash values for each non-empty sorted set."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    out = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out[i, bins[first]] = s[first]
        full[i, bins[first]] = True
    have, values = full.copy(), out.copy()
    for step in range(1, BINS):
        row, col = np.nonzero(~have)
        if not len(row):
            break
        source = _ORDER[step][col]
        hit = full[row, source]
        values[row[hit], col[hit]] = out[row[hit], source[hit]]
        have[row[hit], col[hit]] = True
    return values


def bucket_keys(sets: list[np.ndarray]) -> np.ndarray:
    values = densified(sets)[:, : BANDS * ROWS].reshape(len(sets), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
    for k in range(ROWS):
        key = mixed(key * _B + values[:, :, k])
    return key.view(np.int64)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch["text"], width)
            full = [s for s in sets if len(s)]
            keys = iter(bucket_keys(full)) if full else iter(())
            new = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_shingles", "node", "buckets"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([s.tobytes() for s in shingle_sets(batch["text"], width)], pa.binary())], ["node", "shingles"])

    return run


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch[c]] for c in ("a", "b")]
            shared = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets, strict=True)], np.int64)
            whole = np.array([len(a) + len(b) for a, b in zip(*sets, strict=True)], np.int64) - shared
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(100 * shared >= percent * whole)], ["u", "v", "linked"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(u, v), those whose full sets are alike enough. sets(node, shingles)."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return both.mapInArrow(_compared(percent), "u binary, v binary, linked boolean").where("linked").select("u", "v")


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of docs(doc_id, text, further columns named as ours are not).

    rows: docs' columns, row (its number), n_shingles and node (its class of equal sets; null: no shingles). classes:
    node, copies (its rows), best and first. best and first are (no_id, doc_id, row) of the foremost row, with the least
    doc_id, of the class and of all that it is linked to by any way.
    """
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    schema = numbered.selectExpr("*", "0L AS n_shingles", "cast(null AS binary) AS node", "cast(null AS array<bigint>) AS buckets").schema
    rows = saved(numbered.mapInArrow(_sketch(width), schema), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    found = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(place).alias("best"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = saved(found, "classes")

    member = classes.select("node", "n", F.explode("buckets").alias("bucket"))
    # buckets with two members or more, and one of those with the same members
    shared = member.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.hash("node").cast("bigint")).alias("s")).where("members > 1")
    one = saved(shared.groupBy("members", "x", "s").agg(F.min("bucket").alias("bucket"), F.count("*").alias("alike")), "buckets")
    member = saved(hub_join(member, one.select("bucket", "members", (F.col("members") * F.col("alike")).alias("weight")), "bucket", "members"), "members")
    # the class that meets the most others stands nearest the middle of its group
    weight = saved(member.groupBy("node").agg(F.sum("weight").alias("weight")), "weights")
    texts = rows.select("row", "node", "text").join(classes.join(weight, "node", "left_semi").select("best.row"), "row")
    sets = saved(texts.mapInArrow(_sets(width), "node binary, shingles binary"), "sets")
    ranked = saved(member.drop("weight").join(weight, "node"), "ranked")
    centre = ranked.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "weight"), F.struct("weight", "node")).alias("c"), F.count("*").alias("members"))
    pairs = hub_join(ranked, centre, "bucket", "members").where((F.col("node") != F.col("c.node")) & (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")))
    pairs = pairs.groupBy(F.col("node").alias("u"), F.col("c.node").alias("v")).agg(F.first("c.weight").alias("weight"))
    stars = saved(confirmed(pairs.select("u", "v"), sets, percent).join(weight.withColumnRenamed("node", "v"), "v"), "stars")
    # a first idea of the components: each class with the foremost centre that it is linked to
    part = stars.groupBy(F.col("u").alias("node")).agg(F.max_by("v", F.struct("weight", "v")).alias("component"))
    links = saved(stars.select("u", "v").unionByName(rest(member, part, sets, percent)), "stars")
    for old in (one, member, weight, sets, ranked, stars):
        discard(old)

    placed = saved(components(links).join(classes.select("node", "best"), "node"), "placed")
    least = saved(placed.groupBy("component").agg(F.min("best").alias("first"), F.count("*").alias("n")), "least")
    linked = hub_join(placed.select("node", "component"), least, "component", "n").select("node", "first")
    return rows.drop("buckets"), classes.select("node", "copies", "best").join(linked, "node", "left").withColumn("first", F.coalesce("first", "best"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept: one row per row of docs.

    Links documents with 100 * |intersection| >= percent * |union| of their distinct `width`-word shingles (words are
    runs of non-white-space, A-Z lower-cased). Null, empty and blank texts have no shingles and link with nothing.
    Equal texts are linked. Every row is judged by its own text, so rows that share a doc_id, or have none, may lie in
    different components; component_id is the least doc_id of the component, null where it has none, and kept is
    doc_id <=> component_id. Repeated rows stay; other columns are ignored; an empty table gives an empty one.
    """
    rows, classes = grouped(docs.select("doc_id", "text"), width, percent)
    out = hub_join(rows.select("doc_id", "n_shingles", "node"), saved(classes.select("node", "copies", F.col("first.doc_id").alias("component_id")), "ends"), "node", "copies", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs(doc_id, text, ...) but one of each component (the least doc_id) and those without shingles removed.

    Of repeated rows one stays; a component whose rows have no doc_id keeps one of them. Columns are those of docs.
    """
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)])
    rows, classes = grouped(plain, width, percent)
    stay = saved(classes.select("first.row").distinct(), "stay")
    return rows.join(stay, "row", "left_semi").unionByName(rows.where("node IS NULL")).select(plain.columns).toDF(*docs.columns)


def rest(member: DataFrame, part: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of one bucket that the stars left in different components.

    Members outside a bucket's largest component are asked against all its members, in blocks of BLOCK by BLOCK; a block
    gives back one link for each asked member and component, so neither pairs nor a whole bucket are ever laid out.
    part(node, component) may leave classes out, and may be any part of what is known to be linked.
    """
    placed = saved(member.select("bucket", "node", "n").join(part, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    count = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    count = count.groupBy("bucket").agg(F.sum("c").alias("all"), F.sum("s").alias("size"), F.max(F.struct("c", "s", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    # so many blocks that neither members nor their shingles are too many for one
    sides = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / SHINGLES)).cast("int")
    count = count.select("bucket", "all", F.col("main.component").alias("main"), sides(F.col("all"), F.col("size")).alias("rows"), sides(F.col("all") - F.col("main.c"), F.col("size") - F.col("main.s")).alias("blocks"))
    open_ = hub_join(placed, saved(count, "open"), "bucket", "all")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    both = F.expr("component <> main")
    # every member is there for each block that asks; one outside the largest component also asks each block that is there
    there = F.transform(F.expr("sequence(0, blocks - 1)"), lambda i: F.struct(i.alias("i"), at("rows").alias("j"), F.lit(False).alias("asks")))
    asks = F.transform(F.expr("sequence(0, rows - 1)"), lambda j: F.struct(at("blocks").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    laid = open_.select("bucket", "node", "component", F.inline(F.when(both, F.concat(there, asks)).otherwise(there)))
    blocks = laid.join(sets, "node").select("bucket", "i", "j", "node", "component", "asks", "shingles").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return blocks.mapInArrow(_blocks(percent), "u binary, v binary")


def linked(asked: list[np.ndarray], there: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the asked sets are alike enough to which of the others."""
    size = np.array([len(a) for a in asked])[:, None] + np.array([len(b) for b in there])[None, :]
    if len(asked) * len(there) <= 64:
        shared = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in there] for a in asked])
        return 100 * shared >= percent * (size - shared)
    known, ids = np.unique(np.concatenate(asked + there), return_inverse=True)
    rows = np.repeat(np.arange(len(asked) + len(there)), [len(s) for s in asked + there])
    shared = np.zeros(size.shape, np.float32)
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    for start in range(0, len(known), BLOCK):  # so many shingles at a time
        a, b = np.searchsorted(ids, (start, start + BLOCK))
        grid = np.zeros((len(asked) + len(there), BLOCK), np.float32)
        grid[rows[a:b], ids[a:b] - start] = 1
        shared += grid[: len(asked)] @ grid[len(asked) :].T
    return 100 * shared >= percent * (size - shared)


def _blocks(percent: int):
    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        asks = np.array(t["asks"])
        node, part = t["node"].to_pylist(), t["component"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]]
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = {}
        if len(a) and len(b):
            for x, y in zip(*np.nonzero(linked([sets[k] for k in a], [sets[k] for k in b], percent)), strict=True):
                if part[a[x]] != part[b[y]]:
                    found[node[a[x]], part[b[y]]] = node[b[y]]
        return pa.RecordBatch.from_arrays([pa.array([max(u, v) for (u, _), v in found.items()], pa.binary()), pa.array([min(u, v) for (u, _), v in found.items()], pa.binary())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key = [], None
        for batch in batches:
            keys = np.stack([np.array(batch[c]) for c in ("bucket", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if key is not None and tuple(keys[s]) != key:
                        yield block(open_)
                        open_ = []
                    key = tuple(keys[s])
                    open_.append(batch.slice(s, e - s))
        if open_:
            yield block(open_)

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
