"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks of BLOCK_DOCS. With weight w (its share of the slots), the source's j-th block, j from
1, is released at floor((j - 1) / w) and due at ceil(j / w). Each slot takes the released block that is due first, so at
every slot a source has had its share of the blocks so far to within less than one block.

Weights are whole numbers, so a schedule repeats after as many slots as they add up to, once a factor that all share is
taken out. One such period is laid out once, and no more of it than there are blocks left; a block's slot follows by
arithmetic. Where a source has no block left, a new phase begins in which the others share the slots by their weights. Numbering a
source's documents takes one count per (source, shard), so no source is ever sorted or numbered in one task.

Sources beyond the SOURCES largest are the leaves of a binary tree, in which two neighbours share the slots of their
node by the same rule, with periods as long as their weights add up to; so do the tree and the SOURCES largest at the
top. With two streams the slots follow by arithmetic alone, so nothing of this is laid out, and Spark holds the tree.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import saved, table

BLOCK_DOCS = 8
NEW = ("stream", "block", "phase", "release", "due", "slot", "place")
#: Documents a shard holds about; sources that one period is laid out for when no weights are given, the others are
#: nested; the stream of null sources, and of sources without a given weight; steps of weights.
SHARD_DOCS, SOURCES, OTHERS, STEPS = 2_000, 256, "\0others", 20


def period(weights: Mapping[str, int], slots: int | None = None) -> list[tuple[str, int]]:
    """(source, number of its block) for each slot of one period, or of its first slots: earliest deadline first among released blocks."""
    total = sum(weights.values())
    waiting = [(0, -(-total // w), s, 1) for s, w in weights.items()]  # release, deadline, source, number
    heapq.heapify(waiting)
    ready, out = [], []
    for slot in range(total if slots is None else min(slots, total)):
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)  # the shares add up to one, so there always is one
        out.append((s, j))
        if j < weights[s]:
            w = weights[s]
            heapq.heappush(waiting, (j * total // w, -(-(j + 1) * total // w), s, j + 1))
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[dict]:
    """For each phase: first slot, length of its period, and for each source the period's slots as far as they are needed, blocks before it, blocks in it, weight.

    blocks: how many blocks each source has. A phase ends with the slot in which a source places its last block.
    """
    left = {s: n for s, n in blocks.items() if n}
    done, start, out = dict.fromkeys(left, 0), 0, []
    while left:
        factor = math.gcd(*(weights[s] for s in left))
        active = {s: weights[s] // factor for s in left}
        slots: dict[str, list[int]] = {s: [] for s in active}
        size = sum(active.values())
        # a source is never a block ahead of its share, so one has run out by then
        needed = min(-(-left[s] * size // active[s]) for s in left)
        for at, (s, _) in enumerate(period(active, needed)):
            slots[s].append(at)
        ends = [(left[s] - 1) // active[s] * size + slots[s][(left[s] - 1) % active[s]] for s in left if (left[s] - 1) % active[s] < len(slots[s])]
        last = min(ends) + 1
        rounds, rest = divmod(last, size)
        here = {s: min(left[s], rounds * active[s] + bisect_left(slots[s], rest)) for s in left}
        out.append({"start": start, "size": size, "sources": {s: (slots[s], done[s], here[s], active[s]) for s in left}})
        for s, n in here.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += last
    return out


_PATH = "array<struct<level: int, right: boolean, weight: bigint, total: bigint, others: bigint>>"


def nested(per: DataFrame) -> DataFrame:
    """per(stream, weight, blocks) -> stream, blocks, path: at each node above a stream, from the lowest, what it shares it with."""
    leaf = per.withColumn("leaf", F.row_number().over(Window.orderBy(F.desc("blocks"), "stream")) - 1)  # one row per source
    depth = max(1, (per.count() - 1).bit_length())
    each = leaf.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("node", F.expr("shiftright(leaf, level)"))
    node = each.groupBy("level", "node").agg(F.sum("weight").alias("w"), F.sum("blocks").alias("b"))
    beside = node.select("level", F.col("node").bitwiseXOR(F.lit(1)).alias("node"), F.col("w").alias("ow"), F.col("b").alias("others"))
    shares = node.join(beside, ["level", "node"], "left").select(
        "level", "node", F.struct("level", (F.col("node") % 2 == 1).alias("right"), F.col("w").alias("weight"), (F.col("w") + F.coalesce("ow", F.lit(0))).alias("total"), F.coalesce("others", F.lit(0)).alias("others")).alias("p")
    )
    return each.join(shares, ["level", "node"]).groupBy("stream", "blocks").agg(F.array_sort(F.collect_list("p")).cast(_PATH).alias("path"))


def shared_slot(at: Column, path: str) -> Column:
    """The slot, at the end of path, of what is `at` a slot of its own stream.

    Of two streams the left takes the first slot of each of its windows, the right the last, which are all slots; where
    one has run out, the other takes all that are left.
    """
    first = lambda k, p: F.when(p.right, F.call_function("div", (k + 1) * p.total - 1, p.weight)).otherwise(F.call_function("div", k * p.total, p.weight))
    return F.aggregate(path, at.cast("bigint"), lambda k, p: k + F.least(p.others, first(k, p) - k))


_PHASES = T.StructType([T.StructField(n, T.LongType()) for n in ("phase", "start", "size", "before", "count", "weight")] + [T.StructField("stream", T.StringType()), T.StructField("slots", T.ArrayType(T.LongType()))])


def mixed_order(docs: DataFrame, weights: Mapping[str, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs(doc_id, source, ...) with stream, block, phase, release, due, slot and place added.

    weights: whole numbers from 1 on by source (others are an error); sources without one (null source included) form
    one further stream of weight 1.
    Without weights, every source, and null, gets a weight by the square root of its documents, in steps up to STEPS.
    The SOURCES sources with most documents and null are laid out, the others nested, each in blocks of its own.
    Every row is kept and gets a slot of its block and a place in it; the order of rows within a source is by hash of
    doc_id, of those without one by that of their place in docs. release and due count slots of the phase; those of a nested source count slots that it shares with its
    neighbour, and its phase is 0. Columns of docs that clash are replaced; no rows give no rows.
    """
    docs = docs.drop(*NEW)
    named_as = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "source") else f"column {k}" for k, c in enumerate(named_as)])  # the steps' own names are free
    spark, others, pool = docs.sparkSession, 1, None
    if weights is not None and any(w != int(w) or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on; leave out the rows of a source that is to have no share")
    numbered = not docs.where("doc_id IS NULL").isEmpty()
    if numbered:  # rows without doc_id are dealt over shards by a number of their own, written down so that it stays
        docs = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    if weights is None:
        per = docs.groupBy("source").count()
        top = per.where("source IS NOT NULL").orderBy(F.desc("count"), "source").limit(SOURCES + 1).collect()
        none = per.where("source IS NULL").collect()
        most = max((r["count"] for r in top + none), default=1)
        weights = {r.source: max(1, round(STEPS * (r["count"] / most) ** 0.5)) for r in top[:SOURCES]}
        others = max([1, *(round(STEPS * (r["count"] / most) ** 0.5) for r in none)])
        if len(top) > SOURCES:
            left = per.where(F.col("source").isNotNull()).join(F.broadcast(spark.createDataFrame([(x,) for x in weights], "source string")), "source", "left_anti")
            weight = F.greatest(F.lit(1), F.round(STEPS * F.sqrt(F.col("count") / most))).cast("bigint")
            pool = saved(left.select(F.col("source").alias("stream"), F.col("count").alias("n"), weight.alias("weight"), F.ceil(F.col("count") / block_docs).alias("blocks")), "pool")
    listed = spark.createDataFrame([(s,) for s in sorted(weights)], "source string")
    named = docs.join(F.broadcast(listed.withColumn("stream", F.col("source"))), "source", "left")
    named = named.withColumn("stream", F.coalesce("stream", F.lit(OTHERS)) if pool is None else F.coalesce("source", F.lit(OTHERS)))
    key = F.xxhash64(F.col("doc_id").cast("string"))
    named = named.withColumn("_h", F.when(F.col("doc_id").isNull(), F.xxhash64("_row")).otherwise(key) if numbered else key)

    known = named.groupBy("stream").count()
    known = known if pool is None else known.join(pool, "stream", "left_anti")
    counts = {r.stream: r["count"] for r in known.collect()}  # one row per stream that is laid out
    shards = {s: max(1, -(-n // SHARD_DOCS)) for s, n in counts.items()}
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    plan = phases(blocks, {**weights, OTHERS: others})
    laid = [(k, p["start"], p["size"], before, count, weight, s, slots) for k, p in enumerate(plan) for s, (slots, before, count, weight) in p["sources"].items()]
    sizes = spark.createDataFrame(list(shards.items()), "stream string, shards bigint")
    steps = spark.createDataFrame(laid, _PHASES).withColumn("path", F.array().cast(_PATH))
    tree = None
    if pool is not None:
        a, n = sum(w for s, w in {**weights, OTHERS: others}.items() if s in counts), sum(blocks.values())
        b, m = pool.agg(F.sum("weight"), F.sum("blocks")).first()
        last = lambda right, w, left: F.array(F.struct(F.lit(0), F.lit(right), F.lit(w), F.lit(a + b), F.lit(left))).cast(_PATH)
        tree = nested(pool.select("stream", "weight", "blocks"))
        tree = tree.select(*(F.lit(0).cast("bigint").alias(c) for c in ("phase", "start")), F.col("path")[0].total.alias("size"), F.lit(0).cast("bigint").alias("before"), F.col("blocks").alias("count"), F.col("path")[0].weight.alias("weight"), "stream", F.lit(None).cast("array<bigint>").alias("slots"), F.concat("path", last(True, b, n)).alias("path"))
        steps, tree = steps.withColumn("path", last(False, a, m)), saved(tree, "tree")
        pool = pool.select("stream", F.ceil(F.col("n") / SHARD_DOCS).alias("shards"))
    laid_out = F.broadcast(spark.createDataFrame([(x,) for x in counts], "stream string"))

    def joined(rows: DataFrame, own: DataFrame, nested_: DataFrame | None) -> DataFrame:
        """The streams that are laid out, the largest among them, stay where they are; only rows of smaller ones are shuffled by stream."""
        out = rows.join(F.broadcast(own), "stream")
        return out if nested_ is None else out.unionByName(rows.join(laid_out, "stream", "left_anti").join(nested_, "stream"))

    placed = joined(named, sizes, pool).withColumn("_shard", F.pmod("_h", "shards"))
    each = placed.groupBy("stream", "_shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stream").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = each.select("stream", "_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("stream", "_shard").orderBy("_h", "doc_id"))
    nth = placed.withColumn("_n", within).join(offset, ["stream", "_shard"]).withColumn("_n", F.col("_n") + F.col("offset") - 1)
    nth = nth.withColumn("block", F.floor(F.col("_n") / block_docs)).withColumn("place", (F.col("_n") % block_docs).cast("int"))
    slot = joined(nth, steps, tree).where("block >= before AND block < before + count")
    j = F.col("block") - F.col("before")
    out = slot.select(
        *[c for c in docs.columns if c != "_row"],
        "stream",
        "block",
        F.col("phase"),
        F.floor(j * F.col("size") / F.col("weight")).alias("release"),
        F.ceil((j + 1) * F.col("size") / F.col("weight")).alias("due"),
        shared_slot(F.coalesce(F.col("start") + F.floor(j / F.col("weight")) * F.col("size") + F.expr("slots[cast((block - before) % weight AS int)]"), F.col("block")), "path").alias("slot"),
        "place",
    )
    return out.toDF(*named_as, *NEW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed_order(docs).select("doc_id", "source", "block", "phase", "release", "due", "slot", "place")
