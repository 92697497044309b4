"""Near-duplicate embeddings by NN-descent, exact at the threshold, without laying out the pairs inside a group.

1. Equal vectors are one node. A forest of random hyperplanes deals nodes into small blocks; the best neighbours within
   blocks are the first neighbour lists.
2. Nodes within half the threshold's angle of a leader (the least node of what close edges connect) are that leader's
   class: any two of them are linked, so the class is counted, not laid out.
3. Rounds of NN-descent join the neighbours (both ways) of each leader with one another, where one of them is new, and
   keep the best. Lists are ordered by reach: the angle to a neighbour less the radius of its class, so a pair may matter
   where the reach is at most the threshold's angle and the own radius. Lists whose last entry may matter are saturated:
   they are enlarged and refined again. An audit of AUDIT leaders against all others measures recall of the pairs that may
   matter; below TARGET another forest and round are added, and after MOST_ROUNDS of these all leaders are compared.
4. Two classes whose leaders' angle, plus or minus both radii, settles the matter are linked as a whole or not at all;
   the others are compared member by member in blocks, in double precision.
5. An audit of AUDIT vectors against all measures recall of the links themselves; below LEAST all leaders are compared.

What the search sends around are codes: a byte for each component, and how far the code is from its vector. With that,
angles are taken too small rather than too large, and every pair that is kept is measured again in double precision.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, hub_join, saved, table
from .components import components

#: Cosine of a link; hyperplane trees; nodes of a block; neighbours kept from a block; length of lists at first.
LINK, TREES, BLOCK, NEAR, LENGTH = 0.9, 6, 256, 4, 6
#: Leaders and vectors that are audited, recall that ends the search, recall of links at least, rounds of NN-descent at
#: least, and at most with lists of one length; leaders that are compared with all others at once where these were not enough.
AUDIT, TARGET, LEAST, ROUNDS, MOST_ROUNDS, WHOLE = 256, 1.0, 0.9, 2, 6, 4096
_LEADERS = 3

Block = Callable[[pa.Table], pa.Table | None]


def runs(keys: list[str], work: Block):
    """A mapInArrow function that gives each run of rows with equal keys to `work`; rows must lie sorted by keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key = [], None

        def done() -> Iterator[pa.RecordBatch]:
            out = work(pa.Table.from_batches(open_)) if open_ else None
            if out is not None:
                yield from out.to_batches()

        for batch in batches:
            values = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
            start = 0
            for at in range(1, len(values) + 1):
                if at == len(values) or values[at] != values[start]:
                    if values[start] != key:
                        yield from done()
                        open_, key = [], values[start]
                    open_.append(batch.slice(start, at - start))
                    start = at
        yield from done()

    return run


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def code_of(unit: np.ndarray) -> bytes:
    """A unit vector as scale, distance from the code to the vector, and one byte a component."""
    scale = np.float32(np.abs(unit).max() / 127)
    steps = np.clip(np.rint(unit / scale), -127, 127)
    apart = float(np.linalg.norm(unit - steps * np.float64(scale)))
    return struct.pack("<ff", scale, apart * 1.0001 + 1e-6) + steps.astype(np.int8).tobytes()


def decoded(codes: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, distances) of codes of one length."""
    raw = [x.as_buffer() for x in codes]
    heads = np.array([struct.unpack_from("<ff", x) for x in raw], np.float32).reshape(-1, 2)
    steps = np.stack([np.frombuffer(x, np.int8, offset=8) for x in raw]) if raw else np.zeros((0, 1), np.int8)
    return steps * heads[:, :1], heads[:, 1].astype(np.float64)


def least_angles(x: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """For each two rows an angle that is not above that of their vectors."""
    slack = apart[:, None] + apart[None, :] + apart[:, None] * apart[None, :] + 4e-6
    return np.arccos(np.clip((x @ x.T).astype(np.float64) + slack, -1, 1))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, unit, code = [], [], []
        for x in batch["embedding"].to_pylist():
            v = np.array(x, np.float64) if x and None not in x else np.zeros(1)
            norm = float(np.sqrt(v @ v)) if np.isfinite(v).all() else 0.0
            if norm and not math.isfinite(norm) or not norm and np.isfinite(v).all() and np.any(v):  # the squares overflow or vanish, the vector does not
                v = v / np.abs(v).max()
                norm = float(np.sqrt(v @ v))
            if not norm:
                node.append(None), unit.append(None), code.append(None)
                continue
            one = v / norm + 0.0
            node.append(blake2b(one.tobytes(), digest_size=16).digest()), unit.append(one.tobytes()), code.append(code_of(one))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(node, pa.binary()), pa.array(unit, pa.binary()), pa.array(code, pa.binary())], ["vec_id", "node", "unit", "code"])


def _near(theta: float = -math.inf) -> Block:
    def work(t: pa.Table) -> pa.Table | None:
        """For each row of a block its NEAR neighbours of least reach there, and all that may matter; of pairs without a fresh row none."""
        nodes = t["node"].to_pylist()
        fresh = np.array(t["fresh"])
        if len(nodes) < 2 or not fresh.any():
            return None
        radius = np.array(t["radius"])
        reach = least_angles(*decoded(t["code"])) - radius[None, :]
        np.fill_diagonal(reach, np.inf)
        reach[~(fresh[:, None] | fresh[None, :])] = np.inf
        k = min(NEAR, len(nodes) - 1)
        keep = reach <= theta + radius[:, None]
        keep[np.arange(len(nodes))[:, None], np.argpartition(reach, k - 1, 1)[:, :k]] = True
        u, v = np.nonzero(keep & np.isfinite(reach))
        return pa.table({"node": pa.array([nodes[i] for i in u], pa.binary()), "v": pa.array([nodes[i] for i in v], pa.binary()), "reach": reach[u, v]})

    return work


_EDGE = "node binary, v binary, reach double"


def forest(nodes: DataFrame, seed: int, trees: int = TREES) -> DataFrame:
    """nodes(node, code, radius) -> (u, v, reach): near neighbours within the blocks of random hyperplane trees."""
    n = nodes.count()
    bits = max(1, math.ceil(math.log2(max(2, n / 100))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x.as_buffer()) - 8 for x in batch["code"]])
            block = np.zeros((batch.num_rows, trees), np.int64)
            for d in set(size.tolist()):  # vectors of one length meet only each other
                rows = np.flatnonzero(size == d)
                planes = np.random.default_rng([seed, d]).standard_normal((d, trees * bits))
                sign = (decoded(batch["code"].take(pa.array(rows)))[0] @ planes > 0).reshape(len(rows), trees, bits)
                block[rows] = (sign << np.arange(bits)).sum(2) + (d << bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "blocks"])

    dealt = nodes.select("node", "code", "radius").mapInArrow(deal, "node binary, code binary, radius double, blocks array<bigint>")
    dealt = saved(dealt, "dealt")
    # blocks of more than BLOCK nodes are dealt over parts, other parts in each tree
    each = dealt.select("node", F.posexplode("blocks").alias("tree", "block"))
    parts = each.groupBy("tree", "block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("tree", "block", F.ceil(F.col("n") / BLOCK).alias("parts"))
    # there are at most trees * n / BLOCK of these, a few bytes each; the optimizer decides whether to broadcast them
    each = dealt.select("node", "code", "radius", F.posexplode("blocks").alias("tree", "block")).join(parts, ["tree", "block"], "left")
    each = each.withColumn("part", F.pmod(F.xxhash64("node", "tree", F.lit(seed)), F.coalesce("parts", F.lit(1))))
    laid = each.select("tree", "block", "part", "node", "code", "radius", F.lit(True).alias("fresh")).repartition("tree", "block", "part").sortWithinPartitions("tree", "block", "part")
    return laid.mapInArrow(runs(["tree", "block", "part"], _near()), _EDGE).withColumnRenamed("node", "u")


def lists(edges: DataFrame, length: int) -> DataFrame:
    """(u, v, reach, old) -> (u, near array<struct<reach, v, old>>), the best `length` of each u first."""
    each = edges.groupBy("u", "v").agg(F.min("reach").alias("reach"), F.max("old").alias("old")).groupBy("u").agg(F.collect_list(F.struct("reach", "v", "old")).alias("near"))
    return each.select("u", F.slice(F.sort_array("near"), 1, length).alias("near"))


def descended(near: DataFrame, nodes: DataFrame, length: int, theta: float) -> DataFrame:
    """One round: neighbours of neighbours, through forward and reverse lists, that are better than what a list holds.

    Only pairs with an entry that is not old are met; afterwards entries that were there before are old.
    """
    forward = near.select("u", F.inline("near")).select("u", "v", (~F.col("old")).alias("fresh"))
    # a node that very many list takes as many of them as its own list is long; they reach it by their other neighbours
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u")))
    back = forward.withColumn("rank", rank).where(F.col("rank") <= length).select(F.col("v").alias("hub"), F.col("u").alias("node"), "fresh")
    around = forward.select(F.col("u").alias("hub"), F.col("v").alias("node"), "fresh").unionByName(back).unionByName(near.select(F.col("u").alias("hub"), F.col("u").alias("node"), F.lit(False).alias("fresh")))
    # at most 2 * length + 1 ids, and nothing to do where all of them have met
    groups = around.groupBy("hub").agg(F.collect_list(F.struct("node", "fresh")).alias("all")).where(F.exists("all", lambda x: x.fresh))
    met = groups.select("hub", F.inline("all")).groupBy("hub", "node").agg(F.max("fresh").alias("fresh")).join(nodes.select("node", "code", "radius"), "node")
    met = met.select("hub", "node", "code", "radius", "fresh").repartition("hub").sortWithinPartitions("hub")
    found = met.mapInArrow(runs(["hub"], _near(theta)), _EDGE).withColumnRenamed("node", "u").withColumn("old", F.lit(False))
    return saved(lists(found.unionByName(near.select("u", F.inline("near")).select("u", "v", "reach", F.lit(True).alias("old"))), length), "near")


def _needed(asked: list[tuple[bytes, np.ndarray, float]], theta: float):
    """A mapInArrow function over (node, unit, radius): the pairs with an asked node that may matter, and their angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {len(q) for _, q, _ in asked}
        chosen = {d: [x for x in asked if len(x[1]) == d] for d in sizes}
        others = {d: np.stack([q for _, q, _ in chosen[d]]).T for d in sizes}
        radii = {d: np.array([r for _, _, r in chosen[d]]) for d in sizes}
        for batch in batches:
            u, v, angle = [], [], []
            units = [np.frombuffer(b.as_buffer(), np.float64) for b in batch["unit"]]
            node, radius = batch["node"].to_pylist(), np.array(batch["radius"])
            for d in {len(x) for x in units} & sizes:
                rows = [k for k, x in enumerate(units) if len(x) == d]
                near = np.arccos(np.clip(np.stack([units[k] for k in rows]) @ others[d], -1, 1))
                for i, j in zip(*np.nonzero(near <= theta + radius[rows][:, None] + radii[d] + 1e-9), strict=True):
                    if node[rows[i]] != chosen[d][j][0]:
                        u.append(chosen[d][j][0]), v.append(node[rows[i]]), angle.append(float(near[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(angle, pa.float64())], ["u", "v", "angle"])

    return run


_PAIR = "u binary, v binary, angle double"


def _shared(rows: DataFrame):
    """A bounded number of nodes, for all executors."""
    return rows.sparkSession.sparkContext.broadcast([(bytes(r.node), np.frombuffer(r.unit, np.float64), r.radius) for r in rows.select("node", "unit", "radius").collect()])


def recall(near: DataFrame, nodes: DataFrame, theta: float) -> tuple[float, int]:
    """(share of the pairs of AUDIT nodes that may matter which either list holds, number of these), by comparing them with all nodes."""
    shared = _shared(nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT))
    true = nodes.select("node", "unit", "radius").mapInArrow(lambda batches: _needed(shared.value, theta)(batches), _PAIR).select("u", "v")
    one = near.select("u", F.explode("near.v").alias("v"))
    held = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().withColumn("held", F.lit(1))
    got = true.join(held, ["u", "v"], "left").agg(F.count("*").alias("n"), F.count("held").alias("held")).first()
    return (got.held / got.n if got.n else 1.0), got.n


def compared(nodes: DataFrame, theta: float) -> DataFrame:
    """nodes(node, unit, radius) -> (u, near): every pair that may matter, in the list of one of its nodes.

    WHOLE nodes at a time are compared with all nodes, so this takes a time quadratic in the nodes, but neither a
    shuffle nor more memory.
    """
    parts = max(1, math.ceil(nodes.count() / WHOLE))
    nodes = nodes.select("node", "unit", "radius")
    found = None
    for k in range(parts):
        shared = _shared(nodes.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == k))
        pairs = saved(nodes.mapInArrow(lambda batches, s=shared: _needed(s.value, theta)(batches), _PAIR).where("u < v"), "compared")
        shared.unpersist()
        found = pairs if found is None else found.unionByName(pairs)
    return saved(found.groupBy("u").agg(F.collect_list(F.struct((F.lit(-math.inf)).alias("reach"), "v", F.lit(True).alias("old"))).alias("near")), "near")


def neighbour_lists(nodes: DataFrame, theta: float, first: DataFrame | None = None) -> DataFrame:
    """nodes(node, unit, code, radius) -> (u, near): refined until no list is saturated and the audit holds.

    first: edges (u, v, reach) to begin with; by default those of a forest. A list is saturated if its last entry may
    matter, so that one more might; no other pair ever does. Lists are never given back without an audit that holds:
    where MOST_ROUNDS rounds after the last enlargement have not brought that about, all nodes are compared.
    """
    length, turn, since = LENGTH, 0, 0
    fresh = lambda edges: edges.withColumn("old", F.lit(False))
    near = saved(lists(fresh(forest(nodes, 1) if first is None else first), length), "near")
    while True:
        turn, since, before = turn + 1, since + 1, near
        near = descended(near, nodes, length, theta)
        discard(before)
        if turn < ROUNDS:
            continue
        own = near.join(nodes.select(F.col("node").alias("u"), "radius"), "u")
        if not own.where((F.size("near") >= length) & (F.element_at("near", -1).reach <= theta + F.col("radius"))).isEmpty():
            length, since = 2 * length, 0
            near = near.select("u", F.transform("near", lambda x: x.withField("old", F.lit(False))).alias("near"))
        elif recall(near, nodes, theta)[0] >= TARGET:
            return near
        elif since >= MOST_ROUNDS:
            return compared(nodes, theta)
        else:
            near = lists(near.select("u", F.inline("near")).unionByName(fresh(forest(nodes, turn + 1)).select("u", "reach", "v", "old")), length)
        near = saved(near, "near")


def classes(nodes: DataFrame, edges: DataFrame, link: float) -> DataFrame:
    """nodes(node, unit, n), edges(u, v, reach) -> (node, leader, angle): angle to the leader, at most half a link's."""
    half = math.cos(math.acos(link) / 2) + 1e-9
    close = saved(edges.where(F.col("reach") <= math.acos(half)).select("u", "v"), "close")
    part = components(close)
    left = saved(part.join(nodes.select("node", "unit"), "node").select("node", "component", "unit"), "left")
    out = None
    for _ in range(_LEADERS):
        lead = left.groupBy("component").agg(F.min_by(F.struct("node", "unit"), "node").alias("lead"), F.count("*").alias("n"))
        placed = hub_join(left, saved(lead, "leads"), "component", "n").select("node", "component", "unit", F.col("lead.node").alias("leader"), F.col("lead.unit").alias("other")).mapInArrow(_angles, "node binary, component binary, unit binary, leader binary, cos double")
        placed = saved(placed, "placed")
        fit = placed.where(F.col("cos") >= half).select("node", "leader", F.acos(F.least(F.lit(1.0), "cos")).alias("angle"))
        out = fit if out is None else out.unionByName(fit)
        left = placed.where(F.col("cos") < half).select("node", "component", "unit")
        if left.isEmpty():
            break
    alone = nodes.select("node").join(out.select("node"), "node", "left_anti").select("node", F.col("node").alias("leader"), F.lit(0.0).alias("angle"))
    return saved(out.unionByName(alone), "classes")


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cos = [1.0 if n == m else float(np.frombuffer(a.as_buffer()) @ np.frombuffer(b.as_buffer())) for n, m, a, b in zip(batch["node"].to_pylist(), batch["leader"].to_pylist(), batch["unit"], batch["other"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["node"], batch["component"], batch["unit"], batch["leader"], pa.array(cos, pa.float64())], ["node", "component", "unit", "leader", "cos"])


def _pairs(link: float) -> Block:
    def work(t: pa.Table) -> pa.Table | None:
        """Links of each asked member with the members of another class: their number, counted with copies."""
        asks = np.array(t["asks"])
        if asks.all() or not asks.any():
            return None
        x, n = vectors(t["unit"]), np.array(t["n"])
        node = t["node"].to_pylist()
        count = (x[asks] @ x[~asks].T >= link) @ n[~asks]
        rows = np.flatnonzero(asks)[count > 0]
        return pa.table({"node": pa.array([node[k] for k in rows], pa.binary()), "other": pa.array([t["other"][0].as_py()] * len(rows), pa.binary()), "n": count[count > 0]})

    return work


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        angle = [float(np.arccos(np.clip(np.frombuffer(a.as_buffer()) @ np.frombuffer(b.as_buffer()), -1, 1))) for a, b in zip(batch["a"], batch["b"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(angle, pa.float64())], ["u", "v", "angle"])


def linked_vectors(rows: DataFrame, link: float = LINK) -> DataFrame:
    """rows(vec_id, embedding) -> vec_id, n_links, component_id, kept, recall: one row per row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and no vector links with
    one of another length. Equal vectors, repeated rows included, are linked and count each other. recall is the share of
    the links of AUDIT vectors, compared with all, that were found. Other columns are ignored; an empty table gives an
    empty one.
    """
    named = saved(rows.select("vec_id", "embedding").mapInArrow(_nodes, "vec_id bigint, node binary, unit binary, code binary"), "vectors")
    nodes = saved(named.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id"), F.first("unit").alias("unit"), F.first("code").alias("code"), F.lit(0.0).alias("radius")), "nodes")
    first = saved(forest(nodes, 0), "first")
    member = classes(nodes, first, link)
    for whole in (False, True):
        per = saved(_links(nodes, first, member, link, whole), "links")
        held = link_recall(nodes, per, link)
        if held >= LEAST:
            break
    per = saved(per.join(nodes.select("node", "n"), "node"), "per")
    out = hub_join(named.select("vec_id", "node"), per, "node", "n", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(held))


def link_recall(nodes: DataFrame, per: DataFrame, link: float) -> float:
    """The share of the links of AUDIT vectors that per(node, n_links) has, by comparing them with all vectors."""
    shared = _shared(nodes.orderBy(F.xxhash64("node", F.lit("links")), "node").limit(AUDIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            units, n = [np.frombuffer(b.as_buffer(), np.float64) for b in batch["unit"]], np.array(batch["n"])
            for d in {len(x) for x in units}:
                rows = [k for k, x in enumerate(units) if len(x) == d]
                mine = [k for k, x in enumerate(asked) if len(x[1]) == d]
                if mine:
                    count = n[rows] @ (np.stack([units[k] for k in rows]) @ np.stack([asked[k][1] for k in mine]).T >= link)
                    yield pa.RecordBatch.from_arrays([pa.array([asked[k][0] for k in mine], pa.binary()), pa.array(count.astype(np.int64))], ["node", "n"])

    true = nodes.select("unit", "n").mapInArrow(run, "node binary, n bigint").groupBy("node").agg((F.sum("n") - 1).alias("true"))
    got = true.join(per.select("node", "n_links"), "node").agg(F.sum("true").alias("true"), F.sum(F.least("true", "n_links")).alias("held")).first()
    return got.held / got.true if got.true else 1.0


def _links(nodes: DataFrame, first: DataFrame, member: DataFrame, link: float, all_pairs: bool) -> DataFrame:
    """(node, n_links, component_id) of nodes(node, n, vec_id, unit, code), member(node, leader, angle)."""
    theta = math.acos(link)
    of = member.join(nodes, "node").select("node", "leader", "angle", "n", "vec_id")
    size = saved(of.groupBy("leader").agg(F.max("angle").alias("radius"), F.sum("n").alias("size"), F.count("*").alias("members"), F.min("vec_id").alias("least")), "sizes")
    leaders = size.join(nodes.select(F.col("node").alias("leader"), "unit", "code"), "leader")
    leaders = saved(leaders.select(F.col("leader").alias("node"), "unit", "code", "radius"), "leaders")
    if all_pairs:
        near = compared(leaders, theta)
    else:  # what the first forest says of leaders
        own = lambda c: leaders.select(F.col("node").alias(c), F.col("radius").alias(f"r{c}"))
        begun = first.join(own("u"), "u").join(own("v"), "v").select("u", "v", (F.col("reach") - F.col("rv")).alias("reach"))
        near = neighbour_lists(leaders, theta, begun)

    # classes that may be linked, from either side's list, measured
    radius = leaders.select("node", "radius")
    pairs = near.select("u", F.inline("near")).join(radius.withColumnRenamed("node", "u"), "u").where(F.col("reach") <= theta + F.col("radius") + 1e-9)
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    unit = lambda c, x: leaders.select(F.col("node").alias(c), F.col("unit").alias(x))
    pairs = pairs.join(unit("u", "a"), "u").join(unit("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(_measured, _PAIR)
    pairs = pairs.join(size.select(F.col("leader").alias("u"), F.col("radius").alias("ru"), F.col("size").alias("nu")), "u").join(size.select(F.col("leader").alias("v"), F.col("radius").alias("rv"), F.col("size").alias("nv")), "v")
    spread = F.col("ru") + F.col("rv")
    pairs = saved(pairs.where(F.col("angle") - spread <= theta + 1e-9).withColumn("whole", F.col("angle") + spread <= theta - 1e-9), "pairs")
    whole = pairs.where("whole")
    sums = whole.select(F.col("u").alias("leader"), F.col("nv").alias("n")).unionByName(whole.select(F.col("v").alias("leader"), F.col("nu").alias("n"))).groupBy("leader").agg(F.sum("n").alias("whole"))

    # the others, member by member, in blocks of both classes
    open_ = pairs.where("NOT whole").withColumns({"i": F.explode(F.sequence(F.lit(0), F.ceil(F.col("nu") / BLOCK).cast("int") - 1))})
    open_ = open_.withColumn("j", F.explode(F.sequence(F.lit(0), F.ceil(F.col("nv") / BLOCK).cast("int") - 1)))
    both = open_.select("u", "v", "i", "j", F.col("nu").alias("na"), F.col("nv").alias("nb")).unionByName(open_.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("j").alias("i"), F.col("i").alias("j"), F.col("nv").alias("na"), F.col("nu").alias("nb")))
    full = of.join(nodes.select("node", "unit"), "node")
    at = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))
    dealt = full.join(size.select("leader", "size"), "leader").select("leader", at.cast("int").alias("part"), "node", "n", "unit")
    ask = both.join(dealt, (F.col("u") == F.col("leader")) & (F.col("i") == F.col("part"))).select("u", "v", "i", "j", F.col("v").alias("other"), "node", "n", "unit", F.lit(True).alias("asks"))
    there = both.join(dealt, (F.col("v") == F.col("leader")) & (F.col("j") == F.col("part"))).select("u", "v", "i", "j", F.col("v").alias("other"), "node", "n", "unit", F.lit(False).alias("asks"))
    keys = ["u", "v", "i", "j"]
    single = saved(ask.unionByName(there).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(runs(keys, _pairs(link)), "node binary, other binary, n bigint"), "single")

    edges = whole.select("u", "v").unionByName(single.join(member.select("node", "leader"), "node").select(F.col("leader").alias("u"), F.col("other").alias("v")).distinct())
    found = saved(components(edges).join(size.select(F.col("leader").alias("node"), "least"), "node"), "found")
    least = saved(found.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    linked = hub_join(found.select("node", "component"), least, "component", "n").select(F.col("node").alias("leader"), "component_id")
    groups = size.select("leader", "size", "members", "least").join(linked, "leader", "left").join(sums, "leader", "left")
    groups = saved(groups.select("leader", "members", (F.col("size") - 1 + F.coalesce("whole", F.lit(0))).alias("links"), F.coalesce("component_id", "least").alias("component_id")), "groups")
    more = single.groupBy("node").agg(F.sum("n").alias("more"))
    return hub_join(member.select("node", "leader"), groups, "leader", "members").join(more, "node", "left").select("node", (F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))
