"""Embedding near-dedup with NN-descent.

Vectors whose cosine to a leader is at least that of half the link angle are all linked with each other, so they form a ball that
needs no pairs: leaders are found in rounds of sign sketches, each bucket's smallest leader taking in what is close enough.
The leaders' neighbour graph is refined by NN-descent: lists start from blocks of sketch-sorted vectors, then each vector compares its
neighbours with each other (neighbours of neighbours), and every list keeps its best. A list whose last entry may still be
a link is saturated and doubles; a leader whose longest list is saturated is compared with all others. A brute-force audit of a sample
measures recall, and below the goal lists double, new orders come in and the descent goes on; where that does not reach the goal, all
leaders are compared. Edges within reach of a link are kept; where balls are involved, their members are compared in blocks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventara.llm.base import Scratch, checkpoint
from ventara.llm.components import components

#: Smallest cosine of a link, rounds and sign bits of the leader search.
COSINE, ROUNDS, BITS = 0.95, 8, 20

#: Neighbours of a list at first, sorted orders it starts from and rows of their blocks, and share of new links below which a turn is the last before an audit.
NEIGHBOURS, ORDERS, BLOCK, GROWTH = 6, 4, 64, 0.001

#: Vectors of an audit, recall to reach, and audits after which all leaders are compared.
AUDITED, RECALL, AUDITS = 200, 0.98, 4

#: Entries of the longest list, and leaders that are compared with all others at a time.
LONGEST, PART = 48, 1000

LIMIT = math.acos(COSINE)
#: A little inside half the angle, so that rounding never links two members of a ball wrongly.
TIGHT = math.cos(LIMIT / 2 - 1e-7)
SLACK = 1e-7


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _rows(column) -> list[np.ndarray]:
    """The arrays of a list column."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _sketch(rows: list[np.ndarray], seed: int) -> np.ndarray:
    """Sign bits of each vector against BITS random planes of its dimension; the dimension stands above them."""
    out = np.zeros(len(rows), np.int64)
    sizes = np.array([len(r) for r in rows])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        planes = np.random.default_rng([seed, int(d)]).standard_normal((int(d), BITS))
        bits = np.stack([rows[k] for k in at]).astype(np.float64) @ planes > 0
        out[at] = bits @ (1 << np.arange(BITS, dtype=np.int64)) + (int(d) << BITS)
    return out


def sketched(df: DataFrame, seed: int) -> DataFrame:
    """df (id, v) with its `sketch`."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_sketch(_rows(batch.column(1)), seed))], names=["id", "v", "sketch"])

    return df.select("id", "v").mapInArrow(run, "id bigint, v array<double>, sketch bigint")


def clean(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): unit vectors in double precision of the rows that can link; of a repeated id the smallest vector."""
    raw = df.select(df[id_column].cast("bigint").alias("id"), df[vector].cast("array<double>").alias("v")).where("id is not null and v is not null")
    raw = raw.groupBy("id").agg(F.min("v").alias("v")).where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    raw = raw.withColumn("top", F.array_max(F.transform("v", F.abs))).where("top > 0").withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    return raw.withColumn("size", F.sqrt(_dot("v", "v"))).select("id", F.transform("v", lambda x: x / F.col("size")).alias("v"))


def balls(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, leader, v, cos): leaders lead themselves, and have the smallest id of their ball; cos is that to the leader."""
    state = scratch.keep(vectors.select("id", F.col("id").alias("leader"), "v", F.lit(1.0).alias("cos")))
    for turn in range(ROUNDS):
        active = scratch.keep(sketched(state.where("id = leader"), turn))
        bosses = active.groupBy("sketch").agg(F.min("id").alias("boss"), F.count("*").alias("n")).where("n > 1").join(active.select(F.col("id").alias("boss"), F.col("v").alias("bv")), "boss")
        moves = scratch.keep(active.join(bosses.select("sketch", "boss", "bv"), "sketch").where(F.col("id") != F.col("boss")).where(_dot("v", "bv") >= TIGHT).select(F.col("id").alias("leader"), "boss", "bv"))
        stays, close = F.col("boss").isNull(), F.col("near") >= TIGHT
        moved = state.join(moves, "leader", "left").withColumn("near", F.when(F.col("boss").isNotNull(), _dot("v", "bv")))
        state = scratch.keep(moved.select(
            "id", F.when(stays, F.col("leader")).when(close, F.col("boss")).otherwise(F.col("id")).alias("leader"), "v",
            F.when(stays, F.col("cos")).when(close, F.col("near")).otherwise(1.0).alias("cos"),
        ))
    return state


def _best(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(src, dst, sim, rank) with the best `size` entries of each list."""
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).join(sizes.withColumnRenamed("id", "src"), "src").where(F.col("rank") <= F.col("size")).select("src", "dst", "sim", "rank")


def _block_edges(leaders: DataFrame, seed: int) -> DataFrame:
    """(src, dst, sim) between vectors of blocks of the sketch order: the best NEIGHBOURS in the block."""

    def run(batches):
        ids, rows = [], []

        def flush():
            src, dst, sims = [], [], []
            sizes = np.array([len(r) for r in rows])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                own, m = np.array(ids)[at], np.stack([rows[k] for k in at])
                near = m @ m.T
                np.fill_diagonal(near, -2)
                k = min(NEIGHBOURS, len(at) - 1)
                if k > 0:
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    src.append(np.repeat(own, k))
                    dst.append(own[best].ravel())
                    sims.append(np.take_along_axis(near, best, axis=1).ravel())
            ids.clear()
            rows.clear()
            cat = lambda x, t: pa.array(np.concatenate(x), t) if x else pa.array([], t)
            return pa.RecordBatch.from_arrays([cat(src, pa.int64()), cat(dst, pa.int64()), cat(sims, pa.float64())], names=["src", "dst", "sim"])

        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _rows(batch.column(1)), strict=True):
                ids.append(i)
                rows.append(row)
                if len(ids) == BLOCK:
                    yield flush()
        yield flush()

    ordered = sketched(leaders, seed).repartitionByRange("sketch", "id").sortWithinPartitions("sketch", "id")
    return ordered.select("id", "v").mapInArrow(run, "src bigint, dst bigint, sim double")


def _refined(graph: DataFrame, leaders: DataFrame, sizes: DataFrame) -> DataFrame:
    """(src, dst, sim): better entries found by comparing each vector's neighbours, in both directions, with each other.

    A list with free places takes any entry, a full one only those above its last.
    """
    listed = graph.groupBy("src").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    held = sizes.select("id", "size").join(listed.withColumnRenamed("src", "id"), "id", "left")
    bounds = held.select("id", "size", F.when(F.col("n") >= F.col("size"), F.col("worst")).otherwise(-2.0).alias("worst"))
    back = graph.withColumn("rank", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("sim"), "src"))).join(sizes.select(F.col("id").alias("dst"), "size"), "dst").where(F.col("rank") <= F.col("size"))
    own = graph.select("src").distinct().select(F.col("src").alias("v_id"), F.col("src").alias("u"))
    around = graph.select(F.col("src").alias("v_id"), F.col("dst").alias("u")).union(back.select(F.col("dst").alias("v_id"), F.col("src").alias("u"))).union(own).distinct()
    points = leaders.join(bounds, "id").select(F.col("id").alias("u"), F.transform("v", lambda x: x.cast("float")).alias("v"), "worst", "size")
    met = around.join(points, "u").groupBy("v_id").agg(F.collect_list(F.struct("u", "v", "worst", "size")).alias("met"))  # at most the list twice and itself

    def run(batches):
        for batch in batches:
            src, dst, sims = [], [], []
            for entries in batch.column(0):
                item = entries.values
                u, worst, size = (item.field(x).to_numpy() for x in ("u", "worst", "size"))
                m = item.field("v").flatten().to_numpy().reshape(len(u), -1)
                near = (m @ m.T).astype(np.float64)
                np.fill_diagonal(near, -2)
                # of these entries a list can take no more than its size
                top = np.zeros(near.shape, bool)
                np.put_along_axis(top, np.argsort(-near, axis=1), np.arange(len(u)) < size[:, None], axis=1)
                i, j = np.nonzero(top & (near > worst[:, None] + 1e-6))
                src.append(u[i])
                dst.append(u[j])
                sims.append(near[i, j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst)), pa.array(np.concatenate(sims))], names=["src", "dst", "sim"])

    return met.select("met").mapInArrow(run, "src bigint, dst bigint, sim double")


def _reach(a: str = "ra", b: str = "rb"):
    """Smallest cosine of two leaders whose balls can hold a link."""
    return F.cos(F.least(F.lit(LIMIT + SLACK) + F.col(a) + F.col(b), F.lit(math.pi)))


def descend(leaders: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """(a, b) with a < b: leaders (id, v, radius) whose balls may hold links; and the recall of the last audit, without the audits' own pairs.

    Ends when no list is saturated and the recall is reached. A saturated list of LONGEST entries is given up: its leader is
    compared with all. So are all leaders that are left when AUDITS audits stay below the recall.
    """
    radii = leaders.select("id", "radius")
    reach = lambda e, x, y: e.join(radii.select(F.col("id").alias(x), F.col("radius").alias("ra")), x).join(radii.select(F.col("id").alias(y), F.col("radius").alias("rb")), y).where(F.col("sim") >= _reach() - 1e-5)
    pairs = lambda e: e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    # whole: the leader has been compared with all
    sizes = scratch.keep(leaders.select("id", F.lit(NEIGHBOURS).alias("size"), F.lit(False).alias("whole")))
    graph = scratch.keep(_best(_starts(leaders, 0), sizes))
    links = scratch.keep(pairs(reach(graph, "src", "dst")).distinct())
    known, audit, extra = links.count(), 0, None
    while True:
        graph = scratch.keep(_best(graph.select("src", "dst", "sim").union(_refined(graph, leaders, sizes)), sizes))
        close = reach(graph, "src", "dst")
        links = scratch.keep(links.union(pairs(close)).distinct())
        full = close.groupBy("src").agg(F.count("*").alias("n")).join(sizes.withColumnRenamed("id", "src"), "src").where("n >= size and not whole").select(F.col("src").alias("id"), F.lit(True).alias("full"))
        held = scratch.keep(sizes.join(full, "id", "left").withColumn("due", F.col("full").isNotNull() & (F.col("size") >= LONGEST)))
        saturated, due = held.where("full").count(), held.where("due")
        if not due.isEmpty():
            links = scratch.keep(links.union(_compared(leaders, due, scratch)).distinct())
        longer = F.when(F.col("full") & ~F.col("due"), F.col("size") * 2).otherwise(F.col("size"))
        sizes = scratch.keep(held.select("id", longer.alias("size"), (F.col("whole") | F.col("due")).alias("whole")))
        before, known = known, links.count()
        if saturated or known - before > known * GROWTH:
            continue
        true = scratch.keep(_audited(leaders, audit))
        total = true.count()
        hit = true.join(links, ["a", "b"], "left_semi").count()
        recall = hit / total if total else 1.0
        extra = true if extra is None else extra.union(true)
        audit += 1
        if recall >= RECALL:
            return scratch.keep(links.union(extra).distinct()), recall
        if audit == AUDITS:
            return scratch.keep(links.union(_compared(leaders, sizes.where("not whole"), scratch)).distinct()), 1.0
        # longer lists, and new orders that bring what no neighbour of a neighbour leads to
        sizes = scratch.keep(sizes.select("id", F.least(F.col("size") * 2, F.lit(LONGEST)).alias("size"), "whole"))
        graph = scratch.keep(_best(graph.select("src", "dst", "sim").union(_starts(leaders, audit)), sizes))


def _starts(leaders: DataFrame, turn: int) -> DataFrame:
    """(src, dst, sim) of the blocks of ORDERS sorted orders, others at each turn."""
    parts = [_block_edges(leaders, 100 + turn * ORDERS + k) for k in range(ORDERS)]
    return reduce(DataFrame.union, parts)


def _audited(leaders: DataFrame, turn: int) -> DataFrame:
    """(a, b) of all pairs within reach that have one of AUDITED leaders (a bounded sample by hash), by brute force."""
    return _against(leaders, leaders.orderBy(F.xxhash64(F.lit(turn), "id"), "id").limit(AUDITED)).distinct()


def _compared(leaders: DataFrame, some: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of all pairs within reach that have a leader of `some` (id): about PART of these at a time with all leaders."""
    parts = max(1, -(-some.count() // PART))
    chosen = scratch.keep(leaders.join(some.select("id"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))))
    found = [scratch.keep(_against(leaders, chosen.where(F.col("part") == k)).distinct()) for k in range(parts)]
    return reduce(DataFrame.union, found)


def _against(leaders: DataFrame, few: DataFrame) -> DataFrame:
    """(a, b) of all pairs within reach of the leaders `few`, which are gathered, with all leaders."""
    by_size: dict[int, list] = {}
    for r in few.select("id", "v", "radius").collect():
        by_size.setdefault(len(r["v"]), []).append((r["id"], np.array(r["v"]), r["radius"]))
    packed = {d: (np.array([x[0] for x in own]), np.stack([x[1] for x in own]), np.array([x[2] for x in own])) for d, own in by_size.items()}
    held = leaders.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, PART):
                batch = whole.slice(start, PART)
                ids, rows, radii = batch.column(0).to_numpy(), _rows(batch.column(1)), batch.column(2).to_numpy()
                sizes = np.array([len(r) for r in rows])
                for d in np.unique(sizes):
                    if d not in held.value:
                        continue
                    at, (own, vectors, wide) = np.flatnonzero(sizes == d), held.value[d]
                    least = np.cos(np.minimum(LIMIT + SLACK + radii[at][:, None] + wide, math.pi))
                    i, j = np.nonzero((np.stack([rows[k] for k in at]) @ vectors.T >= least - 1e-9) & (ids[at][:, None] != own))
                    a, b = ids[at][i], own[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return leaders.select("id", "v", "radius").mapInArrow(run, "a bigint, b bigint")


def _member_links(links: DataFrame, members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(id, leader, other, n): links of each vector with the members of another ball, by the angles alone where they decide."""
    sides = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = leaders.select(F.col("id").alias("b"), F.col("v").alias("bv"), F.col("radius").alias("rb"), F.col("n").alias("nb"))
    met = members.select("id", "v", F.col("leader").alias("a")).join(sides.join(other, "b"), "a").withColumn("cos", _dot("v", "bv"))
    angle = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0)))
    alone = F.col("nb") == 1
    all_of = F.when(alone, F.col("cos") >= COSINE).otherwise(angle + F.col("rb") <= LIMIT - SLACK)
    none_of = F.when(alone, F.col("cos") < COSINE).otherwise(angle - F.col("rb") > LIMIT + SLACK)
    judged = met.withColumn("n", F.when(all_of, F.col("nb")).when(none_of, 0))
    sure = judged.where("n > 0").select("id", F.col("a").alias("leader"), F.col("b").alias("other"), "n")
    # the rest in blocks: vectors in doubt with all members of the ball
    parts = F.ceil(F.col("nb") / BLOCK)
    doubt = judged.where("n is null").groupBy("a", "b", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))
    packed = members.join(leaders.select(F.col("id").alias("leader"), F.col("n").alias("nb")), "leader").groupBy(F.col("leader").alias("b"), F.pmod(F.xxhash64("id"), parts).alias("block")).agg(F.collect_list("v").alias("ws"))
    both = doubt.drop("block").join(packed.drop("block"), "b").select("a", "b", "ids", "vs", "ws")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                near = np.array(row["vs"]) @ np.array(row["ws"]).T
                counts = (near >= COSINE).sum(axis=1)
                k = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array([row["a"]] * k, pa.int64()), pa.array([row["b"]] * k, pa.int64()), pa.array(counts, pa.int64())], names=["id", "leader", "other", "n"])

    return sure.union(both.mapInArrow(run, "id bigint, leader bigint, other bigint, n bigint").where("n > 0"))


def near_duplicates(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept, recall) of every row; the id column keeps its name.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do vectors of another length. Rows
    that repeat an id are one vector. Rows without id have null component_id and kept. `recall` is that of the last audit. Ids are
    whole numbers. The result is checkpointed; intermediate tables are removed.
    """
    scratch = Scratch(df.sparkSession, "vectors")
    members = balls(clean(df, id_column, vector), scratch)
    own = members.where("id = leader").select(F.col("id").alias("leader"), F.col("v").alias("lv"))
    stats = members.groupBy("leader").agg(F.count("*").alias("n"), F.max(F.acos(F.least("cos", F.lit(1.0)))).alias("radius"))
    leaders = scratch.keep(stats.join(own, "leader").select(F.col("leader").alias("id"), F.col("lv").alias("v"), "n", "radius"))
    links, recall = descend(leaders, scratch)
    found = scratch.keep(_member_links(links, members, leaders))
    roots = components(found.select(F.col("leader").alias("a"), F.col("other").alias("b")), scratch)
    counted = found.groupBy("id").agg(F.sum("n").alias("across"))
    placed = leaders.join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("leader"), "n", F.coalesce("component", "id").alias("component"))
    judged = members.select("id", "leader").join(placed, "leader").join(counted, "id", "left").select("id", (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"), "component")
    rows = df.select(df[id_column].alias("id")).join(judged, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    out = checkpoint(rows.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("recall")))
    scratch.drop()
    return out
