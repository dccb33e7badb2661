"""The trie of all conversation prefixes, built as a z-fast trie.

A conversation is a path of turns. Its prefixes are known by 128-bit keys, sums of hashes of turn and position, which a running sum over
range-sorted rows gives for conversations of any length. An end mark behind the last turn makes every distinct conversation a leaf.

The trie is compacted: a node stands for the edge of depths (p, j] on the path of one conversation, and it is found under its handle, the
prefix whose length is the two-fattest number in (p, j]. Conversations are inserted in batches. Each locates its exit node by fat binary
search, one join with the handles a step, then the depth m at which it leaves that node's edge. Of those that leave at one point by one
turn a leader is inserted as a leaf; the others leave the leader's path further down and go on from there, until all are inserted. A leaf
owns the depths below its m, so the edges are the owned paths cut where others leave. At the end the edges are expanded to prefixes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventara.llm.base import Scratch

#: Prefix keys stored in a row.
BLOCK = 64
#: One in so many conversations is in the first batch, the others are in the second.
FIRST = 8
#: Ids written as one block before the last digest of a group of equal conversations.
IDS = 5000

_EMPTY = hashlib.sha256(b"").hexdigest()


# --- running sums over range-sorted rows -----------------------------------------------------


def running(df: DataFrame, group: str, order: list[str], lanes: list[str], keep: list[str], scratch: Scratch) -> DataFrame:
    """The columns group, `keep` and `lanes` (long) of df, the lanes as running sums, modulo 2**64, within group in the given order.

    Rows are range-partitioned by group and the first of the order, so a group may span tasks. Each task sums its part; a partition
    shares at most one group with the one before it, so what came before is a list as short as that of the partitions.
    """
    rest = [group, *keep]
    kept = df.repartitionByRange(group, order[0]).sortWithinPartitions(group, *order).select(*rest, *lanes)
    names, n = [*rest, *lanes, "pid", "row"], len(rest)

    def scan(batches):
        last, carry, rows = None, np.zeros(len(lanes), np.uint64), 0
        pid = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            lengths = np.diff(np.append(starts, len(groups)))
            sums = []
            for k in range(len(lanes)):
                cum = np.cumsum(batch.column(n + k).to_numpy(zero_copy_only=False).view(np.uint64), dtype=np.uint64)
                before = np.where(starts > 0, cum[starts - 1], np.uint64(0))
                if groups[0] == last:
                    before[0] -= carry[k]
                sums.append(cum - np.repeat(before, lengths))
            last, carry = groups[-1], np.array([x[-1] for x in sums], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(x.view(np.int64)) for x in sums), pa.array(np.full(len(groups), pid)), pa.array(np.arange(rows, rows + len(groups)))], names=names)
            rows += len(groups)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    local = scratch.keep(kept.mapInArrow(scan, schema + ", pid long, row long"))
    ends = local.groupBy(group, "pid").agg(F.max_by(F.struct(*lanes), "row").alias("end"))
    spans = ends.join(ends.groupBy(group).agg(F.count("*").alias("n")).where("n > 1"), group).select(group, "pid", "end.*")
    offsets: dict = {}
    sums: dict = {}
    for r in sorted(spans.collect(), key=lambda r: r["pid"]):
        before = sums.get(r[group], [0] * len(lanes))
        if any(before):
            offsets.setdefault(r["pid"], {})[r[group]] = before
        sums[r[group]] = [(x + r[c]) % 2**64 for x, c in zip(before, lanes, strict=True)]
    if not offsets:
        return local.drop("pid", "row")

    def shift(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).view(np.uint64).copy() for c in batch.columns[n : n + len(lanes)]]
            groups, pids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(n + len(lanes)).to_numpy()
            for pid in np.unique(pids).tolist():
                for key, before in offsets.get(pid, {}).items():
                    at = (pids == pid) & (groups == key)
                    for c, x in zip(columns, before, strict=True):
                        c[at] += np.uint64(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c.view(np.int64)) for c in columns)], names=names[:-2])

    return scratch.keep(local.mapInArrow(shift, schema))


# --- conversations as paths of keys ----------------------------------------------------------


def head_length(conversation: Column) -> Column:
    """How many turns a rebuilt conversation takes from its base."""
    return F.crc32(conversation.cast("string").cast("binary")) % 9


def rebuilt(df: DataFrame, scratch: Scratch, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, d, digest, bytes): the turns of every rebuilt conversation by depth from 1 on, and an end mark (empty digest) behind them."""
    told = df.select(df[conversation].cast("long").alias("c"), df[turn].alias("t"), F.coalesce(df[role].cast("string"), F.lit("")).alias("r"), F.coalesce(df[text], F.lit("")).alias("x")).where("c is not null")
    digest = F.md5(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "x").cast("binary"))
    told = told.select("c", "t", "r", "x", digest.alias("digest"), F.octet_length("x").cast("long").alias("bytes"), F.lit(1).cast("long").alias("pos"))
    own = running(told, "c", ["t", "r", "x"], ["pos"], ["digest", "bytes"], scratch)  # texts serve the order of ties only
    sizes = own.groupBy("c").agg(F.count("*").alias("n"))
    convs = sizes.select("c", "n", head_length(F.col("c")).alias("h"), (F.col("c") - F.col("c") % 5).alias("base"))
    convs = scratch.write(convs.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("nb")), "base", "left").select("c", "n", "h", "base", F.least("h", F.coalesce("nb", F.lit(0))).alias("taken")), "convs")
    heads = convs.join(own.where("pos <= 8").withColumnRenamed("c", "base"), "base").where("pos <= h").select("c", F.col("pos").alias("d"), "digest", "bytes")
    tails = own.join(convs.select("c", "h", "taken"), "c").where("pos > h").select("c", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "digest", "bytes")
    ends = convs.select("c", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)) + 1).alias("d"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return heads.union(tails).union(ends)


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, d, last, bytes, k1, k2, cum): the key of every prefix, bytes of its last turn and of all, and whether it ends with the end mark."""
    hashed = turns.select("c", "d", (F.col("digest") == "").alias("last"), F.xxhash64("d", "digest").alias("k1"), F.xxhash64("digest", "d", F.lit("second")).alias("k2"), "bytes", F.col("bytes").alias("cum"))
    return running(hashed, "c", ["d"], ["k1", "k2", "cum"], ["d", "last", "bytes"], scratch)


# --- the compacted trie ----------------------------------------------------------------------

FATTEST = "shiftleft(shiftright({b}, length(bin({a} ^ {b})) - 1), length(bin({a} ^ {b})) - 1)"


def fattest(a: str, b: str) -> Column:
    """The number in (a, b] that the highest power of two divides."""
    return F.expr(FATTEST.format(a=a, b=b))


class Paths:
    """Prefix keys of the distinct conversations, BLOCK depths a row: (s, b, a array<struct<k1, k2, bytes, cum>>)."""

    def __init__(self, steps: DataFrame, scratch: Scratch):
        cell = F.struct("d", F.struct("k1", "k2", "bytes", "cum").alias("v"))
        packed = steps.groupBy("s", F.floor((F.col("d") - 1) / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(cell)).alias("a"))
        self.blocks = scratch.write(packed.select("s", "b", F.transform("a", lambda x: x["v"]).alias("a")), "blocks")

    def at(self, df: DataFrame, owner: str, depth: Column, names: dict[str, str]) -> DataFrame:
        """df with fields of the key that the path of `owner` has at a depth; null beyond the path."""
        held = self.blocks.select(F.col("s").alias("_s"), F.col("b").alias("_b"), "a")
        out = df.withColumn("_at", depth)
        out = out.join(held, (F.col(owner) == F.col("_s")) & (F.floor((F.col("_at") - 1) / BLOCK) == F.col("_b")), "left")
        cell = F.get("a", F.pmod(F.col("_at") - 1, F.lit(BLOCK)).cast("int"))
        return out.withColumns({name: cell[field] for name, field in names.items()}).drop("_s", "_b", "_at", "a")

    def shared(self, df: DataFrame, other: str, low: Column, high: Column, name: str) -> DataFrame:
        """df (one row per s) with the depth down to which s and `other` agree, who agree down to `low`, looked for up to `high`."""
        asked = df.select("s", F.col(other).alias("_o"), low.alias("_low"), high.alias("_high")).where("_o is not null and _low < _high")
        asked = asked.select("*", F.explode(F.sequence(F.floor(F.col("_low") / BLOCK), F.floor((F.col("_high") - 1) / BLOCK))).alias("b"))
        left = asked.join(self.blocks.withColumnRenamed("a", "_x"), ["s", "b"])
        both = left.join(self.blocks.select(F.col("s").alias("_o"), "b", F.col("a").alias("_y")), ["_o", "b"])
        same = F.size(F.filter(F.arrays_zip("_x", "_y"), lambda z: (z["_x"]["k1"] == z["_y"]["k1"]) & (z["_x"]["k2"] == z["_y"]["k2"])))
        depth = both.withColumn("_same", same).where("_same > 0").groupBy("s").agg(F.max(F.col("b") * BLOCK + F.col("_same")).alias(name))
        return df.join(depth, "s", "left").withColumn(name, F.greatest(F.least(F.coalesce(name, low), high), low))


def edges(leaves: DataFrame, paths: Paths, scratch: Scratch) -> DataFrame:
    """(rep, p, j, f, h1, h2, c1, c2, cp, cj): the compacted nodes, with the keys of their handles and first turns, and bytes at both ends."""
    cuts = leaves.select("s", F.col("m").alias("cut")).union(leaves.where("host is not null").select("host", "m")).union(leaves.select("s", "len")).distinct()
    spans = cuts.withColumn("p", F.lag("cut").over(Window.partitionBy("s").orderBy("cut"))).where("p is not null").select(F.col("s").alias("rep"), "p", F.col("cut").alias("j"), fattest("p", "cut").alias("f"))
    out = paths.at(spans, "rep", F.col("f"), {"h1": "k1", "h2": "k2"})
    out = paths.at(out, "rep", F.col("p") + 1, {"c1": "k1", "c2": "k2"})
    out = paths.at(paths.at(out, "rep", F.col("p"), {"cp": "cum"}), "rep", F.col("j"), {"cj": "cum"})
    return scratch.keep(out.withColumn("cp", F.coalesce("cp", F.lit(0).cast("long"))))


def locate(batch: DataFrame, nodes: DataFrame, paths: Paths, longest: int, scratch: Scratch) -> DataFrame:
    """(s, len, m, host): the depth at which each conversation leaves the trie and the owner of the path it leaves; no host at the root."""
    none = F.lit(None).cast("long")
    state = batch.select("s", "len", F.lit(0).cast("long").alias("lo"), F.col("len").alias("hi"), none.alias("rep"), none.alias("j"))
    handles = nodes.select(F.col("f").alias("nf"), "h1", "h2", F.col("rep").alias("nrep"), F.col("j").alias("nj"))
    for _ in range(longest.bit_length()):  # each step settles a bit of the depth
        probe = paths.at(state.where("lo < hi").withColumn("f", fattest("lo", "hi")), "s", F.col("f"), {"k1": "k1", "k2": "k2"})
        hit = probe.join(handles, (F.col("f") == F.col("nf")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
        moved = hit.select("s", "len", F.coalesce("nj", "lo").alias("lo"), F.when(F.col("nf").isNull(), F.col("f") - 1).otherwise(F.col("hi")).alias("hi"), F.coalesce("nrep", "rep").alias("rep"), F.coalesce("nj", "j").alias("j"))
        state = scratch.keep(moved.union(state.where("lo >= hi")))
    zero = F.lit(0).cast("long")
    found = paths.shared(state, "rep", zero, F.least("len", F.coalesce("j", zero)), "m")
    through = scratch.keep(found.select("s", "len", "m", "rep", (F.col("rep").isNull() | (F.col("m") == F.col("j"))).alias("on")))
    firsts = nodes.select((F.col("p") + 1).alias("np"), "c1", "c2", F.col("rep").alias("child"), F.col("j").alias("cj"))
    asked = paths.at(through.where("on"), "s", F.col("m") + 1, {"k1": "k1", "k2": "k2"})
    below = asked.join(firsts, (F.col("m") + 1 == F.col("np")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").select("s", "len", "m", "rep", "child", "cj")
    below = scratch.keep(below.union(through.where("not on").select("s", "len", "m", "rep", none, none)))
    deeper = paths.shared(below, "child", F.col("m"), F.least("len", F.coalesce("cj", "m")), "m2")
    return deeper.select("s", "len", F.col("m2").alias("m"), F.coalesce("child", "rep").alias("host"))


def insert(located: DataFrame, paths: Paths, scratch: Scratch) -> list[DataFrame]:
    """Leaves (s, len, m, host) for all located conversations, round by round of leaders."""
    leaves, rest = [], located
    while True:
        rest = scratch.keep(paths.at(rest, "s", F.col("m") + 1, {"g1": "k1", "g2": "k2"}))
        if rest.isEmpty():
            return leaves
        led = rest.groupBy("m", "g1", "g2").agg(F.min_by(F.struct("s", "len", "host"), F.struct(F.xxhash64("s"), F.col("s"))).alias("l"))
        led = scratch.keep(led.select("m", "g1", "g2", F.col("l.s").alias("leader"), F.col("l.len").alias("reach"), "l.host"))
        leaves.append(led.select(F.col("leader").alias("s"), F.col("reach").alias("len"), "m", "host"))
        others = rest.drop("host").join(led.drop("host"), ["m", "g1", "g2"]).where("s <> leader")
        rest = paths.shared(scratch.keep(others), "leader", F.col("m"), F.least("len", "reach"), "m2").select("s", "len", F.col("m2").alias("m"), F.col("leader").alias("host"))


# --- what the nodes say ----------------------------------------------------------------------


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, k1, k2, ends_sha256): SHA-256 of the ids of equal conversations (c, d, k1, k2), rising and joined by commas.

    Ids are joined to blocks where they were sorted; the digest then runs over a group's blocks one by one.
    """
    by = ["d", "k1", "k2"]

    def join(batches):
        key, ids = None, []
        for batch in batches:
            out = []
            for *own, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if ids and (own != key or len(ids) >= IDS):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = own
                ids.append(c)
            yield _rows(out, [pa.int64()] * 4 + [pa.string()], [*by, "first", "ids"])
        if ids:
            yield _rows([(*key, ids[0], ",".join(map(str, ids)))], [pa.int64()] * 4 + [pa.string()], [*by, "first", "ids"])

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _rows(out, [pa.int64()] * 3 + [pa.string()], [*by, "ends_sha256"])
        if key:
            yield _rows([(*key, sha.hexdigest())], [pa.int64()] * 3 + [pa.string()], [*by, "ends_sha256"])

    blocks = ends.select(*by, "c").repartitionByRange(*by, "c").sortWithinPartitions(*by, "c").mapInArrow(join, "d long, k1 long, k2 long, first long, ids string")
    return blocks.repartition(*by).sortWithinPartitions(*by, "first").select(*by, "ids").mapInArrow(digest, "d long, k1 long, k2 long, ends_sha256 string")


def _rows(rows: list, kinds: list, names: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


def prefix_trie(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct prefix: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns are ordered by turn (nulls first), then role, then text; null roles and texts are empty, repeated rows are turns of their own,
    rows without conversation are left out. Conversations without turns after rebuilding are members of the root only. An empty table
    has no rows. Ids are whole numbers.
    """
    scratch = Scratch(df.sparkSession, "trie")
    steps = prefixes(rebuilt(df, scratch, conversation, turn, role, text), scratch)
    ends = steps.where("last")
    seqs = scratch.write(ends.groupBy("d", "k1", "k2").agg(F.min("c").alias("s"), F.count("*").alias("copies")), "seqs")
    size = seqs.agg(F.max("d").alias("longest"), F.count("*").alias("n")).first()
    own = scratch.write(steps.join(seqs.select(F.col("s").alias("c")), "c", "left_semi").select(F.col("c").alias("s"), "d", "k1", "k2", "bytes", "cum"), "paths")
    paths = Paths(own, scratch)

    whole = seqs.select("s", F.col("d").alias("len"))
    early = F.pmod(F.xxhash64(F.lit(FIRST), F.col("s")), F.lit(FIRST)) == 0
    start = whole.where(early).select("s", "len", F.lit(0).cast("long").alias("m"), F.lit(None).cast("long").alias("host"))
    leaves = insert(start, paths, scratch)
    if leaves:
        nodes = edges(reduce(DataFrame.union, leaves), paths, scratch)
        later = locate(whole.where(~early), nodes, paths, size["longest"], scratch)
    else:
        later = whole.select("s", "len", F.lit(0).cast("long").alias("m"), F.lit(None).cast("long").alias("host"))
    leaves += insert(later, paths, scratch)
    if not leaves:
        return df.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = edges(reduce(DataFrame.union, leaves), paths, scratch)
    return expanded(nodes, seqs, own, paths, end_digests(ends), scratch)


def _with(left: DataFrame, right: DataFrame, how: str = "left", of: tuple[str, str] = ("rep", "p")) -> DataFrame:
    """left joined with the row of right for the node that `of` names; the root's owner is null on both sides."""
    other = right.withColumnsRenamed({"rep": "_rep", "p": "_p"})
    return left.join(other, F.col(of[0]).eqNullSafe(F.col("_rep")) & (F.col(of[1]) == F.col("_p")), how).drop("_rep", "_p")


def expanded(nodes: DataFrame, seqs: DataFrame, own: DataFrame, paths: Paths, digests: DataFrame, scratch: Scratch) -> DataFrame:
    """The prefixes of all edges with their figures. The root is an edge (-1, 0] without owner."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = [none.alias("rep"), F.lit(-1).cast("long").alias("p")]
    lengths = seqs.select("s", "copies", F.col("d").alias("len"))
    last = nodes.select(F.col("rep").alias("s"), "p", "j").join(lengths, "s").where("j = len")  # the edge of each end mark
    members = scratch.keep(last.select("s", "copies", F.when(F.col("p") < F.col("len") - 1, 1).otherwise(0).cast("long").alias("bare")))

    # every distinct conversation with the nodes on its path
    handles = nodes.select("f", "h1", "h2", "rep", "p")
    on = own.join(handles, (F.col("d") == F.col("f")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))).select("s", "rep", "p")
    on = scratch.keep(on.union(members.select("s", *root)).join(members, "s"))
    sums = on.groupBy("rep", "p").agg(F.sum("copies").alias("n"), F.min("s").alias("conv"), F.sum("bare").alias("bare"))
    shape = nodes.select("rep", "p", "j", "cp", "cj").join(lengths.select(F.col("s").alias("rep"), "len"), "rep")
    shape = shape.union(shape.sparkSession.range(1).select(*root, zero, zero, zero, none))
    known = scratch.keep(_with(sums, shape, "inner").withColumn("saved", (F.col("n") - 1) * (F.col("cj") - F.col("cp"))))

    # a node's saving stands once, on the path of its smallest member, and counts for the nodes above it there
    mine = known.select(F.col("conv").alias("s"), "rep", "p", "saved", F.lit(True).alias("owner")).withColumnsRenamed({"s": "_s", "rep": "_rep", "p": "_p"})
    held = on.select("s", "rep", "p").join(mine, (F.col("s") == F.col("_s")) & F.col("rep").eqNullSafe(F.col("_rep")) & (F.col("p") == F.col("_p")), "left")
    path = Window.partitionBy("s").orderBy("p")
    held = held.select("rep", "p", "owner", F.sum("saved").over(path.rowsBetween(1, Window.unboundedFollowing)).alias("below"), F.lag(F.struct("rep", "p")).over(path).alias("up"))
    held = scratch.keep(held)
    ups = held.where("owner and up is not null").select("rep", "p", F.col("up.rep").alias("urep"), F.col("up.p").alias("up_p"))
    linked = scratch.keep(_with(known, ups))
    real = linked.where("up_p is not null and not (j = len and p = len - 1)")  # an end mark alone is no prefix
    children = real.groupBy(F.col("urep").alias("rep"), F.col("up_p").alias("p")).agg(F.count("*").alias("n_children"))
    full = _with(_with(linked, held.where("below > 0").groupBy("rep", "p").agg(F.sum("below").alias("below"))), children)
    full = scratch.keep(_with(full.na.fill(0, ["below", "n_children"]), known.select("rep", "p", F.col("conv").alias("up_conv")), of=("urep", "up_p")))

    # depths of every edge, block by block of its owner's path
    deep = full.where("rep is not null").withColumn("bottom", F.least("j", F.col("len") - 1)).where("p < bottom")
    deep = deep.withColumn("b", F.explode(F.sequence(F.floor(F.col("p") / BLOCK), F.floor((F.col("bottom") - 1) / BLOCK))))
    deep = deep.join(paths.blocks.withColumnRenamed("s", "rep"), ["rep", "b"])
    cells = F.transform("a", lambda v, i: F.struct((F.col("b") * BLOCK + i + 1).alias("depth"), v["k1"].alias("k1"), v["k2"].alias("k2"), (v["cum"] - v["bytes"]).alias("before")))
    deep = deep.select("*", F.inline(cells)).where("depth > p and depth <= bottom")
    fields = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "k1", "k2"]
    inner = deep.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("p") + 1, F.col("conv")).otherwise(F.col("up_conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("depth") < F.col("bottom"), 1).when(F.col("j") == F.col("len"), 0).otherwise(F.col("n_children")).cast("long").alias("n_children"), F.col("bare").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("cj") - F.col("before"))).alias("saved_tokens"), "k1", "k2",
    )
    top = full.where("rep is null").select(F.col("conv").alias("conv_id"), zero.alias("depth"), none.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.greatest("bare", F.lit(1).cast("long")).alias("n_leaves"), F.col("below").alias("saved_tokens"), zero.alias("k1"), zero.alias("k2"))
    ended = seqs.join(digests, ["d", "k1", "k2"]).select("s", (F.col("d") - 1).alias("e"), "ends_sha256")
    ended = paths.at(ended, "s", F.col("e"), {"e1": "k1", "e2": "k2"}).select("e", F.coalesce("e1", zero).alias("e1"), F.coalesce("e2", zero).alias("e2"), "ends_sha256")
    result = inner.union(top).join(ended, (F.col("depth") == F.col("e")) & (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    result = scratch.write(result.select(*fields[:-2], F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")), "result")
    scratch.drop_but("result")
    return result
