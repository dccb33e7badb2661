"""MinHash near-dedup with sequential Bayesian verification.

Sets are the distinct shingles of five words (64-bit hashes). Equal sets are one class from the start. The classes' signatures are
banded; members of a bucket are candidates. A candidate pair's signatures are compared batch by batch, and the pair is
pruned as soon as the posterior probability (uniform prior) that its similarity reaches the threshold falls below the miss
probability. Survivors are confirmed on their full sets.

A bucket with m members is not expanded into its pairs. Its members are compared with its smallest member; each class has its best
such pair confirmed first. Members outside a bucket's largest component then meet other members of that, and what still stands apart
is compared with all members of other components, block by block. So the components are those of all candidate pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventara.llm.base import Scratch, checkpoint, map_values
from ventara.llm.components import components

#: Words of a shingle, and the smallest similarity of a link as a share of 100.
WIDTH, PERCENT = 5, 75

#: Bands and their rows: a pair of similarity 0.75 meets in a bucket with probability 0.9997.
BANDS, ROWS = 42, 6

#: Hashes of a signature, the banded ones first.
HASHES = 3 * BANDS * ROWS

#: Hashes of a comparison batch, and the probability that a pair of the threshold's similarity or more is pruned.
BATCH, MISS = 84, 5e-4

#: Members of a comparison block.
BLOCK = 64

_RANDOM = np.random.default_rng(20)
FACTORS = _RANDOM.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)
PLACES = _RANDOM.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
BAND_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower and bytes.split know ASCII letters and white space only, as wanted."""
    words = (text or "").encode(errors="replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WIDTH:
        return _mix((hashes * PLACES[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - WIDTH + 1
    total = hashes[:n] * PLACES[0]
    for k in range(1, WIDTH):
        total += hashes[k : k + n] * PLACES[k]
    return np.unique(_mix(total))


def minima(own: np.ndarray) -> np.ndarray:
    """The signature: minimum of each hash function over the set."""
    low = (own ^ own >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(out, (low[at : at + 256, None] * FACTORS + OFFSETS).min(axis=0), out=out)
    return out


def bounds() -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) after each batch.

    Signatures hold the low byte of each minimum, so unequal minima match with probability 1/256. With a uniform prior the
    posterior probability of at least p after m matches of n is that of at most m successes in n + 1 trials of chance p.
    """
    p = PERCENT / 100 + (1 - PERCENT / 100) / 256
    ends = [min(HASHES, k) for k in range(BATCH, HASHES + BATCH, BATCH)]
    out = []
    for n in ends:
        tail, m = 0.0, -1
        while tail < MISS / len(ends):
            m += 1
            tail += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append((n, m))
    return out


def described(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, n_shingles, digest of the set, bands, signature); the last three are null without words. A signature ends with the bands' bytes."""

    def make(texts: list) -> list:
        sizes, digests, bands, signatures = [], [], [], []
        for value in texts:
            own = shingles(value)
            sizes.append(len(own))
            if not len(own):
                digests.append(None)
                bands.append(None)
                signatures.append(None)
                continue
            low = minima(own)
            digests.append(xxhash.xxh3_128_digest(own.tobytes()))
            bands.append(_mix((low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * BAND_FACTORS).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
            signatures.append(low.astype(np.uint8).tobytes() + bands[-1].astype("<i8").tobytes())
        return [sizes, digests, bands, signatures]

    found = map_values(df.select(df[id_column].alias("id"), df[text].alias("text")), ["id"], "text", [("n_shingles", "bigint"), ("digest", "binary"), ("bands", "array<bigint>"), ("signature", "binary")], make)
    return found


def surviving(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(a, b, matches) of the pairs (a, b) that no batch of the sequential comparison prunes."""
    both = pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    steps = bounds()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (_bytes(batch.column(k).to_pylist())[:, :HASHES] for k in (2, 3))
                rows = np.arange(batch.num_rows)
                kept, matches = _sequential(left, right, rows, rows, steps)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), pa.array(matches)], names=["a", "b", "matches"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}, matches bigint")


def _bytes(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)


def _sequential(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (left[i], right[j]) survive all batches, and their matches."""
    alive, matches, at = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for end, least in steps:
        matches[alive] += (left[i[alive], at:end] == right[j[alive], at:end]).sum(axis=1)
        alive, at = alive[matches[alive] >= least], end
    return alive, matches[alive]


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(ca, cb): the components of the pairs (a, b, ca, cb) whose full sets are similar enough."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        last, left = None, None
        for batch in batches:
            keep = []
            for k, (a, ta, tb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)):
                if last is None or last != a:
                    last, left = a, shingles(ta.as_py())
                right = shingles(tb.as_py())
                shared = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * shared >= PERCENT * (len(left) + len(right) - shared):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (3, 4)], names=["ca", "cb"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "ta", "tb", "ca", "cb").mapInArrow(run, f"ca {kind}, cb {kind}")


def _merged(roots: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components so far (node, component), joined where links (ca, cb) stand between them. A node without links has no row."""
    links = scratch.keep(links)
    if roots is not None and links.isEmpty():
        return roots
    up = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
    if roots is None:
        return up
    raised = roots.join(up.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return scratch.keep(raised.union(up.join(roots.select("node"), "node", "left_anti")))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members (.., id) with the component each stands in so far."""
    return members.join(roots.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends stand in different components, with these as ca and cb."""
    sides = pairs.join(roots.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return sides.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def _best(pairs: DataFrame) -> DataFrame:
    """(a, b): the most similar pair between each two components."""
    return pairs.groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(F.max(F.struct("matches", "a", "b")).alias("best")).select("best.a", "best.b", F.col("c1").alias("ca"), F.col("c2").alias("cb"))


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, component, main, n, outside) of buckets with several components: their largest one, members, and those outside it."""
    placed = _rooted(shared.select("key", "id"), roots)
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(main.select("key", F.col("top.component").alias("main"), "n", (F.col("n") - F.col("top.n")).alias("outside")), "key")


def _compared(opened: DataFrame, signatures: DataFrame) -> DataFrame:
    """(a, b, matches) of the surviving pairs across components: members outside the largest component with all others.

    Both sides travel in blocks of about BLOCK members with their signatures, and a task compares two blocks at once, so
    the pairs are no rows. A pair that meets in several buckets is told by that with the smallest key.
    """
    signed = opened.join(signatures, "id")
    block = lambda size: F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK)).alias("block")
    packed = lambda df, size, name: df.groupBy("key", block(size)).agg(F.collect_list("id").alias(f"{name}_id"), F.collect_list("component").alias(f"{name}_c"), F.collect_list("signature").alias(f"{name}_s"), F.first("main").alias("main"))
    left, right = packed(signed.where("component <> main"), "outside", "x"), packed(signed, "n", "y")
    both = left.join(right.drop("main", "block"), "key").select("key", "x_id", "x_c", "x_s", "y_id", "y_c", "y_s", "main")
    steps = bounds()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                xi, xc, yi, yc = (np.array(row[k]) for k in ("x_id", "x_c", "y_id", "y_c"))
                wanted = (xc[:, None] != yc) & ((yc == row["main"])[None, :] | (xi[:, None] < yi))
                i, j = np.nonzero(wanted)
                xs, ys = _bytes(row["x_s"]), _bytes(row["y_s"])
                kept, matches = _sequential(xs[:, :HASHES], ys[:, :HASHES], i, j, steps)
                keys = [np.ascontiguousarray(m[:, HASHES:]).view("<i8") for m in (xs, ys)]
                met = np.where((a := keys[0][i[kept]]) == keys[1][j[kept]], a, np.iinfo(np.int64).max).min(axis=1) == row["key"]
                kept, matches = kept[met], matches[met]
                x, y = xi[i[kept]], yi[j[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(matches)], names=["a", "b", "matches"])

    kind = opened.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}, matches bigint")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; the id column keeps its name.

    component_id is the smallest id reachable over links, itself included; kept tells that it is the row's own. Null and empty
    texts have no shingles and link with nothing. Rows that repeat an id are one document and share its component. Rows
    without id link with nothing: component_id and kept are null. The result is checkpointed; intermediate tables are removed.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    base = scratch.write(described(df, id_column, text), "base")
    classes = scratch.keep(base.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id")))
    members = base.join(classes, ["id", "digest"], "left_semi").select("id", "bands", "signature")
    banded = members.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader")
    shared = scratch.write(banded.join(buckets, "key"), "shared")

    signatures = scratch.write(members.join(shared.select("id").distinct(), "id", "left_semi").select("id", "signature"), "signatures")
    stars = scratch.write(surviving(shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), signatures), "stars")
    first = scratch.keep(stars.groupBy("b").agg(F.min(F.struct((-F.col("matches")).alias("m"), "a")).alias("best")).select("best.a", "b", F.col("best.a").alias("ca"), F.col("b").alias("cb")))
    rows = df.select(df[id_column].alias("id"), df[text].alias("text"))
    texts = scratch.write(rows.join(shared.select("id").distinct(), "id", "left_semi"), "texts")
    roots = _merged(None, confirmed(first, texts), scratch)

    # members outside a bucket's largest component meet another member of that
    opened = scratch.keep(_open(shared, roots))
    heads = opened.where("component = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id")).alias("head")).select("key", F.col("head.id").alias("a"))
    pairs = opened.where("component <> main").select("key", F.col("id").alias("b")).join(heads, "key").select("a", "b").distinct()
    roots = _merged(roots, confirmed(_best(_crossing(surviving(pairs, signatures), roots)), texts), scratch)

    # and what is left is compared with all others in the bucket, the most similar pairs of two components first
    across = scratch.keep(_crossing(_compared(_open(shared, roots), signatures), roots))
    best = scratch.keep(_best(across))
    roots = _merged(roots, confirmed(best, texts), scratch)
    rest = _crossing(across.select("a", "b"), roots).join(best, ["a", "b"], "left_anti")
    roots = _merged(roots, confirmed(rest, texts), scratch)

    of_class = _rooted(classes, roots).select("digest", "component")
    kept = base.select("id", "n_shingles", "digest").join(of_class, "digest", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    out = checkpoint(kept.select(F.col("id").alias(id_column), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept")))
    scratch.drop()
    return out
