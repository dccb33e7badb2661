"""The conversation trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ventara.llm import trie


def plain(rows):
    """rows: (conv_id, turn, role, text); returns the rows of prefix_trie."""
    given = defaultdict(list)
    for c, *row in rows:
        if c is not None:
            given[c].append(row)
    low = lambda x: (x is not None, x if x is not None else 0)
    told = {c: [(r or "", x or "") for _, r, x in sorted(own, key=lambda o: (low(o[0]), o[1] or "", o[2] or ""))] for c, own in given.items()}
    built = {}
    for c in told:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(told.get(base, [])[:h] + told[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if built[c] == p)))
    return sorted(map(str, ((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, own in members.items())))


def check(spark, rows):
    got = trie.prefix_trie(spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 int").repartition(3))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (2, None, "user", "a"), (2, 1, "", ""), (None, 1, "user", "x"), (3, 0, "user", "a"), (3, 0, "user", "a"), (10, 0, "us", "era"), (11, 0, "use", "ra"), (-3, 1, "user", "é😀"), (-5, 0, "user", "z" * 50_000)]
    rows += [(25, k, "user", f"t{k % 3}") for k in range(300)] + [(26, k, "user", f"t{k % 3}") for k in range(200)] + [(c, 0, "user", "same") for c in range(1000, 1400)]
    check(spark, rows)


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [(7, 0, "user", "only")])  # may lose its turn to a base that is absent
    check(spark, [(5, k, "user", "x") for k in range(3)])


@pytest.mark.parametrize("seed,block,ids", [(1, 64, 5000), (2, 3, 2)])
def test_random_tries(spark, monkeypatch, seed, block, ids):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", ids)
    rng = random.Random(seed)
    texts = ["a", "b", "", "longer text", None]
    rows = [(c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", rng.choices(texts, [8, 2, 1, 1, 1])[0]) for c in range(0, 400) for k in range(rng.choice([0, 1, 2, 5, 9, 20]))]
    check(spark, rows)


def test_fattest(spark):
    want = lambda a, b: max(range(a + 1, b + 1), key=lambda x: x & -x)
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 70)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.fattest("a", "b").alias("f")).collect()
    assert all(r.f == want(r.a, r.b) for r in got)


def test_running_sums_cross_tasks(spark, monkeypatch):
    from ventara.llm.base import Scratch

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(3)
        rows = [(g, k, rng.randrange(-(2**62), 2**62)) for g, n in ((1, 500), (2, 3), (3, 900), (4, 1)) for k in range(n)]
        scratch = Scratch(spark, "test-running")
        got = trie.running(spark.createDataFrame(rows, "g long, k long, x long").repartition(5), "g", ["k"], ["x"], ["k"], scratch).collect()
        sums, want = {}, {}
        for g, k, x in rows:
            sums[g] = (sums.get(g, 0) + x) % 2**64
            want[g, k] = sums[g]
        assert {(r.g, r.k): r.x % 2**64 for r in got} == want
        scratch.drop()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
