"""Cross-tokenizer alignment: how often tokens of two tokenizers cover the same bytes, and each document scored by it.

Texts are aligned twice. The first pass counts, task by task, the documents that hold each linked pair of tokens. The distinct pairs are
dealt to shards by a hash, a minimal perfect hash is built for each shard, the counts of the tasks become dense vectors indexed by that
hash, and the vectors are summed along a tree. The second pass aligns the texts anew and looks the counts up by the hash; the key kept at
the slot says whether the pair is the one meant. The most frequent pairs, up to a checked number, are looked up in the tasks; pairs
beyond them miss there and are joined with the table of counts, so the result is the same at any size.

A text behind its leading space is cut at single spaces between characters that are no white space. No token of either tokenizer crosses
such a cut, so the pieces are aligned apart, and a worker remembers the pieces it has met.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventara.llm import bpe
from ventara.llm.base import Scratch

#: Shards of the pairs. With vocabularies of 50 000 and 32 000 a shard holds 6.3 million pairs at most.
SHARDS = 256
#: Children of a node of the summing tree.
FAN = 64
#: Pairs that a task counts before it hands them on, and characters of pieces that a worker remembers.
FLUSH = 1_000_000
REMEMBERED = 11_000_000
#: Pieces that are encoded in one call.
TOGETHER = 300
#: Pairs looked up in the tasks (17 bytes each); rarer ones are joined.
LOOKED_UP = 2_000_000
#: Bits per key in the first level of a perfect hash.
GAMMA = 2.0

_BLANK = r"\s\x1c-\x1f\x85\u180e"
_ALONE = regex.compile(rf"^(?:[{_BLANK}]|\Z)|[{_BLANK}]\Z|▁")
_GAP = regex.compile(rf" (?:[{_BLANK}]|\Z)")
_CUT = regex.compile(rf"(?<! ) (?=[^{_BLANK}])")


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of every key."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: keys alone at their place of a level are settled there, the others go to the next level."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct."""
        sizes, words, rest = [], [], keys
        while len(rest):
            size = -(-max(64, int(GAMMA * len(rest))) // 64) * 64
            at = mix(rest, len(sizes) + 1) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at.astype(np.int64)]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, from 0 to the number of keys; -1, or any slot, for a key it was not built for."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = self.before[word[hit]] + below[hit]
            left, base = left[~hit], base + size // 64
        return out


def shards_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0) % np.uint64(SHARDS)).astype(np.int64)


def read(byte_level: str, pieces: str) -> dict:
    """What the aligner needs of a byte-level BPE file (JSON) and a sentencepiece model; as large as the vocabularies."""
    spec = bpe.read(byte_level)
    made = [t for _, _, t in spec["merges"]]
    if made != sorted(made):
        raise ValueError("token ids must follow the order of the merges")
    with open(pieces, "rb") as file:
        return {"labels": spec["labels"], "specials": spec["specials"], "pieces": file.read()}


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind, *width: int):
        self.held, self.n = np.empty((1024, *width), kind), 0

    def extend(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.held):
            grown = np.empty((max(end, len(self.held) * 3 // 2), *self.held.shape[1:]), self.held.dtype)
            grown[: self.n] = self.all
            self.held = grown
        self.held[self.n : end] = more
        self.n = end

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner:
    """Aligns texts piece by piece. Pieces and pairs have numbers; what a piece holds stands at its number."""

    def __init__(self, labels: list[bytes], specials: dict[str, int], pieces: bytes):
        import sentencepiece
        import tiktoken

        ranks = {label: t for t, label in enumerate(labels) if label and t not in set(specials.values())}
        self.first = tiktoken.Encoding("first", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        named = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.labels = labels
        self.spelt = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self.sizes = np.array([len(x) for x in labels]), np.array([len(x) for x in self.spelt])
        self.names = [str(i) for i in range(max(len(labels), len(named)))]
        #: Whether a token of the second tokenizer could cross a cut; then texts stay whole.
        self.crossed = any("▁" in p.lstrip("▁") for p in named)
        self.turn = 0
        self.forget()

    def forget(self) -> None:
        """Drop all pieces and pairs."""
        self.turn, self.kept = self.turn + 1, 0
        self.numbers: dict[str, int] = {}
        self.held = 0
        #: Of each piece: whether its bytes are spelt out; tokens of the first, of the second, groups, links; groups as text; where its pairs start.
        self.valid, self.counts, self.groups = Grown(bool), Grown(np.int64, 4), []
        self.starts = Grown(np.int64)
        self.starts.extend(np.zeros(1, np.int64))
        #: Pairs of all pieces, and their links in the piece.
        self.pairs, self.links = Grown(np.int32), Grown(np.int64)
        self.index: dict[int, int] = {}
        self.keys = Grown(np.int64)

    def shorten(self) -> None:
        """Drop the later half of the pieces: those met first are the frequent ones. Pairs keep their numbers."""
        self.turn, self.kept = self.turn + 1, self.valid.n // 2
        self.numbers = {piece: k for piece, k in self.numbers.items() if k < self.kept}
        self.held = sum(20 + len(piece) for piece in self.numbers)
        self.valid.n = self.counts.n = self.kept
        self.starts.n, self.groups[self.kept :] = self.kept + 1, []
        self.pairs.n = self.links.n = int(self.starts.all[-1])

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; each stands for a space and itself."""
        if self.crossed:
            return [text]
        spaced = " " + text
        if not _GAP.search(spaced):
            return text.split(" ")
        parts = _CUT.split(spaced)
        return [parts[0][1:], *parts[1:]] if parts[0] else parts[1:]

    def learn(self, texts: list[str | None], spell: bool) -> list[np.ndarray | None]:
        """The numbers of the pieces of every text; None where a text has no tokens. Numbers hold until the next call."""
        if self.held > REMEMBERED:
            self.shorten()
        cuts = [self.cut(t) if t else [] for t in texts]
        if new := list(set().union(*cuts).difference(self.numbers)):
            self._add(new, spell)
        number, valid, out = self.numbers.__getitem__, self.valid.all, []
        for cut in cuts:
            known = np.fromiter(map(number, cut), np.int64, len(cut))
            out.append(known if len(known) and valid[known].all() else None)
        return out

    def pairs_of(self, pieces: np.ndarray) -> np.ndarray:
        """The pairs of all these pieces, one after the other."""
        starts = self.starts.all
        first, sizes = starts[pieces], starts[pieces + 1] - starts[pieces]
        return self.pairs.all[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def _add(self, new: list[str], spell: bool) -> None:
        labels, spelt, encode = self.labels.__getitem__, self.spelt.__getitem__, self.first.encode_ordinary
        # pieces without blanks at their ends are encoded together, since no token crosses what stands between them
        plain = [] if self.crossed else [piece for piece in new if not _ALONE.search(piece)]
        joined = [" ".join(plain[k : k + TOGETHER]) for k in range(0, len(plain), TOGETHER)]
        a, b = [encode(" " + x) for x in joined], self.second.encode(joined, num_threads=1) if joined else []
        if any(b"".join(map(spelt, y)) != (" " + t).encode() or b"".join(map(labels, x)) != (" " + t).encode() for x, y, t in zip(a, b, joined, strict=True)):
            plain, a, b = [], [], []
        alone = new if not plain else [piece for piece in new if _ALONE.search(piece)]
        new = plain + alone
        whole = [(" " + piece).encode() for piece in new]
        own_a, own_b = [encode(" " + piece) for piece in alone], self.second.encode(alone, num_threads=1) if alone else []
        sound = [b"".join(map(spelt, y)) == w == b"".join(map(labels, x)) for x, y, w in zip(own_a, own_b, whole[len(plain) :], strict=True)]
        valid = np.array([True] * len(plain) + sound)
        good = np.flatnonzero(valid)
        for piece in new:
            self.numbers[piece] = len(self.numbers)
            self.held += 20 + len(piece)
        fa, fb = (np.fromiter(chain.from_iterable(chain(x, (own[k] for k, ok in enumerate(sound) if ok))), np.int64) for x, own in ((a, own_a), (b, own_b)))
        ea, eb = np.cumsum(self.sizes[0][fa]), np.cumsum(self.sizes[1][fb])
        bytes_end = np.cumsum([len(whole[k]) for k in good.tolist()], dtype=np.int64)
        # groups end where both end
        cuts = np.intersect1d(ea, eb, assume_unique=True)
        ga, gb, owner = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb), good[np.searchsorted(bytes_end, cuts)]
        ca, cb = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        counts = np.zeros((len(new), 4), np.int64)
        for column, x in enumerate((ca, cb, np.ones_like(ca), ca * cb)):
            np.add.at(counts[:, column], owner, x)
        # links: distinct tokens of either side of a group with each other
        (ta, na), (tb, nb) = (np.unique(g << 24 | f, return_counts=True) for g, f in ((ga, fa), (gb, fb)))
        of_a, of_b = ta >> 24, tb >> 24
        first, many = np.searchsorted(of_b, of_a), np.bincount(of_b, minlength=len(cuts))[of_a]
        right = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = np.repeat(ta & 0xFFFFFF, many) << 32 | (tb & 0xFFFFFF)[right]
        links, piece = np.repeat(na, many) * nb[right], np.repeat(owner[of_a], many)
        order = np.lexsort((key, piece))
        key, links, piece = key[order], links[order], piece[order]
        starts = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
        links = np.add.reduceat(links, starts) if len(starts) else links
        unique, inverse = np.unique(key[starts], return_inverse=True)
        index, before = self.index, len(self.index)
        local = np.array([index.setdefault(k, len(index)) for k in unique.tolist()], np.int32)
        self.keys.extend(unique[local >= before][np.argsort(local[local >= before])])
        self.valid.extend(valid)
        self.counts.extend(counts)
        self.starts.extend(self.starts.all[-1] + np.cumsum(np.bincount(piece[starts], minlength=len(new))))
        self.pairs.extend(local[inverse])
        self.links.extend(links)
        if spell:
            self.groups += self._spell(valid, fa, fb, ga, gb, ca, cb, owner)

    def _spell(self, valid, fa, fb, ga, gb, ca, cb, owner) -> list[str]:
        """The groups of every new piece as text: tokens of the first, a bar, tokens of the second, a semicolon between groups."""
        ends_a, ends_b = np.cumsum(ca), np.cumsum(cb)
        ids, marks = np.empty(len(fa) + len(fb), np.int64), np.full(len(fa) + len(fb), ord(","), np.uint8)
        ids[np.arange(len(fa)) + (ends_b - cb)[ga]] = fa
        ids[np.arange(len(fb)) + ends_a[gb]] = fb
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        marks[ends_a + ends_b - cb - 1] = ord("|")
        marks[ends_a + ends_b - 1] = np.where(last, ord("\n"), ord(";"))
        said = iter("".join(chain.from_iterable(zip(map(self.names.__getitem__, ids.tolist()), marks.tobytes().decode(), strict=True))).split("\n"))
        return [next(said) if ok else "" for ok in valid.tolist()]


def _aligner(held, use: str) -> Aligner:
    """The aligner of broadcast tokenizers, made once in each Python worker; what it remembers serves the tasks of one use."""
    value = held.value
    if "aligner" not in value:
        value["aligner"] = Aligner(value["labels"], value["specials"], value["pieces"])
    if value.get("use") != use:
        value["aligner"].forget()
    value["use"] = use
    return value["aligner"]


def _parts(texts: DataFrame, held) -> DataFrame:
    """(part, shard, keys, counts): documents per linked pair, counted within a task and dealt to shards."""
    names = ["part", "shard", "keys", "counts"]

    def rows(keys: np.ndarray, counts: np.ndarray, number: int):
        order = np.argsort(shards := shards_of(keys), kind="stable")
        keys, counts, shards = keys[order], counts[order], shards[order]
        starts = np.flatnonzero(np.diff(shards, prepend=-1))
        ends = [*starts[1:].tolist(), len(keys)]
        slices = list(zip(starts.tolist(), ends, strict=True))
        part = TaskContext.get().partitionId() << 20 | number
        return pa.RecordBatch.from_arrays([
            pa.array([part] * len(slices), pa.int64()), pa.array(shards[starts].tolist(), pa.int32()),
            pa.array([keys[a:b].tobytes() for a, b in slices], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in slices], pa.binary()),
        ], names=names)

    def run(batches):
        aligner, number = _aligner(held, "count"), 0
        counted = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                known = aligner.learn(batch.column(0).slice(at, 200).to_pylist(), spell=False)
                counted = np.append(counted, np.zeros(aligner.keys.n - len(counted), np.int64))
                for own in known:
                    if own is not None:
                        counted[np.unique(aligner.pairs_of(np.unique(own)))] += 1
                if len(counted) >= FLUSH:
                    yield rows(aligner.keys.all[counted > 0], counted[counted > 0], number)
                    aligner.forget()
                    counted, number = np.zeros(0, np.int64), number + 1
        if counted.any():
            yield rows(aligner.keys.all[counted > 0], counted[counted > 0], number)

    return texts.mapInArrow(run, "part long, shard int, keys binary, counts binary")


def _nodes(df: DataFrame) -> DataFrame:
    """Rows of one (shard, node) side by side, in one task."""
    return df.repartition("shard", "node").sortWithinPartitions("shard", "node")


def _fold(df: DataFrame, schema: str, start, take, make) -> DataFrame:
    """One row per (shard, node), folded row by row: start() gives the state, take(state, row) the next, make(state) the columns behind node."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        current, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if (row["shard"], row["node"]) != current:
                    if current is not None:
                        yield _one(current, make(state), names)
                    current, state = (row["shard"], row["node"]), start()
                state = take(state, row)
        if current is not None:
            yield _one(current, make(state), names)

    return df.mapInArrow(run, schema)


def _one(current: tuple, made: tuple, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * len(made)]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*current, *made), kinds, strict=True)], names=names)


def _longs(x) -> np.ndarray:
    return np.frombuffer(x or b"", "<i8")


def _hashed(keys: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Levels of the perfect hash of distinct keys, and the keys' slots."""
    made = PerfectHash.build(keys)
    return made.sizes.tobytes(), made.words.tobytes(), made.slots(keys)


def pair_counts(texts: DataFrame, held, scratch: Scratch) -> DataFrame:
    """(shard, sizes, words, keys, counts): each shard's perfect hash, and keys and document counts in the order of its slots."""
    parts = scratch.write(_parts(texts, held), "parts")
    nodes = -(-max(1, parts.select("part").distinct().count()) // FAN)
    dealt = parts.withColumn("node", F.pmod(F.xxhash64("part"), F.lit(nodes)))

    # distinct keys, up the tree
    union = lambda state, row: np.union1d(state, _longs(row["keys"]))
    level, n = dealt.select("shard", "node", "keys"), nodes
    while True:
        level = _fold(_nodes(level), "shard int, node long, keys binary", lambda: np.empty(0, "<i8"), union, lambda s: (s.tobytes(),))
        if n == 1:
            break
        n = -(-n // FAN)
        level = scratch.keep(level.withColumn("node", F.pmod("node", F.lit(n))))

    def hashed(state):
        sizes, words, slots = _hashed(state)
        keys = np.empty_like(state)
        keys[slots] = state
        return sizes, words, keys.tobytes()

    hashes = scratch.write(_fold(level, "shard int, node long, sizes binary, words binary, keys binary", lambda: None, lambda _, row: _longs(row["keys"]), hashed), "hashes")

    # dense vectors of the counts of each node, then their sums up the tree; the hash precedes the counts of its node
    none = F.lit(None).cast("binary")
    copies = hashes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))).alias("node"), F.lit(0).alias("turn"), "sizes", "words", none.alias("keys"), none.alias("counts"))
    both = copies.union(dealt.select("shard", "node", F.lit(1).alias("turn"), none.alias("sizes"), none.alias("words"), "keys", "counts"))

    def dense(state, row):
        if row["sizes"] is not None:
            found = PerfectHash(_longs(row["sizes"]), np.frombuffer(row["words"], "<u8"))
            return found, np.zeros(int(np.bitwise_count(found.words).sum()), np.int64)
        state[1][state[0].slots(_longs(row["keys"]))] += _longs(row["counts"])
        return state

    level = _fold(both.repartition("shard", "node").sortWithinPartitions("shard", "node", "turn"), "shard int, node long, counts binary", lambda: None, dense, lambda s: (s[1].tobytes(),))
    n = nodes
    while n > 1:
        n = -(-n // FAN)
        level = scratch.keep(level.withColumn("node", F.pmod("node", F.lit(n))))
        level = _fold(_nodes(level), "shard int, node long, counts binary", lambda: 0, lambda s, row: s + _longs(row["counts"]), lambda s: (s.tobytes(),))
    sums = scratch.write(level, "sums")
    return scratch.write(hashes.join(sums.select("shard", "counts"), "shard").select("shard", "sizes", "words", "keys", "counts"), "table")


def _highest(table: DataFrame) -> dict[int, int]:
    """The highest count of each token of the first tokenizer; as many as the vocabulary at most."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, counts = _longs(keys) >> 32, _longs(counts)
                order = np.lexsort((counts, a))
                last = np.flatnonzero(np.diff(a[order], append=-1))
                yield pa.RecordBatch.from_arrays([pa.array(a[order][last]), pa.array(counts[order][last])], names=["a", "top"])

    return {r["a"]: r["top"] for r in table.select("keys", "counts").mapInArrow(run, "a long, top long").groupBy("a").agg(F.max("top").alias("top")).collect()}


def _floor(table: DataFrame, most: int) -> int:
    """The least count, on a grid of eighths of powers of two, at and above which there are at most `most` pairs."""

    def run(batches):
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                steps, n = np.unique(np.ceil(np.log2(_longs(counts)) * 8).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(n)], names=["step", "n"])

    steps = table.select("counts").mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    left = sum(r["n"] for r in steps)
    if left <= most:
        return 0
    for r in steps:
        left -= r["n"]
        if left <= most:
            return int(2 ** (r["step"] / 8)) + 1
    raise AssertionError("no pair is left")


def _frequent(table: DataFrame, floor: int) -> list:
    """The shards with the pairs of at least `floor` documents only, under perfect hashes of their own."""

    def run(batches):
        for batch in batches:
            for shard, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys, counts = _longs(keys), _longs(counts)
                sizes, words, slots = _hashed(keys := keys[keep := counts >= floor])
                put = lambda x: (y := np.empty_like(x), y.__setitem__(slots, x))[0].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((shard, pa.int32()), (sizes, pa.binary()), (words, pa.binary()), (put(keys), pa.binary()), (put(counts[keep]), pa.binary()))], names=["shard", "sizes", "words", "keys", "counts"])

    return table.select("shard", "keys", "counts").mapInArrow(run, "shard int, sizes binary, words binary, keys binary, counts binary").collect()


class Lookup:
    """Counts of pairs by perfect hash, with verified keys."""

    def __init__(self, shards: list, highest: dict[int, int]):
        self.shards = {s: (PerfectHash(_longs(sizes), np.frombuffer(words, "<u8")), _longs(keys), _longs(counts)) for s, sizes, words, keys, counts in shards}
        self.highest = np.zeros(1 + max(highest, default=0), np.int64)
        for a, top in highest.items():
            self.highest[a] = top

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of every key; 0 for a key that is not in the table."""
        out = np.zeros(len(keys), np.int64)
        shards = shards_of(keys)
        order = np.argsort(shards, kind="stable")
        starts = np.flatnonzero(np.diff(shards[order], prepend=-1))
        for rows in np.split(order, starts[1:]):
            if len(rows) and (held := self.shards.get(int(shards[rows[0]]))) and len(held[1]):
                slots = held[0].slots(keys[rows])
                same = (slots >= 0) & (held[1][slots] == keys[rows])
                out[rows[same]] = held[2][slots[same]]
        return out


def aligned(df: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text: str = "text", looked_up: int = LOOKED_UP) -> DataFrame:
    """One row per document: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A null or empty text, and a text that one of the tokenizers does not spell out byte by byte, has zeros and an empty
    `groups_sha256`. Every row counts as a document of its own, also under a repeated or missing id. Other columns are not looked at.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(read(byte_level, pieces))
    scratch = Scratch(spark, "align")
    table = pair_counts(df.select(df[text].alias("text")), held, scratch)
    highest, floor = _highest(table), _floor(table, looked_up)
    shards = _frequent(table, floor) if floor else table.collect()
    found = spark.sparkContext.broadcast({"shards": [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in shards], "highest": highest})
    names, use = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"], scratch.root  # a use of its own: the counts differ
    kind = df.schema[id_column].dataType

    def run(batches):
        value = found.value
        if "lookup" not in value:
            value["lookup"] = Lookup(value["shards"], value["highest"])
        aligner = _aligner(held, use)
        told = value.setdefault("told", Told(aligner, value["lookup"]))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                if aligner.keys.n > FLUSH:
                    aligner.forget()
                    told.known.n = 0
                known = aligner.learn(part.column(1).to_pylist(), spell=True)
                told.follow()
                sums, shas, late = np.zeros((len(known), 6), np.int64), [""] * len(known), [[] for _ in known]
                for k, own in enumerate(known):
                    if own is not None:
                        sums[k] = np.append(aligner.counts.all[own].sum(0), told.figures.all[own].sum(0))
                        shas[k] = hashlib.sha256(";".join(map(aligner.groups.__getitem__, own.tolist())).encode()).hexdigest()
                        if told.missed:
                            late[k] = [{"key": key, "links": n} for p in own.tolist() for key, n in told.missed.get(p, ())]
                arrays = [part.column(0), *(pa.array(np.ascontiguousarray(c)) for c in sums.T), pa.array(shas, pa.string()), pa.array(late, pa.list_(pa.struct([("key", pa.int64()), ("links", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *names, "groups_sha256", "late"])

    schema = f"id {kind.simpleString()}, {', '.join(f'{n} long' for n in names)}, groups_sha256 string, late array<struct<key: long, links: long>>"
    result = df.select(df[id_column].alias("id"), df[text].alias("text")).mapInArrow(run, schema)
    if floor:
        result = _joined(scratch.write(result.withColumn("row", F.monotonically_increasing_id()), "rows"), table, scratch)
    else:
        scratch.drop()
    return result.select(F.col("id").alias(id_column), *names, "groups_sha256")


class Told:
    """What the counts say of an aligner's pieces: best links and sum of counts (`figures`), and pairs that were not found (`missed`)."""

    def __init__(self, aligner: Aligner, lookup: Lookup):
        self.aligner, self.lookup, self.turn = aligner, lookup, aligner.turn
        self.figures, self.missed = Grown(np.int64, 2), {}
        self.known = Grown(np.int64)  # count of each pair

    def follow(self) -> None:
        """Look at the pieces and pairs that are new since the last call."""
        aligner = self.aligner
        if self.turn != aligner.turn:
            self.turn, self.figures.n = aligner.turn, min(self.figures.n, aligner.kept)
            self.missed = {p: x for p, x in self.missed.items() if p < self.figures.n}
        old = self.figures.n
        self.known.extend(self.lookup.counts(aligner.keys.all[self.known.n :]))
        starts = aligner.starts.all[old:]
        pairs, links = aligner.pairs.all[starts[0] :], aligner.links.all[starts[0] :]
        counts, keys = self.known.all[pairs], aligner.keys.all[pairs]
        best = np.where((counts > 0) & (self.lookup.highest[keys >> 32] == counts), links, 0)
        piece = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        more = np.zeros((len(starts) - 1, 2), np.int64)
        np.add.at(more[:, 0], piece, best)
        np.add.at(more[:, 1], piece, links * counts)
        self.figures.extend(more)
        for k in np.flatnonzero(counts == 0).tolist():
            self.missed.setdefault(old + int(piece[k]), []).append((int(keys[k]), int(links[k])))


def _joined(rows: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """The result with what the rare pairs add, by a join with the counts."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_longs(keys)), pa.array(_longs(keys) >> 32), pa.array(_longs(counts))], names=["key", "a", "n"])

    pairs = scratch.write(table.select("keys", "counts").mapInArrow(run, "key long, a long, n long"), "pairs")
    tops = pairs.groupBy("a").agg(F.max("n").alias("top"))
    pairs = pairs.join(tops, "a").select("key", "n", (F.col("n") == F.col("top")).alias("best"))
    late = rows.select("row", F.inline("late")).groupBy("row", "key").agg(F.sum("links").alias("links")).join(pairs, "key")
    more = late.groupBy("row").agg(F.sum(F.col("links") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"))
    out = rows.join(more, "row", "left")
    return out.withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0))})
