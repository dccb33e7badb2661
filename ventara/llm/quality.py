"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its hashed words, the n-grams of its run-collapsed character classes (how words are written, pointed and
laid out), repeated neighbouring words and the share of distinct words. Weights are (1 + ln tf) x idf with document frequencies of
the whole corpus, scaled to unit length. The latent space is a truncated SVD of a bounded sample of labelled documents, whose
vectors go to every task; each document gets the exact cosines to all of them, block by block, and its NEIGHBOURS nearest
vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventara.llm.base import free_name, map_values

#: Labelled documents of each class that are learned from (the lowest hashes of their id), latent dimensions, voters, sharpness of the weights, and acceptance.
SAMPLE, DIMENSIONS, NEIGHBOURS, SHARPNESS, THRESHOLD = 1500, 32, 25, 8, 0.3

#: Term numbers: hashed words, then class n-grams of one to three, then the marks for repetition and variety.
WORDS = 1 << 13
CLASSES = 38
SHAPES = CLASSES + CLASSES**2 + CLASSES**3
REPEATED = WORDS + SHAPES
VARIETY = REPEATED + 1
TERMS = VARIETY + 11


def _classes() -> np.ndarray:
    """Class of each byte: others, lower (with all beyond ASCII), upper, digit, blank, line end, and each mark its own."""
    kinds = np.zeros(256, np.int64)
    kinds[128:] = 1
    marks = 6
    for c in range(128):
        ch = chr(c)
        if ch.isalpha():
            kinds[c] = 1 if ch.islower() else 2
        elif ch.isdigit():
            kinds[c] = 3
        elif ch in " \t":
            kinds[c] = 4
        elif ch in "\r\n":
            kinds[c] = 5
        elif ch.isprintable():
            kinds[c] = marks
            marks += 1
    return kinds


KINDS = _classes()


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers in rising order, counts) of a whole text."""
    raw = (text or "").encode(errors="replace")
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = KINDS[np.frombuffer(raw, np.uint8)]
    runs = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
    pairs = runs[:-1] * CLASSES + runs[1:]
    hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS
    found = np.concatenate([hashed, runs + WORDS, pairs + WORDS + CLASSES, pairs[:-1] * CLASSES + runs[2:] + WORDS + CLASSES + CLASSES**2]).astype(np.int32)
    found.sort()
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    own, n = found[starts].astype(np.int64), np.diff(np.append(starts, len(found)))
    repeated = sum(map(eq, words, words[1:]))
    extra = [REPEATED] * (repeated > 0) + [VARIETY + 10 * len(set(words)) // len(words)]
    return np.concatenate([own, extra]), np.concatenate([n, [repeated] * (repeated > 0) + [len(words)]])


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents: one array of TERMS numbers, summed over the whole table."""

    def run(batches):
        seen, rows = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen[terms(value.as_py())[0]] += 1
                seen[TERMS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for row in df.select(df[text].alias("text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most TERMS + 1 rows
        out[row["term"]] = row["n"]
    return out[:TERMS], int(out[TERMS])


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def base(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5


def _weights(own: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf[own]
    size = np.sqrt(w @ w)
    return (w / size if size else w).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(size > 0, size, 1)).astype(np.float32)


def fit(df: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text: str = "text") -> Model:
    """Learn from labelled (id, label 0 or 1): of each class the SAMPLE rows with the lowest hash; the rest only by document frequency.

    Rows without id or with another label are not used. Without any labelled row every score is 0.5.
    """
    seen, total = document_frequencies(df, text)
    idf = np.log((1 + total) / (1 + seen)) + 1
    # a bounded side: at most 2 x SAMPLE rows
    picked = None
    for label in (0, 1):
        own = labelled.select(F.col(labelled.columns[0]).alias("sample_id"), F.col(labelled.columns[1]).cast("int").alias("sample_label")).where(F.col("sample_label") == label).where(F.col("sample_id").isNotNull())
        own = own.distinct().orderBy(F.xxhash64("sample_id"), "sample_id").limit(SAMPLE)
        picked = own if picked is None else picked.union(own)
    narrow = df.select(df[id_column].alias("sample_id"), df[text].alias("sample_text"))
    rows = map_values(narrow.join(F.broadcast(picked), "sample_id"), ["sample_id", "sample_label"], "sample_text", [("own", "binary"), ("n", "binary")], lambda texts: list(zip(*([x.astype("<i8").tobytes() for x in terms(t)] for t in texts), strict=True)))
    rows = sorted(rows.dropDuplicates(["sample_id"]).collect(), key=lambda r: r["sample_id"])
    kept = [(own, _weights(own, np.frombuffer(r["n"], "<i8"), idf)) for r in rows for own in [np.frombuffer(r["own"], "<i8")]]
    labels = np.array([r["sample_label"] for r in rows], np.float32)
    size = min(DIMENSIONS, len(kept))
    if not size:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)

    def times(m: np.ndarray) -> np.ndarray:
        return np.stack([w @ m[own] for own, w in kept])

    def back(m: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, m.shape[1]), np.float32)
        for (own, w), row in zip(kept, m, strict=True):
            out[own] += w[:, None] * row
        return out

    basis = times(np.random.default_rng(0).standard_normal((TERMS, min(2 * size, len(kept))), np.float32))
    for _ in range(3):
        basis = np.linalg.qr(times(back(np.linalg.qr(basis)[0])))[0]
    u, s, axes = np.linalg.svd(back(basis.astype(np.float32)).T, full_matrices=False)
    axes = np.ascontiguousarray(axes[:size].T.astype(np.float32))
    return Model(idf, axes, _unit(times(axes)), labels)


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Scores of unit vectors: exact cosines to all labelled vectors; nothing similar: the share of label 1."""
    near = vectors @ model.vectors.T
    k = min(NEIGHBOURS, near.shape[1])
    if not k:
        return np.full(len(vectors), model.base)
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    w = np.clip(np.take_along_axis(near, at, axis=1).astype(np.float64), 0, 1) ** SHARPNESS
    total = w.sum(axis=1)
    return np.where(total > 1e-9, (w * model.labels[at]).sum(axis=1) / np.where(total > 1e-9, total, 1), model.base).clip(0, 1)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` and the score of every row (1: like label 1). Null and empty texts have no terms: the share of label 1."""
    held = df.sparkSession.sparkContext.broadcast((model.idf, model.axes, model.vectors, model.labels))

    def make(texts: list) -> list:
        own = Model(*held.value)
        rows = np.zeros((len(texts), own.axes.shape[1]), np.float32)
        for k, value in enumerate(texts):
            at, n = terms(value)
            if len(at):
                rows[k] = _weights(at, n, own.idf) @ own.axes[at]
        return [vote(_unit(rows), own).tolist()]

    return map_values(df, keep, text, [(name, "double")], make, rows=256)


def accepted(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df with a score of at least the threshold, all their columns as they are."""
    name = free_name(df, "_score")
    return score(df, model, df.columns, text, name).where(F.col(name) >= threshold).drop(name)
