"""Language identification by rank-order profiles.

A text is lower-cased and reduced to its words of letters; its n-grams are those of one to three characters inside the
words with a mark at both ends. The profile of a language lists its most frequent n-grams over all its texts, that of a
document the most frequent ones of its whole text, both by falling count and then by code points. The out-of-place distance
adds, for each n-gram of the document, how far its rank is from its rank in the language, or a full profile where it is absent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventara.llm.base import map_values

#: Length of a profile, and the most languages that may be learned (their profiles are sent to every task).
PROFILE, LANGUAGES = 300, 2000

#: N-gram codes gathered in a task before they are counted, and distinct ones kept before they are emitted.
GATHERED, DISTINCT = 1 << 21, 1 << 19

UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


class Grams:
    """N-gram codes of texts: three fields of 21 bits, code points or 0 for a mark or an unused field; pairs have the top bit."""

    def __init__(self):
        self.letter = _letters()

    def codes(self, text: str | None) -> np.ndarray:
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
        known = self.letter[np.minimum(points, 0xFFFF)]
        far = points > 0xFFFF
        if far.any():
            known = np.where(far, False, known)
            own, at = np.unique(points[far], return_inverse=True)
            known[far] = np.array([chr(c).isalpha() for c in own])[at]
        symbols = np.zeros(len(points) + 2, np.uint64)
        symbols[1:-1] = np.where(known, points, 0)
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        s = symbols[keep]
        if len(s) < 3:
            return np.zeros(0, np.uint64)
        pairs = s[:-1] << np.uint64(21) | s[1:]
        pair = np.uint64(1 << 63)  # a pair is told from a triple that begins with a mark
        triples = (pairs[:-1] << np.uint64(21) | s[2:])[s[1:-1] != 0]
        return np.concatenate([s[s != 0], pairs | pair, triples])

    def profile(self, text: str | None) -> np.ndarray:
        """The most frequent codes, best first; a text has at most PROFILE of them."""
        codes = np.sort(self.codes(text))
        if not len(codes):
            return codes
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.diff(np.append(starts, len(codes)))
        return codes[starts[np.argsort(-counts, kind="stable")[:PROFILE]]]


def counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): n-gram counts over whole texts; rows without a language or text count nothing."""

    def run(batches):
        grams, held, size, totals = Grams(), {}, 0, {}

        def fold():
            for name, parts in held.items():
                own, n = np.unique(np.concatenate(parts), return_counts=True)
                if name in totals:
                    both = np.concatenate([totals[name][0], own])
                    own, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([totals[name][1], n]), len(own)).astype(np.int64)
                totals[name] = own, n
            held.clear()

        def rows():
            for name, (own, n) in totals.items():
                for at in range(0, len(own), 50_000):
                    part = own[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[at : at + 50_000], pa.int64())], names=["lang", "gram", "n"])
            totals.clear()

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                codes = grams.codes(value.as_py())
                held.setdefault(name.as_py(), []).append(codes)
                size += len(codes)
                if size >= GATHERED:
                    fold()
                    size = 0
                    if sum(len(own) for own, _ in totals.values()) >= DISTINCT:
                        yield from rows()
        fold()
        yield from rows()

    found = df.where(df[lang].isNotNull() & df[text].isNotNull()).select(df[lang].cast("string").alias("lang"), df[text].alias("text"))
    return found.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Profiles of all languages of the rows: at most LANGUAGES x PROFILE codes, gathered on the driver."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")  # codes as unsigned numbers
    top = counts(df, text, lang).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    rows = top.limit(LANGUAGES * PROFILE + 1).collect()
    profiles: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    if len(profiles) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {name: np.array(codes, np.int64).view(np.uint64) for name, codes in profiles.items()}


def predict(df: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score (1: all n-grams in place, 0: none known).

    `und` with score 0 for a text that is null or has no letter, and where nothing was learned. Ties go to the first name.
    """
    names = sorted(profiles)
    known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
    ranks = np.full((len(known) + 1, len(names)), -1, np.int32)  # the last row: a code that no profile has
    for k, name in enumerate(names):
        ranks[np.searchsorted(known, profiles[name]), k] = np.arange(len(profiles[name]))
    held = df.sparkSession.sparkContext.broadcast((names, known, ranks))

    def make(texts: list) -> list:
        names, known, ranks = held.value
        grams, found, scores = Grams(), [], []
        for value in texts:
            own = grams.profile(value)
            if not len(own) or not names:
                found.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            at[known[at] != own] = len(known)
            theirs = ranks[at]
            places = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
            best = int(places.argmin())
            found.append(names[best])
            scores.append(max(0.0, 1.0 - float(places[best]) / (PROFILE * len(own))))
        return [found, scores]

    return map_values(df, keep, text, [("lang_pred", "string"), ("score", "double")], make, rows=2000)
