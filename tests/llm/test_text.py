"""Tokens, lines, languages, quality, near-duplicates and mixing on small tables, against plain versions."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from ventara.llm import bpe, langid, lines, mixing, neardup, quality, queries
from ventara.llm.base import bucket_of, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, sig long, hash string, batch int"


def docs(spark, rows):
    """Documents (id, text, lang, source), with extra columns that have the names operators use inside."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", "y", 1, "z", 2) for i, t, g, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "tree", "House", "runs", "blue", "12", "sky", "on", "Ärger", "under", "we", "see"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, missing ids."""
    rng = random.Random(5)
    base = prose(rng, 60)
    words = base.split()
    near = " ".join(words[:50] + ["changed"] + words[51:])
    long = "\n".join(prose(rng, 12) for _ in range(4000))
    shared = "  A line that Stands in many documents \t"
    rows = [(1, None, "en", None), (2, "", None, "s"), (3, " \t\n ", "en", "s"), (4, long, "en", "s"), (5, base, "de", "t"), (6, base.upper(), "de", "t"), (7, near, None, "t"), (8, "two words", "en", "t"), (9, "Two  WORDS", "en", "s")]
    rows += [(20 + k, prose(rng, 9) + "\n" + shared + "\n" + prose(rng, 30) + "\n" + shared.lower() + "\nshort", "en", "s" if k % 3 else "t") for k in range(12)]
    rows += [(25, rows[14][1], "en", "s"), (None, base, "en", "s"), (40, long, "en", "s"), (41, shared + "\n" * 3, "en", "s"), (42, "İ 123 @x licensed\n" + shared.replace("A", "Ä"), "fr", "u")]
    return rows


def test_lines(spark, odd):
    got = lines.dedup(docs(spark, odd)).collect()
    assert [c for c in lines.dedup(docs(spark, odd)).columns][:-1] == docs(spark, odd).columns
    want = sorted((str(r[0]), str(r[1]), *w) for r, w in zip(odd, brute.lines([(i, t) for i, t, _, _ in odd]), strict=True))
    assert sorted((str(r["doc_id"]), str(r["text"]), *r["_lines"]) for r in got) == want
    assert lines.dedup(docs(spark, [])).count() == 0


def test_runs_are_levelled(spark):
    held = lines.Runs(spark, 2, 2)
    keys = lambda a, b: spark.range(a, b).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("hash"), F.col("id").alias("owner"), F.col("id").alias("last"))
    held.add(keys(0, 10))
    held.compact()
    assert held.add(keys(5, 15)).where("seen").count() == 5
    held.compact()
    assert [len(x) for x in held.levels] == [0, 1] and held.all()[0].count() == 15
    held.close()


def test_near_duplicates(spark, odd):
    got = neardup.near_duplicates(docs(spark, odd)).collect()
    want = brute.near([(i, t) for i, t, _, _ in odd if i is not None])
    assert len(got) == len(odd)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    sizes = {(r["doc_id"], r["n_shingles"]) for r in got}
    assert sizes == {(i, len(brute.shingles(t))) for i, t, _, _ in odd}
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_with_chains(spark):
    """Copies that drift apart, so that a group hangs together by chains and its bucket keeps several components."""
    rng = random.Random(9)
    rows, words = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(60):
        words = [w if rng.random() > 0.025 else f"w{rng.randrange(10**6)}" for w in words]
        rows.append((100 - k, " ".join(words), "en", "s"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute.near([(i, t) for i, t, _, _ in rows])


def test_bounds_keep_similar_pairs():
    rng = np.random.default_rng(1)
    same = rng.random((4000, neardup.HASHES)) < 0.751
    left = np.zeros((1, neardup.HASHES), np.uint8)
    kept, _ = neardup._sequential(left, (~same).astype(np.uint8), np.zeros(4000, int), np.arange(4000), neardup.bounds())
    assert len(kept) >= 4000 * (1 - 20 * neardup.MISS)
    apart = rng.random((4000, neardup.HASHES)) < 0.5
    assert not len(neardup._sequential(left, (~apart).astype(np.uint8), np.zeros(4000, int), np.arange(4000), neardup.bounds())[0])


def test_tokens(spark, odd):
    library = Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", "é", "日", "<|endoftext|>", "'s", "'ll", "!", "\xa0", "\x1c", "😀", "A", "the", "ing", "\r", "²", "<|"]
    made = [(1000 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(40))), "en", "s") for k in range(300)]
    made += [(2000, "a" * 3000, "en", "s"), (2001, " " * 3000 + "x", "en", "s")]
    rows = odd + made
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.digests(docs(spark, rows), queries.tokenizer_path()).collect()}
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs(spark, []), queries.tokenizer_path()).count() == 0
    encoded = bpe.encode(docs(spark, odd), queries.tokenizer_path())
    back = sorted((str(r["doc_id"]), r["text"]) for r in bpe.decode(encoded, queries.tokenizer_path()).collect())
    assert back == sorted((str(i), t or "") for i, t, _, _ in odd)


def test_automaton():
    labels = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"aa"]
    merges = [(0, 1, 3), (1, 2, 4), (3, 2, 5), (0, 0, 6)]
    a = bpe.Automaton(labels, merges, {})

    def merged(word):
        out = [labels.index(bytes([c])) for c in word]
        for x, y, t in merges:
            k = 0
            while k < len(out) - 1:
                if out[k : k + 2] == [x, y]:
                    out[k : k + 2] = [t]
                k += 1
        return out

    rng = random.Random(1)
    for _ in range(500):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        assert a.path(word) == merged(word)
    with pytest.raises(ValueError):
        bpe.Automaton(labels, [*merges, (0, 4, 5)], {})
    with pytest.raises(KeyError):
        a.path(b"x")


def test_languages(spark, sf_dir, odd):
    documents = table(spark, sf_dir, "documents")
    profiles = langid.learn(documents.where(bucket_of("doc_id", 4) != 2))
    assert all(len(p) == langid.PROFILE for p in profiles.values())
    found = langid.predict(documents, profiles, ["doc_id", "lang"]).toPandas()
    held = found[found.doc_id.map(lambda i: brute.crc(i, 4) == 2)]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    # the distance, plainly
    grams = langid.Grams()
    for r in documents.limit(5).collect():
        own = list(grams.profile(r["text"]))
        far = {g: sum(abs(k - list(p).index(x)) if x in p else langid.PROFILE for k, x in enumerate(own)) for g, p in profiles.items()}
        row = found[found.doc_id == r["doc_id"]].iloc[0]
        assert row.lang_pred == min(sorted(far), key=far.get) and abs(row.score - (1 - min(far.values()) / langid.PROFILE / len(own))) < 1e-9
    rows = langid.predict(docs(spark, [*odd, (50, "12 !!", "en", "s")]), profiles, ["doc_id", "text"]).collect()
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    nothing = langid.learn(docs(spark, []))
    assert not nothing and {r["lang_pred"] for r in langid.predict(docs(spark, odd), nothing, ["doc_id"]).collect()} == {"und"}


def test_quality(spark, sf_dir, odd):
    found = queries.op5_quality(spark, sf_dir.replace("0.001", "0.01")).toPandas()
    labels = pd.read_parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet").merge(found, on="doc_id")
    held = labels[labels.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert found.score.between(0, 1).all() and (found.held_out == found.doc_id.map(lambda i: brute.crc(i, 5) == 0)).all()
    none = quality.fit(docs(spark, odd), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs(spark, odd), none, ["doc_id"]).collect()} == {0.5}
    model = quality.fit(docs(spark, odd), spark.createDataFrame([(5, 1), (7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int"))
    # cosines and votes, plainly
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, odd), model, ["doc_id"]).collect()}
    for i, text, _, _ in odd:
        own, n = quality.terms(text)
        v = quality._weights(own, n, model.idf) @ model.axes[own] if len(own) else np.zeros(model.axes.shape[1])
        v = v / (np.linalg.norm(v) or 1)
        w = np.clip(model.vectors @ v, 0, 1) ** quality.SHARPNESS
        want = (w * model.labels).sum() / w.sum() if w.sum() > 1e-9 else model.base
        if i not in (25, 40):
            assert abs(rows[i] - want) < 1e-3
    kept = quality.accepted(docs(spark, odd), model)
    assert kept.columns == docs(spark, odd).columns


def test_mixing(spark, odd):
    rows = [r for r in odd if r[0] not in (25, None)]
    found = mixing.mixed(docs(spark, rows))
    assert found.columns[:-1] == docs(spark, rows).columns
    got = {r["doc_id"]: r["_mix"]["sampled"] for r in found.collect()}
    assert got == brute.mix([(i, t, s, g) for i, t, g, s in rows], mixing.TEMPER, 30)
    assert mixing.mixed(docs(spark, [])).count() == 0
    given = {"source": [("s", 0.5), ("t", 0.5)], "lang": [("en", 0.6), ("de", 0.4)], "topic": [("prose", 0.7), ("figures", 0.3)]}
    rng = random.Random(3)
    full = [(k, " ".join(["w"] * rng.randrange(1, 50)) + (" 1" if k % 2 else ""), ("en", "de")[k // 2 % 2], ("s", "t")[k // 4 % 2]) for k in range(200)]
    for most in (mixing.CELLS, 0):  # on the driver and by shuffle
        mixed = mixing.mixed(docs(spark, full), targets={m: dict(v) for m, v in given.items()}, most=most).select("source", "lang", "_mix.*").toPandas()
        mixed["weight"] = mixed.tokens * mixed.factor
        for margin, shares in given.items():
            held = mixed.groupby(margin).weight.sum() / mixed.tokens.sum()
            assert all(abs(held[v] - share) < 1e-6 for v, share in shares)
        assert mixed.probability.max() == 1.0
    assert {r["doc_id"]: r["_mix"]["sampled"] for r in mixing.mixed(docs(spark, rows), most=0).collect()} == got


def test_targets_that_cannot_be_met(spark):
    cells = [("s", "en", "prose", 60), ("t", "en", "prose", 40), ("u", "de", "prose", 0)]
    want = {"source": {"s": 0.25, "t": 0.25, "gone": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 1.0}}
    weight, rounds, residual, unmet = mixing.rake(cells, want)
    assert weight.tolist() == [50.0, 50.0, 0.0] and unmet == {"source": ["gone"], "lang": ["de"], "topic": []} and max(residual.values()) <= mixing.TOLERANCE and rounds < 5
    packed = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    for most in (mixing.CELLS, 0):
        found = mixing.fit(packed, want, most)
        assert found.unmet == unmet and max(found.residual.values()) <= mixing.TOLERANCE
        assert {r["source"]: r["factor"] for r in found.factors.collect()} == {"s": 50 / 60, "t": 50 / 40, "u": None}
    stuck = mixing.rake([("s", "en", "prose", 60), ("t", "de", "prose", 40)], {"source": {"s": 0.5, "t": 0.5}, "lang": {"en": 0.9, "de": 0.1}, "topic": {"prose": 1.0}})
    assert stuck[1] == mixing.ROUNDS and stuck[2]["source"] > 0.1  # two margins that contradict each other: the last one is met


def test_columns_that_bear_the_names_of_results(spark):
    df = spark.createDataFrame([(1, "a\nb", "en", "s", 1, 2)], "doc_id long, text string, lang string, source string, _mix int, _Lines int")
    assert mixing.mixed(df).columns == [*df.columns, "_mix_"] and lines.dedup(df).columns == [*df.columns, "_lines_"]
    assert mixing.mixed(df).first()["_mix_"]["topic"] == "prose" and lines.dedup(df).first()["_lines_"]["kept"] == "a\nb"
