"""Registered queries against their SQL, and the pipeline against a plain version."""

import hashlib

import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.oracle import compare, duck
from ventara.llm import mixing, quality, queries
from ventara.llm.base import bucket_of, table


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    verdict = compare(queries.QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(queries.ORACLES[name]).df())
    assert not verdict or verdict.startswith("~"), verdict


def test_pipeline(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels.where(bucket_of("doc_id", 5) != 0).select("doc_id", "quality"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(documents, model, ["doc_id"]).collect()}
    docs = pd.read_parquet(sf_dir + "/documents.parquet")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.itertuples() if scores[r.doc_id] >= quality.THRESHOLD]
    assert 0 < len(rows) < len(docs)
    rows = [(i, kept, s, g) for (i, _, s, g), (_, _, kept) in zip(rows, brute.lines([(i, t) for i, t, _, _ in rows]), strict=True)]
    components = brute.near([(i, t) for i, t, _, _ in rows])
    rows = [r for r in rows if components[r[0]] == r[0]]
    sampled = brute.mix(rows, mixing.TEMPER, 30)
    library = Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation()
    want = {i: hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in library.encode(t, add_special_tokens=False).ids)).hexdigest() for i, t, _, _ in rows if sampled[i]}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


ODD = [
    (1, "one two three four five six seven\n" * 3 + "a line that repeats\nshared line of some length", "en", "s", 9, "x", 1),
    (2, "shared line of some length\nanother one here", "en", "s", 9, "y", 2), (2, "shared line of some length\nanother one here", "en", "s", 9, "y", 2),
    (3, None, None, None, None, None, None), (4, "", "de", None, 0, "", 0), (None, "no id, but a text of several words", "de", "t", 1, "z", 3), (5, "word " * 20_000, "fr", "t", 1, "z", 3),
    (6, "one two three four five six seven\n" * 3 + "a line that repeats\nshared line of some length", "en", "s", 9, "x", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lines string, _mix int"


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_on_odd_rows(spark, tmp_path, rows):
    """Rows without id or text pass or go by their score, repeated rows together; columns of any name come through."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        if name in ("lines", "mixing"):
            assert {r["_lines"] for r in after.collect()} <= {r[5] for r in rows}
        docs = after
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
