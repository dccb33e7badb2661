"""Cross-tokenizer alignment against a plain version with the libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ventara.llm import align, bpe, queries

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)] of whole texts, group by group."""
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    first.no_truncation()
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    labels, alphabet = {}, bpe.byte_alphabet()
    for token, i in first.get_vocab().items():
        labels[i] = bytes(alphabet[c] for c in token if c in alphabet)
    spelt = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    found, holders = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        a, b, whole = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text), (" " + text).encode()
        wa, wb = [labels[t] for t in a], [spelt(t) for t in b]
        if b"".join(wa) != whole or b"".join(wb) != whole:
            found.append(None)
            continue
        ea, eb = np.cumsum([len(w) for w in wa]).tolist(), np.cumsum([len(w) for w in wb]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            i1, j1 = ea.index(cut, i) + 1, eb.index(cut, j) + 1
            groups.append((a[i:i1], b[j:j1]))
            i, j = i1, j1
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        holders.update(set(links))
        found.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (x, _), n in holders.items():
        top[x] = max(top[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = f
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((na, nb, len(groups), len(links), sum(holders[k] == top[k[0]] for k in links), sum(holders[k] for k in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**62, n))
        made = align.PerfectHash.build(keys)
        assert sorted(made.slots(keys)) == list(range(len(keys)))
        held = keys[np.argsort(made.slots(keys))]
        other = rng.integers(0, 2**62, 100)
        slots = made.slots(other)
        assert not any(s >= 0 and len(held) and held[s] == k for s, k in zip(slots, other, strict=True) if k not in keys)


def test_cuts_do_not_change_tokens():
    aligner = align.Aligner(**{k: v for k, v in align.read(*FILES).items()})
    rng = random.Random(2)
    parts = ["a", "The", "word", " ", "  ", "\n", "\t", " \n", "é", "😀", "\x1c", "\x85", "　", "᠎", "​", "'s", "12", ".", ",", "<s>", "<|endoftext|>", "▁", "\x00", "ﬁ", "ab" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    want = brute(texts)
    for known, row in zip(aligner.learn(texts, spell=True), want, strict=True):
        if known is None:
            assert row[0] == 0
        else:
            assert (*aligner.counts.all[known].sum(0).tolist(), hashlib.sha256(";".join(aligner.groups[p] for p in known).encode()).hexdigest()) == (*row[:4], row[6])
    assert sum(r[0] > 0 for r in want) > 1000


@pytest.mark.parametrize("looked_up", [align.LOOKED_UP, 3])
def test_odd_rows(spark, looked_up):
    texts = [None, "", " ", "one two", "one two", "one two three <|endoftext|> <s>", "▁no", "été 😀\n\nx", "long " * 30_000, "x" * 100_000, "naïve one", "three one one"]
    rows = [(k % 9 if k < 11 else None, t, "n", 1) for k, t in enumerate(texts)]
    got = align.aligned(spark.createDataFrame(rows, "doc_id int, text string, n_a string, late int"), *FILES, looked_up=looked_up).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute(texts), strict=True)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert align.aligned(spark.createDataFrame([], "doc_id long, text string"), *FILES).count() == 0


def test_trees_of_several_levels(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(align, "FAN", 2)
    monkeypatch.setattr(align, "FLUSH", 2000)
    monkeypatch.setattr(align, "REMEMBERED", 5_000)
    _whole(queries.op11_align(spark, sf_dir).toPandas(), sf_dir)


def test_whole_table(spark, sf_dir):
    _whole(queries.op11_align(spark, sf_dir).toPandas(), sf_dir)


def _whole(got, sf_dir):
    docs = pd.read_parquet(sf_dir + "/documents.parquet")
    want = pd.DataFrame(brute([None if pd.isna(t) else t for t in docs.text]), columns=COLUMNS, index=docs.doc_id).sort_index()
    got = got.set_index("doc_id").sort_index()[COLUMNS]
    assert (got.to_numpy() == want.to_numpy()).all() and (got.index == want.index).all()
