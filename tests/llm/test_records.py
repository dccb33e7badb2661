"""Chats, media, pages and vectors on small tables."""

import hashlib
import html as entities
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from ventara.llm import chat, components, html, media, queries, vectors
from ventara.llm.base import Scratch


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, c string, x int"
    rows = [(1, 0, "user", "hi <|im_end|>\n<\\|x"), (1, 1, "assistant", "<|im_start|>user\nok"), (2, 0, "assistant", None), (2, 0, "assistant", ""), (2, None, None, "first"), (3, 0, "a\nb\\n<|", "t"), (None, 0, "user", "é😀"), (None, 1, "assistant", "z" * 50_000), (4, 0, "system", ""), (4, 1, "user", "q"), (4, 2, "user", "q"), (4, 3, "assistant", "a"), (4, 3, "assistant", "a")]
    rows += [(5, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in random.Random(1).sample(rows, len(rows))], schema)
    got = {r["conv_id"]: r for r in chat.digests(chat.segments(df)).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == sha(loss)
    assert {c: got[c]["n_faults"] for c in got} == {1: 0, None: 0, 2: 3, 3: 2, 4: 2, 5: 0}
    text = "".join(r["segment"] for r in chat.segments(df.where("conv_id = 1")).collect())
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 2 and got[1]["formatted_chars"] == len(text)
    assert chat.digests(chat.segments(df.limit(0))).count() == 0
    for x in ("<|", "<\\|", "<\\\\|im_end|>", "\\<|", "plain"):
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x) and chat.unescape_role(chat.escape_role(x + "\n\\n")) == x + "\n\\n"


def _plain_adpcm(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.MOVES[code])))
            out.append(value)
    return out


def test_media(spark):
    blocks = np.random.default_rng(1).integers(0, 256, (40, 36), dtype=np.uint8)
    assert media.adpcm_blocks(blocks).tolist() == [_plain_adpcm(bytes(b)) for b in blocks]
    assert media.MULAW[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and media.ALAW[[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    assert media.resample(np.array([0, 10, 20]), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20] and media.resample(np.array([0, 1, 2, 3]), 16000, 8000).tolist() == [0, 2]
    for codec in media.TAGS:
        assert media.unwrap(media.wrap(b"abc", codec, 8000, 36)) == (codec, 8000, 36, b"abc")
    with pytest.raises(ValueError):
        media.unwrap(b"no")
    rows = [(1, None, 9), (2, "", 9), (3, "é" * 288, 9), (4, "x" * 577, 9), (4, "x" * 577, 9), (None, "y" * 300_000, 9)]
    got = media.stored_features(spark.createDataFrame(rows, "doc_id long, text string, media int")).toPandas()
    assert len(got) == len(rows) and got[got.doc_id == 4].feature.nunique() == 1
    decoded = [-(((((~c & 15) << 3) + 132) << ((~c >> 4) & 7)) - 132) if ~c & 128 else ((((~c & 15) << 3) + 132) << ((~c >> 4) & 7)) - 132 for c in range(256)]
    for _, text, _ in rows:
        raw = (text or "").encode()
        held = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        row = got[got.payload_sha256 == hashlib.sha256(held).hexdigest()].iloc[0]
        assert row.n_bytes == len(raw) and row.payload_bytes == len(held) and row.media_bytes == len(held) + 44
        loud = [decoded[c] for c in held]
        sums = sum(abs(x) for k in range(0, len(held), media.BLOCK) for x in _plain_adpcm(held[k : k + media.BLOCK]))
        thin = b"".join(x.to_bytes(2, "little", signed=True) for x in loud[:: media.RATE // media.PCM_RATE])
        turns = sum((a < 0) != (b < 0) for a, b in zip(loud, loud[1:], strict=False))
        alaw = sum(int(media.ALAW[c]) ** 2 for c in held)
        assert row.feature == f"mulaw={sum(x * x for x in loud)},{turns};alaw={alaw};adpcm={sums};pcm={zlib.crc32(thin):08x}"
    assert media.stored_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    pcm = media.to_pcm(spark.createDataFrame([(media.wrap(bytes(range(256))),), (None,), (b"bad",)], "media binary")).collect()
    assert len(pcm[0]["pcm"]) == 256 and pcm[1]["pcm"] is None and pcm[2]["pcm"] is None


def _plain_article(source):
    start, end = source.find("<article>"), source.find("</article>")
    body = source[start + 9 : end if end >= 0 else None]
    body = body if end >= 0 else re.sub(r"<[^>]*$", "", body)
    parts = (" ".join(entities.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(x for x in parts if x)


def test_pages(spark, sf_dir):
    got = queries.op6_html(spark, sf_dir).toPandas().set_index("page_id")
    pages = pd.read_parquet(sf_dir + "/pages.parquet")
    assert all(got.text[i] == _plain_article(x) and got.n_chars[i] == len(got.text[i]) for i, x in zip(pages.page_id, pages.html, strict=True))
    prose = "A sentence of some length, with marks; and more of it, to be sure."
    page = f"<title>t</title><div id='menu'><a href='x'>Home</a></div><div class=\"post\"><h2>Title &amp; more</h2><p>{prose}<p>{prose} <i>in</i>side 1 < 2&nbsp;x</div><div class='comments'><p>{prose}</p></div><form>{prose}</form><script>if (a < b) {{}}</script><aside>{prose}</aside>"
    assert html.main_text(page) == f"Title & more\n\n{prose}\n\n{prose} inside 1 < 2 x"
    listed = f"<article><p>{prose}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article><p>{prose}</p>"
    assert html.main_text(listed) == f"{prose}\n\none\n\ntwo\n\na\n\nb"
    rows = [(1, None, "u"), (2, "", "u"), (3, "plain text", "u"), (4, "<p>" * 5000 + "deep", "u"), (4, "<p", "u"), (None, "<!-- x", None), (5, "<p>" + "word, " * 100_000, "u")]
    out = sorted((str(r["page_id"]), r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), ["page_id"]).collect())
    assert out == [("1", 0), ("2", 0), ("3", 10), ("4", 0), ("4", 4), ("5", 599_999), ("None", 0)]
    assert html.extract(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0
    rng = random.Random(4)
    for _ in range(500):
        html.main_text("".join(rng.choice(["<", ">", '"', "'", "a", "<p>", "</p>", '<div class="ad', "<!--", "-->", "&amp", "<script>", "<b>", "=", "</"]) for _ in range(50)))


_PROSE = "A sentence of some length, with marks; and more of it, to be sure."


def test_story_beside_a_marked_teaser():
    story = " ".join([_PROSE] * 8)
    page = f"<article><p>Teaser</p></article><div><p>{story}</p><p>{story}</p></div>"
    assert html.main_text(page).endswith(f"{story}\n\n{story}")


def test_words_do_not_remove_the_story():
    for words in ("has-sidebar", "entry-content has-sidebar", "post comments-open", "elementor-widget", "widget"):
        assert html.main_text(f"<div class='{words}'><article><p>{_PROSE}</p></article></div>") == _PROSE
        assert html.main_text(f"<div class='{words}'><p>{_PROSE}</p></div><div class='ad'><p>Buy it, now.</p></div>") == _PROSE


def test_lists_and_tables_of_an_unmarked_page():
    story = " ".join([_PROSE] * 5)
    inner = "<ul><li>one<li>two</ul><table><tr><td>12.5<td>3</table>"
    want = f"{story}\n\none\n\ntwo\n\n12.5\n\n3"
    menu = "<ul><li><a href='x'>Home</a><li><a href='y'>News</a></ul>"
    assert html.main_text(f"<div>{menu}</div><div class='post'><p>{story}</p>{inner}<p>{story}</p></div>") == f"{want}\n\n{story}"
    assert html.main_text(f"<div class='post'>{menu}<p>{story}</p>{inner}</div>") == want


def _bare(source, words=False):
    """A page without its marking, and without class, id and role as well."""
    source = source.replace("<article>", "<div>").replace("</article>", "</div>")
    return re.sub(r' (class|id|role)="[^"]*"', "", source) if words else source


def test_pages_without_marking_or_words():
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    want = [_plain_article(x) for x in pages]
    assert [html.main_text(_bare(x)) for x in pages] == want
    assert sum(html.main_text(_bare(x, words=True)) == w for x, w in zip(pages, want, strict=True)) >= 0.9 * len(pages)


@pytest.mark.parametrize("words", ["comment-list", "comments-area", "related-posts", "ad-box", "share-buttons", "cookie-banner", "widget-area"])
def test_what_stands_inside_an_article_without_being_part_of_it(words):
    page = f"<article><h1>Title</h1><p>{_PROSE}</p><p>{_PROSE} More.</p><div class='{words}'><p>{_PROSE} Or not.</p></div></article>"
    assert html.main_text(page) == f"Title\n\n{_PROSE}\n\n{_PROSE} More."


def test_links_in_main_are_no_content():
    page = f"<main><ul><li><a href=x>Home page</a><li><a href=y>News of the day</a></ul><p>{_PROSE}</p><p>{_PROSE}</p></main>"
    assert html.main_text(page) == f"{_PROSE}\n\n{_PROSE}"


@pytest.mark.parametrize("piece,text", [
    ("<svg width='1'/>", ""), ("<svg><path d='x'>", ""), ("<svg><g><svg><text>label</text></svg><text>more</text></g></svg>", ""), ("<iframe src=x />", ""), ("<iframe src=x>", ""),
    ("<object data=x></object>", ""), ("<noscript/>", ""), ("<noscript><p>turn it on</p></noscript>", ""), ("<select><option>a<option>b</select>", ""),
    ("<i title='the hidden truth'>kept, too</i>", "kept, too"), ("<i data-x='a hidden b'>kept, too</i>", "kept, too"), ("<i hidden>gone</i>", ""), ("<i aria-hidden='true'>gone</i>", ""), ("<i style='display: none'>gone</i>", ""),
    ("<math><mi>x</mi></math>", "x"),
])
def test_texts_that_are_not_lost(piece, text):
    page = f"<div class='post'><header><h1>The title</h1></header><p>{_PROSE} {piece}</p><p>{_PROSE} {_PROSE}</p></div>"
    assert html.main_text(page) == f"The title\n\n{_PROSE} {text}".rstrip() + f"\n\n{_PROSE} {_PROSE}"


def _plain_values(rows):
    """rows: (path, text, linked) of the text nodes; the fused value of each path, from the definition."""
    paths = {p for p, _, _ in rows}
    mean = {p: [sum(f(t) for q, t, _ in rows if q == p) / sum(q == p for q, _, _ in rows) for f in (len, lambda t: sum(c in ".,;:!?" for c in t))] for p in paths}
    out = {}
    for p in paths:
        sides = []
        for side in (0, 1):
            own = []
            for k, (q, _, _) in enumerate(rows):
                if q == p:
                    near = [(html.KERNEL[abs(d)], mean[rows[k + d][0]][side]) for d in (-2, -1, 0, 1, 2) if 0 <= k + d < len(rows)]
                    own.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
            sides.append(sum(own) / len(own))
        link = sum(len(t) for q, t, is_link in rows if q == p and is_link) / sum(len(t) for q, t, _ in rows if q == p)
        out[p] = math.log(1 + sides[0]) * math.log(2 + sides[1]) * (1 - link) ** 2
    return out


def test_ratios_against_the_definition():
    rng = random.Random(8)
    for _ in range(60):
        rows, source = [], ""
        for _ in range(rng.randrange(1, 12)):
            tag, name, link = rng.choice(["p", "div", "td"]), rng.choice(["", "a", "b7", "b12"]), rng.random() < 0.3
            text = " ".join(rng.choice(["word", "and,", "end.", "x"]) for _ in range(rng.randrange(1, 30)))
            source += f"<{tag} class='{name}'>" + (f"<a href=x>{text}</a>" if link else text) + f"</{tag}>"
            rows.append(((tag, re.sub(r"\d", "", name), link), text, link))
        page = html.Page(source)
        values, want = html.path_values(page), _plain_values(rows)
        got = {row[0]: values[page.paths[e]] for row, (_, e, _) in zip(rows, page.nodes, strict=True)}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        worth = [want[p] for p, _, _ in rows]
        lists = [k for k, (p, _, _) in enumerate(rows) if p[0] == "td"]
        kept = html.content(page)
        if len(rows) < 4 and not lists and "<div" not in source:  # no way down: the cut alone decides
            assert kept == {k for k, x in enumerate(worth) if x >= html.SHARE * max(worth)}


def _components(ids, linked):
    comp = np.array(ids)
    while True:
        new = np.array([min(comp[k], comp[linked[k]].min()) if linked[k].any() else comp[k] for k in range(len(comp))])
        if (new == comp).all():
            return comp
        comp = new


def test_vectors(spark):
    rng, rows = np.random.default_rng(3), []
    for _ in range(8):
        base = rng.standard_normal(16)
        rows += [base / np.linalg.norm(base) + rng.standard_normal(16) * rng.choice([0.01, 0.04, 0.07]) for _ in range(rng.integers(2, 40))]
    rows += [*rng.standard_normal((40, 16)), *([np.ones(16)] * 30)]
    rows += [np.array([np.cos(0.2 * k), np.sin(0.2 * k), *[0.0] * 14]) for k in range(20)]
    ids = rng.permutation(len(rows))
    odd = [(10000, None), (10001, [0.0] * 16), (10002, [float("nan")] * 16), (10003, [1.0, 2.0]), (10004, [2.0, 4.0]), (None, [1.0] * 16), (10005, []), (int(ids[0]), [float(x) for x in rows[0]]), (10006, [None, *[1.0] * 15])]
    data = [(int(i), [float(x) for x in v]) for i, v in zip(ids, rows, strict=True)] + odd
    got = vectors.near_duplicates(spark.createDataFrame([(*r, 5, "x") for r in data], "vec_id long, embedding array<double>, label int, id string")).toPandas()
    unit = np.stack(rows) / np.linalg.norm(np.stack(rows), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want, comp = dict(zip(ids, linked.sum(1), strict=True)), dict(zip(ids, _components(ids, linked), strict=True))
    assert len(got) == len(data)
    true = got[got.vec_id < 10000].drop_duplicates("vec_id")
    assert true.n_links.sum() >= 0.97 * sum(want.values()) and all(r.n_links <= want[r.vec_id] for r in true.itertuples())
    assert sum(r.component_id != comp[r.vec_id] for r in true.itertuples()) <= 0.03 * len(true)
    rest = got[~(got.vec_id < 10000)].set_index("vec_id")
    assert rest.n_links.to_dict() == {**{float(i): 0 for i in (10000, 10001, 10002, 10005, 10006)}, 10003.0: 1, 10004.0: 1, **{i: 0 for i in rest.index if i != i}} or rest.n_links.sum() == 2
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _group(n, noise=0.186, size=64, seed=5):
    """Unit vectors whose cosines are about 1 / (1 + noise ** 2): linked, but in no ball."""
    rng = np.random.default_rng(seed)
    base, more = rng.standard_normal(size), rng.standard_normal((n, size))
    base /= np.linalg.norm(base)
    more -= np.outer(more @ base, base)
    rows = base + noise * more / np.linalg.norm(more, axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _leaders(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v], 1, 0.0) for k, v in enumerate(rows)], "id long, v array<double>, n long, radius double")


def test_longer_lists_fill(spark):
    rows = _group(30)
    near = rows @ rows.T
    np.fill_diagonal(near, -2)
    graph = spark.createDataFrame([(k, int(j), float(near[k, j])) for k in range(30) for j in np.argsort(-near[k])[:6]], "src long, dst long, sim double")
    leaders = _leaders(spark, rows)
    sizes = leaders.selectExpr("id", "12 as size")
    lists = vectors._best(graph.union(vectors._refined(graph, leaders, sizes)), sizes).groupBy("src").count().collect()
    assert [r["count"] for r in lists] == [12] * 30


def test_dense_group_without_audit(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_audited", lambda leaders, turn: leaders.selectExpr("id as a", "id as b").where("false"))
    rows = np.concatenate([_group(200, 0.17), np.random.default_rng(6).standard_normal((150, 64))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    near = np.triu(rows @ rows.T, 1)
    assert (near >= 0.95).sum() == (near >= 0.9499).sum() == 19_900 and near.max() < vectors.TIGHT
    scratch = Scratch(spark, "test")
    links, _ = vectors.descend(scratch.keep(_leaders(spark, rows)), scratch)
    assert {(r["a"], r["b"]) for r in links.collect()} == set(zip(*(x.tolist() for x in np.nonzero(near >= 0.95)), strict=True))
    scratch.drop()


def test_low_recall_compares_all(spark, monkeypatch):
    # pairs in different blocks of tiny lists: the audits see what the lists lack
    monkeypatch.setattr(vectors, "AUDITS", 1)
    monkeypatch.setattr(vectors, "BLOCK", 1)
    rows = np.repeat(np.random.default_rng(7).standard_normal((60, 64)), 2, axis=0) + 0.1 * np.random.default_rng(8).standard_normal((120, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    monkeypatch.setattr(vectors, "AUDITED", 5)
    scratch = Scratch(spark, "test")
    links, recall = vectors.descend(scratch.keep(_leaders(spark, rows)), scratch)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(k, k + 1) for k in range(0, 120, 2)} and recall == 1.0
    scratch.drop()


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 200 + k) for k in range(40)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)] + [(None, 1), (5, 5)]
    scratch = Scratch(spark, "test")
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    parent = {}
    for a, b in links:
        if a is not None and a != b:
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert got == {x: find(x) for x in parent}
    scratch.drop()
