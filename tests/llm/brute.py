"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

KEYS = ("source", "lang", "topic")


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def lines(docs):
    """docs: [(id, text)]; returns [(n_lines, n_dropped, kept)] in order."""
    holders = defaultdict(set)
    for i, text in docs:
        if i is not None and text is not None:
            for line in text.split("\n"):
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)])


def near(docs):
    """docs: [(id, text)]; returns {id: component} over links of similarity 0.75 or more."""
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in docs]
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 4 * len(s & t) >= 3 * len(s | t) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in parent}


def topic(text):
    text = text or ""
    return "legal" if "icense" in text else "contact" if "@" in text else "figures" if re.search("[0-9]", text) else "prose"


def mix(docs, temper, iterations):
    """docs: [(id, text, source, lang)]; returns {id: sampled}."""
    rows = [(i, s or "", g or "", topic(t), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s, g in docs]
    cells = Counter()
    for _, *cell, n in rows:
        cells[tuple(cell)] += n
    names, tokens = list(cells), np.array(list(cells.values()), float)
    weight, total = tokens.copy(), tokens.sum()
    for _ in range(iterations):
        for d, margin in enumerate(KEYS):
            values = sorted({c[d] for c in names})
            seen = {v: sum(t for c, t in zip(names, tokens, strict=True) if c[d] == v) for v in values}
            powers = {v: n ** temper[margin] for v, n in seen.items() if n > 0}
            for v in values:
                at = [k for k, c in enumerate(names) if c[d] == v]
                held = weight[at].sum()
                weight[at] *= (powers.get(v, 0) / sum(powers.values()) * total / held) if held > 0 else 0
    factor = {c: w / t if t else None for c, w, t in zip(names, weight, tokens, strict=True)}
    top = max((f for f in factor.values() if f is not None), default=1.0)
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return {i: draw(i) < (1.0 if factor[tuple(c)] is None else factor[tuple(c)] / top) for i, *c, _ in rows}
