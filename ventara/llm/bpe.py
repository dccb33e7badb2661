"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled into a deterministic automaton over token labels that accepts exactly the BPE tokenizations.
It starts as one state with a loop for every byte. Merge number r, (a, b) -> t, adds a gadget: the state that a's arcs
reach is copied without its arc b, a's arcs lead to the copy, and wherever an arc a stands, an arc t is put beside it that
leads to the state behind b. All arcs of one label lead to one state, so a copy is kept as (state it copies, arc it lacks,
merge number) and an arc t added by merge r stands where arc left(t) stood then; a look-up follows these two links. A word is
encoded by the only path whose labels spell it. Every position of the word lies on at most one path, so the search is linear.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from ventara.llm.base import map_values

#: Fixed value: the splitting pattern of byte-level tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words (in two generations) and arcs remembered per Python worker; beyond that they are found anew, results do not change.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """Printable characters stand for their own byte, the other bytes for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges. labels: bytes of each token id; words outside the byte tokens of the vocabulary raise KeyError."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], specials: dict[str, int]):
        self.labels, self.specials = labels, specials
        self.left = left = array("l", [-1]) * len(labels)
        self.born = born = array("l", [-1]) * len(labels)
        made = {t for _, _, t in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token")
        self.base, self.cut, self.time = array("l", [-1]), array("l", [-1]), array("l", [-1])
        self.state = state = array("l", [-1]) * len(labels)
        for t, label in enumerate(labels):
            if len(label) == 1 and t not in made:
                state[t] = 0
        for r, (a, b, t) in enumerate(merges):
            if state[a] < 0 or state[b] < 0 or not self.allows(state[a], b):
                continue  # no such arcs: the merge never applies
            left[t], born[t], state[t] = a, r, state[b]
            self.base.append(state[a])
            self.cut.append(b)
            self.time.append(r)
            state[a] = len(self.base) - 1
        special = set(specials.values())
        #: Trie of the labels: node and byte to the next node; the token that ends at each node, or -1.
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        for t, label in enumerate(labels):
            if state[t] < 0 or t in special:
                continue
            node = 0
            for byte in label:
                node = self.trie.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = t
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def allows(self, s: int, t: int) -> bool:
        """Whether state s has an arc t."""
        base, cut, time, left, born = self.base, self.cut, self.time, self.left, self.born
        while s:
            if born[t] >= time[s]:
                t = left[t]
            elif t == cut[s]:
                return False
            else:
                s = base[s]
        return True

    def path(self, word: bytes) -> list[int]:
        """Labels of the accepted path that spells the word: the longest label first, back to shorter ones at a dead end."""
        trie, ends, state, arcs, n = self.trie.get, self.ends, self.state, self.arcs, len(word)
        out: list[int] = []
        left: list[list[tuple[int, int]]] = []
        at = s = 0
        while at < n:
            node, here, choices = 0, at, []
            while here < n:
                node = trie(node << 8 | word[here])
                if node is None:
                    break
                here += 1
                t = ends[node]
                if t >= 0:
                    choices.append((t, here))
            while True:
                if choices:
                    t, here = choices.pop()
                    key = s << 20 | t
                    ok = arcs.get(key)
                    if ok is None:
                        if len(arcs) >= REMEMBERED:
                            arcs.clear()
                        ok = arcs[key] = self.allows(s, t)
                    if ok:
                        break
                elif out:
                    out.pop()
                    choices = left.pop()
                    s = state[out[-1]] if out else 0
                else:
                    raise KeyError(word)
            out.append(t)
            left.append(choices)
            at, s = here, state[t]
        return out

    def __getstate__(self):
        return self.__dict__ | {"arcs": {}, "words": {}, "older": {}}

    def _put(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= 64:
            if len(self.words) >= REMEMBERED:
                self.words, self.older = {}, self.words
            self.words[chunk] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        ids = array("I", self.path(word.encode())).tobytes()
        return ids if sys.byteorder == "little" else np.frombuffer(ids, ">u4").astype("<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A space and a chunk, which no word crosses: split by the pattern, each word encoded."""
        if (ids := self.older.get(chunk)) is not None:
            return self._put(chunk, ids)
        words = _WORDS.findall(" " + chunk)
        if len(words) > 1:
            ids = b"".join([self._known(w) if w[0] == " " and len(w) > 1 else self._ids(w) for w in words])
            return self._put(chunk, ids)
        return self._put(chunk, self._ids(words[0]))

    def _known(self, word: str) -> bytes:
        return self.words.get(word[1:]) or self.older.get(word[1:]) or self._put(word[1:], self._ids(word))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of special tokens become their id.

        A word of the pattern starts at every space with a character that is no white space behind it, so a text is cut
        there first, and the chunks are looked up; only new chunks are split by the pattern.
        """
        parts = [text]
        if any(s in text for s in self.specials):
            parts = regex.split("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")", text)
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.specials[part]], "<u4").tobytes())
            elif part:
                chunks = part.split(" ") if not _GAP.search(part) else _SPACE.split(part)
                out += [self._ids(w) for w in _WORDS.findall(chunks[0])]
                out += [self.words.get(c) or self._chunk(c) for c in chunks[1:]]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The labels of the ids, emitted one after the other; bytes that are no UTF-8 become U+FFFD as in a text."""
        raw = b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


_WORDS = regex.compile(PATTERN)
_SPACE = regex.compile(r" (?=\S)")
_GAP = regex.compile(r" (?:\s|\Z)")


def load(path: str) -> Automaton:
    """Compile a tokenizer file."""
    return Automaton(**read(path))


def read(path: str) -> dict:
    """Labels, merges and special tokens of a tokenizer file (byte-level BPE in JSON form); as large as the vocabulary."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, alphabet = spec["model"], byte_alphabet()
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer") or model.get("ignore_merges"):
        raise ValueError("a byte-level BPE without normalizer is needed")
    if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
        raise ValueError("add_prefix_space and use_regex=false are not supported")
    vocab, specials = model["vocab"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    labels = [b""] * (1 + max([*vocab.values(), *specials.values()]))
    for token, i in vocab.items():
        labels[i] = bytes(alphabet[c] for c in token)
    for token, i in specials.items():
        labels[i] = token.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {"labels": labels, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], "specials": specials}


def _compiled(held) -> Automaton:
    """The automaton of a broadcast tokenizer, compiled once in each Python worker."""
    value = held.value
    if "automaton" not in value:
        value["automaton"] = Automaton(value["labels"], value["merges"], value["specials"])
    return value["automaton"]


def encode(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<bigint>) of every row; null text counts as empty, repeated rows are encoded each."""
    held = df.sparkSession.sparkContext.broadcast(read(tokenizer))
    return map_values(df, [id_column], text, [("ids", "array<bigint>")], lambda texts: [[np.frombuffer(_compiled(held).encode(t or ""), "<u4").astype("int64") for t in texts]])


def decode(df: DataFrame, tokenizer: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give the empty text."""
    held = df.sparkSession.sparkContext.broadcast(read(tokenizer))
    return map_values(df, [id_column], ids, [("text", "string")], lambda rows: [[_compiled(held).decode(np.array(x or [], "<u4").tobytes()).decode() for x in rows]])


def digests(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids. Null text counts as empty."""
    held = df.sparkSession.sparkContext.broadcast(read(tokenizer))

    def make(texts: list) -> list:
        automaton = _compiled(held)
        ids = [automaton.encode(t or "") for t in texts]
        return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(automaton.decode(x)).hexdigest() for x in ids]]

    return map_values(df, [id_column], text, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], make)
