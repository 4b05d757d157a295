"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

The leaves of a word's tree are the ranks of its adjacent pairs; the root holds the lowest rank and,
among equals, the leftmost place.  Each merge changes at most three leaves, so it costs a logarithm
of the word's length.  Many words are worked on at once, one row of a matrix each, so that tree
building, reading the roots and updating paths are array operations.  A group of few words, such as
one very long word, has a tree of plain integers per word instead: the same tree, the same ids.

The vocabulary file is a parameter and is read on each machine, once per Python worker.  Words that
were met before come from a cache bounded in words and in characters, which is emptied when full.

Defined cases: a null text counts as empty and gives no ids.  Text that spells a special token gives
that token's id, as the file's own library does.  Words of any length are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encoded words that a worker remembers at most.
CACHE_WORDS = 300_000
#: Characters of words, ids and tokens that it holds before it is emptied.
CACHE_CHARS = 32_000_000
#: Groups of fewer words are merged word by word; array calls cost more than they save there.
FEW_WORDS = 16
#: Matrix cells of one group of words.
CELLS = 1 << 20
NONE = np.int64(1) << 62


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A lower-casing word-level BPE file: words apart from white space, `</w>` at each word's end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.end = model["end_of_word_suffix"] or ""
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + self.end] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = np.int64(size)
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        self.words = regex.compile(pattern)
        # The same classes where every character is ASCII.
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
        self.cache: dict[str, tuple[str, str]] = {}
        self.cached_chars = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merged(self, word_bytes: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(word_bytes)
        lengths = np.array([len(w) for w in word_bytes], np.int64)
        width = np.int64(1) << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for w in np.unique(width):
            members = np.flatnonzero(width == w)
            step = max(1, CELLS // int(w))
            for k in range(0, len(members), step):
                rows = members[k : k + step]
                if len(rows) < FEW_WORDS:
                    for i in rows:
                        out[i] = self._merge_word(word_bytes[i], int(w))
                    continue
                for i, ids in zip(rows, self._merge_group([word_bytes[i] for i in rows], lengths[rows], int(w))):
                    out[i] = ids
        return out

    @functools.cached_property
    def merges(self) -> dict[int, int]:
        """Key of a pair to its rank."""
        return dict(zip(self.keys.tolist(), self.rank.tolist()))

    def _merge_word(self, word: bytes, w: int) -> np.ndarray:
        """One word of at most w bytes; pair i stands at leaf w + i of its tree, as rank * w + i."""
        n, size, none, merges = len(word), int(self.size), int(NONE), self.merges
        codes = np.frombuffer(word, np.uint8)
        first = self.inner[codes]
        first[-1] = self.final[codes[-1]]
        full = np.full(2 * w, NONE, np.int64)
        ranks = self.ranks(first[:-1], first[1:])
        full[w : w + n - 1] = np.where(ranks < NONE, ranks * w + np.arange(n - 1), NONE)
        level = w
        while level > 1:
            half = level // 2
            full[half:level] = np.minimum(full[level : 2 * level : 2], full[level + 1 : 2 * level : 2])
            level = half
        tree, ids = array("q", full.tobytes()), array("q", first.tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        del full, first, ranks

        def put(leaf: int, value: int) -> None:
            """Sets a leaf; the way up ends where a node's minimum stays."""
            node = w + leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                low = value if value < other else other
                node >>= 1
                if tree[node] == low:
                    return
                tree[node] = value = low

        while tree[1] < none:
            rank, i = divmod(tree[1], w)
            j = after[i]
            k, p = after[j], before[i]
            new = ids[i] = int(self.made[rank])
            ids[j] = -1
            after[i] = k
            put(j, none)
            if p >= 0:
                found = merges.get(ids[p] * size + new)
                put(p, none if found is None else found * w + p)
            found = None
            if k < n:
                before[k] = i
                found = merges.get(new * size + ids[k])
            put(i, none if found is None else found * w + i)
        done = np.frombuffer(ids, np.int64)
        return done[done >= 0]

    def _merge_group(self, group: list[bytes], lengths: np.ndarray, w: int) -> list[np.ndarray]:
        """Words of at most w bytes, one row each; pair i of a row stands at leaf w + i of its tree."""
        n = len(group)
        filled = np.arange(w) < lengths[:, None]
        ids = np.full((n, w + 1), -1, np.int64)
        codes = np.frombuffer(b"".join(group), np.uint8)
        ids[:, :w][filled] = self.inner[codes]
        rows = np.arange(n)
        ids[rows, lengths - 1] = self.final[codes[np.cumsum(lengths) - 1]]
        after = np.where(filled, np.arange(1, w + 1), w)
        after = np.minimum(after, lengths[:, None])  # the place behind a word's end stands for none
        before = np.broadcast_to(np.arange(-1, w), (n, w + 1)).copy()
        tree = np.full((n, 2 * w), NONE, np.int64)
        pair = np.arange(w - 1) < (lengths - 1)[:, None]
        r = np.full((n, w - 1), NONE, np.int64)
        r[pair] = self.ranks(ids[:, : w - 1][pair], ids[:, 1:w][pair])
        tree[:, w : 2 * w - 1] = np.where(r < NONE, r * w + np.arange(w - 1), NONE)
        level = w
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        dead = np.zeros((n, w), bool)
        flat, width = tree.reshape(-1), 2 * w
        while True:
            rows = rows[tree[rows, 1] < NONE]
            if not len(rows):
                break
            top = tree[rows, 1]
            i = top % w
            j = after[rows, i]
            new = self.made[top // w]
            k = after[rows, j] if w > 1 else j
            ends = k >= lengths[rows]
            ids[rows, i] = new
            after[rows, i] = k
            before[rows, np.where(ends, w, k)] = i
            dead[rows, j] = True
            p = before[rows, i]
            right = np.where(ends, NONE, self.ranks(new, ids[rows, np.where(ends, 0, k)]))
            left = np.where(p < 0, NONE, self.ranks(ids[rows, np.maximum(p, 0)], new))
            for leaf, rank, on in ((i, right, None), (j, None, None), (p, left, p >= 0)):
                at = rows if on is None else rows[on]
                place = leaf if on is None else leaf[on]
                value = NONE if rank is None else (rank if on is None else rank[on])
                if rank is not None:
                    value = np.where(value < NONE, value * w + place, NONE)
                base, node = at * width, place + w
                flat[base + node] = value
                node = node >> 1
                while node.size and node[0] >= 1:
                    flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
                    node = node >> 1
        live = filled & ~dead
        return np.split(ids[:, :w][live], np.cumsum(live.sum(1))[:-1])

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # One character at a time, without the rule for a final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as they are."""
        if self.split_special is None or not any(s in text for s in self.special):
            text = self.normal(text)
            return self.ascii_words.findall(text) if text.isascii() else self.words.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            out += [part] if k % 2 else self.pieces(part)
        return out

    def learn(self, words: Iterable[str]) -> None:
        missing = [w for w in words if w not in self.cache]
        if len(self.cache) + len(missing) > CACHE_WORDS or self.cached_chars > CACHE_CHARS:
            self.cache.clear()
            self.cached_chars = 0
            missing = list(words)
        plain = [w for w in missing if w not in self.special]
        for w, ids in zip(plain, self.merged([w.encode() for w in plain])):
            self._keep(w, ids.tolist())
        for w in set(missing) & set(self.special):
            self._keep(w, [self.special[w]])

    def _keep(self, word: str, ids: list[int]) -> None:
        shown = self.cache[word] = self._shown(ids)
        self.cached_chars += len(word) + len(shown[0]) + len(shown[1])

    def _shown(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Per text: its ids in decimal and their tokens, each joined by one space."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*map(set, split)) if split else set())
        out = []
        for words in split:
            shown = [self.cache[w] for w in words]
            out.append((" ".join([s[0] for s in shown]), " ".join([s[1] for s in shown])))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: tokens joined by one space."""
        return " ".join([self.token[i] for i in ids])


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def by_chars(texts: list[str], limit: int) -> Iterator[slice]:
    """Runs of texts of about `limit` characters; a longer text is a run of its own."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


ENCODED = T.StructType([T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])


def encoded(text: Column, path: str) -> Column:
    """struct<ids, decoded>: decimal ids joined by one space, and what decoding gives back."""

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for series in batches:
            texts = [t or "" for t in series]
            done: list[tuple[str, str]] = []
            for part in by_chars(texts, 1_000_000):
                done += model.encode(texts[part])
            yield pd.DataFrame(done, columns=["ids", "decoded"], dtype=object)

    return run(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col).cast("string"), path).alias("e"))
    return rows.select("doc_id", "e.ids", "e.decoded")
