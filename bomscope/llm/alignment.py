"""Cross-tokenizer alignment: each distinct text is encoded by two tokenizers and their tokens are linked by bytes.

Texts are shuffled whole, so equal ones meet, and each distinct text is encoded and aligned once.  Tokenizer A (byte-level
BPE) encodes a space and the text, tokenizer B (pieces) the text, to which it adds the space itself; both then spell the
same bytes.  Byte offsets where tokens of both end cut the tokens into groups, and tokens whose byte ranges overlap are
linked.  What a text links is written once, as distinct id pairs and how often.  A pair's count is the number of its links in
the whole corpus, each text weighted by its rows.  The measures go back to all rows by the text's SHA-256.

Sizes: texts are shuffled once, after equal ones of a task became one.  Where there are at most BROADCAST_PAIRS different id
pairs, their counts are broadcast; otherwise pairs are joined by key, hot ones apart.  A B id's highest count is
one of at most as many rows as the vocabulary has.

Defined cases: a null or empty text, or one whose tokens do not spell its bytes, has no tokens: zeros and an empty
digest.  Strings of special tokens are plain text.  Every row has its own result, also where ids or texts repeat or ids
are null.  Without any link the counts are empty.  Extra columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomscope.llm.common import attached, staged, text_or_empty

#: Characters that are encoded at once.
SLICE = 1_000_000
#: Rows of 24 bytes.
BROADCAST_PAIRS = 1_000_000
ALIGNED = (
    "name binary, met long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
)
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes a printable byte as itself and the others, in order, as characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _numbers(size: int, first: str) -> np.ndarray:
    """Every id as it is written behind a comma, then every id as the first of its kind in a group."""
    return np.array([f"{mark}{k}" for mark in (",", first) for k in range(size)], object)


@dataclass
class Pair:
    """Two tokenizers and the bytes of their ids."""

    a: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    def __post_init__(self):
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.written_a, self.written_b = _numbers(len(self.bytes_a), ";"), _numbers(len(self.bytes_b), "|")

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return list(zip([e.ids for e in found], self.b.encode(texts, num_threads=1)))


@functools.lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    alphabet = byte_alphabet()
    bytes_a = [b""] * a.get_vocab_size()
    for entry, k in a.get_vocab().items():
        # An entry outside the alphabet is a special token, which no plain text gives.
        bytes_a[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else b""
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    if len(bytes_a) * b.get_piece_size() > np.iinfo(np.int32).max:
        raise ValueError("id pairs are numbered in 32 bits")
    bytes_b = [
        bytes([int(b.id_to_piece(k)[1:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
        for k in range(b.get_piece_size())
    ]
    return Pair(a, b, bytes_a, bytes_b)


def aligned(pair: Pair, a: list[int], b: list[int]) -> tuple[int, str, np.ndarray, np.ndarray]:
    """Groups and their written form; the A and B ids of every link, for ids that spell the same bytes."""
    ids_a, ids_b = np.array(a, np.int32), np.array(b, np.int32)
    ends_a, ends_b = np.cumsum(pair.lengths_a[ids_a]), np.cumsum(pair.lengths_b[ids_b])
    marks = np.zeros(ends_a[-1] + 1, np.uint8)
    marks[ends_a] = 1
    marks[ends_b] += 2
    # Between two neighbouring ends lies one overlap of one A and one B token.
    marks = marks[np.flatnonzero(marks)]
    is_a, is_b, both = marks != 2, marks != 1, marks == 3
    done_a, done_b, groups = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(both)
    links_a, links_b = ids_a[done_a - is_a], ids_b[done_b - is_b]
    # A group's A ids stand before its B ids: before an A id are the B ids of earlier groups, before a B id the A ids of its own too.
    group_a, group_b = (groups - both)[is_a], (groups - both)[is_b]
    out = np.empty(len(a) + len(b), object)
    first_a, first_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
    out[np.arange(len(a)) + np.concatenate([[0], done_b[both]])[group_a]] = pair.written_a[ids_a + first_a * len(pair.bytes_a)]
    out[np.arange(len(b)) + done_a[both][group_b]] = pair.written_b[ids_b + first_b * len(pair.bytes_b)]
    return int(groups[-1]), "".join(out.tolist())[1:], links_a, links_b


def align_texts(distinct: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per (name, met, text): its measures, and its distinct linked id pairs as a * size of B + b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        size_b = len(pair.bytes_b)

        def one(text: str, a: list[int], b: list[int]):
            spelled = b" " + text.encode()
            if not text or b"".join(map(pair.bytes_a.__getitem__, a)) != spelled or b"".join(map(pair.bytes_b.__getitem__, b)) != spelled:
                return 0, 0, 0, 0, "", np.empty(0, np.int32), np.empty(0, np.int32)
            groups, written, links_a, links_b = aligned(pair, a, b)
            codes, times = np.unique(links_a * np.int32(size_b) + links_b, return_counts=True)
            return len(a), len(b), groups, len(links_a), hashlib.sha256(written.encode()).hexdigest(), codes, times.astype(np.int32)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and (not texts or chars < SLICE):
                    texts.append(batch.column("text")[at + len(texts)].as_py())
                    chars += len(texts[-1])
                found = [one(t, a, b) for t, (a, b) in zip(texts, pair.encode(texts))]
                part = batch.slice(at, len(texts))
                at += len(texts)
                columns = list(zip(*found))
                sizes = np.cumsum([0] + [len(x) for x in columns[5]]).astype(np.int32)
                arrays = [part.column("name"), part.column("met"), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())]
                arrays += [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(c))) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in ALIGNED.split(", ")])

    return distinct.select("name", "met", "text").mapInArrow(run, ALIGNED)


def spread(texts: DataFrame, *keep: str) -> DataFrame:
    """A row for each distinct id pair of each text: what is kept of the text, pair, times."""
    return texts.select(*keep, F.explode(F.arrays_zip("pairs", "times")).alias("z")).select(*keep, "z.pairs", "z.times").withColumnRenamed("pairs", "pair")


def counted(texts: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best, met): links of each id pair in all rows, whether no pair of its B id has more, and its texts."""
    counts = staged(spread(texts, "met").groupBy("pair").agg(
        F.sum(F.col("met") * F.col("times")).alias("count"), F.count(F.lit(1)).alias("met")), "pairs")
    # As many rows as B has ids.
    most = F.broadcast(counts.groupBy((F.col("pair") % size_b).alias("_b")).agg(F.max("count").alias("_most")))
    return counts.join(most, F.col("pair") % size_b == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"), "met")


def align(
    docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id and the measures of every row."""
    named = lambda text: F.unhex(F.sha2(text, 256))
    distinct = docs.select(text_or_empty(text_col).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("met"))
    texts = staged(align_texts(distinct.withColumn("name", named(F.col("text"))), path_a, path_b), "aligned")
    counts = staged(counted(texts, len(tokenizers(path_a, path_b).bytes_b)), "counts")
    linked = spread(texts, "name")
    if counts.count() <= broadcast_pairs:
        linked = linked.join(F.broadcast(counts.drop("met")), "pair")
    else:
        linked = attached(linked, counts, "pair", "met")
    sums = linked.groupBy("name").agg(
        F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    # Names are unique here.
    none = F.lit(0).cast("long")
    whole = texts.join(sums, "name", "left").select(
        "name", "met", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
    rows = docs.select(F.col(id_col).alias("doc_id"), named(text_or_empty(text_col)).alias("name"))
    return attached(rows, staged(whole, "measures"), "name", "met").select("doc_id", *MEASURES)
