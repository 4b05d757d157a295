"""Cost-balanced packing of documents into sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n.  Within a window of documents the pieces go, longest
first, each to the sequence of lowest cost that still has room for it; what fits nowhere whole is cut
over the gaps that are left, so every sequence but the last of a task is full.  Windows follow each
other inside a task and hand their rest on; the last rest of a task is laid out in sequences whose
lengths are powers of two, which need no padding.

No rows are shuffled: each task packs what it reads, in bounded memory.  Sequence ids carry the task's
number, so a task that runs again gives the same ids.

tiktoken's pattern engine runs out of stack on white space of hundreds of thousands of characters in a row, so such
runs are cut out before it and merged as the one piece that the pattern makes of them; the ids are the same.

Defined cases: a null text counts as empty; an empty text is its end mark alone.  Each row is a document
of its own, also where ids repeat or are null.  Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CAPACITY = 2048
#: Tokens that one window holds before it is packed.
WINDOW = 1_000_000
#: Sequence ids that one task may use.
PER_TASK = 1 << 36

#: White space of the pattern engine: Python's without the separators U+001C to U+001F.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of so many are cut out.
LONG_BLANK = 10_000
LONG_RUN = re.compile(f"[{BLANK}]{{{LONG_BLANK},}}")
#: What the cuts rest on: a run is one piece, less its last character if something follows.
CUT_RULE = r"|\s+(?!\S)|\s+"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def layout(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for full sequences and a rest at the end.

    Sequences are numbered from 0; all but the last are full.
    """
    total = sum(lengths)
    n = -(-total // capacity)
    if not n:
        return []
    room = np.full(n, capacity, np.int64)
    room[-1] = total - capacity * (n - 1)
    price, used = np.zeros(n), np.zeros(n, np.int64)
    out: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, seq: int) -> None:
        out.append((doc, start, length, seq, int(used[seq])))
        used[seq] += length
        room[seq] -= length
        price[seq] += cost(length)

    pieces, whole = [], 0
    spare = n - (room[-1] < capacity)
    for doc, length in enumerate(lengths):
        # Full-length cuts of long documents fill sequences of their own.
        cuts = min(length // capacity, spare - whole)
        for c in range(cuts):
            put(doc, c * capacity, capacity, whole)
            whole += 1
        if length > cuts * capacity:
            pieces.append((length - cuts * capacity, doc, cuts * capacity))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    left = []
    for length, doc, start in pieces:
        fits = np.flatnonzero(room >= length)
        if len(fits):
            put(doc, start, length, int(fits[price[fits].argmin()]))
        else:
            left.append((length, doc, start))
    gaps = iter(sorted(np.flatnonzero(room).tolist(), key=lambda s: (price[s], s)))
    seq = next(gaps, 0)
    for length, doc, start in left:
        while length:
            if not room[seq]:
                seq = next(gaps)
            take = int(min(length, room[seq]))
            put(doc, start, take, seq)
            length, start = length - take, start + take
    return out


def powers(n: int) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


@functools.lru_cache(maxsize=2)
def byte_bpe(ranks_path: str, pattern: str, special: str, special_id: int):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: special_id})


def encode_ordinary(model, text: str) -> list[int]:
    """Ids of a text without special tokens."""
    if len(text) < LONG_BLANK:
        return model.encode_ordinary(text)
    ids, at = [], 0
    for run in LONG_RUN.finditer(text):
        if not model._pat_str.endswith(CUT_RULE):
            raise ValueError(f"white space of {len(run[0])} characters in a row, and no rule to cut it by for this pattern")
        stop = run.end() - (run.end() < len(text))
        ids += model.encode_ordinary(text[at : run.start()])
        ids += model._core_bpe.encode_single_piece(text[run.start() : stop].encode())
        at = stop
    return ids + model.encode_ordinary(text[at:])


def encode(model, text: str, special: str, special_id: int) -> list[int]:
    parts = text.split(special)
    ids = encode_ordinary(model, parts[0])
    for part in parts[1:]:
        ids.append(special_id)
        ids += encode_ordinary(model, part)
    return ids


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, special: str = "<|endoftext|>", special_id: int = 50256,
    end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces with their ids, as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(ranks_path, pattern, special, special_id)
        first = TaskContext.get().partitionId() * PER_TASK
        used = 0
        held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens

        def emit(parts: list) -> pa.RecordBatch:
            cols = list(zip(*parts)) if parts else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, used
            plan = layout([len(h[2]) for h in held], capacity)
            total = sum(len(h[2]) for h in held)
            n, rest = -(-total // capacity), total % capacity
            tail = sorted((p for p in plan if rest and p[3] == n - 1), key=lambda p: p[4])
            full = [p for p in plan if not rest or p[3] < n - 1]
            parts = []
            for doc, start, length, seq, offset in full:
                i, s, ids, t = held[doc]
                parts.append((i, s + start, length, ids[start : start + length].tobytes(), t, first + used + seq, offset))
            used += n - bool(rest)
            kept = [(held[d][0], held[d][1] + s, held[d][2][s : s + m], held[d][3]) for d, s, m, _, _ in tail]
            if last and kept:
                for size in powers(rest):
                    offset = 0
                    while offset < size:
                        i, s, ids, t = kept.pop(0)
                        m = min(len(ids), size - offset)
                        parts.append((i, s, m, ids[:m].tobytes(), t, first + used, offset))
                        offset += m
                        if m < len(ids):
                            kept.insert(0, (i, s + m, ids[m:], t))
                    used += 1
            held = kept
            yield emit(parts)

        tokens = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = encode(model, text, special, special_id)
                ids.append(end_id)
                held.append((doc_id, 0, np.array(ids, "<u4"), len(ids)))
                tokens += len(ids)
                if tokens >= WINDOW:
                    yield from flush(last=False)
                    tokens = sum(len(h[2]) for h in held)
        yield from flush(last=True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)
