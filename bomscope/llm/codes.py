"""Vector code compression: product quantisation whose rounds skip distances by adaptive bounds.

A vector's components become integers and are cut into PARTS parts; each position has a codebook of ENTRIES
entries.  A round assigns every part to its nearest entry and moves the entries to the floored means of
their parts.  All distances that decide are integers, so results do not depend on the order of work.

The first assignment measures all entries and keeps, for each part, its entry, the b next entries in order with
lower bounds of their distances, and one outer bound for all entries beyond.  These rows are written to the
shared folder.  A later assignment lowers the bounds by what the entries moved, puts them in order, and measures
the part's own entry.  If that is nearer than the first bound, nothing else is measured; if the bound that lies
beyond it has rank z, only the entries before z are measured; beyond the outer bound all are.  b shrinks to
the rank that settles nearly all parts of a slice.  Bounds are stored rounded down, in half precision.

One task holds a slice of vectors and the codebooks, whose size does not depend on the data.  Entry sums are made per
task and added up by Spark.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped.  The length of
the vectors is the most frequent one that can be cut evenly (the longer of two); rows of another length, or with a
component too large for sums in 64 bits, stay with null code and error.  Ids may repeat or be null: each row
is coded by itself, nulls count as the largest ids, and equal ids are in the order of their vectors.  With
fewer rows than ENTRIES the codebooks are as small as that.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomscope.llm.common import attached, discard, staged, workspace

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2
#: Components that are worked on at once.
SLICE = 1 << 18
#: Share of a slice's parts that the shrunk bound lists would have settled.
SETTLED = 0.98
STATE = "code binary, near binary, lower binary, outer binary"


def integers(vector, scale: int = SCALE):
    return F.transform(vector, lambda x: F.floor(x * scale))


def finite(vector):
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd), F.lit(False))


def largest(width: int) -> int:
    """Size of the largest component for which squared distances of `width` components stay below 2**62."""
    return min(math.isqrt((1 << 62) // max(width, 1)) // 2, (1 << 31) - 1)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x (n, m) to its entries (n, c, m) or to all of entries (c, m)."""
    if entries.ndim == 2:
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    step = x[:, None, :] - entries
    return (step * step).sum(2)


def below(values: np.ndarray) -> np.ndarray:
    """The largest half-precision numbers that are not above the values."""
    values = np.maximum(values, 0.0)
    half = np.where(np.isinf(values), np.inf, np.minimum(values, 65504.0)).astype(np.float16)
    return np.where(half.astype(np.float64) > values, np.nextafter(half, np.float16(-np.inf)), half).astype(np.float16)


def roots_below(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)), 0.0)


def nearest(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """Measured from all entries: code, b next entries, their lower bounds, outer bound, squared distance."""
    d = squared(x, book)
    order = np.argsort(d, axis=1, kind="stable")  # ties: the lower index first
    d = np.take_along_axis(d, order, 1)
    b = min(b, len(book) - 1)
    outer = roots_below(d[:, b + 1]) if len(book) > b + 1 else np.full(len(x), np.inf)
    return order[:, 0], order[:, 1 : b + 1], roots_below(d[:, 1 : b + 1]), outer, d[:, 0]


def renewed(x, book, moved, code, near, lower, outer) -> tuple[np.ndarray, ...]:
    """As `nearest`, from the bounds of the round before and what each entry has moved since; and the ranks needed."""
    b = near.shape[1]
    bounds = np.concatenate([np.nextafter(lower - moved[near], -np.inf), np.nextafter(outer - moved.max(initial=0.0), -np.inf)[:, None]], 1)
    # In order: each bound holds for its entry and all that follow.
    bounds = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]
    own = squared(x, book[code][:, None, :])[:, 0]
    upper = np.nextafter(np.sqrt(own.astype(np.float64)), np.inf)
    need = (upper[:, None] >= bounds).sum(1)
    code, near, best = code.copy(), near.copy(), own.copy()

    some = np.flatnonzero((need > 0) & (need <= b))
    if len(some):
        entries = np.concatenate([code[some][:, None], near[some]], 1)
        d = squared(x[some], book[entries])
        rank = np.arange(b + 1)
        # Entries beyond the needed rank keep their place behind those that are measured.
        place = np.where(rank <= need[some][:, None], 0, rank)
        order = np.lexsort((entries, np.where(place == 0, d, 0), place), axis=1)
        entries, d = np.take_along_axis(entries, order, 1), np.take_along_axis(d, order, 1)
        code[some], near[some], best[some] = entries[:, 0], entries[:, 1:], d[:, 0]
        known = rank[1:] <= need[some][:, None]
        bounds[some, :b] = np.where(known, roots_below(d[:, 1:]), bounds[some, :b])
    every = np.flatnonzero(need > b)
    if len(every):
        c, n, low, out, d = nearest(x[every], book, b)
        code[every], near[every], best[every] = c, n, d
        bounds[every, :b], bounds[every, b] = low, out
    bounds = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]
    return code, near, bounds[:, :b], bounds[:, b], best, need


def shrunk(need: np.ndarray, b: int, entries: int) -> int:
    """Length of the bound lists that settles the share SETTLED of what the present lists settle."""
    inside = need[need <= b]
    wanted = int(np.quantile(inside, SETTLED, method="higher")) if len(inside) else b
    return max(1, min(b, max(wanted, entries // 16)))


def _blobs(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    offsets = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(a.tobytes())])


def _matrix(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape)


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    size = max(1, SLICE // width)
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        x = part.column("parts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield part, x.reshape(part.num_rows, PARTS, width // PARTS)


def _with_state(rows: DataFrame, books: np.ndarray, columns: list[str]) -> DataFrame:
    """First assignment: the rows with their code and bounds."""
    parts, entries, m = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _slices(batch, parts * m):
                found = [nearest(x[:, p], books[p], max(1, entries // 8)) for p in range(parts)]
                yield _state_rows(part, columns, *[np.stack([f[i] for f in found], 1) for i in range(4)])

    return rows.mapInArrow(run, f"{_ddl(rows, columns)}, {STATE}")


def _state_rows(part, columns, code, near, lower, outer) -> pa.RecordBatch:
    blobs = [_blobs(code.astype(np.uint8)), _blobs(near.astype(np.uint8)), _blobs(below(lower)), _blobs(below(outer))]
    return pa.RecordBatch.from_arrays([part.column(c) for c in columns] + blobs, names=[*columns, "code", "near", "lower", "outer"])


def _ddl(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def _renewed(part: pa.RecordBatch, x: np.ndarray, books: np.ndarray, moved: np.ndarray):
    """Rows of a slice with equally long bound lists: (row numbers, what `renewed` gives for each position)."""
    near = part.column("near").to_pylist()
    sizes = np.array([len(v) for v in near])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = part.take(pa.array(at))
        n, b = len(at), int(size) // PARTS
        code = _matrix(rows.column("code"), np.uint8, (n, PARTS)).astype(np.int64)
        listed = _matrix(rows.column("near"), np.uint8, (n, PARTS, b)).astype(np.int64)
        lower = _matrix(rows.column("lower"), np.float16, (n, PARTS, b)).astype(np.float64)
        outer = _matrix(rows.column("outer"), np.float16, (n, PARTS)).astype(np.float64)
        yield rows, [renewed(x[at, p], books[p], moved[p], code[:, p], listed[:, p], lower[:, p], outer[:, p]) for p in range(PARTS)]


def _next_state(rows: DataFrame, books: np.ndarray, moved: np.ndarray, columns: list[str]) -> DataFrame:
    width = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _slices(batch, width):
                for own, found in _renewed(part, x, books, moved):
                    code, near, lower, outer, _, need = [np.stack([f[i] for f in found], 1) for i in range(6)]
                    b = near.shape[2]
                    if b:
                        less = shrunk(need.ravel(), b, books.shape[1])
                        if less < b:
                            near, lower, outer = near[:, :, :less], lower[:, :, :less], lower[:, :, less]
                    yield _state_rows(own, columns, code, near, lower, outer)

    return rows.mapInArrow(run, f"{_ddl(rows, columns)}, {STATE}")


def _final(rows: DataFrame, books: np.ndarray, moved: np.ndarray, columns: list[str]) -> DataFrame:
    width = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _slices(batch, width):
                for own, found in _renewed(part, x, books, moved):
                    code = np.stack([f[0] for f in found], 1).astype(np.uint8)
                    error = np.stack([f[4] for f in found], 1).sum(1)
                    shown = pa.array([c.tobytes().hex() for c in code], pa.string())
                    yield pa.RecordBatch.from_arrays([own.column(c) for c in columns] + [shown, pa.array(error, pa.int64())], names=[*columns, "code", "error"])

    return rows.mapInArrow(run, f"{_ddl(rows, columns)}, code string, error long")


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floored means of the parts of each entry; unused entries stay."""
    parts, entries, m = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, m + 1), np.int64)
        for batch in batches:
            for part, x in _slices(batch, parts * m):
                code = _matrix(part.column("code"), np.uint8, (part.num_rows, PARTS))
                for p in range(parts):
                    order = np.argsort(code[:, p], kind="stable")
                    used, first, count = np.unique(code[order, p], return_index=True, return_counts=True)
                    sums[p, used, :m] += np.add.reduceat(x[order, p], first, axis=0)
                    sums[p, used, m] += count
        at = np.argwhere(sums)
        columns = [*at.T.astype(np.int32), sums[tuple(at.T)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "total"])

    tallied = state.select("parts", "code").mapInArrow(run, "part int, entry int, place int, total long")
    sums = np.zeros((parts, entries, m + 1), np.int64)
    # As many rows as the codebooks have numbers.
    for r in tallied.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
        sums[r["part"], r["entry"], r["place"]] = r["total"]
    count = sums[:, :, m:]
    return np.where(count > 0, sums[:, :, :m] // np.maximum(count, 1), books)


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    step = new - old
    return np.nextafter(np.sqrt((step * step).sum(2).astype(np.float64)), np.inf)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row with a finite vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark = rows.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("v")).filter(F.col("v").isNotNull() & finite(F.col("v")))
    size = F.size("v")
    common = (kept.groupBy(size.alias("width")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("width") > 0) & (F.col("width") % PARTS == 0))
              .orderBy(F.desc("n"), F.desc("width")).first())
    width = common["width"] if common else 0
    limit = largest(width)
    fits = (size == width) & (size > 0) & ~F.exists("v", lambda x: (x * SCALE >= limit + 1) | (x * SCALE < -limit))
    kept = kept.withColumn("parts", F.when(fits, integers(F.col("v")).cast("array<int>"))).drop("v")
    uncoded = kept.filter("parts IS NULL").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    usable = kept.filter("parts IS NOT NULL")

    # The first entries: a fixed number of rows.
    first = usable.orderBy(F.asc_nulls_last("vec_id"), "parts").select("parts").limit(entries).collect()
    books = np.array([r["parts"] for r in first], np.int64).reshape(len(first), PARTS, -1 if first else 0).transpose(1, 0, 2)
    if first:
        columns = ["vec_id", "label", "parts"]
        path = workspace(spark, "codes")
        _with_state(usable, books, columns).write.option("compression", "zstd").parquet(path)
        for k in range(rounds):
            state = spark.read.parquet(path)
            after = _means(state, books)
            books, moved = after, _moved(books, after)
            if k < rounds - 1:
                older, path = path, workspace(spark, "codes")
                _next_state(state, books, moved, columns).write.option("compression", "zstd").parquet(path)
                discard(spark, older)
        coded = staged(_final(spark.read.parquet(path), books, moved, ["vec_id", "label"]).unionByName(uncoded), "coded")
        discard(spark, path)
    else:
        coded = staged(uncoded, "coded")
    labels = staged(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("met")), "labels")
    return attached(coded, labels, "label", "met").select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
