"""Exact duplicates: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups.

Built-in expressions only.  Hashes are tallied before they are shuffled, so a text that a third of
all rows repeat arrives as one row per task.  Whole texts meet only the kept text of their group, in
a two-sided join on the hash whose large partitions Spark splits.

Defined cases: a null text counts as empty.  An id that is repeated with an equal text is one
document: its rows get the same verdict and `survivors` returns one of them.  A group whose ids are
all null keeps null.  An empty table gives an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomscope.llm.common import ascii_lower, staged, text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    return F.md5(text.cast("binary"))


def verdicts(
    docs: DataFrame,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    hashed: Callable[[Column], Column] = content_hash,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    base = docs.select(F.col(id_col).alias("doc_id"), normalise(text_or_empty(text_col)).alias("norm"))
    base = base.withColumn("digest", hashed(F.col("norm")))

    groups = base.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
    several = groups.filter("group_size > 1").withColumnRenamed("digest", "d")
    # Texts of the documents that stay in groups of several: the side to compare with.
    leaders = staged(
        base.join(several, base["doc_id"].eqNullSafe(several["keep_id"]) & (base["digest"] == several["d"]))
        .select("digest", "keep_id", "group_size", "norm")
        .dropDuplicates(["digest"]),
        "leaders",
    ).withColumnRenamed("norm", "leader")
    compared = base.join(leaders, "digest", "left").select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("leader").isNull() | (F.col("norm") == F.col("leader"))).alias("same"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
    )
    compared = staged(compared, "compared")
    verdict = [
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    ]
    colliding = compared.filter(~F.col("same")).select("digest").distinct()
    if colliding.isEmpty():
        return compared.select(*verdict)
    # Unequal texts under one hash: those groups are formed anew by the text itself.
    again = base.join(colliding, "digest", "left_semi")
    by_text = again.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
    again = again.join(by_text, "norm").withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    return compared.join(colliding, "digest", "left_anti").select(*verdict).unionByName(again.select(*verdict))


def survivors(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs` that stay, with all their columns: one row for each distinct text."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    norm = options.get("normalise", ascii_lower)
    # An id says nothing about its text where ids are null or repeat: verdicts are found again by id and text.
    kept = verdicts(docs, **options).filter("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).agg(
        F.count(F.lit(1)).alias("_kept_rows")
    )
    own = docs.withColumn("_own_text", F.sha2(norm(text_or_empty(text_col)).cast("binary"), 256))
    rows = own.join(kept, own[id_col].eqNullSafe(kept["_kept_id"]) & (own["_own_text"] == kept["_kept_text"]), "inner")
    single = rows.filter("_kept_rows = 1").select(*docs.columns)
    # Rows that repeat an id and its text are rare: only they are told apart.
    repeated = rows.filter("_kept_rows > 1").dropDuplicates(["_kept_id", "_own_text"])
    return single.unionByName(repeated.select(*docs.columns))
