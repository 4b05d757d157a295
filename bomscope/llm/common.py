"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomscope.session import shared_dir, shuffles_removed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for one use, under the folder that driver and executors share."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: what follows starts from the files."""
    path = workspace(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch; long texts make it short of rows.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches that go to Python are bounded by bytes: ten thousand whole texts at once are too much."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only.  `lower` equals that where every character is one byte, and is much faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def with_next(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key) for each distinct non-null key in ascending order; the last is followed by the first.

    Only keys move: a range sort, a window inside each range, and one row per range for its neighbour.
    """
    parts = staged(
        ids.select(key).dropna().distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("_part")),
        "order",
    )
    heads = parts.groupBy("_part").agg(F.min(key).alias("_head"))
    # As many rows as there are ranges.
    every = Window.orderBy("_part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_part", F.coalesce(F.lead("_head").over(every), F.first("_head").over(whole)).alias("_after"))
    inside = parts.select("_part", key, F.lead(key).over(Window.partitionBy("_part").orderBy(key)).alias("_lead"))
    return inside.join(heads, "_part").select(key, F.coalesce("_lead", "_after").alias(f"next_{key}"))


#: A key is hot if it meets at least one of so many rows; there are never more hot keys than this.
HOT_SHARE = 1000


def attached(rows: DataFrame, facts: DataFrame, key: str, met: str) -> DataFrame:
    """Inner join on `key`, where nulls meet nulls, that no hot key piles into one task.

    `facts` has one row for each key; its column `met` says how many rows the key meets.  Hot keys, HOT_SHARE at
    most whatever the size of the data, are broadcast; all others are dealt by key.
    """
    facts = facts.withColumnRenamed(key, "_key")
    total = facts.agg(F.sum(met)).first()[0] or 0
    hot = facts.filter(F.col(met) * HOT_SHARE >= total)
    own = rows[key].eqNullSafe(F.col("_key"))
    by_hot = rows.join(F.broadcast(hot), own)
    rest = rows.join(F.broadcast(hot.select("_key")), own, "left_anti")
    return by_hot.unionByName(rest.join(facts.filter(F.col(met) * HOT_SHARE < total), own)).drop("_key", met)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of `workspace` whose rows have been written on elsewhere."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
