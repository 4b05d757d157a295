"""The XML machine listing, read with Spark's own XML source (splittable by row tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bomscope.session import shuffles_removed, written
from bomscope.sources.bundles import EXAMPLES, RejectedInput

# Stated, not inferred: a lone <chip> must still be an array and a clock must stay text.
LISTING_SCHEMA = """
_name string, _sourcefile string, _isbios string, _isdevice string, _ismechanical string, _runnable string,
_cloneof string, _romof string, description string, year string, manufacturer string,
driver struct<_status: string>,
device_ref array<struct<_tag: string, _name: string>>,
chip array<struct<_type: string, _tag: string, _name: string, _clock: string>>
"""


def read_machine_listing(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per machine, attributes as raw text.

    A record that cannot be read, or has no name, refuses the listing: records are staged in one scan and counted on
    the way, and `RejectedInput` is raised after the write.  (Behind a record that cannot be read, the XML source
    reads nothing more of the file, so going on would lose machines silently.)
    """
    seen = Observation()
    records = (spark.read.format("xml").option("rowTag", "machine").option("columnNameOfCorruptRecord", "_unread")
               .schema(LISTING_SCHEMA + ", _unread string").load(path)
               .observe(seen, F.count_if(F.col("_unread").isNotNull() | F.col("_name").isNull()).alias("rejected")))
    raw = written(records)
    if seen.get["rejected"]:
        few = raw.filter("_unread IS NOT NULL OR _name IS NULL").select(
            F.when(F.col("_unread").isNotNull(), "unreadable").otherwise("no name").alias("problem"),
            F.substring(F.coalesce("_unread", "description"), 1, 80).alias("text")).limit(EXAMPLES)
        raise RejectedInput(path, seen.get["rejected"], [tuple(r) for r in few.collect()])
    refs = F.transform("device_ref", lambda r: F.struct(r["_tag"].alias("tag"), r["_name"].alias("name")))
    chips = F.transform("chip", lambda c: F.struct(c["_type"].alias("type"), c["_tag"].alias("tag"), c["_name"].alias("name"), c["_clock"].alias("clock")))
    return raw.select(
        F.col("_name").alias("machine_id"), F.coalesce("description", F.lit("")).alias("name"), F.coalesce("_sourcefile", F.lit("")).alias("mame_sourcefile"),
        F.col("year").alias("mame_year"), F.col("manufacturer").alias("mame_manufacturer"), F.col("driver._status").alias("driver_status_raw"),
        F.col("_isbios").alias("isbios"), F.col("_isdevice").alias("isdevice"), F.col("_ismechanical").alias("ismechanical"),
        F.col("_runnable").alias("runnable_raw"), F.col("_cloneof").alias("cloneof"), F.col("_romof").alias("romof"),
        F.coalesce(refs, F.array().cast("array<struct<tag:string,name:string>>")).alias("device_refs"),
        F.coalesce(chips, F.array().cast("array<struct<type:string,tag:string,name:string,clock:string>>")).alias("chips"))


def write_machine_listing(machines: DataFrame, path: str) -> None:
    """The inverse: nested rows to XML part files, gzipped: tags make the text a dozen times its content. A part is read by one task."""
    attr = machines.select(
        F.col("machine_id").alias("_name"), F.col("mame_sourcefile").alias("_sourcefile"), F.col("isbios").alias("_isbios"),
        F.col("isdevice").alias("_isdevice"), F.col("ismechanical").alias("_ismechanical"), F.col("runnable_raw").alias("_runnable"),
        F.col("cloneof").alias("_cloneof"), F.col("romof").alias("_romof"), F.col("name").alias("description"), F.col("mame_year").alias("year"),
        F.col("mame_manufacturer").alias("manufacturer"), F.struct(F.col("driver_status_raw").alias("_status")).alias("driver"),
        F.transform("device_refs", lambda r: F.struct(r["tag"].alias("_tag"), r["name"].alias("_name"))).alias("device_ref"),
        F.transform("chips", lambda c: F.struct(c["type"].alias("_type"), c["tag"].alias("_tag"), c["name"].alias("_name"), c["clock"].alias("_clock"))).alias("chip"))
    with shuffles_removed(machines.sparkSession):
        attr.write.mode("overwrite").format("xml").option("rootTag", "mame").option("rowTag", "machine").option("compression", "gzip").save(path)
