"""Published folders: immutable versions and one small pointer file that names the current one.

    <path>/_current     {"version": "v-…", "previous": "v-…" or null, "tables": […]}
    <path>/v-…/<table>  Parquet

Whoever opens `<path>` reads the pointer once and then only files of that version, which nobody changes.
Publishing replaces the pointer by one overwriting rename: readers see the old version or the new one, never
neither.  Folders that no pointer names (a publish that failed or is under way) are not looked at.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

POINTER = "_current"
PREFIX = "v-"


def hadoop(spark: SparkSession, path: str):
    """(file system, path object)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_version() -> str:
    return PREFIX + uuid.uuid4().hex


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What `path` points to; None where it is a plain folder of tables."""
    fs, p = hadoop(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current_folder(spark: SparkSession, path: str) -> str:
    """The folder that holds the tables of `path` now."""
    pointer = read_pointer(spark, path)
    return path.rstrip("/") if pointer is None else f"{path.rstrip('/')}/{pointer['version']}"


def switch(spark: SparkSession, path: str, version: str, tables: list[str]) -> None:
    """Makes `version` the current one: the pointer is written aside, then renamed over the old one."""
    root = path.rstrip("/")
    before = read_pointer(spark, root)
    pointer = {"version": version, "previous": before and before["version"], "tables": tables}
    fs, aside = hadoop(spark, f"{root}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(pointer).encode()))
    finally:
        out.close()
    rename_over(spark, aside, f"{root}/{POINTER}")


def rename_over(spark: SparkSession, source, target: str) -> None:
    hfs = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hfs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = hfs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(source, hfs.Path(target), options)


def expire_versions(spark: SparkSession, path: str) -> list[str]:
    """Deletes the version folders that are neither current nor previous, and says which.

    Not to be run while another publish to `path` is under way: its unfinished folder is such a one.
    """
    pointer = read_pointer(spark, path)
    if pointer is None:
        return []
    fs, root = hadoop(spark, path)
    named = {pointer["version"], pointer["previous"]}
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(PREFIX) and name not in named:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
