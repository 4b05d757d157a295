"""Writing results: the gated catalogue, generated row tables, the quality report, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomscope.catalog import TABLES, Catalog
from bomscope.operators.gates import POST_CORRECTION, PRE_CORRECTION, apply_corrections, run_gates
from bomscope.session import shuffles_removed
from bomscope.sources import versions
from bomscope.sources.bundles import load_lookup_defaults


class GateFailure(RuntimeError):
    def __init__(self, failures):
        super().__init__("\n".join(map(str, failures)))
        self.failures = failures


def publish_catalog(cat: Catalog, path: str, tables=None, gates: Mapping = POST_CORRECTION) -> Catalog:
    """Corrections, gates, then one switch of a pointer: nothing is visible at `path` until every gate passes.

    Tables are written to a version folder of their own and the gates read the written files, so what is
    checked is what is published.  Whatever fails, at whatever point, `path` shows the version it showed before;
    a catalogue opened earlier keeps reading its own version.
    """
    failures = run_gates(cat, PRE_CORRECTION)
    if failures:
        raise GateFailure(failures)
    corrected = apply_corrections(cat["machine_chip"], cat["machine_chip_correction"])
    fixed = cat.with_tables(machine_chip=corrected)
    names, version = list(tables or TABLES), versions.new_version()
    folder = f"{path.rstrip('/')}/{version}"
    for name in names:
        load_lookup_defaults(fixed[name], name).write.parquet(f"{folder}/{name}")
    failures = run_gates(Catalog.from_parquet(cat.spark, folder), gates)
    if failures:
        fs, staged = versions.hadoop(cat.spark, folder)
        fs.delete(staged, True)
        raise GateFailure(failures)
    versions.switch(cat.spark, path, version, names)
    return Catalog.from_parquet(cat.spark, path)


def write_row_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """One JSON-lines folder per generated table, rows in key order inside each range-sorted part;
    an empty table leaves no output and removes a stale one."""
    for name, df in tables.items():
        spark = df.sparkSession
        target = f"{path}/{name}"
        if df.isEmpty():
            fs, p = versions.hadoop(spark, target)
            if fs.exists(p):
                fs.delete(p, True)
            continue
        key = list(TABLES[name].key)
        df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").json(target)


def write_quality_report(report: DataFrame, path: str) -> None:
    """The one-row report as a single text file."""
    report.coalesce(1).write.mode("overwrite").text(path)


def write_reconciliation(records: DataFrame, findings: DataFrame, path: str) -> None:
    """Nested witness records and flat findings as gzipped JSON lines."""
    with shuffles_removed(records.sparkSession):
        records.write.mode("overwrite").option("compression", "gzip").json(f"{path}/records")
        findings.write.mode("overwrite").option("compression", "gzip").json(f"{path}/findings")
