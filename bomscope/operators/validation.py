"""Row lints over bundle rows; every finding has the same shape.

A finding is (severity, file, table, key, column, rule, message, fix).  Bundle rows carry
`_file` and `_pos` (position inside their table's array); see `sources.bundles`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomscope.catalog import TABLES

# Plausibility bands, and the tables kept one entity per file.
CLOCK_MIN_HZ, CLOCK_MAX_HZ = 1_000, 1_000_000_000
YEAR_MIN, YEAR_MAX = 1970, 2005
ENTITY_KEYS = {"chip": "chip_id", "implementation": "implementation_id", "project": "project_id", "system": "system_id"}
SHAPE = ("severity", "file", "table", "key", "column", "rule", "message", "fix")

# Where each warning code points and what to do.
WARNING_TARGETS = {
    "CHIP_MANUFACTURER_FAMILY_MISMATCH": ("chip", "manufacturer_id", "confirm second sourcing or correct the manufacturer or family"),
    "CHIP_NAME_COLLISION": ("chip", "display_name", "rename one of the two or drop the alias"),
    "SYSTEM_NAME_COLLISION": ("system", "name", "rename one of the two or drop the alias"),
    "MAPPED_INSTANCE_SHARE_LOW": ("", "", "map more devices"),
    "UNMAPPED_DEVICE_HIGH_IMPACT": ("mame_device", "chip_id", "map the device to a chip or give an ignore reason"),
    "CHIP_MISSING_METADATA": ("chip", "manufacturer_id, description", "set manufacturer and description"),
    "IMPL_UNVERIFIED_LICENSE": ("implementation", "license_id", "set the licence"),
    "IMPL_UNVERIFIED_ACCURACY": ("implementation", "accuracy_id", "assess and set the accuracy level"),
    "IMPL_STALE_REVIEW": ("implementation", "last_reviewed", "review again"),
    "IMPL_UNTARGETED": ("implementation", "", "add a chip or a system target"),
    "IMPL_MACHINES_WITHOUT_SYSTEM": ("implementation", "", "add the system or drop the machines"),
    "SYSTEM_NO_CHIPS": ("system", "", "add chips or a driver"),
    "SYSTEM_UNMAPPED_SHARE_HIGH": ("system", "", "map the system's devices"),
    "MACHINE_ZERO_MAPPED_CHIPS": ("machine", "", "map the machine's devices"),
    "EQUIVALENCE_MUTUAL_PROVIDES": ("chip_equivalence", "kind", "use one equivalent edge"),
}


def _key(table: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in TABLES[table].key])


def _finding(df, severity, table, key, column, rule, message, fix) -> DataFrame:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(F.lit(severity).alias("severity"), F.col("_file").alias("file"), F.lit(table).alias("table"), as_col(key).alias("key"),
                     as_col(column).alias("column"), F.lit(rule).alias("rule"), as_col(message).alias("message"), as_col(fix).alias("fix"))


def _union(parts: list[DataFrame], spark) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in SHAPE))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stem(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"\.json$", "")


def filename_key(tables: Mapping[str, DataFrame]) -> DataFrame:
    """An entity file holds one entity row named like the file, and every row carries that key."""
    parts, spark = [], next(iter(tables.values())).sparkSession
    for entity, key in ENTITY_KEYS.items():
        if entity not in tables:
            continue
        rows = tables[entity].withColumn("_stem", stem(F.col("_file")))
        per = rows.groupBy("_file", "_stem").agg(F.count("*").alias("n"), F.min(key).alias("declared"))
        many = per.filter("n <> 1")
        parts.append(_finding(many, "ERROR", entity, F.col("_stem"), key, "filename-key",
                              F.concat(F.lit(f"a per-entity file holds exactly one '{entity}' row, this one holds "), F.col("n").cast("string")),
                              "one file per row"))
        wrong = per.filter((F.col("n") == 1) & ~F.col("declared").eqNullSafe(F.col("_stem")))
        parts.append(_finding(wrong, "ERROR", entity, F.coalesce("declared", F.lit("")), key, "filename-key",
                              F.concat(F.lit(f"{key} is '"), F.coalesce("declared", F.lit("")), F.lit("' but the filename stem is '"), "_stem", F.lit("'")), "rename"))
        good = per.filter((F.col("n") == 1) & (F.col("declared") == F.col("_stem"))).select("_file", "_stem")
        for name, df in tables.items():
            if name == entity or key not in TABLES[name].names:
                continue
            stray = df.join(good, "_file").filter(F.col(key).isNotNull() & (F.col(key) != F.col("_stem")))
            parts.append(_finding(stray, "ERROR", name, _key(name), key, "filename-key",
                                  F.concat(F.lit(f"{key} is '"), key, F.lit("' but this file belongs to '"), "_stem", F.lit("'")), "move the row"))
    return _union(parts, spark)


def row_order(tables: Mapping[str, DataFrame]) -> DataFrame:
    """First row of each (file, table) that sorts before the row above it. Neighbours meet by an
    equality join on position, so one long file is spread over all tasks."""
    parts, spark = [], next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        key = F.struct(*TABLES[name].key)
        here = df.select("_file", "_pos", key.alias("k"), _key(name).alias("kt"))
        above = here.select("_file", (F.col("_pos") + 1).alias("_pos"), F.col("k").alias("pk"), F.col("kt").alias("pt"))
        first = here.join(above, ["_file", "_pos"]).filter(F.col("k") < F.col("pk")).groupBy("_file").agg(
            F.min(F.struct("_pos", "kt", "pt")).alias("b")).select("_file", F.col("b.kt").alias("kt"), F.col("b.pt").alias("pt"))
        parts.append(_finding(first, "ERROR", name, F.col("kt"), ", ".join(TABLES[name].key), "row-order",
                              F.concat(F.lit("sorts before '"), "pt", F.lit("' but is written after it")), "sort by key"))
    return _union(parts, spark)


def _band(tables, columns_of, low, high, rule, unit) -> DataFrame:
    parts, spark = [], next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        for c in columns_of(name):
            out = df.filter(F.col(c).isNotNull() & ~F.col(c).between(low, high))
            parts.append(_finding(out, "WARN", name, _key(name), c, rule,
                                  F.concat(F.lit(f"{c} is "), F.col(c).cast("string"), F.lit(f"{unit}, outside {low}..{high}")), "confirm or correct"))
    return _union(parts, spark)


def clock_range(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _band(tables, lambda t: [c for c in TABLES[t].names if c.endswith("clock_hz")], CLOCK_MIN_HZ, CLOCK_MAX_HZ, "clock-range", " Hz")


def year_range(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _band(tables, lambda t: [c for c in TABLES[t].names if c == "year_introduced"], YEAR_MIN, YEAR_MAX, "year-range", "")


def warning_diagnostic(warnings: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """Quality warnings as findings. `located` maps (table, key) to a file."""
    spark = warnings.sparkSession
    target = spark.createDataFrame([(c, *t) for c, t in WARNING_TARGETS.items()], "code string, table string, column string, fix string")
    df = warnings.join(target, "code", "left").withColumn("key", F.coalesce("subject", F.lit(""))).withColumn("table", F.coalesce("table", F.lit("")))
    df = df.withColumn("_file", F.lit(None).cast("string")) if located is None else df.join(
        located.select("table", "key", F.col("file").alias("_file")), ["table", "key"], "left")
    impact = F.when(F.col("impact").isNull(), "").otherwise(F.concat(F.lit(" (impact "), _number(F.col("impact")), F.lit(")")))
    return df.select(F.lit("WARN").alias("severity"), F.coalesce("_file", F.lit("(database)")).alias("file"), "table", "key",
                     F.coalesce("column", F.lit("")).alias("column"), F.lower(F.replace("code", F.lit("_"), F.lit("-"))).alias("rule"),
                     F.concat("detail", impact).alias("message"), F.coalesce("fix", F.lit("see the code's description")).alias("fix"))


def _number(col: Column) -> Column:
    whole = col.cast("long")
    return F.when(whole == col, whole.cast("string")).otherwise(col.cast("string"))


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.when(F.col("severity") == "ERROR", 0).otherwise(1), "file", "table", "key", "rule", "column", "message")


def severity_counts(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row: errors, warnings, and whether the run fails (any error; a warning only when strict)."""
    n = findings.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") != "ERROR").alias("warnings"))
    return n.withColumn("failed", ((F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))).cast("int"))
