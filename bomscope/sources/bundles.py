"""Row bundles: JSON objects {table: [flat rows]}; and the other catalogue inputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomscope.catalog import TABLES
from bomscope.session import written

REQUIRED_THRESHOLDS = ("issue_generator.min_instance_count", "issue_generator.min_machine_count", "mapped_instance_share.warn_below",
                       "stale_review_days", "system_unmapped_share.warn_above")

EXAMPLES = 5  # rejected documents named in an error


def _bundle_text(spark: SparkSession, paths, lines: bool) -> DataFrame:
    """(_file, text): whole `*.json` files (not `*.raw.json`), or one bundle per line."""
    df = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*")
          .text(paths, wholetext=not lines).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("text")))
    return df.filter(~F.col("_file").rlike(r"\.raw\.json$"))


class RejectedInput(ValueError):
    """Input that holds what it may not; `count` of all such documents, `examples` of a few."""

    def __init__(self, paths, count: int, examples):
        shown = "".join(f"\n  {e}" for e in examples)
        super().__init__(f"{paths}: {count} rejected{shown}")
        self.count, self.examples = count, list(examples)


def bundle_problems(text: Column) -> Column:
    """array<struct<table, pos, column, problem>>: what one bundle may not contain, empty for a good one.

    An expression over the bundle itself, so rows are read and judged in one scan. Cells are texts and numbers
    that their column can hold; an unknown column leaves out instead of null.
    """
    columns = [(f"{t}.{c.name}", c.type) for t, spec in TABLES.items() for c in spec.columns]

    def names(*types):
        return F.array(*[F.lit(n) for n, kind in columns if not types or isinstance(kind, types)])

    every, whole, real = names(), names(T.LongType, T.IntegerType), names(T.DoubleType)
    tables = F.array(*map(F.lit, TABLES))
    nowhere = F.lit(None).cast("int")

    def found(table, pos, column, problem):
        return F.struct(table.alias("table"), pos.alias("pos"), column.alias("column"), problem.alias("problem"))

    def cell(table, pos):
        def judge(e):
            name, kind = F.concat(table, F.lit("."), e["key"]), F.schema_of_variant(e["value"])
            return found(table, pos, e["key"], (
                F.when(~F.array_contains(every, name), "unknown column").when(kind == "VOID", "null cell")
                .when(kind.rlike("^(ARRAY|OBJECT)<"), "nested cell").when(kind == "BOOLEAN", "neither text nor number")
                .when(F.array_contains(whole, name) & (kind != "BIGINT"), "not a whole number")
                .when(F.array_contains(real, name) & (kind == "STRING"), "not a number")))
        return judge

    def row(table):
        def judge(r, i):
            cells = F.map_entries(F.try_variant_get(r, "$", "map<string,variant>"))
            return F.coalesce(F.transform(cells, cell(table, i)), F.array(found(table, i, F.lit(""), F.lit("row is not an object"))))
        return judge

    def whole_table(t):
        rows = F.try_variant_get(t["value"], "$", "array<variant>")
        return (F.when(~F.array_contains(tables, t["key"]), F.array(found(t["key"], nowhere, F.lit(""), F.lit("unknown table"))))
                .when(rows.isNull(), F.array(found(t["key"], nowhere, F.lit(""), F.lit("not an array"))))
                .otherwise(F.flatten(F.transform(rows, row(t["key"])))))

    listed = F.map_entries(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"))
    all_found = F.coalesce(F.flatten(F.transform(listed, whole_table)), F.array(found(F.lit(""), nowhere, F.lit(""), F.lit("not an object"))))
    return F.filter(all_found, lambda p: p["problem"].isNotNull())


def read_row_bundles(spark: SparkSession, paths, tables=None, lines: bool = False) -> dict[str, DataFrame]:
    """Rows per table with `_file` and `_pos`. An absent key is NULL; defaults are applied afterwards.

    The schema is stated for every table, so nothing is inferred. `lines` reads bundles
    written one per line, which split across tasks; otherwise each file is one bundle (a file of no bytes is none).
    The text is read once: parsed rows are staged, bad bundles counted on the way, and `RejectedInput` is raised
    after the write if there was any, in whatever table. Each table's rows then come from its own staged column.
    """
    names = list(tables or TABLES)
    schema = T.StructType([T.StructField(n, T.ArrayType(TABLES[n].schema)) for n in names])
    seen = Observation()
    parsed = (_bundle_text(spark, paths, lines)
              .select("_file", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("b"), bundle_problems(F.col("text")).alias("_problems"))
              .select("_file", "b.*", "_problems").observe(seen, F.count_if(F.size("_problems") > 0).alias("rejected")))
    staged = written(parsed)
    if seen.get["rejected"]:
        few = staged.filter(F.size("_problems") > 0).select("_file", F.get("_problems", F.lit(0)).alias("p")).select("_file", "p.*").limit(EXAMPLES)
        raise RejectedInput(paths, seen.get["rejected"], [tuple(r) for r in few.collect()])
    return {n: staged.select("_file", F.posexplode(n).alias("_pos", "r")).select("_file", "_pos", "r.*") for n in names}


def rejected_cells(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """What a bundle may not contain: (_file, table, pos, column, problem), in one pass over the text."""
    return (_bundle_text(spark, paths, lines).select("_file", F.explode(bundle_problems(F.col("text"))).alias("p"))
            .select("_file", "p.*"))


def load_lookup_defaults(df: DataFrame, table: str) -> DataFrame:
    """Column defaults where the key was absent."""
    for c in TABLES[table].columns:
        if c.default is not None and c.name in df.columns:
            df = df.withColumn(c.name, F.coalesce(F.col(c.name), F.lit(c.default).cast(c.type)))
    return df


def flatten_thresholds(config: Mapping, prefix: str = "") -> list[tuple[str, float]]:
    """Nested policy to dotted names; anything that is not a finite number is left out."""
    out = []
    for key, value in config.items():
        name = f"{prefix}.{key}" if prefix else key
        if isinstance(value, Mapping):
            out += flatten_thresholds(value, name)
        elif isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) != float("inf") and value == value:
            out.append((name, float(value)))
    return sorted(out)


def load_thresholds(spark: SparkSession, config: Mapping, required=REQUIRED_THRESHOLDS) -> DataFrame:
    rows = flatten_thresholds(config)
    missing = sorted(set(required) - {n for n, _ in rows})
    if missing:
        raise ValueError(f"thresholds missing: {', '.join(missing)}")
    return spark.createDataFrame(rows, TABLES["threshold"].schema)


def read_raw_extract(spark: SparkSession, path: str, element: str, schema: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of raw extracts {mame_version, <element>: [...]}; fails when any document lacks its version.

    A document is a file, or with `lines` a line. Rows carry their document's version.
    """
    doc = spark.read.schema(f"mame_version string, {element} array<{schema}>").option("multiLine", not lines).json(path)
    if doc.isEmpty() or not doc.filter("mame_version IS NULL").isEmpty():
        raise ValueError(f"{path}: mame_version is missing")
    return doc.select("mame_version"), doc.select("mame_version", F.explode(element).alias("r")).select("mame_version", "r.*")


def read_documents(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """(path, text): whole text files."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def wikipedia_articles(responses: DataFrame, body: str = "body") -> DataFrame:
    """(title, revision_id, text) from page-query responses; incomplete pages are skipped."""
    schema = ("struct<query:struct<pages:array<struct<title:string,revisions:array<struct<revid:bigint,"
              "slots:struct<main:struct<content:string>>>>>>>>")
    page = responses.select(F.explode(F.from_json(body, schema)["query"]["pages"]).alias("p"))
    rev = F.get("p.revisions", F.lit(0))
    return page.select(F.col("p.title").alias("title"), rev["revid"].alias("revision_id"), rev["slots"]["main"]["content"].alias("text")).filter(
        "title IS NOT NULL AND revision_id IS NOT NULL AND text IS NOT NULL")


def title_aliases(responses: DataFrame, body: str = "body") -> DataFrame:
    """(from, to) title normalisations and redirects of the same responses."""
    pair = "array<struct<`from`:string,`to`:string>>"
    q = responses.select(F.from_json(body, f"struct<query:struct<normalized:{pair},redirects:{pair}>>")["query"].alias("q"))
    empty = F.from_json(F.lit("[]"), pair)
    return q.select(F.explode(F.concat(F.coalesce("q.normalized", empty), F.coalesce("q.redirects", empty))).alias("a")).select("a.*").filter("`from` IS NOT NULL AND `to` IS NOT NULL")
