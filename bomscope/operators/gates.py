"""Corrections of extracted sockets, integrity gates and data lints."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomscope.catalog import TABLES
from bomscope.operators.closure import cycle_nodes

SOCKET = ["machine_id", "mame_tag", "chip_id"]
# Keys every dataset must state.
REQUIRED_META = ("build_date", "dataset_version", "mame_version", "schema_version")


# -- COR1 ---------------------------------------------------------------------------

def apply_corrections(machine_chip: DataFrame, corrections: DataFrame) -> DataFrame:
    """Remove, then add, then set. One join: removals and settings are looked up together."""
    ops = corrections.filter("op <> 'add'").select(*SOCKET, "op", F.col("clock_hz").alias("fix_clock"), F.col("quantity").alias("fix_quantity"))
    kept = (machine_chip.join(ops, SOCKET, "left").filter("op IS NULL OR op <> 'remove'")
            .select(*SOCKET, F.coalesce("fix_clock", "clock_hz").alias("clock_hz"), F.coalesce("fix_quantity", "quantity").alias("quantity")))
    added = corrections.filter("op = 'add'").select(*SOCKET, "clock_hz", F.coalesce("quantity", F.lit(1).cast("long")).alias("quantity"))
    return kept.unionByName(added)


def correction_counts(machine_chip: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows each operation touches: (op, rows)."""
    hit = machine_chip.select(*SOCKET).join(corrections.filter("op <> 'add'").select(*SOCKET, "op"), SOCKET)
    return (hit.select("op").unionByName(corrections.filter("op = 'add'").select("op"))
            .groupBy("op").agg(F.count("*").alias("rows")))


# -- GAT1 - GAT5, GAT8 - GAT10 ------------------------------------------------------

def stale_correction(cat) -> DataFrame:
    """remove/set without a target, add with one. Runs against sockets before corrections."""
    present = cat["machine_chip"].select(*SOCKET).withColumn("_there", F.lit(True))
    df = cat["machine_chip_correction"].join(present, SOCKET, "left")
    there = F.col("_there").isNotNull()
    return df.filter(F.when(F.col("op") == "add", there).otherwise(~there)).select(*SOCKET, "op", "reason")


def retired_id_collision(cat) -> DataFrame:
    def side(entity, names, owners, key):
        live = owners.select(F.col(key).alias("name"))
        return names.join(live, "name", "left_semi").select(F.lit(entity).alias("entity"), "name", F.col(key).alias("claimed_by"))

    return side("chip", cat["chip_name"], cat["chip"], "chip_id").unionByName(
        side("system", cat["system_name"], cat["system"], "system_id"))


def stale_extract(cat) -> DataFrame:
    return cat["machine_unmapped_device"].select("mame_device").distinct().join(cat["mame_device"], "mame_device", "left_semi")


def dependency_cycle(cat) -> DataFrame:
    return cycle_nodes(cat["implementation_dependency"], "consumer_id", "provider_id", "implementation_id")


def dataset_meta_incomplete(cat) -> DataFrame:
    need = cat.spark.createDataFrame([(k,) for k in REQUIRED_META], "key string")
    return need.join(cat["dataset_meta"], "key", "left_anti")


def provides_cycle(cat) -> DataFrame:
    return cycle_nodes(cat["chip_equivalence"].filter("kind = 'provides'"), "from_chip_id", "to_chip_id", "chip_id")


def _symmetric(cat) -> DataFrame:
    edge = cat["chip_equivalence"].filter("kind = 'equivalent'")
    there = F.struct(F.col("from_chip_id").alias("x"), F.col("to_chip_id").alias("y"))
    back = F.struct(F.col("to_chip_id").alias("x"), F.col("from_chip_id").alias("y"))
    return edge.select(F.explode(F.array(there, back)).alias("e")).select("e.x", "e.y").distinct()


def incomplete_equivalence_hubs(cat) -> DataFrame:
    """Chips whose equivalents are not all equivalent to each other: (chip_id, links, closed, missing).

    Counts triangles instead of listing pairs: `closed` ordered pairs of neighbours are
    linked, `links * (links - 1)` should be.  Use it to see how large the pair report is.
    """
    eq = _symmetric(cat)
    degree = eq.groupBy("x").agg(F.count("*").alias("links"))
    # Each edge is directed from its lower-degree end, so a hub sends none of its edges to the join.
    ends = (eq.join(degree.withColumnRenamed("links", "dx"), "x")
            .join(degree.select(F.col("x").alias("y"), F.col("links").alias("dy")), "y"))
    lower = ends.filter((F.col("dx") < F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") < F.col("y")))).select("x", "y")
    wedge = lower.join(lower.select("x", F.col("y").alias("z")), "x").filter("y < z")
    triangle = wedge.join(eq.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"], "left_semi")
    closed = triangle.select(F.explode(F.array("x", "y", "z")).alias("x")).groupBy("x").agg((F.count("*") * 2).alias("closed"))
    total = F.col("links") * (F.col("links") - 1)
    return (degree.join(closed, "x", "left").select(F.col("x").alias("chip_id"), "links", F.coalesce("closed", F.lit(0)).cast("long").alias("closed"))
            .withColumn("missing", total - F.col("closed")).filter("missing > 0"))


def incomplete_equivalence(cat) -> DataFrame:
    """a~b and b~c without a~c: the report is the missing pairs, one row per (a, c, hub b).

    Only hubs that miss something are expanded, so complete groups, however large, add nothing.
    """
    eq = _symmetric(cat)
    hubs = incomplete_equivalence_hubs(cat).select(F.col("chip_id").alias("y"))
    arms = eq.join(hubs, "y", "left_semi")
    pairs = arms.join(arms.select("y", F.col("x").alias("z")), "y").filter("x <> z")
    return pairs.join(eq.select("x", F.col("y").alias("z")), ["x", "z"], "left_anti").select(
        F.col("x").alias("chip_a"), F.col("z").alias("chip_c"))


def cross_function_edge(cat) -> DataFrame:
    kind = cat["chip"].select("chip_id", "function_id")
    return (cat["chip_equivalence"].select("from_chip_id", "to_chip_id", "kind")
            .join(kind.select(F.col("chip_id").alias("from_chip_id"), F.col("function_id").alias("from_function")), "from_chip_id")
            .join(kind.select(F.col("chip_id").alias("to_chip_id"), F.col("function_id").alias("to_function")), "to_chip_id")
            .filter("from_function <> to_function").select("from_chip_id", "to_chip_id", "kind", "from_function", "to_function"))


def short_note(cat, minimum: int = 40) -> DataFrame:
    return cat["chip_equivalence"].filter(F.length(F.trim("note")) < minimum).select("from_chip_id", "to_chip_id", "note")


# -- GAT6, GAT7 ---------------------------------------------------------------------

def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def foreign_key_check(cat, tables=None) -> DataFrame:
    """Dangling references: (table, column, value, rows).

    All children and all referenced keys go into one relation, tallied per (reference, value)
    map-side, so every key of the catalogue is checked with two shuffles; a value shared by a
    third of the rows reaches the shuffle once per task.
    """
    parts, parents = [], {}
    none = F.lit(None).cast("string")
    for name in tables or TABLES:
        for c in TABLES[name].columns:
            if c.ref:
                to = f"{c.ref}.{c.ref_col}"
                parents[to] = cat[c.ref].select(F.lit(to).alias("to"), F.col(c.ref_col).alias("value"), none.alias("table"), none.alias("column"))
                parts.append(cat[name].filter(F.col(c.name).isNotNull()).select(
                    F.lit(to).alias("to"), F.col(c.name).alias("value"), F.lit(name).alias("table"), F.lit(c.name).alias("column")))
    tally = _union([*parts, *parents.values()]).groupBy("to", "value", "table", "column").agg(F.count("*").alias("rows"))
    child = F.when(F.col("table").isNotNull(), F.struct("table", "column", "rows"))
    # At most one entry per referring column of the data model.
    per_value = tally.groupBy("to", "value").agg(F.max(F.col("table").isNull()).alias("present"), F.collect_list(child).alias("c"))
    return per_value.filter(~F.col("present")).select("value", F.explode("c").alias("x")).select("x.table", "x.column", "value", "x.rows")


def unique_check(cat, tables=None) -> DataFrame:
    """Groups that break a primary key or a (partial) unique rule: (table, rule, key, rows); one shuffle for all."""
    parts = []
    for name in tables or TABLES:
        spec = TABLES[name]
        for rule, exprs, where in (("primary key", spec.key, None), *spec.unique):
            rows = cat[name].filter(where) if where else cat[name]
            parts.append(rows.select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.array(*[F.expr(e).cast("string") for e in exprs]).alias("k")))
    return (_union(parts).groupBy("table", "rule", "k").agg(F.count("*").alias("rows")).filter("rows > 1")
            .select("table", "rule", F.array_join("k", "|").alias("key"), "rows"))


def check_constraint(cat, tables=None) -> DataFrame:
    """Rows that break a column rule or a row check: (table, key, rule), one row per broken rule."""
    parts = []
    for name in tables or TABLES:
        spec = TABLES[name]
        broken = [F.when(~c.holds(), F.lit(f"{c.name}: {c.kind}")) for c in spec.columns]
        broken += [F.when(~F.expr(sql), F.lit(rule)) for rule, sql in spec.checks]
        parts.append(cat[name].select(F.lit(name).alias("table"), F.concat_ws("|", *spec.key).alias("key"),
                                      F.explode(F.array_compact(F.array(*broken))).alias("rule")))
    return _union(parts)


# -- GAT11, GAT12 -------------------------------------------------------------------

@dataclass(frozen=True)
class Failure:
    code: str
    rows: int
    shown: list[str]

    def __str__(self):
        lines = [f"FAIL {self.code}: {self.rows} row(s)", *(f"  {r}" for r in self.shown)]
        return "\n".join(lines + ([f"  … {self.rows - len(self.shown)} more"] if self.rows > len(self.shown) else []))


PRE_CORRECTION = {"STALE_CORRECTION": stale_correction}
POST_CORRECTION = {
    "RETIRED_ID_COLLISION": retired_id_collision,
    "STALE_EXTRACT": stale_extract,
    "DEPENDENCY_CYCLE": dependency_cycle,
    "DATASET_META_INCOMPLETE": dataset_meta_incomplete,
    "FOREIGN_KEY": foreign_key_check,
    "UNIQUE": unique_check,
    "CHECK": check_constraint,
    "PROVIDES_CYCLE": provides_cycle,
}


def run_gates(cat, gates: Mapping = POST_CORRECTION, show: int = 20) -> list[Failure]:
    """Run every gate and collect all failures. Rows are counted where they are; only the
    first `show` come to the driver for the message."""
    failures = []
    for code, gate in gates.items():
        rows = gate(cat)
        # One job: per-partition limits, then at most show + 1 rows in one list.
        shown = rows.limit(show + 1).agg(F.collect_list(F.to_json(F.struct(*rows.columns)))).first()[0]
        if shown:
            total = len(shown) if len(shown) <= show else rows.count()
            failures.append(Failure(code, total, shown[:show]))
    return failures


def gate_counts(cat, gates: Mapping = POST_CORRECTION) -> DataFrame:
    """(code, rows) for every gate, zeros included."""
    return _union([gate(cat).agg(F.count("*").alias("rows")).select(F.lit(code).alias("code"), "rows")
                   for code, gate in gates.items()])


def rebuild_fingerprint(cat, tables=None) -> DataFrame:
    """Order-insensitive content hash per table: (table, rows, digest). Two builds of the same
    inputs must agree. Row hashes are summed as exact decimals, so nothing overflows."""
    names = list(tables or TABLES)
    hashed = _union([cat[n].select(F.lit(n).alias("table"), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in TABLES[n].names])
                                   .cast("decimal(38,0)").alias("h")) for n in names])
    listed = cat.spark.createDataFrame([(n,) for n in names], "table string")
    sums = hashed.groupBy("table").agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("digest"))
    return listed.join(sums, "table", "left").select("table", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce("digest", F.lit("0")).alias("digest"))
