"""Multi-source reconciliation: witness rows, collapsing, findings and summary.

A witness row is (system_id, witness, key, designation, chip_id, mame_state, source_url,
evidence, machine_count).  Documents are inputs; nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bomscope.functions.columns import round4
from bomscope.functions.parts import Recognition, normalize_without_vendor, resolve_part, scan_parts
from bomscope.functions.source_text import attribute_blocks

# Witness order; the first is the primary listing.
WITNESSES = ("mame-listxml", "mame-source", "wikidata", "wikipedia", "jtcores")
PRIMARY = WITNESSES[0]
RECORD = 2000  # parts of a family in one record at most
FIELDS = ("system_id", "witness", "key", "designation", "chip_id", "mame_state", "source_url", "evidence", "machine_count")


def machine_systems_for_recon(cat, null_override_falls_through: bool = False) -> DataFrame:
    """Machine to family. By default the view's rule (an explicit "no system" stands); the flag
    gives the form in which such a row falls through to the driver's default."""
    if not null_override_falls_through:
        return cat["v_machine_system"].filter("system_id IS NOT NULL")
    override = cat["machine_system"].select("machine_id", F.col("system_id").alias("set_id"))
    driver = cat["system_driver"].select("mame_sourcefile", F.col("system_id").alias("default_id"))
    return (cat["machine"].select("machine_id", "mame_sourcefile").join(override, "machine_id", "left").join(driver, "mame_sourcefile", "left")
            .select("machine_id", F.coalesce("set_id", "default_id").alias("system_id")).filter("system_id IS NOT NULL"))


def listing_witness(cat, rec: Recognition, source_url: str, owner: DataFrame | None = None) -> DataFrame:
    """What the listing says per family: mapped chips and normalised unmapped devices, with machine
    counts; the evidence is the first machine's row."""
    owner = machine_systems_for_recon(cat) if owner is None else owner
    chips = cat["machine_chip"].select(
        "machine_id", F.concat(F.lit("chip:"), "chip_id").alias("key"), F.col("chip_id").alias("designation"), "chip_id",
        F.lit("mapped").alias("mame_state"), F.col("mame_tag").alias("at"),
        F.concat(F.lit("machine_chip "), "machine_id", F.lit(":"), "mame_tag", F.lit(" -> "), "chip_id").alias("evidence"))
    devices = cat["machine_unmapped_device"].select(
        "machine_id", F.concat(F.lit("part:"), normalize_without_vendor(F.col("mame_device"), rec)).alias("key"),
        F.col("mame_device").alias("designation"), F.lit(None).cast("string").alias("chip_id"), F.lit("unmapped").alias("mame_state"),
        F.col("mame_device").alias("at"),
        F.concat(F.lit("machine_unmapped_device "), "machine_id", F.lit(" -> "), "mame_device").alias("evidence"))
    rows = chips.unionByName(devices).join(owner, "machine_id")
    first = F.min_by(F.struct("designation", "chip_id", "mame_state", "evidence"), F.struct("machine_id", "at"))
    return (rows.groupBy("system_id", "key").agg(F.count_distinct("machine_id").alias("machine_count"), first.alias("f"))
            .select("system_id", F.lit(PRIMARY).alias("witness"), "key", "f.designation", "f.chip_id", "f.mame_state",
                    F.lit(source_url).alias("source_url"), "f.evidence", "machine_count"))


def reference_witness(hits: DataFrame, witness: str, index: DataFrame, rec: Recognition) -> DataFrame:
    """Resolve a reference's (system_id, designation, source_url, evidence) rows to witness rows."""
    return resolve_part(hits.select("system_id", "designation", "source_url", "evidence"), index, rec).select(
        "system_id", F.lit(witness).alias("witness"), "key", "designation", "chip_id", F.lit(None).cast("string").alias("mame_state"),
        "source_url", "evidence", F.lit(None).cast("long").alias("machine_count"))


def source_witness(cat, blocks: DataFrame, names: DataFrame, index: DataFrame, rec: Recognition, source_url: str, key: str = "mame_sourcefile") -> DataFrame:
    """What driver source says per family: parts named in its comment blocks.

    `blocks` are (doc_id, block, line, text, machine_id, <key>), see `source_text.attach_markers`. A block is scanned
    once, however many families it speaks for; families join its hits only. The citation is the line in the file.
    """
    blocks = blocks.withColumn("_id", F.concat_ws("#", "doc_id", "block"))
    hits = resolve_part(scan_parts(blocks.select("_id", "text"), names, rec, "_id").withColumnRenamed("line", "_at"), index, rec)
    spoken = attribute_blocks(cat, blocks.select("_id", "line", "machine_id", key), key)
    place = F.concat(F.lit(source_url + "/"), key, F.lit("#L"), (F.col("line") + F.col("_at") - 1).cast("string"))
    said = F.concat(F.col(key), F.coalesce(F.concat(F.lit(" ("), "machine_id", F.lit(")")), F.lit("")), F.lit(": "), "evidence")
    return hits.join(spoken, "_id").select(
        "system_id", F.lit("mame-source").alias("witness"), "key", "designation", "chip_id", F.lit(None).cast("string").alias("mame_state"),
        place.alias("source_url"), said.alias("evidence"), F.lit(None).cast("long").alias("machine_count"))


def collapse_parts(parts: DataFrame) -> DataFrame:
    """One row per (family, witness, key): the bytewise first citation."""
    rest = [c for c in FIELDS if c not in ("system_id", "witness", "key", "source_url", "designation", "evidence")]
    return (parts.groupBy("system_id", "witness", "key").agg(F.min(F.struct("source_url", "designation", "evidence", *rest)).alias("b"))
            .select("system_id", "witness", "key", "b.*").select(*FIELDS))


def _order(column):
    return F.array_position(F.array(*[F.lit(w) for w in WITNESSES]), column)


def merge_witnesses(collapsed: DataFrame, size: int = RECORD) -> DataFrame:
    """Nested record per family: witnesses in fixed order, parts in key order.

    A family of more than `size` parts goes on in further records, so none grows with the family; a record that goes on says
    each witness's `position` in the family, and `after` how many parts of it come before. Both are null in the first.
    """
    part = F.struct("key", *[c for c in FIELDS if c not in ("system_id", "witness", "key")])
    rows = collapsed.select("system_id", "witness", _order(F.col("witness")).alias("o"), part.alias("part"))
    # One shuffle and one sort that spills; the windows only count.
    family, witness = W.partitionBy("system_id"), W.partitionBy("system_id", "o", "witness")
    placed = rows.select(
        "system_id", "witness", "part", F.dense_rank().over(family.orderBy("o", "witness")).alias("position"),
        (F.row_number().over(witness.orderBy("part")) - 1).alias("after"),
        F.floor((F.row_number().over(family.orderBy("o", "witness", "part")) - 1) / size).alias("record"))
    per = placed.groupBy("system_id", "record", "position", "witness").agg(F.min("after").alias("after"), F.array_sort(F.collect_list("part")).alias("parts"))
    on = F.col("record") > 0
    record = F.struct("position", "witness", F.when(on, F.col("after")).alias("after"), "parts")
    return per.groupBy("system_id", "record").agg(F.array_sort(F.collect_list(record)).alias("w")).select("system_id", F.transform("w", lambda x: F.struct(
        x["witness"].alias("witness"), F.when(on, x["position"]).alias("position"), x["after"].alias("after"), x["parts"].alias("parts"))).alias("witnesses"))


def classify_findings(collapsed: DataFrame, machine_counts: DataFrame) -> DataFrame:
    """agreed / mame-only / reference-only per (family, key), with the best citation."""
    # References before the primary; among references the fixed order.
    order = F.when(F.col("witness") == PRIMARY, len(WITNESSES) + 1).otherwise(_order(F.col("witness")))
    is_primary = F.col("witness") == PRIMARY
    cite = F.struct("designation", "source_url", "evidence")
    df = collapsed.groupBy("system_id", "key").agg(
        F.max(is_primary.cast("int")).alias("has_primary"), F.max((~is_primary).cast("int")).alias("has_reference"),
        F.min_by(cite, order).alias("c"),
        F.expr(f"min_by(chip_id, array_position(array({','.join(repr(w) for w in WITNESSES)}), witness)) FILTER (WHERE chip_id IS NOT NULL)").alias("chip_id"),
        F.max(F.when(is_primary, F.col("mame_state"))).alias("mame_state"),
        F.max(F.when(is_primary, F.col("machine_count"))).alias("machine_count"),
        F.array_sort(F.collect_set(F.struct(_order(F.col("witness")).alias("o"), "witness"))).alias("w"))
    kind = F.when((F.col("has_primary") == 1) & (F.col("has_reference") == 1), "agreed").when(F.col("has_primary") == 1, "mame-only").otherwise("reference-only")
    share = F.when(F.col("machine_count").isNotNull() & (F.col("machines") > 0), round4(F.col("machine_count") / F.col("machines")))
    return df.join(machine_counts.select("system_id", F.col("machines")), "system_id", "left").select(
        "system_id", kind.alias("classification"), "key", "c.designation", "chip_id", F.coalesce("mame_state", F.lit("absent")).alias("mame_state"),
        F.array_join(F.transform("w", lambda x: x["witness"]), ",").alias("witnesses"), "c.source_url", "c.evidence", "machine_count", share.alias("machine_share"))


def ordered_findings(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("classification") == "reference-only", 0).when(F.col("classification") == "mame-only", 1).otherwise(2)
    return findings.orderBy(rank, "system_id", "key")


def machines_per_system(owner: DataFrame) -> DataFrame:
    return owner.groupBy("system_id").agg(F.count("*").alias("machines"))


def reconcile_summary(collapsed: DataFrame, findings: DataFrame) -> DataFrame:
    """(section, name, value): totals, per-classification counts, families and parts per witness."""
    def row(df, name, col):
        return df.select(F.lit("summary").alias("section"), F.lit(name).alias("name"), col.cast("long").alias("value"))

    systems = collapsed.agg(F.count_distinct("system_id").alias("n"), F.count_distinct(
        F.when(F.col("witness") != PRIMARY, F.col("system_id"))).alias("r"))
    kinds = findings.agg(*[F.count_if(F.col("classification") == k).alias(n) for n, k in
                           (("agreed", "agreed"), ("mame_only", "mame-only"), ("reference_only", "reference-only"))],
                         F.count_if((F.col("classification") == "agreed") & (F.col("mame_state") == "unmapped")).alias("agreed_unmapped_in_mame"))
    out = row(systems, "systems_total", F.col("n")).unionByName(row(systems, "systems_with_reference_witness", F.col("r")))
    for name in ("agreed", "mame_only", "reference_only", "agreed_unmapped_in_mame"):
        out = out.unionByName(row(kinds, name, F.col(name)))
    per = collapsed.groupBy("witness").agg(F.count_distinct("system_id").alias("s"), F.count("*").alias("p"))
    tall = per.select(F.explode(F.array(F.struct(F.lit("witness_systems").alias("section"), F.col("witness").alias("name"), F.col("s").alias("value")),
                                        F.struct(F.lit("witness_parts").alias("section"), F.col("witness").alias("name"), F.col("p").alias("value")))).alias("x"))
    return out.unionByName(tall.select("x.*"))
