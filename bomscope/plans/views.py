"""The relational views (coverage, evidence, instances), composed lazily.

No view takes a parameter; the caller filters.  Joins carry no broadcast hints: the
planner and AQE broadcast a side only when its measured size is under the session's
threshold and shuffle it otherwise, with skewed partitions split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomscope.catalog import view
from bomscope.functions.columns import AXIS_GROUPS, share, with_axis

FPGA = "fpga_hdl"  # fixed value: the kind the ranking is about


@view("v_machine_system")
def machine_system(cat) -> DataFrame:
    """An explicit assignment wins even when it says "no system"; else the driver file's default."""
    override = cat["machine_system"].select("machine_id", F.col("system_id").alias("set_id"), F.lit(True).alias("is_set"))
    driver = cat["system_driver"].select("mame_sourcefile", F.col("system_id").alias("default_id"))
    return (cat["machine"].select("machine_id", "mame_sourcefile")
            .join(override, "machine_id", "left").join(driver, "mame_sourcefile", "left")
            .select("machine_id", F.when(F.col("is_set"), F.col("set_id")).otherwise(F.col("default_id")).alias("system_id")))


@view("v_machine")
def machine(cat) -> DataFrame:
    """Machines with corrections laid over the extracted values."""
    fix = cat["machine_correction"].select(
        "machine_id", F.col("name").alias("fix_name"), F.col("year").alias("fix_year"),
        F.col("manufacturer_id").alias("fix_maker"))
    alias = cat["manufacturer_alias"].select(F.col("alias").alias("mame_manufacturer"), F.col("manufacturer_id").alias("alias_maker"))
    override = cat["machine_system"].select("machine_id", F.col("system_id").alias("set_id"), F.lit(True).alias("is_set"))
    driver = cat["system_driver"].select("mame_sourcefile", F.col("system_id").alias("default_id"))
    listed_year = F.when(F.col("mame_year").rlike("^[0-9]{4}$"), F.col("mame_year")).try_cast("bigint")
    return (cat["machine"].join(fix, "machine_id", "left").join(override, "machine_id", "left")
            .join(driver, "mame_sourcefile", "left").join(alias, "mame_manufacturer", "left")
            .select("machine_id", F.coalesce("fix_name", "name").alias("name"),
                    F.when(F.col("is_set"), F.col("set_id")).otherwise(F.col("default_id")).alias("system_id"),
                    F.coalesce("fix_year", listed_year).alias("year"),
                    F.coalesce("fix_maker", "alias_maker").alias("manufacturer_id"),
                    "mame_sourcefile", "driver_status", "clone_count"))


def of_family(members: DataFrame, rows: DataFrame, item: str) -> DataFrame:
    """Each machine of `members` with its family's `rows`, but for those whose `item` it holds itself (`held`, may be null).

    The result is as large as machines times rows, so nothing is shuffled after this join: attributes belong into its two
    sides.  The rows are copied to groups of machines, so that a family is as many tasks as it has groups.
    """
    groups = F.sequence(F.lit(0).cast("long"), F.lit(AXIS_GROUPS - 1).cast("long"))
    spread = rows.withColumn("_group", F.explode(groups))
    placed = members.withColumn("_group", F.pmod(F.xxhash64("machine_id"), F.lit(AXIS_GROUPS).cast("long")))
    return (placed.join(spread, ["family_id", "_group"]).filter(~F.coalesce(F.array_contains("held", F.col(item)), F.lit(False)))
            .drop("family_id", "_group", "held"))


def family_members(cat, own: DataFrame, item: str) -> DataFrame:
    """(machine_id, family_id, held): machines of families with the distinct items of their own rows."""
    held = own.groupBy("machine_id").agg(F.collect_set(item).alias("held"))
    return (cat["v_machine_system"].filter(F.col("system_id").isNotNull()).withColumnRenamed("system_id", "family_id")
            .join(held, "machine_id", "left"))


def machine_bom_with(cat, machines: DataFrame | None = None, chips: DataFrame | None = None) -> DataFrame:
    """The effective BOM; columns of a machine and of a chip are joined before the family's chips meet its machines."""
    own = cat["machine_chip"]
    mine = own.select("machine_id", "chip_id", F.col("mame_tag").alias("role"), "quantity", "clock_hz", F.lit("machine").alias("via"))
    members = family_members(cat, own, "chip_id")
    sockets = cat["system_chip"].select(F.col("system_id").alias("family_id"), "chip_id", F.col("role_id").alias("role"), "quantity", "clock_hz",
                                        F.lit("system").alias("via"))
    if machines is not None:
        mine, members = mine.join(machines, "machine_id"), members.join(machines, "machine_id")
    if chips is not None:
        mine, sockets = mine.join(chips, "chip_id"), sockets.join(chips, "chip_id")
    return mine.unionByName(of_family(members, sockets, "chip_id"))


@view("v_machine_bom")
def machine_bom(cat) -> DataFrame:
    return machine_bom_with(cat).select("machine_id", "chip_id", "role", "quantity", "clock_hz", "via")


@view("v_chip_satisfies")
def chip_satisfies(cat) -> DataFrame:
    """One-hop substitution, never transitive: a single pass over the edges plus the identity."""
    itself = cat["chip"].select(F.col("chip_id").alias("socket_chip_id"), F.col("chip_id").alias("provider_chip_id"),
                                F.lit("self").alias("via"))
    edge = cat["chip_equivalence"]
    forward = F.struct(F.col("to_chip_id").alias("socket_chip_id"), F.col("from_chip_id").alias("provider_chip_id"),
                       F.col("kind").alias("via"))
    backward = F.struct(F.col("from_chip_id").alias("socket_chip_id"), F.col("to_chip_id").alias("provider_chip_id"),
                        F.col("kind").alias("via"))
    routes = F.when(F.col("kind") == "equivalent", F.array(forward, backward)).otherwise(F.array(forward))
    return itself.unionByName(edge.select(F.explode(routes).alias("r")).select("r.*"))


@view("v_chip_implementation_count")
def chip_implementation_count(cat) -> DataFrame:
    return (cat["implementation_chip"].join(cat["implementation"].select("implementation_id", "kind_id"), "implementation_id")
            .groupBy("chip_id", "kind_id").agg(F.count("*").alias("implementation_count")))


@view("v_system_chip_effective")
def system_chip_effective(cat) -> DataFrame:
    """Curated chips, plus observed chips nobody curated.

    A pair is 'curated' when any curated row names it, so one distinct-like aggregation over
    the union (curated marked 0, observed 1) replaces the union, anti-join and distinct.
    """
    observed = (cat["v_machine_system"].filter(F.col("system_id").isNotNull())
                .join(cat["machine_chip"].select("machine_id", "chip_id"), "machine_id")
                .select("system_id", "chip_id", F.lit(1).alias("observed")))
    curated = cat["system_chip"].select("system_id", "chip_id", F.lit(0).alias("observed"))
    return (curated.unionByName(observed).groupBy("system_id", "chip_id").agg(F.min("observed").alias("observed"))
            .select("system_id", "chip_id", F.when(F.col("observed") == 0, "curated").otherwise("mame").alias("via")))


@view("v_system_unmapped")
def system_unmapped(cat) -> DataFrame:
    return (cat["v_machine_system"].filter(F.col("system_id").isNotNull())
            .join(cat["machine_unmapped_device"].select("machine_id", "mame_device"), "machine_id")
            .groupBy("system_id").agg(F.count_distinct("mame_device").alias("unmapped_device_count")))


@view("v_system_core")
def system_core(cat) -> DataFrame:
    return (cat["implementation_system"].join(cat["implementation"].select("implementation_id", "kind_id"), "implementation_id")
            .join(cat["implementation_platform"], "implementation_id")
            .select("kind_id", "system_id", "platform_id", "implementation_id").distinct())


@view("v_mame_device_worklist")
def device_worklist(cat) -> DataFrame:
    return cat["machine_unmapped_device"].groupBy("mame_device").agg(
        F.count_distinct("machine_id").alias("machine_count"), F.sum("quantity").alias("instance_count"))


def _provided(cat) -> DataFrame:
    """Distinct (kind, chip) that some implementation names; taken before the edges fan out."""
    return (cat["implementation_chip"].join(cat["implementation"].select("implementation_id", "kind_id"), "implementation_id")
            .select("kind_id", F.col("chip_id").alias("provider_chip_id")).distinct())


@view("v_chip_satisfied")
def chip_satisfied(cat) -> DataFrame:
    return (cat["v_chip_satisfies"].join(_provided(cat), "provider_chip_id")
            .select("kind_id", F.col("socket_chip_id").alias("chip_id"), "via",
                    F.when(F.col("via") == "self", 1).when(F.col("via") == "equivalent", 2).otherwise(3).alias("evidence_rank"),
                    "provider_chip_id").distinct())


@view("v_chip_evidence")
def chip_evidence(cat) -> DataFrame:
    """Best route per (kind, chip): lowest rank, then lowest provider id, in one aggregation."""
    best = (cat["v_chip_satisfied"].groupBy("kind_id", "chip_id")
            .agg(F.min(F.struct("evidence_rank", "provider_chip_id")).alias("b")))
    rank = F.col("b.evidence_rank")
    return best.select(
        "kind_id", "chip_id", rank.alias("evidence_rank"),
        F.when(rank == 1, "self").when(rank == 2, "equivalent").otherwise("provides").alias("best_via"),
        F.when(rank == 1, "high").when(rank == 2, "medium").otherwise("low").alias("confidence"),
        F.col("b.provider_chip_id").alias("provider_chip_id"))


@view("v_system_chip_coverage")
def system_chip_coverage(cat) -> DataFrame:
    """Every socket under every kind, with its best route or 'unsatisfied'.

    Routes are completed per (kind, chip) first, so the sockets are shuffled once, not once per kind; a filter
    on the kind reaches the dictionary and the evidence.
    """
    chips = with_axis(cat["chip"].select("chip_id"), "chip_id", cat["implementation_kind"], "kind_id")
    routes = chips.join(cat["v_chip_evidence"], ["kind_id", "chip_id"], "left").select(
        "kind_id", "chip_id", F.coalesce("best_via", F.lit("unsatisfied")).alias("satisfied_via"),
        F.coalesce("evidence_rank", F.lit(4)).alias("evidence_rank"), "provider_chip_id", F.col("confidence").alias("chip_confidence"))
    return (cat["v_system_chip_effective"].select("system_id", "chip_id").join(routes, "chip_id")
            .select("kind_id", "system_id", "chip_id", "satisfied_via", "evidence_rank", "provider_chip_id", "chip_confidence"))


def _cells(cat) -> DataFrame:
    """Every family under every kind."""
    return with_axis(cat["system"].select("system_id"), "system_id", cat["implementation_kind"], "kind_id")


@view("v_system_coverage_by_kind")
def system_coverage_by_kind(cat) -> DataFrame:
    rank = F.col("evidence_rank")
    hit = cat["v_system_chip_coverage"].groupBy("kind_id", "system_id").agg(
        F.count("*").alias("n_total"), F.count_if(rank == 1).alias("n_direct"),
        F.count_if(rank == 2).alias("n_equivalent"), F.count_if(rank == 3).alias("n_provided"))
    cells = _cells(cat)

    def count(c):
        return F.coalesce(F.col(c), F.lit(0).cast("long"))

    counted = (cells.join(hit, ["kind_id", "system_id"], "left").join(cat["v_system_unmapped"], "system_id", "left")
               .select("kind_id", "system_id", count("n_total").alias("chips_total"), count("n_direct").alias("chips_direct"),
                       count("n_equivalent").alias("chips_equivalent"), count("n_provided").alias("chips_provided"),
                       (count("n_direct") + count("n_equivalent") + count("n_provided")).alias("chips_satisfied"),
                       count("unmapped_device_count").alias("unmapped_device_count")))
    total, missing = F.col("chips_total"), F.col("unmapped_device_count")
    confidence = (F.when((total == 0) | (missing * 2 >= total), "low")
                  .when((missing >= 1) | (F.col("chips_equivalent") + F.col("chips_provided") >= 1), "medium")
                  .otherwise("high"))
    return counted.select("kind_id", "system_id", "chips_total", "chips_direct", "chips_equivalent", "chips_provided",
                          "chips_satisfied", share(F.col("chips_satisfied"), total, 0.0).alias("satisfied_share"),
                          "unmapped_device_count", confidence.alias("confidence"))


def _without_core(cat, families: DataFrame) -> DataFrame:
    """Families on every platform where they have no FPGA core."""
    cored = cat["v_system_core"].filter(F.col("kind_id") == FPGA).select("system_id", "platform_id").distinct()
    return (with_axis(families, "system_id", cat["fpga_platform"], "platform_id")
            .join(cored, ["system_id", "platform_id"], "left_anti"))


def prospector_candidates(cat) -> DataFrame:
    """(platform_id, system_id): the rows of `v_prospector` without their coverage, which needs every device."""
    return _without_core(cat, _cells(cat).filter(F.col("kind_id") == FPGA).drop("kind_id")).select("platform_id", "system_id")


@view("v_prospector")
def prospector(cat) -> DataFrame:
    """Board families without an FPGA core, per platform."""
    covered = cat["v_system_coverage_by_kind"].filter(F.col("kind_id") == FPGA).drop("kind_id")
    return (_without_core(cat, covered)
            .select("platform_id", "system_id", "chips_total", "chips_direct", "chips_equivalent", "chips_provided",
                    "chips_satisfied", "satisfied_share", "unmapped_device_count", "confidence"))


@view("v_chip_gap")
def chip_gap(cat) -> DataFrame:
    """(kind, chip) no implementation satisfies, with how many families and machines use the chip."""
    systems = cat["system_chip"].groupBy("chip_id").agg(F.count_distinct("system_id").alias("n_systems"))
    machines = cat["machine_chip"].groupBy("chip_id").agg(F.count_distinct("machine_id").alias("n_machines"))
    banded = cat["chip"].join(cat["chip_function"].select("function_id", "prospector_band"), "function_id")
    used = (banded.select("chip_id", "display_name", "function_id", "prospector_band")
            .join(systems, "chip_id", "left").join(machines, "chip_id", "left"))
    zero = F.lit(0).cast("long")
    return (with_axis(used, "chip_id", cat["implementation_kind"], "kind_id")
            .join(cat["v_chip_evidence"].select("kind_id", "chip_id"), ["kind_id", "chip_id"], "left_anti")
            .select("kind_id", "chip_id", "display_name", "function_id", "prospector_band",
                    F.coalesce("n_systems", zero).alias("system_count"),
                    F.coalesce("n_machines", zero).alias("machine_count")))


@view("v_quality_instance")
def quality_instance(cat) -> DataFrame:
    """Mapped and unmapped instance sums: two partial sums over one union, no join."""
    zero = F.lit(0).cast("long")
    both = (cat["machine_chip"].select(F.col("quantity").alias("mapped"), zero.alias("unmapped"))
            .unionByName(cat["machine_unmapped_device"].select(zero.alias("mapped"), F.col("quantity").alias("unmapped"))))
    total = F.col("mapped_instances") + F.col("unmapped_instances")
    return (both.agg(F.coalesce(F.sum("mapped"), zero).alias("mapped_instances"),
                     F.coalesce(F.sum("unmapped"), zero).alias("unmapped_instances"))
            .select("mapped_instances", "unmapped_instances", total.alias("total_instances"),
                    share(F.col("mapped_instances"), total, 1.0).alias("mapped_instance_share")))


@view("v_quality_device")
def quality_device(cat) -> DataFrame:
    zero = F.lit(0).cast("long")
    listed = cat["mame_device"].agg(F.count("chip_id").alias("devices_mapped"), F.count("ignore_reason").alias("devices_ignored"))
    seen = cat["machine_unmapped_device"].agg(F.count_distinct("mame_device").alias("devices_unmapped"))
    return (listed.withColumn("devices_unmapped", zero)
            .unionByName(seen.withColumn("devices_mapped", zero).withColumn("devices_ignored", zero))
            .agg(*[F.sum(c).alias(c) for c in ("devices_mapped", "devices_ignored", "devices_unmapped")]))


@view("v_machine_instance")
def machine_instance(cat) -> DataFrame:
    """Instance sums per machine: one aggregation over machines, mapped and unmapped rows together."""
    zero = F.lit(0).cast("long")
    rows = (cat["machine"].select("machine_id", zero.alias("mapped"), zero.alias("unmapped"), F.lit(1).alias("listed"))
            .unionByName(cat["machine_chip"].select("machine_id", F.col("quantity").alias("mapped"), zero.alias("unmapped"), F.lit(0).alias("listed")))
            .unionByName(cat["machine_unmapped_device"].select("machine_id", zero.alias("mapped"), F.col("quantity").alias("unmapped"), F.lit(0).alias("listed"))))
    return (rows.groupBy("machine_id").agg(F.sum("mapped").alias("mapped_instances"), F.sum("unmapped").alias("unmapped_instances"),
                                           F.max("listed").alias("listed"))
            .filter(F.col("listed") == 1).drop("listed"))


@view("v_system_instance")
def system_instance(cat) -> DataFrame:
    total = F.col("mapped_instances") + F.col("unmapped_instances")
    return (cat["v_machine_system"].filter(F.col("system_id").isNotNull()).join(cat["v_machine_instance"], "machine_id")
            .groupBy("system_id").agg(F.sum("mapped_instances").alias("mapped_instances"),
                                      F.sum("unmapped_instances").alias("unmapped_instances"))
            .select("system_id", "mapped_instances", "unmapped_instances",
                    share(F.col("unmapped_instances"), total, 0.0).alias("unmapped_share")))


# The (entity, columns) whose presence is reported.
COMPLETENESS = {
    "chip": ("manufacturer_id", "description", "family_id", "model", "package", "typical_clock_hz", "year_introduced"),
    "implementation": ("license_id", "accuracy_id", "hdl_language_id", "project_id", "repo_url", "last_reviewed",
                       "verified_against_hardware"),
    "system": ("manufacturer_id", "year_introduced", "description"),
    "mame_device": ("note",),
}


@view("v_quality_completeness")
def quality_completeness(cat) -> DataFrame:
    """Rows present per optional column: one aggregation per table, then unpivoted."""
    out = None
    for entity, columns in COMPLETENESS.items():
        one = cat[entity].agg(F.count("*").alias("rows_total"), *[F.count(c).alias(c) for c in columns])
        tall = one.select(F.lit(entity).alias("entity"), "rows_total", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rows_present")) for c in columns])).alias("p")
        ).select("entity", "p.column_name", "rows_total", "p.rows_present")
        out = tall if out is None else out.unionByName(tall)
    sheets = (cat["chip"].select("chip_id", F.lit(1).alias("chip"), F.lit(0).alias("sheet"))
              .unionByName(cat["chip_datasheet"].select("chip_id", F.lit(0).alias("chip"), F.lit(1).alias("sheet")))
              .groupBy("chip_id").agg(F.sum("chip").alias("chip"), F.max("sheet").alias("sheet"))
              .agg(F.coalesce(F.sum("chip"), F.lit(0)).cast("long").alias("rows_total"),
                   F.coalesce(F.sum("sheet"), F.lit(0)).cast("long").alias("rows_present"))
              .select(F.lit("chip").alias("entity"), F.lit("datasheet").alias("column_name"), "rows_total", "rows_present"))
    return out.unionByName(sheets)
