"""Browse lists with their filters, detail relations for all ids, and dashboard reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bomscope.functions.columns import any_text, with_axis
from bomscope.plans.views import FPGA, family_members, machine_bom_with, of_family, prospector_candidates



def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)


def _label(cat, table: str, key: str, source: str, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return cat[table].select(F.col(key).alias(key), F.col(source).alias(name), *extra)


def _fpga_evidence(cat) -> DataFrame:
    return cat["v_chip_evidence"].filter(F.col("kind_id") == FPGA).select("chip_id", "best_via", "provider_chip_id")


def _sorted(df: DataFrame, by: Column | list[Column], descending: bool, key: str) -> DataFrame:
    cols = by if isinstance(by, list) else [by]
    return df.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols], F.asc(key))


def _equal(column: str, value) -> Column:
    return F.lit(True) if value in (None, "") else F.col(column) == value


def _equal_or_none(column: str, value) -> Column:
    """`none` asks for rows without a value."""
    return F.col(column).isNull() if value == "none" else _equal(column, value)


# -- chips --------------------------------------------------------------------------

def chip_browser(cat) -> DataFrame:
    machines = _bom_machines(cat)
    systems = cat["v_system_chip_effective"].groupBy("chip_id").agg(F.count_distinct("system_id").alias("system_count"))
    per_chip = cat["v_chip_implementation_count"].filter(F.col("kind_id") == FPGA).select(
        "chip_id", F.col("implementation_count").alias("fpga_implementations"))
    chips = (cat["chip"].select("chip_id", "display_name", "function_id", "manufacturer_id", "year_introduced")
             .join(_label(cat, "chip_function", "function_id", "label", "function_label", ("prospector_band",)), "function_id")
             .join(_label(cat, "manufacturer", "manufacturer_id", "name", "manufacturer_name"), "manufacturer_id", "left"))
    return (chips.join(per_chip, "chip_id", "left").join(machines, "chip_id", "left").join(systems, "chip_id", "left")
            .join(_fpga_evidence(cat).select("chip_id", "best_via"), "chip_id", "left")
            .select("chip_id", "display_name", "function_id", "function_label", "prospector_band", "manufacturer_id",
                    "manufacturer_name", "year_introduced", _n("fpga_implementations"), _n("machine_count"), _n("system_count"), "best_via"))


def _own_chips(cat) -> DataFrame:
    """Distinct (machine_id, chip_id) of the machines' own rows, with `curated`: the machine's family lists the chip too."""
    own = cat["machine_chip"].select("machine_id", "chip_id").distinct()
    curated = cat["system_chip"].select("system_id", "chip_id").distinct().withColumn("curated", F.lit(True))
    return (own.join(cat["v_machine_system"], "machine_id", "left").join(curated, ["system_id", "chip_id"], "left")
            .select("machine_id", "chip_id", F.coalesce("curated", F.lit(False)).alias("curated")))


def _bom_machines(cat) -> DataFrame:
    """Machines per chip over the effective BOM, without expanding it: a family's machines count for each of its chips,
    and a machine's own row counts unless its family has the chip."""
    members = cat["v_machine_system"].filter("system_id IS NOT NULL").groupBy("system_id").agg(F.count("*").alias("n"))
    family = cat["system_chip"].select("system_id", "chip_id").distinct().join(members, "system_id").select("chip_id", "n")
    own = _own_chips(cat).filter("NOT curated").groupBy("chip_id").agg(F.count("*").alias("n"))
    return family.unionByName(own).groupBy("chip_id").agg(F.sum("n").alias("machine_count"))


def _machine_chips(cat) -> DataFrame:
    """(machine_id, chips_total, chips_satisfied) over the effective BOM: a family's totals plus the machine's own other chips."""
    covered = _fpga_evidence(cat).select("chip_id", F.lit(1).alias("_hit"))
    totals = F.count("*").alias("n"), F.count("_hit").alias("hits")
    family = cat["system_chip"].select("system_id", "chip_id").distinct().join(covered, "chip_id", "left").groupBy("system_id").agg(*totals)
    of_family = cat["v_machine_system"].join(family, "system_id").select("machine_id", "n", "hits")
    own = _own_chips(cat).filter("NOT curated").join(covered, "chip_id", "left").groupBy("machine_id").agg(*totals)
    return of_family.unionByName(own).groupBy("machine_id").agg(F.sum("n").alias("chips_total"), F.sum("hits").alias("chips_satisfied"))


def chip_filter_sort(chips: DataFrame, *, function=None, manufacturer=None, status=None, text=None, sort="machines", descending=True) -> DataFrame:
    via = F.col("best_via")
    state = {"implemented": via == "self", "equivalent": via.isin("equivalent", "provides"),
             "covered": via.isNotNull(), "missing": via.isNull()}.get(status, F.lit(True))
    keep = _equal("function_id", function) & _equal("manufacturer_id", manufacturer) & state & any_text(text, F.col("display_name"), F.col("chip_id"))
    by = {"machines": F.col("machine_count"), "systems": F.col("system_count"), "implementations": F.col("fpga_implementations"),
          "name": F.col("display_name"), "year": F.coalesce("year_introduced", F.lit(0))}[sort]
    return _sorted(chips.filter(keep), by, descending, "chip_id")


# -- machines -----------------------------------------------------------------------

def machine_browser(cat) -> DataFrame:
    chips = _machine_chips(cat)
    unmapped = cat["machine_unmapped_device"].groupBy("machine_id").agg(F.count_distinct("mame_device").alias("unmapped_devices"))
    by_family = cat["v_machine_system"].join(cat["implementation_system"].select("system_id").distinct(), "system_id", "left_semi").select("machine_id")
    cored = cat["implementation_machine"].select("machine_id").unionByName(by_family).distinct().withColumn("_core", F.lit(1))
    return (cat["v_machine"].join(chips, "machine_id", "left").join(unmapped, "machine_id", "left").join(cored, "machine_id", "left")
            .select("machine_id", "name", "year", "manufacturer_id", "system_id", "driver_status", _n("chips_total"), _n("chips_satisfied"),
                    _n("unmapped_devices"), F.coalesce("_core", F.lit(0)).alias("has_core")))


def machine_filter_sort(cat, machines: DataFrame, *, manufacturer=None, family=None, kind=None, year_from=None, year_to=None,
                        min_coverage=None, core=None, text=None, sort="name", descending=False) -> DataFrame:
    share = F.when(F.col("chips_total") == 0, F.lit(0.0)).otherwise(F.col("chips_satisfied") / F.col("chips_total"))
    keep = _equal("manufacturer_id", manufacturer) & _equal_or_none("system_id", family) & any_text(text, F.col("name"), F.col("machine_id"))
    if year_from is not None:
        keep = keep & (F.col("year") >= year_from)
    if year_to is not None:
        keep = keep & (F.col("year") <= year_to)
    if min_coverage is not None:
        keep = keep & (share * 100 >= min_coverage)
    if core in ("yes", "no"):
        keep = keep & (F.col("has_core") == (1 if core == "yes" else 0))
    df = machines.filter(keep)
    if kind:
        df = df.join(cat["system"].filter(F.col("kind_id") == kind).select("system_id"), "system_id", "left_semi").select(machines.columns)
    by = {"name": [F.col("name")], "year": [F.coalesce("year", F.lit(0))], "coverage": [share, F.col("chips_total")],
          "unmapped": [F.col("unmapped_devices")]}[sort]
    return _sorted(df, by, descending, "machine_id")


# -- systems ------------------------------------------------------------------------

def _fpga_coverage(cat) -> DataFrame:
    return cat["v_system_coverage_by_kind"].filter(F.col("kind_id") == FPGA).drop("kind_id")


def system_browser(cat) -> DataFrame:
    members = cat["v_machine_system"].filter("system_id IS NOT NULL").groupBy("system_id").agg(F.count("*").alias("machine_count"))
    cores = cat["implementation_system"].groupBy("system_id").agg(F.count_distinct("implementation_id").alias("core_count"))
    return (cat["system"].select("system_id", "name", "kind_id", "manufacturer_id", "year_introduced", "description")
            .join(_label(cat, "system_kind", "kind_id", "label", "kind_label"), "kind_id")
            .join(_label(cat, "manufacturer", "manufacturer_id", "name", "manufacturer_name"), "manufacturer_id", "left")
            .join(_fpga_coverage(cat), "system_id", "left").join(members, "system_id", "left").join(cores, "system_id", "left")
            .select("system_id", "name", "kind_id", "kind_label", "manufacturer_id", "manufacturer_name", "year_introduced", "description",
                    _n("chips_total"), _n("chips_satisfied"), _n("unmapped_device_count"), "confidence", _n("machine_count"), _n("core_count")))


def system_filter(systems: DataFrame, *, kind=None, manufacturer=None, core=None, text=None) -> DataFrame:
    keep = _equal("kind_id", kind) & _equal("manufacturer_id", manufacturer) & any_text(text, F.col("name"), F.col("system_id"))
    if core in ("yes", "no"):
        keep = keep & ((F.col("core_count") > 0) == F.lit(core == "yes"))
    return systems.filter(keep).orderBy("name", "system_id")


# -- implementations ----------------------------------------------------------------

def implementation_browser(cat) -> DataFrame:
    def tally(table, key, name):
        return cat[table].groupBy(F.col(key).alias("implementation_id")).agg(F.count("*").alias(name))

    df = (cat["implementation"].drop("kind_id")
          .join(_label(cat, "license", "license_id", "name", "license_name", ("is_osi_approved",)), "license_id", "left")
          .join(_label(cat, "accuracy_level", "accuracy_id", "label", "accuracy_label"), "accuracy_id", "left")
          .join(cat["hdl_language"].select(F.col("language_id").alias("hdl_language_id"), F.col("label").alias("language_label")), "hdl_language_id", "left")
          .join(_label(cat, "project", "project_id", "name", "project_name", ("author",)), "project_id", "left"))
    counts = (("implementation_chip", "implementation_id", "chip_count"), ("implementation_machine", "implementation_id", "machine_count"),
              ("implementation_system", "implementation_id", "system_count"), ("implementation_dependency", "provider_id", "consumer_count"))
    for table, key, name in counts:
        df = df.join(tally(table, key, name), "implementation_id", "left")
    return df.select("implementation_id", df["name"], "repo_url", "license_id", "license_name", "is_osi_approved", "accuracy_id", "accuracy_label",
                     "hdl_language_id", "language_label", "project_id", "project_name", "author", "verified_against_hardware",
                     "last_reviewed", "resource_notes", "notes", *[_n(c[2]) for c in counts])


def implementation_filter(cat, implementations: DataFrame, *, language=None, license=None, accuracy=None, project=None, platform=None, text=None) -> DataFrame:
    keep = (_equal("hdl_language_id", language) & _equal_or_none("license_id", license) & _equal_or_none("accuracy_id", accuracy)
            & _equal("project_id", project)
            & any_text(text, F.col("name"), F.col("implementation_id"), F.col("author"), F.col("project_name")))
    df = implementations.filter(keep)
    if platform:
        on = cat["implementation_platform"].filter(F.col("platform_id") == platform).select("implementation_id")
        df = df.join(on, "implementation_id", "left_semi")
    return df.orderBy("name", "implementation_id")


def facets(cat) -> DataFrame:
    """Distinct values present per filter, with a label: (facet, value, label)."""
    def facet(name, df, value, label):
        return df.filter(F.col(value).isNotNull()).select(F.lit(name).alias("facet"), F.col(value).alias("value"), F.col(label).alias("label")).distinct()

    chips = cat["chip"].select("function_id", "manufacturer_id").distinct()
    impl = cat["implementation"].select("license_id", "project_id", "hdl_language_id", "accuracy_id").distinct()
    projects = cat["project"].select("project_id", F.when(F.col("author").isNull(), F.col("name")).otherwise(F.concat_ws(" — ", "name", "author")).alias("project_label"))
    return (facet("chip_function", chips.join(_label(cat, "chip_function", "function_id", "label", "l"), "function_id"), "function_id", "l")
            .unionByName(facet("chip_manufacturer", chips.join(_label(cat, "manufacturer", "manufacturer_id", "name", "l"), "manufacturer_id"), "manufacturer_id", "l"))
            .unionByName(facet("license", impl, "license_id", "license_id"))
            .unionByName(facet("project", impl.join(projects, "project_id"), "project_id", "project_label"))
            .unionByName(facet("system_kind", cat["system"].select("kind_id").distinct().join(_label(cat, "system_kind", "kind_id", "label", "l"), "kind_id"), "kind_id", "l")))


# -- details: relations for every id; the caller filters ------------------------------

def chip_head(cat) -> DataFrame:
    return (cat["chip"].join(_label(cat, "chip_function", "function_id", "label", "function_label").join(
                cat["chip_function"].select("function_id", F.col("description").alias("function_description"), "prospector_band"), "function_id"), "function_id")
            .join(_label(cat, "manufacturer", "manufacturer_id", "name", "manufacturer_name"), "manufacturer_id", "left")
            .join(_label(cat, "chip_family", "family_id", "name", "family_name"), "family_id", "left")
            .select("chip_id", "display_name", "function_id", "function_label", "function_description", "prospector_band", "manufacturer_id",
                    "manufacturer_name", "family_id", "family_name", "model", "description", "typical_clock_hz", "package", "year_introduced", "notes"))


def chip_implementations(cat) -> DataFrame:
    """Implementations that satisfy a socket, with the route."""
    routes = cat["v_chip_satisfies"].join(cat["implementation_chip"].withColumnRenamed("chip_id", "provider_chip_id"), "provider_chip_id")
    impl = (cat["implementation"].drop("notes", "resource_notes")
            .join(_label(cat, "license", "license_id", "name", "license_name"), "license_id", "left")
            .join(_label(cat, "accuracy_level", "accuracy_id", "label", "accuracy_label"), "accuracy_id", "left")
            .join(cat["hdl_language"].select(F.col("language_id").alias("hdl_language_id"), F.col("label").alias("language_label")), "hdl_language_id", "left")
            .join(_label(cat, "project", "project_id", "name", "project_name", ("author",)), "project_id", "left"))
    return routes.join(impl, "implementation_id").select(
        F.col("socket_chip_id").alias("chip_id"), "implementation_id", "name", "kind_id", "repo_url", "license_id", "license_name", "accuracy_id",
        "accuracy_label", "language_label", "project_id", "project_name", "author", "verified_against_hardware", "last_reviewed", "via",
        "provider_chip_id").distinct()


def _first_n(df: DataFrame, per: str, order: list[str], n: int | None) -> DataFrame:
    """All rows, or the first n per id for a caller that asks for them; the limit is applied before the shuffle."""
    if n is None:
        return df
    w = W.partitionBy(per).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def chip_machines(cat, limit: int | None = None) -> DataFrame:
    df = machine_bom_with(cat, machines=cat["v_machine"].select("machine_id", "name", "year", "system_id")).select(
        "chip_id", "machine_id", "name", "year", "system_id", "role", "via", "clock_hz", "quantity")
    return _first_n(df, "chip_id", ["name", "machine_id", "role"], limit)


def chip_equivalences(cat) -> DataFrame:
    names = cat["chip"].select("chip_id", "display_name")
    edge = (cat["chip_equivalence"].join(names.select(F.col("chip_id").alias("from_chip_id"), F.col("display_name").alias("from_name")), "from_chip_id")
            .join(names.select(F.col("chip_id").alias("to_chip_id"), F.col("display_name").alias("to_name")), "to_chip_id"))
    return edge.select(F.explode(F.array("from_chip_id", "to_chip_id")).alias("chip_id"), "from_chip_id", "to_chip_id", "kind", "note", "from_name", "to_name")


def chip_systems(cat) -> DataFrame:
    return cat["v_system_chip_effective"].join(cat["system"].select("system_id", "name"), "system_id").select("chip_id", "system_id", "name", "via")


def chip_machine_count(cat) -> DataFrame:
    return _bom_machines(cat)


def machine_head(cat) -> DataFrame:
    fixes = cat["machine_correction"].select("machine_id", F.col("reason").alias("correction_reason"), F.col("source_url").alias("correction_source"))
    override = cat["machine_system"].select("machine_id", F.col("reason").alias("system_reason"))
    return (cat["v_machine"].join(_label(cat, "manufacturer", "manufacturer_id", "name", "manufacturer_name"), "manufacturer_id", "left")
            .join(_label(cat, "system", "system_id", "name", "system_name"), "system_id", "left")
            .join(fixes, "machine_id", "left").join(override, "machine_id", "left")
            .select("machine_id", "name", "year", "manufacturer_name", "system_id", "system_name", "mame_sourcefile", "driver_status",
                    "clone_count", "correction_reason", "correction_source", "system_reason"))


def machine_bom_detail(cat) -> DataFrame:
    chips = cat["chip"].select("chip_id", "display_name", "function_id").join(
        _label(cat, "chip_function", "function_id", "label", "function_label", ("prospector_band",)), "function_id")
    about = chips.join(_fpga_evidence(cat), "chip_id", "left")
    return machine_bom_with(cat, chips=about).select(
        "machine_id", "chip_id", "role", "quantity", "clock_hz", "via", "display_name", "function_label", "prospector_band", "best_via", "provider_chip_id")


def machine_implementations(cat) -> DataFrame:
    """FPGA implementations satisfying any socket of a machine. Distinct chips of machines and of families first, so
    repeated sockets do not multiply; a machine's own chips are left out of its family's."""
    impl = cat["implementation"].filter(F.col("kind_id") == FPGA).select("implementation_id", "name", "repo_url")
    routes = (cat["v_chip_satisfies"].join(cat["implementation_chip"].withColumnRenamed("chip_id", "provider_chip_id"), "provider_chip_id")
              .join(impl, "implementation_id").select(F.col("socket_chip_id").alias("chip_id"), "implementation_id", "name", "repo_url", "via"))
    own = cat["machine_chip"].select("machine_id", "chip_id").distinct()
    sockets = cat["system_chip"].select(F.col("system_id").alias("family_id"), "chip_id").distinct()
    return own.join(routes, "chip_id").unionByName(of_family(family_members(cat, own, "chip_id"), sockets.join(routes, "chip_id"), "chip_id")).select(
        "machine_id", "chip_id", "implementation_id", "name", "repo_url", "via")


def machine_cores(cat) -> DataFrame:
    """Implementations that claim the machine, or failing that its family."""
    impl = cat["implementation"].select("implementation_id", "name", "repo_url", "license_id", "accuracy_id")
    own = cat["implementation_machine"].select("machine_id", "implementation_id").distinct()
    family = cat["implementation_system"].select(F.col("system_id").alias("family_id"), "implementation_id").distinct().join(impl, "implementation_id")
    far = of_family(family_members(cat, own, "implementation_id"), family, "implementation_id").withColumn("scope", F.lit("system"))
    return own.join(impl, "implementation_id").withColumn("scope", F.lit("machine")).unionByName(far).select(
        "machine_id", "implementation_id", "name", "repo_url", "license_id", "accuracy_id", "scope")


def machine_unmapped(cat) -> DataFrame:
    return cat["machine_unmapped_device"].select("machine_id", "mame_device", "quantity")


def system_head(cat) -> DataFrame:
    members = cat["v_machine_system"].filter("system_id IS NOT NULL").groupBy("system_id").agg(F.count("*").alias("machine_count"))
    unmapped = cat["v_system_instance"].select("system_id", F.col("unmapped_share").alias("unmapped_instance_share"))
    return (cat["system"].select("system_id", "name", "kind_id", "manufacturer_id", "year_introduced", "description", "notes")
            .join(_label(cat, "system_kind", "kind_id", "label", "kind_label"), "kind_id")
            .join(_label(cat, "manufacturer", "manufacturer_id", "name", "manufacturer_name"), "manufacturer_id", "left")
            .join(_fpga_coverage(cat), "system_id", "left").join(members, "system_id", "left").join(unmapped, "system_id", "left")
            .select("system_id", "name", "kind_label", "manufacturer_name", "year_introduced", "description", "notes",
                    *[_n(c) for c in ("chips_total", "chips_satisfied", "chips_direct", "chips_equivalent", "chips_provided")],
                    F.coalesce("satisfied_share", F.lit(0.0)).alias("satisfied_share"), _n("unmapped_device_count"), "confidence",
                    _n("machine_count"), "unmapped_instance_share"))


def system_chipset(cat) -> DataFrame:
    chips = cat["chip"].select("chip_id", "display_name", "function_id").join(
        _label(cat, "chip_function", "function_id", "label", "function_label", ("prospector_band",)), "function_id")
    cover = cat["v_system_chip_coverage"].filter(F.col("kind_id") == FPGA).select("system_id", "chip_id", "satisfied_via", "provider_chip_id", "chip_confidence")
    uses = (cat["v_machine_system"].filter("system_id IS NOT NULL").join(cat["machine_chip"].select("machine_id", "chip_id"), "machine_id")
            .groupBy("system_id", "chip_id").agg(F.count_distinct("machine_id").alias("machine_count")))
    return (cat["v_system_chip_effective"].join(chips, "chip_id").join(cover, ["system_id", "chip_id"], "left").join(uses, ["system_id", "chip_id"], "left")
            .select("system_id", "chip_id", "via", "display_name", "function_label", "prospector_band", "satisfied_via", "provider_chip_id",
                    "chip_confidence", _n("machine_count")))


def system_platforms(cat) -> DataFrame:
    """Every family on every platform with a has_core flag."""
    core = (cat["v_system_core"].filter(F.col("kind_id") == FPGA).select("system_id", "platform_id").distinct().withColumn("_core", F.lit(1)))
    cells = with_axis(cat["system"].select("system_id"), "system_id", cat["fpga_platform"], "platform_id")
    return (cells.join(core, ["system_id", "platform_id"], "left").join(_label(cat, "fpga_platform", "platform_id", "label", "label"), "platform_id")
            .select("system_id", "platform_id", "label", F.coalesce("_core", F.lit(0)).alias("has_core")))


def system_machines(cat, limit: int | None = None) -> DataFrame:
    df = cat["v_machine"].filter("system_id IS NOT NULL").select("system_id", "machine_id", "name")
    return _first_n(df, "system_id", ["name", "machine_id"], limit)


def system_drivers(cat) -> DataFrame:
    return cat["system_driver"].select("system_id", "mame_sourcefile")


def system_cores(cat) -> DataFrame:
    return cat["implementation_system"].join(cat["implementation"].select("implementation_id", "name", "repo_url", "license_id"), "implementation_id").select(
        "system_id", "implementation_id", "name", "repo_url", "license_id")


def implementation_links(cat, machine_limit: int | None = None) -> DataFrame:
    """What an implementation touches: (implementation_id, relation, id, name, note)."""
    def rel(name, df, key, target, label, note=None):
        return df.select(F.col(key).alias("implementation_id"), F.lit(name).alias("relation"), F.col(target).alias("id"),
                         F.col(label).alias("name"), (F.col(note) if note else F.lit(None)).cast("string").alias("note"))

    impl = cat["implementation"].select("implementation_id", "name")
    dep = cat["implementation_dependency"]
    machines = _first_n(cat["implementation_machine"].join(cat["v_machine"].select("machine_id", "name"), "machine_id"),
                        "implementation_id", ["name", "machine_id"], machine_limit)
    return (rel("chip", cat["implementation_chip"].join(cat["chip"].select("chip_id", "display_name"), "chip_id"), "implementation_id", "chip_id", "display_name")
            .unionByName(rel("system", cat["implementation_system"].join(cat["system"].select("system_id", "name"), "system_id"), "implementation_id", "system_id", "name"))
            .unionByName(rel("machine", machines, "implementation_id", "machine_id", "name"))
            .unionByName(rel("provider", dep.join(impl.withColumnRenamed("implementation_id", "provider_id"), "provider_id"), "consumer_id", "provider_id", "name", "note"))
            .unionByName(rel("consumer", dep.join(impl.withColumnRenamed("implementation_id", "consumer_id"), "consumer_id"), "provider_id", "consumer_id", "name")))


# -- dashboard ------------------------------------------------------------------------

def headline(cat, platform: str) -> DataFrame:
    """Ten scalars in one row: one-row aggregates are stacked and summed, nothing is joined."""
    evidence = _fpga_evidence(cat)
    counts = {
        "chips": cat["chip"].agg(F.count("*")), "machines": cat["machine"].agg(F.count("*")), "systems": cat["system"].agg(F.count("*")),
        "implementations": cat["implementation"].filter(F.col("kind_id") == FPGA).agg(F.count("*")), "projects": cat["project"].agg(F.count("*")),
        "chips_covered": evidence.agg(F.count("*")), "chips_direct": evidence.agg(F.count_if(F.col("best_via") == "self")),
        "machines_with_core": cat["implementation_machine"].agg(F.count_distinct("machine_id")),
        "systems_with_core": cat["implementation_system"].agg(F.count_distinct("system_id")),
        "prospector_candidates": prospector_candidates(cat).filter(F.col("platform_id") == platform).agg(F.count("*"))}
    out = None
    for name, df in counts.items():
        row = df.toDF("n").select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out.agg(*[F.sum(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in counts])


def band_rollup(cat) -> DataFrame:
    bands = cat["chip_function"].select("function_id", F.col("prospector_band").alias("band"))
    order = F.when(F.col("band") == "hard", 0).when(F.col("band") == "medium", 1).otherwise(2)
    return (cat["chip"].select("chip_id", "function_id").join(bands, "function_id").join(_fpga_evidence(cat), "chip_id", "left")
            .groupBy("band").agg(F.count("*").alias("chips"), F.count("best_via").alias("covered")).orderBy(order))


def top_worklist(cat, limit: int = 8) -> DataFrame:
    return (cat["v_mame_device_worklist"].select("mame_device", "machine_count", "instance_count")
            .orderBy(F.desc("instance_count"), F.desc("machine_count"), "mame_device").limit(limit))
