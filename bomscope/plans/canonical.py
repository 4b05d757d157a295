"""Canonical parameterised reads and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bomscope.functions.columns import round4
from bomscope.operators.closure import reach_with_depth
from bomscope.plans.views import FPGA


def _only(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def system_bom_counts(cat, system_id: str | None = None, kind: str = FPGA) -> DataFrame:
    """A family's curated chips with how many implementations of the kind each has (all families when None)."""
    per_chip = cat["v_chip_implementation_count"].filter(F.col("kind_id") == kind).select("chip_id", "implementation_count")
    chips = cat["chip"].select("chip_id", "display_name", "function_id")
    return (_only(cat["system_chip"], "system_id", system_id).join(chips, "chip_id").join(per_chip, "chip_id", "left")
            .select("system_id", F.col("role_id").alias("role"), "chip_id", "display_name", "function_id",
                    F.coalesce("implementation_count", F.lit(0).cast("long")).alias("implementations")))


def prospector_simple(cat, platform_id: str | None = None) -> DataFrame:
    df = _only(cat["v_prospector"], "platform_id", platform_id).join(cat["system"].select("system_id", "name"), "system_id")
    return (df.select("platform_id", "system_id", "name", "chips_total", "chips_satisfied", "chips_equivalent", "chips_provided",
                      (F.floor(F.col("satisfied_share") * 1000 + F.lit(0.5)).cast("double") / F.lit(10.0)).alias("satisfied_pct"),
                      "satisfied_share", "unmapped_device_count", "confidence")
            .orderBy("platform_id", F.desc("satisfied_share"), "unmapped_device_count", F.desc("chips_total"), "system_id"))


def dependency_closure(cat, consumers: DataFrame | None = None) -> DataFrame:
    """Every FPGA implementation a consumer uses, directly or not, with depth, chips, paths and repository."""
    seeds = cat["implementation_dependency"].select("consumer_id") if consumers is None else consumers
    used = reach_with_depth(cat["implementation_dependency"], "consumer_id", "provider_id", seeds)
    impl = cat["implementation"].filter(F.col("kind_id") == FPGA)
    project = cat["project"].select("project_id", F.col("url").alias("project_url"))
    about = (impl.join(project, "project_id", "left").join(cat["implementation_chip"], "implementation_id", "left")
             .join(cat["implementation_path"], "implementation_id", "left")
             .select("implementation_id", "name", "chip_id", "path", "is_top",
                     F.coalesce("repo_url", "project_url").alias("repo_url"), "license_id"))
    return used.select(F.col("seed").alias("consumer_id"), F.col("node").alias("implementation_id"), "depth").join(about, "implementation_id")


def consumers_of(cat, provider_id: str | None = None) -> DataFrame:
    return _only(cat["implementation_dependency"], "provider_id", provider_id).select("provider_id", "consumer_id")


def chip_gap_ranked(cat, kind: str = FPGA) -> DataFrame:
    return (cat["v_chip_gap"].filter(F.col("kind_id") == kind)
            .select("chip_id", "display_name", "function_id", "prospector_band", "system_count", "machine_count")
            .orderBy(F.desc("system_count"), F.desc("machine_count"), "chip_id"))


def system_coverage(cat, system_id: str | None = None, kind: str = FPGA) -> DataFrame:
    return _only(cat["v_system_coverage_by_kind"].filter(F.col("kind_id") == kind), "system_id", system_id)


def system_coverage_explained(cat, system_id: str | None = None, kind: str = FPGA) -> DataFrame:
    return _only(cat["v_system_chip_coverage"].filter(F.col("kind_id") == kind), "system_id", system_id).select(
        "system_id", "chip_id", "satisfied_via", "provider_chip_id", "chip_confidence")


def worklist_top(cat, min_instance_count: int = 50, min_machine_count: int = 5, top_n: int = 25, samples: int = 5) -> DataFrame:
    """The top-n report over both minimums, with the first machine ids of each device."""
    top = (cat["v_mame_device_worklist"]
           .filter((F.col("instance_count") >= min_instance_count) & (F.col("machine_count") >= min_machine_count))
           .orderBy(F.desc("instance_count"), "mame_device").limit(top_n))
    first = W.partitionBy("mame_device").orderBy("machine_id")
    ids = (cat["machine_unmapped_device"].select("mame_device", "machine_id").join(top.select("mame_device"), "mame_device", "left_semi")
           .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= samples)
           .groupBy("mame_device").agg(F.array_join(F.array_sort(F.collect_list("machine_id")), " ").alias("sample_machines")))
    return (top.join(ids, "mame_device").select("mame_device", "instance_count", "machine_count", "sample_machines")
            .orderBy(F.desc("instance_count"), "mame_device"))


def warnings_by_code(cat) -> DataFrame:
    return cat["v_quality_warning"].groupBy("code").agg(F.count("*").alias("warnings"))


REPORT_COUNTED = ("chip", "implementation", "machine", "project", "system")
REPORT_VERSIONS = ("dataset_version", "mame_version", "schema_version", "threshold_version")


def quality_report_items(cat) -> DataFrame:
    """The report's scalars as rows (section, name, value as text); a warning code without rows is absent."""
    def item(df, section, name, value):
        return df.select(F.lit(section).alias("section"), (name if not isinstance(name, str) else F.lit(name)).alias("name"), value.cast("string").alias("value"))

    parts = [item(cat[t].agg(F.count("*").alias("n")), "counts", t, F.col("n")) for t in REPORT_COUNTED]
    unpivot = lambda df, section, pairs: df.select(F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in pairs])).alias("i")).select("i.*")
    parts.append(unpivot(cat["v_quality_device"], "devices", [(n, F.col(f"devices_{n}")) for n in ("ignored", "mapped", "unmapped")]))
    parts.append(unpivot(cat["v_quality_instance"], "instances", [
        ("mapped", F.col("mapped_instances")), ("mapped_instance_share", round4(F.col("mapped_instance_share"))),
        ("total", F.col("total_instances")), ("unmapped", F.col("unmapped_instances"))]))
    parts.append(item(warnings_by_code(cat), "warnings_by_code", F.col("code"), F.col("warnings")))
    parts.append(item(cat["dataset_meta"].filter(F.col("key").isin(*REPORT_VERSIONS)), "versions", F.col("key"), F.col("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_report(cat) -> DataFrame:
    """One row, one `report` string: a JSON object with bytewise-ascending keys."""
    rows = quality_report_items(cat).groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("m"))
    whole = rows.agg(F.map_from_entries(F.collect_list(F.struct("section", "m"))).alias("s"))
    s = F.col("s")
    counted = lambda key: F.transform_values(s[key], lambda k, v: v.cast("long"))
    inst = s["instances"]
    version = lambda k: s["versions"][k].alias(k)
    return whole.select(F.to_json(F.struct(
        counted("counts").alias("counts"), version("dataset_version"), counted("devices").alias("devices"),
        F.struct(inst["mapped"].cast("long").alias("mapped"), inst["mapped_instance_share"].cast("double").alias("mapped_instance_share"),
                 inst["total"].cast("long").alias("total"), inst["unmapped"].cast("long").alias("unmapped")).alias("instances"),
        version("mame_version"), version("schema_version"), version("threshold_version"),
        F.coalesce(counted("warnings_by_code"), F.from_json(F.lit("{}"), "map<string,long>")).alias("warnings_by_code"))).alias("report"))
