"""The fifteen quality warnings: each branch yields (code, subject, impact, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomscope.catalog import view
from bomscope.functions.columns import round4


def _setting(cat, name: str):
    """Policy value as a scalar subquery over the threshold table."""
    return cat["threshold"].filter(F.col("name") == name).agg(F.max("value")).scalar()


def _warn(df: DataFrame, code: str, subject, impact, detail: str) -> DataFrame:
    as_text = F.lit(None).cast("string") if subject is None else subject
    value = F.lit(None).cast("double") if impact is None else impact.cast("double")
    return df.select(F.lit(code).alias("code"), as_text.alias("subject"), value.alias("impact"), F.lit(detail).alias("detail"))


def mapped_instance_share_low(cat):
    df = cat["v_quality_instance"].filter(F.col("mapped_instance_share") < _setting(cat, "mapped_instance_share.warn_below"))
    return _warn(df, "MAPPED_INSTANCE_SHARE_LOW", None, round4(F.col("mapped_instance_share")),
                 "dataset mapped-instance share is below the warn threshold")


def unmapped_device_high_impact(cat):
    df = cat["v_mame_device_worklist"].filter(
        (F.col("instance_count") >= _setting(cat, "issue_generator.min_instance_count"))
        & (F.col("machine_count") >= _setting(cat, "issue_generator.min_machine_count")))
    return _warn(df, "UNMAPPED_DEVICE_HIGH_IMPACT", F.col("mame_device"), F.col("instance_count"),
                 "unmapped MAME device is above both issue-generator thresholds")


def chip_missing_metadata(cat):
    missing = F.col("manufacturer_id").isNull().cast("int") + F.col("description").isNull().cast("int")
    return _warn(cat["chip"].filter(missing > 0), "CHIP_MISSING_METADATA", F.col("chip_id"), missing,
                 "chip is missing manufacturer and/or description")


def _licensable(cat):
    return cat["implementation"].filter(F.col("kind_id") != "original_silicon")


def impl_unverified_license(cat):
    return _warn(_licensable(cat).filter("license_id IS NULL"), "IMPL_UNVERIFIED_LICENSE", F.col("implementation_id"), None,
                 "implementation has no verified license")


def impl_unverified_accuracy(cat):
    return _warn(_licensable(cat).filter("accuracy_id IS NULL"), "IMPL_UNVERIFIED_ACCURACY", F.col("implementation_id"), None,
                 "implementation has no assessed accuracy level")


def impl_stale_review(cat):
    built = cat["dataset_meta"].filter(F.col("key") == "build_date").agg(F.max("value")).scalar()
    days = F.date_diff(F.to_date(built), F.to_date("last_reviewed"))
    df = cat["implementation"].filter(F.col("last_reviewed").isNotNull()).withColumn("days", days)
    return _warn(df.filter(F.col("days") > _setting(cat, "stale_review_days")), "IMPL_STALE_REVIEW",
                 F.col("implementation_id"), F.col("days"), "implementation last_reviewed is older than the staleness threshold")


def impl_untargeted(cat):
    df = (cat["implementation"].join(cat["implementation_chip"], "implementation_id", "left_anti")
          .join(cat["implementation_system"], "implementation_id", "left_anti"))
    return _warn(df, "IMPL_UNTARGETED", F.col("implementation_id"), None, "implementation targets neither a chip nor a system")


def impl_machines_without_system(cat):
    claims = cat["implementation_machine"].groupBy("implementation_id").agg(F.count("*").alias("n"))
    df = (cat["implementation"].select("implementation_id").join(claims, "implementation_id")
          .join(cat["implementation_system"], "implementation_id", "left_anti"))
    return _warn(df, "IMPL_MACHINES_WITHOUT_SYSTEM", F.col("implementation_id"), F.col("n"),
                 "chip-level implementation claims machines but no system")


def system_no_chips(cat):
    df = cat["system"].join(cat["v_system_chip_effective"], "system_id", "left_anti")
    return _warn(df, "SYSTEM_NO_CHIPS", F.col("system_id"), None, "system has no curated and no observed chips")


def system_unmapped_share_high(cat):
    df = cat["v_system_instance"].filter(F.col("unmapped_share") > _setting(cat, "system_unmapped_share.warn_above"))
    return _warn(df, "SYSTEM_UNMAPPED_SHARE_HIGH", F.col("system_id"), round4(F.col("unmapped_share")),
                 "system unmapped device-instance share is above the warn threshold")


def machine_zero_mapped_chips(cat):
    """A machine's BOM is empty when it has no chip of its own and its family has no curated chip,
    so the (large) effective BOM need not be built to find it."""
    families = cat["system_chip"].select("system_id").distinct()
    bare = cat["v_machine_system"].join(families, "system_id", "left_anti").select("machine_id")
    bare = bare.join(cat["machine_chip"].select("machine_id"), "machine_id", "left_anti")
    unmapped = cat["machine_unmapped_device"].groupBy("machine_id").agg(F.sum("quantity").alias("n"))
    df = bare.join(unmapped, "machine_id", "left")
    return _warn(df, "MACHINE_ZERO_MAPPED_CHIPS", F.col("machine_id"), F.coalesce("n", F.lit(0)),
                 "machine has no mapped chips in its effective BOM")


def equivalence_mutual_provides(cat):
    edge = cat["chip_equivalence"].filter(F.col("kind") == "provides").select("from_chip_id", "to_chip_id")
    back = edge.select(F.col("to_chip_id").alias("from_chip_id"), F.col("from_chip_id").alias("to_chip_id"))
    df = edge.filter("from_chip_id < to_chip_id").join(back, ["from_chip_id", "to_chip_id"], "left_semi")
    return _warn(df, "EQUIVALENCE_MUTUAL_PROVIDES", F.concat_ws(" -> ", "from_chip_id", "to_chip_id"), None,
                 "mutual provides edge should be a single equivalent edge")


def _name_collision(owners, names, key, label):
    taken = names.select(F.col("name").alias("taken"), F.col(key).alias("holder"))
    return owners.select(key, F.col(label).alias("taken")).join(taken, "taken").filter(
        F.col("holder") != F.col(key)).select(key).distinct()


def chip_name_collision(cat):
    df = _name_collision(cat["chip"], cat["chip_name"], "chip_id", "display_name")
    return _warn(df, "CHIP_NAME_COLLISION", F.col("chip_id"), None, "chip display_name is another chip's alias or retired id")


def system_name_collision(cat):
    df = _name_collision(cat["system"], cat["system_name"], "system_id", "name")
    return _warn(df, "SYSTEM_NAME_COLLISION", F.col("system_id"), None, "system name is another system's alias or retired id")


def chip_manufacturer_family_mismatch(cat):
    family = cat["chip_family"].select("family_id", F.col("manufacturer_id").alias("family_maker"))
    df = cat["chip"].join(family, "family_id").filter(F.col("manufacturer_id") != F.col("family_maker"))
    return _warn(df, "CHIP_MANUFACTURER_FAMILY_MISMATCH", F.col("chip_id"), None,
                 "chip manufacturer differs from its family's manufacturer")


BRANCHES = {
    "MAPPED_INSTANCE_SHARE_LOW": mapped_instance_share_low,
    "UNMAPPED_DEVICE_HIGH_IMPACT": unmapped_device_high_impact,
    "CHIP_MISSING_METADATA": chip_missing_metadata,
    "IMPL_UNVERIFIED_LICENSE": impl_unverified_license,
    "IMPL_UNVERIFIED_ACCURACY": impl_unverified_accuracy,
    "IMPL_STALE_REVIEW": impl_stale_review,
    "IMPL_UNTARGETED": impl_untargeted,
    "IMPL_MACHINES_WITHOUT_SYSTEM": impl_machines_without_system,
    "SYSTEM_NO_CHIPS": system_no_chips,
    "SYSTEM_UNMAPPED_SHARE_HIGH": system_unmapped_share_high,
    "MACHINE_ZERO_MAPPED_CHIPS": machine_zero_mapped_chips,
    "EQUIVALENCE_MUTUAL_PROVIDES": equivalence_mutual_provides,
    "CHIP_NAME_COLLISION": chip_name_collision,
    "SYSTEM_NAME_COLLISION": system_name_collision,
    "CHIP_MANUFACTURER_FAMILY_MISMATCH": chip_manufacturer_family_mismatch,
}


@view("v_quality_warning")
def quality_warning(cat) -> DataFrame:
    out = None
    for branch in BRANCHES.values():
        out = branch(cat) if out is None else out.unionByName(branch(cat))
    return out
