"""From a raw machine listing to catalogue rows.

Inputs are flat relations (`refs`, `chips`: one row per element with its document
position); `flatten_listing` produces them from nested records.  Every fold is a
partially aggregated groupBy, so a machine or device holding a large share of all rows
is combined map-side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bomscope.catalog import DRIVER_STATUS, TABLES, conform

DROP_REASONS = ("device", "mechanical", "clone", "bios", "excluded_driver")
MAX_SAFE_CLOCK = 9007199254740991  # fixed value: largest exact integer of a double


# -- EXT2 ---------------------------------------------------------------------------

def yes_flag(col: Column) -> Column:
    return F.when(col == "yes", 1).otherwise(0)


def usable_clock(col: Column) -> Column:
    """Positive plain integer up to the exact-double limit, else NULL."""
    value = F.when(F.btrim(col, F.lit("0123456789")) == "", col).try_cast("bigint")  # nothing but digits; a pattern costs several times as much
    return F.when(value.between(1, MAX_SAFE_CLOCK), value)


def parse_flags_clock(listing: DataFrame) -> DataFrame:
    """Raw attribute text to typed machine columns."""
    return listing.select(
        "machine_id", "name", "mame_sourcefile", "mame_year", "mame_manufacturer",
        F.when(F.col("driver_status_raw").isin(*DRIVER_STATUS), F.col("driver_status_raw")).alias("driver_status"),
        yes_flag(F.col("isbios")).alias("is_bios"),
        yes_flag(F.col("isdevice")).alias("is_device"),
        yes_flag(F.col("ismechanical")).alias("is_mechanical"),
        F.when(F.col("runnable_raw") == "no", 0).otherwise(1).alias("runnable"),
        "cloneof", "romof")


# -- EXT1, EXT3 ---------------------------------------------------------------------

def flatten_listing(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested `device_refs` / `chips` arrays to flat (machine_id, tag, ..., pos) rows."""
    refs = listing.select("machine_id", F.posexplode("device_refs").alias("pos", "r")).select(
        "machine_id", F.col("r.tag").alias("tag"), F.col("r.name").alias("device"), F.col("pos").cast("long").alias("pos"))
    chips = listing.select("machine_id", F.posexplode("chips").alias("pos", "c")).select(
        "machine_id", F.col("c.tag").alias("tag"), F.col("c.type").alias("type"),
        F.col("c.name").alias("name"), F.col("c.clock").alias("clock"), F.col("pos").cast("long").alias("pos"))
    return refs, chips


def _bare_tag(tag: Column) -> Column:
    tag = F.coalesce(tag, F.lit(""))
    return F.when(F.startswith(tag, F.lit(":")), F.substring(tag, 2, 1 << 30)).otherwise(tag)


def _sockets(refs: DataFrame, chips: DataFrame) -> DataFrame:
    """One aggregate per (machine, tag) over both element kinds: a union and one shuffle, no join."""
    none = F.lit(None)
    left = refs.select("machine_id", _bare_tag(F.col("tag")).alias("mame_tag"), "pos", "device",
                       none.cast("string").alias("type"), none.cast("string").alias("name"),
                       none.cast("long").alias("clock_hz"), F.lit(0).alias("is_chip"))
    right = chips.select("machine_id", _bare_tag(F.col("tag")).alias("mame_tag"), "pos",
                         none.cast("string").alias("device"), "type", "name",
                         usable_clock(F.col("clock")).alias("clock_hz"), F.lit(1).alias("is_chip"))
    return left.unionByName(right)


def join_device_chip(refs: DataFrame, chips: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Devices with what the chip elements of the same tag add; of the machines of `kept` only, where it is given.

    Last reference of a tag wins; chip types form a set; first name and first usable clock
    win; a chip element without a reference contributes nothing.
    """
    tagged = _sockets(refs, chips).filter(
        (F.col("mame_tag") != "") & ((F.col("is_chip") == 1) | F.col("device").isNotNull()))
    if kept is not None:  # before the fold, which then needs no shuffle of its own; ids are never held by one task
        tagged = tagged.join(kept.select("machine_id").hint("merge"), "machine_id", "left_semi")
    types = F.array_sort(F.collect_set("type"))
    return (
        tagged.groupBy("machine_id", "mame_tag").agg(
            F.expr("max_by(device, pos) FILTER (WHERE device IS NOT NULL)").alias("mame_device"),
            F.when(F.size(types) > 0, types).alias("chip_types"),
            F.expr("min_by(name, pos) FILTER (WHERE name IS NOT NULL)").alias("chip_name"),
            F.expr("min_by(clock_hz, pos) FILTER (WHERE clock_hz IS NOT NULL)").alias("clock_hz"))
        .filter(F.col("mame_device").isNotNull()))


def parse_stats(machines: DataFrame, refs: DataFrame, chips: DataFrame) -> DataFrame:
    """One row of counters that make an odd release visible."""
    per_tag = _sockets(refs, chips).groupBy("machine_id", "mame_tag").agg(
        F.count_if(F.col("is_chip") == 1).alias("chips"),
        F.count_if(F.col("is_chip") == 0).alias("refs"),
        F.count_if((F.col("is_chip") == 0) & F.col("device").isNull()).alias("nameless_refs"),
        F.count_if((F.col("is_chip") == 1) & F.col("clock_hz").isNull()).alias("bad_clock"))
    tagged = F.col("mame_tag") != ""
    zero = F.lit(0).cast("long")
    from_tags = per_tag.agg(
        zero.alias("machines"), F.sum("chips").alias("chips"), F.sum("refs").alias("device_refs"),
        F.count_if(tagged & (F.col("chips") > 0) & (F.col("refs") == F.col("nameless_refs")))
        .alias("chips_without_device_ref"),
        F.sum(F.when(tagged, F.col("bad_clock"))).alias("chips_without_usable_clock"),
        F.sum(F.when(tagged, F.col("nameless_refs")).otherwise(F.col("refs") + F.col("chips")))
        .alias("untagged_references"))
    from_machines = machines.agg(F.count("*").alias("machines"))
    return from_tags.unionByName(from_machines, allowMissingColumns=True).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in from_tags.columns])


# -- EXT4 - EXT7 --------------------------------------------------------------------

def rules_frame(spark, exclude, keep) -> DataFrame:
    rows = [("exclude", p, r) for p, r in exclude] + [("keep", p, r) for p, r in keep]
    return spark.createDataFrame(rows, "list string, pattern string, reason string")


def match_sourcefile_rules(machines: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching keep and exclude rule (bytewise pattern order) per source file.

    A pattern ending in '/' is a prefix, anything else an exact path.  Each distinct path
    is expanded to the patterns that could match it (itself and its directories), so the
    match is an equality join and not a scan of every rule for every path.
    """
    parts = F.split("mame_sourcefile", "/")
    folders = F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))
    exact = F.when(~F.endswith("mame_sourcefile", F.lit("/")), F.array("mame_sourcefile")).otherwise(
        F.array().cast("array<string>"))
    candidates = machines.select("mame_sourcefile").distinct().select(
        "mame_sourcefile", F.explode(F.concat(exact, folders)).alias("pattern"))
    return candidates.join(rules, "pattern").groupBy("mame_sourcefile").agg(
        F.expr("min(pattern) FILTER (WHERE list = 'keep')").alias("keep_rule"),
        F.expr("min(pattern) FILTER (WHERE list = 'exclude')").alias("exclude_rule"))


def classify_drop(machines: DataFrame, rules: DataFrame, *, drop_devices=True, drop_mechanical=True,
                  parents_only=True, drop_bios=True) -> DataFrame:
    """Adds `drop_reason` (NULL = kept), `rule` that excluded, and `keep_rule` of a kept machine."""
    matched = match_sourcefile_rules(machines, rules)
    df = machines.join(matched, "mame_sourcefile", "left")
    switch = F.lit
    reason = (
        F.when(switch(drop_devices) & (F.col("is_device") == 1), "device")
        .when(switch(drop_mechanical) & (F.col("is_mechanical") == 1), "mechanical")
        .when(switch(parents_only) & F.col("cloneof").isNotNull(), "clone")
        .when(switch(drop_bios) & (F.col("is_bios") == 1), "bios")
        .when(F.col("keep_rule").isNull() & F.col("exclude_rule").isNotNull(), "excluded_driver"))
    df = df.withColumn("drop_reason", reason)
    return df.select(
        *machines.columns, "drop_reason",
        F.when(F.col("drop_reason") == "excluded_driver", F.col("exclude_rule")).alias("rule"),
        F.when(F.col("drop_reason").isNull(), F.col("keep_rule")).alias("keep_rule"))


def clone_count(kept: DataFrame, all_machines: DataFrame) -> DataFrame:
    """Clones listed under each kept parent, counted over every input machine; NULL when none."""
    clones = (all_machines.filter(F.col("cloneof").isNotNull())
              .groupBy(F.col("cloneof").alias("machine_id")).agg(F.count("*").alias("clone_count")))
    return kept.join(clones, "machine_id", "left")


def filter_stats(decided: DataFrame, rules: DataFrame) -> DataFrame:
    """Long-form run statistics: (section, name, value); dropped reasons appear with zeros."""
    spark = decided.sparkSession
    tally = decided.groupBy("drop_reason", "rule", "keep_rule").agg(F.count("*").alias("n"))
    zeros = spark.createDataFrame(
        [("total", "", 0), ("kept", "", 0)] + [("dropped", r, 0) for r in DROP_REASONS],
        "section string, name string, value long")
    is_kept = F.col("drop_reason").isNull()
    counts = tally.select(F.explode(F.array(
        F.struct(F.lit("total").alias("section"), F.lit("").alias("name"), F.col("n").alias("value")),
        F.struct(F.when(is_kept, "kept").otherwise("dropped").alias("section"),
                 F.coalesce("drop_reason", F.lit("")).alias("name"), F.col("n").alias("value")),
        F.struct(F.when(F.col("rule").isNotNull(), "excluded_by_rule").alias("section"),
                 F.col("rule").alias("name"), F.col("n").alias("value")))).alias("s")).select("s.*")
    summed = (zeros.unionByName(counts.filter(F.col("section").isNotNull()))
              .groupBy("section", "name").agg(F.sum("value").alias("value")))
    used = tally.select(F.explode(F.array(
        F.struct(F.lit("exclude").alias("list"), F.col("rule").alias("pattern")),
        F.struct(F.lit("keep").alias("list"), F.col("keep_rule").alias("pattern")))).alias("u")).select("u.*").distinct()
    unused = rules.join(used, ["list", "pattern"], "left_anti").select(
        F.concat(F.lit("unused_"), "list", F.lit("_rule")).alias("section"),
        F.col("pattern").alias("name"), F.lit(0).cast("long").alias("value"))
    return summed.unionByName(unused)


# -- EXT8 ---------------------------------------------------------------------------

def device_worklist_raw(devices: DataFrame, sample_size: int = 5) -> DataFrame:
    """Per device: instances, machines, sorted distinct types and names, first machine ids."""
    def sorted_or_null(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.array_sort(values))

    facts = devices.groupBy("mame_device").agg(
        F.count("*").alias("instance_count"),
        F.count_distinct("machine_id").alias("machine_count"),
        sorted_or_null(F.array_distinct(F.flatten(F.collect_set("chip_types")))).alias("chip_types"),
        sorted_or_null(F.collect_set("chip_name")).alias("chip_names"))
    first = W.partitionBy("mame_device").orderBy("machine_id")
    # The rank filter is pushed below the shuffle as a per-partition group limit, so a
    # device present on a third of all machines ships at most `sample_size` ids per task.
    samples = (devices.select("mame_device", "machine_id").distinct()
               .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample_size)
               .groupBy("mame_device").agg(F.array_sort(F.collect_list("machine_id")).alias("sample_machine_ids")))
    return facts.join(samples, "mame_device")


# -- EXT9, EXT10 --------------------------------------------------------------------

def route_devices(devices: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(machine_chip, machine_unmapped_device): mapped, ignored (dropped) or absent from the dictionary."""
    keyed = dictionary.select("mame_device", "chip_id", F.lit(1).alias("listed"))
    routed = devices.select("machine_id", "mame_tag", "mame_device", "clock_hz").join(keyed, "mame_device", "left")
    chips = routed.filter(F.col("chip_id").isNotNull()).select(
        "machine_id", "mame_tag", "chip_id", "clock_hz", F.lit(1).cast("long").alias("quantity"))
    unmapped = (routed.filter(F.col("listed").isNull())
                .groupBy("machine_id", "mame_device").agg(F.count("*").alias("quantity")))
    return chips, unmapped


def emit_machine_rows(kept: DataFrame, devices: DataFrame, dictionary: DataFrame, version: str) -> dict[str, DataFrame]:
    """The four generated tables, projected onto their declared columns."""
    chips, unmapped = route_devices(devices, dictionary)
    meta = kept.sparkSession.createDataFrame([("mame_version", version)], "key string, value string")
    made = {"machine": kept, "machine_chip": chips, "machine_unmapped_device": unmapped, "dataset_meta": meta}
    return {name: conform(df, TABLES[name]) for name, df in made.items()}


# -- EXT11, EXT12 -------------------------------------------------------------------

def first_broken_rule(table: str, skip: tuple[str, ...] = ()) -> Column:
    """Name of the first violated column rule or row check, NULL when the row is acceptable."""
    spec = TABLES[table]
    rules = [F.when(~c.holds(), F.lit(f"{c.name}: {c.kind}")) for c in spec.columns if c.name not in skip]
    rules += [F.when(~F.expr(sql), F.lit(name)) for name, sql in spec.checks]
    return F.coalesce(*rules)


def _judged(rows: DataFrame, bad: Column, keys: list[str], place: Column, again: str) -> DataFrame:
    """Adds `_bad`: the broken rule, or `again` where an earlier row that breaks no rule holds the same key.

    The first place of each key that several good rows share is one partially aggregated fold, so a key that very
    many rows repeat is combined before the shuffle; only such keys are joined back.
    """
    ruled = rows.withColumn("_bad", bad).withColumn("_place", place)
    shared = (ruled.filter("_bad IS NULL").groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
              .filter("_n > 1").select(*keys, "_first"))
    return ruled.join(shared, keys, "left").withColumn(
        "_bad", F.coalesce("_bad", F.when(F.col("_place") > F.col("_first"), F.lit(again)))).drop("_first", "_place")


def verify_constraints(machines: DataFrame, devices: DataFrame) -> DataFrame:
    """Every refused row: (table, machine_id, detail). Rows are tried in the order of the listing.

    `machines` and `devices` carry `record`, the place of the machine's record; `devices` also `pos`, the place
    within it; places differ. Of rows with one key the first that breaks no rule is taken and every later one
    refused. Device rows of a refused record are not tested. A socket is tested without its chip (mapping comes
    later), so its key is machine and tag; an unmapped candidate is tested once per (machine, device).
    """
    judged = _judged(machines, first_broken_rule("machine"), ["machine_id"], F.col("record"), "machine_id: repeated key")
    bad_machines = judged.filter(F.col("_bad").isNotNull()).select(
        F.lit("machine").alias("table"), "machine_id", F.col("_bad").alias("detail"))
    taken = judged.filter(F.col("_bad").isNull()).select("machine_id", "record")
    tested = devices.join(taken, ["machine_id", "record"], "left_semi")
    sockets = _judged(tested.withColumn("quantity", F.lit(1)), first_broken_rule("machine_chip", ("chip_id",)),
                      ["machine_id", "mame_tag"], F.struct("record", "pos"), "mame_tag: repeated key")
    bad_sockets = sockets.filter(F.col("_bad").isNotNull()).select(
        F.lit("machine_chip").alias("table"), "machine_id",
        F.concat_ws(" -> ", "mame_tag", "_bad").alias("detail"))
    pairs = (tested.groupBy("machine_id", "mame_device").agg(F.count("*").alias("quantity"))
             .withColumn("_bad", first_broken_rule("machine_unmapped_device")))
    bad_pairs = pairs.filter(F.col("_bad").isNotNull()).select(
        F.lit("machine_unmapped_device").alias("table"), "machine_id",
        F.concat_ws(" -> ", "mame_device", "_bad").alias("detail"))
    return bad_machines.unionByName(bad_sockets).unionByName(bad_pairs)


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("table").agg(F.count("*").alias("violations"))


def classify_violations(violations: DataFrame, known: DataFrame) -> DataFrame:
    """(status, table, machine_id, detail, reason): known, unexpected, or known entries that did not occur.

    `known` has (key = 'table/machine_id', reason).  All violations are listed; whoever prints them limits them.
    """
    detail = violations.withColumn("key", F.concat_ws("/", "table", "machine_id"))
    listed = known.select("key", "reason")
    found = detail.join(listed, "key", "left").select(
        F.when(F.col("reason").isNotNull(), "known").otherwise("unexpected").alias("status"),
        "table", "machine_id", "detail", "reason")
    unused = listed.join(detail, "key", "left_anti").select(
        F.lit("unused_known").alias("status"), F.split_part("key", F.lit("/"), F.lit(1)).alias("table"),
        F.split_part("key", F.lit("/"), F.lit(2)).alias("machine_id"), F.lit(None).cast("string").alias("detail"), "reason")
    return found.unionByName(unused)


# -- EXT13 --------------------------------------------------------------------------

def release_diff(old_machines: DataFrame, new_machines: DataFrame,
                 old_devices: DataFrame, new_devices: DataFrame) -> DataFrame:
    """Snapshot difference in long form: (section, id, name, instance_count, machine_count)."""
    none = F.lit(None)

    def machines(section, df, other):
        return df.join(other.select("machine_id"), "machine_id", "left_anti").select(
            F.lit(section).alias("section"), F.col("machine_id").alias("id"), "name",
            none.cast("long").alias("instance_count"), none.cast("long").alias("machine_count"))

    def count(section, df):
        return df.agg(F.count("*").alias("machine_count")).select(
            F.lit(section).alias("section"), none.cast("string").alias("id"), none.cast("string").alias("name"),
            none.cast("long").alias("instance_count"), "machine_count")

    fresh = new_devices.join(old_devices.select("mame_device"), "mame_device", "left_anti").select(
        F.lit("new_device").alias("section"), F.col("mame_device").alias("id"), none.cast("string").alias("name"),
        "instance_count", "machine_count")
    return (machines("added", new_machines, old_machines)
            .unionByName(machines("removed", old_machines, new_machines))
            .unionByName(count("count_before", old_machines)).unionByName(count("count_after", new_machines))
            .unionByName(fresh))
