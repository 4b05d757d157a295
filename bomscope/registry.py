"""Named queries over a bound catalogue: one per operator, each over the whole tables.

Nested results are flattened (exploded or joined to text) so they can be compared row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomscope.binding import CURATED_SQL
from bomscope.catalog import TABLES, Catalog
from bomscope.functions import parts, source_text
from bomscope.operators import closure, extraction, gates, validation
from bomscope.plans import browse, canonical, guard, prospect, reconcile, search, views, warnings
from bomscope.session import shared_dir, written
from bomscope.sources import bundles, listing, sinks

QUERIES: dict = {}


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn

    return wrap


def _scratch(cat) -> str:
    return f"{shared_dir(cat.spark)}/io-{uuid.uuid4().hex}"


def _joined(col: str):
    return F.array_join(F.col(col), ",").alias(col)


# -- sources and sinks ----------------------------------------------------------------

def _bundle_folder(cat) -> str:
    """The bound chips as row bundles, one per line: {"chip": [row], "chip_name": [rows]}."""
    path = _scratch(cat)
    names = cat["chip_name"].groupBy("chip_id").agg(F.array_sort(F.collect_list(F.struct("name", "chip_id", "kind"))).alias("chip_name"))
    chip = cat["chip"].select("chip_id", F.array(F.struct(*TABLES["chip"].names)).alias("chip"))
    curated = cat["system_chip"].select(F.array(F.struct("system_id", "role_id", "chip_id", "clock_hz", "note")).alias("system_chip"))
    chip.join(names, "chip_id", "left").select("chip", "chip_name").unionByName(curated, allowMissingColumns=True).write.json(path)
    return path


@query("src1_read_row_bundles")
def src1(cat):
    read = bundles.read_row_bundles(cat.spark, _bundle_folder(cat), ["chip", "chip_name"], lines=True)
    return (read["chip"].select(F.lit("chip").alias("table"), "chip_id", F.col("display_name").alias("name"), "typical_clock_hz")
            .unionByName(read["chip_name"].select(F.lit("chip_name").alias("table"), "chip_id", "name", F.lit(None).cast("long").alias("typical_clock_hz"))))


@query("src1_rejected_cells")
def src1_rejects(cat):
    """Bundles with an unknown table, an unknown column, a null and a nested cell for every system."""
    path = _scratch(cat)
    row = F.struct("system_id", F.lit(None).cast("string").alias("name"), F.lit(1).alias("colour"), F.struct(F.lit(1).alias("a")).alias("notes"))
    doc = cat["system"].select(F.array(row).alias("system"), F.array().cast("array<int>").alias("weather"), F.lit(3).alias("chip"))
    doc.write.option("ignoreNullFields", False).json(path)
    return bundles.rejected_cells(cat.spark, path, lines=True).groupBy("table", "column", "problem").agg(F.count("*").alias("cells"))


def _nested_listing(cat) -> DataFrame:
    """Raw listing as nested records. A record's list is one machine's elements."""
    refs = cat["listing_ref"].groupBy("machine_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", F.col("device").alias("name")))).alias("device_refs"))
    chips = cat["listing_chip"].groupBy("machine_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "tag", "name", "clock"))).alias("chips"))
    return (cat["listing_machine"].join(refs, "machine_id", "left").join(chips, "machine_id", "left")
            .withColumn("device_refs", F.transform("device_refs", lambda r: F.struct(r["tag"].alias("tag"), r["name"].alias("name"))))
            .withColumn("chips", F.transform("chips", lambda c: F.struct(c["type"].alias("type"), c["tag"].alias("tag"), c["name"].alias("name"), c["clock"].alias("clock")))))


@query("src2_read_machine_listing")
def src2(cat):
    """The listing written as XML, read back, flattened and folded."""
    path = _scratch(cat)
    listing.write_machine_listing(_nested_listing(cat), path)
    back = listing.read_machine_listing(cat.spark, path)
    devices = extraction.join_device_chip(*extraction.flatten_listing(back))
    return devices.join(back.select("machine_id", "mame_sourcefile", "isbios"), "machine_id").select(
        "machine_id", "mame_sourcefile", "isbios", "mame_tag", "mame_device", _joined("chip_types"), "chip_name", "clock_hz")


@query("src3_read_raw_extract")
def src3(cat):
    """Kept machines written as extract documents, one per line, and read back."""
    path = _scratch(cat)
    row = F.struct("machine_id", "name", "clone_count")
    doc = F.struct(F.lit("0.288").alias("mame_version"), F.array(row).alias("machines"))
    cat["machine"].select(F.to_json(doc).alias("value")).write.text(path)
    return bundles.read_raw_extract(cat.spark, path, "machines", "struct<machine_id:string,name:string,clone_count:bigint>", lines=True)[1]


@query("src4_load_lookup_defaults")
def src4(cat):
    rows = bundles.read_row_bundles(cat.spark, _bundle_folder(cat), ["system_chip"], lines=True)["system_chip"]
    return bundles.load_lookup_defaults(rows, "system_chip").select("system_id", "role_id", "chip_id", "quantity")


@query("src6_document_lines")
def src6(cat):
    lines = parts.lines_of(cat["documents"])
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("content")).cast("long").alias("longest"))


@query("snk1_publish_catalog")
def snk1(cat):
    """Publish the catalogue with its known defects taken out; count what was published."""
    stale = gates.stale_correction(cat).select(*gates.SOCKET)
    clash = gates.retired_id_collision(cat).select("name")
    meta = cat["dataset_meta"].unionByName(cat.spark.createDataFrame([("schema_version", "1")], "key string, value string"))
    bad_tags = gates.unique_check(cat, ["machine_chip_correction"]).select("key").distinct()
    fixes = (cat["machine_chip_correction"].join(stale, gates.SOCKET, "left_anti")
             .withColumn("key", F.concat_ws("|", "machine_id", "mame_tag")).join(bad_tags, "key", "left_anti").drop("key"))
    dangling = gates.foreign_key_check(cat, ["machine_chip_correction"]).filter("column = 'chip_id'").select(F.col("value").alias("chip_id"))
    fixed = cat.with_tables(chip_name=cat["chip_name"].join(clash, "name", "left_anti"), dataset_meta=meta,
                            machine_chip_correction=fixes.join(dangling, "chip_id", "left_anti"))
    out = sinks.publish_catalog(fixed, _scratch(cat) + "/catalog")
    parts_ = [out[t].agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows") for t in TABLES]
    df = parts_[0]
    for p in parts_[1:]:
        df = df.unionByName(p)
    return df


@query("snk2_write_quality_report")
def snk2(cat):
    path = _scratch(cat)
    sinks.write_quality_report(canonical.quality_report(cat), path)
    schema = "counts map<string,long>, devices map<string,long>, instances map<string,double>, warnings_by_code map<string,long>"
    back = cat.spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")
    return back.select(F.explode(F.map_concat("counts", "devices", "warnings_by_code")).alias("name", "value"))


@query("snk3_write_reconciliation")
def snk3(cat):
    path = _scratch(cat)
    collapsed, findings = _reconciled(cat)
    sinks.write_reconciliation(reconcile.merge_witnesses(collapsed), findings, path)
    part = "key:string,designation:string,chip_id:string,mame_state:string,source_url:string,evidence:string,machine_count:bigint"
    return _flat_records(cat.spark.read.schema(f"system_id string, witnesses array<struct<witness:string,position:int,after:int,parts:array<struct<{part}>>>>").json(path + "/records"))


@query("snk4_write_row_tables")
def snk4(cat):
    path = _scratch(cat)
    made = ("machine", "machine_chip", "machine_unmapped_device", "dataset_meta")
    sinks.write_row_tables({t: cat[t] for t in made}, path)
    back = {t: cat.spark.read.schema(TABLES[t].schema).json(f"{path}/{t}") for t in made}
    out = None
    for t in made:
        row = back[t].agg(F.count("*").alias("rows"), F.count_distinct(*TABLES[t].key).alias("keys")).select(F.lit(t).alias("table"), "rows", "keys")
        out = row if out is None else out.unionByName(row)
    return out


# -- extraction -------------------------------------------------------------------------

@query("ext1_join_device_chip")
def ext1(cat):
    return extraction.join_device_chip(cat["listing_ref"], cat["listing_chip"]).select(
        "machine_id", "mame_tag", "mame_device", _joined("chip_types"), "chip_name", "clock_hz")


QUERIES["ext2_parse_flags_clock"] = lambda cat: extraction.parse_flags_clock(cat["listing_machine"])
QUERIES["ext3_parse_stats"] = lambda cat: extraction.parse_stats(cat["listing_machine"], cat["listing_ref"], cat["listing_chip"])
QUERIES["ext4_classify_drop"] = lambda cat: extraction.classify_drop(cat["parsed"], cat["rules"]).select("machine_id", "drop_reason", "rule", "keep_rule")
QUERIES["ext5_match_sourcefile_rules"] = lambda cat: extraction.match_sourcefile_rules(cat["parsed"], cat["rules"])
QUERIES["ext6_clone_count"] = lambda cat: extraction.clone_count(cat["decided"].filter("drop_reason IS NULL"), cat["parsed"]).select("machine_id", "clone_count")
QUERIES["ext7_filter_stats"] = lambda cat: extraction.filter_stats(cat["decided"], cat["rules"])


@query("ext8_device_worklist_raw")
def ext8(cat):
    return extraction.device_worklist_raw(cat["kept_devices"]).select(
        "mame_device", "instance_count", "machine_count", _joined("chip_types"), _joined("chip_names"), _joined("sample_machine_ids"))


@query("ext9_route_devices")
def ext9(cat):
    chips, unmapped = extraction.route_devices(cat["kept_devices"], cat["mame_device"])
    return chips.select(F.lit("mapped").alias("route"), "machine_id", F.col("mame_tag").alias("at"), "chip_id", "clock_hz", "quantity").unionByName(
        unmapped.select(F.lit("unmapped").alias("route"), "machine_id", F.col("mame_device").alias("at"), F.lit(None).cast("string").alias("chip_id"),
                        F.lit(None).cast("long").alias("clock_hz"), "quantity"))


QUERIES["ext10_emit_machine_rows"] = lambda cat: extraction.emit_machine_rows(cat["kept"], cat["kept_devices"], cat["mame_device"], "0.288")["machine"]


def _suspect(cat):
    """Kept machines and devices with defects a bad release could carry, assigned by rule to all rows.

    Some machines come twice, the second record without the defects but with bad tags; some tags come twice in a record.
    """
    twice = F.col("machine_id").endswith("7")
    spoiled = cat["kept"].withColumn("mame_year", F.when(F.col("mame_year") == "1997", F.lit(" ")).otherwise(F.col("mame_year"))).withColumn(
        "mame_sourcefile", F.when(F.startswith("mame_sourcefile", F.lit("building/n1")), F.upper("mame_sourcefile")).otherwise(F.col("mame_sourcefile")))
    machines = spoiled.withColumn("record", F.lit(1)).unionByName(cat["kept"].filter(twice).withColumn("record", F.lit(2)))
    listed = cat["kept_devices"].withColumn("mame_tag", F.when(F.col("mame_device").endswith("77"), F.concat("mame_tag", F.lit("..x"))).otherwise(F.col("mame_tag"))
                                            ).withColumn("pos", F.explode(F.sequence(F.lit(1), F.when(F.col("mame_device").endswith("66"), 2).otherwise(1)))
                                                         ).withColumn("mame_device", F.when(F.col("mame_device").endswith("88"), F.concat("mame_device", F.lit("-b"))).otherwise(F.col("mame_device")))
    more = cat["kept_devices"].filter(twice).withColumn("mame_tag", F.concat("mame_tag", F.lit("..y"))).withColumn("pos", F.lit(1))
    return machines, listed.withColumn("record", F.lit(1)).unionByName(more.withColumn("record", F.lit(2)))


QUERIES["ext11_verify_constraints"] = lambda cat: extraction.verify_constraints(*_suspect(cat))
QUERIES["ext11_violation_counts"] = lambda cat: extraction.violation_counts(extraction.verify_constraints(*_suspect(cat)))


@query("ext12_classify_violations")
def ext12(cat):
    found = extraction.verify_constraints(*_suspect(cat))
    known = cat["machine"].filter("driver_status = 'good'").select(F.concat(F.lit("machine/"), "machine_id").alias("key"), F.lit("accepted").alias("reason"))
    return extraction.classify_violations(found, known).groupBy("status", "table").agg(F.count("*").alias("rows"))


def _release(cat, keep):
    machines = cat["machine"].join(cat["orders"].filter(keep).select(F.concat(F.lit("o"), "o_orderkey").alias("machine_id")), "machine_id", "left_semi")
    devices = cat["kept_devices"].join(machines.select("machine_id"), "machine_id", "left_semi")
    return machines, extraction.device_worklist_raw(devices)


@query("ext13_release_diff")
def ext13(cat):
    """Two releases: machines dated before 2000, and machines dated from 1996 on."""
    old_m, old_d = _release(cat, "o_orderdate < '2000-01-01'")
    new_m, new_d = _release(cat, "o_orderdate >= '1996-01-01'")
    return extraction.release_diff(old_m, new_m, old_d, new_d)


# -- views ------------------------------------------------------------------------------

for _i, _v in enumerate(("v_machine_system", "v_machine", "v_machine_bom", "v_chip_satisfies", "v_chip_implementation_count", "v_system_chip_effective",
                         "v_system_unmapped", "v_system_core", "v_mame_device_worklist", "v_chip_satisfied", "v_chip_evidence", "v_system_chip_coverage",
                         "v_system_coverage_by_kind", "v_prospector", "v_chip_gap", "v_quality_instance", "v_quality_device", "v_machine_instance",
                         "v_system_instance", "v_quality_completeness", "v_quality_warning"), 1):
    QUERIES[f"v{_i}_{_v[2:]}"] = lambda cat, v=_v: cat[v]
for _code, _branch in warnings.BRANCHES.items():
    QUERIES[f"v21_{_code.lower()}"] = lambda cat, b=_branch: b(cat)

# -- canonical reads ----------------------------------------------------------------------

QUERIES["q1_system_bom_counts"] = lambda cat: canonical.system_bom_counts(cat)
QUERIES["q2_prospector_simple"] = lambda cat: canonical.prospector_simple(cat, "asia")
QUERIES["q3_dependency_closure"] = lambda cat: canonical.dependency_closure(cat)
QUERIES["q3r_consumers_of"] = lambda cat: canonical.consumers_of(cat)
QUERIES["q4_chip_gap_ranked"] = lambda cat: canonical.chip_gap_ranked(cat)
QUERIES["q5_system_coverage"] = lambda cat: canonical.system_coverage(cat)
QUERIES["q5_system_coverage_explained"] = lambda cat: canonical.system_coverage_explained(cat)
QUERIES["q6_worklist_top"] = lambda cat: canonical.worklist_top(cat, 5, 2)
QUERIES["q7_warnings_by_code"] = lambda cat: canonical.warnings_by_code(cat)

# -- ranking ------------------------------------------------------------------------------

SCORE_COLUMNS = ("platform_id", "system_id", "system_name", "chips_total", "chips_satisfied", "unmapped_device_count", "confidence", "chip_weight",
                 "satisfied_weight", "total_weight", "readiness", "confidence_factor", "mate_system_id", "mate_shared_chips", "mate_factor",
                 "cpu_sound_applied", "cpu_sound_factor", "score")
QUERIES["rnk1_socket_detail"] = lambda cat: prospect.socket_detail(cat)
QUERIES["rnk2_socket_rollup"] = lambda cat: prospect.socket_rollup(cat)
QUERIES["rnk3_system_mates"] = lambda cat: prospect.system_mates(cat)
QUERIES["rnk4_best_mate"] = lambda cat: prospect.best_mate(cat)
QUERIES["rnk5_prospect_score"] = lambda cat: prospect.prospect_score(cat).select(*SCORE_COLUMNS)
QUERIES["rnk6_cpu_sound_bonus"] = lambda cat: prospect.socket_rollup(cat).select("system_id", "cpu_chips", "cpu_satisfied", "sound_chips", "sound_satisfied",
                                                                                 prospect.cpu_sound_complete().alias("applied"))
QUERIES["rnk7_prospect_rank"] = lambda cat: prospect.prospect_rank(cat).select("platform_id", "rank", "system_id", "score", "total_weight")
QUERIES["rnk8_missing_chips"] = lambda cat: prospect.missing_chips(cat)
QUERIES["rnk9_via_edge_chips"] = lambda cat: prospect.via_edge_chips(cat)
QUERIES["rnk10_cpu_sound_missing"] = lambda cat: prospect.cpu_sound_missing(cat)


@query("rnk11_prospect_breakdown")
def rnk11(cat):
    b = F.col("breakdown")
    return prospect.prospect_breakdown(cat).select(
        "platform_id", "rank", "system_id", "score", b["readiness"]["value"].alias("readiness"), b["readiness"]["unmapped_weight"].alias("unmapped_weight"),
        b["chips"]["by_band"]["hard"]["missing"].alias("hard_missing"), F.array_join(F.transform(b["chips"]["missing"], lambda x: x["chip_id"]), ",").alias("missing"),
        F.array_join(F.transform(b["chips"]["via_edge"], lambda x: x["chip_id"]), ",").alias("via_edge"),
        F.array_join(b["cpu_sound_complete"]["missing_chip_ids"], ",").alias("cpu_sound_missing"))


@query("rnk12_prospect_caveats")
def rnk12(cat):
    return prospect.prospect_caveats(cat).select("platform_id", "system_id", F.size("caveats").cast("long").alias("caveats"),
                                                 F.exists("caveats", lambda c: F.contains(c, F.lit("unmapped"))).cast("int").alias("unmapped"))


# -- corrections, gates, report -------------------------------------------------------------

QUERIES["cor1_apply_corrections"] = lambda cat: gates.apply_corrections(cat["machine_chip"], cat["machine_chip_correction"])
QUERIES["cor1_correction_counts"] = lambda cat: gates.correction_counts(cat["machine_chip"], cat["machine_chip_correction"])
QUERIES["gat1_stale_correction"] = gates.stale_correction
QUERIES["gat2_retired_id_collision"] = gates.retired_id_collision
QUERIES["gat3_stale_extract"] = lambda cat: gates.stale_extract(cat.with_tables(mame_device=_next_dictionary(cat)))


def _next_dictionary(cat):
    """The dictionary after curation listed devices of even keys that the extract still has as unmapped."""
    return cat["mame_device"].unionByName(
        cat["part"].filter("p_partkey % 40 = 38").select(F.concat(F.lit("d"), "p_partkey").alias("mame_device"), F.lit(None).cast("string").alias("chip_id"),
                                                         F.lit("reviewed").alias("ignore_reason"), F.lit(None).cast("string").alias("note")))


def _cyclic(cat):
    """Dependencies plus the edges back from every provider to its largest consumer divisible by five."""
    dep = cat["implementation_dependency"]
    key = F.substring("consumer_id", 2, 20).cast("long")
    back = dep.filter(key % 5 == 0).select(F.col("provider_id").alias("consumer_id"), F.col("consumer_id").alias("provider_id"), "note")
    return dep.unionByName(back)


QUERIES["gat4_dependency_cycle"] = lambda cat: gates.dependency_cycle(cat.with_tables(implementation_dependency=_cyclic(cat)))
QUERIES["gat4_dependency_acyclic"] = gates.dependency_cycle
QUERIES["gat6_foreign_key_check"] = lambda cat: gates.foreign_key_check(cat)
QUERIES["gat7_unique_check"] = lambda cat: gates.unique_check(cat)
QUERIES["gat7_check_constraint"] = lambda cat: gates.check_constraint(cat)


def _cyclic_edges(cat):
    """Every chip edge read as `provides`, plus edges closing loops of three."""
    edge = cat["chip_equivalence"].select("from_chip_id", "to_chip_id", F.lit("provides").alias("kind"), "note")
    loop = cat["part"].filter("p_partkey % 60 = 0").select(
        F.concat(F.lit("p"), "p_partkey").alias("a"), F.concat(F.lit("p"), F.col("p_partkey") + 8).alias("b"), F.concat(F.lit("p"), F.col("p_partkey") + 4).alias("c"))
    more = loop.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("e")).select(
        F.col("e.a").alias("from_chip_id"), F.col("e.b").alias("to_chip_id"), F.lit("provides").alias("kind"), F.lit("loop").alias("note"))
    return edge.unionByName(more)


QUERIES["gat8_provides_cycle"] = lambda cat: gates.provides_cycle(cat.with_tables(chip_equivalence=_cyclic_edges(cat)))
QUERIES["gat9_incomplete_equivalence"] = gates.incomplete_equivalence
QUERIES["gat9_incomplete_hubs"] = gates.incomplete_equivalence_hubs
QUERIES["gat10_cross_function_edge"] = gates.cross_function_edge
QUERIES["gat10_short_note"] = gates.short_note


@query("gat11_run_gates")
def gat11(cat):
    """All nine gates; what `run_gates` reports beside what each gate counts."""
    every = {**gates.PRE_CORRECTION, **gates.POST_CORRECTION}
    failed = cat.spark.createDataFrame([(f.code, f.rows) for f in gates.run_gates(cat, every)], "code string, reported long")
    counted = gates.gate_counts(cat, every)
    return counted.join(failed, "code", "left").select("code", "rows", F.coalesce("reported", F.lit(0).cast("long")).alias("reported"))


@query("gat12_rebuild_fingerprint")
def gat12(cat):
    """Rows per table, and whether a second build of the same inputs has the same digest."""
    again = gates.rebuild_fingerprint(cat.with_tables(**{t: cat[t].repartition(3) for t in TABLES}))
    again = again.select("table", F.col("digest").alias("other"))
    return gates.rebuild_fingerprint(cat).join(again, "table").select("table", "rows", (F.col("digest") == F.col("other")).alias("same"))


QUERIES["rep1_quality_report"] = canonical.quality_report_items

# -- reconciliation -------------------------------------------------------------------------

RECOGNITION = parts.Recognition(
    vendor_prefixes=("SMALL", "BLUE", "RED", "D"),
    grammars=(parts.Grammar("phone", "[0-9]{3}-[0-9]{4}", True), parts.Grammar("license", "licen[sc]e [a-z0-9.-]+")),
    context_pattern=r"\+1", part_aliases={"third bracket": "p4"}, ignored_parts=("LICENSETHE",), min_literal_length=3)
LISTING_URL = "https://example.org/listing"


def _benchmark_names(cat):
    """Catalogue names for the text corpus: every clause of every benchmark item, of one word or of many."""
    return cat["benchmark"].select(F.explode(F.split("text", "[.,\n]")).alias("form")).select(F.trim("form").alias("form")).filter("form <> ''").distinct()


@query("rec1_normalize_part")
def rec1(cat):
    return cat["part"].select("p_partkey", parts.normalize_part(F.concat(F.lit("µ"), "p_name", F.lit("-"), "p_brand")).alias("normalized"))


@query("rec2_strip_vendor")
def rec2(cat):
    return cat["part"].select("p_partkey", parts.normalize_without_vendor(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")), RECOGNITION).alias("normalized"))


@query("rec3_name_forms")
def rec3(cat):
    return cat["part"].select("p_partkey", F.explode(parts.name_forms(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))).alias("form"))


QUERIES["rec4_chip_index"] = lambda cat: parts.chip_index(cat, RECOGNITION)


@query("rec5_resolve_part")
def rec5(cat):
    asked = cat["part"].select("p_partkey", F.concat_ws("_", F.upper("p_name"), F.col("p_partkey").cast("string")).alias("designation"))
    return parts.resolve_part(asked, parts.chip_index(cat, RECOGNITION), RECOGNITION).select("p_partkey", "designation", "normalized", "chip_id", "key")


QUERIES["rec6_scan_parts"] = lambda cat: parts.scan_parts(cat["documents"], _benchmark_names(cat), RECOGNITION).select("doc_id", "line", "designation", "rule")


def _source_files(cat):
    """Driver source text derived from the catalogue: one file per source file, comments naming chips
    above each machine's marker. By the machine's number the marker stands right below, at the end of its reach,
    out of reach, or names a machine that nobody knows."""
    number = F.expr("CAST(substr(machine_id, 2) AS BIGINT)")
    blank = F.when(number % 6 == 3, "\n\n").when(number % 6 == 4, "\n\n\n").otherwise("")
    body = F.concat(
        F.lit("// board "), "machine_id", F.lit(" uses\n/* "), F.coalesce("chips", F.lit("nothing")), F.lit(" */\n"), blank,
        F.lit("ROM_START( "), F.when(number % 6 == 5, "zz").otherwise(""), "machine_id", F.lit(" )\n  ROM_LOAD(\"a//b\", 'x')\nROM_END\n"))
    chips = cat["machine_chip"].groupBy("machine_id").agg(F.array_join(F.array_sort(F.collect_set("chip_id")), " ").alias("chips"))
    lines = cat["machine"].select("machine_id", "mame_sourcefile").join(chips, "machine_id", "left").select("mame_sourcefile", "machine_id", body.alias("t"))
    # A source file is one value: machines are dealt to files of about 200, however many there are.
    files = lines.groupBy("mame_sourcefile").agg(F.ceil(F.count("*") / 200).alias("files"))
    return (lines.join(files, "mame_sourcefile").withColumn("doc_id", F.concat("mame_sourcefile", F.lit("#"), (number % F.col("files")).cast("string")))
            .groupBy("doc_id", "mame_sourcefile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("machine_id", "t"))), lambda x: x["t"]), "").alias("text")))


def _blocks(cat):
    """Comment blocks with their machine and source file, stored: they are scanned, cited and attributed."""
    src = written(_source_files(cat))
    found = source_text.attach_markers(written(source_text.extract_comments(src)), source_text.markers(src))
    return written(found.join(src.select("doc_id", "mame_sourcefile"), "doc_id"))


@query("rec7_extract_comments")
def rec7(cat):
    return source_text.extract_comments(_source_files(cat)).select(F.regexp_extract("text", r"board (\S+)", 1).alias("machine_id"), F.length("text").cast("long").alias("size"))


@query("rec8_attach_rom_starts")
def rec8(cat):
    return _blocks(cat).select(F.regexp_extract("text", r"board (\S+)", 1).alias("board"), "machine_id")


@query("rec9_attribute_blocks")
def rec9(cat):
    return source_text.attribute_blocks(cat, _blocks(cat)).groupBy("system_id").agg(F.count("*").alias("blocks"))


@query("rec9_source_witness")
def rec9_witness(cat):
    """Driver comments to witness rows: blocks, their markers, parts named in them, families."""
    rows = reconcile.source_witness(cat, _blocks(cat), parts.catalogue_names(cat), parts.chip_index(cat, RECOGNITION), RECOGNITION, LISTING_URL)
    return rows.select("system_id", "witness", "key", "designation", "chip_id", "source_url", "evidence")


@query("rec10_strip_markup")
def rec10(cat):
    return cat["pages"].select("page_id", F.md5(source_text.strip_markup(F.col("html"))).alias("digest"), F.length(source_text.strip_markup(F.col("html"))).cast("long").alias("size"))


def _wiki(cat):
    """Wiki articles derived from the systems: an infobox and a specification section."""
    return cat["system"].select(F.col("system_id").alias("doc_id"), F.concat(
        F.lit("{{Infobox\n| name = "), "name", F.lit("\n| CPU = [[Zilog Z80|Z80]] {{convert|4|{{x}}}} at "), F.coalesce(F.col("year_introduced").cast("string"), F.lit("?")),
        F.lit("\n| media = none\n}}\n== History ==\n* old\n== [[Specifications]] ==\n* '''"), "kind_id", F.lit("'''<ref name=a/>\n; sound: "), "name",
        F.lit("\nplain\n== See also ==\n* later\n== Specifications ==\n* again\n")).alias("text"))


QUERIES["rec11_infobox_fields"] = lambda cat: source_text.infobox_fields(_wiki(cat), ("cpu", "na-me"))
QUERIES["rec12_spec_section_items"] = lambda cat: source_text.spec_section_items(_wiki(cat), ("Specifications", "Hardware"))


@query("rec13_resolve_title")
def rec13(cat):
    """Titles s<n> redirect to s<n/2>: alias chains as long as the logarithm of n."""
    num = F.substring("consumer_id", 2, 20)
    alias = cat["implementation_dependency"].select(F.concat(F.lit("s"), num).alias("from"), F.concat(F.lit("s"), F.substring("provider_id", 2, 20)).alias("to"))
    titles = cat["implementation"].select(F.concat(F.lit("s"), F.substring("implementation_id", 2, 20)).alias("title"))
    return source_text.resolve_title(titles, alias).select("title", "resolved")


@query("rec14_module_instances")
def rec14(cat):
    """HDL text per implementation and a manifest, derived from what it depends on."""
    v = cat["implementation_dependency"].select(
        F.concat("consumer_id", F.lit(".v")).alias("path"),
        F.concat(F.lit("module top;\n  wire x;\n  core_"), "provider_id", F.lit(" #(.W(8)) u_core(\n    .clk(clk) );\nendmodule\n")).alias("text"))
    y = cat["implementation_dependency"].select(F.concat("consumer_id", F.lit(".yaml")).alias("path"), F.concat(F.lit("core_"), "provider_id", F.lit(":\n  - a\nother: 1\n")).alias("text"))
    return source_text.module_instances(v.unionByName(y)).select("path", "line", "module", "evidence")


@query("rec15_statement_parts")
def rec15(cat):
    val = lambda c: F.struct(c.alias("value"))
    label = F.when(F.col("chip_id").endswith("0"), F.concat(F.lit("Q"), F.substring("chip_id", 2, 20))).otherwise(F.col("display_name"))
    row = F.struct(val(F.concat(F.lit("http://example.org/entity/"), "chip_id")).alias("item"), val(F.lit("P880")).alias("prop"), val(label).alias("valueLabel"))
    bodies = cat["chip"].select(F.to_json(F.struct(F.struct(F.array(row).alias("bindings")).alias("results"))).alias("body"))
    return source_text.statement_parts(bodies)


def _references(cat):
    """Reference claims: driver comments read from source text, and rows derived from curated chips, families and device names."""
    index = parts.chip_index(cat, RECOGNITION)
    src = cat["system_chip"].select("system_id", F.upper("chip_id").alias("designation"), F.concat(F.lit("https://example.org/src/"), "role_id").alias("source_url"),
                                    F.concat(F.lit("// "), "chip_id").alias("evidence"))
    wiki = cat["system"].select("system_id", F.concat(F.lit("D"), F.coalesce(F.col("year_introduced").cast("string"), F.lit("38"))).alias("designation"),
                                F.lit("https://example.org/wiki").alias("source_url"), F.col("name").alias("evidence"))
    dev = cat["v_machine_system"].filter("system_id IS NOT NULL").join(cat["machine_unmapped_device"].filter("quantity >= 1"), "machine_id").select(
        "system_id", F.upper("mame_device").alias("designation"), F.lit("https://example.org/item").alias("source_url"), F.lit("statement").alias("evidence")).distinct()
    said = reconcile.source_witness(cat, _blocks(cat), parts.catalogue_names(cat), index, RECOGNITION, LISTING_URL)
    return (said.unionByName(reconcile.reference_witness(src, "mame-source", index, RECOGNITION))
            .unionByName(reconcile.reference_witness(wiki, "wikipedia", index, RECOGNITION))
            .unionByName(reconcile.reference_witness(dev, "wikidata", index, RECOGNITION)))


def _collapsed(cat):
    # `listing_witness` is already one row per (family, key); only references need collapsing.
    return reconcile.listing_witness(cat, RECOGNITION, LISTING_URL).select(*reconcile.FIELDS).unionByName(
        reconcile.collapse_parts(_references(cat).select(*reconcile.FIELDS)))


def _findings(cat, collapsed):
    return reconcile.classify_findings(collapsed, reconcile.machines_per_system(reconcile.machine_systems_for_recon(cat)))


def _reconciled(cat):
    """Collapsed parts, stored because records or a summary are made of them too, and findings."""
    collapsed = written(_collapsed(cat))
    return collapsed, _findings(cat, collapsed)


QUERIES["rec16_listing_witness"] = lambda cat: reconcile.listing_witness(cat, RECOGNITION, LISTING_URL)
QUERIES["rec17_collapse_parts"] = lambda cat: reconcile.collapse_parts(_references(cat)).select("system_id", "witness", "key", "designation", "chip_id", "source_url", "evidence")


def _flat_records(records):
    """Nested records as rows: each witness of a family with its place, each part with its place."""
    return (records.select("system_id", F.posexplode("witnesses").alias("w", "x")).select("system_id", F.coalesce("x.position", F.col("w") + 1).alias("position"), "x.witness", F.coalesce("x.after", F.lit(0)).alias("after"), F.posexplode("x.parts").alias("p", "part"))
            .select("system_id", "position", "witness", (F.col("after") + F.col("p") + 1).alias("part_position"), "part.key", "part.designation", "part.chip_id", "part.mame_state",
                    "part.source_url", "part.evidence", "part.machine_count"))


QUERIES["rec18_merge_witnesses"] = lambda cat: _flat_records(reconcile.merge_witnesses(_collapsed(cat)))
QUERIES["rec19_classify_findings"] = lambda cat: _findings(cat, _collapsed(cat))
QUERIES["rec20_reconcile_summary"] = lambda cat: reconcile.reconcile_summary(*_reconciled(cat))
QUERIES["rec21_machine_systems_for_recon"] = lambda cat: reconcile.machine_systems_for_recon(cat)
QUERIES["rec21_null_override_falls_through"] = lambda cat: reconcile.machine_systems_for_recon(cat, True)
#: Notes with a fence, code with sub-domains, row files and settings, for every page.
GUARDED = (
    ("n%d.md", "Notes on example.com, page {}\n```\ncurl https://www.example.com/{}\n```\nsee https://docs.example.org there"),
    ("t%d.ts", "const a = 'https://www.example.com/{}'\n// plain my-site.example.org\n\n\n\n\nconst b = 'my.example.org'\nconst c = 'the example.org site {}'\ngo to https://my-site.example.com now"),
    ("data/j%d.json", '{\n"source_url": "https://www.example.com/{}",\n"machine_id": "api.example.org"\n}'),
    ("config/c%d.json", '{"host": "api.example.org",\n"page": {},\n"base": "https://api.example.com"}'),
)
GUARD = guard.GuardPolicy(domains=("example.com", "example.org"), fetch_verbs=("fetch(", "curl", "src="))


@query("rec22_domain_guard")
def rec22(cat):
    docs = cat["documents"].select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), "text")
    pages = cat["pages"].select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.concat(F.lit("<!-- source: "), "url", F.lit(" -->\n"), "html").alias("text"))
    made = cat["pages"].select(F.explode(F.array(*[F.struct(
        F.format_string(path, "page_id").alias("path"), F.replace(F.lit(text), F.lit("{}"), F.col("page_id").cast("string")).alias("text"))
        for path, text in GUARDED])).alias("d")).select("d.*")
    found = [guard.domain_guard(d, GUARD) for d in (docs, pages, made)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("path", "line", "domain", "disposition")


# -- search, browse, details, dashboard --------------------------------------------------------

def _terms(cat):
    return (cat["part"].select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term")).unionByName(cat["customer"].select(F.col("c_mktsegment").alias("term")))
            .unionByName(cat["nation"].select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("term")))
            .unionByName(cat["nation"].select(F.concat(F.lit("Hardware "), F.col("n_nationkey").cast("string")).alias("term"))).distinct())


QUERIES["sea1_global_search"] = lambda cat: search.global_search(cat, _terms(cat))


@query("sea2_resolve_alias")
def sea2(cat):
    asked = cat["chip"].select(F.upper("chip_id").alias("term")).unionByName(cat["chip_name"].select(F.upper("name").alias("term"))).unionByName(
        cat["chip"].select(F.col("chip_id").alias("term")))
    systems = cat["system_name"].select(F.upper("name").alias("term")).unionByName(cat["system"].select(F.upper("system_id").alias("term")))
    return search.resolve_alias(cat["chip"], "chip_id", cat["chip_name"], asked).select(F.lit("chip").alias("kind"), "term", "id").unionByName(
        search.resolve_alias(cat["system"], "system_id", cat["system_name"], systems).select(F.lit("system").alias("kind"), "term", "id"))


QUERIES["brw1_chip_browser"] = browse.chip_browser
QUERIES["brw2_chip_filter_sort"] = lambda cat: browse.chip_filter_sort(browse.chip_browser(cat), status="equivalent", text="r", sort="systems")
QUERIES["brw3_machine_browser"] = browse.machine_browser
QUERIES["brw4_machine_filter_sort"] = lambda cat: browse.machine_filter_sort(
    cat, browse.machine_browser(cat), kind="console", year_from=1994, year_to=1999, min_coverage=50, core="no", text="board", sort="coverage", descending=True)
QUERIES["brw5_system_browser"] = browse.system_browser
QUERIES["brw5_system_filter"] = lambda cat: browse.system_filter(browse.system_browser(cat), kind="console", core="no", text="family")
QUERIES["brw6_implementation_browser"] = browse.implementation_browser
QUERIES["brw6_implementation_filter"] = lambda cat: browse.implementation_filter(cat, browse.implementation_browser(cat), license="none", platform="america", text="author")
QUERIES["brw7_prospector_filters"] = lambda cat: prospect.prospector_filters(
    prospect.prospect_rank(cat), platform="asia", kind="console", text="family").select("platform_id", "rank", "system_id", "score")
QUERIES["brw8_facets"] = browse.facets
for _name in ("chip_head", "chip_implementations", "chip_machines", "chip_equivalences", "chip_systems", "chip_machine_count"):
    QUERIES[f"det1_{_name}"] = lambda cat, f=getattr(browse, _name): f(cat)
for _name in ("machine_head", "machine_bom_detail", "machine_implementations", "machine_cores", "machine_unmapped"):
    QUERIES[f"det2_{_name}"] = lambda cat, f=getattr(browse, _name): f(cat)
for _name in ("system_head", "system_chipset", "system_platforms", "system_machines", "system_drivers", "system_cores"):
    QUERIES[f"det3_{_name}"] = lambda cat, f=getattr(browse, _name): f(cat)
QUERIES["det4_implementation_links"] = lambda cat: browse.implementation_links(cat)
QUERIES["dsh1_headline"] = lambda cat: browse.headline(cat, "asia")
QUERIES["dsh2_band_rollup"] = browse.band_rollup
QUERIES["dsh3_top_worklist"] = lambda cat: browse.top_worklist(cat)

# -- row lints ----------------------------------------------------------------------------------


def _bundle_rows(cat):
    """Catalogue tables as bundle rows: entity files named after their row, lookups in shared files.
    Positions follow the numeric key, which is not the bytewise order for ids of different length."""
    chip = cat["chip"].withColumn("_file", F.concat(F.lit("data/chip/"), F.when(F.col("function_id") == "glue", F.upper("chip_id")).otherwise(F.col("chip_id")), F.lit(".json"))).withColumn("_pos", F.lit(0))
    names = cat["chip_name"].withColumn("_file", F.concat(F.lit("data/chip/"), F.when(F.col("kind") == "retired_id", F.lit("p0")).otherwise(F.col("chip_id")), F.lit(".json"))).withColumn("_pos", F.lit(0))
    device = cat["mame_device"].withColumn("_file", F.lit("data/mame_device.json")).withColumn("_pos", F.substring("mame_device", 2, 20).cast("long"))
    return {"chip": chip, "chip_name": names, "mame_device": device}


QUERIES["val1_filename_key"] = lambda cat: validation.filename_key(_bundle_rows(cat)).select("severity", "file", "table", "key", "column", "rule")
QUERIES["val2_row_order"] = lambda cat: validation.row_order({"mame_device": _bundle_rows(cat)["mame_device"]}).select("file", "table", "key", "rule")
QUERIES["val3_clock_range"] = lambda cat: validation.clock_range({"chip": _bundle_rows(cat)["chip"].withColumn("typical_clock_hz", F.col("typical_clock_hz") * 300)}).select("table", "key", "column", "rule", "message")
QUERIES["val4_year_range"] = lambda cat: validation.year_range(_bundle_rows(cat)).select("table", "key", "column", "rule", "message")


def _located(cat):
    """Files of chip rows, to send warnings to their file."""
    return cat["chip"].select(F.lit("chip").alias("table"), F.col("chip_id").alias("key"), F.concat(F.lit("data/chip/"), "chip_id", F.lit(".json")).alias("file"))


QUERIES["val5_warning_diagnostic"] = lambda cat: validation.warning_diagnostic(cat["v_quality_warning"], _located(cat)).select("severity", "file", "table", "key", "column", "rule")
QUERIES["val6_sort_and_count"] = lambda cat: validation.severity_counts(validation.sorted_findings(
    validation.filename_key(_bundle_rows(cat)).unionByName(validation.year_range(_bundle_rows(cat)))))
