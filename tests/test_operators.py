"""Operator behaviour on small fixtures, and brute-force comparisons."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from bomscope.catalog import GRAMMARS, TABLES, Catalog, matches_grammar
from bomscope.functions import parts, source_text
from bomscope.functions.columns import with_axis
from bomscope.operators import closure, extraction, gates, validation
from bomscope.operators.ranking import number_rows
from bomscope.plans import guard, prospect, reconcile, search
from bomscope.sources import bundles, listing, sinks, versions
from fixtures import canonical as canonical_rows

# -- extraction ---------------------------------------------------------------------

XML = """<?xml version="1.0"?>
<mame build="0.288">
 <machine name="a" sourcefile="x/a.cpp" isbios="no"><description>A &amp; B</description><year>1987</year><manufacturer>M</manufacturer>
  <device_ref tag=":maincpu" name="z80"/><device_ref tag=":maincpu" name="m68000"/><device_ref tag=":spk" name="speaker"/><device_ref name="untagged"/>
  <chip type="cpu" tag="maincpu" name="Zilog Z80" clock="bad"/><chip type="audio" tag="maincpu" name="Second" clock="4000000"/><chip type="cpu" tag="lost" name="L" clock="0"/>
  <driver status="good"/></machine>
 <machine name="b" sourcefile="x/b.cpp" isdevice="yes" runnable="no" cloneof="a"><description>B</description><driver status="odd"/>
  <chip type="cpu" tag="one" name="N"/></machine>
</mame>"""


@pytest.fixture(scope="module")
def xml(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("xml") / "listing.xml"
    path.write_text(XML)
    return listing.read_machine_listing(spark, str(path))


def test_listing_attributes(xml):
    rows = {r.machine_id: r for r in extraction.parse_flags_clock(xml).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.name, a.mame_year, a.driver_status, a.is_device, a.runnable) == ("A & B", "1987", "good", 0, 1)
    assert (b.driver_status, b.is_device, b.runnable, b.cloneof) == (None, 1, 0, "a")


def test_device_fold(xml):
    rows = {(r.machine_id, r.mame_tag): r for r in extraction.join_device_chip(*extraction.flatten_listing(xml)).collect()}
    assert set(rows) == {("a", "maincpu"), ("a", "spk")}
    cpu = rows["a", "maincpu"]  # last reference, set of types, first name, first usable clock
    assert (cpu.mame_device, cpu.chip_types, cpu.chip_name, cpu.clock_hz) == ("m68000", ["audio", "cpu"], "Zilog Z80", 4000000)
    assert rows["a", "spk"].chip_types is None


def test_parse_stats(xml):
    got = extraction.parse_stats(xml, *extraction.flatten_listing(xml)).first().asDict()
    assert got == {"machines": 2, "chips": 4, "device_refs": 4, "chips_without_device_ref": 2, "chips_without_usable_clock": 3, "untagged_references": 1}


@pytest.mark.parametrize("text,want", [("0", None), ("12", 12), ("-1", None), ("1e3", None), ("9007199254740991", 9007199254740991), ("9007199254740992", None),
                                       ("99999999999999999999", None), (None, None), ("", None)])
def test_clock(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(extraction.usable_clock(F.col("c"))).first()[0] == want


def test_drop_rules_first_wins(spark):
    cols = "machine_id string, mame_sourcefile string, is_device int, is_mechanical int, is_bios int, cloneof string"
    m = spark.createDataFrame([("dev", "a/x.cpp", 1, 1, 0, "p"), ("mech", "a/x.cpp", 0, 1, 0, None), ("clone", "a/x.cpp", 0, 0, 1, "p"), ("bios", "a/x.cpp", 0, 0, 1, None),
                               ("ex", "casino/z.cpp", 0, 0, 0, None), ("keep", "casino/y.cpp", 0, 0, 0, None), ("ok", "casino.cpp", 0, 0, 0, None)], cols)
    rules = extraction.rules_frame(spark, [("casino/", "r"), ("casino/z.cpp", "r"), ("unused/", "r")], [("casino/y.cpp", "r"), ("gone.cpp", "r")])
    decided = extraction.classify_drop(m, rules)
    got = {r.machine_id: (r.drop_reason, r.rule) for r in decided.collect()}
    assert got == {"dev": ("device", None), "mech": ("mechanical", None), "clone": ("clone", None), "bios": ("bios", None),
                   "ex": ("excluded_driver", "casino/"), "keep": (None, None), "ok": (None, None)}
    stats = {(r.section, r.name): r.value for r in extraction.filter_stats(decided, rules).collect()}
    assert stats["total", ""] == 7 == stats["kept", ""] + sum(v for (s, _), v in stats.items() if s == "dropped")
    assert {k for k in stats if k[0].startswith("unused")} == {("unused_exclude_rule", "unused/"), ("unused_exclude_rule", "casino/z.cpp"), ("unused_keep_rule", "gone.cpp")}
    off = extraction.classify_drop(m, rules, drop_devices=False, parents_only=False)
    assert {r.machine_id: r.drop_reason for r in off.collect()}["dev"] == "mechanical"


def test_routing_is_total_and_order_free(spark):
    dev = spark.createDataFrame([("m", f"t{i}", d, None) for i, d in enumerate(["z80", "speaker", "gate", "gate", "z80"])],
                                "machine_id string, mame_tag string, mame_device string, clock_hz long")
    dic = spark.createDataFrame([("z80", "z80", None), ("speaker", None, "not a chip")], "mame_device string, chip_id string, ignore_reason string")
    chips, unmapped = extraction.route_devices(dev, dic)
    assert chips.count() == 2 and [(r.mame_device, r.quantity) for r in unmapped.collect()] == [("gate", 2)]


def test_worklist_samples_and_sets(spark):
    dev = spark.createDataFrame([(f"m{i}", f"t{j}", "d", ["cpu"] if i % 2 else None, f"N{i % 3}") for i in range(9) for j in range(2)],
                                "machine_id string, mame_tag string, mame_device string, chip_types array<string>, chip_name string")
    r = extraction.device_worklist_raw(dev, 3).first()
    assert (r.instance_count, r.machine_count, r.chip_types, r.chip_names, r.sample_machine_ids) == (18, 9, ["cpu"], ["N0", "N1", "N2"], ["m0", "m1", "m2"])


def test_all_violations_are_listed(spark):
    v = spark.createDataFrame([("machine", f"m{i}", "bad") for i in range(5)], "table string, machine_id string, detail string")
    known = spark.createDataFrame([(f"machine/m{i}", "ok") for i in (0, 1, 4)] + [("machine/zz", "ok")], "key string, reason string")
    got = sorted((r.status, r.machine_id) for r in extraction.classify_violations(v, known).collect())
    assert got == [("known", "m0"), ("known", "m1"), ("known", "m4"), ("unexpected", "m2"), ("unexpected", "m3"), ("unused_known", "zz")]


# -- ranking, axis --------------------------------------------------------------------

def test_repeated_keys_are_refused(spark):
    names = [c.name for c in TABLES["machine"].columns]
    schema = "record int, " + ", ".join(f"{c.name} {c.type.simpleString()}" for c in TABLES["machine"].columns)

    def machine(record, machine_id, file="a/b.cpp"):
        given = {"machine_id": machine_id, "name": "N", "mame_sourcefile": file, "is_bios": 0, "is_device": 0, "is_mechanical": 0}
        return (record, *[given.get(n) for n in names])

    machines = spark.createDataFrame([machine(1, "a"), machine(2, "b", "A/B.CPP"), machine(3, "a"), machine(4, "b"), machine(5, "a", "A/B.CPP"), machine(6, "b")], schema)
    devices = spark.createDataFrame(
        [(1, 1, "a", "cpu", "z80"), (1, 2, "a", "snd", "ay"), (1, 3, "a", "cpu", "ay"), (1, 4, "a", "cpu", "ay"), (1, 5, "a", "c..u", "ay"), (1, 6, "a", "c..u", "ay"),
         (2, 1, "b", "cpu", "BAD!"), (3, 1, "a", "x", "BAD!"), (4, 1, "b", "cpu", "z80"), (4, 2, "b", "cpu", "BAD!"), (5, 1, "a", "y", "BAD!"), (6, 1, "b", "z", "BAD!")],
        "record int, pos int, machine_id string, mame_tag string, mame_device string").withColumn("clock_hz", F.lit(None).cast("long"))
    got = sorted(tuple(r) for r in extraction.verify_constraints(machines, devices).collect())
    assert got == sorted([
        ("machine", "a", "machine_id: repeated key"), ("machine", "a", "mame_sourcefile: sourcefile"),  # a broken rule is named first
        ("machine", "b", "mame_sourcefile: sourcefile"), ("machine", "b", "machine_id: repeated key"),  # its key stays free for record 4
        ("machine_chip", "a", "cpu -> mame_tag: repeated key"), ("machine_chip", "a", "cpu -> mame_tag: repeated key"),
        ("machine_chip", "a", "c..u -> mame_tag: mame_tag"), ("machine_chip", "a", "c..u -> mame_tag: mame_tag"),
        ("machine_chip", "b", "cpu -> mame_tag: repeated key"), ("machine_unmapped_device", "b", "BAD! -> mame_device: mame_device_key")])


def test_number_rows_matches_sort_with_one_huge_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.randint(0, 3), f"id{i:04d}") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, id string").repartition(6)
    got = {(r.g, r.id): r["rank"] for r in number_rows(df, ["g"], [F.desc("v"), F.asc("id")]).collect()}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            assert got[g, r[2]] == n


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_axis_repeats_every_row_and_takes_filters(spark, threshold):
    """Small and large dictionaries, broadcast and shuffled, repeated and null values; the filter reaches the dictionary."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        axis = spark.range(12_000).select((F.col("id") % 6_000).cast("string").alias("k"))
        rows = spark.range(40).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("s"))
        got = with_axis(rows, "s", axis, "k")
        assert got.columns == ["s", "k"] and got.count() == 40 * 6_000
        assert got.distinct().count() == (rows.filter("s IS NOT NULL").distinct().count() + 1) * 6_000
        assert with_axis(rows, "s", axis.limit(0), "k").count() == 0
        one = got.filter("k = '7'")
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert one.count() == 40 and plan.index("Generate") < plan.index("= 7")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# -- closure and gates -------------------------------------------------------------------

def brute_cycle(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    return {n for n in nodes if n in reach[n]}


@pytest.mark.parametrize("edges", [
    [("a", "b"), ("b", "c"), ("c", "d")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")],
    [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("s", "s")],
])
def test_cycle_nodes(spark, edges):
    got = {r.node for r in closure.cycle_nodes(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == brute_cycle(edges)


def test_cycle_nodes_random(spark):
    rng = random.Random(11)
    edges = sorted({(f"n{rng.randint(0, 24)}", f"n{rng.randint(0, 24)}") for _ in range(34)})
    got = {r.node for r in closure.cycle_nodes(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == brute_cycle(edges)


def test_cycle_nodes_of_long_chains(spark, monkeypatch):
    """A chain and a ring of 10 000 nodes each, a ring with a bridge, and a chain into a ring: rounds as the logarithm."""
    rounds = []
    real = closure.written
    monkeypatch.setattr(closure, "written", lambda df: rounds.append(1) or real(df))
    chain = [(f"a{k}", f"a{k + 1}") for k in range(10_000)]
    assert closure.cycle_nodes(spark.createDataFrame(chain, "a string, b string"), "a", "b").count() == 0
    assert len(rounds) <= 40  # two directions of 14 doublings, and what is around them
    ring = [(f"r{k}", f"r{(k + 1) % 3000}") for k in range(3000)] + [("r7", "r1500")]  # two ways round
    more = [(f"c{k}", f"c{k + 1}") for k in range(500)] + [("c500", "r3"), ("o", "o")] + [(f"p{k}", f"p{(k + 1) % 900}") for k in range(900)]
    got = {r.node for r in closure.cycle_nodes(spark.createDataFrame(ring + more, "a string, b string"), "a", "b").collect()}
    assert got == {f"r{k}" for k in range(3000)} | {f"p{k}" for k in range(900)} | {"o"}


@pytest.mark.parametrize("seed", range(3))
def test_cycle_nodes_random_sparse(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(44)})
    got = [r.node for r in closure.cycle_nodes(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()]
    assert set(got) == brute_cycle(edges) and len(got) == len(set(got))


def test_titles_to_the_end_and_around(spark):
    steps = [(f"t{k}", f"t{k + 1}") for k in range(300)] + [("x", "y"), ("y", "z"), ("z", "y"), ("self", "self")]
    aliases = spark.createDataFrame(steps, "from string, to string")
    titles = spark.createDataFrame([("t0",), ("t299",), ("t300",), ("x",), ("y",), ("self",), ("other",), (None,)], "title string")
    got = {r.title: (r.resolved, r.cyclic) for r in source_text.resolve_title(titles, aliases).collect()}
    assert got == {"t0": ("t300", False), "t299": ("t300", False), "t300": ("t300", False), "x": (None, True), "y": (None, True),
                   "self": ("self", False), "other": ("other", False), None: (None, False)}
    assert source_text.resolve_title(titles, aliases, hops=4).filter("title = 't0'").first().resolved == "t4"


def _boards(spark, sockets, cored):
    systems = sorted({s for s, _ in sockets})
    return Catalog.from_rows(spark, {
        "chip_function": [{"function_id": "cpu", "label": "c", "prospector_band": "hard"}],
        "chip": [{"chip_id": c, "display_name": c, "function_id": "cpu"} for c in sorted({c for _, c in sockets})],
        "system": [{"system_id": s, "name": s, "kind_id": "k"} for s in systems],
        "system_chip": [{"system_id": s, "chip_id": c, "role_id": "r", "quantity": 1} for s, c in sockets],
        "implementation": [{"implementation_id": "i", "name": "i", "kind_id": "fpga_hdl"}],
        "implementation_platform": [{"implementation_id": "i", "platform_id": "p"}],
        "implementation_system": [{"implementation_id": "i", "system_id": s} for s in cored]})


@pytest.mark.parametrize("light", [0, 3, 64])
def test_best_mate_with_chips_on_all_boards(spark, light):
    rng = random.Random(light)
    common, rare = [f"u{k:02}" for k in range(20)], [f"v{k:02}" for k in range(30)]
    boards = {f"s{k:03}": set(common) | set(rng.sample(rare, rng.randint(0, 4))) for k in range(60)}
    boards |= {f"h{k:03}": set(rng.sample(common, rng.randint(1, 20))) for k in range(30)}
    cored = sorted(boards)[::3]
    cat = _boards(spark, [(s, c) for s, chips in boards.items() for c in chips], cored)
    pairs = {(s, t): len(boards[s] & boards[t]) for s in boards for t in cored if len(boards[s] & boards[t]) >= 2}
    best = {}
    for (s, t), n in pairs.items():
        best[s] = min(best.get(s, (-n, t)), (-n, t))
    got = {r.system_id: (-r.shared_chips, r.mate_system_id) for r in prospect.best_mate(cat, light=light).collect()}
    assert got == best
    if light == 64:
        assert {(r.system_id, r.mate_system_id): r.shared_chips for r in prospect.system_mates(cat).collect()} == pairs


def test_mates_of_few_boards_with_many_chips(spark):
    """Boards of thousands of chips: no list of chips may travel with each of its chips."""
    from pyspark.sql import functions as F

    from bomscope.catalog import TABLES

    n, boards = 6000, 40
    chips = {s: {c for c in range(n) if (c * 31 + s * s) % 7 < 3} for s in range(boards)}
    cat = _boards(spark, [(f"s{s:02}", "c0") for s in range(boards)], [f"s{s:02}" for s in range(0, boards, 2)])
    rows = spark.range(boards * n).select((F.col("id") % boards).alias("s"), F.floor(F.col("id") / boards).alias("c")).filter("(c * 31 + s * s) % 7 < 3")
    sockets = rows.select(F.format_string("s%02d", "s").alias("system_id"), F.lit("r").alias("role_id"), F.concat(F.lit("c"), "c").alias("chip_id"),
                          F.lit(1).cast("long").alias("quantity"), F.lit(None).cast("long").alias("clock_hz"), F.lit(None).cast("string").alias("note"))
    cat = cat.with_tables(system_chip=sockets.select(*TABLES["system_chip"].names))
    pairs = {(f"s{s:02}", f"s{t:02}"): len(chips[s] & chips[t]) for s in chips for t in range(0, boards, 2) if len(chips[s] & chips[t]) >= 2}
    assert {(r.system_id, r.mate_system_id): r.shared_chips for r in prospect.system_mates(cat).collect()} == pairs
    best = {s: min((-m, t) for (u, t), m in pairs.items() if u == s) for s, _ in pairs}
    for light in (0, 10, 64):
        assert {r.system_id: (-r.shared_chips, r.mate_system_id) for r in prospect.best_mate(cat, light=light).collect()} == best


def test_no_task_holds_all_sockets_of_the_mates(spark, monkeypatch):
    """Files of sockets are small, as ids repeat, and their rows in memory are not: they may not be broadcast."""
    boards = {f"s{k}": {f"c{j}" for j in range(12) if (j + k) % 3} for k in range(8)}
    cat = _boards(spark, [(s, c) for s, chips in boards.items() for c in chips], sorted(boards)[::2])
    steps, written = [], prospect.written
    monkeypatch.setattr(prospect, "written", lambda df: steps.append(df) or written(df))
    steps += [prospect.system_mates(cat), prospect.best_mate(cat, light=0), prospect.best_mate(cat)]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in steps]
    assert any("SortMergeJoin [chip_id" in p for p in plans)
    assert not any("BroadcastHashJoin [chip_id" in p for p in plans)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_mates_of_boards_that_meet_in_common_chips(spark, least):
    from dataclasses import replace

    rng = random.Random(least)
    boards = {f"s{k:02}": {"all"} | set(rng.sample([f"u{j}" for j in range(6)], rng.randint(0, 4))) for k in range(25)}
    cored = sorted(boards)[::2]
    cat = _boards(spark, [(s, c) for s, chips in boards.items() for c in chips], cored)
    policy = replace(prospect.DEFAULT, mate_min_shared=least)
    pairs = {(s, t): len(boards[s] & boards[t]) for s in boards for t in cored if len(boards[s] & boards[t]) >= least}
    assert {(r.system_id, r.mate_system_id): r.shared_chips for r in prospect.system_mates(cat, policy).collect()} == pairs


def test_machines_are_bound_without_devices(spark):
    from bomscope.binding import bind_catalog
    from settings import SF

    cat = bind_catalog(spark, SF)
    machines = sorted(map(tuple, cat["v_machine"].select("machine_id", "name", "clone_count").collect()), key=str)
    assert not {"devices", "kept_devices", "machine_chip"} & set(cat._memo)
    every = extraction.emit_machine_rows(cat["kept"], cat["kept_devices"], cat["mame_device"], "0.288")["machine"]
    assert cat["machine"].schema == every.schema and not cat["machine"].exceptAll(every).count() and cat["machine"].count() == every.count() == len(machines)


def test_headline_binds_no_devices(spark):
    from bomscope.binding import bind_catalog
    from bomscope.plans import browse, views
    from settings import SF

    cat = bind_catalog(spark, SF)
    counted = {p: browse.headline(cat, p).first().prospector_candidates for p in ("asia", "europe", "nowhere")}
    assert not {"kept_devices", "machine_chip", "machine_unmapped_device"} & set(cat._memo)
    rows = sorted(map(tuple, cat["v_prospector"].select("platform_id", "system_id").collect()))
    assert sorted(map(tuple, views.prospector_candidates(cat).collect())) == rows
    assert counted == {p: sum(r[0] == p for r in rows) for p in counted} and counted["asia"]


def test_no_task_holds_all_kept_machines_while_binding(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from bomscope.binding import bind_catalog
    from settings import SF

    plans, parquet = {}, DataFrameWriter.parquet

    def seen(self, path, *args, **kwargs):
        plans[path.rsplit("/", 1)[1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    cat = bind_catalog(spark, SF)
    for name in ("implementation_machine", "machine_system", "machine_chip_correction"):
        assert not cat[name].isEmpty()
        assert not [x for x in plans[name].splitlines() if "BroadcastHashJoin" in x and "machine_id" in x], name


def test_letters_of_several_capitals_are_no_signs(spark):
    """As in the SQL: one normal form, so one row for the line, and the first spelling stands."""
    docs = spark.createDataFrame([("d", "der erach und erßach\nder erßach und ﬁx"), ("e", "ERACH er-ach")], "doc_id string, text string")
    forms = spark.createDataFrame([("er ach",)], "form string")
    got = sorted((r.doc_id, r.line, r.designation) for r in parts.scan_parts(docs, forms, parts.Recognition()).collect())
    assert got == [("d", 1, "erach"), ("d", 2, "erßach"), ("e", 1, "ERACH")]
    shown = spark.createDataFrame([("Straße-1µ ﬁ ŉ",)], "a string").select(parts.normalize_part(F.col("a")).alias("n")).first().n
    assert shown == "STRAE1U"


def test_names_meet_only_lines_that_have_all_their_signs(spark):
    """Names that share their first signs: a line meets those it names, not all that begin alike."""
    names = spark.range(1000, 3000).select(F.concat(F.lit("p12"), "id").alias("form")).unionByName(
        spark.createDataFrame([("x" * 31 + "1",), ("x" * 31 + "22",), ("y" * 40 + " b",), ("y" * 40 + " c",)], "form string"))
    text = "uses p121000 P12 1001 p121002x p12-1003 p12--1004\n" + "x" * 31 + "1 " + "x" * 30 + "x22\n" + "y" * 40 + "-C"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = sorted((r.line, r.designation) for r in parts.scan_parts(docs, names, parts.Recognition()).collect())
    assert got == [(1, "p121000"), (2, "x" * 31 + "1"), (2, "x" * 31 + "22"), (3, "y" * 40 + "-C")]
    met = parts._met_names(parts.lines_of(docs), parts.literal_table(names, parts.Recognition()), "doc_id")
    assert {r.line: len(r.names) for r in met.collect()} == {1: 4, 2: 2, 3: 2}


def test_the_bom_is_not_shuffled_once_it_is_expanded(spark):
    """Families' rows meet their machines in the last join of a plan; what a machine holds itself comes once."""
    from bomscope.plans import browse

    rng = random.Random(5)
    families = [f"f{k}" for k in range(3)]
    sockets = sorted({(f, f"c{rng.randint(0, 9)}", f"r{rng.randint(0, 2)}") for f in families for _ in range(6)})
    machines = [(f"m{k:02}", rng.choice(families + [None])) for k in range(40)]
    own = sorted({(m, f"t{rng.randint(0, 3)}", f"c{rng.randint(0, 9)}") for m, _ in machines for _ in range(rng.randint(0, 3))})
    claims = sorted({(f"i{rng.randint(0, 5)}", m) for m, _ in machines for _ in range(2)})
    served = sorted({(f"i{rng.randint(0, 5)}", f) for f in families for _ in range(3)})
    cat = Catalog.from_rows(spark, {
        "chip_function": [{"function_id": "cpu", "label": "c", "prospector_band": "hard"}],
        "chip": [{"chip_id": f"c{k}", "display_name": f"n{k}", "function_id": "cpu"} for k in range(9)],  # c9 is in no table of chips
        "system_chip": [{"system_id": f, "chip_id": c, "role_id": r, "quantity": 1} for f, c, r in sockets],
        "machine": [{"machine_id": m, "name": m, "mame_sourcefile": "x", "is_bios": 0, "is_device": 0, "is_mechanical": 0} for m, _ in machines],
        "machine_system": [{"machine_id": m, "system_id": f, "reason": "r"} for m, f in machines],
        "machine_chip": [{"machine_id": m, "mame_tag": t, "chip_id": c, "quantity": 1} for m, t, c in own],
        "implementation": [{"implementation_id": f"i{k}", "name": f"n{k}", "kind_id": "fpga_hdl"} for k in range(5)],
        "implementation_chip": [{"implementation_id": f"i{k}", "chip_id": f"c{k}"} for k in range(5)],
        "implementation_machine": [{"implementation_id": i, "machine_id": m} for i, m in claims],
        "implementation_system": [{"implementation_id": i, "system_id": f} for i, f in served]})
    held = {(m, c) for m, _, c in own}
    bom = sorted([(m, c, t, "machine") for m, t, c in own] + [(m, c, r, "system") for m, f in machines for g, c, r in sockets if f == g and (m, c) not in held])
    assert sorted((r.machine_id, r.chip_id, r.role, r.via) for r in cat["v_machine_bom"].collect()) == bom
    assert sorted((r.machine_id, r.chip_id, r.role, r.via) for r in browse.chip_machines(cat).collect()) == bom
    detail = browse.machine_bom_detail(cat)
    assert sorted((r.machine_id, r.chip_id, r.role, r.via) for r in detail.collect()) == [b for b in bom if b[1] != "c9"]
    routes = browse.machine_implementations(cat)
    assert sorted((r.machine_id, r.chip_id, r.implementation_id) for r in routes.collect()) == sorted({(m, c, "i" + c[1:]) for m, c, *_ in bom if c < "c5"})
    cores = browse.machine_cores(cat)
    near = {(m, i) for i, m in claims if i != "i5"}
    far = {(m, i) for m, f in machines for i, g in served if f == g and i != "i5"} - near
    assert sorted((r.machine_id, r.implementation_id, r.scope) for r in cores.collect()) == sorted([(*x, "machine") for x in near] + [(*x, "system") for x in far])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (cat["v_machine_bom"], browse.chip_machines(cat), detail, routes, cores):
            lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
            depth = {k: len(re.match(r"[ :+|*-]*", line).group()) for k, line in enumerate(lines)}
            at = next(k for k, line in enumerate(lines) if "SortMergeJoin [family_id" in line)
            # Whatever stands on the way from this join to the root has a smaller indent than all between.
            low, above = depth[at], []
            for k in range(at - 1, -1, -1):
                if depth[k] < low:
                    low = depth[k]
                    above.append(lines[k])
            assert not [x for x in above if "Exchange" in x or "Join" in x or "Aggregate" in x], above
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bom_counts_never_expand_the_bom(spark):
    from bomscope.plans import browse

    rng = random.Random(9)
    families = {f"f{k}": sorted({f"c{rng.randint(0, 12)}" for _ in range(4)}) for k in range(5)}
    machines = {f"m{k}": (rng.choice([*families, None]), sorted({f"c{rng.randint(0, 15)}" for _ in range(rng.randint(0, 5))})) for k in range(60)}
    cat = Catalog.from_rows(spark, {
        "chip": [{"chip_id": f"c{k}", "display_name": "x", "function_id": "cpu"} for k in range(16)],
        "machine": [{"machine_id": m, "name": m, "mame_sourcefile": "x.cpp"} for m in machines],
        "machine_system": [{"machine_id": m, "system_id": f, "reason": "r"} for m, (f, _) in machines.items() if f],
        "system_chip": [{"system_id": f, "chip_id": c, "role_id": f"r{j}", "quantity": 1} for f, chips in families.items() for c in chips for j in range(2)],
        "machine_chip": [{"machine_id": m, "mame_tag": f"t{j}", "chip_id": c, "quantity": 1} for m, (_, chips) in machines.items() for j, c in enumerate(chips + chips[:1])],
        "implementation": [{"implementation_id": "i", "name": "i", "kind_id": "fpga_hdl"}],
        "implementation_chip": [{"implementation_id": "i", "chip_id": f"c{k}"} for k in range(0, 16, 3)]})
    whole = {m: set(chips) | set(families.get(f, [])) for m, (f, chips) in machines.items()}
    per_chip = {c: sum(c in chips for chips in whole.values()) for c in {c for chips in whole.values() for c in chips}}
    assert {r.chip_id: r.machine_count for r in browse.chip_machine_count(cat).collect()} == per_chip
    hit = {f"c{k}" for k in range(0, 16, 3)}
    assert {r.machine_id: (r.chips_total, r.chips_satisfied) for r in browse.machine_browser(cat).collect()} == {m: (len(c), len(c & hit)) for m, c in whole.items()}
    for df in (browse.chip_machine_count(cat), browse.machine_browser(cat)):
        assert "mame_tag" not in df._jdf.queryExecution().optimizedPlan().toString().replace("Relation", "").split("Project")[0]


def test_reach_depths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "x string, y string")
    got = sorted(tuple(r) for r in closure.reach_with_depth(e, "x", "y", spark.createDataFrame([("a",)], "s string")).collect())
    assert got == [("a", "b", 1), ("a", "c", 1), ("a", "c", 2)]


def eq_catalog(spark, edges, kind="equivalent"):
    return Catalog.from_rows(spark, {"chip_equivalence": [{"from_chip_id": a, "to_chip_id": b, "kind": kind, "note": "n"} for a, b in edges]})


def test_incomplete_equivalence(spark):
    cat = eq_catalog(spark, [("a", "b"), ("b", "c"), ("p", "q"), ("q", "r"), ("p", "r")])
    assert sorted(tuple(r) for r in gates.incomplete_equivalence(cat).collect()) == [("a", "c"), ("c", "a")]
    assert [(r.chip_id, r.missing) for r in gates.incomplete_equivalence_hubs(cat).collect()] == [("b", 2)]


def good(spark, **tables):
    rows = canonical_rows()
    rows["license"] = [{"license_id": "GPL-3.0-only", "name": "GPL", "is_osi_approved": 1}]
    rows["chip_role"] = [{"role_id": r, "label": r} for r in ("maincpu", "audiocpu", "sound", "video")]
    rows["dataset_meta"] = [{"key": k, "value": "1"} for k in gates.REQUIRED_META]
    rows["threshold"] = [{"name": "a.b", "value": 1.0}]
    rows.update(tables)
    return Catalog.from_rows(spark, rows)


def test_clean_catalogue_passes_every_gate(spark):
    cat = good(spark)
    assert gates.run_gates(cat, gates.PRE_CORRECTION) == [] and gates.run_gates(cat) == []


FIX = {"machine_id": "shinobi", "mame_tag": "maincpu", "chip_id": "m68000", "reason": "r"}


@pytest.mark.parametrize("code,tables", [
    ("RETIRED_ID_COLLISION", {"chip_name": [{"chip_id": "z80", "name": "m68000", "kind": "retired_id"}]}),
    ("STALE_EXTRACT", {"mame_device": [{"mame_device": "sega_315_5195", "ignore_reason": "x"}]}),
    ("DEPENDENCY_CYCLE", {"implementation_dependency": [{"consumer_id": "t80", "provider_id": "jt51"}, {"consumer_id": "jt51", "provider_id": "t80"}]}),
    ("DATASET_META_INCOMPLETE", {"dataset_meta": [{"key": "build_date", "value": "x"}]}),
    ("FOREIGN_KEY", {"implementation_chip": [{"implementation_id": "t80", "chip_id": "nope"}]}),
    ("UNIQUE", {"chip_name": [{"chip_id": "z80", "name": "A", "kind": "alias"}, {"chip_id": "m68000", "name": "A", "kind": "alias"}]}),
    ("CHECK", {"mame_device": [{"mame_device": "Bad Name", "ignore_reason": "x"}]}),
])
def test_each_gate_trips(spark, code, tables):
    failed = gates.run_gates(good(spark, **tables), {code: gates.POST_CORRECTION[code]})
    assert [f.code for f in failed] == [code]
    assert f"FAIL {code}" in str(failed[0])


@pytest.mark.parametrize("fix,stale", [
    ({**FIX, "op": "remove"}, False), ({**FIX, "op": "set", "quantity": 2}, False), ({**FIX, "op": "add"}, True),
    ({**FIX, "op": "remove", "chip_id": "z80"}, True), ({**FIX, "op": "add", "mame_tag": "new"}, False)])
def test_stale_correction(spark, fix, stale):
    assert (not gates.stale_correction(good(spark, machine_chip_correction=[fix])).isEmpty()) == stale


def test_corrections(spark):
    cat = good(spark, machine_chip_correction=[{**FIX, "op": "set", "quantity": 3}, {**FIX, "op": "remove", "mame_tag": "audiocpu", "chip_id": "z80"},
                                               {**FIX, "op": "add", "mame_tag": "new", "chip_id": "z80"}])
    got = {(r.mame_tag, r.chip_id): r.quantity for r in gates.apply_corrections(cat["machine_chip"], cat["machine_chip_correction"]).collect()}
    assert got == {("maincpu", "m68000"): 3, ("ym2151", "ym2151"): 1, ("gfx", "sega-315-5011"): 1, ("new", "z80"): 1}


def test_failure_message_shows_first_rows(spark):
    cat = good(spark, implementation_chip=[{"implementation_id": "t80", "chip_id": f"x{i}"} for i in range(25)])
    failure = gates.run_gates(cat, {"FOREIGN_KEY": gates.foreign_key_check})[0]
    assert failure.rows == 25 and len(failure.shown) == 20 and "… 5 more" in str(failure)


def test_fingerprint_ignores_order(spark):
    cat = good(spark)
    again = cat.with_tables(machine_chip=cat["machine_chip"].orderBy(F.rand(1)))
    names = ["machine_chip", "chip"]
    assert gates.rebuild_fingerprint(cat, names).collect() == gates.rebuild_fingerprint(again, names).collect()
    other = cat.with_tables(machine_chip=cat["machine_chip"].limit(2))
    assert gates.rebuild_fingerprint(cat, names).collect() != gates.rebuild_fingerprint(other, names).collect()


CORPUS = ["a", "a-b", "a--b", "-a", "a-", "A", "a_b", "a__b", "", "a.b", "a..b", ":device", "x:y", "x::y", "a/b.cpp", "a.cpp", "/a.cpp", "a//b.cpp", "Ab+1.v", "2020-01-02",
          "https://x", "http://", "https://x y", "a\n", "z" * 65, "GPL-3.0+", "JP"]


def test_grammars_agree_with_python(spark):
    import re

    df = spark.createDataFrame([(i, s) for i, s in enumerate(CORPUS)], "i int, s string")
    for name, (pattern, limit) in GRAMMARS.items():
        got = {r.i for r in df.filter(matches_grammar(F.col("s"), name)).collect()}
        want = {i for i, s in enumerate(CORPUS) if re.fullmatch(pattern.strip("^$"), s) and len(s) <= limit}
        assert got == want, name


# -- sources and sinks ----------------------------------------------------------------------

def test_bundles_and_rejects(spark, tmp_path):
    (tmp_path / "chip").mkdir()
    (tmp_path / "chip" / "z80.json").write_text('{"chip":[{"chip_id":"z80","display_name":"Z80"}],"chip_name":[{"chip_id":"z80","name":"b"},{"chip_id":"z80","name":"a"}]}')
    (tmp_path / "x.raw.json").write_text('{"chip":[{"chip_id":"no"}]}')
    read = bundles.read_row_bundles(spark, str(tmp_path), ["chip", "chip_name"])
    assert [(r.chip_id, r.model) for r in read["chip"].collect()] == [("z80", None)]
    assert bundles.rejected_cells(spark, str(tmp_path)).isEmpty()
    found = validation.row_order({"chip_name": read["chip_name"]}).collect()
    assert [(f.table, f.key) for f in found] == [("chip_name", "z80/a")]
    assert validation.filename_key(read).isEmpty()
    (tmp_path / "bad.json").write_text('{"chip":[{"chip_id":"q","display_name":null,"notes":[1],"nope":1}],"what":[],"system":{}}')
    (tmp_path / "worse.json").write_text("[1]")
    got = {(r.table, r.column, r.problem) for r in bundles.rejected_cells(spark, str(tmp_path)).collect()}
    assert got == {("chip", "display_name", "null cell"), ("chip", "notes", "nested cell"), ("chip", "nope", "unknown column"), ("what", "", "unknown table"),
                   ("system", "", "not an array"), ("", "", "not an object")}


@pytest.mark.parametrize("text,want", [
    ('{"chip":[{"chip_id":"q","display_name":null}]}', ("chip", 0, "display_name", "null cell")),
    ('{"chip":[{"chip_id":"q"},{"chip_id":["q"]}]}', ("chip", 1, "chip_id", "nested cell")),
    ('{"chip":[{"chip_id":true}]}', ("chip", 0, "chip_id", "neither text nor number")),
    ('{"chip":[{"chip_id":"q","typical_clock_hz":1.5}]}', ("chip", 0, "typical_clock_hz", "not a whole number")),
    ('{"chip":[{"chip_id":"q","typical_clock_hz":"4 MHz"}]}', ("chip", 0, "typical_clock_hz", "not a whole number")),
    ('{"chip":[{"colour":"red"}]}', ("chip", 0, "colour", "unknown column")), ('{"chip":[3]}', ("chip", 0, "", "row is not an object")),
    ('{"chip":{"chip_id":"q"}}', ("chip", None, "", "not an array")), ('{"weather":[]}', ("weather", None, "", "unknown table")),
    ("[1]", ("", None, "", "not an object")), ('{"chip":[', ("", None, "", "not an object")), (" ", ("", None, "", "not an object"))])
def test_bad_bundle_is_refused(spark, tmp_path, text, want):
    (tmp_path / "good.json").write_text('{"chip":[{"chip_id":"z80","display_name":"Z80","typical_clock_hz":4000000}]}')
    assert bundles.read_row_bundles(spark, str(tmp_path), ["chip"])["chip"].count() == 1
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(bundles.RejectedInput) as refused:
        bundles.read_row_bundles(spark, str(tmp_path), ["chip_name"])  # whatever table is asked for
    assert refused.value.count == 1 and [e[1:] for e in refused.value.examples] == [want]


@pytest.mark.parametrize("record,problem", [('<machine sourcefile="x"><description>N</description></machine>', "no name"),
                                            ('<machine name="x"><description>B</descr></machine>', "unreadable")])
def test_bad_listing_is_refused(spark, tmp_path, record, problem):
    (tmp_path / "l.xml").write_text(XML.replace("</mame>", record + '<machine name="z"><description>Z</description></machine></mame>'))
    with pytest.raises(bundles.RejectedInput) as refused:
        listing.read_machine_listing(spark, str(tmp_path))
    assert [e[0] for e in refused.value.examples] == [problem]


def test_filename_lints(spark):
    rows = [Row(_file="d/chip/z80.json", _pos=0, chip_id="z81"), Row(_file="d/chip/two.json", _pos=0, chip_id="a"), Row(_file="d/chip/two.json", _pos=1, chip_id="two")]
    out = validation.filename_key({"chip": spark.createDataFrame(rows)}).collect()
    assert sorted((r.file, r.key) for r in out) == [("d/chip/two.json", "two"), ("d/chip/z80.json", "z81")]


def test_defaults(spark):
    df = spark.createDataFrame([("s", "r", "c", None)], "system_id string, role_id string, chip_id string, quantity long")
    assert bundles.load_lookup_defaults(df, "system_chip").first().quantity == 1


def test_thresholds(spark):
    config = {"a": {"b": 1, "c": "text"}, "stale_review_days": 365, "flag": True}
    assert bundles.flatten_thresholds(config) == [("a.b", 1.0), ("stale_review_days", 365.0)]
    assert bundles.load_thresholds(spark, config, ("stale_review_days",)).count() == 2
    with pytest.raises(ValueError, match="missing.one"):
        bundles.load_thresholds(spark, config, ("missing.one",))


def test_raw_extract(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"mame_version":"0.288",\n"machines":[{"machine_id":"a"},{"machine_id":"b"}]}')
    head, rows = bundles.read_raw_extract(spark, str(tmp_path / "m.json"), "machines", "struct<machine_id:string>")
    assert head.first()[0] == "0.288" and rows.count() == 2
    (tmp_path / "n.json").write_text('{"machines":[]}')
    with pytest.raises(ValueError):
        bundles.read_raw_extract(spark, str(tmp_path / "n.json"), "machines", "struct<machine_id:string>")
    (tmp_path / "l.json").write_text('{"mame_version":"0.288","machines":[]}\n{"machines":[{"machine_id":"a"}]}')
    with pytest.raises(ValueError):
        bundles.read_raw_extract(spark, str(tmp_path / "l.json"), "machines", "struct<machine_id:string>", lines=True)


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.md").write_text("three")
    got = bundles.read_documents(spark, str(tmp_path), "*.txt").collect()
    assert [r.text for r in got] == ["one\ntwo"]


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "cat")
    some = {"FOREIGN_KEY": gates.foreign_key_check}
    sinks.publish_catalog(good(spark), path, gates=some)
    before = Catalog.from_parquet(spark, path)["chip"].count()
    with pytest.raises(sinks.GateFailure, match="FOREIGN_KEY"):
        sinks.publish_catalog(good(spark, chip=[], implementation_dependency=[]), path, gates=some)
    assert Catalog.from_parquet(spark, path)["chip"].count() == before == 4
    assert versions.expire_versions(spark, path) == []  # the refused version left nothing behind


def test_publish_survives_a_failure_at_the_switch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cat")
    some = {"FOREIGN_KEY": gates.foreign_key_check}
    with monkeypatch.context() as m:  # the very first publish fails: there is still nothing to read
        m.setattr(versions, "rename_over", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            sinks.publish_catalog(good(spark), path, gates=some)
        assert versions.read_pointer(spark, path) is None
    opened = sinks.publish_catalog(good(spark), path, gates=some)
    first = versions.read_pointer(spark, path)
    assert first["previous"] is None and set(first["tables"]) == set(TABLES)
    with monkeypatch.context() as m:
        m.setattr(versions, "rename_over", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            sinks.publish_catalog(good(spark, machine=[], machine_chip=[], machine_unmapped_device=[]), path, gates={})
    assert versions.read_pointer(spark, path) == first
    kept = Catalog.from_parquet(spark, path)["machine"].count()
    assert kept == good(spark)["machine"].count() > 0
    sinks.publish_catalog(good(spark, machine=[], machine_chip=[], machine_unmapped_device=[]), path, gates={})
    assert Catalog.from_parquet(spark, path)["machine"].count() == 0
    assert opened["machine"].count() == kept  # opened before the switch: still its own version
    assert len(versions.expire_versions(spark, path)) == 2  # the two that failed
    assert versions.read_pointer(spark, path)["previous"] == first["version"] and opened["machine"].count() == kept


def test_row_tables_remove_stale(spark, tmp_path):
    cat = good(spark)
    sinks.write_row_tables({"machine": cat["machine"]}, str(tmp_path))
    assert (tmp_path / "machine").exists()
    sinks.write_row_tables({"machine": cat["machine"].limit(0)}, str(tmp_path))
    assert not (tmp_path / "machine").exists()


# -- parts and text ----------------------------------------------------------------------------

REC = parts.Recognition(vendor_prefixes=("SEGA", "SEGAX", "NEC"), grammars=(parts.Grammar("custom", "[0-9]{3}-[0-9]{4}", True),), context_pattern="custom|ic",
                        part_aliases={"sixty eight": "m68000"}, ignored_parts=("DIP40",), min_literal_length=3)


@pytest.mark.parametrize("text,want", [("µPD-7759", "UPD7759"), ("Sega 315-5296", "3155296"), ("SEGA", "SEGA"), ("Sega X", "SEGAX"), ("SegaX12", "12"), ("z80", "Z80")])
def test_normalise(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(parts.normalize_without_vendor(F.col("s"), REC)).first()[0] == want


def part_catalog(spark):
    return Catalog.from_rows(spark, {
        "chip": [{"chip_id": c, "display_name": d} for c, d in (("m68000", "MC68000"), ("sh2", "SH-2 (SH7604)"), ("a1", "Twin"), ("a2", "Twin"), ("ay", "AY-3-8910"), ("mc6800", "MC6800"))],
        "chip_name": [{"chip_id": "sh2", "name": "HD6417095", "kind": "alias"}]})


def test_index_and_resolution(spark):
    cat = part_catalog(spark)
    index = parts.chip_index(cat, REC)
    keys = {r.key: r.chip_id for r in index.collect()}
    assert keys["SH7604"] == keys["SH2"] == "sh2" and "TWIN" not in keys and keys["SIXTYEIGHT"] == "m68000"
    asked = spark.createDataFrame([("Sega SH7604",), ("dip-40",), ("x",), ("new9",)], "designation string")
    assert {r.designation: r.key for r in parts.resolve_part(asked, index, REC).collect()} == {"Sega SH7604": "chip:sh2", "new9": "part:NEW9"}


def test_scan(spark):
    cat = part_catalog(spark)
    text = "uses MC68000 and AY38910, ay 3 8910\nXMC68000 MC680001\n  315-5197 plain\n  315-5197 - Custom IC   here\nAY3-8910/AY-38910 A-Y38910"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = sorted((r.line, r.designation, r.rule) for r in parts.scan_parts(docs, parts.catalogue_names(cat), REC).collect())
    assert got == [(1, "AY38910", "catalog"), (1, "MC68000", "catalog"), (4, "315-5197", "custom"), (5, "AY3-8910", "catalog")]
    long = parts.scan_parts(spark.createDataFrame([("d", "MC68000 " + "y" * 300)], "doc_id string, text string"), parts.catalogue_names(cat), REC).first()
    assert len(long.evidence) == 160 and long.evidence.endswith("…")


def test_scan_long_names_share_their_beginning(spark):
    words = [f"word{i}" for i in range(40)]
    names = [" ".join(words[:n]) for n in (6, 7, 12, 39, 40)] + ["µPD 77", "word5"]
    forms = spark.createDataFrame([(n,) for n in names], "form string")
    lines = [" ".join(words), "-".join(words[:39]) + "  word39", "".join(words[:12]) + " word13, word5", "x" + " ".join(words[:7]), "uPD77; ΜPD 77 UPD-77", "K word5", ""]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id int, text string")
    got = sorted((r.line, r.designation) for r in parts.scan_parts(docs, forms, parts.Recognition()).collect())
    assert got == sorted([(1, " ".join(words)), (2, "-".join(words[:39])), (3, "".join(words[:12])), (3, "word5"), (4, "word5"), (5, "uPD77"), (6, "word5")])


def brute_scan(line, names):
    import re

    ordered = sorted(names, key=lambda n: (-len(n), n))
    pattern = "(?<![A-Za-z0-9])(?:" + "|".join("[^A-Za-z0-9]?".join(re.findall("[A-Za-z0-9]+", n)) for n in ordered) + ")(?![A-Za-z0-9])"
    return {re.sub("[^A-Z0-9]", "", m.upper()) for m in re.findall(pattern, line, re.I)}


def test_scan_against_regex(spark):
    rng = random.Random(2)
    names = ["ab-1", "ab1c", "ab-1-c", "c-ab", "1-c", "abc", "c1 ab 1"]
    lines = ["".join(rng.choice(["ab", "1", "c", "-", " ", ".", "ab1", "--"]) for _ in range(rng.randint(3, 12))) for _ in range(150)]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "doc_id int, text string")
    forms = spark.createDataFrame([(n,) for n in names], "form string")
    got = {}
    for r in parts.scan_parts(docs, forms, parts.Recognition(min_literal_length=3)).collect():
        got.setdefault(r.doc_id, set()).add(r.designation.upper())
    import re

    for i, s in enumerate(lines):
        assert {re.sub("[^A-Z0-9]", "", d) for d in got.get(i, set())} == brute_scan(s, names), s


SOURCE = '''// first board
// second line

/* block
   two */
ROM_START( alpha )
  LOAD("http://not/a comment", 'x')
ROM_END
//
/* far */



ROM_START( beta )
char *s = "a\\"b // no"; // tail
ROM_START
 ( gamma )
'''


def test_comments_and_markers(spark):
    docs = spark.createDataFrame([("f", SOURCE)], "doc_id string, text string")
    blocks = source_text.extract_comments(docs)
    got = [(r.line, r.end_line, r.text) for r in blocks.orderBy("block").collect()]
    assert got == [(1, 5, " first board\n second line\n\n block\n   two "), (10, 10, " far "), (15, 15, " tail")]
    marks = source_text.markers(docs)
    assert [(r.line, r.machine_id) for r in marks.orderBy("line").collect()] == [(6, "alpha"), (14, "beta"), (16, "gamma")]
    at = {r.line: r.machine_id for r in source_text.attach_markers(blocks, marks).collect()}
    assert at == {1: "alpha", 10: None, 15: "gamma"}


def test_driver_comments_become_witness_rows(spark):
    cat = Catalog.from_rows(spark, {
        "chip": [{"chip_id": "z80", "display_name": "Z80"}, {"chip_id": "ay", "display_name": "AY-3-8910"}],
        "system": [{"system_id": s, "name": s} for s in ("s1", "s2", "s3")],
        "machine": [{"machine_id": m, "name": m, "mame_sourcefile": f} for m, f in (("a", "x/one.cpp"), ("b", "x/one.cpp"), ("c", "x/two.cpp"), ("d", "x/two.cpp"))],
        "machine_system": [{"machine_id": m, "system_id": s, "reason": "r"} for m, s in (("a", "s2"), ("c", "s1"), ("d", "s2"))],
        "system_driver": [{"mame_sourcefile": "x/one.cpp", "system_id": "s3"}]})
    one = "/* Z80\n SEGA 315-5296 custom */\n\nROM_START( a )\n// AY38910\n\n\n\n\nROM_START( b )\n// Z80\nROM_START( nobody )\nx = \"Z80\";\n"
    two = "int x; // uses z80 and Z-80\n"
    src = spark.createDataFrame([("1", "x/one.cpp", one), ("2", "x/two.cpp", two), ("3", "x/none.cpp", two)], "doc_id string, mame_sourcefile string, text string")
    blocks = source_text.attach_markers(source_text.extract_comments(src), source_text.markers(src)).join(src.select("doc_id", "mame_sourcefile"), "doc_id")
    rows = reconcile.source_witness(cat, blocks, parts.catalogue_names(cat), parts.chip_index(cat, REC), REC, "u")
    got = sorted((r.system_id, r.key, r.designation, r.source_url, r.evidence) for r in rows.collect())
    assert set(rows.columns) == set(reconcile.FIELDS)
    assert got == sorted([
        ("s2", "chip:z80", "Z80", "u/x/one.cpp#L1", "x/one.cpp (a): Z80"),  # the marked machine's family
        ("s2", "part:3155296", "315-5296", "u/x/one.cpp#L2", "x/one.cpp (a): SEGA 315-5296 custom"),
        ("s3", "chip:ay", "AY38910", "u/x/one.cpp#L5", "x/one.cpp: AY38910"),  # out of reach: what the file declares
        ("s1", "chip:z80", "z80", "u/x/two.cpp#L1", "x/two.cpp: uses z80 and Z-80"),  # nothing declared: what it reaches
        ("s2", "chip:z80", "z80", "u/x/two.cpp#L1", "x/two.cpp: uses z80 and Z-80")])


def test_markup(spark):
    text = "a<ref name=x/>b<ref>cite</ref>c<!-- no -->d {{t|{{u}}}} [[Zilog Z80|Z80]] [[Amiga]] '''bold''' x&nbsp;&amp;"
    got = spark.createDataFrame([(text,)], "s string").select(source_text.strip_markup(F.col("s"))).first()[0]
    assert " ".join(got.split()) == "a b c d Zilog Z80 Amiga bold x &"


@pytest.mark.parametrize("text,want", [("{{a}} b }} c", "  b }} c"), ("x {{open {{t}} y", "x {{open   y"), ("{{a{b}c}}d", " d"), ("<references/>r", " r"), (None, None), ("", ""),
                                       ("<!-- <ref> -->a<ref group=n>b<b>c</b></ref>d", " a d"), ("{{" * 12 + "deep" + "}}" * 12, " "), ("[[a|b|c", "[[a|b|c")])
def test_markup_cases(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(source_text.strip_markup(F.col("s"))).first()[0] == want


def test_modules(spark):
    docs = spark.createDataFrame([("a.v", "module top;\n  jt51 u_jt51(\n.clk(clk));\n z80 #(.A(1),\n .B(2)) u_cpu (\n"), ("files.yaml", "jt51:\n  - x: 1\nt80:\n")], "path string, text string")
    got = sorted((r.path, r.line, r.module) for r in source_text.module_instances(docs).collect())
    assert got == [("a.v", 2, "jt51"), ("a.v", 4, "z80"), ("files.yaml", 1, "jt51"), ("files.yaml", 3, "t80")]


def test_api_responses(spark):
    body = '{"query":{"pages":[{"title":"A","revisions":[{"revid":7,"slots":{"main":{"content":"x"}}}]},{"title":"B","missing":true}],"redirects":[{"from":"Z","to":"A"}],"normalized":[{"from":"z","to":"Z"}]}}'
    df = spark.createDataFrame([(body,), ("not json",)], "body string")
    assert [tuple(r) for r in bundles.wikipedia_articles(df).collect()] == [("A", 7, "x")]
    titles = spark.createDataFrame([("z",), ("q",)], "title string")
    assert {r.title: r.resolved for r in source_text.resolve_title(titles, bundles.title_aliases(df)).collect()} == {"z": "A", "q": "q"}
    sparql = '{"results":{"bindings":[{"item":{"value":"http://x/Q1"},"prop":{"value":"P880"},"valueLabel":{"value":"Zilog Z80"}},{"item":{"value":"http://x/Q1"},"prop":{"value":"P1"},"valueLabel":{"value":"Q99"}}]}}'
    assert [tuple(r) for r in source_text.statement_parts(spark.createDataFrame([(sparql,)], "body string")).collect()] == [("Q1", "P880", "Zilog Z80")]


# -- reconciliation ------------------------------------------------------------------------------

def test_findings(spark):
    rows = [("mame-listxml", "chip:m68000", "m68000", "m68000", "mapped", 40), ("mame-listxml", "chip:93c46", "93c46", "93c46", "mapped", 4),
            ("mame-listxml", "part:UPD4701A", "upd4701a", None, "unmapped", 2), ("mame-source", "chip:m68000", "MC68000", "m68000", None, None),
            ("mame-source", "part:CPSB01", "CPS-B-01", None, None, None), ("jtcores", "part:UPD4701A", "uPD4701A", None, None, None)]
    df = spark.createDataFrame([("cps1", w, k, d, c, s, f"https://{w}", "e", n) for w, k, d, c, s, n in rows],
                               "system_id string, witness string, key string, designation string, chip_id string, mame_state string, source_url string, evidence string, machine_count long")
    collapsed = reconcile.collapse_parts(df)
    found = reconcile.classify_findings(collapsed, spark.createDataFrame([("cps1", 40)], "system_id string, machines long"))
    got = {r.key: (r.classification, r.mame_state, r.machine_share, r.designation, r.witnesses) for r in found.collect()}
    assert got == {"chip:m68000": ("agreed", "mapped", 1.0, "MC68000", "mame-listxml,mame-source"), "chip:93c46": ("mame-only", "mapped", 0.1, "93c46", "mame-listxml"),
                   "part:CPSB01": ("reference-only", "absent", None, "CPS-B-01", "mame-source"),
                   "part:UPD4701A": ("agreed", "unmapped", 0.05, "uPD4701A", "mame-listxml,jtcores")}
    assert [r.key for r in reconcile.ordered_findings(found).collect()] == ["part:CPSB01", "chip:93c46", "chip:m68000", "part:UPD4701A"]
    summary = {(r.section, r.name): r.value for r in reconcile.reconcile_summary(collapsed, found).collect()}
    assert summary["summary", "agreed"] == 2 and summary["summary", "agreed_unmapped_in_mame"] == 1 and summary["witness_parts", "mame-source"] == 2
    nested = reconcile.merge_witnesses(collapsed).first()
    assert [w.witness for w in nested.witnesses] == ["mame-listxml", "mame-source", "jtcores"]


GUARDED = guard.GuardPolicy(domains=("bad.com",), fetch_verbs=("fetch(", "curl "))


@pytest.mark.parametrize("path,text,want", [
    ("a.ts", "// see bad.com for more", {1: "prose"}),
    ("a.ts", "const u = 'https://bad.com/x'", {1: "fetch"}),
    ("a.ts", "const h = 'bad.com';", {1: "fetch"}),
    ("a.ts", "const h = 'the bad.com site';", {1: "prose"}),
    ("a.ts", "const h = 'the bad.com site';\nfetch(h)", {1: "fetch"}),
    ("a.ts", "// the bad.com site\nfetch(h)", {1: "prose"}),
    ("a.ts", "x = 'bad' +\n 'xx';\ny = 'https://b' + 'ad.com/z'", {3: "fetch"}),
    ("a.ts", "bad.community notbad.com", {}),
    ("r.md", "We cite bad.com here\ncurl x", {1: "prose"}),
    ("r.md", "```\ncurl bad.com\n```\nbad.com", {2: "fetch", 4: "prose"}),
    ("data/a.json", '{\n"source_url": "https://bad.com/1",\n"machine_id": "bad.com"\n}', {2: "citation", 3: "fetch"}),
    ("config/a.json", '{"host": "bad.com"}', {1: "prose"}),
    ("a.ts", "go to https://www.bad.com now\n\n\n\n\nsee my-site.bad.com now", {1: "fetch", 6: "prose"}),
    ("a.ts", "const h = 'api.my-site.bad.com';\nconst g = `bad.com`;", {1: "fetch", 2: "prose"}),
    ("r.md", "see https://www.bad.com", {1: "prose"}),
    ("config/a.json", '{"host": "https://api.bad.com"}', {1: "fetch"}),
    ("a.ts", "x = 'https://user.bad.community/bad.com/a'", {1: "fetch"}),
    ("s.py", "# bad.com\ncurl = 1", {1: "prose"}),
])
def test_guard(spark, path, text, want):
    docs = spark.createDataFrame([(path, text)], "path string, text string")
    assert {r.line: r.disposition for r in guard.domain_guard(docs, GUARDED).collect()} == want


# -- search ------------------------------------------------------------------------------------------

def test_search_ranks_and_limits(spark):
    chips = [{"chip_id": f"c{i}", "display_name": f"Z80 type {i}", "function_id": "cpu"} for i in range(9)] + [{"chip_id": "z80", "display_name": "Zilog", "function_id": "cpu"}]
    cat = Catalog.from_rows(spark, {"chip": chips, "chip_name": [{"chip_id": "c3", "name": "z80", "kind": "alias"}],
                                    "system": [{"system_id": "sys", "name": "My Z80 box", "kind_id": "k"}]})
    terms = spark.createDataFrame([(" Z80 ",), ("x",), ("%",), ("80 b",)], "t string")
    rows = search.global_search(cat, terms).orderBy("needle", "position").collect()
    got = [(r.id, r["rank"]) for r in rows if r.needle == "z80"]
    assert got[0] == ("z80", 0) and got[1] == ("c3", 1) and len(got) == 6 and got[-1] == ("sys", 4)
    assert [(r.id, r["rank"]) for r in rows if r.needle == "80 b"] == [("sys", 4)]
    assert {r.needle for r in rows} == {"z80", "80 b"}


def test_every_table_has_a_schema():
    assert len(TABLES) == 36 and all(set(t.key) <= set(t.names) for t in TABLES.values())


def test_devices_of_kept_machines_are_shuffled_once(spark):
    """The machines are met before the fold: no list of ids in one task, and the fold adds no shuffle."""
    refs = spark.createDataFrame([("m1", ":a", "d1", 1), ("m1", ":a", "d2", 2), ("m1", ":", "d3", 3), ("m2", ":a", "d4", 1), ("m3", "::b", "d5", 1)],
                                 "machine_id string, tag string, device string, pos long")
    chips = spark.createDataFrame([("m1", "a", "cpu", "Z80", "4", 1), ("m1", "a", "audio", "YM", "4x", 2), ("m2", "a", "cpu", "Z80", "4", 1), ("m3", ":b", "cpu", "P", "\u0664", 1)],
                                  "machine_id string, tag string, type string, name string, clock string, pos long")
    kept = spark.createDataFrame([("m1",), ("m3",)], "machine_id string")
    got = extraction.join_device_chip(refs, chips, kept)
    assert sorted(map(tuple, got.collect())) == [("m1", "a", "d2", ["audio", "cpu"], "Z80", 4), ("m3", ":b", "d5", None, None, None)]
    every = extraction.join_device_chip(refs, chips).join(kept, "machine_id", "left_semi")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.index("ObjectHashAggregate") < plan.index("Union") < plan.index("Exchange")


def test_comment_blocks_are_read_from_source_once(bound):
    from bomscope.registry import QUERIES

    for name in ("rec8_attach_rom_starts", "rec9_attribute_blocks", "rec9_source_witness", "rec17_collapse_parts"):
        plan = QUERIES[name](bound)._jdf.queryExecution().optimizedPlan().toString()
        assert "// board" not in plan and "ROM_START" not in plan, name


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_steps_leave_no_shuffle_files(spark):
    from bomscope.llm.common import staged
    from bomscope.session import written

    df = spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.collect_list("id").alias("ids"))
    for store in (written, lambda x: staged(x, "test")):
        before, stored, ends = _shuffle_files(spark), store(df), time.time() + 20
        while _shuffle_files(spark) - before and time.time() < ends:  # they go in the background
            time.sleep(0.1)
        assert not _shuffle_files(spark) - before
        assert stored.count() == 50 and store(df).count() == 50


def test_listing_is_compressed_and_reads_back(spark, tmp_path):
    one = "device_refs array<struct<tag:string,name:string>>, chips array<struct<type:string,tag:string,name:string,clock:string>>"
    rows = [(f"m{i}", f"Board <{i}> & more", "a/b.cpp", "1990", "X", "good", "no", None, "no", None, None, None,
             [(f":t{k}", f"d{k}") for k in range(9)], [("cpu", f"t{k}", f"Part {k}", "1000") for k in range(9)]) for i in range(500)]
    names = "machine_id string, name string, mame_sourcefile string, mame_year string, mame_manufacturer string, driver_status_raw string, isbios string, isdevice string, ismechanical string, runnable_raw string, cloneof string, romof string, "
    machines = spark.createDataFrame(rows, names + one)
    path = str(tmp_path / "listing")
    listing.write_machine_listing(machines, path)
    back = listing.read_machine_listing(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, machines.select(*back.columns).collect()))
    parts = list((tmp_path / "listing").glob("part-*"))
    assert parts and sum(p.stat().st_size for p in parts) < 500 * 18 * 20


def test_records_of_a_family_are_bounded(spark, tmp_path):
    from bomscope.registry import _flat_records

    kinds = "system_id string, witness string, key string, designation string, chip_id string, mame_state string, source_url string, evidence string, machine_count long"
    rows = [(s, w, f"k{n}", f"d{n}", None if n % 3 else f"c{n}", None, "u", "e", None) for s, most in (("a", 25), ("b", 3), (None, 7))
            for w in ("wikipedia", "mame-listxml", "elsewhere", None) for n in range(most)] + [("a", "wikipedia", "k1", "d0", None, None, "u", "e", 1)]
    df = spark.createDataFrame(rows, kinds).repartition(5)
    whole = sorted(map(str, _flat_records(reconcile.merge_witnesses(df)).collect()))
    assert len(whole) == len(rows) and reconcile.merge_witnesses(df).count() == 3
    small = reconcile.merge_witnesses(df, 10)
    assert small.count() == 11 + 2 + 3 and sorted(map(str, _flat_records(small).collect())) == whole
    assert small.select(F.aggregate("witnesses", F.lit(0), lambda n, w: n + F.size(w["parts"])).alias("n")).agg(F.max("n")).first()[0] == 10
    sinks.write_reconciliation(small, df, str(tmp_path))
    back = spark.read.schema(small.schema).json(f"{tmp_path}/records")
    assert sorted(map(str, _flat_records(back).collect())) == whole
