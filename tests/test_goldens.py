"""Hand-derived results on literal catalogues."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from bomscope.catalog import Catalog
from bomscope.plans import browse, canonical, prospect, views  # noqa: F401
from fixtures import canonical as canonical_rows
from fixtures import coverage as coverage_rows


@pytest.fixture(scope="module")
def g1(spark):
    return Catalog.from_rows(spark, canonical_rows())


@pytest.fixture(scope="module")
def g2(spark):
    return Catalog.from_rows(spark, coverage_rows())


def test_bom_counts(g1):
    got = {r.chip_id: r.implementations for r in canonical.system_bom_counts(g1, "sega-system16a").collect()}
    assert got == {"m68000": 1, "ym2151": 1, "z80": 1, "sega-315-5011": 0}


def test_candidates_exclude_cored_platform(g1):
    rows = canonical.prospector_simple(g1).collect()
    assert [(r.platform_id, r.chips_total, r.chips_satisfied, r.satisfied_pct, r.unmapped_device_count, r.confidence) for r in rows] == [("pocket", 4, 3, 75.0, 1, "medium")]


def test_dependency_closure_depth_and_paths(g1):
    got = sorted((r.depth, r.implementation_id, r.path, r.is_top) for r in canonical.dependency_closure(g1).collect())
    assert got == [(1, "fx68k", "fx68k.sv", 1), (1, "jt51", "hdl/jt51.v", 1), (1, "jt51", "hdl/jt51_op.v", 0), (1, "t80", "T80.vhd", 1)]


EXPECTED = {  # family: total direct equivalent provided satisfied unmapped confidence
    "fx-symmetric": (4, 2, 1, 0, 3, 0, "medium"), "fx-68k-hit": (2, 1, 0, 1, 2, 0, "medium"), "fx-68k-miss": (3, 2, 0, 0, 2, 0, "high"),
    "fx-68k-notrans": (2, 1, 0, 0, 1, 0, "high"), "fx-2a03": (3, 2, 0, 0, 2, 0, "high"), "fx-unmapped-med": (5, 5, 0, 0, 5, 1, "medium"),
    "fx-unmapped-low": (4, 4, 0, 0, 4, 2, "low"), "fx-kind": (3, 1, 0, 0, 1, 0, "high"), "fx-empty": (0, 0, 0, 0, 0, 0, "low"),
}


def test_coverage_table(g2):
    rows = g2["v_system_coverage_by_kind"].collect()
    got = {r.system_id: (r.chips_total, r.chips_direct, r.chips_equivalent, r.chips_provided, r.chips_satisfied, r.unmapped_device_count, r.confidence)
           for r in rows if r.kind_id == "fpga_hdl"}
    assert got == EXPECTED
    kind = {r.kind_id: r.chips_satisfied for r in rows if r.system_id == "fx-kind"}
    assert kind == {"fpga_hdl": 1, "software_emulation": 3, "original_silicon": 0}
    assert {r.satisfied_share for r in rows if r.system_id == "fx-empty"} == {0.0}


def test_provider_tie_takes_lowest_id(g2):
    row = g2["v_chip_evidence"].filter("chip_id = 'fx-tie-socket' AND kind_id = 'fpga_hdl'").first()
    assert (row.best_via, row.provider_chip_id, row.confidence) == ("provides", "fx-tie-hi", "low")


def test_substitution_is_one_hop(g2):
    assert g2["v_chip_evidence"].filter("chip_id = 'm68000'").isEmpty()


def ranking(cat, platform, policy=prospect.DEFAULT):
    rows = prospect.prospect_rank(cat, policy).filter(F.col("platform_id") == platform).orderBy("rank").collect()
    return [(r["rank"], r.system_id, r.score) for r in rows], rows


def test_ranking_scores(g2):
    got, _ = ranking(g2, "pocket")
    assert got == [(1, "fx-unmapped-med", .768036), (2, "fx-68k-miss", .733334), (3, "fx-2a03", .666667), (4, "fx-68k-hit", .6375), (5, "fx-symmetric", .56695),
                   (6, "fx-68k-notrans", .5), (7, "fx-unmapped-low", .31625), (8, "fx-kind", .244444), (9, "fx-empty", 0.0)]


def test_ranking_excludes_cored_family_but_keeps_it_as_mate(g2):
    got, rows = ranking(g2, "mister")
    assert len(got) == 8 and "fx-symmetric" not in {s for _, s, _ in got}
    mate = {r.system_id: (r.mate_system_id, r.mate_shared_chips) for r in rows}
    assert mate["fx-68k-miss"] == ("fx-symmetric", 2) and mate["fx-2a03"] == (None, 0)


def test_flat_policy_lifts_unmapped_board(g2):
    flat = replace(prospect.DEFAULT, unmapped_weight=0.0, confidence_medium=1.0, confidence_low=1.0)
    got, _ = ranking(g2, "pocket", flat)
    assert got[1] == (2, "fx-unmapped-low", 1.265)


@pytest.mark.parametrize("light", [0, 1, 2, 64])
def test_best_mate_equals_all_pairs(g2, light):
    want = {}
    for r in prospect.system_mates(g2).collect():
        key = (-r.shared_chips, r.mate_system_id)
        want[r.system_id] = min(want.get(r.system_id, key), key)
    got = {r.system_id: (-r.shared_chips, r.mate_system_id) for r in prospect.best_mate(g2, light=light).collect()}
    assert got == want


def test_breakdown_lists(g2):
    rows = {r.system_id: r.breakdown for r in prospect.prospect_breakdown(g2).filter("platform_id = 'pocket'").collect()}
    kind = rows["fx-kind"]
    assert [(m.chip_id, m.weight) for m in kind.chips.missing] == [("sega-315-5011", 5.0), ("ym2151", 2.0)]
    assert kind.cpu_sound_complete.missing_chip_ids == ["ym2151"]
    assert [(v.chip_id, v.via, v.provider_chip_id) for v in rows["fx-68k-hit"].chips.via_edge] == [("m68010", "provides", "m68020")]
    assert rows["fx-empty"].chips.missing == []


def test_score_is_product_of_factors(g2):
    for r in prospect.prospect_breakdown(g2).collect():
        b = r.breakdown
        product = b.readiness.value * b.confidence.factor * b.system_mate_core.factor * b.cpu_sound_complete.factor
        assert abs(r.score - product) <= 5.1e-7


def test_caveats(g2):
    got = {r.system_id: len(r.caveats) for r in prospect.prospect_caveats(g2).filter("platform_id = 'pocket'").collect()}
    assert got["fx-2a03"] == 0 and got["fx-unmapped-low"] == 2 and got["fx-68k-hit"] == 2


def test_null_override_means_no_system(spark, g1):
    over = g1.with_tables(machine_system=spark.createDataFrame([("shinobi", None, "x")], "machine_id string, system_id string, reason string"))
    assert over["v_machine_system"].first().system_id is None
    assert g1["v_machine_system"].first().system_id == "sega-system16a"


def test_mapped_share(spark, g1):
    share = g1["v_quality_instance"].first()
    assert (share.mapped_instances, share.unmapped_instances, share.mapped_instance_share) == (4, 1, 0.8)
    empty = Catalog.from_rows(spark, {})
    assert empty["v_quality_instance"].first().mapped_instance_share == 1.0


def test_results_do_not_depend_on_partitioning(g2):
    shuffled = g2.with_tables(**{t: g2[t].repartition(7).orderBy(F.rand(3)) for t in ("system_chip", "implementation_chip", "chip_equivalence")})
    a = {tuple(r) for r in g2["v_system_coverage_by_kind"].collect()}
    assert a == {tuple(r) for r in shuffled["v_system_coverage_by_kind"].collect()}


def test_chip_browser_status_filter(g2):
    chips = browse.chip_browser(g2)
    assert {r.chip_id for r in browse.chip_filter_sort(chips, status="equivalent").collect()} == {"m68010", "ym2612", "fx-tie-socket"}
    assert "m68000" in {r.chip_id for r in browse.chip_filter_sort(chips, status="missing").collect()}
