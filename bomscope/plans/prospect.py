"""Weighted, explained ranking of board families that have no core yet on a platform.

All platforms are ranked in one plan; the per-board explanation lists come from the same
socket relation by aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bomscope.catalog import view
from bomscope.functions.columns import any_text, round6
from bomscope.operators.ranking import number_rows
from bomscope.plans.views import FPGA
from bomscope.session import written


@dataclass(frozen=True)
class Policy:
    """The shipped scoring policy."""

    band_hard: float = 5.0
    band_medium: float = 2.0
    band_soft: float = 1.0
    credit_equivalent: float = 0.9
    credit_provides: float = 0.5
    confidence_high: float = 1.0
    confidence_medium: float = 0.85
    confidence_low: float = 0.5
    bonus_system_mate: float = 0.1
    bonus_cpu_sound: float = 0.15
    mate_min_shared: int = 2
    unmapped_weight: float = 4.0


DEFAULT = Policy()
LIGHT = 64  # a chip on more cored families is heavy: its families are never paired through it one by one


def socket_detail(cat, policy: Policy = DEFAULT) -> DataFrame:
    band, rank = F.col("band"), F.col("evidence_rank")
    functions = cat["chip_function"].select("function_id", F.col("prospector_band").alias("band"))
    kinds = cat["chip"].select("chip_id", "function_id").join(functions, "function_id")
    return (cat["v_system_chip_coverage"].filter(F.col("kind_id") == FPGA).join(kinds, "chip_id")
            .select("system_id", "chip_id", "evidence_rank", "satisfied_via", "provider_chip_id", "band",
                    F.when(band == "hard", policy.band_hard).when(band == "medium", policy.band_medium)
                    .otherwise(policy.band_soft).cast("double").alias("weight"),
                    F.when(rank == 1, 1.0).when(rank == 2, policy.credit_equivalent)
                    .when(rank == 3, policy.credit_provides).otherwise(0.0).cast("double").alias("credit"),
                    F.col("function_id").isin("cpu", "mcu").cast("int").alias("is_cpu"),
                    F.startswith("function_id", F.lit("sound-")).cast("int").alias("is_sound")))


def socket_rollup(cat, policy: Policy = DEFAULT) -> DataFrame:
    """Per family: weights, satisfied and missing sockets per band, cpu and sound totals.

    The satisfied weight is assembled from counts per (band, route), so it does not depend
    on the order in which doubles are added.
    """
    rank, band = F.col("evidence_rank"), F.col("band")
    weights = {"hard": policy.band_hard, "medium": policy.band_medium, "soft": policy.band_soft}
    credits = {1: 1.0, 2: policy.credit_equivalent, 3: policy.credit_provides}
    counts = [F.count_if((band == b) & (rank == r)).alias(f"{b}_{r}") for b in weights for r in (1, 2, 3, 4)]
    flags = [F.sum(c).alias(f"{n}_chips") for n, c in (("cpu", "is_cpu"), ("sound", "is_sound"))]
    flags += [F.count_if((F.col(c) == 1) & (rank < 4)).alias(f"{n}_satisfied") for n, c in (("cpu", "is_cpu"), ("sound", "is_sound"))]
    df = socket_detail(cat, policy).groupBy("system_id").agg(*counts, *flags)

    def satisfied(b):
        return F.col(f"{b}_1") + F.col(f"{b}_2") + F.col(f"{b}_3")

    total = sum((F.lit(w) * (satisfied(b) + F.col(f"{b}_4")) for b, w in weights.items()), F.lit(0.0))
    earned = sum((F.lit(w * c) * F.col(f"{b}_{r}") for b, w in weights.items() for r, c in credits.items()), F.lit(0.0))
    return df.select("system_id", total.alias("chip_weight"), round6(earned).alias("satisfied_weight"),
                     *[col for b in weights for col in (satisfied(b).alias(f"{b}_satisfied"), F.col(f"{b}_4").alias(f"{b}_missing"))],
                     "cpu_chips", "cpu_satisfied", "sound_chips", "sound_satisfied")


def _cored(cat) -> DataFrame:
    return cat["v_system_core"].filter(F.col("kind_id") == FPGA).select("system_id").distinct()


def _sockets(cat) -> DataFrame:
    """(system_id, chip_id, cored, n): sockets with how many cored families carry the chip; chips of none pair nobody."""
    cored = _cored(cat).withColumn("cored", F.lit(True))
    sockets = written(cat["v_system_chip_effective"].select("system_id", "chip_id").join(cored, "system_id", "left")
                      .withColumn("cored", F.coalesce("cored", F.lit(False))))
    return sockets.join(sockets.filter("cored").groupBy("chip_id").agg(F.count("*").alias("n")).hint("merge"), "chip_id")


def _mates(sockets: DataFrame) -> DataFrame:
    """Sockets of cored families, for joins by the chip. By sort-merge: ids repeat, so files are a small part of what the rows take in memory."""
    return sockets.filter("cored").withColumnRenamed("system_id", "mate_system_id").hint("merge")


def _none() -> Column:
    return F.array().cast("array<string>")


def system_mates(cat, policy: Policy = DEFAULT) -> DataFrame:
    """Every (family, cored family) pair sharing enough chips: (system_id, mate_system_id, shared_chips).

    This is the relation itself; `best_mate` finds the one the ranking needs without listing pairs.  Shared chips are
    counted by pair, by equality of the chip alone.  Two families that share k chips share one outside the k - 1 most
    common ones of either: pairs that meet within these tails only are never formed, and for the others the tails,
    lists of k - 1 chips, are compared.
    """
    least = policy.mate_min_shared
    sockets = written(_sockets(cat))
    common = W.partitionBy("system_id").orderBy(F.desc("n"), F.desc("chip_id"))
    tails = (sockets.withColumn("_k", F.row_number().over(common)).filter(F.col("_k") < least)
             .groupBy("system_id").agg(F.collect_list("chip_id").alias("tail")))
    sockets = sockets.join(tails, "system_id", "left").withColumn("in_tail", F.coalesce(F.array_contains("tail", F.col("chip_id")), F.lit(False)))
    left, right = sockets.select("system_id", "chip_id", "in_tail"), _mates(sockets).select("mate_system_id", "chip_id", "in_tail")
    met = (left.filter("NOT in_tail").drop("in_tail").join(right.drop("in_tail"), "chip_id")
           .unionByName(left.filter("in_tail").drop("in_tail").join(right.filter("NOT in_tail").drop("in_tail"), "chip_id")))
    pairs = (met.groupBy("system_id", "mate_system_id").agg(F.count("*").alias("shared")).join(tails, "system_id", "left")
             .join(tails.select(F.col("system_id").alias("mate_system_id"), F.col("tail").alias("mate_tail")), "mate_system_id", "left"))
    both = F.size(F.array_intersect(F.coalesce("tail", _none()), F.coalesce("mate_tail", _none())))
    return pairs.select("system_id", "mate_system_id", (F.col("shared") + both).alias("shared_chips")).filter(F.col("shared_chips") >= least)


def _paired(lists: DataFrame, standing: DataFrame, prefix: Column) -> DataFrame:
    """Pairs of heavy lists that share a chip of the first `prefix` ones of the left, with `shared`. Lists join the distinct pairs only."""
    keys = lists.select("list_id", F.explode(F.slice("heavy", F.lit(1), prefix)).alias("chip_id"))
    met = keys.join(standing.select("mate_system_id", F.explode("mate_heavy").alias("chip_id")).hint("merge"), "chip_id").select("list_id", "mate_system_id").distinct()
    return (met.join(lists, "list_id").join(standing, "mate_system_id")
            .select("list_id", "mate_system_id", "least", F.size("heavy").alias("size"), F.size(F.array_intersect("heavy", "mate_heavy")).cast("long").alias("shared")))


def best_mate(cat, policy: Policy = DEFAULT, light: int = LIGHT) -> DataFrame:
    """Per family the cored family with the largest overlap, lowest id on a tie. Exact.

    Light chips meet by equality and are counted by pair: `light` partners a socket at most, and no list travels with
    them.  Only chips on more than `light` cored families, the heavy ones, become a list per family, which is added to
    the pairs that share a light chip.  Partners by heavy chips alone cannot share more than the family has heavy
    chips, so most families are settled.  For the others only distinct lists of heavy chips are compared, each
    standing for its lowest family: first with the lists that hold all of it, found by its rarest chip, and what finds
    none with those that share enough to win, found by as many of its rarest chips as that needs.  A pair seen by
    both routes has its full count in the first, which wins.
    """
    sockets = written(_sockets(cat))
    least = F.lit(policy.mate_min_shared)
    order = F.struct((-F.col("shared")).alias("less"), "mate_system_id")
    # Rarest first, in one order for all families.
    heavy = F.transform(F.array_sort(F.collect_list(F.struct("n", "chip_id"))), lambda x: x["chip_id"])
    boards = written(sockets.filter(F.col("n") > light).groupBy("system_id", "cored").agg(heavy.alias("heavy")))
    mates = boards.filter("cored").select(F.col("system_id").alias("mate_system_id"), F.col("heavy").alias("mate_heavy"))

    few = sockets.filter(F.col("n") <= light)
    pairs = (few.select("system_id", "chip_id").join(_mates(few).select("mate_system_id", "chip_id"), "chip_id").groupBy("system_id", "mate_system_id").agg(F.count("*").alias("light"))
             .join(boards.drop("cored"), "system_id", "left").join(mates, "mate_system_id", "left"))
    both = F.size(F.array_intersect(F.coalesce("heavy", _none()), F.coalesce("mate_heavy", _none())))
    by_light = pairs.select("system_id", "mate_system_id", (F.col("light") + both).alias("shared"))
    by_light = written(by_light.groupBy("system_id").agg(F.min(order).alias("b")))

    rest = boards.join(by_light, "system_id", "left").select("system_id", "heavy", F.greatest(least, F.coalesce(-F.col("b.less"), least)).alias("least"))
    rest = written(rest.filter(F.size("heavy") >= F.col("least")))
    lists = written(rest.groupBy("heavy").agg(F.min("system_id").alias("list_id"), F.min("least").alias("least")))
    standing = written(mates.groupBy("mate_heavy").agg(F.min("mate_system_id").alias("mate_system_id")))
    whole = _paired(lists, standing, F.lit(1)).filter(F.col("shared") == F.col("size"))
    whole = written(whole.groupBy("list_id").agg(F.min(order).alias("b")))
    part = lists.join(whole, "list_id", "left_anti")
    part = _paired(part, standing, F.size("heavy") - F.col("least").cast("int") + 1).filter(F.col("shared") >= F.col("least"))
    found = whole.unionByName(part.groupBy("list_id").agg(F.min(order).alias("b"))).join(lists.select("list_id", "heavy"), "list_id")
    by_heavy = rest.select("system_id", "heavy").join(found, "heavy").select("system_id", "b")

    best = by_light.unionByName(by_heavy).groupBy("system_id").agg(F.min("b").alias("b"))
    return (best.select("system_id", F.col("b.mate_system_id").alias("mate_system_id"), (-F.col("b.less")).alias("shared_chips"))
            .filter(F.col("shared_chips") >= policy.mate_min_shared))


def prospect_score(cat, policy: Policy = DEFAULT) -> DataFrame:
    """All factors and the score of every candidate on every platform.

    Distinct (family, chip) sockets are the pivotal reduction: small next to the listing and
    read by the rollup, the coverage and the overlaps, so they are stored once.
    """
    cat.materialize("v_system_chip_effective", "v_chip_evidence")
    zero_l, zero_d = F.lit(0).cast("long"), F.lit(0.0)
    rollup = socket_rollup(cat, policy)
    mates = best_mate(cat, policy).withColumnRenamed("shared_chips", "mate_shared_chips")
    names = cat["system"].select("system_id", F.col("name").alias("system_name"), F.col("kind_id").alias("system_kind_id"), "manufacturer_id")
    # Everything about a family is joined once, then met with the platforms.
    family = names.join(rollup, "system_id", "left").join(mates, "system_id", "left")
    df = cat["v_prospector"].select("platform_id", "system_id", "chips_total", "chips_satisfied",
                                    "unmapped_device_count", "confidence").join(family, "system_id")
    counts = [c for c in rollup.columns if c not in ("system_id", "chip_weight", "satisfied_weight")]
    for c in counts + ["mate_shared_chips"]:
        df = df.withColumn(c, F.coalesce(c, zero_l))
    for c in ("chip_weight", "satisfied_weight"):
        df = df.withColumn(c, F.coalesce(c, zero_d))
    total = F.col("chip_weight") + F.col("unmapped_device_count") * F.lit(policy.unmapped_weight)
    df = df.withColumn("total_weight", total).withColumn(
        "readiness", round6(F.when(F.col("total_weight") == 0, zero_d).otherwise(F.col("satisfied_weight") / F.col("total_weight"))))
    level = F.col("confidence")
    df = (df.withColumn("confidence_factor", F.when(level == "high", policy.confidence_high)
                        .when(level == "medium", policy.confidence_medium).otherwise(policy.confidence_low).cast("double"))
          .withColumn("mate_factor", F.when(F.col("mate_system_id").isNull(), 1.0).otherwise(1.0 + policy.bonus_system_mate))
          .withColumn("cpu_sound_applied", cpu_sound_complete())
          .withColumn("cpu_sound_factor", F.when(F.col("cpu_sound_applied") == 1, 1.0 + policy.bonus_cpu_sound).otherwise(1.0)))
    return df.withColumn("score", round6(F.col("readiness") * F.col("confidence_factor") * F.col("mate_factor") * F.col("cpu_sound_factor")))


def cpu_sound_complete() -> Column:
    done = ((F.col("cpu_chips") >= 1) & (F.col("sound_chips") >= 1)
            & (F.col("cpu_satisfied") == F.col("cpu_chips")) & (F.col("sound_satisfied") == F.col("sound_chips")))
    return done.cast("int")


def prospect_rank(cat, policy: Policy = DEFAULT) -> DataFrame:
    """Rank 1..n per platform: score, then total weight, then id; numbered before any filter."""
    return number_rows(prospect_score(cat, policy), ["platform_id"],
                       [F.desc("score"), F.desc("total_weight"), F.asc("system_id")])


# -- explanation lists --------------------------------------------------------------
# Each is a relation of rows; `prospect_breakdown` nests them. A list is bounded by the
# distinct chips of one family.

def missing_chips(cat, policy: Policy = DEFAULT) -> DataFrame:
    return socket_detail(cat, policy).filter(F.col("evidence_rank") == 4).select("system_id", "chip_id", "band", "weight", "is_cpu", "is_sound")


def via_edge_chips(cat, policy: Policy = DEFAULT) -> DataFrame:
    return socket_detail(cat, policy).filter(F.col("evidence_rank").isin(2, 3)).select(
        "system_id", "chip_id", F.col("satisfied_via").alias("via"), "provider_chip_id", "credit")


def cpu_sound_missing(cat, policy: Policy = DEFAULT) -> DataFrame:
    return missing_chips(cat, policy).filter((F.col("is_cpu") == 1) | (F.col("is_sound") == 1)).select("system_id", "chip_id")


def _lists(cat, policy: Policy) -> DataFrame:
    rank = F.col("evidence_rank")
    open_ = rank == 4
    return socket_detail(cat, policy).groupBy("system_id").agg(
        F.array_sort(F.collect_list(F.when(open_, F.struct((-F.col("weight")).alias("w"), "chip_id", "band")))).alias("m"),
        F.array_sort(F.collect_list(F.when(rank.isin(2, 3), F.struct(
            "chip_id", F.col("satisfied_via").alias("via"), "provider_chip_id", "credit")))).alias("via_edge"),
        F.array_sort(F.collect_list(F.when(open_ & ((F.col("is_cpu") == 1) | (F.col("is_sound") == 1)), F.col("chip_id")))).alias("cpu_sound_missing"),
    ).select("system_id", F.transform("m", lambda x: F.struct(x["chip_id"].alias("chip_id"), x["band"].alias("band"),
                                                               (-x["w"]).alias("weight"))).alias("missing"), "via_edge", "cpu_sound_missing")


def prospect_breakdown(cat, policy: Policy = DEFAULT) -> DataFrame:
    """Ranked boards with every factor as one nested record."""
    df = prospect_rank(cat, policy).join(_lists(cat, policy), "system_id", "left")

    def listed(name):
        return F.coalesce(F.col(name), F.from_json(F.lit("[]"), df.schema[name].dataType))

    band = {b: F.struct(F.col(f"{b}_satisfied").alias("satisfied"), F.col(f"{b}_missing").alias("missing")).alias(b)
            for b in ("hard", "medium", "soft")}
    breakdown = F.struct(
        F.struct(round6(F.col("chip_weight")).alias("chip_weight"), round6(F.col("satisfied_weight")).alias("satisfied_weight"),
                 round6(F.col("total_weight") - F.col("chip_weight")).alias("unmapped_weight"),
                 round6(F.col("total_weight")).alias("total_weight"), F.col("readiness").alias("value")).alias("readiness"),
        F.struct(F.col("chips_total").alias("total"), F.col("chips_satisfied").alias("satisfied"),
                 F.struct(*band.values()).alias("by_band"), listed("missing").alias("missing"),
                 listed("via_edge").alias("via_edge")).alias("chips"),
        F.struct(F.col("unmapped_device_count").alias("count"), F.lit(policy.unmapped_weight).alias("weight_each")).alias("unmapped_devices"),
        F.struct(F.col("confidence").alias("level"), F.col("confidence_factor").alias("factor")).alias("confidence"),
        F.struct(F.col("mate_system_id").isNotNull().alias("applied"), F.col("mate_factor").alias("factor"), "mate_system_id",
                 F.col("mate_shared_chips").alias("shared_chips")).alias("system_mate_core"),
        F.struct((F.col("cpu_sound_applied") == 1).alias("applied"), F.col("cpu_sound_factor").alias("factor"), "cpu_chips", "sound_chips",
                 listed("cpu_sound_missing").alias("missing_chip_ids")).alias("cpu_sound_complete"))
    return df.select("platform_id", "rank", "system_id", "system_name", "system_kind_id", "manufacturer_id", "score", breakdown.alias("breakdown"))


def prospect_caveats(cat, policy: Policy = DEFAULT) -> DataFrame:
    """Reasons to read a board's score with care: (platform_id, system_id, caveats[])."""
    edges = via_edge_chips(cat, policy).groupBy("system_id").agg(F.count("*").alias("edges"))
    df = prospect_score(cat, policy).select("platform_id", "system_id", "unmapped_device_count", "confidence",
                                            "confidence_factor").join(edges, "system_id", "left")
    n, e = F.col("unmapped_device_count"), F.coalesce("edges", F.lit(0))
    notes = F.array_compact(F.array(
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" unmapped"))),
        F.when(F.col("confidence") != "high", F.concat(F.lit("confidence "), "confidence", F.lit(" x"), F.col("confidence_factor").cast("string"))),
        F.when(e > 0, F.concat(e.cast("string"), F.lit(" via equivalence")))))
    return df.select("platform_id", "system_id", notes.alias("caveats"))


def prospector_filters(ranked: DataFrame, *, platform: str | None = None, kind: str | None = None,
                       manufacturer: str | None = None, text: str | None = None) -> DataFrame:
    """Narrow a ranking without re-ranking."""
    keep = any_text(text, F.col("system_name"), F.col("system_id"))
    for column, value in (("platform_id", platform), ("system_kind_id", kind), ("manufacturer_id", manufacturer)):
        if value:
            keep = keep & (F.col(column) == value)
    return ranked.filter(keep)


@view("prospect_rank")
def _prospect_rank(cat) -> DataFrame:
    return prospect_rank(cat)
