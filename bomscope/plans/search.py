"""Ranked multi-entity search over many terms at once, and id/alias resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

import bomscope.plans.views  # noqa: F401  registers the views read below
from bomscope.session import checkpointed

MIN_TERM = 2  # fixed value: shorter terms are not searched
KIND_ORDER = {"chip": 4, "system": 3, "implementation": 2, "machine": 1}  # fixed values


def search_names(cat) -> DataFrame:
    """Every searchable text: (kind, id, label, detail, text, matched_on); `matched_on` names an alias."""
    def entity(kind, df, key, label, detail):
        base = df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(label).alias("label"), detail.alias("detail"))
        return base, base.select("*", F.explode(F.array("id", "label")).alias("text"), F.lit(None).cast("string").alias("matched_on"))

    def aliases(base, names, key):
        held = names.select(F.col(key).alias("id"), F.col("name").alias("text"), F.col("name").alias("matched_on"))
        return base.join(held, "id").select("kind", "id", "label", "detail", "text", "matched_on")

    chip, chip_texts = entity("chip", cat["chip"], "chip_id", "display_name", F.coalesce("manufacturer_id", "function_id"))
    system, system_texts = entity("system", cat["system"], "system_id", "name", F.col("kind_id"))
    _, impl_texts = entity("implementation", cat["implementation"], "implementation_id", "name", F.col("kind_id"))
    _, machine_texts = entity("machine", cat["v_machine"], "machine_id", "name", F.coalesce("system_id", "mame_sourcefile"))
    return (chip_texts.unionByName(aliases(chip, cat["chip_name"], "chip_id")).unionByName(system_texts)
            .unionByName(aliases(system, cat["system_name"], "system_id")).unionByName(impl_texts).unionByName(machine_texts)
            .withColumn("text", F.lower("text")))


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - (size - 1)
    made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def name_table(cat) -> DataFrame:
    """Every searchable text under a number of its own."""
    return search_names(cat).withColumn("entry", F.monotonically_increasing_id())


def gram_table(cat) -> DataFrame:
    """The inverted index (gram, entry): letter pairs and triples of every text, in the order of the grams."""
    text = F.col("text")
    grams = stored(cat, "search_name").select(F.explode(F.concat(_grams(text, 2), _grams(text, 3))).alias("gram"), "entry")
    return grams.repartitionByRange("gram").sortWithinPartitions("gram", "entry")


INDEXES = {"search_name": name_table, "search_gram": gram_table}


def stored(cat, name: str) -> DataFrame:
    """A part of the index: as the catalogue keeps it, else made and stored once."""
    try:
        return cat[name]
    except KeyError:
        cat._memo[name] = checkpointed(INDEXES[name](cat))
        return cat._memo[name]


def _hits_by_gram(cat, needles: DataFrame) -> DataFrame:
    wanted = needles.select("needle", F.explode(F.when(F.length("needle") >= 3, _grams(F.col("needle"), 3))
                                                .otherwise(F.array("needle"))).alias("gram"))
    postings = stored(cat, "search_gram").join(wanted.select("gram").distinct(), "gram", "left_semi")
    frequency = postings.groupBy("gram").agg(F.count("*").alias("n"))
    key = (wanted.join(frequency, "gram", "left").groupBy("needle")
           .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")).select("needle", F.col("k.gram").alias("gram")))
    return postings.join(key, "gram").join(stored(cat, "search_name"), "entry").filter(F.contains("text", "needle"))


def global_search(cat, terms: DataFrame, per_kind: int = 5, total: int = 20) -> DataFrame:
    """Best hits per term: exact, exact alias, prefix, alias prefix, substring, alias substring.

    A substring test between every term and every text would be a cross join.  Terms use the stored
    index instead: texts by their letter triples (pairs for two-letter terms), met with each term's
    rarest one by equality; candidates are then fetched by number and tested exactly.
    """
    needles = (terms.select(F.lower(F.trim(F.col(terms.columns[0]))).alias("needle")).distinct()
               .filter(F.length("needle") >= MIN_TERM))
    hits = _hits_by_gram(cat, needles)
    step = F.when(F.col("text") == F.col("needle"), 0).when(F.startswith("text", "needle"), 2).otherwise(4)
    rank = step + F.when(F.col("matched_on").isNotNull(), 1).otherwise(0)
    best = (hits.groupBy("needle", "kind", "id", "label", "detail")
            .agg(F.min(F.struct(rank.alias("rank"), "matched_on")).alias("b"))
            .select("needle", "kind", "id", "label", "detail", F.col("b.matched_on").alias("matched_on"), F.col("b.rank").alias("rank"),
                    F.length("label").alias("_len")))
    in_kind = W.partitionBy("needle", "kind").orderBy("rank", "_len", "label", "id")
    weight = F.lit(0)
    for kind, w in KIND_ORDER.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    in_all = W.partitionBy("needle").orderBy("rank", F.desc("_kind"), "_len", "label", "id")
    # Both limits are the feature; the per-kind one is applied map-side as a group limit.
    capped = best.withColumn("_n", F.row_number().over(in_kind)).filter(F.col("_n") <= per_kind).withColumn("_kind", weight)
    return (capped.withColumn("position", F.row_number().over(in_all)).filter(F.col("position") <= total)
            .select("needle", F.col("position").cast("long").alias("position"), "kind", "id", "label", "detail", "matched_on", "rank"))


def resolve_alias(ids: DataFrame, key: str, names: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id): the id itself, else the id ignoring case, else an alias; lowest id on a tie."""
    term = terms.select(F.col(terms.columns[0]).alias("term")).distinct().withColumn("_low", F.lower("term"))
    own = ids.select(F.col(key).alias("id"), F.lower(key).alias("_low")).join(term, "_low").select(
        "term", "id", F.when(F.col("id") == F.col("term"), 0).otherwise(1).alias("how"))
    alias = names.select(F.col(key).alias("id"), F.lower("name").alias("_low")).join(term, "_low").select("term", "id", F.lit(2).alias("how"))
    return (own.unionByName(alias).groupBy("term").agg(F.min(F.struct("how", "id")).alias("b"))
            .select("term", F.col("b.id").alias("id"), F.col("b.how").alias("how")))
