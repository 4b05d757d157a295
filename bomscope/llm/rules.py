"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Every text gets a row of statistics, in built-in expressions and one pass over the text.  Two fixed base rules
reject texts that are too short or repeat themselves.  The list is learned from the statistics of labelled texts: each
statistic is cut at quantiles of the labelled rows; a rule grows by the threshold condition of highest
information gain on two thirds of the rows, is pruned to its best beginning on the last third, and is taken if it
is precise enough there; the rows it covers leave and the next rule grows.  The result is an ordered list of
conjunctions, which is emitted as one conditional expression (or as SQL text).

Learning counts: a step is one aggregation over the labelled rows that are left, and brings one count for each
statistic, cut and label to the driver.  All labelled rows take part.

Defined cases: a null text has no words and no lines.  A word is a run of characters other than space and U+0009 to
U+000D.  Labels other than 0 and 1 are not looked at, nor are labels of an id that disagree, null ids, or ids
without a text; a label counts for every row of its id.  If one label is missing the list is empty and only
the base rules decide.  Ids may repeat or be null: every row is judged by its own text.  Extra columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomscope.llm.common import staged, text_or_empty

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
MAX_RULES, MAX_CONDITIONS = 12, 4
#: Share of labelled low-quality rows among those a rule covers, on rows it did not grow on.
PRECISION = 0.9
CUTS = (0.002, 0.005, 0.01, 0.02, *(k / 20 for k in range(1, 20)), 0.98, 0.99, 0.995, 0.998)


def repeated_words(words: Column, windows: Column) -> Column:
    """Words inside windows that occur twice or more; `windows` has a hash of the words from each place on.

    Places are sorted by hash; those that share their hash with a neighbour are compared word by word.
    """
    def same(a, b):
        out = a["h"] == b["h"]
        for k in range(WINDOW):  # one by one: a slice would copy all words of a text each time
            out = out & (F.get(words, a["i"] + k) == F.get(words, b["i"] + k))
        return out

    def twice(s):
        beside = lambda x, k: F.coalesce(same(x, F.get(s, k)), F.lit(False))
        return F.filter(s, lambda x, k: beside(x, k - 1) | beside(x, k + 1))

    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.array_sort(F.transform(F.element_at(F.transform(F.array(by_hash), twice), 1), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the base rules, and the rates that the list is learned from."""
    text = F.col("t")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    bare = F.btrim(text, F.lit(BLANK))
    rows = rows.select(
        "doc_id", "t", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "").alias("lines"),
    )
    # What is neither letter nor space is little, and holds all the characters that are counted one by one.
    marks = F.col("marks")
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.regexp_replace(text, "[\\p{L} ]+", "").alias("marks"))
    n = F.size("words")
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    rows = rows.select("*", F.when(n >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    size = F.length(text)
    among = lambda characters: (F.length(marks) - F.length(F.translate(marks, characters, ""))).cast("long")
    long = lambda c: c.cast("long")
    counts = rows.select(
        "doc_id", long(n).alias("n_words"),
        (F.length(F.replace(text, F.lit(" "), F.lit(""))) - among(BLANK)).alias("word_chars"),
        among(SYMBOLS).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("windows")).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"), long(size).alias("n_chars"),
        long(F.size(F.array_distinct("words"))).alias("n_distinct"),
        long(size - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))).alias("n_upper"),
        among("0123456789").alias("n_digits"), among(".,;:").alias("n_stops"), among("!?").alias("n_shouts"),
        among("{}[]()=+_/\\@~^`").alias("n_signs"),
    )
    rate = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return counts.withColumns({
        "mean_word": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"), "line_words": rate("n_words", "n_lines"), "distinct_rate": rate("n_distinct", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"), "digit_rate": rate("n_digits", "word_chars"), "stop_rate": rate("n_stops", "n_words"),
        "shout_rate": rate("n_shouts", "n_words"), "sign_rate": rate("n_signs", "word_chars"), "words": F.col("n_words").cast("double"),
    })


#: What conditions are about.
RATES = (
    "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "line_words", "distinct_rate",
    "upper_rate", "digit_rate", "stop_rate", "shout_rate", "sign_rate", "words",
)


@dataclass(frozen=True)
class Condition:
    rate: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.rate) > self.limit if self.above else F.col(self.rate) <= self.limit

    def __str__(self) -> str:
        return f"{self.rate} {'>' if self.above else '<='} {self.limit!r}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def as_sql(rules: list[Rule]) -> list[str]:
    return [" AND ".join(map(str, rule)) for rule in rules]


def fired(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(holds(rule), k) if out is None else out.when(holds(rule), k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rates of labelled rows with `bad` (label 0) and `grows`, drawn by the hash of the id."""
    label = F.col(label_col).cast("int")
    agreed = (labels.select(F.col(id_col).alias("doc_id"), label.alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
              .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most"))
    return stats.join(agreed, "doc_id").select(
        *RATES, (F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) != 0).alias("grows"))


def _information(p: float, n: float) -> float:
    return math.log2((p + 1) / (p + n + 2))


def _best(tally: dict, cuts: dict[str, list[float]], rule: Rule) -> Condition | None:
    """The condition of highest gain, from counts of (rate, cut) by label; ties go to the first."""
    best, choice = 0.0, None
    for rate in RATES:
        bad, good = [[tally.get((rate, k, b), 0) for k in range(len(cuts[rate]) + 1)] for b in (True, False)]
        p_all, n_all = sum(bad), sum(good)
        p = n = 0
        for k, limit in enumerate(cuts[rate]):
            p, n = p + bad[k], n + good[k]
            for above, pp, nn in ((False, p, n), (True, p_all - p, n_all - n)):
                condition = Condition(rate, above, limit)
                gain = pp * (_information(pp, nn) - _information(p_all, n_all))
                if gain > best + 1e-9 and condition not in rule:
                    best, choice = gain, condition
    return choice


def learn(rows: DataFrame) -> list[Rule]:
    """The decision list from rows of `labelled`: rules for texts that do not stay, in order."""
    labels = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(labels) < 2:
        return []
    found = rows.agg(*[F.percentile_approx(r, list(CUTS), 10_000).alias(r) for r in RATES]).first()
    cuts = {r: sorted(set(found[r])) for r in RATES}
    # Each rate as the number of cuts below it, so that a step counts small numbers.
    place = lambda r: sum([(F.col(r) > c).cast("int") for c in cuts[r]], F.lit(0))
    rows = staged(rows.withColumn("places", F.array(*[place(r) for r in RATES])), "labelled")

    def tally(where: Column) -> dict:
        spread = rows.filter(where).select("bad", F.posexplode("places").alias("rate", "place"))
        counts = spread.groupBy("rate", "place", "bad").agg(F.count(F.lit(1)).alias("n")).collect()
        return {(RATES[r["rate"]], r["place"], r["bad"]): r["n"] for r in counts}

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            counts = tally(F.col("grows") & left & holds(rule))
            more = _best(counts, cuts, rule)
            if more is None:
                break
            rule += (more,)
        if not rule:
            break
        # Pruned to the beginning that is worth most on rows the rule did not grow on.
        starts = [rule[: k + 1] for k in range(len(rule))]
        seen = rows.filter(~F.col("grows") & left).agg(*[
            F.coalesce(F.sum((holds(s) & (F.col("bad") == b)).cast("long")), F.lit(0)).alias(f"{k}_{b}") for k, s in enumerate(starts) for b in (True, False)]).first()
        worth = [((seen[f"{k}_True"] - seen[f"{k}_False"]) / max(1, seen[f"{k}_True"] + seen[f"{k}_False"]), k) for k in range(len(starts))]
        _, k = max(worth, key=lambda w: (w[0], -w[1]))
        p, n = seen[f"{k}_True"], seen[f"{k}_False"]
        if not p or p < PRECISION * (p + n):
            break
        rules.append(starts[k])
        left = left & ~holds(starts[k])
    return rules


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with base_failed, the number of the rule that fired, and kept."""
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", fired(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics and verdict of every row."""
    stats = staged(statistics(docs, id_col, text_col), "statistics")
    return judged(stats, learn(labelled(stats, labels, id_col, label_col)))
