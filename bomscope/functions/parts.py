"""Part designations: normal form, vendor stripping, the chip index, and finding parts in text."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE_LENGTH = 160  # fixed value: evidence is clipped to this many characters


@dataclass(frozen=True)
class Grammar:
    id: str
    pattern: str
    requires_context: bool = False


@dataclass(frozen=True)
class Recognition:
    """How designations are recognised. Small, hand-written policy."""

    vendor_prefixes: tuple[str, ...] = ()
    grammars: tuple[Grammar, ...] = ()
    context_pattern: str = "(?!)"
    part_aliases: dict[str, str] = field(default_factory=dict)
    ignored_parts: tuple[str, ...] = ()
    min_literal_length: int = 3


_WIDE = "ßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"  # letters that upper-casing would write as several; they are no signs of a designation


def normalize_part(col: Column) -> Column:
    """Micro signs folded to U (before upper-casing, which would make a Greek capital), then A-Z0-9 only."""
    return F.regexp_replace(F.upper(F.translate(col, "µμ" + _WIDE, "UU")), "[^A-Z0-9]", "")


def strip_vendor(normalized: Column, prefixes: tuple[str, ...]) -> Column:
    """Remove the longest vendor prefix that leaves at least two characters."""
    if not prefixes:
        return normalized
    longest_first = sorted(prefixes, key=lambda p: (-len(p), p))
    return F.regexp_replace(normalized, f"^(?:{'|'.join(map(re.escape, longest_first))})(?=.{{2,}})", "")


def normalize_without_vendor(col: Column, rec: Recognition) -> Column:
    return strip_vendor(normalize_part(col), rec.vendor_prefixes)


def name_forms(col: Column) -> Column:
    """`A (B)` is three names: the whole, A, and B."""
    pattern = r"^([^(]+?)\s*\(([^)]+)\)\s*$"
    whole = col.rlike(pattern)
    return F.array_compact(F.array(col, F.when(whole, F.regexp_extract(col, pattern, 1)), F.when(whole, F.regexp_extract(col, pattern, 2))))


def catalogue_names(cat) -> DataFrame:
    own = cat["chip"].select("chip_id", F.explode(F.array("chip_id", "display_name")).alias("name"))
    return (own.unionByName(cat["chip_name"].select("chip_id", "name")).filter(F.col("name").isNotNull())
            .select("chip_id", F.explode(name_forms(F.col("name"))).alias("form")).distinct())


def chip_index(cat, rec: Recognition) -> DataFrame:
    """(key, chip_id) for keys exactly one chip claims; configured aliases win over claims."""
    claims = (catalogue_names(cat).select("chip_id", F.explode(F.array(
        normalize_part(F.col("form")), normalize_without_vendor(F.col("form"), rec))).alias("key"))
        .filter(F.length("key") >= 2))
    sole = (claims.groupBy("key").agg(F.min("chip_id").alias("chip_id"), F.max("chip_id").alias("other"))
            .filter("chip_id = other").drop("other"))
    if not rec.part_aliases:
        return sole
    alias = (cat.spark.createDataFrame(list(rec.part_aliases.items()), "designation string, chip_id string")
             .select(normalize_without_vendor(F.col("designation"), rec).alias("key"), "chip_id"))
    return sole.join(alias, "key", "left_anti").unionByName(alias)


def resolve_part(df: DataFrame, index: DataFrame, rec: Recognition, column: str = "designation") -> DataFrame:
    """Adds `normalized`, `chip_id` (NULL when unknown) and `key`; drops ignored and too short designations."""
    named = df.withColumn("normalized", normalize_without_vendor(F.col(column), rec)).filter(F.length("normalized") >= 2)
    if rec.ignored_parts:
        named = named.filter(~F.col("normalized").isin(*rec.ignored_parts))
    by_key = index.select(F.col("key").alias("normalized"), F.col("chip_id").alias("_c1"))
    by_plain = index.select(F.col("key").alias("_plain"), F.col("chip_id").alias("_c2"))
    out = (named.withColumn("_plain", normalize_part(F.col(column))).join(by_key, "normalized", "left").join(by_plain, "_plain", "left")
           .withColumn("chip_id", F.coalesce("_c1", "_c2")))
    return out.select(*df.columns, "normalized", "chip_id", part_key(F.col("chip_id"), F.col("normalized")).alias("key"))


def part_key(chip_id: Column, normalized: Column) -> Column:
    return F.when(chip_id.isNotNull(), F.concat(F.lit("chip:"), chip_id)).otherwise(F.concat(F.lit("part:"), normalized))


def collapse_space(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def evidence(line: Column) -> Column:
    text = collapse_space(line)
    return F.when(F.length(text) <= EVIDENCE_LENGTH, text).otherwise(
        F.concat(F.substring(text, 1, EVIDENCE_LENGTH - 1), F.lit("…")))


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, content): whole documents as numbered lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("_p", "content")).select(key, (F.col("_p") + 1).alias("line"), "content")


_SIGN = "[A-Za-z0-9µμ]"
_GAP = "[^A-Za-z0-9µμ]?"
SEED = 32  # a name is looked up by its signs, this many at most


def _folded(col: Column) -> Column:
    """Latin capitals as small letters and micro signs as u; nothing else changes, so other letters stay gaps."""
    return F.translate(col, string.ascii_uppercase + "µμ", string.ascii_lowercase + "uu")


def _beginnings(window: Column) -> Column:
    """The signs of a window up to the end of each of its words."""
    words = F.length(window) - F.length(F.replace(window, F.lit(" "), F.lit(""))) + 1
    return F.transform(F.sequence(F.lit(1), words), lambda k: F.replace(F.call_function("substring_index", window, F.lit(" "), k), F.lit(" "), F.lit("")))


def literal_table(names: DataFrame, rec: Recognition) -> DataFrame:
    """Searchable catalogue names as (name, size, seed, pattern).

    A name is its alphanumeric pieces; text may write at most one other character between
    two pieces, or none.  `seed` is its signs, gaps left out, or the first SEED of them.
    """
    form = F.col("form")
    ok = (F.length(form) >= rec.min_literal_length) & form.rlike("[A-Za-z]")
    if rec.ignored_parts:
        ok = ok & ~form.isin(*rec.ignored_parts)
    pieces = F.regexp_extract_all(_folded(F.col("name")), F.lit("([a-z0-9]+)"), F.lit(1))
    return (names.filter(ok).select(form.alias("name")).distinct().withColumn("p", pieces).select(
        "name", F.length("name").alias("size"), F.substring(F.array_join("p", ""), 1, SEED).alias("seed"),
        F.array_join(F.transform("p", lambda x: F.replace(x, F.lit("u"), F.lit("[uµμ]"))), _GAP).alias("pattern")))


def _met_names(lines: DataFrame, literals: DataFrame, key: str) -> DataFrame:
    """(key, line, names): the names whose signs a line may hold, longest first.

    A name starts and ends with a word of the line.  So every word starts a window of the next SEED signs, whose
    beginnings up to a word's end meet the names' signs by equality: names of so many signs or fewer are met only where
    the line has all their signs.  The catalogue may be large and names as long as they like; a window has a fixed length.
    """
    spaced = F.regexp_replace(_folded(F.col("content")), "[^a-z0-9]+", " ")
    windows = F.regexp_extract_all(spaced, F.lit(f"(?:^| )(?=((?:[a-z0-9] ?){{1,{SEED}}}))"), F.lit(1))
    beginnings = F.array_distinct(F.flatten(F.transform(windows, lambda w: _beginnings(F.rtrim(w)))))
    return (lines.select(key, "line", F.explode(beginnings).alias("seed")).join(literals, "seed")
            .groupBy(key, "line").agg(F.array_sort(F.collect_set(F.struct((-F.col("size")).alias("o"), "name", "pattern"))).alias("names")))


def _literal_hits(lines: DataFrame, literals: DataFrame, key: str) -> DataFrame:
    """Leftmost, non-overlapping catalogue names per line; a longer name wins at one place.

    Only the names that a line meets become the alternation that it is searched with.
    """
    search = F.concat(F.lit(f"(?i)(?<!{_SIGN})("), F.array_join("names.pattern", "|"), F.lit(f")(?!{_SIGN})"))
    return (lines.join(_met_names(lines, literals, key), [key, "line"])
            .select(key, "line", evidence(F.col("content")).alias("evidence"), F.posexplode(F.regexp_extract_all("content", search, F.lit(1))).alias("at", "designation"))
            .select(key, "line", "evidence", F.lit(0).alias("rule_no"), F.lit("catalog").alias("rule"), "at", "designation"))


def _tagged(no: int, rule: str):
    return lambda d, i: F.struct(F.lit(no).alias("rule_no"), F.lit(rule).alias("rule"), i.alias("at"), d.alias("designation"))


def _grammar_hits(lines: DataFrame, rec: Recognition, key: str) -> DataFrame | None:
    if not rec.grammars:
        return None
    context = F.col("content").rlike("(?i)" + rec.context_pattern)
    found = []
    for no, g in enumerate(rec.grammars, 1):
        pattern = f"(?i)((?<![A-Za-z0-9])(?:{g.pattern})(?![A-Za-z0-9]))"
        hits = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        if g.requires_context:
            hits = F.when(context, hits).otherwise(F.array().cast("array<string>"))
        found.append(F.transform(hits, _tagged(no, g.id)))
    return (lines.select(key, "line", evidence(F.col("content")).alias("evidence"), F.explode(F.concat(*found)).alias("h"))
            .select(key, "line", "evidence", "h.*"))


def scan_parts(docs: DataFrame, names: DataFrame, rec: Recognition, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, designation, rule, evidence): parts named in text, once per line and normal form.

    `names` has a `form` column of catalogue names; they need no context. Grammar rules may
    demand a context word on the same line. Catalogue hits come before grammar hits.
    """
    lines = lines_of(docs, key, text)
    hits = _literal_hits(lines, literal_table(names, rec), key)
    other = _grammar_hits(lines, rec, key)
    if other is not None:
        hits = hits.unionByName(other)
    norm = hits.withColumn("normalized", normalize_part(F.col("designation"))).filter("normalized <> ''")
    first = norm.groupBy(key, "line", "normalized").agg(F.min(F.struct("rule_no", "at", "designation", "rule", "evidence")).alias("b"))
    return first.select(key, "line", "b.designation", "b.rule", "b.evidence")
