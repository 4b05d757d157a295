"""Forbidden-domain scan over documents: citation, prose or fetch for every occurrence.

Everything happens on columns of one document row or on its exploded lines; documents that
cannot contain a domain are dropped first by a plain substring test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bomscope.functions.parts import evidence
from bomscope.functions.source_text import _BT, _DQ, _SQ, segments


@dataclass(frozen=True)
class GuardPolicy:
    domains: tuple[str, ...]
    allowed_row_keys: tuple[str, ...] = ("source_url", "notes", "reason")
    row_file_roots: tuple[str, ...] = ("data",)
    prose_extensions: tuple[str, ...] = (".md",)
    fetch_verbs: tuple[str, ...] = ("fetch(", "curl", "wget", "axios", "http.get")
    context_lines: int = 3


# Comment syntax per file extension: (pattern, first characters, extensions).
_STYLES = (
    (r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)", "/", (".ts", ".tsx", ".js", ".mjs", ".cjs", ".cpp", ".c", ".h", ".scss")),
    (r"/\*[\s\S]*?(?:\*/|\z)", "/", (".css",)),
    (r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)", "-/", (".sql",)),
    (r"#[^\n]*", "#", (".sh", ".bash", ".yml", ".yaml", ".py", ".toml")),
    (r"<!--[\s\S]*?(?:-->|\z)", "<", (".html", ".xml", ".svg")),
)
# What a host name is written with (letters, digits and hyphens between dots) and how long it gets, with
# the two slashes before it; and the marks that an address has beside letters and digits.
HOST = "A-Za-z0-9.-"
HOST_LENGTH = 255
ADDRESS = "A-Za-z0-9_.:/?#=&%~+-"
QUOTES = ('"', "'")
_JOINERS = "['\"`+\\\\\\s]"


def _blanked(comment: str):
    return lambda s: F.when(s.rlike(rf"\A(?:{comment})\z"), F.regexp_replace(s, r"[^\n]", "\u0001")).otherwise(s)


def _masked(text: Column, ext: Column) -> Column:
    """The text with every comment character (but newlines) replaced by \\u0001: same length, same lines."""
    out = None
    for pattern, opener, extensions in _STYLES:
        seg = segments(text, pattern, opener, (_DQ, _SQ, _BT))
        blank = F.array_join(F.transform(seg, _blanked(pattern)), "")
        case = ext.isin(*extensions)
        out = F.when(case, blank) if out is None else out.when(case, blank)
    return out.otherwise(text)


def _offsets(text: Column, domain: Column) -> Column:
    """0-based offsets of the domain in a lower-cased text, with a boundary on each side."""
    pattern = F.concat(F.lit(r"(?<![a-z0-9-])\Q"), domain, F.lit(r"\E(?![a-z0-9-])"))
    none = F.array().cast("array<int>")
    walked = F.aggregate(F.split(text, pattern), F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, p: F.struct(
        (a["at"] + F.length(p) + F.length(domain)).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")), lambda a: a["out"])
    # What follows the last piece is the end of the text, not a match.
    return F.slice(walked, F.lit(1), F.greatest(F.size(walked) - 1, F.lit(0)))


def _address(line: Column, at: Column, size: Column, bare: Column) -> Column:
    """An address rather than a word: slashes start its host, a path follows it, or its token fills a quoted literal.

    The token around the domain is the run of address marks that holds it.
    """
    before = F.substring(line, F.greatest(at - HOST_LENGTH + 1, F.lit(1)), F.least(at, F.lit(HOST_LENGTH)))
    after = F.substring(line, at + size + 1, F.lit(HOST_LENGTH))
    head, tail = F.regexp_extract(before, f"([{ADDRESS}]*)$", 1), F.regexp_extract(after, f"^([{ADDRESS}]*)", 1)
    hosted = head.rlike(f"//[{HOST}]*$")
    pathed = after.rlike("^/[^\\s\"'`]")
    opening, closing = F.right(F.left(before, F.length(before) - F.length(head)), F.lit(1)), F.substring(after, F.length(tail) + 1, F.lit(1))
    return hosted | pathed | (bare & opening.isin(*QUOTES) & (opening == closing))


def domain_guard(docs: DataFrame, policy: GuardPolicy, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, domain, disposition, evidence), one row per line and domain; the harsher verdict wins."""
    domains = F.array(*[F.lit(d.lower()) for d in policy.domains])
    flat = F.lower(F.regexp_replace(F.col(text), _JOINERS, ""))
    docs = docs.select(F.col(path).alias("path"), F.col(text).alias("text"), flat.alias("flat")).withColumn(
        "found", F.filter(domains, lambda d: F.contains(F.col("flat"), d))).filter(F.size("found") > 0)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    docs = docs.withColumn("ext", ext).withColumn("is_prose", F.col("ext").isin(*policy.prose_extensions)).withColumn("is_json", F.col("ext") == ".json")
    roots = F.lit(False)
    for r in policy.row_file_roots:
        roots = roots | (F.col("path") == r) | F.startswith("path", F.lit(r + "/"))
    keys = "|".join(policy.allowed_row_keys)
    string = r'"(?:[^"\\]|\\.)*"'
    cited = F.regexp_extract_all("text", F.lit(rf'"(?:{keys})"\s*:\s*({string}|\[(?:\s*{string}\s*,?)*\s*\])'), F.lit(1))
    values = F.flatten(F.transform(cited, lambda c: F.regexp_extract_all(c, F.lit(f"({string})"), F.lit(1))))
    docs = docs.withColumn("is_rows", F.col("is_json") & roots).withColumn(
        "cited", F.when(F.col("is_rows") & F.try_parse_json("text").isNotNull(), values).otherwise(F.array().cast("array<string>")))

    # Joined fragments: quotes, pluses, backslashes and space removed, lines run together. A match
    # belongs to the last line that starts at or before it.
    docs = docs.withColumn("sq", F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, _JOINERS, ""))).withColumn(
        "all", F.array_join("sq", ""))

    def line_of(at):
        return F.aggregate("sq", F.struct(F.lit(0).alias("n"), F.lit(0).alias("from"), F.lit(0).alias("line")), lambda a, s: F.struct(
            (a["n"] + 1).alias("n"), (a["from"] + F.length(s)).alias("from"),
            F.when(a["from"] <= at, a["n"] + 1).otherwise(a["line"]).alias("line")), lambda a: a["line"])

    docs = docs.withColumn("joined", F.flatten(F.transform("found", lambda d: F.transform(
        _offsets(F.lower("all"), d), lambda at: F.struct(d.alias("domain"), line_of(at).alias("line"), _address(
            F.col("all"), at, F.length(d), ~F.col("is_json")).alias("address"))))))

    masked = F.when(F.col("is_prose"), F.col("text")).otherwise(_masked(F.col("text"), F.col("ext")))
    kept = ["path", "is_prose", "is_json", "is_rows", "cited", "found", "joined"]
    lines = docs.withColumn("ls", F.split("text", "\n")).withColumn("ms", F.split(masked, "\n")).select(
        *kept, F.size("ls").alias("n_lines"), F.posexplode(F.arrays_zip("ls", "ms")).alias("p", "z")).select(
        *kept, "n_lines", (F.col("p") + 1).alias("line"), F.col("z.ls").alias("content"), F.col("z.ms").alias("mask"))
    w = W.partitionBy("path").orderBy("line")
    verb = F.lit(False)
    for v in policy.fetch_verbs:
        verb = verb | F.contains(F.lower("content"), F.lit(v))
    fence = F.col("content").rlike(r"^\s*(?:```|~~~)")
    opened = F.sum(fence.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(fence.cast("int")).over(W.partitionBy("path"))
    lines = (lines.withColumn("verb", F.max(verb.cast("int")).over(w.rowsBetween(-policy.context_lines, policy.context_lines)) == 1)
             .withColumn("fenced", (opened % 2 == 1) & ~fence & ((opened < total) | (total % 2 == 0) | (F.col("line") < F.col("n_lines"))))
             .withColumn("citable", F.exists("cited", lambda v: F.contains(F.col("content"), v))))

    # As written first; a joined match counts only on a line where the domain is not written out.
    def occurrences(d):
        written = F.transform(_offsets(F.lower("content"), d), lambda at: F.struct(
            d.alias("domain"), _address(F.col("content"), at, F.length(d), ~F.col("is_json")).alias("address"),
            (F.substring(F.col("mask"), at + 1, F.lit(1)) == "\u0001").alias("comment"), F.lit(False).alias("split")))
        pieced = F.transform(F.filter("joined", lambda j: (j["domain"] == d) & (j["line"] == F.col("line"))), lambda j: F.struct(
            d.alias("domain"), j["address"].alias("address"), F.lit(False).alias("comment"), F.lit(True).alias("split")))
        return F.when(F.size(written) > 0, written).otherwise(pieced)

    seen = lines.withColumn("o", F.explode(F.flatten(F.transform("found", occurrences)))).select(
        "path", "line", "content", "is_prose", "is_rows", "verb", "fenced", "citable", "o.*")
    near = F.col("verb") & ~F.col("comment")
    fetch = (F.when(F.col("is_rows"), ~F.col("citable") | F.col("split")).when(F.col("is_prose"), F.col("fenced") & near)
             .otherwise(F.col("address") | near))
    mild = F.when(F.col("is_rows"), "citation").otherwise("prose")
    return (seen.groupBy("path", "line", "domain").agg(F.max(fetch.cast("int")).alias("f"), F.max(mild).alias("m"), F.max("content").alias("content"))
            .select("path", "line", "domain", F.when(F.col("f") == 1, "fetch").otherwise(F.col("m")).alias("disposition"), evidence(F.col("content")).alias("evidence")))
