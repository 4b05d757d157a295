"""Source files and wiki markup: comments, markers, instantiations, infobox and section lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bomscope.functions.parts import collapse_space, lines_of
from bomscope.operators.closure import follow

_DQ = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)'
_SQ = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\\?\z)"
_BT = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+(?:`|\\?\z)"


def segments(text: Column, comment: str, opener: str, quotes: tuple[str, ...] = (_DQ, _SQ)) -> Column:
    """A text cut into string literals, comments and the rest, in order; a literal that starts
    first hides comment marks inside it, and the other way round."""
    marks = "".join("\\" + c if c in "-]\\^" else c for c in sorted(set('"\'' + ("`" if len(quotes) > 2 else "") + opener)))
    pattern = f"({'|'.join(quotes)}|{comment}|[^{marks}]+|[\\s\\S])"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


C_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"


def _newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))


def extract_comments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Comment blocks (key, block, line, text, end_line): comments separated only by white space
    form one block, padded with the newlines between them so line numbers stay true."""
    seg = docs.select(key, F.posexplode(segments(F.col(text), C_COMMENT, "/")).alias("pos", "s"))
    seg = seg.withColumn("is_c", F.col("s").rlike(r"^(//|/\*)") & (F.length("s") >= 2))
    w = W.partitionBy(key).orderBy("pos")
    prev, prev2 = F.lag("is_c", 1).over(w), F.lag("is_c", 2).over(w)
    blank = F.lag(F.col("s").rlike(r"^\s*$"), 1).over(w)
    body = F.when(F.startswith("s", F.lit("//")), F.substring("s", 3, 1 << 30)).otherwise(
        F.regexp_replace(F.substring("s", 3, 1 << 30), r"\*/\z", ""))
    seg = (seg.withColumn("start", F.coalesce(F.sum(_newlines(F.col("s"))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1)
           .withColumn("joined", F.coalesce(prev | (blank & prev2), F.lit(False))).withColumn("body", body))
    c = seg.filter("is_c").withColumn("end", F.col("start") + _newlines(F.col("body")))
    c = c.withColumn("run", F.sum((~F.col("joined")).cast("int")).over(w))
    # An empty comment opens nothing: a run starts at its first comment with text.
    in_run = W.partitionBy(key, "run").orderBy("pos")
    c = c.withColumn("begun", F.max((F.col("body") != "").cast("int")).over(in_run.rowsBetween(W.unboundedPreceding, 0))).filter("begun = 1")
    gap = F.col("start") - F.lag("end").over(in_run)
    pad = F.when(gap.isNull(), "").when(gap > 0, F.repeat(F.lit("\n"), gap.cast("int"))).otherwise(" ")
    c = c.withColumn("part", F.concat(pad, "body"))
    blocks = c.groupBy(key, "run").agg(
        F.min("start").alias("line"), F.max("end").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("text"))
    order = W.partitionBy(key).orderBy("run")
    return blocks.select(key, F.row_number().over(order).alias("block"), "line", "text", "end_line")


def markers(docs: DataFrame, name: str = "ROM_START", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, at, machine_id) for every `NAME ( id )`, by the line it starts on."""
    tagged = F.regexp_replace(F.col(text), rf"\b{name}(\s*\(\s*)([A-Za-z0-9_]+)(\s*\))", "\u0001$2\u0002$1$3")
    lines = lines_of(docs.select(key, tagged.alias("_t")), key, "_t")
    return lines.select(key, "line", F.posexplode(F.regexp_extract_all("content", F.lit("\u0001([A-Za-z0-9_]+)\u0002"), F.lit(1))).alias("at", "machine_id"))


def attach_markers(blocks: DataFrame, marks: DataFrame, reach: int = 3, key: str = "doc_id") -> DataFrame:
    """Blocks with the machine whose marker follows within `reach` lines (as-of join by a window per file);
    the last marker that picks a block wins."""
    none = F.lit(None)
    both = (blocks.select(key, F.col("end_line").alias("l"), F.lit(1).alias("kind"), F.col("block").alias("o"), "block", "end_line", none.cast("string").alias("machine_id"))
            .unionByName(marks.select(key, F.col("line").alias("l"), F.lit(0).alias("kind"), F.col("at").alias("o"), none.cast("int").alias("block"),
                                      none.cast("int").alias("end_line"), "machine_id")))
    w = W.partitionBy(key).orderBy("l", "kind", "o").rowsBetween(W.unboundedPreceding, 0)
    near = (both.withColumn("b", F.last("block", True).over(w)).withColumn("e", F.last("end_line", True).over(w))
            .filter((F.col("kind") == 0) & F.col("b").isNotNull() & (F.col("l") - F.col("e") <= reach)))
    chosen = near.groupBy(key, F.col("b").alias("block")).agg(F.max_by("machine_id", F.struct("l", "o")).alias("machine_id"))
    return blocks.join(chosen, [key, "block"], "left")


def attribute_blocks(cat, blocks: DataFrame, key: str = "mame_sourcefile") -> DataFrame:
    """(…block…, system_id): a marked block speaks for its machine's family (nothing when unknown),
    any other for the families its file declares, failing that those it reaches."""
    owner = cat["v_machine_system"].filter("system_id IS NOT NULL")
    marked = blocks.filter("machine_id IS NOT NULL").join(owner, "machine_id").select(*blocks.columns, "system_id")
    declared = cat["system_driver"].select(F.col("mame_sourcefile").alias(key), "system_id")
    reached = (cat["machine"].select("machine_id", F.col("mame_sourcefile").alias(key)).join(owner, "machine_id")
               .select(key, "system_id").distinct().join(declared, key, "left_anti"))
    rest = blocks.filter("machine_id IS NULL").join(declared.unionByName(reached), key).select(*blocks.columns, "system_id")
    return marked.unionByName(rest)


# -- wiki markup --------------------------------------------------------------------

# What stands in angle brackets: a comment, a footnote with its body, any other tag.
_ANGLE = r"<!--[\s\S]*?-->|(?i:<ref(?:\s[^>]*)?(?<!/)>[\s\S]*?</ref\s*>)|<[^>]+>"
_LINK = r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"
_BLANK = " \t\r"


def _without_templates(text: Column) -> Column:
    """Calls in double braces become a space, at any depth; marks without a partner stay.

    The text is cut into marks and what lies between, and read once with a stack of open calls: a closing mark
    drops the innermost call, and what is left open at the end goes back into the text.
    """
    def onto(stack, more):
        return F.array_append(F.slice(stack, F.lit(1), F.size(stack) - 1), F.concat(F.element_at(stack, -1), more))

    def read(stack, piece):
        outer = F.slice(stack, F.lit(1), F.size(stack) - 1)
        return (F.when(piece == "{{", F.array_append(stack, F.lit("")))
                .when((piece == "}}") & (F.size(stack) > 1), onto(outer, F.lit(" "))).otherwise(onto(stack, piece)))

    pieces = F.regexp_extract_all(text, F.lit(r"(\{\{|\}\}|[^{}]+|[{}])"), F.lit(1))
    parsed = F.array_join(F.aggregate(pieces, F.array(F.lit("")), read), "{{")
    return F.when(F.contains(text, F.lit("{{")), parsed).otherwise(text)


def strip_markup(col: Column) -> Column:
    """Wiki text without comments, footnotes, tags, templates and emphasis; links reduced to their target."""
    text = _without_templates(F.regexp_replace(col, _ANGLE, " "))
    text = F.regexp_replace(F.regexp_replace(text, _LINK, "$1"), "''+", "")
    for entity, character in (("&nbsp;", " "), ("&amp;", "&")):  # fixed values
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def _fold(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def infobox_fields(docs: DataFrame, fields: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, name, value) of `| name = value` lines with a wanted name."""
    import re as _re

    wanted = [_re.sub("[^a-z0-9]", "", f.lower()) for f in fields]
    line = F.ltrim(F.rtrim("content", F.lit("\r")), F.lit(_BLANK))
    at = F.locate("=", F.col("line"))
    lines = lines_of(docs, key, text).select(key, F.col("line").alias("no"), line.alias("line")).filter(F.startswith("line", F.lit("|")) & (at > 2))
    found = lines.select(key, F.col("no").alias("line"), F.btrim(F.substring("line", F.lit(2), at - 2), F.lit(_BLANK)).alias("name"),
                         F.ltrim(F.substring("line", at + 1, F.length("line")), F.lit(_BLANK)).alias("value"))
    found = found.filter(_fold(F.col("name")).isin(*wanted) & F.col("name").rlike("^[\\w -]+$"))
    return found.withColumn("value", strip_markup(F.col("value")))


def spec_section_items(docs: DataFrame, headings: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, item): list lines of the first section whose heading is wanted."""
    lines = lines_of(docs, key, text)
    bare = F.btrim(F.col("content"), F.lit(_BLANK))
    size = F.length(bare)
    # A heading's level is the smaller of its two runs of equals signs; what is over belongs to the title.
    level = F.least(size - F.length(F.ltrim(bare, F.lit("="))), size - F.length(F.rtrim(bare, F.lit("="))), F.lit(6))
    is_head = (level >= 2) & (F.btrim(bare, F.lit("=" + _BLANK)) != "")
    title = F.substring(bare, level + 1, size - 2 * level)
    title = F.btrim(F.lower(F.replace(F.replace(title, F.lit("[[")), F.lit("]]"))), F.lit(_BLANK))
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = (lines.withColumn("head", is_head).withColumn("section", F.sum(is_head.cast("int")).over(w))
             .withColumn("hit", is_head & title.isin(*[h.lower() for h in headings])))
    first = W.partitionBy(key)
    lines = lines.withColumn("want", F.min(F.when(F.col("hit"), F.col("section"))).over(first))
    return (lines.filter((F.col("section") == F.col("want")) & ~F.col("head") & F.substring(F.ltrim("content", F.lit(_BLANK)), 1, 1).isin("*", "#", ";", "|"))
            .select(key, "line", strip_markup(F.col("content")).alias("item")))


def resolve_title(titles: DataFrame, aliases: DataFrame, hops: int | None = None) -> DataFrame:
    """(title, resolved, cyclic): what a title's alias steps (from, to) end at, by doubling the steps.

    A title whose aliases run into a circle is cyclic and resolves to nothing.  A caller may ask for so many hops at most.
    """
    step = aliases.filter("from <> to").groupBy(F.col("from").alias("n")).agg(F.max("to").alias("to"))
    if hops is None:
        ends = follow(step).select(F.col("n").alias("title"), F.col("last").alias("_to"), F.col("ring").alias("_ring"))
        ring = F.coalesce("_ring", F.lit(False))
        return titles.select("title").join(ends, "title", "left").select(
            "title", F.when(~ring, F.coalesce("_to", "title")).alias("resolved"), ring.alias("cyclic"))
    out = titles.select("title", F.col("title").alias("n"))
    for _ in range(hops):
        out = out.join(step, "n", "left").select("title", F.coalesce("to", "n").alias("n"))
    return out.select("title", F.col("n").alias("resolved"), F.lit(False).alias("cyclic"))


# -- hardware description and statements ----------------------------------------------

# An instantiation (type, parameters, name, open parenthesis) and a top-level key.
_VERILOG = r"(?m)^[ \t]*([A-Za-z][A-Za-z0-9_]*)\s*(?:#\s*\([^;]*?\)\s*)?[A-Za-z_][A-Za-z0-9_]*\s*\("
_YAML = r"(?m)^([A-Za-z][A-Za-z0-9_]*):"


def module_instances(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, module, evidence): instantiations in `.v` files, top-level keys elsewhere."""
    mark = "\u0001$1\u0002$0"
    tagged = F.when(F.endswith(path, F.lit(".v")), F.regexp_replace(text, _VERILOG, mark)).otherwise(F.regexp_replace(text, _YAML, mark))
    lines = lines_of(docs.select(path, tagged.alias("_t")), path, "_t")
    return (lines.select(path, "line", "content", F.explode(F.regexp_extract_all("content", F.lit("\u0001([^\u0002]*)\u0002"), F.lit(1))).alias("module"))
            .select(path, "line", "module", F.substring(collapse_space(F.regexp_replace("content", "\u0001[^\u0002]*\u0002", "")), 1, 160).alias("evidence")))


def statement_parts(responses: DataFrame, body: str = "body") -> DataFrame:
    """(item, property, label) from result sets in the query service's JSON; unresolved labels
    (bare entity ids) are dropped."""
    schema = ("struct<results:struct<bindings:array<struct<item:struct<value:string>,prop:struct<value:string>,"
              "valueLabel:struct<value:string>>>>>")
    row = responses.select(F.explode(F.from_json(body, schema)["results"]["bindings"]).alias("b"))
    return row.select(F.regexp_replace("b.item.value", r"^.*/", "").alias("item"), F.col("b.prop.value").alias("property"),
                      F.col("b.valueLabel.value").alias("label")).filter(
        "item IS NOT NULL AND property IS NOT NULL AND label IS NOT NULL").filter(~F.col("label").rlike(r"^Q\d+$"))
