"""Merkle tree fingerprints: leaves are sentences, above them paragraphs, sections and the root.

Built-in expressions only.  A text is cut at blank lines into sections, at line ends into paragraphs,
and inside a paragraph after `.`, `!` or `?` (and after 64 characters at the latest) into leaves.
Every cut can be undone, so unequal texts have unequal trees and equal roots mean equal texts; where
roots differ, unequal branches at the same place lead to the edits.

Defined cases: a null text counts as empty.  A row without an id has no place in the order; its next
document is the empty text.  Where several rows share an id, the smallest of their texts is the one
that the document before sees as its next.  One document alone is its own next.  Extra columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomscope.llm.common import text_or_empty, with_next

#: A leaf: up to 64 characters and the sentence end that follows.
LEAF = r"[^.!?]{1,64}[.!?]*|[.!?]+"


def _node(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, ",")), 256)


def _leaves(paragraph: Column) -> Column:
    return F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0))


def sections(text: Column) -> Column:
    """array<struct<hash, paragraphs array<string>>>: the tree's two middle levels."""
    def paragraph(p: Column) -> Column:
        return _node("P", F.transform(_leaves(p), lambda s: F.sha2(s, 256)))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n", -1), paragraph)

    inner = F.transform(F.split(text, "\n\n", -1), section)
    return F.transform(inner, lambda p: F.struct(_node("S", p).alias("hash"), p.alias("paragraphs")))


def root(tree: Column) -> Column:
    return _node("R", F.transform(tree, lambda s: s["hash"]))


def leaf_set(text: Column) -> Column:
    """Distinct 64-bit leaf hashes, for likeness."""
    pieces = F.transform(F.split(text, "\n", -1), _leaves)
    return F.array_distinct(F.transform(F.flatten(pieces), lambda s: F.xxhash64(s)))


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves in common: 1 for two empty texts, 0 if one is empty."""
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def differing(a: Column, b: Column) -> Column:
    """Places of the paragraphs that differ, as array<struct<section, paragraph>>; equal branches are not entered."""
    def inside(x: Column, y: Column, i: Column) -> Column:
        n = F.greatest(F.size(x["paragraphs"]), F.size(y["paragraphs"]))
        at = F.sequence(F.lit(0), n - 1)
        unlike = F.filter(at, lambda j: ~F.get(x["paragraphs"], j).eqNullSafe(F.get(y["paragraphs"], j)))
        return F.transform(unlike, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    n = F.greatest(F.size(a), F.size(b))
    empty = F.struct(F.lit("").alias("hash"), F.array().cast("array<string>").alias("paragraphs"))
    side = lambda t, i: F.coalesce(F.get(t, i), empty)
    unlike = F.filter(F.sequence(F.lit(0), n - 1), lambda i: side(a, i)["hash"] != side(b, i)["hash"])
    return F.flatten(F.transform(unlike, lambda i: inside(side(a, i), side(b, i), i)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, tree, leaves of every row."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), sections(text).alias("tree"), leaf_set(text).alias("leaves")
    ).withColumn("fingerprint", root(F.col("tree")))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against itself with its second half replaced by the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    the number of paragraphs that the two trees show as edited.  Only the needed start of a text and its
    leaf hashes travel to the document before it.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # Both joins by id below start from these same rows, so they are dealt by id once.
    known = base.filter("doc_id IS NOT NULL")
    lengths = base.select("doc_id", F.length("text").alias("n")).dropna().groupBy("doc_id").agg(F.max("n").alias("room"))
    order = with_next(base, "doc_id").join(lengths, "doc_id").select(
        F.col("doc_id").alias("before"), F.col("next_doc_id").alias("doc_id"), F.floor(F.col("room") / 2).cast("int").alias("room")
    )
    after = known.join(order, "doc_id").select(
        F.col("before").alias("doc_id"),
        F.struct(F.expr("left(text, room)").alias("head"), leaf_set(F.col("text")).alias("leaves")).alias("after"),
    )
    # min: one of them where rows share an id.
    after = after.groupBy("doc_id").agg(F.min("after").alias("after"))
    both = known.join(after, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "after")
    # The new name lets Spark see that both joins start from equal rows.
    both = both.unionByName(base.filter("doc_id IS NULL").withColumnRenamed("doc_id", "id"), allowMissingColumns=True).select(
        F.col("id").alias("doc_id"), "text", F.length("text").cast("long").alias("n_chars"),
        F.coalesce(F.col("after.head"), F.lit("")).alias("head"),
        F.coalesce(F.col("after.leaves"), F.array().cast("array<bigint>")).alias("next_leaves"),
    )
    both = both.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(head, int(n_chars div 2)))"))
    both = both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_leaves",
        sections(F.col("text")).alias("tree"), sections(F.col("edited")).alias("edited_tree"),
        leaf_set(F.col("text")).alias("leaves"), leaf_set(F.col("edited")).alias("edited_leaves"),
    )
    both = both.withColumns({"fingerprint": root(F.col("tree")), "edited_fingerprint": root(F.col("edited_tree"))})
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        F.when(F.col("fingerprint") == F.col("edited_fingerprint"), F.lit(0))
        .otherwise(F.size(differing(F.col("tree"), F.col("edited_tree")))).cast("long").alias("n_edited_paragraphs"),
    )
