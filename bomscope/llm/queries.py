"""One query per operator over its whole table, and DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomscope.llm import (
    alignment, bpe, codes, exact_dedup, fingerprints, jaccard, language, packing, preferences, quality, rules, warc, wrapper,
)
from bomscope.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(id_col: str, of: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    blanks = F.length("ids") - F.length(F.replace("ids", F.lit(" "), F.lit("")))
    return rows.select(
        "doc_id",
        F.when(F.col("ids") == "", F.lit(0)).otherwise(blanks + 1).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fitted(docs.filter(F.col("lang").isNotNull() & (remainder("doc_id", 3) != 1)))
    return language.identify(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.learn_and_classify(docs, labels.filter(remainder("doc_id", 5) != 0)).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op8_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), 3, jaccard.Limit(90, 100))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"), keep="largest")


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.format_pairs(preferences.contrast_pairs(table(spark, sf_dir, "conversations")))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), " ")
    return pairs.withColumns({"chosen_loss": shown("chosen_loss"), "rejected_loss": shown("rejected_loss")})


def op11_adaptive_bound_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_wrapper_induction, op2_merkle_fingerprints, op3_warc_index, op4_segment_tree_bpe, op5_language_crf,
        op6_cost_balanced_packing, op7_pairwise_quality, op8_signature_tree_join, op9_exact_dedup, op10_preference_format,
        op11_adaptive_bound_codes, op12_decision_list, op13_tokenizer_alignment,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TREE = """
  sha256('R' || list_aggregate(list_transform({s}, lambda s: sha256('S' || list_aggregate(list_transform(string_split(s, chr(10)),
    lambda p: sha256('P' || coalesce(list_aggregate(list_transform(regexp_extract_all(p, '[^.!?]{{1,64}}[.!?]*|[.!?]+'), lambda x: sha256(x)),
    'string_agg', ','), ''))), 'string_agg', ','))), 'string_agg', ','))"""
_LEAVES = """list_distinct(flatten(list_transform(string_split({t}, chr(10)), lambda p: regexp_extract_all(p, '[^.!?]{{1,64}}[.!?]*|[.!?]+'))))"""


def _near(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _assigned(name: str, book: str) -> str:
    """SQL: every part with its nearest entry of a codebook."""
    return f"""
{name} AS MATERIALIZED (SELECT vec_id, i, any_value(x) AS x, min(z).d AS d, min(z).e AS e FROM (
  SELECT vec_id, i, p.x, {{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda w: (w[1] - w[2]) * (w[1] - w[2]))), 'e': e}} AS z
  FROM p JOIN {book} b USING (i)) GROUP BY vec_id, i)"""


def _moved(name: str, book: str, assigned: str) -> str:
    """SQL: the codebook with every used entry at the floored mean of its parts."""
    return f"""
{name} AS MATERIALIZED (SELECT i, e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT i, e, list(v ORDER BY k) AS x FROM (
  SELECT i, e, k, CAST(floor(sum(x[k])::DOUBLE / count(*)) AS BIGINT) AS v FROM {assigned}, range(1, len(x) + 1) r(k) GROUP BY i, e, k)
  GROUP BY i, e) m USING (i, e))"""


ORACLE: dict[str, str] = {
    "op11_adaptive_bound_codes": f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, i, v[i * (len(v) // 16) + 1 : (i + 1) * (len(v) // 16)] AS x FROM v, range(16) r(i)),
n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT i, e, x FROM p JOIN n USING (vec_id)),{_assigned('a0', 'b0')},{_moved('b1', 'b0', 'a0')},{_assigned('a1', 'b1')},{_moved('b2', 'b1', 'a1')},{_assigned('a2', 'b2')},
h AS (SELECT sha256(string_agg(t, ',' ORDER BY i, e)) AS h FROM (SELECT i, e, list_aggregate(x, 'string_agg', ',') AS t FROM b2)),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY i) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN v USING (vec_id), h""",
    "op2_merkle_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n_chars,
  coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next
  FROM d),
e AS (SELECT *, substring(text, 1, n_chars - n_chars // 2) || substring(next, 1, n_chars // 2) AS edited FROM o),
t AS (SELECT *, string_split(text, chr(10) || chr(10)) AS s, string_split(edited, chr(10) || chr(10)) AS es,
  {_LEAVES.format(t='text')} AS a, {_LEAVES.format(t='edited')} AS b, {_LEAVES.format(t='next')} AS c FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_TREE.format(s='s')} AS fingerprint, {_TREE.format(s='es')} AS edited_fingerprint,
  {_near('a', 'b')} AS near_edited, {_near('a', 'c')} AS near_next,
  coalesce(list_sum(list_transform(range(1, greatest(len(s), len(es)) + 1), lambda i:
    len(list_filter(range(1, greatest(len(string_split(s[i], chr(10))), len(string_split(es[i], chr(10)))) + 1),
      lambda j: string_split(s[i], chr(10))[j] IS DISTINCT FROM string_split(es[i], chr(10))[j])))), 0)::BIGINT AS n_edited_paragraphs
FROM t""",
    "op3_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS f FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substring(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM p JOIN f USING (h)""",
    "op8_signature_tree_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.u AS component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT v, min(u) AS u FROM r GROUP BY v) m ON m.v = d.doc_id""",
    "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op10_preference_format": """
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, t, coalesce(list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')), len(t)) AS i FROM c),
e AS (SELECT conv_id, t, t[1:i - 1] AS head, t[i:] AS tail FROM b),
o AS (SELECT conv_id, t, head, coalesce(lead(tail) OVER (ORDER BY conv_id),
  first(tail) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM e),
q AS (SELECT conv_id, t, list_concat(head, other) AS r FROM o),
k AS (SELECT conv_id, t, r, coalesce(list_min(list_filter(range(1, greatest(len(t), len(r)) + 1), lambda j: t[j] IS DISTINCT FROM r[j])) - 1, len(t)) AS n FROM q),
s AS (SELECT conv_id, n, list_transform(t[1:n], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS p,
  list_transform(t[n + 1:], lambda x: {'role': x.role, 'h': '<|im_start|>' || x.role || chr(10), 'a': x.text || '<|im_end|>' || chr(10)}) AS c,
  list_transform(r[n + 1:], lambda x: {'role': x.role, 'h': '<|im_start|>' || x.role || chr(10), 'a': x.text || '<|im_end|>' || chr(10)}) AS r FROM k)
SELECT conv_id, n::BIGINT AS prompt_turns, coalesce(list_aggregate(p, 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate(list_transform(c, lambda x: x.h || x.a), 'string_agg', ''), '') AS chosen,
  coalesce(list_aggregate(list_transform(list_filter(range(1, len(c) + 1), lambda j: c[j].role = 'assistant'), lambda j:
    (coalesce(list_sum(list_transform(c[1:j - 1], lambda y: length(y.h) + length(y.a))), 0) + length(c[j].h))::BIGINT || '-'
    || coalesce(list_sum(list_transform(c[1:j], lambda y: length(y.h) + length(y.a))), 0)::BIGINT), 'string_agg', ' '), '') AS chosen_loss,
  coalesce(list_aggregate(list_transform(r, lambda x: x.h || x.a), 'string_agg', ''), '') AS rejected,
  coalesce(list_aggregate(list_transform(list_filter(range(1, len(r) + 1), lambda j: r[j].role = 'assistant'), lambda j:
    (coalesce(list_sum(list_transform(r[1:j - 1], lambda y: length(y.h) + length(y.a))), 0) + length(r[j].h))::BIGINT || '-'
    || coalesce(list_sum(list_transform(r[1:j], lambda y: length(y.h) + length(y.a))), 0)::BIGINT), 'string_agg', ' '), '') AS rejected_loss FROM s""",
}
