"""Adaptive-bound codes, decision lists and tokenizer alignment: brute force and the defined odd cases."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bomscope.llm import alignment, codes, queries, rules
from bomscope.llm.common import attached

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- joins that split hot keys


def test_attached_keeps_every_row(spark):
    rows = spark.createDataFrame([(k, None if k < 400 else k % 700) for k in range(1500)], "n int, k int")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("s"))
    got = {(r.n, r.k, r.s) for r in attached(rows, facts, "k", "met").collect()}
    sums = Counter()
    for k in range(1500):
        sums[None if k < 400 else k % 700] += k
    assert got == {(k, None if k < 400 else k % 700, sums[None if k < 400 else k % 700]) for k in range(1500)}


# -- op11


def plain_codes(vectors, entries=64, rounds=2):
    """(codes, errors, books) by measuring everything, in Python integers."""
    x = [[math.floor(256 * v) for v in vector] for vector in vectors]
    m = len(x[0]) // 16
    parts = [[v[p * m : (p + 1) * m] for p in range(16)] for v in x]
    books = [[list(parts[k][p]) for k in range(min(entries, len(x)))] for p in range(16)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            own = [near(v[p], books[p])[1] for v in parts]
            for e in range(len(books[p])):
                mine = [parts[k][p] for k in range(len(x)) if own[k] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[near(v[p], books[p]) for p in range(16)] for v in parts]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return ["".join(f"{e:02x}" for _, e in row) for row in found], [sum(d for d, _ in row) for row in found], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("count, width, entries, spreading", [(300, 32, 64, 1.0), (400, 16, 16, 0.02), (40, 48, 64, 3.0), (150, 16, 1, 1.0)])
def test_codes_equal_full_search(spark, count, width, entries, spreading):
    rng = np.random.default_rng(count)
    x = (rng.normal(0, spreading, (count, width)) + rng.integers(0, 3, (count, 1))).astype(np.float32)
    rows = spark.createDataFrame([(k, [float(c) for c in v], k % 3) for k, v in enumerate(x)], VECTORS).repartition(3)
    got = sorted(codes.compress(rows, entries).collect())
    want, errors, digest = plain_codes(x.tolist(), entries)
    assert [r.code for r in got] == want and [r.error for r in got] == errors
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = [sum(e for k, e in enumerate(errors) if k % 3 == label) for label in range(3)]
    assert all(r.label_error == sums[r.label] for r in got)


def test_bounds_save_distances_and_shrink():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 4))
    code, near, lower, outer, _ = codes.nearest(x, centres, 8)
    after = centres + rng.integers(-20, 20, centres.shape)
    moved = codes._moved(centres[None], after[None])[0]
    lower, outer = codes.below(lower).astype(float), codes.below(outer).astype(float)
    again, listed, low, out, best, need = codes.renewed(x, after, moved, code, near, lower, outer)
    d = codes.squared(x, after)
    assert (again == d.argmin(1)).all() and (best == d.min(1)).all()
    assert (need == 0).mean() > 0.9 and codes.shrunk(need, 8, 64) == 4
    # The stored bounds hold, for each listed entry and for all others.
    roots = np.sqrt(np.take_along_axis(d, listed, 1))
    assert (low <= roots + 1e-9).all()
    others = np.ones_like(d, bool)
    np.put_along_axis(others, np.concatenate([again[:, None], listed], 1), False, 1)
    assert (np.where(others, np.sqrt(d), np.inf).min(1) >= out - 1e-9).all()


def test_half_precision_bounds_are_below():
    values = np.concatenate([np.random.default_rng(1).uniform(0, 70000, 5000), [0.0, 1e-9, 65504.0, 65505.0, 1e9, np.inf, -3.0]])
    half = codes.below(values).astype(np.float64)
    assert (half <= np.maximum(values, 0)).all() and np.isinf(half[-2]) and half[-1] == 0


def test_codes_odd_rows(spark):
    v = [k / 16 for k in range(16)]
    rows = [
        (1, v, 1), (1, v, 1), (2, None, 1), (3, [*v[:15], None], 1), (4, [*v[:15], float("nan")], 2), (5, [*v[:15], float("inf")], 2), (6, v[:5], 2),
        (7, [], None), (None, v[::-1], None), (9, [*v[:15], 3e38], None), (10, [0.0] * 32, 3),
    ]
    table = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("code", "parts", "error", "met", "_key", "v")])
    got = codes.compress(table).collect()
    assert sorted((r.vec_id for r in got), key=str) == [1, 1, 10, 6, 7, 9, None]
    by = {r.vec_id: r for r in got}
    assert by[1].code and by[None].code and by[1].error == 0
    assert all(by[k].code is None and by[k].error is None for k in (6, 7, 9, 10))
    assert by[None].label_error == by[None].error == by[7].label_error and by[10].label_error is None
    assert codes.compress(table.limit(0)).collect() == []


# -- op12


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    several = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in several for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    few = [" ".join(rng.choice(["a", "b", "é|", "\n", "\x0b", "dd\n"], rng.integers(0, 60))) for _ in range(60)]
    texts = [*few, "", None, " ", "\n \n\t", "x " * 8, "x " * 9, "a b  c\x1cd", "1 2 3 4 5 6 7 8 " * 3, "eight words are here and no more there", "\n".join(["same line"] * 5)]
    texts.append(" ".join(f"w{k % 900}" for k in range(20_000)))
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in rules.statistics(docs).collect()}
    assert got == {k: plain_counts(t) for k, t in enumerate(texts)}


def test_a_text_with_a_million_words_takes_linear_time(spark):
    text = " ".join(f"w{k}" for k in range(1_000_000)) + " w0 w1 w2 w3 w4 w5 w6 w7"
    docs = spark.createDataFrame([(1, text, None, None, None)], DOCS)
    assert rules.statistics(docs).select(*COUNTS).first()[4] == 16


def rated(spark, rows):
    """Labelled rows from (rate values by name, bad)."""
    return spark.createDataFrame([(*[float(r.get(c, 0)) for c in rules.RATES], bad, k % 3 != 0) for k, (r, bad) in enumerate(rows)],
                                 ", ".join(f"{c} double" for c in rules.RATES) + ", bad boolean, grows boolean")


def test_learns_a_planted_conjunction_and_the_order(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        r = {"symbol_rate": rng.random(), "mean_word": 10 * rng.random(), "digit_rate": rng.random()}
        rows.append((r, bool((r["symbol_rate"] > 0.7 and r["mean_word"] <= 5) or r["digit_rate"] > 0.95)))
    learned = rules.learn(rated(spark, rows))
    assert any({c.rate for c in rule} == {"symbol_rate", "mean_word"} for rule in learned) and any(rule[0].rate == "digit_rate" for rule in learned)

    def verdict(r):
        for k, rule in enumerate(learned, 1):
            if all((r.get(c.rate, 0.0) > c.limit) == c.above for c in rule):
                return k
        return 0

    assert np.mean([(verdict(r) > 0) == bad for r, bad in rows]) > 0.95
    frame = rated(spark, rows[:300])
    assert [x.f for x in frame.select(rules.fired(learned).alias("f")).collect()] == [verdict(r) for r, _ in rows[:300]]
    texts = rules.as_sql(learned)
    assert [x.f for x in frame.selectExpr("CASE " + " ".join(f"WHEN {t} THEN {k}" for k, t in enumerate(texts, 1)) + " ELSE 0 END AS f").collect()] == [
        verdict(r) for r, _ in rows[:300]]


def test_learns_nothing_from_noise_or_one_label(spark):
    rng = np.random.default_rng(2)
    noise = [({c: rng.random() for c in rules.RATES}, bool(rng.random() < 0.5)) for _ in range(600)]
    covered = rules.learn(rated(spark, noise))
    assert len(covered) <= 1
    assert rules.learn(rated(spark, [({}, True)] * 20)) == [] and rules.learn(rated(spark, [])) == []


def test_held_out_rows_are_told_apart(spark):
    docs, labels = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    rows = rules.filter_quality(docs, labels.filter(~fold)).join(labels.filter(fold), "doc_id").filter("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) >= 0.97 and np.mean([not r.kept for r in bad]) >= 0.8


def test_rules_odd_rows(spark):
    long = "Zeta eta theta iota kappa. " * 3000
    rows = [(1, "few words", "en", "s", 1), (1, "few words", "en", "s", 1), (2, None, None, None, None), (None, long, None, None, None), (4, "", "en", "s", 0), (5, long + "end", "en", "s", 9)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(2).alias(c) for c in ("words", "t", "rule", "kept", "label", "n_words")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (5, 7), (77, 0), (4, None)], "doc_id long, quality int")
    got = rules.filter_quality(docs, labels).collect()
    assert len(got) == 6 and all(r.base_failed and not r.kept for r in got)
    assert sorted((r.n_words for r in got)) == [0, 0, 2, 2, 15000, 15001]
    assert rules.filter_quality(docs.limit(0), labels.limit(0)).collect() == []


# -- op13


def plain_alignment(texts):
    """Measures by comparing byte ranges one by one; equal texts are encoded again."""
    pair = alignment.tokenizers(*PATHS)

    def ranges(ids, spelling):
        at, out = 0, []
        for k in ids:
            out.append((at, at + len(spelling[k]), k))
            at += len(spelling[k])
        return out

    found, tally = [], Counter()
    for text in texts:
        (a, b), = pair.encode([text or ""])
        spelled = b" " + (text or "").encode()
        if not text or b"".join(pair.bytes_a[k] for k in a) != spelled or b"".join(pair.bytes_b[k] for k in b) != spelled:
            found.append(None)
            continue
        a, b = ranges(a, pair.bytes_a), ranges(b, pair.bytes_b)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        tally.update(links)
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, low = [], 0
        for high in cuts:
            inside = [",".join(str(k) for s, e, k in side if low <= s and e <= high) for side in (a, b)]
            groups.append("|".join(inside))
            low = high
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in tally.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(tally[x] == best[x[1]] for x in f[3]), sum(tally[x] for x in f[3]), f[4]) for f in found]


def measures(rows):
    return [tuple(r[c] for c in alignment.MEASURES) for r in rows]


ODD_TEXTS = [
    "plain words", "plain words", None, "", " ", "  two  blanks ", "tab\there\r\nand lines\n\n", "über naïve façade", "日本語のテキスト", "<|endoftext|> and <s> </s> <0x41> <unk>",
    "a\u0000b", "▁ low line ▁", "🙂🙃 mixed é̂ ​", "x" * 3000, " " * 2000, " nbsp 　wide", "1234567890 " * 50,
]


@pytest.mark.parametrize("bound", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, bound):
    some = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()[:12]]
    texts = ODD_TEXTS + [t[:1500] for t in some]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)] + [(None, texts[0], None, None, None), (3, texts[0], None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(2).alias(c) for c in ("name", "met", "pair", "pairs", "times", "best", "count")])
    want = Counter(zip([r[0] for r in rows], plain_alignment([r[1] for r in rows])))
    got = alignment.align(docs.repartition(3), *PATHS, broadcast_pairs=bound).collect()
    assert Counter(zip([r.doc_id for r in got], measures(got))) == want
    assert any(m == (0, 0, 0, 0, 0, 0, "") for _, m in want) and any(m[2] < min(m[:2]) for _, m in want)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), *PATHS).collect() == []


def test_vectors_match_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rel = con.sql(queries.ORACLE["op11_adaptive_bound_codes"])
    df = queries.op11_adaptive_bound_codes(spark, SF)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())
