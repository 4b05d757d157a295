"""Operators of bomscope.llm: brute force, round trips, held-out accuracy, and the defined odd cases."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bomscope.llm import bpe, exact_dedup, fingerprints, jaccard, language, packing, preferences, quality, queries, warc, wrapper
from bomscope.llm.common import with_next

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Zeta eta theta iota. " * 4000


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a clashing extra column."""
    rows = [
        (1, "Aa bb cc dd", "en", "s", 11), (1, "Aa bb cc dd", "en", "s", 11), (2, "aA BB cc dd", None, None, None), (3, "", "en", "s", 0),
        (4, None, None, None, None), (None, "aa bb cc dd", "en", "s", 11), (None, None, None, None, None), (7, LONG, "en", "s", len(LONG)),
        (8, LONG + "x", "en", "s", len(LONG) + 1), (9, "É é", "fr", "s", 3), (10, "!? 12 ²", "fr", "s", 7),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.select("*", *[F.lit(5).alias(c) for c in ("norm", "digest", "cid", "token", "score", "ids", "id", "label", "head")])


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingle_components(rows, k, num, den):
    sets = {i: set(jaccard.shingles((t or "").encode(), k).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: top(i) for i in ids}


# -- op1

def page(article, menu="Home", extra=""):
    return f"<html><body><nav><a href='/'>{menu}</a></nav><div>Same line here</div>{article}{extra}<footer>&copy; x</footer></body></html>"


def test_wrapper_learns_constant_nodes_and_drops_roles(spark):
    rows = [(i, f"http://h.org/{i}", page(f"<div><p>Unique {i} &amp; more</p></div>")) for i in range(8)]
    rows += [(20, "http://one.org/", "<p>A<b>b</b> c<br>d<p>e  \n f<script>x</script><style>p</style><aside>no</aside><div class='cookie-notice'>no</div>"),
             (21, None, None), (22, "http://h.org/9", ""), (23, "http://m.org/", "<main><header><h1>T</h1></header><p>body</p><div id=comments>no</div></main><p>out</p>"),
             (24, "http://u.org/", "<article>cut <foo bar=\"x"), (25, "not a url", "plain &lt; text")]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("z"))
    got = {r.page_id: r.text for r in wrapper.extract(pages).collect()}
    assert wrapper.extract(pages).count() == len(rows)
    assert all(got[i] == f"Unique {i} & more" for i in range(8))
    assert got[20] == "Ab c d e f" and got[21] == "" and got[22] == "" and got[23] == "T body" and got[24] == "cut" and got[25] == "plain < text"
    assert wrapper.extract(pages.limit(0)).count() == 0


def test_wrapper_drops_template_inside_marked_articles(spark):
    """Lines that a host repeats go, a repeated teaser is no article, and copies of an article keep it."""
    rows = [(i, f"http://h.org/{i}", page(f"<article><h1>Story {i}</h1><p>Unique {i}</p><p>Share this <b>now</b></p></article>")) for i in range(8)]
    rows += [(10 + i, f"http://t.org/{i}", page("<article><p>Our weekly letter</p></article>", extra=f"<div><p>Body {i}</p></div>")) for i in range(8)]
    rows += [(20 + i, f"http://c.org/{i}", page("<article><p>One and the same</p></article>", menu=f"M{i}")) for i in range(8)]
    rows += [(30 + i, f"http://few.org/{i}", page(f"<article><p>Unique {i}</p><p>Share</p></article>")) for i in range(3)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"Story {i} Unique {i}" for i in range(8)]
    assert [got[10 + i] for i in range(8)] == [f"Body {i}" for i in range(8)]
    assert {got[20 + i] for i in range(8)} == {"One and the same"}
    assert [got[30 + i] for i in range(3)] == [f"Unique {i} Share" for i in range(3)]  # too few pages for a template


def test_wrapper_finds_articles_without_marks(spark):
    """All marks and class names renamed to div: the same texts on every host with a template, nearly all from slots."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"<(/?)(article|nav|footer)\b", "<$1div"), r"\sclass=\"[^\"]*\"", ""))
    sized = pages.withColumn("host", wrapper.host_of(F.col("url")))
    sized = sized.join(sized.groupBy("host").agg(F.count_distinct("html").alias("n")), "host").filter(f"n > {wrapper.MIN_PAGES}").select("page_id")
    assert bare.filter("html LIKE '%<article%' OR html LIKE '%class=%'").count() == 0
    known = {r.page_id for r in sized.collect()}
    marked, renamed = ({r.page_id: r for r in wrapper.extract(p).collect()} for p in (pages, bare))
    assert len(known) > 100 and all(marked[i].slotted and renamed[i].slotted for i in known)
    assert [i for i in known if marked[i].text != renamed[i].text] == []
    # By plain reading of the generator's pages: the article's text, less nothing.
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert marked[r.page_id].text == " ".join(html.unescape(re.sub("<(?:/?(?:p|h1|br|ul|li|div))[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_wrapper_slots_overrule_names(spark):
    """Names that sound like boilerplate hold the text of a host; comments, however they vary, do not."""
    def host(name, body):
        return [(len(rows) + k, f"http://{name}.org/{k}", f"<html><body><nav><a href=/>Home</a></nav>{body(k)}<footer>Imprint {k}</footer></body></html>") for k in range(7)]

    rows: list = []
    prose = "Words of story number {} go on for a while and then some more. "
    rows += host("title", lambda k: f"<article><div class='article-header'><h1>Title {k}</h1></div><p>{prose.format(k)}</p></article>")
    rows += host("search", lambda k: f"<main><section id='search-results-explained'><p>{prose.format(k)}</p></section></main>")
    rows += host("plain", lambda k: f"<div class='widget'><div><p>{prose.format(k) * 3}</p></div></div><div><p>Teaser {k}</p></div>")
    rows += host("talk", lambda k: f"<div><h1>T{k}</h1><p>{prose.format(k)}</p></div><div class='comments'><p>{('reader %d says so. ' % k) * 9}</p></div>")
    rows += host("side", lambda k: f"<div id=a><div id=b><h1>T{k}</h1></div><div id=c><p>{prose.format(k)}</p><p>Share this</p></div></div>")
    rows += [(900, "http://plain.org/long", "<html><body><nav><a href=/>Home</a></nav><div class='widget'><div>" + f"<p>{prose.format(0)}</p>" * 20_000 + "</div></div></body></html>")]
    rows += [(rows[0][0], "http://title.org/again", rows[0][2])]
    got = defaultdict(list)
    for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].append(r.text)
    words = [prose.format(k).strip() for k in range(7)]
    assert [got[k][0] for k in range(7)] == [f"Title {k} {words[k]}" for k in range(7)] and got[0] == [got[0][0]] * 2
    assert [got[7 + k] for k in range(7)] == [[words[k]] for k in range(7)]
    assert [got[14 + k] for k in range(7)] == [[" ".join([words[k]] * 3)] for k in range(7)]
    assert [got[21 + k] for k in range(7)] == [[f"T{k} {words[k]}"] for k in range(7)]
    assert [got[28 + k] for k in range(7)] == [[f"T{k} {words[k]}"] for k in range(7)]
    assert got[900] == [" ".join([words[0]] * 20_000)]


def test_wrapper_weights_equal_a_plain_sum():
    """Differing prose per element, against a recursion that recounts everything below each one."""
    rng = random.Random(12)

    def source(depth):
        tag, text = rng.choice(["div", "section", "p", "a", "b", "h1"]), rng.choice(["x", "yy y", "zzz"])
        return f"<{tag}>{text}{''.join(source(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ''}</{tag}>"

    def plain(node, twin, linked=False):
        linked = linked or node.tag == "a"
        if node.tag == "#":
            other = twin.get(node)
            return 0 if linked or other is not None and other.text.split() == node.text.split() else wrapper.NAMED * len(" ".join(node.text.split()))
        return sum(plain(c, twin, linked) for c in node.children)

    for _ in range(100):
        a, trees = source(3), wrapper.Trees()
        b = wrapper.parse(source(3))
        pairs = list(trees.aligned(a, b))
        twin = {y: x for x, y in pairs}
        got = {n: w for n, w, _ in wrapper.weights(pairs, b)}
        larger = {x.number: plain(y, twin) for x, y in pairs if x.tag in ("#root", "div", "section", "h1")}
        linked = {x.number for x, y in pairs if x.tag == "a"}
        for n, w in larger.items():
            assert got.get(n, 0) in (w, 0) if linked else got.get(n, 0) == w


def test_tree_matching_equals_plain_recursion():
    random.seed(4)

    def tree(depth):
        n = wrapper.Node(random.choice("abc"))
        n.children = [tree(depth - 1) for _ in range(random.randint(0, 3))] if depth else []
        return n

    def plain(a, b):
        if a.tag != b.tag:
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children, 1):
            for j, y in enumerate(b.children, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain(x, y))
        return 1 + best[-1][-1]

    for _ in range(300):
        a, b, m = tree(3), tree(3), wrapper.Matcher()
        assert m.score(m.shape(a), m.shape(b)) == plain(a, b)


# -- op2

def test_merkle_roots_and_edits(spark):
    texts = ["a. b.\nc\n\nd", "a. b.\nx\n\nd", "a. b.\nc\n\nd", "", "\n", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert got[0].fingerprint == got[2].fingerprint and len({got[i].fingerprint for i in (0, 1, 3, 4, 5)}) == 5
    a, b = (fingerprints.fingerprints(df.filter(f"doc_id = {i}")).select(F.col("tree").alias(n)) for i, n in ((0, "a"), (1, "b")))
    at = a.join(b).select(fingerprints.differing(F.col("a"), F.col("b")).alias("d")).first().d
    assert [(x.section, x.paragraph) for x in at] == [(0, 1)]


def test_edited_pairs_odd_rows(spark):
    got = fingerprints.edited_pairs(odd_documents(spark)).collect()
    assert len(got) == 11 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[3].near_next == 1.0 and by[3].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[2].edited_sha256 == hashlib.sha256(b"aA BB ").hexdigest()  # the next text is empty
    assert fingerprints.edited_pairs(odd_documents(spark).limit(0)).count() == 0
    assert [tuple(r) for r in with_next(spark.range(1).selectExpr("id AS k"), "k").collect()] == [(0, 0)]


# -- op3

def test_archives_round_trip(spark):
    rows = [(5, "http://A.b.org:8080/x?y#z", "é"), (3, "http://b.org/", "é"), (4, "http://b.org/", None), (6, None, ""), (7, "t\tab\nnl", "q"), (None, "http://b.org/", "é")]
    rows += [(100 + i, "http://same.org/", f"{i % 7}") for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(0)).withColumn("digest", F.lit(0))
    got = {r.page_id: r for r in warc.archive_and_read(spark, pages).collect()}
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None)):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        r, f = got[i], first[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if i == f else ("revisit", f))
        assert r.payload_bytes == len((h or "").encode()) and (r.payload is None or r.payload == (h or "").encode())
    assert warc.archive_and_read(spark, pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.read_record(zlib.compress(zlib.decompress(warc.write_record(1, "u", b"abc", None, False), 31).replace(b"abc", b"abd"), wbits=31))


# -- op4

def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.WordBpe(path)
    random.seed(5)
    pool = "aAbBéÉßİΣσ١²½'ʼ’\t\n\r\x0b\x1c\x85 　中字😀é <|startoftext|><|endoftext|> 0!?#_-ǅﬁ"
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 50))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|endoftext|>", "", "ab" * 3000, "'S 't"]
    for text, (ids, shown) in zip(texts, ours.encode(texts)):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and shown == theirs.decode(want, skip_special_tokens=False) == ours.decode(want)
    got = bpe.encode_documents(odd_documents(spark), path).collect()
    assert len(got) == 11 and all(r.ids == "" and r.decoded == "" for r in got if r.doc_id in (3, 4))


def test_bpe_of_very_long_words_and_of_few_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = random.Random(6)
    for word in ("".join(rng.choices("etaoinshrdlu", k=1_000_000)), "a" * 70_000, "中" * 20_000, "é!" * 9_000, "x"):
        ids, _ = ours.encode([word])[0]
        assert ids == " ".join(map(str, theirs.encode(word, add_special_tokens=False).ids))
    few = ["".join(rng.choices("abcdeéß!", k=rng.randint(1, 40))).encode() for _ in range(400)]
    groups = ours.merged(few)
    assert all(ours.merged([w])[0].tolist() == g.tolist() for w, g in zip(few, groups))


def test_bpe_cache_is_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 50)
    model = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["some words here", "other words there", "some more words"] * 3
    assert [model.encode([t])[0] for t in texts] == model.encode(texts)
    for t in texts:
        model.encode([t])
        assert model.cached_chars <= 50 + 200


# -- op5

def test_language_held_out(documents):
    rows = documents.select("doc_id", "lang", "text").collect()
    kept = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = language.fit([(r.lang, r.text) for r in kept])
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    langs, _ = language.predict(model, [r.text for r in test])
    assert np.mean([a == r.lang for a, r in zip(langs, test)]) > 0.95


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 1, 4])
    e, t = rng.normal(size=(8, 2)).astype(np.float32), rng.normal(size=(2, 2))
    got = language.marginals(e, sizes, t)
    start = 0
    for n in sizes:
        want = np.zeros((n, 2))
        for code in range(2**n):
            path = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(e[start + i, s] for i, s in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            for i, s in enumerate(path):
                want[i, s] += w
        assert np.allclose(got[start : start + n], want / want.sum(1, keepdims=True), atol=1e-6)
        start += n


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    got = language.identify(docs, language.fitted(docs.filter("lang IS NOT NULL"))).collect()
    assert len(got) == 11 and {r.lang_pred for r in got if r.doc_id in (3, 4, 10)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.identify(docs, language.fitted(docs.limit(0))).collect()} == {"und"}


def test_any_letter_makes_a_word():
    assert language.words_of("m² x³ 12² ½a ½ _ !") == ["m²", "x³", "½a"]
    model = language.fit([("en", "the miles and square miles"), ("de", "die Meilen und Quadratmeilen")])
    langs, scores = language.predict(model, ["m² km²", "² ³", None])
    assert langs[0] != "und" and scores[0] > 0 and langs[1:] == ["und", "und"] and not scores[1:].any()


def test_training_runs_lie_over_the_whole_text(spark):
    short, long = "one two " * 10, " ".join(f"w{k}" for k in range(20_000))
    rows = spark.createDataFrame([(0, short), (1, long), (2, "x" * 9000), (3, "")], "k int, text string")
    got = {r.k: r.t for r in rows.select("k", language.evenly(F.col("text"), 12, 128).alias("t")).collect()}
    places = [int(w[1:]) for w in got[1].split()]
    assert got[0] == short and got[3] == "" and places[0] < 50 and places[-1] > 19_950 and places == sorted(places)
    assert set(got[1].split()) <= set(long.split()) and np.diff(places).max() < 2500 and len(got[2]) <= 12 * 129


def test_language_of_repeated_ids_and_ties(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en")] * 50 + [(1, "der Hund und die Katze", "de")] * 50 + [(None, "und die", "de")], "doc_id long, text string, lang string")
    got = language.identify(docs, language.fitted(docs)).collect()
    assert sorted((r.lang_pred for r in got)) == ["de"] * 51 + ["en"] * 50


# -- op6

def check_packing(rows, texts):
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    filled, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
        assert r.length > 0
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    for i, text in texts.items():
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(ids, "<u4").tobytes()
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids) and r.length * 4 == len(r.ids)
            at += r.length


def test_packing_round_trip(spark, documents):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    check_packing(packing.pack(documents, *args).collect(), {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()})
    odd = odd_documents(spark).filter("doc_id > 1")
    check_packing(packing.pack(odd, *args).collect(), {r.doc_id: r.text for r in odd.collect()})
    assert packing.pack(odd_documents(spark), *args).agg(F.sum("length")).first()[0] > 0
    assert packing.pack(odd.limit(0), *args).count() == 0


def test_packing_of_very_long_white_space(spark):
    """Runs that the pattern engine has no stack for: the library's ids, in the middle, at the end and beside special tokens."""
    model = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "<|endoftext|>", 50256)
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, n = random.Random(3), packing.LONG_BLANK
    for fill in (" ", "\n", "\u3000", "\t \n", "\x1c "):
        run = (fill * n)[: n + rng.randrange(9)]
        for text in (run, f"a{run}b", f"a {run}'s {run}", f"!{run}7{run[:-1]}\n.", f"x{run}<|endoftext|>{run}y", f"{run}\x1cz", f"{run}\né"):
            assert packing.encode(model, text, "<|endoftext|>", 50256) == theirs.encode(text, add_special_tokens=False).ids, (fill, text.strip())
    rows = [(1, "a" + " " * 1_500_000 + "b"), (2, " \n" * 750_000), (3, "short")]
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), *args).collect(), dict(rows))


def test_layout_takes_the_cheapest_sequence_with_room():
    plan = packing.layout([1000, 900, 1148, 1048], 2048)
    assert sorted((d, q) for d, _, _, q, _ in plan) == [(0, 1), (1, 0), (2, 0), (3, 1)]


# -- op7

def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = queries.remainder("doc_id", 5) == 0
    model = quality.fitted(docs, labels.filter(~held))
    got = quality.classify(docs, model).join(labels.filter(held), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    odd = quality.classify(odd_documents(spark), model).collect()
    assert len(odd) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert {r.score for r in quality.classify(docs.limit(3), quality.fitted(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs.limit(3), quality.fitted(docs, labels.filter("quality = 1"))).collect()} == {1.0}


def test_quality_takes_one_text_of_an_id_and_the_cut_of_all_labelled_rows(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(quality, "TRAIN_TEXTS", 30)
    seen = []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, label, share: seen.append(len(x)) or real(x, label, share))
    many = docs.unionByName(spark.range(3000).select(F.lit(0).alias("doc_id"), F.concat(F.lit("again "), "id").alias("text"), *[F.lit(None).alias(c) for c in ("lang", "source", "n_chars")]))
    model = quality.fitted(many, labels)
    assert seen[0] <= 60
    # Brute force: the quantile of the strengths of every labelled row.
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.text, known[r.doc_id]) for r in many.collect() if r.doc_id in known]
    found = np.sort([model.strengths(quality.features(t)[None])[0] for t, _ in rows])
    share = np.mean([q == 0 for _, q in rows])
    assert abs(np.searchsorted(found, model.cut) - share * len(found)) <= 2
    plain = 1 / (1 + np.exp(-(model.slope * (found - model.cut) + np.log(quality.THRESHOLD / (1 - quality.THRESHOLD)))))
    got = [r.score for r in quality.classify(many, model).join(labels, "doc_id").collect()]
    assert np.allclose(np.sort(got), plain) and abs(np.mean(np.array(got) < quality.THRESHOLD) - share) < 0.02
    once = {(r.doc_id, round(r.score, 9)) for r in quality.learn_and_classify(docs, labels).collect()}
    assert once == {(r.doc_id, round(r.score, 9)) for r in quality.classify(docs, quality.fitted(docs, labels)).collect()}


# -- op8

@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, k, num, monkeypatch):
    """A family of near copies around the limit, shared passages, exact copies and short texts."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "FANOUT", 3)
    rng = random.Random(k)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage, rows = [word() for _ in range(60)], []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    for _ in range(40):
        body = [word() for _ in range(rng.randint(5, 120))]
        rows.append(" ".join(body + passage if rng.random() < 0.7 else body))
    rows += ["", None, "one", "one", "One two", "one\x1ctwo", "a b c", "A  b\nc", "a b c d"] + rows[:5]
    pairs = list(enumerate(rows))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.linked(df, k, jaccard.Limit(num, 100)).collect()}
    want = shingle_components(pairs, k, num, 100)
    assert got == want and len(set(want.values())) < len(want) - 20


def test_components_equal_union_find(spark):
    """Random links, a hub, loops, repeated and reversed links; no links at all."""
    from bomscope.llm.components import components

    rng = random.Random(1)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(260)] + [(ids[0], i) for i in ids[:80]]
    links += [(b, a) for a, b in links[:50]]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {v: top(v) for a, b in links if a != b for v in (a, b)}
    assert len(got) == len(want) and {r.v: r.label for r in got} == want
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_lists_of_shingles_move_once(spark):
    rows = spark.createDataFrame([(i, 10, i // 2, [i // 2 % 7, 1000 + i // 2 % 5, 2000 + i // 2]) for i in range(60)], "doc_id long, n long, cid long, prefix array<long>")
    classes = jaccard.classes_of(rows)
    assert sorted(map(tuple, classes.select("cid", "prefix").collect())) == [(c, [c % 7, 1000 + c % 5, 2000 + c]) for c in range(30)]
    keys = jaccard.buckets(classes, jaccard.Limit(80, 100))
    assert keys.count() and keys.collect()
    plan = keys._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(cid" in line and "Reused" not in line]
    assert len([line for line in moved if "n#" in line]) == 2, plan  # the lists, and the shared shingles of each class


@pytest.mark.parametrize("shingles", [60, 400])
def test_blocks_by_shingles_lose_no_link(spark, shingles, monkeypatch):
    """Chains of sets that only their neighbours link to, cut into very many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    rng = random.Random(shingles)
    text = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [" ".join(text[4 * i : 4 * i + 60]) for i in range(80)] + [" ".join(text[:30] + [f"v{i}{j}" for j in range(30)]) for i in range(40)]
    rng.shuffle(rows)
    pairs = list(enumerate(rows))
    got = {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(pairs, "doc_id long, text string"), 3, jaccard.Limit(80, 100)).collect()}
    assert got == shingle_components(pairs, 3, 80, 100)


def test_sets_travel_once_for_a_family_that_a_task_can_hold(spark):
    members = spark.range(2000).select(F.lit(1).alias("family"), F.lit(30).alias("bin"), F.col("id").alias("cid"), F.col("id").alias("label"), F.lit(25).alias("n"))
    assert jaccard.block_pairs(members).count() == 2000
    large = jaccard.block_pairs(members.withColumn("n", F.lit(200_000)))
    assert large.groupBy("family", "i", "j").count().agg(F.max("count")).first()[0] < 100


def test_only_texts_that_stand_for_a_class_are_moved(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("t"), "id").alias("text")).unionByName(
        spark.createDataFrame([(None, "t3"), (None, None), (3, "other")], "id long, text string"))
    named = jaccard._named_texts(rows, "id", "text")
    wanted = named.filter("doc_id % 100 = 3 OR doc_id IS NULL").select(F.col("doc_id").alias("cid"), F.col("doc_id").alias("stands"), F.col("text_key").alias("stands_key"))
    moved = [(r.doc_id, r.text) for r in jaccard._maybe_wanted(named, wanted).collect()]
    assert {(i, t and bytes(t).decode()) for i, t in moved} >= {(3, "t3"), (3, "other"), (None, "t3"), (None, None), (103, "t103"), (4903, "t4903")}
    assert 53 <= len(moved) < 100 and len(set(moved)) == len(moved)


def test_trees_lose_no_link():
    rng = np.random.default_rng(2)
    limit = jaccard.Limit(80, 100)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(45, 60)], rng.integers(0, 1 << 62, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(60)]
    whole = {(a, b) for a in range(60) for b in range(a) if limit.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}

    def classes(links):
        root = list(range(60))
        for _ in range(60):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    found = jaccard.tree_links(list(range(60)), sets, list(range(60)), limit)
    assert set(map(lambda p: (max(p), min(p)), found)) <= whole and classes(found) == classes(whole)
    across = jaccard.tree_links(list(range(30)), sets[:30], list(range(30)), limit, (list(range(30, 60)), sets[30:], list(range(30, 60))))
    assert classes(across) == classes({(a, b) for a, b in whole if (a < 30) != (b < 30)})


def test_join_odd_rows(spark):
    got = jaccard.linked(odd_documents(spark), 3, jaccard.Limit(90, 100)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1 and by[3].n_shingles == 0 and by[3].component_id == 3 and by[8].component_id == 8
    assert jaccard.linked(odd_documents(spark).limit(0)).count() == 0


# -- op9

def test_exact_dedup_survives_collisions(spark):
    rows = [(1, "AB"), (2, "ab"), (3, "cd"), (4, "É"), (5, "é"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hashed in (exact_dedup.content_hash, lambda t: F.length(t).cast("string")):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(df, "largest", hashed=hashed).collect()}
        assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True), 5: (5, 1, True), 6: (7, 2, False), 7: (7, 2, True)}


def test_exact_dedup_odd_rows(spark):
    docs = odd_documents(spark)
    got = exact_dedup.verdicts(docs).collect()
    assert len(got) == 11 and {r.keep_id for r in got if r.group_size == 4} == {1}
    stay = exact_dedup.survivors(docs)
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3, 7, 8, 9, 10] and stay.columns == docs.columns
    assert exact_dedup.verdicts(docs.limit(0)).count() == 0


# -- op10

def test_preference_pairs(spark):
    T = "array<struct<role:string,text:string>>"
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [u], [u, a]), (4, [a], [b]), (5, [], [u])]
    got = {r.conv_id: r for r in preferences.format_pairs(spark.createDataFrame(rows, f"conv_id long, chosen {T}, rejected {T}")).collect()}
    head = "<|im_start|>user\nhi<|im_end|>\n"
    assert [got[i].prompt_turns for i in range(1, 6)] == [1, 2, 1, 0, 0]
    assert got[1].prompt == head and got[1].chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    s = got[1].chosen_loss[0]
    assert got[1].chosen[s.start : s.stop] == "yes<|im_end|>\n" and got[2].chosen == got[2].rejected == ""
    assert got[3].chosen == "" and got[3].rejected_loss and got[5].chosen == "" and got[5].rejected == head


def test_contrast_pairs_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 1, None, None), (None, 0, "user", "z"), (2, None, "assistant", "r"), (2, None, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("other", F.lit(1))
    got = preferences.format_pairs(preferences.contrast_pairs(df)).collect()
    assert len(got) == 3 and preferences.contrast_pairs(df.limit(0)).count() == 0


def test_contrast_pairs_branch_at_the_last_answer(spark):
    """Against plain Python: a real prefix, sides of different lengths, one very long conversation, and loss wherever an answer is."""
    rng = random.Random(8)
    convs = {i: [(rng.choice(["user", "assistant", "tool"]), rng.choice(["a", "b", "c d"])) for _ in range(rng.randint(1, 6))] for i in range(60)}
    convs[60] = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(20_000)]
    convs[61] = [("user", "only")]
    rows = [(i, k, role, text) for i, turns in convs.items() for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in preferences.format_pairs(preferences.contrast_pairs(df)).collect()}

    def cut(turns):
        return max([k for k, t in enumerate(turns) if t[0] == "assistant"], default=len(turns) - 1)

    def shown(turns):
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)

    for i, turns in convs.items():
        after = convs[(i + 1) % len(convs)]
        rejected = turns[: cut(turns)] + after[cut(after) :]
        n = 0
        while n < min(len(turns), len(rejected)) and turns[n] == rejected[n]:
            n += 1
        r = got[i]
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == (n, shown(turns[:n]), shown(turns[n:]), shown(rejected[n:]))
        for text, spans, rest in ((r.chosen, r.chosen_loss, turns[n:]), (r.rejected, r.rejected_loss, rejected[n:])):
            assert [text[s.start : s.stop] for s in spans] == [f"{t}<|im_end|>\n" for role, t in rest if role == "assistant"]
    assert got[60].prompt_turns == 19_999 and any(len(r.chosen_loss) != len(r.rejected_loss) for r in got.values())


# -- pipeline

def test_pipeline_stages(spark, documents):
    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == documents.columns
            docs = docs.cache()
            assert docs.join(before, ["doc_id", "text"], "left_anti").count() == 0
        if k == 2:
            assert docs.count() == before.select(exact_dedup.ascii_lower(F.col("text"))).distinct().count()
        if k == 3:
            want = shingle_components([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert {r.doc_id for r in docs.collect()} == set(want.values())
    assert docs.agg(F.sum("length")).first()[0] == docs.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_odd_rows(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_language_stage_rejects_what_no_label_fits(spark, documents):
    """Other languages and letters at random go, clean texts stay.  With two labels the scores tell Polish from them no more."""
    rng = random.Random(3)
    strange = [
        "Это предложение написано на другом языке и не должно оставаться в наборе данных. " * 4,
        "Tämä lause on kirjoitettu toisella kielellä eikä sen pitäisi jäädä aineistoon lainkaan tänään. " * 4,
        "To zdanie jest napisane w innym języku i nie powinno pozostać w zbiorze danych. " * 4,
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(200)), "12 34 !?",
    ]
    more = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], DOCS)
    for langs, passing in ((["en", "fr", "de", "es"], set()), (["en", "fr"], {10**9 + 2})):
        clean = documents.filter(F.col("lang").isin(langs)).select(*corpus_pipeline.COLUMNS)
        kept = {r.doc_id for r in corpus_pipeline.identified(spark, clean.unionByName(more), SF).select("doc_id").collect()}
        assert {i for i in kept if i >= 10**9} <= passing and len(kept - passing) >= 0.99 * clean.count()


def test_dedup_stages_keep_one_row_of_each_text(spark):
    """Null and repeated ids: unrelated texts stay, copies go, also under an id that stays with another text."""
    rng = random.Random(8)
    body = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    a, b, c, d, e, f = (" ".join(body()) for _ in range(6))
    near = lambda t: t + " more"
    rows = [(None, a), (None, b), (None, b), (None, c), (5, d), (5, e), (5, d), (7, f), (8, f), (8, near(d)), (None, near(c)), (9, near(e)), (None, "!"), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    exact = [(r.doc_id, r.text) for r in corpus_pipeline.distinct_texts(spark, docs, SF).collect()]
    want = {t: min((i for i, u in rows if u == t and i is not None), default=None) for _, t in rows}
    assert len(exact) == len(want) and {t: i for i, t in exact} == want
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.distinct_shingles(spark, docs, SF).collect()]
    assert len(kept) == 8 and {(i, t) for i, t in kept if t not in (c, near(c))} == {(None, a), (None, b), (5, d), (5, e), (7, f), (None, "!"), (4, "")}
    assert {r.doc_id for r in jaccard.linked(docs, 5).filter("component_id = 5").collect()} == {5, 8, 9}


def test_sql_checks(spark):
    from compare import compare, connect

    con = connect(SF)
    for name, sql in queries.ORACLE.items():
        diff, _ = compare(queries.QUERIES[name](spark, SF), con, sql)
        assert diff is None, (name, diff)


def test_every_query_covers_its_table(spark):
    con = duckdb.connect()
    for name, table in (("op1_wrapper_induction", "pages"), ("op4_segment_tree_bpe", "documents"), ("op5_language_crf", "documents"), ("op7_pairwise_quality", "documents")):
        assert queries.QUERIES[name](spark, SF).count() == con.sql(f"SELECT count(*) FROM '{SF}/{table}.parquet'").fetchall()[0][0]
