"""Candidates straight from the texts against the index and the frame of all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from findara.functions.text import folded
from findara.operators import candidates as c
from findara.operators import facets
from findara.operators.lexical import LexicalIndex, term_counts, top
from findara.operators.signals import signals
from findara.plans import score_queries as q

DATA = "/root/testdata/sf0.001"
WEIGHTS = [{"semantic": 0.35, "lexical": 0.15, "topic": 0.25, "domain": 0.1, "method": 0.1, "evidence": 0.05}, {"lexical": 1.0}, {"semantic": 1.0}, {"topic": 0.5, "domain": 0.3, "method": 0.2}]
AWKWARD = [
    None, "", " ", "a b c", "Él  está aquí, él está AQUÍ", "x y\nél está", "ΣΑΣ ΟΔΟΣ", "İstanbul ǅ ﬁn ½ ²³", "日本語 日本語 𝒜𝒷 𝟙𝟚 🙂 ok_1", "café au lait", "au lait cafe", "está aquí" * 3, "lait́ au  lait", "́́ ﹰx y", "longestword longestword a longestword",
]


@pytest.fixture(scope="module")
def word(spark):
    return c._flags(c.word_characters(spark))


def lowered(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return rows, [r["t"] for r in rows.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).orderBy("id").collect()]


def test_terms_are_those_of_the_index(spark, word, monkeypatch):
    monkeypatch.setattr(c, "SLICE", 5)
    rows, lower = lowered(spark, AWKWARD)
    text, term, tf = c.grams(*c._joined(lower), word)
    want = sorted((r["id"], r["term"], r["tf"]) for r in term_counts(rows, "id", "text").collect())
    # A term's hash does not depend on the text around it.
    alone = {t: c.grams(*c._joined([t]), word) for t in {w[1] for w in want}}
    hashes = {t: c._runs(c._codes(t), word)[2] for t in alone}
    hashes = {t: h[0] if len(h) == 1 else c._pair(h[:1], h[1:])[0] for t, h in hashes.items()}
    assert len(set(hashes.values())) == len(hashes)
    assert sorted(zip(text.tolist(), term.tolist(), tf.tolist())) == sorted((i, int(hashes[t]), n) for i, t, n in want)


def test_facets_are_those_extracted(spark, word):
    rows, lower = lowered(spark, AWKWARD)
    terms = ["está aqui", "esta aqui", "el esta", "au lait", "lait", "a b", "b", "longestword", "istanbul", "日本語 日本語", "σας", "x y", "cafe au"]
    vocab = spark.createDataFrame([("topic", t) for t in terms], "facet string, term string").select("facet", folded(F.col("term")).alias("term")).distinct()
    names = [r["term"] for r in vocab.collect()]
    hashes = np.array([c.words(*c._joined([t]), word, c._folds())[1][-1] for t in names], np.uint64)
    order = np.argsort(hashes)
    text, place = c._facet_places(*c._joined(lower), word, c._folds(), c.Known(hashes[order]))
    got = sorted((int(t), names[order[p]]) for t, p in zip(text, place))
    assert got == sorted((r["id"], r["term"]) for r in facets.extract(rows, vocab, "id", "text").collect())


def test_the_best_are_among_them(spark, monkeypatch):
    """Many ties, texts without vectors, more texts than a slice has."""
    monkeypatch.setattr(c, "ROWS", 7)
    rng = np.random.default_rng(3)
    some = ["red fox", "blue fox", "grey owl", "old tree", "a river", "señor gato", ""]
    docs = spark.createDataFrame([(900 - k, " ".join(rng.choice(some, int(rng.integers(0, 5)))), float(rng.integers(0, 3)) / 3) for k in range(300)], "id long, text string, evidence double")
    items = spark.createDataFrame([(1, "red fox and grey owl"), (2, "señor gato, old tree"), (5, "nothing shared"), (7, "")], "query long, text string")
    vectors = spark.createDataFrame([(int(k), [float(x) for x in rng.integers(-1, 2, 4)]) for k in [1, 2, *range(700, 850)]], "id long, vector array<double>")
    vocab = facets.vocabulary([("topic", spark.createDataFrame([("red fox",), ("grey owl",), ("fox grey",), ("old tree",)], "term string")), ("method", spark.createDataFrame([("señor gato",)], "term string")), ("domain", spark.createDataFrame([("gato",)], "term string"))])
    size = c.plain(docs.select("id", F.octet_length("text").alias("size")), items, vectors, vocab)
    assert size[0] == 300
    corpus, asked = docs.select("id", "evidence").join(vectors, "id", "left"), items.join(vectors.withColumnRenamed("id", "query"), "query", "left")
    got = c.candidates(docs.select("id", "text"), corpus, asked, vocab, WEIGHTS, 5, 2, size)
    index = LexicalIndex.fit(docs, "id", "text")
    found, own = facets.extract(docs, vocab, "id", "text"), facets.extract(items, vocab, "query", "text")
    every = signals(corpus, asked.select("query", F.col("vector").alias("asked_vector")), index.weights, index.asked(items, "query", "text"), found, own)
    for v, w in enumerate(WEIGHTS):
        best = lambda df: [tuple(r) for r in top(df.select("query", "id", q._variant_score(w).alias("s")), 5, "s", ["query"], ["id"]).orderBy("query", "rank").collect()]  # noqa: B023, E731
        assert best(got.filter(f"variant = {v}")) == best(every) and len(best(every)) == 20
    topics = lambda df, k: {(r[k], r["term"]) for r in df.filter("facet = 'topic'").withColumnRenamed("id", k).collect()}
    a, b = topics(own, "query"), topics(found, "id")
    shared = {(x, y) for x, _ in a for y, _ in b if len({t for i, t in a if i == x} & {t for i, t in b if i == y}) >= 2}
    assert {(r["query"], r["id"]) for r in got.filter("variant < 0").collect()} == shared and shared


def test_what_is_not_plain_is_told(spark):
    docs, items, vectors, vocab = (lambda *rows, s=s: spark.createDataFrame(list(rows), s) for s in ("id long, size int", "query long, text string", "id long, vector array<float>", "facet string, term string"))
    fine = (docs((1, 3), (2, 0)), items((1, "x")), vectors((1, [1.0])), vocab(("topic", "a b")))
    assert c.plain(*fine) == (2, 3)
    odd = [docs((1, 1), (1, 2)), docs((None, 1)), items((1, "x"), (1, "y")), vectors((1, [1.0]), (2, [1.0, 2.0])), vectors((1, [float("nan")])), vectors((1, None)), vocab(("topic", "a b c")), vocab(("topic", "a-b"))]
    for at, df in zip((0, 0, 1, 2, 2, 2, 3, 3), odd, strict=True):
        assert c.plain(*fine[:at], df, *fine[at + 1 :]) is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_ablation_mmr_needs_neither_index_nor_all_pairs(spark, monkeypatch):
    wanted = top(q._swept(spark, DATA), 50, "score", ["variant", "query"], ["id"]).select("variant", "query", "id", "score")
    wanted, relevant = sorted(map(tuple, wanted.collect())), sorted(map(tuple, q._relevant(spark, DATA).select("query", "id").collect()))

    def refuse(*_):
        raise AssertionError("all pairs")

    for name in ("_swept", "_relevant", "lexical_index", "document_facets", "all_signals"):
        monkeypatch.setattr(q, name, refuse)
    pools, pairs = q._variant_pools(spark, DATA)
    got = top(pools, 50, "score", ["variant", "query"], ["id"]).select("variant", "query", "id", "score")
    assert sorted(map(tuple, got.collect())) == wanted and sorted(map(tuple, pairs.collect())) == relevant
    assert q.ablation_mmr(spark, DATA).count() == 5
