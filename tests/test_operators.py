import math
import random

import pytest
from pyspark.sql import functions as F

from findara.functions.scores import RESEARCHER_ROLES, WEIGHTS
from findara.operators import facets, opportunities
from findara.operators.evaluation import metrics, nearest_percentile, silver
from findara.operators.graph import ForeignKey, Relation, dangling, edges, induced, neighbours, nodes, two_steps
from findara.operators.lexical import LexicalIndex, top
from findara.operators.propagation import best_of, bridged, contributions, matched, mode, spread
from findara.operators.ranking import hybrid, mmr, nearest


def test_tfidf_by_formula(spark):
    texts = {1: "gato perro gato", 2: "perro casa", 3: "casa casa verde"}
    index = LexicalIndex.fit(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text")
    docs = {k: t.split() for k, t in texts.items()}
    grams = {k: w + [f"{a} {b}" for a, b in zip(w, w[1:])] for k, w in docs.items()}
    df = {g: sum(g in x for x in grams.values()) for x in grams.values() for g in x}
    want = {}
    for k, g in grams.items():
        raw = {t: (1 + math.log(g.count(t))) * (math.log(4 / (1 + df[t])) + 1) for t in set(g)}
        size = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(k, t): v / size for t, v in raw.items()}
    got = {(r["id"], r["term"]): r["w"] for r in index.weights.collect()}
    assert got == pytest.approx(want)
    asked = index.similarities(spark.createDataFrame([(9, "gato azul"), (8, "nada")], "q long, t string"), "q", "t").collect()
    assert {(r["query"], r["id"]) for r in asked} == {(9, 1)} and 0 < asked[0]["similarity"] < 1


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 4, 0.5), (1, 1, 0.2)], "q int, id int, s double")
    assert [(r["id"], r["rank"]) for r in top(df, 2, "s", ["q"], ["id"]).orderBy("rank").collect()] == [(3, 1), (4, 2)]


def cos(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size > 1e-12 else 0.0


def greedy(items, k, weight):
    rest, out = sorted(items, key=lambda x: (-x[1], x[0])), []
    most = max(x[1] for x in rest) or 1.0
    while rest and len(out) < k:
        best = max(rest, key=lambda x: weight * x[1] / most - (1 - weight) * (max(cos(x[2], y[2]) for y in out) if out else 0.0))
        out.append(best)
        rest.remove(best)
    return [x[0] for x in out]


@pytest.mark.parametrize("weight", [0.7, 1.0, 0.3])
def test_mmr_against_a_loop(spark, weight):
    rng = random.Random(8)
    queries = {q: [(i, rng.random(), [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)] for q, n in ((1, 30), (2, 3), (3, 70))}
    pool = spark.createDataFrame([(q, *x) for q, items in queries.items() for x in items], "query int, id long, score double, vector array<double>")
    got = {}
    for r in mmr(pool, k=8, weight=weight).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    want = {q: greedy(sorted(items, key=lambda x: -x[1])[:50], 8, weight) for q, items in queries.items()}
    assert got == want
    if weight == 1.0:
        assert got[3] == [x[0] for x in sorted(queries[3], key=lambda x: -x[1])[:8]]


def test_mmr_displaces_a_near_copy(spark):
    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.001]), (1, 3, 0.8, [0.0, 1.0]), (1, 4, 0.1, None)]
    pool = spark.createDataFrame(rows, "query int, id long, score double, vector array<double>")
    ids = lambda w: [r["id"] for r in mmr(pool, k=4, weight=w).orderBy("rank").collect()]
    assert ids(0.7)[:2] == [1, 3] and ids(1.0) == [1, 2, 3, 4]


def test_penalty_and_degradation(spark):
    rows = [(1, 1, 0.5, 0.4, 0.0, 0.2, 0.5, 1.0), (1, 2, 0.5, 0.4, 0.1, 0.2, 0.5, 1.0), (1, 3, None, None, None, None, None, None)]
    pairs = spark.createDataFrame(rows, "query int, id int, semantic double, lexical double, topic double, domain double, method double, evidence double")
    got = {r["id"]: r for r in hybrid(pairs, WEIGHTS).collect()}
    raw = 0.35 * 0.5 + 0.15 * 0.4 + 0.1 * 0.2 + 0.1 * 0.5 + 0.05
    assert got[1]["total"] == pytest.approx(raw / 2) and got[1]["penalty"] == pytest.approx(-raw / 2) and got[1]["relation"] == "metodo_transferible"
    assert got[2]["total"] == pytest.approx(raw + 0.025) and got[2]["penalty"] == 0 and got[2]["relation"] == "antecedente_relevante" and got[3]["total"] == 0
    assert sum(got[2][c] for c in got[2].asDict() if c.startswith("c_")) == pytest.approx(got[2]["total"])
    assert {r["id"]: r["c_semantic"] for r in hybrid(pairs, WEIGHTS, semantic=False).collect()}[2] == 0


def test_nearest(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query int, vector array<float>")
    c = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id int, vector array<float>")
    assert {r["id"]: r["similarity"] for r in nearest(q, c).collect()} == {1: pytest.approx(1), 2: 0, 3: 0}


def test_facets(spark):
    vocab = facets.vocabulary([("topic", spark.createDataFrame([("Redes Neuronales",), ("redes neuronales",), ("",)], "term string")), ("method", spark.createDataFrame([("c++",), ("año",), ("redes neuronales",)], "term string"))])
    assert vocab.count() == 4  # a term can be in two facets
    texts = spark.createDataFrame([(1, "Las REDES neuronales."), (2, "redes, neuronales"), (3, "uso de C++ cada AÑO"), (4, None)], "id int, text string")
    found = facets.extract(texts, vocab, "id", "text")
    assert {(r["id"], r["facet"], r["term"]) for r in found.collect()} == {(1, "topic", "redes neuronales"), (1, "method", "redes neuronales"), (3, "method", "c++"), (3, "method", "ano")}
    shared = facets.overlaps(found.filter("id = 1"), found).filter("facet = 'method'").collect()
    assert {(r["query"], r["id"]): (r["shared"], r["similarity"]) for r in shared} == {(1, 1): (1, 1.0)}


@pytest.fixture(scope="module")
def graph(spark):
    rows = spark.createDataFrame([("P1", "G1", "T1"), ("P2", "", "T2"), ("P3", "G9", "T1"), ("P4", None, "T3")], "id string, g string, t string")
    roles = spark.createDataFrame([("A", "P1", "PI"), ("A", "P1", "OTHER"), ("B", "P1", None), ("B", "P2", "PI"), ("Z", "P1", "PI")], "who string, what string, role string")
    groups = spark.createDataFrame([("A", "G1", "LEADER"), ("A", "G2", "MEMBER"), ("B", "G2", "MEMBER")], "who string, what string, role string")
    ids = spark.createDataFrame([(x,) for x in ("P1", "P2", "P3", "P4", "A", "B", "G1", "G2")], "id string")
    known = nodes([("N", ids, F.col("id"), F.col("id"))])
    return known, edges(known, [ForeignKey(rows, "id", "g", "run_by", "p.csv")], [Relation(roles, "who", "what", "role", "works", "w.csv"), Relation(groups, "who", "what", "role", "member", "m.csv")])


def test_graph(spark, graph):
    known, e = graph
    rows = {(r["src"], r["dst"], r["label"], r["role"], r["record"]) for r in e.collect()}
    assert ("P1", "G1", "run_by", None, "P1") in rows and ("A", "P1", "works", "PI", "A|P1") in rows and len(rows) == 8
    assert dangling(e, known).count() == 0 and e.filter("nature <> 'explicita'").count() == 0
    start = spark.createDataFrame([("P1",)], "id string")
    found = lambda d: sorted(r["neighbour"] for r in neighbours(start, e, ["works", "run_by"], d).collect())
    assert found("in") == ["A", "A", "B"] and found("out") == ["G1"] and found("both") == ["A", "A", "B", "G1"]
    pairs = induced(spark.createDataFrame([("P1",), ("A",), ("G1",)], "id string"), e).collect()
    assert {(r["a"], r["b"], r["label"]) for r in pairs} == {("G1", "P1", "run_by"), ("A", "P1", "works"), ("A", "G1", "member")}
    walk = two_steps(e, "works", "member", spark.createDataFrame([("G2",)], "id string")).collect()
    assert {(r["id"], r["via"], r["end"]) for r in walk} == {("P1", "A", "G2"), ("P1", "B", "G2"), ("P2", "B", "G2")}


def test_propagation(spark):
    sources = spark.createDataFrame([("P1", 0.9), ("P2", 0.8)], "id string, score double")
    steps = spark.createDataFrame([("P1", "A", "ADVISOR", 1), ("P1", "A", "PI", 2), ("P1", "A", "AUTHOR", 3), ("P2", "A", "PI", 4), ("P2", "B", "WHAT", 5), ("P1", "B", None, 6)], "id string, neighbour string, role string, ordinal int")
    found = contributions(sources, steps, RESEARCHER_ROLES)
    got = {(r["id"], r["neighbour"]): (r["role"], r["weight"], r["contribution"]) for r in found.collect()}
    assert got["P1", "A"] == ("PI", 1.0, pytest.approx(0.54))  # one of three parallel edges, the last of the heaviest
    assert got["P2", "B"][:2] == ("WHAT", 0.6) and got["P1", "B"][1] == 0.6
    like = spark.createDataFrame([("A", 0.5), ("B", -0.5)], "neighbour string, similarity double")
    out = {r["neighbour"]: r for r in spread(found, like).collect()}
    assert out["A"]["direct"] == 1.0 and out["A"]["total"] == pytest.approx(1.2) and out["A"]["nature"] == "mixta"  # capped evidence, total above one
    assert out["B"]["direct"] == pytest.approx(0.612) and out["B"]["affinity"] == 0 and out["B"]["nature"] == "explicita"


def test_bridge_and_match(spark):
    items = spark.createDataFrame([(1, "p", 0.1, 0.0), (2, "q", 0.1, 0.0), (3, "q", 0.35, 0.0), (4, "q", 0.0, 0.15)], "id int, program string, sem double, lex double")
    bridges = best_of(spark.createDataFrame([("p", -0.5), ("p", 0.6), (None, 1.0)], "program string, score double"), "program", "score")
    got = {r["id"]: (r["total"], r["nature"]) for r in bridged(items, bridges, "program", F.col("sem"), F.col("lex")).collect()}
    assert got == {1: (pytest.approx(0.34), "mixta"), 3: (pytest.approx(0.14), "inferida"), 4: (pytest.approx(0.06), "inferida")}
    kept = matched(items.withColumn("dom", F.lit(0.1)), F.col("sem"), F.col("lex"), F.col("dom")).collect()
    assert {r["id"] for r in kept} == {3, 4}


def test_mode_ties(spark):
    votes = spark.createDataFrame([("f", "LOW", 1), ("f", "HIGH", 2), ("f", "HIGH", 3), ("f", "LOW", 4), ("g", "A", 5), ("g", "B", 6), ("g", "B", 7), ("h", None, 8)], "file string, level string, n int")
    assert {r["file"]: r["level"] for r in mode(votes, "file", "level", "n").collect()} == {"f": "LOW", "g": "B"}


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (3, "y", 12)], "query int, id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "c"), (1, "z"), (2, "q"), (3, "y")], "query int, id string")
    got = {r["query"]: r for r in metrics(ranking, relevant, 10).collect()}
    ideal = sum(1 / math.log2(i + 2) for i in range(3))
    assert got[1]["precision"] == 0.2 and got[1]["recall"] == pytest.approx(2 / 3) and got[1]["mrr"] == 0.5
    assert got[1]["ndcg"] == pytest.approx((1 / math.log2(3) + 0.5) / ideal)
    assert tuple(got[2])[1:] == (0, 0, 0, 0) and got[3]["precision"] == 0 and got[3]["mrr"] == pytest.approx(1 / 12)
    pairs = silver(spark.createDataFrame([(1, "a"), (1, "b")], "id int, term string"), spark.createDataFrame([(7, "a"), (7, "b"), (8, "a")], "id int, term string"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 7)]
    values = spark.range(20).select(F.col("id").cast("double").alias("v"))
    assert values.agg(nearest_percentile(F.col("v"), 0.5)).first()[0] == 10 and values.agg(nearest_percentile(F.col("v"), 0.95)).first()[0] == 19 and values.limit(0).agg(nearest_percentile(F.col("v"), 0.5)).first()[0] == 0


def test_opportunities(spark):
    need = F.lit("HIGH")
    subjects = spark.createDataFrame([(1, "S1", "p", 0.1, 1), (2, "S2", "q", 0.25, 2), (3, "S3", "r", 0.4, 3), (4, "S4", "r", 0.4, 4)], "id int, name string, program string, score double, rank int")
    sources = spark.createDataFrame([("p", "P", 0.5, 1), ("q", "Q", 0.5, 2), ("r", "R", 0.5, 3), ("s", "S", 0.3, 4)], "program string, program_name string, score double, rank int")
    got = opportunities.integration(sources, subjects, need).orderBy("place").collect()
    assert [(r["related"], r["priority"]) for r in got] == [(["p"], "Alta"), (["r", "3"], "Media"), (["s"], "Media")]  # .25 is neither
    able = spark.createDataFrame([(1, "A", "x", 5, False, 0.5, 1), (2, "A", "x", 4, True, 0.5, 2), (3, "A", "x", 5, True, 0.5, 3), (4, "B", "y", 2, True, 0.4, 4), (5, "C", "z", None, True, 0.3, 5), (6, "D", "w", 3, True, 0.1, 6)], "id int, name string, base string, maturity int, active boolean, score double, rank int")
    assert [r["related"] for r in opportunities.activation(able, need).orderBy("place").collect()] == [["2"], ["6"]]
    people = spark.createDataFrame([(1, "n1", "u", 0.9, 1), (2, "n2", "u", 0.8, 2), (3, "n3", "", 0.7, 3), (4, "n4", "v", 0.6, 4), (5, "n5", "w", 0.1, 5), (6, "n6", "x", 0.1, 6)], "id int, name string, unit string, score double, rank int")
    pairs = opportunities.collaboration(people, need)
    assert [r["related"] for r in pairs.orderBy("place").collect()] == [["1", "4"], ["1", "5"], ["1", "6"]]
    theses = spark.createDataFrame([("T1", "t", 2015, 0.5, 2), ("T0", "t", 2024, 0.6, 1)], "id string, name string, year int, score double, rank int")
    years = spark.createDataFrame([(2015, 2024)], "least int, most int")
    assert opportunities.renewal(theses, years, need).count() == 0 and opportunities.renewal(theses.filter("rank = 2"), years, need).first()["related"] == ["T1"]
    every = opportunities.combined([pairs, opportunities.renewal(theses.filter("rank = 2"), years, need)]).orderBy("position").collect()
    assert [r["priority"] for r in every] == sorted((r["priority"] for r in every), key=["Alta", "Media", "Baja"].index) and every[0]["type"] == "COLLABORATION"


def test_more_queries_than_a_block_are_all_asked(spark, monkeypatch):
    from findara.operators import ranking

    monkeypatch.setattr(ranking, "MOST_QUERIES", 10)
    queries = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(57)], "query long, vector array<double>")
    corpus = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(3)], "id long, vector array<double>")
    assert all(b.count() <= 10 for b in ranking.blocks(queries))
    got = [(r["query"], r["id"]) for r in ranking.nearest(queries, corpus).collect()]
    assert sorted(got) == [(q, i) for q in range(57) for i in range(3)]
