import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from findara.functions import assistant
from findara.functions import evidence as ev
from findara.functions.scores import WEIGHTS, band, completeness, effective, jaccard, priority, recency
from findara.functions.text import bigrams, digits, first_of, folded, has_word, joined, mended, ngrams, tokens, value, values, without_suffix
from findara.functions.vectors import cosine


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def run(df, c):
    return df.select(c.alias("x")).first()["x"]


def test_values(one):
    assert run(one, value(F.lit("  a "))) == "a" and run(one, value(F.lit(None).cast("string"))) == ""
    assert run(one, values(F.lit(" a; ;b;"))) == ["a", "b"] and run(one, values(F.lit(None).cast("string"))) == []
    assert run(one, mended(F.lit("una;frase;sola"))) == "una frase sola"
    assert run(one, joined([F.lit("a"), F.lit(""), F.lit("b")])) == "a . b"
    assert run(one, first_of([F.lit(" "), F.lit(None), F.lit("n")], F.lit(7))) == "n" and run(one, first_of([F.lit("")], F.lit(7))) == "7"
    assert run(one, without_suffix(F.lit("Laboratorio — capacidad 07 "))) == "Laboratorio"


@pytest.mark.parametrize("text,want", [("2020", 2020), ("-1", None), (" 3", None), ("3.5", None), ("", None), (None, None), ("99999999999", None)])
def test_digits(one, text, want):
    assert run(one, digits(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text", ["  ÁÉÍÓÚÜÑ ç ô ", "Straße œuvre", "plain", "ĀĒǍǨ", ""])
def test_folding(spark, text):
    want = "".join(c for c in unicodedata.normalize("NFKD", text.lower().strip()) if not unicodedata.combining(c))
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(folded(F.col("t"))).first()[0] == want


def test_folding_for_all_of_unicode(spark):
    """Combining marks, letters with several, full-width and mathematical ones; ligatures stay."""
    texts = ["cafe\u0301 x²", "ḿṩ Ａｂ 𝐱", "ﬁn", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(folded(F.col("t"))).collect()] == ["cafe x2", "ms ab x", "ﬁn", None]


def test_tokens_and_ngrams(one):
    text = "El niño-año, a x_1 ½! Día"
    words = re.findall(r"\b\w\w+\b", text.lower())
    assert run(one, tokens(F.lit(text))) == words
    assert run(one, ngrams(tokens(F.lit(text)))) == words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    for t, want in (("", []), ("uno", []), ("uno dos", ["uno dos"])):
        assert run(one, bigrams(tokens(F.lit(t)))) == want


@pytest.mark.parametrize("text,term,want", [("red neuronal.", "red neuronal", True), ("red, neuronal", "red neuronal", False), ("redes", "red", False), ("la red", "red", True), ("a_red", "red", False), ("c++ y", "c++", True), (r"x \E y", r"\E", True)])
def test_whole_words(one, text, term, want):
    assert run(one, has_word(F.lit(text), F.lit(term))) is want


def test_scores(one):
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert run(one, jaccard(strings(), strings())) == 0 and run(one, jaccard(strings("a", "b"), strings("b", "c"))) == pytest.approx(1 / 3)
    vector = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert run(one, cosine(vector(1, 2), vector(2, 4))) == pytest.approx(1) and run(one, cosine(vector(0, 0), vector(1, 1))) == 0
    assert run(one, cosine(F.lit(None).cast("array<double>"), vector(1, 1))) == 0 and run(one, cosine(vector(1, 0), vector(-1, 0))) == pytest.approx(-1)
    assert [run(one, band(F.lit(x))) for x in (0.45, 0.449, 0.25, 0.2, -1.0)] == ["Alta", "Media", "Media", "Baja", "Baja"]
    assert run(one, completeness([F.lit("a"), F.lit(""), F.lit("b"), F.lit("")])) == 0.5


def test_recency(one):
    year = lambda y, a, b: run(one, recency(F.lit(y).cast("int"), F.lit(a), F.lit(b)))
    assert year(None, 2015, 2020) == 0.8 and year(2015, 2015, 2015) == 0.6 and year(2020, 2015, 2020) == 1.0 and year(2030, 2015, 2020) == 1.0 and year(2016, 2015, 2020) == pytest.approx(0.68)


@pytest.mark.parametrize("need,mean,want", [("HIGH", 0.45, "Alta"), ("HIGH", 0.3, "Media"), ("MEDIUM", 0.25, "Media"), ("MEDIUM", 0.5, "Media"), ("LOW", 0.5, "Media"), ("LOW", 0.44, "Baja"), ("HIGH", 0.1, "Baja")])
def test_priority(one, need, mean, want):
    assert run(one, priority(F.lit(need), F.lit(mean))) == want


def test_weights_without_vectors():
    got = effective(WEIGHTS, False)
    assert got["semantic"] == 0 and got["lexical"] == 0.5 and math.isclose(sum(got.values()), 1) and effective(WEIGHTS, True) == WEIGHTS


def test_assistant(spark, one):
    said = lambda *x: run(one, assistant.answer(F.lit(x[0]).cast("string"), F.lit(x[1]).cast("string"), F.lit(x[2]).cast("string"), F.lit(x[3]), F.lit(x[4]).cast("string")))
    assert said(None, None, None, 0, None) == assistant.NOTHING
    assert said("N", "Alta", None, 2, "T") == f'{assistant.FOUND} El antecedente más relevante que encontré es "N" (confianza alta). También identifiqué 2 oportunidad(es) institucional(es), como "T". {assistant.DETAIL}'
    items = spark.createDataFrame([([(f"n{k}", "THESIS", f"T{k}", "Alta", 0.5, "e") for k in range(6)],), ([],)], "i array<struct<name string, kind string, id string, band string, score double, explanation string>>")
    lines = [r[0] for r in items.select(assistant.summary(F.col("i"))).collect()]
    assert lines[0].count("\n") == 3 and lines[0].startswith("- n0 (THESIS, id T0), confianza Alta (score 0.50). e") and lines[1] == assistant.EMPTY
    cites = spark.createDataFrame([([["a", "b"], ["b"], ["c", "d", "e", "f"]],)], "c array<array<string>>")
    assert cites.select(assistant.citations(F.col("c"))).first()[0] == list("abcde")
    turns = spark.createDataFrame([(list(range(6)),), ([1],)], "t array<int>")
    assert [r[0] for r in turns.select(assistant.recent(F.col("t"))).collect()] == [[2, 3, 4, 5], [1]]


def test_evidence_and_sentences(one):
    p = ev.provenance("layer", "file.csv", F.lit("R-1"), "title")
    assert run(one, ev.citation(p, "set")) == "set / file.csv / R-1 / title"
    top = run(one, ev.top_fields("l", "f", F.lit("1"), {"a": F.lit("x"), "b": F.lit(""), "c": F.lit("y"), "d": F.lit("z"), "e": F.lit("w")}))
    assert [(e["provenance"]["field"], e["text"]) for e in top] == [("a", "x"), ("c", "y"), ("d", "z")]
    with pytest.raises(ValueError):
        ev.evidence(p, F.lit("t"), "invented")
    with pytest.raises(Exception, match="cites a file"):
        run(one, ev.evidence(p, F.lit("t"), "generada"))
    parts = F.create_map(F.lit("tema"), F.lit(0.2), F.lit("lexico"), F.lit(0.3), F.lit("metodo"), F.lit(0.0), F.lit("dominio"), F.lit(0.1))
    assert run(one, ev.factors(parts, F.lit(True))).startswith("Los factores que más pesaron: coincidencia léxica (TF-IDF) (0.30), solape de tema (0.20). Se aplicó")
    assert run(one, ev.factors(F.create_map(F.lit("tema"), F.lit(0.0)), F.lit(False))) == ""
    strings = F.array(*[F.lit(x) for x in "dbca"])
    assert run(one, ev.shared_terms({"topic": strings, "method": F.lit(None).cast("array<string>")})) == "Términos del vocabulario controlado que comparten: tema: a, b, c."
    told = run(one, ev.explanation(ev.opening(F.lit("antecedente_relevante"), F.lit("N"), F.lit("THESIS"), F.lit("T-1"), F.lit(0.5), F.lit("Alta")), F.lit(""), ev.cited(F.array().cast("array<string>"))))
    assert told == "N (tesis T-1) se identifica como antecedente relevante (score 0.50, banda Alta). No se encontró evidencia textual asociada."
    assert run(one, ev.opening(F.lit("metodo_transferible"), F.lit("N"), F.lit("X"), F.lit("1"), F.lit(0.5), F.lit("Alta"))).startswith("N (x 1) comparte únicamente el método")
    difference = run(one, ev.compared(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("b"), F.lit(0.25))))
    assert difference == {"a": 1.0, "b": -0.25} and run(one, ev.winner(F.lit(1.0), F.lit(1.0))) == "A"
