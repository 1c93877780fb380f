import random

import numpy as np
from pyspark.sql import functions as F

from findara.llm.language_id import DIMENSIONS, UNKNOWN, held_out, identify, ngram_counts, spherical_kmeans, train, unit_rows


def test_counts_against_a_plain_count():
    """An n-gram adds one each time it occurs, and texts do not reach into each other."""
    counts, has = ngram_counts(["ab", "", "1 2!", "ab ab", "x"])
    assert has.tolist() == [True, False, False, True, True]
    # a, b; _a, ab, b_; _ab, ab_ (middle letters)
    assert counts[0].sum() == 2 + 3 + 2 and not counts[1].any() and not counts[2].any()
    assert (counts[3] == 2 * counts[0]).all() and counts[4].sum() == 1 + 2 + 1
    one, _ = ngram_counts(["AB"])
    assert (one[0] == counts[0]).all() and counts.shape[1] == DIMENSIONS


def test_parts_of_a_long_text_do_not_show(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abΣσςİé 1.") for _ in range(n)) for n in (0, 1, 6, 7, 8, 14, 50, 300)]
    whole, has = ngram_counts(texts)
    monkeypatch.setattr("findara.llm.language_id.SLICE", 7)
    parts, also = ngram_counts(texts)
    assert (whole == parts).all() and (has == also).all() and has.tolist()[0] is False


def plain_prediction(text, model):
    """The nearest centroid, text by text and centroid by centroid."""
    counts = ngram_counts([text or ""])[0][0]
    vector = [(1 + np.log(c)) * model.idf[k] if c else 0.0 for k, c in enumerate(counts)]
    length = sum(v * v for v in vector) ** 0.5
    best = (-1.0, None)
    for centre, owner in zip(model.centroids, model.owner):
        cosine = sum(float(v) * float(c) for v, c in zip(vector, centre) if v) / length if length else 0.0
        best = max(best, (cosine, -int(owner)))
    letters = any(c.isalpha() for c in text or "")
    return (model.languages[-best[1]] if letters else UNKNOWN), (min(1.0, max(0.0, best[0])) if letters else 0.0)


def test_predictions_against_brute_force(spark, prose):
    model = train(prose)
    texts = [r["text"] for r in prose.limit(60).collect()] + [None, "", "12", "bala schrag", "ünïcödé"]
    names, score, _ = model.predict(texts)
    want = [plain_prediction(t, model) for t in texts]
    assert names == [w[0] for w in want] and np.allclose(score, [w[1] for w in want], atol=1e-5)


def test_the_sample_is_bounded_for_any_identifiers(spark, prose, monkeypatch):
    """Null identifiers, one identifier for all, and rows that repeat."""
    from findara.llm import language_id

    seen = []
    monkeypatch.setattr(language_id, "weighted", lambda counts, idf, f=language_id.weighted: seen.append(len(counts)) or f(counts, idf))
    for name, docs in {"null": prose.withColumn("doc_id", F.lit(None).cast("long")), "one": prose.withColumn("doc_id", F.lit(7).cast("long")), "repeated": prose.limit(40).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("x")}.items():
        seen.clear()
        model = train(docs, sample=30)
        assert all(0 < n <= 60 for n in seen), (name, seen)
        assert model.predict(["bala ruka tomi sefa"])[0] == ["aa"]


def test_kmeans_separates():
    x = unit_rows(np.array([[1, 0.1], [1, 0.2], [0.1, 1], [0.2, 1]], float))
    c = spherical_kmeans(x, 2)
    near = (x @ c.T).argmax(axis=1)
    assert near[0] == near[1] != near[2] == near[3] and np.allclose(np.linalg.norm(c, axis=1), 1)


def test_held_out_accuracy_and_rejection(spark, prose):
    learn = prose.filter(~held_out(F.col("doc_id")))
    model = train(learn)
    got = identify(prose.drop("lang"), model).join(prose.select("doc_id", F.col("lang").alias("true")), F.col("_row.doc_id") == F.col("doc_id")).filter(held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and sum(r["lang_pred"] == r["true"] for r in got) > 0.98 * len(got)
    assert sum(r["rejected"] for r in got) == 0 and all(0 <= r["score"] <= 1 for r in got)
    rng = random.Random(1)
    junk = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400)), "".join(rng.choice("xyzqj") for _ in range(900))]
    names, score, rejected = model.predict([*junk, None, "", "12 !?", "bala ruka tomi"])
    assert rejected.tolist()[:5] == [True] * 5 and names[2:] == [UNKNOWN] * 3 + ["aa"] and not rejected[5] and score[2] == 0


def test_learning_does_not_read_the_held_out(spark, prose):
    learn = ~held_out(F.col("doc_id"))
    changed = prose.withColumn("lang", F.when(learn, F.col("lang")).otherwise("zz"))
    a, b = train(prose.filter(learn)), train(changed.filter(learn))
    assert a.languages == b.languages and (a.centroids == b.centroids).all() and (a.idf == b.idf).all()


def test_awkward_rows(awkward, empty):
    model = train(awkward)
    got = identify(awkward.withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == awkward.count()
    by = {r["_row"]["doc_id"]: r for r in got}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == UNKNOWN and by[3]["score"] == 0 and by[3]["rejected"]
    assert identify(empty, model).count() == 0
    nothing = train(empty)
    assert [(r["lang_pred"], r["rejected"]) for r in identify(awkward.limit(1), nothing).collect()] == [(UNKNOWN, True)]


def test_a_few_low_texts_do_not_set_a_floor():
    from inspect import signature

    from findara.llm.language_id import class_quantiles

    best, kind = np.array([0.1] * 3 + [0.9] * 97 + [0.8] * 5), np.array([3] * 100 + [5] * 5)
    floors = class_quantiles(best, kind, signature(train).parameters["quantile"].default)
    assert np.allclose(floors, [0, 0, 0, 0.9, 0.9, 0.9, 0.9, 0.9])
