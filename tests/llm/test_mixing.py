import random

import pytest
from pyspark.sql import functions as F

from findara.llm.mixing import flight, landing, mix, words


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(1, 80)
        p, size = [rng.random() for _ in range(n)], [rng.randrange(0, 300) for _ in range(n)]
        out = flight(p, size, rng)
        assert sum(1e-9 < x < 1 - 1e-9 for x in out) <= 2 and all(0 <= x <= 1 for x in out)
        assert sum(out) == pytest.approx(sum(p), abs=1e-5) and sum(a * b for a, b in zip(out, size)) == pytest.approx(sum(a * b for a, b in zip(p, size)), abs=1e-3)


def test_flight_is_fair():
    """Each chance is the share of draws that take it."""
    p, size = [0.3, 0.3, 0.3, 0.7, 0.7], [5, 1, 9, 4, 4]
    total = [0.0] * 5
    for seed in range(4000):
        for k, x in enumerate(flight(p, size, random.Random(seed))):
            total[k] += x / 4000
    assert total == pytest.approx(p, abs=0.04)


def test_landing_comes_near():
    assert landing([0.5, 0.5], [0.5, 0.5], [10, 30]) in ([0.0, 1.0], [1.0, 0.0])
    rng = random.Random(2)
    p, size = [0.4] * 500, [rng.randrange(1, 1000) for _ in range(500)]
    out = landing(p, flight(p, size, rng), size)
    assert set(out) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(out, size)) - 0.4 * sum(size)) < 20


def brute_targets(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        whole, rest = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / whole
            if target[s] >= cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
        left = rest
    return target


@pytest.mark.parametrize("table,chunk", [("awkward", 512), ("prose", 512), ("prose", 8), ("empty", 512)])
def test_mix(request, table, chunk):
    df = request.getfixturevalue(table)
    got = mix(df, words(F.col("text")), chunk=chunk).collect()
    assert len(got) == df.count()
    sizes, taken = {}, {}
    for r in got:
        s = r["_row"]["source"]
        assert r["size"] == len((r["_row"]["text"] or "").split()) if table == "prose" else True
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
    want = brute_targets(sizes, [3, 1, 2], 1.5, 2.0)
    for r in got:
        s = r["_row"]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["copies"] <= 2
    if table == "prose":
        assert all(abs(taken[s] - want[s]) < 0.02 * want[s] for s in sizes)
    again = mix(df.repartition(3), words(F.col("text")), chunk=chunk).collect()
    key = lambda rows: sorted(str((r["_row"]["doc_id"], r["_row"]["source"], r["size"], r["copies"])) for r in rows)
    assert key(again) == key(got)


def test_words(spark):
    df = spark.createDataFrame([("a b",), (" \t",), (None,), ("a\x0bb\x1cc d",)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [2, 0, 0, 2]


def test_repeated_rows_fly_in_parts(spark, monkeypatch):
    """Rows that are all alike share a chunk; parts of it fly one after the other, wherever batches end."""
    monkeypatch.setattr("findara.llm.mixing.TOGETHER", 100)
    df = spark.createDataFrame([(None, "s" if k % 3 else "t", 5) for k in range(1000)] + [(k, "u", k % 9) for k in range(300)], "doc_id long, source string, n long")
    got = mix(df, F.col("n"), chunk=32).collect()
    want = {r["_row"]["source"]: r["target"] for r in got}
    for s, t in want.items():
        assert abs(sum(r["size"] * r["copies"] for r in got if r["_row"]["source"] == s) - t) <= 5
    again = mix(df.repartition(7), F.col("n"), chunk=32).collect()
    key = lambda rows: sorted(str((r["_row"]["doc_id"], r["_row"]["source"], r["copies"])) for r in rows)
    assert key(again) == key(got)
