import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from findara.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def brute(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    best = {t: keep([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted(((r["doc_id"], best[r["text"] or ""], len(groups[r["text"] or ""]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("table", ["awkward", "prose", "empty"])
def test_groups(request, keep, table):
    df = request.getfixturevalue(table)
    got = exact_duplicates(df, keep=keep).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(df.collect(), {"min": min, "max": max}[keep])
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_group_over_many_tasks(spark):
    """Copies fill most tasks; texts share a beginning as well."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("x" * 100)).otherwise(F.concat(F.lit("x" * 100), F.col("id").cast("string"))).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_duplicates(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = [r for r in got if r["group_size"] > 1]
    assert len(got) == 4000 and len(hot) == 2666 and {r["keep_id"] for r in hot} == {1} and sum(r["kept"] for r in hot) == 1


def test_rows_kept_whole(awkward, empty):
    got = drop_exact_duplicates(awkward, keep="max")
    assert got.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["2", "4", "5", "7", "8", "None"])
    assert drop_exact_duplicates(empty).count() == 0


def test_normalised(prose):
    got = drop_exact_duplicates(prose.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))), normalise=F.lower)
    assert got.count() == prose.select("text").distinct().count()
