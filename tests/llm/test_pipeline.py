import pytest

import corpus_pipeline


def test_stages_in_turn(spark, prose):
    docs, names = prose, []
    rows = {r["doc_id"]: r["text"] for r in prose.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == prose.columns
        kept = {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            assert kept == set(rows)
        if name == "exact_dedup":
            assert len(kept) == len(set(rows.values())) and {rows[i] for i in kept} == set(rows.values())
        docs = out
        names.append(name)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert mixed.columns == prose.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, "").collect()
    copies = {}
    for r in packed:
        if r["start"] == 0:
            copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    want = {}
    for r in mixed.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + 1
    assert copies == want and max(copies.values()) == 2


def test_awkward_rows(spark, awkward):
    """What each stage keeps of nulls, empty and long texts, repeated rows and clashing names."""
    docs, kept = awkward, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        kept[name] = sorted(str(r["doc_id"]) for r in docs.collect())
        if name != "pack":
            assert docs.columns == awkward.columns
    assert set(kept["language_id"]) <= {"1", "2", "6", "7", "8", "None"} and kept["language_id"].count("2") == 2 and {"1", "6", "7"} <= set(kept["language_id"])
    left = set(kept["language_id"]) - {"2", "7"}  # copies of 1 and of 6
    assert kept["exact_dedup"] == kept["simhash_near_dedup"] == sorted(left)
    assert set(kept["mix_sources"]) <= left and set(kept["pack"]) == set(kept["mix_sources"])


def test_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
