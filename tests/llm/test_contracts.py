"""The queries themselves on small tables: columns, types, and values by a plain way."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from findara.llm import registry
from findara.llm.simhash import Plan, fingerprint

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "source"])
    return {r["doc_id"]: (r["text"] or "", r["source"]) for r in t.to_pylist()}


def rows(spark, name, columns):
    df = QUERIES[name](spark, DATA)
    kinds = dict(df.dtypes)
    for c, kind in columns.items():
        assert kinds[c] == kind, c
    return df.collect()


def test_op2(spark, texts):
    got = rows(spark, "op2_reshard", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    shards = {}
    for r in got:
        data = texts[r["doc_id"]][0].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "rows" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(texts) and sorted(shards) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op3(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op3_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})}
    ids = sorted(texts)
    fps = {i: fingerprint(texts[i][0], Plan())[0] for i in ids}
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", root[i]) for i in ids}


def test_op5(spark, texts):
    kinds = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    got = rows(spark, "op5_media", kinds)
    assert len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]][0].encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


def test_op8(spark, texts):
    got = rows(spark, "op8_mix", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    taken, target = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6
        s = texts[r["doc_id"]][1]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
    total = sum(r["size"] for r in got)
    assert len(got) == len(texts) and sum(target.values()) == pytest.approx(min(1.5, 2.0) * total) and all(abs(taken[s] - t) <= 0.05 * t + 50 for s, t in target.items())


def test_op10(spark, texts):
    got = rows(spark, "op10_language", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]][0]))
    assert np.mean([r["held_out"] for r in got]) > 0.2
