import itertools
import random
import zlib

from pyspark.sql import functions as F

from findara.llm.common import n_bytes
from findara.llm.sharding import min_cost_flow, plan_moves, reshard


def test_flow_against_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        supply, room = [rng.randrange(1, 4) for _ in range(2)], [rng.randrange(1, 5) for _ in range(3)]
        cost = [[rng.randrange(0, 6) for _ in room] for _ in supply]
        arcs = [(0, 2 + i, s, 0) for i, s in enumerate(supply)] + [(2 + i, 4 + j, 9, cost[i][j]) for i in range(2) for j in range(3)] + [(4 + j, 1, r, 0) for j, r in enumerate(room)]
        flow, total = min_cost_flow(7, arcs, 0, 1)
        best = None
        for x in itertools.product(*[range(s + 1) for s in supply for _ in room]):
            rows = [x[:3], x[3:]]
            if all(sum(r) <= s for r, s in zip(rows, supply)) and all(sum(c) <= m for c, m in zip(zip(*rows), room)):
                key = (-sum(x), sum(a * b for r, c in zip(rows, cost) for a, b in zip(r, c)))
                best = min(best or key, key)
        assert (-sum(flow[:2]), total) == best


def test_plan_moves_smallest_first():
    intervals, moved = plan_moves([(0, 0, 5, 50), (1, 0, 5, 500)], [5, 5])
    assert moved == 50 and {(i.block, i.shard, i.hi - i.lo) for i in intervals} == {(0, 1, 5), (1, 0, 5)}


def resharded(df, n=4):
    return reshard(df, F.pmod(F.xxhash64("doc_id"), F.lit(3)), n_bytes(F.col("text")) + 16, n)


def test_awkward_rows(awkward, empty):
    named = awkward.withColumnsRenamed({"rank": "shard", "lang": "slot"})
    got = resharded(named)
    assert got.rows.columns == [*named.columns, "old_shard", "shard_", "slot_"]
    rows = got.rows.collect()
    assert len(rows) == awkward.count()
    counts = {}
    for r in rows:
        counts.setdefault(r["shard_"], []).append(r["slot_"])
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1  # one row comes twice
    assert resharded(empty).rows.count() == 0


def test_counts_and_files(spark, prose):
    got = resharded(prose, 7)
    rows = got.rows.collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == prose.count()
    files = spark.read.parquet(got.path)
    assert files.filter(F.col("shard") == 5).count() == sizes[5]
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in resharded(prose.repartition(5), 7).rows.collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    assert {zlib.crc32(r["text"].encode()) for r in rows} == {zlib.crc32(r["text"].encode()) for r in prose.collect()}


def moved_and_least(rows, n):
    """Bytes of rows that left their shard, and the fewest that could: each shard keeps the largest its capacity lets it."""
    moved, least = sum(r["size"] for r in rows if r["old_shard"] != r["shard"]), 0
    for old in {r["old_shard"] for r in rows}:
        sizes = sorted((r["size"] for r in rows if r["old_shard"] == old), reverse=True)
        room = len(rows) // n + (old < len(rows) % n) if old is not None and 0 <= old < n else 0
        least += sum(sizes[room:])
    return moved, least


def test_repeated_rows_part_and_the_fewest_bytes_move(spark):
    """50 copies of one row, rows without an old shard, an old shard that is no more, and one that is new."""
    rng = random.Random(8)
    rows = [(1, "the same text", 2, 29)] * 50 + [(k, f"text {k}", rng.choice([0, 0, 0, 1, 3, 9, None]), rng.randrange(1, 3000)) for k in range(2, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, old int, size long")
    for n in (8, 3):
        got = reshard(df, F.col("old"), F.col("size"), n)
        found = got.rows.collect()
        counts = {}
        for r in found:
            counts.setdefault(r["shard"], []).append(r["slot"])
        assert len(counts) == n and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in counts.values())
        assert sorted((r["doc_id"], r["old"] is None, r["size"]) for r in found) == sorted((r[0], r[2] is None, r[3]) for r in rows)
        moved, least = moved_and_least(found, n)
        assert moved == least


def test_unchanged_shards_stay(prose):
    even = prose.limit(40)
    got = reshard(even, F.pmod("doc_id", F.lit(1)).cast("int"), n_bytes(F.col("text")), 1)
    assert got.changed == [] and got.moved_bytes == 0 and sorted(r["slot"] for r in got.rows.collect()) == list(range(40))
