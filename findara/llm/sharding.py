"""Resharding by minimum-cost flow.

Old shards hold rows of several size classes; new shards have capacities in rows.  A flow network of one node per
(old shard, size class), solved on the driver, says how many rows of each class every old shard sends to every new
one so that the capacities are met and the fewest bytes move.  Its size depends on the shard counts only.  Rows of
a class are ordered by size, the largest first, then by a hash; the flow cuts that order into intervals of which the
first stays, so what moves are a shard's smallest rows.  The keys at the cuts, found by a distributed ranking of
narrow rows, let a scan place each row by comparing its key; the rows of a key on both sides of a cut, which are
alike, are numbered first.  Texts are moved once, into the files of the shards that change.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, n_bytes, new_path, sorted_ranks


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> tuple[list[int], int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a maximum flow of least cost, and that cost.

    Primal-dual: shortest distances give potentials, then blocking flows fill all arcs of zero reduced cost.
    """
    head, left, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, cap, c in arcs:
        out[a].append(len(head))
        head.append(b), left.append(cap), cost.append(c)
        out[b].append(len(head))
        head.append(a), left.append(0), cost.append(-c)
    potential = [0] * n
    while True:
        far = [None] * n
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                if left[e] and (far[b := head[e]] is None or d + cost[e] + potential[a] - potential[b] < far[b]):
                    far[b] = d + cost[e] + potential[a] - potential[b]
                    heapq.heappush(queue, (far[b], b))
        if far[sink] is None:
            break
        most = max(d for d in far if d is not None)
        potential = [p + (most if d is None else d) for p, d in zip(potential, far)]
        tight = lambda a, e: left[e] and cost[e] + potential[a] == potential[head[e]]
        while True:
            level = {source: 0}
            layer = [source]
            while layer and sink not in level:
                layer = list(dict.fromkeys(head[e] for a in layer for e in out[a] if head[e] not in level and tight(a, e)))
                depth = max(level.values()) + 1
                level.update((b, depth) for b in layer)
            if sink not in level:
                break
            tried = [0] * n
            path: list[int] = []
            at = source
            while True:  # one augmenting path after another through the layers
                if at == sink:
                    amount = min(left[e] for e in path)
                    for e in path:
                        left[e] -= amount
                        left[e ^ 1] += amount
                    path, at = [], source
                    continue
                while tried[at] < len(out[at]):
                    e = out[at][tried[at]]
                    if tight(at, e) and level.get(head[e], -1) == level[at] + 1:
                        break
                    tried[at] += 1
                if tried[at] < len(out[at]):
                    path.append(out[at][tried[at]])
                    at = head[path[-1]]
                elif path:
                    at = head[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break
    flow = [left[2 * k + 1] for k in range(len(arcs))]
    return flow, sum(f * a[3] for f, a in zip(flow, arcs))


@dataclass
class Interval:
    """Rows ``lo`` to ``hi - 1`` of a block, in key order, go to ``shard``."""

    block: int
    lo: int
    hi: int
    shard: int


def plan_moves(blocks: Iterable[tuple[int, int, int, int]], capacities: list[int]) -> tuple[list[Interval], int]:
    """Intervals for blocks (number, old shard, rows, bytes), and the bytes that move, at each block's mean size."""
    blocks = list(blocks)
    shards = len(capacities)
    source, sink, hub = 0, 1, 2
    first_shard, first_block = 3, 3 + shards
    arcs = [(first_shard + t, sink, cap, 0) for t, cap in enumerate(capacities)]
    arcs += [(hub, first_shard + t, sum(capacities), 0) for t in range(shards)]
    for k, (_, old, rows, size) in enumerate(blocks):
        arcs.append((source, first_block + k, rows, 0))
        arcs.append((first_block + k, hub, rows, round(size / rows)))
        if 0 <= old < shards:
            arcs.append((first_block + k, first_shard + old, rows, 0))
    flow, cost = min_cost_flow(first_block + len(blocks), arcs, source, sink)
    stay = {a[0] - first_block: f for f, a in zip(flow, arcs) if a[0] >= first_block and a[1] != hub}
    move = {a[0] - first_block: f for f, a in zip(flow, arcs) if a[0] >= first_block and a[1] == hub}
    arriving = [[a[1] - first_shard, f] for f, a in zip(flow, arcs) if a[0] == hub and f]
    out = []
    for k, (block, old, rows, _) in enumerate(blocks):
        at = stay.get(k, 0)
        if at:
            out.append(Interval(block, 0, at, old))
        todo = move.get(k, 0)
        while todo:
            shard, room = arriving[-1]
            n = min(todo, room)
            out.append(Interval(block, at, at + n, shard))
            at, todo, arriving[-1][1] = at + n, todo - n, room - n
            if not arriving[-1][1]:
                arriving.pop()
    return out, cost


@dataclass
class Resharded:
    """``rows``: the columns of the input, ``old_shard``, ``shard`` and ``slot``; ``path``: the rewritten files, a
    folder per shard; ``changed``: the shards in it; ``moved_bytes``: as planned, at each block's mean size, so at
    most what the rows that move, a block's smallest, come to by that mean."""

    rows: DataFrame
    path: str
    changed: list[int]
    moved_bytes: int


def reshard(df: DataFrame, old_shard: F.Column, size: F.Column, n_shards: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Resharded:
    """Move rows from their old shards to ``n_shards`` new ones whose row counts differ by one at most.

    Null identifiers and texts are values like any other, and long texts are only hashed and moved.  A row without an
    old shard is in none and always moves; a null size counts as 0.  Rows that repeat with identifier and text are
    numbered, so they can go to different shards; which of them goes where does not show.  An empty table gives an
    empty result.  Where ``df`` has a column named like one of ours, ours gets underscores appended.  ``path`` is
    where the files of changed shards stay; without it they go when the application ends.
    """
    key = [F.xxhash64(F.lit(1), id_col, text_col).alias("h"), F.xxhash64(text_col, F.lit(2), id_col).alias("g")]
    old_name, shard_name, slot_name = (free_name(df, x) for x in ("old_shard", "shard", "slot"))
    bytes_of = F.coalesce(size.cast("long"), F.lit(0))
    keyed = df.select(F.struct(*df.columns).alias("_rs_row"), old_shard.cast("int").alias("_rs_old"), F.struct((-bytes_of).alias("s"), *key).alias("_rs_key"))
    in_class = F.floor(F.log2(F.greatest(-F.col("_rs_key.s"), F.lit(1)))).cast("int")
    keyed = keyed.withColumn("_rs_block", F.coalesce("_rs_old", F.lit(-1)) * 64 + in_class)
    ranked = sorted_ranks(keyed.select("_rs_block", "_rs_key"), ["_rs_block"], ["_rs_key"], "reshard-keys")
    found = ranked.groupBy("_rs_block").agg(F.count("*").alias("n"), F.sum(-F.col("_rs_key.s")).alias("b")).collect()  # shards x classes
    blocks = sorted((r["_rs_block"], r["_rs_block"] // 64, r["n"], r["b"]) for r in found)
    total = sum(b[2] for b in blocks)
    intervals, moved = plan_moves(blocks, [total // n_shards + (t < total % n_shards) for t in range(n_shards)])
    spark = df.sparkSession
    cuts = spark.createDataFrame([(i.block, i.lo + k) for i in intervals if i.lo for k in (-1, 0)], "block int, at long")
    around = F.broadcast(cuts).join(ranked, (F.col("block") == F.col("_rs_block")) & (F.col("at") == F.col("rank"))).select("block", "at", "_rs_key").collect()
    key_at = {(r["block"], r["at"]): tuple(r["_rs_key"]) for r in around}  # two for each interval
    split = {(i.block, k) for i in intervals if i.lo and (k := key_at[i.block, i.lo]) == key_at[i.block, i.lo - 1]}
    rules = []
    for i in intervals:
        first = key_at[i.block, i.lo] if i.lo else None
        rules.append((i.block, i.shard, first, key_at.get((i.block, i.hi)), first is None or (i.block, first) not in split))
    kind = "struct<s:bigint,h:bigint,g:bigint>"
    rules = spark.createDataFrame(rules, f"block int, _rs_shard int, first {kind}, next {kind}, with_first boolean")
    own = F.col("_rs_key")
    from_start = F.col("first").isNull() | (own > F.col("first")) | (F.col("with_first") & (own == F.col("first")))
    to_end = F.col("next").isNull() | (own < F.col("next"))
    placed = keyed.join(F.broadcast(rules), (F.col("_rs_block") == F.col("block")) & from_start & to_end).select("_rs_row", "_rs_old", "_rs_key", "_rs_shard")
    if split:
        placed = placed.unionByName(_numbered(keyed, ranked, split, intervals))
    placed = placed.select("_rs_row.*", F.col("_rs_old").alias(old_name), F.col("_rs_shard").alias(shard_name), F.col("_rs_key.h").alias("_rs_h"), F.col("_rs_key.g").alias("_rs_g"))

    touched = {i.shard for i in intervals if i.block // 64 != i.shard} | {i.block // 64 for i in intervals if i.block // 64 != i.shard}
    changed = sorted(touched & set(range(n_shards)))
    path = path or new_path(spark, "shards")
    order = ["_rs_h", "_rs_g"]
    rows = sorted_ranks(placed.filter(F.col(shard_name).isin(changed)), [shard_name], order, "shards", path, [shard_name])
    same = sorted({i.shard for i in intervals} - set(changed))
    if same:  # these files stay as they are; only their rows' places are worked out
        rows = rows.unionByName(sorted_ranks(placed.filter(F.col(shard_name).isin(same)), [shard_name], order, "same-shards"))
    return Resharded(rows.drop(*order).withColumnRenamed(free_name(placed, "rank"), slot_name), path, changed, moved)


def _numbered(keyed: DataFrame, ranked: DataFrame, split: set[tuple], intervals: list[Interval]) -> DataFrame:
    """The rows of keys that lie on both sides of a cut, each by its number among its like; one key spreads over many tasks."""
    spark = keyed.sparkSession
    kind = "struct<s:bigint,h:bigint,g:bigint>"
    keys = F.broadcast(spark.createDataFrame(sorted(split), f"block int, key {kind}"))  # at most one for each cut
    here = (F.col("_rs_block") == F.col("block")) & (F.col("_rs_key") == F.col("key"))
    first = ranked.join(keys, here).groupBy("block", "key").agg(F.min("rank").alias("first"))
    rows = sorted_ranks(keyed.join(keys, here, "left_semi"), ["_rs_block", "_rs_key"], [], "reshard-alike")
    rows = rows.join(F.broadcast(first), here).withColumn("_at", F.col("rank") + F.col("first")).drop("block", "rank")
    spans = spark.createDataFrame([(i.block, i.lo, i.hi, i.shard) for i in intervals], "block int, lo long, hi long, _rs_shard int")
    inside = (F.col("_rs_block") == F.col("block")) & (F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi"))
    return rows.join(F.broadcast(spans), inside).select("_rs_row", "_rs_old", "_rs_key", "_rs_shard")


#: Shards before and after, as the query has them.
OLD, NEW = 32, 40


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by a hash of doc_id to 40 of equal row counts, moving the fewest bytes."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD))
    moved = reshard(docs, old, n_bytes(F.col("text")) + 16, NEW)
    return moved.rows.select(
        "doc_id",
        (n_bytes(F.col("text")) + 16).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
