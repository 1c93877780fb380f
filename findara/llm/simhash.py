"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that of two fingerprints within the distance one segment
differs by at most one bit (segments > distance / 2).  Every segment is indexed once for each of its bits, with
that bit wiped out: two segments within one bit share the variant that wipes the bit in which they differ, and an
equality join on variants finds the pair.  Within a variant's bucket the whole fingerprints are compared.

Equal fingerprints are one node, so copies cost nothing.  A bucket gives at most one link for each of its rows
(a spanning forest, from which connected components come out the same), never all pairs; a bucket too large for
one task is dealt out in tiles.  Components come from alternating large-star and small-star steps.

Where links only propose, they are verified where they are found, and the forest is made of verified links.  A
bucket then gives its members, those rows that have a partner in it, each with its set of shingles; a task compares
the sets of a bucket's members that are within the distance and not joined yet, and gives the links that join them.
So no pair is ever a row, and none within the distance goes unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_small_batches, lean, spread_join, written

#: Bytes of a text that are taken apart at a time.
CHUNK = 1 << 20
#: Rows of a bucket that one task compares; more are dealt out in tiles of this many.
TILE = 8192
#: Rows up to which buckets are compared side by side; members whose sets a task compares, and bytes of those sets.
SMALL, BLOCK, HELD = 48, 1024, 32 << 20
#: Edges that one task joins at a time.
EDGES = 1 << 20
#: Odd multipliers from the golden ratio, for further hash words of a shingle.
_GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Plan:
    """``segments`` for each of ``lanes`` 64-bit fingerprints; links need ``distance`` over all lanes' bits.

    Every link is found if there are more than distance / 2 segments in all (:attr:`complete`).  More lanes hash the
    same shingles anew: a sharper estimate, and more chances to meet at a distance beyond that.
    """

    words: int = 4
    distance: int = 4
    segments: int = 3
    lanes: int = 1

    @property
    def complete(self) -> bool:
        return self.distance // (self.segments * self.lanes) <= 1

    def parts(self) -> list[tuple[int, int, int]]:
        """(lane, first bit, end) of every segment."""
        cuts = [round(64 * k / self.segments) for k in range(self.segments + 1)]
        return [(lane, a, b) for lane in range(self.lanes) for a, b in zip(cuts, cuts[1:])]

    def variants(self) -> list[tuple[int, int, int]]:
        """(segment, lane, mask) of every variant: a segment's bits but one.  Number 64 x lane + bit wipes that bit."""
        return [(k, lane, (1 << b) - (1 << a) & ~(1 << bit)) for k, (lane, a, b) in enumerate(self.parts()) for bit in range(a, b)]

    def linked(self, left: np.ndarray, right: np.ndarray, variant: np.ndarray | int) -> np.ndarray:
        """Whether fingerprints (rows x lanes) that share the variant's bucket are within the distance and share no
        earlier one, so that a pair comes out of one bucket only."""
        differ = left ^ right
        out = np.bitwise_count(differ).sum(axis=-1) <= self.distance
        at = np.flatnonzero(out)
        if len(at):
            differ = np.broadcast_to(differ, (len(out), self.lanes))[at]
            v = np.broadcast_to(variant, len(out))[at]
            own = np.searchsorted([64 * lane + b for lane, a, b in self.parts()], v, side="right")
            first = np.ones(len(at), bool)
            for k, (lane, a, b) in enumerate(self.parts()):
                bits = differ[:, lane] >> np.uint64(a) & np.uint64((1 << b - a) - 1)
                first &= (own <= k) | (np.bitwise_count(bits) > 1)
                first &= (own != k) | (bits == np.uint64(1) << ((v - 64 * lane - a) % 64).astype(np.uint64)) | ((bits == 0) & (v == 64 * lane + a))
            out[at] = first
        return out


def _spaced(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a chunk at a time."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def _hashed(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a text's shingles, repeats included, a chunk at a time."""
    n = 0
    carried: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for part in _spaced((text or "").encode("utf-8", "surrogatepass").lower()):
        part = carried + part
        carried = part[max(0, len(part) - words + 1) :]
        if len(part) < words:
            continue
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(part) - words + 1]
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())], np.uint64)
        n += len(hashes)
        yield hashes
    if not n and carried:
        yield np.array([digest(b" ".join(carried), 42)], np.uint64)


def _simhash(hashes: Iterable[np.ndarray], plan: Plan) -> list[int]:
    ones = np.zeros((plan.lanes, 64), np.int64)
    n = 0
    for h in hashes:
        n += len(h)
        _count(ones, h)
    bits = (2 * ones > n).astype(np.uint8)
    return [int(x) for x in np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]]


def fingerprint(text: str | None, plan: Plan) -> list[int]:
    """One unsigned 64-bit SimHash a lane, zero for a text without words."""
    return _simhash(_hashed(text, plan.words), plan)


def set_fingerprint(text: str | None, plan: Plan) -> tuple[int, int, list[int]]:
    """A digest of the set of different shingles, how many there are, and their fingerprint, each counted once."""
    parts = list(_hashed(text, plan.words))
    found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 7), len(found), _simhash((found[a : a + CHUNK] for a in range(0, len(found), CHUNK)), plan)


def _count(ones: np.ndarray, hashes: np.ndarray) -> None:
    for lane in range(len(ones)):
        h = hashes
        if lane:
            h = (h ^ (h >> np.uint64(31 - lane))) * np.uint64(_GOLDEN * (2 * lane + 1) % 2**64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_GOLDEN)
            h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones[lane] += bits[a : a + 255].sum(axis=0, dtype=np.uint8)


def fingerprints(df: DataFrame, plan: Plan, text_col: str = "text", carry: list[str] | None = None, sets: bool = False) -> DataFrame:
    """``carry`` columns and ``fp0, fp1 ...`` (long, the unsigned value's bits), a lane each.

    ``sets``: also ``_node, _n`` of :func:`set_fingerprint`.
    """
    names = [*(["_node", "_n"] if sets else []), *(f"_fp{k}" for k in range(plan.lanes))]

    def of(text: str | None) -> list[int]:
        if not sets:
            return fingerprint(text, plan)
        node, n, fps = set_fingerprint(text, plan)
        return [node, n, *fps]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of(t.as_py()) for t in b["_text"]]
            found = np.array(rows, np.uint64).reshape(len(rows), len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["_row"], *(pa.array(found[:, k]) for k in range(len(names)))], ["_row", *names])

    rows = in_small_batches(df).select(F.struct(*(carry or df.columns)).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema["_row"], *(T.StructField(n, T.LongType()) for n in names)])
    return rows.mapInArrow(lean(scan), schema)


def _forest(fps: np.ndarray, plan: Plan, variant: int, side: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links that join what is connected, at most one a row; ``fps``: rows x lanes.

    ``side`` (booleans) keeps the two sides of a tile apart: only links between the sides count.  Each row found is
    compared with the rows not yet reached; those shrink as a dense group is found.  Rows near the middle of all
    come first, so that a group's links lead to what its members have in common.
    """
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)
    middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(fps)).view(np.uint64)
    todo = np.argsort(np.bitwise_count(fps ^ middle).sum(axis=1), kind="stable")
    left, right = [], []
    while len(todo) > 1:
        front = [int(todo[0])]
        todo = todo[1:]
        for at in front:
            if not len(todo):
                break
            near = plan.linked(fps[todo], fps[at], variant)
            if side is not None:
                near &= side[todo] != side[at]
            if near.any():
                found = todo[near].tolist()
                left += [at] * len(found)
                right += found
                front += found
                todo = todo[~near]
    return left, right


def _numbers(b: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    return [b[c].to_numpy() for c in columns]


def _whole_buckets(batches: Iterator[pa.RecordBatch], columns: list[str], tile: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Rows (_v, _key, ``columns``), sorted by variant and key, as (whether overfull, columns).

    Whole buckets, many at a time, or parts of a bucket that has more than ``tile`` rows.
    """
    rest: list[np.ndarray] | None = None
    overfull = None  # the bucket that is being passed on
    for b in batches:
        if not b.num_rows:
            continue
        rows = _numbers(b, ["_v", "_key", *columns])
        if overfull is not None:
            more = (rows[0] == overfull[0]) & (rows[1] == overfull[1])
            if more.any():
                yield True, [c[more] for c in rows]
                rows = [c[~more] for c in rows]
            if not len(rows[0]):
                continue
            overfull = None
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])  # this bucket may go on
        rest = [c[last] for c in rows]
        if not last.all():
            yield False, [c[~last] for c in rows]
        if len(rest[0]) > tile:
            yield True, rest
            overfull, rest = (rest[0][0], rest[1][0]), None
    if rest is not None:
        yield False, rest


def _bounds(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]])


def _side_by_side(plan: Plan, v: np.ndarray, bounds: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """All links within buckets of at most ``SMALL`` rows, as (rows, step to their partners)."""
    size = np.diff(bounds)
    of, at = np.repeat(size, size), np.arange(len(v)) - np.repeat(bounds[:-1], size)
    rows = np.flatnonzero((of > 1) & (of <= SMALL))
    for step in range(1, SMALL):
        rows = rows[at[rows] + step < of[rows]]
        if not len(rows):
            break
        yield rows[plan.linked(fp[rows], fp[rows + step], v[rows])], step


def _links(plan: Plan, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (_v, _key, _node, lanes), sorted by variant and key, to links (_a, _b) and rows of overfull buckets."""
    lanes = [f"_fp{k}" for k in range(plan.lanes)]
    names = ["_a", "_b", "_v", "_key", "_node", *lanes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for overfull, (v, key, node, *words) in _whole_buckets(batches, ["_node", *lanes], tile):
            if overfull:
                none = pa.nulls(len(v), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, (v, key, node, *words))], names)
                continue
            fp, bounds = np.stack(words, axis=1).view(np.uint64), _bounds(v, key)
            lefts, rights = [], []
            for rows, step in _side_by_side(plan, v, bounds, fp):
                lefts.append(node[rows])
                rights.append(node[rows + step])
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s > SMALL:
                    found = _forest(fp[s:e], plan, int(v[s]))
                    lefts.append(node[s + np.array(found[0], int)])
                    rights.append(node[s + np.array(found[1], int)])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
            if len(a):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), none, none, *[none] * plan.lanes], names)

    return scan


def _sharing(plan: Plan, v: int, fp: np.ndarray, root: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Which rows of a bucket have a partner within the distance, of another root and on the other side if those are given."""
    out = np.zeros(len(fp), bool)
    for at in range(len(fp) - 1):
        near = plan.linked(fp[at + 1 :], fp[at], v)
        if side is not None:
            near &= side[at + 1 :] != side[at]
        if root is not None:
            near &= root[at + 1 :] != root[at]
        if near.any():
            out[at] = True
            out[at + 1 :] |= near
    return out


#: What a member is, besides its lanes: bucket, pair of blocks and its own of them, node, shingles, known root.
MEMBER = {"_v": "int", "_key": "long", "_i": "int", "_j": "int", "_mine": "int", "_node": "long", "_n": "long", "_root": "long"}


def _members(plan: Plan, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (_v, _key, _node, _n, lanes), sorted by variant and key, to members and, with null blocks, rows of overfull buckets.

    A bucket with many members, or large sets, is dealt out in blocks; every pair of blocks is one group.
    """
    lanes = [f"_fp{k}" for k in range(plan.lanes)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for overfull, (v, key, node, n, *words) in _whole_buckets(batches, ["_node", "_n", *lanes], tile):
            if overfull:
                none = pa.nulls(len(v), pa.int32())
                yield pa.RecordBatch.from_arrays([*map(pa.array, (v, key)), none, none, none, *map(pa.array, (node, n, node, *words))], [*MEMBER, *lanes])
                continue
            fp, bounds = np.stack(words, axis=1).view(np.uint64), _bounds(v, key)
            member = np.zeros(len(v), bool)
            for rows, step in _side_by_side(plan, v, bounds, fp):
                member[rows] = member[rows + step] = True
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s > SMALL:
                    member[s:e] = _sharing(plan, int(v[s]), fp[s:e])
            at = np.flatnonzero(member)
            if not len(at):
                continue
            mine, other = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
            runs = _bounds(v[at], key[at])
            extra = []
            for s, e in zip(runs[:-1], runs[1:]):
                blocks = max(-(-int(e - s) // BLOCK), -(-4 * int(n[at[s:e]].sum()) // HELD))
                if blocks > 1:
                    mine[s:e] = node[at[s:e]].view(np.uint64) * np.uint64(_GOLDEN) % np.uint64(blocks)
                    extra += [(np.arange(s, e), k) for k in range(1, blocks)]
            rows = np.concatenate([np.arange(len(at)), *(r for r, _ in extra)])
            other = np.concatenate([other, *(np.full(len(r), k, np.int32) for r, k in extra)])
            at, mine = at[rows], mine[rows]
            columns = [v[at], key[at], np.minimum(mine, other), np.maximum(mine, other), mine, node[at], n[at], node[at], *(w[at] for w in words)]
            for k in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in columns], [*MEMBER, *lanes])

    return scan


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, from rows sorted by their keys."""
    waiting: list[pa.RecordBatch] = []  # of a group that may go on
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        bounds = _bounds(*_numbers(b, keys))
        first = tuple(b[k][0].as_py() for k in keys)
        if waiting and first != last:
            yield pa.Table.from_batches(waiting)
            waiting = []
        for s, e in zip(bounds[:-2], bounds[1:-1]):
            yield pa.Table.from_batches([*waiting, b.slice(s, e - s)])
            waiting = []
        waiting.append(b.slice(bounds[-2]))
        last = tuple(b[k][b.num_rows - 1].as_py() for k in keys)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _grouped(rows: DataFrame, keys: list[str], of_group: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n = [], 0
        for group in _groups(batches, keys):
            found = of_group(group)
            if found is not None and found.num_rows:
                made.append(found)
                n += found.num_rows
            if n > 1 << 16:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made, n = [], 0
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "_node").mapInArrow(lean(scan), schema)


def _tiled(big: DataFrame, plan: Plan, tile: int, contested: bool = False) -> DataFrame:
    """Overfull buckets: rows are dealt to blocks by hash, and every pair of blocks is one group.

    Gives links that join what is connected; or, if ``contested``, the members with a partner of another ``_root``.
    """
    lanes = [f"_fp{k}" for k in range(plan.lanes)]
    more = ["_n", "_root"] if contested else []
    sizes = big.groupBy("_v", "_key").agg(F.count("*").alias("_rows"), *([F.sum("_n").alias("_sets")] if contested else []))
    blocks = F.ceil(F.col("_rows") / tile)
    blocks = F.greatest(blocks, F.ceil(F.col("_sets") * 4 / HELD)) if contested else blocks
    rows = big.join(sizes, ["_v", "_key"]).withColumn("_blocks", blocks.cast("int"))
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("_v", "_key", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_mine", "_node", *more, *lanes)

    def of_group(t: pa.Table) -> pa.RecordBatch | None:
        fp = np.stack([t[c].to_numpy() for c in lanes], axis=1).view(np.uint64)
        v, i, j = (t[c][0].as_py() for c in ("_v", "_i", "_j"))
        side = None if i == j else t["_mine"].to_numpy() == i
        if contested:
            found = t.filter(pa.array(_sharing(plan, v, fp, t["_root"].to_numpy(), side)))
            return found.select([*MEMBER, *lanes]).combine_chunks().to_batches()[0] if len(found) else None
        node = t["_node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[np.array(x, int)]) for x in _forest(fp, plan, v, side)], ["_a", "_b"])

    schema = _member_schema(plan) if contested else "_a long, _b long"
    return _grouped(rows, ["_v", "_key", "_i", "_j"], of_group, schema)


def _member_schema(plan: Plan) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in (MEMBER | {f"_fp{k}": "long" for k in range(plan.lanes)}).items())


def _indexed(fps: DataFrame, plan: Plan, more: list[str]) -> DataFrame:
    """A row for each variant of each node, dealt and sorted by variant and key."""
    lanes = [f"_fp{k}" for k in range(plan.lanes)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.array(*[F.lit(signed(m)).cast("long") for _, _, m in plan.variants()])
    # Each row becomes as many as there are variants: spread them first, however few files or partitions they fill.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_node")
    index = spread.select(F.posexplode(masks).alias("_v", "_mask"), "_node", *more, *lanes)
    lane = F.col("_fp0")
    for k in range(1, plan.lanes):
        lane = F.when(F.col("_v") >= 64 * k, F.col(f"_fp{k}")).otherwise(lane)
    index = index.select("_v", lane.bitwiseAND(F.col("_mask")).alias("_key"), "_node", *more, *lanes)
    return index.repartition("_v", "_key").sortWithinPartitions("_v", "_key", "_node")


def links(fps: DataFrame, plan: Plan, tile: int = TILE) -> DataFrame:
    """``_a, _b`` (fingerprints of lane 0) whose components are those of all pairs the plan links.

    ``fps``: distinct rows ``_fp0, _fp1 ...``.
    """
    lanes = [f"_fp{k}" for k in range(plan.lanes)]
    schema = "_a long, _b long, _v int, _key long, _node long, " + ", ".join(f"{c} long" for c in lanes)
    found = written(_indexed(fps.withColumn("_node", F.col("_fp0")), plan, []).mapInArrow(lean(_links(plan, tile)), schema), "simhash-links")
    pairs, big = found.filter("_b is not null").select("_a", "_b"), found.filter("_b is null").select("_v", "_key", "_node", *lanes)
    if big.head(1):
        pairs = pairs.unionByName(_tiled(big, plan, tile))
    return pairs  # a pair comes out of one bucket, and of one pair of blocks, only


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; two empty ones have."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b):
        return False
    if not len(a):
        return True
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return common >= similarity * (len(a) + len(b) - common)


def _verified(plan: Plan, similarity: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Of a group's members with their sets, the links that join what verified links connect, at most one a member."""
    lanes = [f"_fp{k}" for k in range(plan.lanes)]

    def of_group(t: pa.Table) -> pa.RecordBatch | None:
        node, n = t["_node"].to_numpy(), len(t)
        v, i, j = (t[c][0].as_py() for c in ("_v", "_i", "_j"))
        side = None if i == j or v < 0 else t["_mine"].to_numpy() == i
        fp = np.stack([t[c].to_numpy() for c in lanes], axis=1).view(np.uint64)
        lists = t["_set"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy().view(np.uint32)
        part = np.unique(t["_root"].to_numpy(), return_inverse=True)[1].copy()  # rows of one number are joined
        left, right = [], []
        for at in range(n - 1):
            near = part[at + 1 :] != part[at]
            if side is not None:
                near &= side[at + 1 :] != side[at]
            if v >= 0 and near.any():  # else every row is to be compared
                near &= plan.linked(fp[at + 1 :], fp[at], v)
            mine = flat[ends[at] : ends[at + 1]]
            for k in (np.flatnonzero(near) + at + 1).tolist():
                if part[k] != part[at] and alike(mine, flat[ends[k] : ends[k + 1]], similarity):
                    left.append(node[at])
                    right.append(node[k])
                    part[part == part[k]] = part[at]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right)], ["_a", "_b"]) if left else None

    return of_group


def verified_components(nodes: DataFrame, plan: Plan, similarity: float, sets: Callable[[DataFrame], DataFrame], tile: int = TILE) -> DataFrame:
    """:func:`components` of all pairs that the plan links and whose sets are similar.

    ``nodes``: ``_node, _n`` (the size of its set), lanes.  ``sets`` gives ``_node, _set`` (sorted) of those asked for.
    Overfull buckets first give the links of a spanning forest, which join most of a group of copies, and then the
    members with a partner that verified links have not joined to them.
    """
    lanes = [f"_fp{k}" for k in range(plan.lanes)]
    found = written(_indexed(nodes, plan, ["_n"]).mapInArrow(lean(_members(plan, tile)), _member_schema(plan)), "members")
    members, big = found.filter("_i is not null"), found.filter("_i is null").select("_v", "_key", "_node", "_n", *lanes)

    def verify(rows: DataFrame) -> DataFrame:
        own = sets(rows.select("_node").distinct())
        keys = ["_v", "_key", "_i", "_j"]
        return _grouped(rows.join(own, "_node"), keys, _verified(plan, similarity), "_a long, _b long")

    if not big.head(1):
        return components(verify(members))
    pairs = written(_tiled(big, plan, tile), "tiles")
    ends = pairs.select(F.col("_a").alias("_key"), F.pmod(F.xxhash64("_b"), F.lit(1 << 30)).cast("int").alias("_i"), F.explode(F.array("_a", "_b")).alias("_node"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("_n", *lanes)]
    ends = ends.select(F.lit(-1).alias("_v"), "_key", "_i", F.col("_i").alias("_j"), F.lit(0).alias("_mine"), "_node", zero[0], F.col("_node").alias("_root"), *zero[1:])
    kept = written(verify(ends), "verified")
    rooted = big.join(components(kept), F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_node")).drop("node", "root")
    rest = written(_tiled(rooted, plan, min(tile, BLOCK), contested=True), "contested")
    return components(kept.unionByName(verify(members.unionByName(rest))))


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges that are not the smallest of their component, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(deeper := root[root], root):
            root = deeper
    low = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[low], nodes[root[low]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges with the same components: each task's, ``EDGES`` at a time, become stars."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2

        def star() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in forest_of(*held)], ["_a", "_b"])

        for batch in batches:
            held = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("_a", "_b"))]
            if len(held[0]) >= EDGES:
                done = star()
                held = [c.to_numpy() for c in done.columns]
                if len(held[0]) >= EDGES // 2:  # the task has too many nodes for this: what is found is passed on
                    yield done
                    held = [np.zeros(0, np.int64)] * 2
        yield star()

    return edges.select("_a", "_b").coalesce(tasks).mapInArrow(lean(scan), "_a long, _b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges (_a, _b long): root is the smallest node of its component.

    Blocks of about ``EDGES`` edges become stars, each in a task; if there is more than one block, large-star and
    small-star turns join them until every node but the roots has one edge, to a root.  Each turn's edges are a
    written table.
    """

    def turn(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        else:
            both = e.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b"))
        least = both.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("_n"), F.least("_a", "_m").alias("_m"))
        joined = both.join(least, F.col("_a") == F.col("_n"))
        if large:
            out = joined.filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        else:
            out = joined.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).unionByName(least.select(F.col("_n").alias("_a"), F.col("_m").alias("_b")))
        return out.filter("_a <> _b").distinct()

    given = written(edges.filter("_a <> _b"), "edges")
    tasks = -(-given.count() // EDGES)
    now = written(_contracted(given, max(1, tasks)), "stars")
    while tasks > 1 and not _all_stars(now):
        now = written(turn(turn(now, True), False), "stars")
    stars = now.select(F.col("_a").alias("node"), F.col("_b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or edges to larger ones only."""
    ends = edges.select(F.col("_a").alias("_n"), F.lit(1).alias("_up")).unionByName(edges.select("_b").distinct().select(F.col("_b").alias("_n"), F.lit(1).alias("_up")))
    return not ends.groupBy("_n").agg(F.sum("_up").alias("_up")).filter("_up > 1").head(1) and not edges.filter("_a < _b").head(1)


def near_duplicates(df: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``<id_col>, fingerprint, component_id``: the component's smallest identifier, for every row.

    A null text counts as empty; empty texts have fingerprint zero and link like others.  Rows that repeat stay,
    in one component.  Null identifiers are never a component's identifier unless it has no other.  Texts are
    read whole, in chunks.  An empty table gives an empty result.
    """
    rows = written(fingerprints(df, plan, text_col, [id_col]).select(F.col(f"_row.{id_col}").alias("_id"), *[f"_fp{k}" for k in range(plan.lanes)]), "fingerprints")
    lanes = [f"_fp{k}" for k in range(plan.lanes)]
    nodes = rows.groupBy(*lanes).agg(F.min("_id").alias("_least"), F.count("*").alias("_rows"))
    tree = components(links(nodes.select(*lanes), plan, tile))
    by_fp = nodes.groupBy("_fp0").agg(F.min("_least").alias("_least"), F.sum("_rows").alias("_rows"))
    of = _shared(by_fp.withColumnRenamed("_fp0", "_node"), tree).select(F.col("_node").alias("_fp"), F.col("_least").alias("_component"))
    hexed = F.lower(F.lpad(F.hex("_fp0"), 16, "0"))
    component = F.when(F.col("_fp").isNull(), F.col("_id")).otherwise(F.col("_component"))
    return spread_join(rows, of, "_fp0", "_fp", "_id", "left").select(F.col("_id").alias(id_col), hexed.alias("fingerprint"), component.alias("component_id"))


def _shared(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """``_node, _least`` of nodes (_node, _least, _rows) that stand for several rows or are linked: the component's least."""
    placed = nodes.join(tree, F.col("_node") == F.col("node"), "left")
    linked = placed.filter("root is not null")
    best = linked.groupBy("root").agg(F.min("_least").alias("_best")).withColumnRenamed("root", "_root")
    alone = placed.filter("root is null and _rows > 1").select("_node", "_least")
    return alone.unionByName(spread_join(linked, best, "root", "_root", "_node", "inner").select("_node", F.col("_best").alias("_least")))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The different shingles of a text, as sorted 32-bit hashes."""
    found: list[int] = []
    carried: list[bytes] = []
    digest = xxhash.xxh32_intdigest
    for part in _spaced((text or "").encode("utf-8", "surrogatepass").lower()):
        part = carried + part
        carried = part[max(0, len(part) - words + 1) :]
        found += [digest(b" ".join(part[k : k + words])) for k in range(len(part) - words + 1)]
    if not found and carried:
        found = [digest(b" ".join(carried))]
    return np.unique(np.array(found, np.uint32))


#: Buckets that rows are told apart by before they are moved: a broadcast of so many numbers at most.
BUCKETS = 1 << 18


def _among(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``df`` joined to ``keys``, left_anti or inner; only rows whose key's bucket occurs are moved."""
    bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS))
    buckets = keys.select(bucket.alias("_bucket")).distinct()
    marked = df.withColumn("_bucket", bucket)
    near = marked.join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"_r.{c}").eqNullSafe(F.col(f"_k.{c}"))
    if how == "inner":
        return near.dropDuplicates(on).alias("_r").join(keys.alias("_k"), same)
    far = marked.join(F.broadcast(buckets), "_bucket", "left_anti").drop("_bucket")
    return far.unionByName(near.alias("_r").join(keys.alias("_k"), same, how))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``_node, _set``: the sorted 32-bit hashes of a text's different shingles, from ``_node, _text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words).view(np.int32) for t in b["_text"]]
            yield pa.RecordBatch.from_arrays([b["_node"], pa.array(sets, pa.list_(pa.int32()))], ["_node", "_set"])

    return texts.mapInArrow(lean(scan), "_node long, _set array<int>")


def drop_near_duplicates(df: DataFrame, plan: Plan, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row of each group, whole, with all columns: that of the smallest identifier.

    Fingerprints propose links; a link counts if the texts' sets of shingles are as similar as asked (Jaccard).
    Texts with the same set of shingles are one group.  Rows whose text is null, empty or has no word stay.  Null
    identifiers go before others; rows that repeat with identifier and text stay or go together.  Whole texts are
    read, in chunks; an empty table gives an empty result.  Rows keep their columns, whatever their names.
    """
    lanes = [f"_fp{k}" for k in range(plan.lanes)]
    keyed = df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"))
    text = F.col("_row")[text_col].alias("_text")
    rows = fingerprints(keyed.select("_id", "_h", text), plan, "_text", ["_id", "_h"], sets=True).select("_row._id", "_row._h", "_node", "_n", *lanes)
    rows = written(rows, "fingerprints").filter("_n > 0")
    least = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_h").alias("h"))).alias("_least")
    nodes = written(rows.groupBy("_node", "_n", *lanes).agg(least, F.count("*").alias("_rows")), "nodes")

    def sets(wanted: DataFrame) -> DataFrame:
        ends = written(nodes.join(wanted, "_node").select("_node", F.col("_least.i").alias("_id"), F.col("_least.h").alias("_h")), "ends")
        texts = _among(keyed.select("_id", "_h", text), ends, ["_id", "_h"], "inner")
        return written(shingle_sets(texts.select("_k._node", "_r._text"), plan.words), "shingles")

    tree = verified_components(nodes.select("_node", "_n", *lanes), plan, similarity, sets, tile)
    best = _shared(nodes.select("_node", "_least", "_rows"), tree).select(F.col("_node").alias("_of"), F.col("_least").alias("_best"))
    judged = spread_join(rows, best, "_node", "_of", "_h", "inner")
    gone = written(judged.filter((F.col("_h") != F.col("_best.h")) | ~F.col("_id").eqNullSafe(F.col("_best.i"))).select("_id", "_h").distinct(), "gone")
    return _among(keyed, gone, ["_id", "_h"], "left_anti").select("_row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words, links at four bits, three segments: every link is found."""
    return near_duplicates(documents(spark, sf_dir), Plan(words=4, distance=4, segments=3))
