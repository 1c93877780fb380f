"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes every document floor(r) times, and once more with the fractional
part of r as inclusion probability.  The flight phase moves the probabilities of three documents at a time along
the null space of the two balancing constraints, so that the expected words and the expected documents stay as
they are while one of the three becomes 0 or 1.  Documents are dealt to chunks by a hash, so a large source
flies in many tasks; the two or fewer fractions that a chunk leaves fly on together, until each source has two or
fewer: the landing rounds those, with exchanges, to the words nearest to the target.

All random draws come from a seed, the source and the chunk, and the chunks from the rows alone: reruns agree.
"""

from __future__ import annotations

import bisect
import itertools
import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, documents, in_small_batches, lean, sorted_ranks, written

#: Rows of a chunk, about, and rows of one chunk that fly at a time: rows that repeat wholly share a chunk.
CHUNK, TOGETHER = 512, 1 << 12
#: Nearer to 0 or 1 than this is there.
NEAR = 1e-9


def flight(chances: list[float], sizes: list[int], rng: random.Random) -> list[float]:
    """Chances of which at most two are left between 0 and 1; their sum and the sum weighted by size stay."""
    out = list(chances)
    flying: list[int] = []
    for k in range(len(out)):
        if NEAR < out[k] < 1 - NEAR:
            flying.append(k)
        while len(flying) == 3:
            a, b, c = flying
            move = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if not any(move):
                move = (1, -1, 0)
            up = min((1 - out[i] if u > 0 else out[i]) / abs(u) for i, u in zip(flying, move) if u)
            down = min((out[i] if u > 0 else 1 - out[i]) / abs(u) for i, u in zip(flying, move) if u)
            step = up if rng.random() * (up + down) < down else -down
            for i, u in zip(flying, move):
                out[i] += step * u
                if out[i] <= NEAR or out[i] >= 1 - NEAR:
                    out[i] = round(out[i])
            flying = [i for i in flying if NEAR < out[i] < 1 - NEAR]
    return out


def landing(before: list[float], chances: list[float], sizes: list[int]) -> list[float]:
    """Every chance rounded so that the words come nearest to those expected ``before`` the flight.

    The few fractions left are rounded in the best of all ways (of ties, the fewest taken); then, while it brings
    the words nearer, one taken document is exchanged for one that is not, which leaves the documents' number.
    """
    open_ = [k for k, p in enumerate(chances) if NEAR < p < 1 - NEAR]
    out = [float(round(p)) for p in chances]
    want = sum(p * s for p, s in zip(before, sizes))
    fixed = sum(out[k] * s for k, s in enumerate(sizes)) - sum(out[k] * sizes[k] for k in open_)
    best = min(itertools.product((0, 1), repeat=len(open_)), key=lambda x: (abs(fixed + sum(sizes[k] * v for k, v in zip(open_, x)) - want), sum(x), x))
    for k, v in zip(open_, best):
        out[k] = float(v)
    free = sorted((k for k, p in enumerate(before) if NEAR < p < 1 - NEAR), key=lambda k: (sizes[k], k))
    over = sum(p * s for p, s in zip(out, sizes)) - want
    while abs(over) >= 1:
        outside = [k for k in free if not out[k]]
        lengths = [sizes[k] for k in outside]
        found = (abs(over), -1, -1)
        for k in free:
            if out[k]:
                at = bisect.bisect(lengths, sizes[k] - over)
                for j in range(max(0, at - 1), min(len(outside), at + 1)):
                    found = min(found, (abs(over - sizes[k] + lengths[j]), k, outside[j]))
        if found[1] < 0 or found[0] > abs(over) - 0.5:
            break
        out[found[1]], out[found[2]] = 0.0, 1.0
        over += sizes[found[2]] - sizes[found[1]]
    return out


def targets(totals: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Add ``_target`` to rows (_source, _total, _rows): sources in order take the weights in turn.

    A target is the smaller of cap x total and its weight times a common level; the level that uses up the share
    is found by giving what capped sources cannot take to the others until none is above its cap.
    """
    order = totals.withColumn("_null", F.col("_source").isNull()).withColumn("_all", F.lit(0))
    ranked = sorted_ranks(order, ["_all"], ["_null", "_source"], "sources").drop("_null", "_all")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_most", F.col("_total") * F.lit(float(cap)))
    all_words = ranked.agg(F.sum("_total")).first()[0] or 0
    level, wanted = 0.0, min(share, cap) * all_words
    while True:
        capped = F.col("_weight") * F.lit(level) >= F.col("_most")
        full, free = ranked.agg(F.sum(F.when(capped, F.col("_most"))), F.sum(F.when(~capped, F.col("_weight")))).first()
        if not free:
            break
        higher = (wanted - (full or 0.0)) / free
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return ranked.select("_source", "_total", "_rows", F.least(F.col("_most"), F.col("_weight") * F.lit(level)).alias("_target"))


def _fly(seed: int, last: bool, at: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by source and chunk, with the chance ``_p`` moved; ``last`` lands as well."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def done(group: pa.Table) -> Iterator[pa.RecordBatch]:
            name = f"{seed}|{at}|{group['_source'][0].as_py()!r}|{group['_chunk'][0].as_py()}"
            together = len(group) if last else TOGETHER
            for k in range(0, len(group), together):
                part = group.slice(k, together)
                sizes, before = part["_size"].to_pylist(), part["_p"].to_pylist()
                p = flight(before, sizes, random.Random(name))
                p = landing(before, p, sizes) if last else p
                yield from part.set_column(part.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64())).to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if waiting is not None:
                rows = pa.concat_tables([waiting, rows])
            keys = list(zip(rows["_source"].to_pylist(), rows["_chunk"].to_pylist()))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
            for a, b in zip(cuts, cuts[1:]):
                yield from done(rows.slice(a, b - a))
            waiting = rows.slice(cuts[-1]) if len(keys) else None
            while not last and waiting is not None and len(waiting) >= TOGETHER:
                yield from done(waiting.slice(0, TOGETHER))
                waiting = waiting.slice(TOGETHER)
        if waiting is not None and len(waiting):
            yield from done(waiting)

    return scan


def mix(df: DataFrame, size: F.Column, source_col: str = "source", weights: list[int] = [3, 1, 2], share: float = 1.5, cap: float = 2.0, seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """``_row`` (the row as a struct), ``size, source_size, target, copies``: how often the mix takes each row.

    Sources are ordered by code point, null last and a source of its own.  A row of size zero (an empty or null text)
    takes part with its chance and adds no words; a source without words has the target 0 and takes nothing.  Null
    identifiers are values like any other: rows are dealt by a hash of all their columns but maps.  Rows that repeat
    wholly are drawn one by one.  Long texts are only hashed.  An empty table gives an empty result; the row being a
    struct, its names cannot clash with ours.
    """
    digest = F.xxhash64(F.lit(seed), *[F.col(c) for c, kind in df.dtypes if "map<" not in kind])
    rows = in_small_batches(df).select(F.struct(*df.columns).alias("_row"), F.col(source_col).cast("string").alias("_source"), digest.alias("_digest"), size.cast("long").alias("_size"))
    totals = written(rows.groupBy("_source").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows")), "sources")
    aims = written(targets(totals, weights, share, cap), "targets")
    small = aims.count() <= 10_000  # a table of this many narrow rows is broadcast, a larger one is joined by sorting
    aims = aims.select(F.col("_source").alias("_s"), "_total", "_rows", "_target")
    rows = rows.join(F.broadcast(aims) if small else aims, F.col("_source").eqNullSafe(F.col("_s")))
    ratio = F.coalesce(F.try_divide(F.col("_target"), F.col("_total")), F.lit(0.0))
    rows = rows.withColumn("_base", F.floor(ratio).cast("long")).withColumn("_p", ratio - F.floor(ratio))
    chunks = lambda n: F.ceil(F.col("_rows") / F.lit(n))
    parts, dealt = [], 1
    while True:
        dealt *= chunk if not parts else chunk // 2  # each chunk leaves two rows at most
        n = chunks(dealt)
        most = aims.agg(F.max(n)).first()[0] or 1
        flying = rows.withColumn("_chunk", F.pmod("_digest", n).cast("long"))
        sort = ["_source", "_chunk", F.desc("_size"), "_digest"]
        flying = flying.repartition("_source", "_chunk").sortWithinPartitions(*sort)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in flying.schema])
        table = written(flying.mapInArrow(lean(_fly(seed, most == 1, str(len(parts)))), schema), "flight")
        if most == 1:
            parts.append(table)
            break
        undecided = (F.col("_p") > NEAR) & (F.col("_p") < 1 - NEAR)
        parts.append(table.filter(~undecided))
        rows = table.filter(undecided).drop("_chunk")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = F.col("_base") + F.round("_p").cast("long")
    return out.select("_row", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"))


def words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2 in turn over the sources; 150 % of all words; no source beyond twice its words."""
    docs = documents(spark, sf_dir)
    narrow = docs.select("doc_id", "source", words(F.col("text")).alias("n"))
    mixed = mix(narrow, F.col("n"))
    return mixed.select("_row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
