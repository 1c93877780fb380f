"""What the operators of this package share: the cluster's shared folder, written intermediate tables, ranks."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findara.session import new_path, written  # noqa: F401  (the operators take them from here)

#: Word characters of the contracts: everything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch: rows can be long, and a Python worker holds a few batches at a time.
BATCH = 4 << 20


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan``, after which the worker process, which later tasks use again, gives free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to hand rows to Python in batches of at most ``BATCH`` bytes."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH:
        conf.set(key, f"{BATCH}b")
    return df


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` ... that no column of ``df`` has (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sorted_ranks(df: DataFrame, group: list[str], order: list[str], tag: str, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` with ``rank`` (long, from 0; ``rank_`` ... if taken): the row's place in its group by ``order``.

    Range-partitioned by group and order, so one group spreads over many tasks.  Each task numbers its rows; a
    small table, at most one row per group and task boundary, turns those numbers into ranks.  Rows that tie in
    all of ``group`` and ``order`` get different ranks, in either order.  Without ``order`` all rows of a group tie:
    they are numbered where they are.
    """
    at, part = F.col("_at"), F.shiftright("_at", 33)
    ordered = (df.repartitionByRange(*group, *order) if order else df).sortWithinPartitions(*group, *order)
    table = written(ordered.withColumn("_at", F.monotonically_increasing_id()), tag, path, by)
    runs = table.groupBy(*group, part.alias("_part")).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    before = {}
    starts = []
    for r in sorted(runs.collect(), key=lambda r: r["_part"]):  # one row per group and task
        key = tuple(r[g] for g in group)
        starts.append((*key, r["_part"], before.get(key, 0) - r["_first"]))
        before[key] = before.get(key, 0) + r["_n"]
    fields = [runs.schema[g] for g in group]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _part long, _shift long"
    shifts = df.sparkSession.createDataFrame(starts, schema)
    same = [table[g].eqNullSafe(shifts[g]) for g in group]
    on = F.shiftright(table["_at"], 33) == shifts["_part"]
    for s in same:
        on = on & s
    out = table.join(F.broadcast(shifts), on)
    return out.select(*[table[c] for c in df.columns], (table["_at"] + shifts["_shift"]).alias(free_name(df, "rank")))


#: Tasks that the rows of one key are dealt to.
SALT = 16


def spread_join(rows: DataFrame, small: DataFrame, key: str, other: str, by: str, how: str) -> DataFrame:
    """Join rows to a narrow table with at most one row a key; the rows of a key are dealt to ``SALT`` tasks by ``by``."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(copies, (F.col(key) == F.col(other)) & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")
