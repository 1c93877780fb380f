"""Exact dedup by content sort.

Texts are range-partitioned by sampled splitters over (first bytes, SHA-256, identifier) and sorted externally,
so equal texts lie next to each other; neighbours are then compared in full.  The splitters stay short however
long the texts are, and as the identifier is part of the key a large group of copies spreads over many tasks.
A run of equal texts that touches a task's first or last row may go on in the next task; such runs, two a task
at most, meet in a small table that settles them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_small_batches, lean, written

#: Bytes of a text that the range splitters hold.
PREFIX = 48


def _runs(carry: bool, field: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (_id, _sha, _text or _row) to decisions; with ``carry`` only the first row of each run goes on.

    ``field``: the text is this one of _row, null being empty.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept_cols = ["_id", "_sha"] + ["_row"] * carry
        open_run: pa.Table | None = None  # rows of the run that may go on; with carry its first row only
        open_n, last_text, first_run = 0, None, True

        def emit(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray, edge: np.ndarray) -> pa.Table:
            n = len(rows)
            run = np.arange(len(starts)) if carry else np.repeat(np.arange(len(starts)), sizes)
            head = np.zeros(n, bool)
            head[np.arange(n) if carry else starts] = True
            cols = {
                "_id": rows["_id"],
                "_keep": rows["_id"] if carry else rows["_id"].take(pa.array(starts[run])),
                "_n": pa.array(sizes[run], pa.int64()),
                "_head": pa.array(head),
                "_sha": rows["_sha"],
                "_edge": pa.array(edge[run]),
                "_part": pa.array(np.full(n, part), pa.int32()),
            }
            if carry:
                cols["_row"] = rows["_row"]
            return pa.table(cols)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            sha = batch["_sha"]
            text = pc.fill_null(pc.struct_field(batch["_row"], field), "") if field else batch["_text"]
            new = np.ones(len(t), bool)
            same = pc.and_(pc.equal(sha[1:], sha[:-1]), pc.equal(text[1:], text[:-1]))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
            new[0] = last_text is None or not (open_run["_sha"][-1].as_py() == sha[0].as_py() and last_text == text[0].as_py())
            last_text = text[-1].as_py()
            starts = np.flatnonzero(new)
            rows = t.select(kept_cols)
            if not len(starts):  # the whole batch goes on with the open run
                open_n += len(t)
                if not carry:
                    open_run = pa.concat_tables([open_run, rows])
                continue
            if open_run is not None:
                size = open_n + starts[0]
                done = open_run if carry else pa.concat_tables([open_run, rows.slice(0, starts[0])])
                yield from emit(done, np.array([0]), np.array([size]), np.array([first_run])).to_batches()
                first_run = False
            if len(starts) > 1:
                sizes = np.diff(starts)
                whole = rows.take(pa.array(starts[:-1])) if carry else rows.slice(starts[0], starts[-1] - starts[0])
                edge = np.zeros(len(sizes), bool)
                edge[0] = first_run
                yield from emit(whole, starts[:-1] - starts[0], sizes, edge).to_batches()
                first_run = False
            open_run = rows.slice(starts[-1], 1 if carry else None)
            open_n = len(t) - starts[-1]
        if open_run is not None:
            yield from emit(open_run, np.array([0]), np.array([open_n]), np.array([True])).to_batches()

    return scan


def _sorted_runs(df: DataFrame, id_col: str, text_col: str, keep: str, normalise: Callable[[Column], Column] | None, carry: bool) -> DataFrame:
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    sha = F.sha2(F.encode(text, "UTF-8"), 256)
    field = text_col if carry and not normalise and df.schema[text_col].dataType == T.StringType() else None
    cols = [F.col(id_col).alias("_id"), sha.alias("_sha")] + [text.alias("_text")] * (field is None) + [F.struct(*df.columns).alias("_row")] * carry
    rows = in_small_batches(df).select(*cols, F.substring(F.encode(text, "UTF-8"), 1, PREFIX).alias("_start"))
    by_id = F.col("_id").asc_nulls_last() if keep == "min" else F.col("_id").desc_nulls_last()
    whole = F.coalesce(F.col("_row")[field], F.lit("")) if field else F.col("_text")
    ordered = rows.repartitionByRange("_start", "_sha", by_id).sortWithinPartitions("_start", "_sha", whole, by_id).drop("_start")
    id_type = df.schema[id_col].dataType
    out = [("_id", id_type), ("_keep", id_type), ("_n", T.LongType()), ("_head", T.BooleanType()), ("_sha", T.StringType()), ("_edge", T.BooleanType()), ("_part", T.IntegerType())]
    out += [("_row", ordered.schema["_row"].dataType)] if carry else []
    runs = written(ordered.mapInArrow(lean(_runs(carry, field)), T.StructType([T.StructField(*x) for x in out])), "runs")
    # Two runs a task at most, so this table is bounded by the number of tasks.
    edges = runs.filter("_edge and _head").groupBy("_sha").agg(F.sum("_n").alias("_all"), F.min_by("_keep", "_part").alias("_best"), F.min("_part").alias("_where"))
    edges = edges.withColumnRenamed("_sha", "_edge_sha")
    return runs.join(F.broadcast(edges), runs["_edge"] & (runs["_sha"] == edges["_edge_sha"]), "left")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    A null text counts as empty; an empty table gives an empty result.  ``keep`` says which identifier stays, a
    null identifier only if its group has no other.  Of rows that repeat with one identifier, exactly one stays.
    Other columns are not read, so their names may clash with ours.
    """
    r = _sorted_runs(df, id_col, text_col, keep, normalise, False)
    met = F.col("_edge_sha").isNotNull()
    return r.select(
        F.col("_id").alias(id_col),
        F.when(met, F.col("_best")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_all", "_n").alias("group_size"),
        (F.col("_head") & (~met | (F.col("_where") == F.col("_part")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``df`` that :func:`exact_duplicates` keeps, whole, with all columns; each text is moved once."""
    r = _sorted_runs(df, id_col, text_col, keep, normalise, True)
    return r.filter(F.col("_edge_sha").isNull() | (F.col("_where") == F.col("_part"))).select("_row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="max")


SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
