"""A property multigraph as two tables: nodes (id, kind, name) and edges with provenance.

Edges: src, dst, label, role (null for foreign keys), nature, file, record, field, ordinal (the order in which the
edges of the graph were declared, which settles ties).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class ForeignKey:
    """Rows of ``df`` (id) point to what ``column`` says."""

    df: DataFrame
    id_col: str
    column: str
    label: str
    file: str = ""


@dataclass
class Relation:
    """Rows of ``df`` join two nodes, in a role."""

    df: DataFrame
    src: str
    dst: str
    role: str | None
    label: str
    file: str = ""


def nodes(parts: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """``id, kind, name`` from (kind, table, id, name)."""
    out = None
    for kind, df, key, name in parts:
        rows = df.select(key.cast("string").alias("id"), F.lit(kind).alias("kind"), name.alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _edges(df: DataFrame, src: Column, dst: Column, label: str, role: Column, file: str, record: Column, field: str, ordinal: int) -> DataFrame:
    return df.select(
        src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(label).alias("label"), role.cast("string").alias("role"),
        F.lit("explicita").alias("nature"), F.lit(file).alias("file"), record.cast("string").alias("record"), F.lit(field).alias("field"), F.lit(ordinal).alias("ordinal"),
    )


def declared(keys: list[ForeignKey], relations: list[Relation]) -> DataFrame:
    """Edges as the tables say, whether or not their ends are known; an empty key makes none.  Keys come before relations."""
    out = None
    for n, k in enumerate(keys):
        rows = _edges(k.df, F.col(k.id_col), F.col(k.column), k.label, F.lit(None), k.file, F.col(k.id_col), k.column, n)
        out = rows if out is None else out.unionByName(rows)
    for n, r in enumerate(relations, len(keys)):
        record = F.concat_ws("|", F.col(r.src).cast("string"), F.col(r.dst).cast("string"))
        rows = _edges(r.df, F.col(r.src), F.col(r.dst), r.label, F.col(r.role) if r.role else F.lit(None), r.file, record, r.role or r.label, n)
        out = rows if out is None else out.unionByName(rows)
    return out.filter("dst is not null and trim(dst) <> ''")


def edges(known: DataFrame, keys: list[ForeignKey], relations: list[Relation]) -> DataFrame:
    """Declared edges whose ends are both known nodes."""
    ids = known.select(F.col("id").alias("known"))
    return declared(keys, relations).join(ids, F.col("dst") == F.col("known"), "left_semi").join(ids, F.col("src") == F.col("known"), "left_semi")


def neighbours(start: DataFrame, graph: DataFrame, labels: list[str], direction: str) -> DataFrame:
    """``id, neighbour, label, role, ordinal, file, record, field`` one step from ``start`` (id); direction: in, out or both."""
    chosen = graph.filter(F.col("label").isin(labels))
    step = lambda a, b: start.join(chosen, F.col("id") == F.col(a)).select("id", F.col(b).alias("neighbour"), "label", "role", "ordinal", "file", "record", "field")
    if direction == "in":
        return step("dst", "src")
    if direction == "out":
        return step("src", "dst")
    return step("dst", "src").unionByName(step("src", "dst"))


def induced(members: DataFrame, graph: DataFrame) -> DataFrame:
    """``a, b, label``: one undirected edge for each pair of members that are joined, the first declared; no loops."""
    ids = members.select(F.col("id").alias("member")).distinct()
    inside = graph.join(ids, F.col("src") == F.col("member"), "left_semi").join(ids, F.col("dst") == F.col("member"), "left_semi").filter("src <> dst")
    paired = inside.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "label", "ordinal", "record")
    return paired.groupBy("a", "b").agg(F.min_by("label", F.struct("ordinal", "record", "label")).alias("label"))


def dangling(graph: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = known.select(F.col("id").alias("known"))
    return graph.join(ids, F.col("dst") == F.col("known"), "left_anti").unionByName(graph.join(ids, F.col("src") == F.col("known"), "left_anti")).distinct()


def two_steps(graph: DataFrame, first: str, second: str, end: DataFrame) -> DataFrame:
    """``id, via, end``: id <-first- via -second-> end, the first declared end (smallest record) of each via.

    ``end``: the nodes (id) that count as ends.
    """
    to_end = graph.filter(F.col("label") == second).join(end.select(F.col("id").alias("good")), F.col("dst") == F.col("good"), "left_semi")
    order = Window.partitionBy("src").orderBy("ordinal", "record", "dst")
    one = to_end.withColumn("n", F.row_number().over(order)).filter("n = 1").select(F.col("src").alias("via"), F.col("dst").alias("end"))
    return graph.filter(F.col("label") == first).select(F.col("dst").alias("id"), F.col("src").alias("via")).join(one, "via").select("id", "via", "end")
