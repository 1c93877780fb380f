"""Extension: score new documents as they arrive.  Batch search has no streams; this reuses its index as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from findara.operators.lexical import LexicalIndex, term_counts, weigh


def score_new(new: DataFrame, index: LexicalIndex, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query, id, similarity`` of documents that the index has not seen, by its document frequencies."""
    fresh = LexicalIndex(index.terms, weigh(term_counts(new, id_col, text_col), index.terms))
    return fresh.similarities(queries, "query", "text")


def score_stream(stream: DataFrame, index: LexicalIndex, queries: DataFrame, id_col: str, text_col: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the scores of each micro-batch under its number; a batch that is run again overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        score_new(batch, index, queries, id_col, text_col).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
