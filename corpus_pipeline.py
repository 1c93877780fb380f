"""From raw documents to packed training sequences, a table at a time.

All stages read whole texts, long ones in parts, give an empty result for an empty table, and all but the last keep the
rows' columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findara.llm.common import documents, written
from findara.llm.exact_dedup import drop_exact_duplicates
from findara.llm.language_id import identify, train
from findara.llm.mixing import mix, words
from findara.llm.packing import pack_documents
from findara.llm.simhash import Plan, drop_near_duplicates

#: Shingles of five words.  A similarity of 0.8 comes to 29 of 192 bits, and two deviations more to 39; two texts meet
#: if one of twelve 16-bit segments differs by at most one bit.  Links are then checked on the shingles themselves.
NEAR = Plan(words=5, distance=39, segments=4, lanes=3)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near enough to a language's centroid.

    Texts that are null, empty or without letters go, as do all if no row has a language.  Rows that repeat stay or go
    together; null identifiers are values like any other.
    """
    return identify(docs, train(docs)).filter(~F.col("rejected")).select("_row.*")


def different_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id, a null one only if there is no other; null counts as empty.

    Of rows that repeat with one identifier one stays.
    """
    return drop_exact_duplicates(docs)


def dissimilar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts, the document with the smallest doc_id, null before others.

    Texts that are null, empty or without words stay; rows that repeat with identifier and text stay or go together.
    """
    return drop_near_duplicates(docs, NEAR)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is one of its own; a source without words is not taken.  Rows that repeat are drawn one by one.
    """
    taken = mix(docs, words(F.col("text"))).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; a row that comes twice is packed twice.  Null and empty texts have the end token alone."""
    return pack_documents(docs)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", different_texts),
    ("simhash_near_dedup", dissimilar_texts),
    ("mix_sources", mixed_sources),
    ("pack", packed_sequences),
]

#: SQL cannot express near duplicates, balanced sampling or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
