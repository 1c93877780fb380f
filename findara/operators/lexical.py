"""TF-IDF over tokens and bigrams, as long tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findara.functions.text import ngrams, tokens
from findara.session import written


#: Query terms up to which they are broadcast.
MOST_TERMS = 500_000


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf``.  Texts are dealt by identifier, so their many terms are counted where they are."""
    words = F.explode(ngrams(tokens(F.coalesce(F.col("text"), F.lit("")))))
    dealt = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id")
    return dealt.select("id", words.alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def weigh(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, term, w``: sublinear TF times IDF, unit length a text; terms that ``terms`` lacks are left out.

    The rows of a text come out together.
    """
    raw = counts.join(terms, "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))  # a text's terms
    return raw.select("id", "term", (F.col("raw") / norm).alias("w"))


@dataclass
class LexicalIndex:
    """``terms``: term, df, idf; ``weights``: id, term, w."""

    terms: DataFrame
    weights: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, text_col: str) -> LexicalIndex:
        """Counts and document frequencies are tables of their own, as both are read twice."""
        counts = written(term_counts(df, id_col, text_col), "counts")
        n = df.agg(F.count("*").alias("n"))
        terms = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
        terms = written(terms, "terms")
        return cls(terms, weigh(counts, terms))

    def asked(self, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``query, term, q`` of each query, as a table."""
        counts = written(term_counts(queries, id_col, text_col), "asked")
        counts = F.broadcast(counts) if counts.count() <= MOST_TERMS else counts  # the index's terms are not moved
        return written(weigh(counts, self.terms).toDF("query", "term", "q"), "asked")

    def similarities(self, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``query, id, similarity`` for each query and text that share a term.

        The weights of terms that are asked for are dealt by text, so sums are made where they are.
        """
        asked = self.asked(queries, id_col, text_col)
        near = self.weights
        if asked.count() <= MOST_TERMS:
            near = near.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").repartition("id")
            asked = F.broadcast(asked)
        return near.join(asked, "term").groupBy("query", "id").agg(F.sum(F.col("q") * F.col("w")).alias("similarity"))


def top(df: DataFrame, k: int, score: str, group: list[str], tie: list[str]) -> DataFrame:
    """The best k rows a group, ties by ``tie``, with ``rank`` from 1."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), *tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
