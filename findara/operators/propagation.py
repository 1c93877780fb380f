"""Relevance that spreads along edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findara.functions.scores import AFFINITY, DAMPING, OTHER_ROLE, band, looked_up


def contributions(sources: DataFrame, steps: DataFrame, roles: dict[str, float], carry: list[str] = []) -> DataFrame:
    """``id, neighbour, role, weight, contribution`` and ``carry``: parallel edges count once, in their best role.

    ``sources``: id, score; ``steps``: id, neighbour, role, ordinal.  Of roles of the same weight the last declared
    is the evidence.
    """
    weighed = steps.withColumn("w", looked_up(F.coalesce("role", F.lit("")), roles, OTHER_ROLE))
    best = weighed.groupBy("id", "neighbour").agg(F.max_by(F.struct("w", "role", *carry), F.struct("w", "ordinal", F.coalesce("role", F.lit("")))).alias("best"))
    scored = best.join(sources.select("id", "score"), "id")
    return scored.select("id", "neighbour", F.col("best.role").alias("role"), F.col("best.w").alias("weight"), (F.lit(DAMPING) * F.col("score") * F.col("best.w")).alias("contribution"), *[F.col(f"best.{c}").alias(c) for c in carry])


def spread(found: DataFrame, affinity: DataFrame | None = None) -> DataFrame:
    """``neighbour, direct, affinity, total, band, nature, sources``; ``affinity``: neighbour, similarity."""
    direct = found.groupBy("neighbour").agg(F.round(F.least(F.lit(1.0), F.sum("contribution")), 4).alias("direct"), F.count("*").alias("sources"))
    if affinity is None:
        direct = direct.withColumn("similarity", F.lit(None).cast("double"))
    else:
        direct = direct.join(affinity, "neighbour", "left")
    like = F.round(F.lit(AFFINITY) * F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0))), 4)
    out = direct.withColumn("affinity", like).withColumn("total", F.col("direct") + F.col("affinity"))
    nature = F.when(F.col("affinity") > 0, "mixta").otherwise("explicita")
    return out.select("neighbour", "direct", "affinity", "total", band(F.col("total")).alias("band"), nature.alias("nature"), "sources")


def best_of(df: DataFrame, key: str, score: str) -> DataFrame:
    """``key, best``: the highest score of each key, at least 0."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.greatest(F.lit(0.0), F.max(score)).alias("best"))


def bridged(items: DataFrame, bridges: DataFrame, key: str, semantic: Column, lexical: Column) -> DataFrame:
    """Items by a shared key or by likeness: half the key's best score plus the weighted likeness.

    Adds ``bridge, affinity, total, nature``.  Items without a bridge need a semantic score of .35 or a lexical one
    of .15.
    """
    joined = items.join(bridges, key, "left")
    has = F.col("best").isNotNull()
    out = joined.filter(has | (semantic >= 0.35) | (lexical >= 0.15))
    out = out.withColumn("bridge", F.when(has, F.col("best") * 0.5).otherwise(0.0)).withColumn("affinity", F.lit(AFFINITY) * F.greatest(semantic, lexical))
    return out.withColumn("total", F.col("bridge") + F.col("affinity")).withColumn("nature", F.when(has, "mixta").otherwise("inferida"))


def matched(pairs: DataFrame, semantic: Column, lexical: Column, domain: Column, least: float = 0.10) -> DataFrame:
    """Add ``affinity, overlap, total, band``; pairs below ``least`` are left out."""
    out = pairs.withColumn("affinity", 0.5 * F.greatest(semantic, lexical)).withColumn("overlap", 0.3 * domain)
    out = out.withColumn("total", F.col("affinity") + F.col("overlap"))
    return out.filter(F.col("total") >= least).withColumn("band", band(F.col("total")))


def mode(votes: DataFrame, key: str, level: str, ordinal: str) -> DataFrame:
    """``key, level``: the most frequent level, of ties the first met."""
    counts = votes.filter(F.col(level).isNotNull()).groupBy(key, level).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return counts.groupBy(key).agg(F.max_by(level, F.struct("n", -F.col("first"))).alias(level))
