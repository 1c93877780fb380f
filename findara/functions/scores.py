"""Score expressions: overlaps, bands, evidence, priorities, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, thresholds and tables that the scores are defined by.
WEIGHTS = {"semantic": 0.35, "lexical": 0.15, "topic": 0.25, "domain": 0.10, "method": 0.10, "evidence": 0.05}
METHOD_WITHOUT_TOPIC = 0.5
DAMPING = 0.6
RESEARCHER_ROLES = {"PI": 1.0, "CO_INVESTIGATOR": 0.6, "ADVISOR": 1.0, "AUTHOR": 0.8}
GROUP_ROLES = {"LEADER": 1.0, "MEMBER": 0.6}
OTHER_ROLE = 0.6
AFFINITY = 0.4
MMR_LAMBDA = 0.7
POOL, TOP_K = 50, 10
RELIABILITY = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4, "NO_CATALOGADO": 0.6}
HIGH_BAND, MIDDLE_BAND = 0.45, 0.25
BANDS = ("Alta", "Media", "Baja")
YEARS = (2015, 2026)
# Ablation: weights and MMR's lambda of each variant.
VARIANTS = {
    "completo (híbrido)": (WEIGHTS, MMR_LAMBDA),
    "solo léxico (TF-IDF)": ({"lexical": 1.0}, MMR_LAMBDA),
    "solo semántico (embeddings)": ({"semantic": 1.0}, MMR_LAMBDA),
    "solo facetas (tema+dominio+método)": ({"topic": 0.5, "domain": 0.3, "method": 0.2}, MMR_LAMBDA),
    "híbrido sin MMR": (WEIGHTS, 1.0),
}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def band(score: Column) -> Column:
    return F.when(score >= HIGH_BAND, BANDS[0]).when(score >= MIDDLE_BAND, BANDS[1]).otherwise(BANDS[2])


def recency(year: Column, least: Column, most: Column) -> Column:
    """0.6 for the oldest year to 1.0 for the newest; a missing year gets 0.8."""
    place = (year - least) / F.greatest(F.lit(1), most - least)
    return F.when(year.isNull(), 0.8).otherwise(0.6 + 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), place)))


def completeness(fields: list[Column]) -> Column:
    """The share of fields that are not empty."""
    return F.size(F.filter(F.array(*fields), lambda x: x != "")) / F.lit(float(len(fields)))


def looked_up(key: Column, table: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def priority(need: Column, mean: Column) -> Column:
    """An opportunity's priority from its need's and the mean score."""
    return (
        F.when((need == "HIGH") & (mean >= HIGH_BAND), BANDS[0])
        .when(need.isin("HIGH", "MEDIUM") & (mean >= MIDDLE_BAND), BANDS[1])
        .when(mean >= HIGH_BAND, BANDS[1])
        .otherwise(BANDS[2])
    )


def priority_order(c: Column) -> Column:
    return F.when(c == BANDS[0], 0).when(c == BANDS[1], 1).otherwise(2)


def effective(weights: dict[str, float], semantic: bool) -> dict[str, float]:
    """Without semantic vectors their weight goes to the lexical score."""
    out = dict.fromkeys(WEIGHTS, 0.0) | weights
    if not semantic:
        out["lexical"] += out["semantic"]
        out["semantic"] = 0.0
    return out
