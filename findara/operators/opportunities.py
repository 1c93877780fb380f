"""Five kinds of typed opportunities.  Each: type, title, related (array), reason, score, priority, place.

``place`` orders an opportunity within its kind.  Results come with a rank from 1, best first.  ``by``: columns that
tell searches apart; all inputs have them, and every search has opportunities of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findara.functions.scores import priority, priority_order

# Kinds in the order they are made, thresholds, limits and sentences.
KINDS = ["RESEARCH_CONTINUITY", "COLLABORATION", "CURRICULAR_INTEGRATION", "CAPABILITY_ACTIVATION", "THESIS_OPPORTUNITY"]
GAP, COVERED = 0.20, 0.35
FEW, MATURE = 3, 3
CONTINUITY = ("Continuidad investigativa a partir de %s", "%s es antecedente relevante (score %.2f). Su director, %s, pertenece al grupo activo %s, lo que habilita dar continuidad a esta línea.")
COLLABORATION = (
    "Colaboración interdisciplinaria: %s + %s",
    "%s (%s) y %s (%s) llegan a esta necesidad por evidencia independiente y pertenecen a facultades distintas: su combinación amplía el abordaje más allá de un solo dominio.",
)
GAP_FOUND = (
    "Brecha curricular en %s",
    "El programa %s produce antecedentes relevantes para esta necesidad, pero ninguna de sus asignaturas muestra articulación temática clara (mejor cobertura curricular encontrada: %.2f). Se sugiere revisar el currículo del programa.",
)
INTEGRATION = (
    "Integrar como caso de estudio en %s",
    "La asignatura %s (%s) ya está alineada temáticamente (score %.2f); puede incorporar antecedentes reales del proyecto/tesis relacionado como caso de estudio.",
)
ACTIVATION = (
    "Activar %s",
    "%s tiene madurez %s/5, está activa y su perfil semántico se relaciona con la necesidad (score %.2f - inferido, sin arista explícita capacidad-proyecto en el dataset).",
)
RENEWAL = (
    "Nuevo trabajo de grado que actualice %s",
    "El antecedente más relevante disponible (%s) data de %s, anterior a la mitad del rango observado en el dataset (%s-%s). Es un hueco razonable para proponer un nuevo trabajo de grado que actualice esta línea.",
)


def _made(df: DataFrame, kind: int, need: Column, title: Column, related: list[str], reason: Column, score: Column, place: list[str], by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(*place)  # a handful of rows: results are ranked and cut before
    return df.select(
        *by,
        F.lit(kind).alias("made"), F.lit(KINDS[kind]).alias("type"), title.alias("title"), F.array(*[F.col(c).cast("string") for c in related]).alias("related"),
        reason.alias("reason"), score.alias("score"), priority(need, score).alias("priority"), F.row_number().over(order).alias("place"),
    )


def _first(df: DataFrame, n: int, by: list[str], *order: str) -> DataFrame:
    """The first rows of each search."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def continuity(results: DataFrame, directed: DataFrame, need: Column, by: list[str] = []) -> DataFrame:
    """``results``: id, name, score, rank (theses only); ``directed``: id, via, via_name, end, end_name, ordinal.

    The first three theses, with each director who is in an active group.
    """
    found = _first(results, FEW, by, "rank").join(directed, "id")
    title, reason = CONTINUITY
    return _made(found, 0, need, F.format_string(title, F.col("id")), ["id", "via", "end"], F.format_string(reason, "name", "score", "via_name", "end_name"), F.col("score"), ["rank", "ordinal", "via"], by)


def collaboration(people: DataFrame, need: Column, by: list[str] = []) -> DataFrame:
    """``people``: id, name, unit, score, rank.  The best of each unit, in pairs, the first three."""
    best = _first(people.filter("unit is not null and unit <> ''"), 1, [*by, "unit"], "rank")
    a, b = (best.select(*by, *[F.col(c).alias(f"{c}_{side}") for c in ("id", "name", "unit", "score", "rank")]) for side in "ab")
    # No more than top_k rows a side, one a unit.
    later = F.col("rank_a") < F.col("rank_b")
    pairs = _first(a.join(b, by).filter(later) if by else a.join(b, later), FEW, by, "rank_a", "rank_b")
    title, reason = COLLABORATION
    mean = (F.col("score_a") + F.col("score_b")) / 2
    return _made(pairs, 1, need, F.format_string(title, "unit_a", "unit_b"), ["id_a", "id_b"], F.format_string(reason, "name_a", "unit_a", "name_b", "unit_b"), mean, ["rank_a", "rank_b"], by)


def integration(sources: DataFrame, subjects: DataFrame, need: Column, by: list[str] = []) -> DataFrame:
    """``sources``: program, program_name, score, rank; ``subjects``: id, name, program, score, rank.

    A program whose best subject covers less than .20 has a gap; from .35 the subject takes up the case.
    """
    programs = sources.groupBy(*by, "program", "program_name").agg(F.max("score").alias("source"), F.min("rank").alias("first"))
    best = subjects.groupBy(*by, "program").agg(F.max_by(F.struct("id", "name"), F.struct("score", -F.col("rank"))).alias("best"), F.greatest(F.lit(0.0), F.max("score")).alias("cover"))
    joined = programs.join(best, [*by, "program"], "left").withColumn("cover", F.coalesce("cover", F.lit(0.0)))
    joined = joined.select("*", F.col("best.id").alias("subject"), F.col("best.name").alias("subject_name")).filter((F.col("cover") < GAP) | (F.col("cover") >= COVERED))
    gap = F.col("cover") < GAP
    title = F.when(gap, F.format_string(GAP_FOUND[0], "program_name")).otherwise(F.format_string(INTEGRATION[0], "subject_name"))
    reason = F.when(gap, F.format_string(GAP_FOUND[1], "program_name", "cover")).otherwise(F.format_string(INTEGRATION[1], "subject_name", "program_name", "cover"))
    out = _made(joined.withColumn("subject", F.when(~gap, F.col("subject").cast("string"))), 2, need, title, ["program", "subject"], reason, F.when(gap, F.col("source")).otherwise(F.col("cover")), ["first", "program"], by)
    return out.withColumn("related", F.array_compact("related"))


def activation(capabilities: DataFrame, need: Column, by: list[str] = []) -> DataFrame:
    """``capabilities``: id, name, base, maturity (number), active, score, rank.  The first three different bases."""
    good = capabilities.filter(F.col("active") & (F.col("maturity") >= MATURE))
    first = _first(_first(good, 1, [*by, "base"], "rank"), FEW, by, "rank")
    return _made(first, 3, need, F.format_string(ACTIVATION[0], "name"), ["id"], F.format_string(ACTIVATION[1], "name", F.col("maturity").cast("string"), "score"), F.col("score"), ["rank"], by)


def renewal(results: DataFrame, years: DataFrame, need: Column, by: list[str] = []) -> DataFrame:
    """``results``: id, name, year (number or null), score, rank (theses); ``years``: one row, least and most."""
    best = _first(results, 1, by, "rank").join(F.broadcast(years)).filter(F.col("year") <= (F.col("least") + F.col("most")) / 2)
    told = [F.col(c).cast("string") for c in ("year", "least", "most")]
    return _made(best, 4, need, F.format_string(RENEWAL[0], F.col("id")), ["id"], F.format_string(RENEWAL[1], "name", *told), F.col("score"), ["rank"], by)


def combined(parts: list[DataFrame], by: list[str] = []) -> DataFrame:
    """All opportunities with ``position`` from 1: by priority, then as they were made."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy(*by).orderBy(priority_order(F.col("priority")), "made", "place")  # a handful of rows a search
    return out.withColumn("position", F.row_number().over(order))
