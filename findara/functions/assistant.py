"""What an assistant says without a language model: a context, citations and an answer from the results alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentences, and how many items, citations and turns they take.
ITEMS, CITATIONS, TURNS = 4, 5, 4
NOTHING = (
    "No encontré antecedentes claros para lo que me contaste. ¿Podrías darme un poco más de detalle o probar con otras palabras? "
    "A veces ayuda mencionar el área (por ejemplo salud, educación, tecnología) o el tipo de problema que querés resolver."
)
FOUND = "¡Encontré algunas conexiones que pueden servirte!"
BEST = 'El antecedente más relevante que encontré es "%s" (confianza %s).'
PERSON = "La persona más conectada con este tema parece ser %s."
CHANCES = 'También identifiqué %d oportunidad(es) institucional(es), como "%s".'
DETAIL = "Podés ver el detalle completo y la evidencia exacta de cada dato en las pestañas de Conexiones y Oportunidades."
ITEM, EMPTY = "- %s (%s, id %s), confianza %s (score %.2f). %s", "(sin resultados en esta categoría)"


def summary(items: Column) -> Column:
    """Lines for the first items of an array of (name, kind, id, band, score, explanation)."""
    lines = F.transform(F.slice(items, 1, ITEMS), lambda x: F.format_string(ITEM, x["name"], x["kind"], x["id"], x["band"], x["score"], x["explanation"]))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise(F.lit(EMPTY))


def citations(of_items: Column) -> Column:
    """The first different citations of an array of arrays, in order."""
    return F.slice(F.array_distinct(F.flatten(of_items)), 1, CITATIONS)


def answer(best: Column, band: Column, person: Column, chances: Column, chance: Column) -> Column:
    """The answer without a model; null where there is no best result, person or opportunity."""
    said = F.array(
        F.lit(FOUND), F.when(best.isNotNull(), F.format_string(BEST, best, F.lower(band))), F.when(person.isNotNull(), F.format_string(PERSON, person)),
        F.when(chances > 0, F.format_string(CHANCES, chances, chance)), F.lit(DETAIL),
    )
    return F.when(best.isNull() & person.isNull(), F.lit(NOTHING)).otherwise(F.array_join(F.array_compact(said), " "))


def recent(turns: Column) -> Column:
    """The last turns of a conversation, in order."""
    return F.slice(turns, F.greatest(F.size(turns) - TURNS + 1, F.lit(1)), TURNS)
