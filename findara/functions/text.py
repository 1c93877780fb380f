"""Text expressions: values, lists, folding, tokens, whole words."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of the lexical index: two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD_CHARACTER = r"[\p{L}\p{N}_]"


def value(c: Column) -> Column:
    """A field's text, null as empty, without blanks around it."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def values(c: Column, separator: str = ";") -> Column:
    """The non-empty parts of a list in one field."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def mended(c: Column) -> Column:
    """A phrase that was taken apart word by word with semicolons."""
    return F.replace(c, F.lit(";"), F.lit(" "))


def joined(fields: list[Column], between: str = " . ") -> Column:
    """The non-empty fields, in order."""
    return F.array_join(F.filter(F.array(*fields), lambda x: x != ""), between)


def first_of(fields: list[Column], otherwise: Column) -> Column:
    """The first non-empty field."""
    return F.coalesce(*[F.nullif(value(f), F.lit("")) for f in fields], otherwise.cast("string"))


def digits(c: Column) -> Column:
    """The number that a text of digits alone is, else null."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def _folding() -> tuple[str, str]:
    """Characters that are one letter in another form (marked, full-width, mathematical), and those letters; then
    combining marks, which stand for nothing."""
    one, plain, marks = [], [], []
    for code in range(0xA0, 0x20000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        parts = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(parts) == 1 and parts != c and c == c.lower():
            one.append(c)
            plain.append(parts)
    return "".join(one + marks), "".join(plain)


_MARKED, _PLAIN = _folding()


def folded(c: Column) -> Column:
    """Lower case, trimmed, without marks; stays in generated code.

    Characters that stand for several letters, such as ligatures, stay as they are.
    """
    return F.translate(F.lower(F.trim(c)), _MARKED, _PLAIN)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def pairs(words: Column) -> Column:
    """Neighbours with a blank between them."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda x, y: F.concat(x, F.lit(" "), y))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring tokens with a blank between them."""
    return once(words, pairs)


def ngrams(words: Column) -> Column:
    """Tokens and bigrams."""
    return once(words, lambda w: F.concat(w, pairs(w)))


def has_word(text: Column, term: Column) -> Column:
    """Whether the term occurs as a whole word; both are folded."""
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_like(text, F.concat(F.lit(f"(?<!{WORD_CHARACTER})"), quoted, F.lit(f"(?!{WORD_CHARACTER})")))


def without_suffix(c: Column, pattern: str = r"\s*—\s*capacidad\s*\d+\s*$") -> Column:
    """A name without its numbered suffix."""
    return F.regexp_replace(c, pattern, "")
