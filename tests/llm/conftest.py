"""Small tables of awkward rows."""

import random

import pytest

LONG = " ".join(f"word{k % 997}" for k in range(300_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, ties; columns named like what operators add."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 9, 0),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 9, 0),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 9, 0),
        (3, None, "en", "b", None, 1),
        (4, "", None, None, 0, 1),
        (5, " \t\n ", "en", "b", 4, 1),
        (6, LONG, "en", "c", len(LONG), 2),
        (7, LONG, "en", "c", len(LONG), 2),
        (None, "an orphan text without a number", "en", None, 31, 3),
        (8, "ünïcödé 日本語 🙂 <|endoftext|> it's", "xx", "d", 30, 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank long")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def prose(spark):
    """600 texts in two made-up languages, with exact and near copies."""
    rng = random.Random(7)
    tongues = {"aa": ["bala", "ruka", "tomi", "sefa", "lodu", "nika", "para", "wesi"], "bb": ["schrag", "knopf", "wurst", "zwolf", "pfund", "strich", "quark", "jetzt"]}
    rows, number = [], 0
    for lang, words in tongues.items():
        for _ in range(250):
            text = " ".join(rng.choice(words) + rng.choice(["", "n", "s", "ta"]) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(rng.randrange(20, 200)))
            rows.append((number, text, lang, f"s{number % 5}"))
            number += 1
            if number % 5 == 0:
                rows.append((number, text, lang, f"s{number % 5}"))
                number += 1
            if number % 7 == 0:
                parts = text.split()
                parts[len(parts) // 2] = "changed"
                rows.append((number, " ".join(parts), lang, f"s{number % 5}"))
                number += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
