import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from findara.llm import token_counts as module
from findara.llm.packing import tokenizer_path
from findara.llm.token_counts import TOKENIZER, Machine, token_counts

FILE = public_tokenizers.path(TOKENIZER)
HARD = ["", "a", "'s", "it's", "it're x", "'rx", "' re", " 're", "a 's", "x'", "x''s", "!!'s", "\n's", "a\n\n b", "a  b", "a   ", "\t\t x", "é'll", "'l'l", "'ll'll", "'v", "'r ", "'l1",
        "<|endoftext|>", "a  <|endoftext|>  b", "日本語 テスト", "١٢٣ ½", "🙂🙂 x", "\x00\x01", "\u0085\u0085a", "'S 'T", "don't we'd I'm", " _", "\x1c\x1c a"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_hard_and_random_texts(library):
    rng = random.Random(0)
    letters = "abstrevl'   \n\t!?1é ñ日<|"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    assert Machine(FILE).counts([t.encode() for t in texts]).tolist() == want(library, texts)


def test_every_code_point_has_its_class(library):
    machine = Machine(FILE)
    texts = ["".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)} {chr(c)}{chr(c)}b" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 64)]
    assert machine.counts([t.encode() for t in texts]).tolist() == want(library, texts)


def test_small_chunks_and_a_full_table(library, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 3)
    monkeypatch.setattr(module, "TRANSITIONS", 50)
    machine = Machine(FILE)
    for _ in range(3):
        assert machine.counts([t.encode() for t in HARD]).tolist() == want(library, HARD)


@pytest.mark.parametrize("table", ["awkward", "prose", "empty"])
def test_rows(request, library, table):
    df = request.getfixturevalue(table)
    rows = df.collect()
    expected = sorted(((r["doc_id"], len((r["text"] or "").encode()), n) for r, n in zip(rows, want(library, [r["text"] or "" for r in rows]))), key=str)
    got = token_counts(df, tokenizer_path(TOKENIZER)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == expected
