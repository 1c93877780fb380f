import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from findara.llm.packing import END, TOKENIZER, WINDOW, combinations, nnls, pack, pack_documents, pieces, plan_windows, sequences, tokenizer_path, word_ids

FILE = public_tokenizers.path(TOKENIZER)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.random(8) * 10 - 2
        x = nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-5).all() and np.abs(gradient[x > 1e-9]).max(initial=0) < 1e-5


def test_combinations_fill_the_window():
    found = combinations(12)
    assert all(sum(c * m for c, m in p) == 12 and len(dict(p)) == len(p) for p in found) and len({tuple(sorted(p)) for p in found}) == len(found)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for n in (0, 1, 50, 3000):
        counts = {}
        for _ in range(n):
            c = min(64, max(1, int(rng.expovariate(1 / 20))))
            counts[c] = counts.get(c, 0) + 1
        plan = plan_windows(counts, 64)
        used = {}
        for p, times in plan:
            assert sum(c * m for c, m in p) <= 64 and times > 0
            for c, m in p:
                used[c] = used.get(c, 0) + m * times
        assert used == counts
        if n == 3000:
            assert sum(t for _, t in plan) * 64 < 1.01 * sum(c * k for c, k in counts.items())


def test_ids_are_the_library_s():
    tokenizer, encode, rng = Tokenizer.from_file(FILE), word_ids(FILE), random.Random(3)
    letters = "abWTsStreéÉİΣñ日1½'.,!?;:|<>~-̊̈  ͅ \t\n  ﬁKÅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(5000)]
    texts += ["", "a<|endoftext|>b c", "<|startoftext|>", "<|ENDOFTEXT|>.", "İ.", "ΑΣ.,", "don't. it's! 'S", "x<|endoftext|>, y"]
    ids, ends = encode(pa.array(texts))
    at = 0
    for t, end in zip(texts, ends):
        assert ids[at:end].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
        at = end


def check(df, rows):
    tokenizer = Tokenizer.from_file(FILE)
    of = {}
    for r in df.collect():
        of.setdefault(r["doc_id"], []).append(np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [END], "<u4"))
    seen, total = {}, {}
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in of[r["doc_id"]])
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: sum(map(len, x)) for i, x in of.items()}
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= WINDOW
    return len(seen)


def test_documents(awkward, empty, prose):
    check(awkward, pack_documents(awkward).collect())
    n = check(prose, pack_documents(prose).collect())
    words = sum(r["doc_tokens"] for r in pack_documents(prose).filter("start = 0").collect())
    assert n <= words / WINDOW * 1.05 + 2
    assert pack_documents(empty).count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(k % 7 + 1, k, k, k, k) for k in range(40)], "length int, rank int, offset int, _class int, sequence_id int")
    got = pack(rows, 16, grain=1)
    assert got.columns == [*rows.columns, "sequence_id_", "offset_"]
    seen = {}
    for r in got.collect():
        assert r["length"] == r["rank"] % 7 + 1
        seen.setdefault(r["sequence_id_"], []).append((r["offset_"], r["length"]))
    for parts in seen.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 16


def test_sequences_have_the_ids(prose):
    cut = pieces(prose, tokenizer_path(TOKENIZER), 256, END, ids=True)
    whole = sequences(pack(cut, 256)).collect()
    assert all(r["tokens"] == len(r["ids"]) <= 256 for r in whole)
    assert sum(r["tokens"] for r in whole) == sum(r["length"] for r in cut.collect())


def test_little_memory_and_long_texts_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") * rng.randrange(1, 9) + rng.choice(["", ".", "é", "x" * 90]) for _ in range(rng.randrange(400))) for _ in range(30)]
    want = word_ids(FILE)(pa.array(texts))
    encode = word_ids(FILE, memory=500)
    for _ in range(3):
        got = encode(pa.array(texts))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    from findara.llm import packing

    tokenizer = Tokenizer.from_file(FILE)
    monkeypatch.setattr(packing, "SLICE", 64)
    whole = pa.array([texts[0] + "\n" + texts[1]])
    ids = [i for part in packing._segments(whole[0]) for i in tokenizer.encode(part, add_special_tokens=False).ids]
    assert ids == tokenizer.encode(whole[0].as_py(), add_special_tokens=False).ids and len(list(packing._segments(whole[0]))) > 5
