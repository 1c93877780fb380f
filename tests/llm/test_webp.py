import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from findara.llm.media import WIDTH, filled, load, store, to_media
from findara.llm.webp import BLACK, CROSS_COLOUR, PALETTE, PREDICTOR, SUBTRACT_GREEN, decode, decode_grey, encode, encode_grey, grey_plan, lengths_for

rng = np.random.default_rng(4)


def noise(height, width, colours=None):
    a = rng.integers(0, 2**32, (height, width), dtype=np.uint32)
    return a if colours is None else rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, (height, width))]


RAMP = np.add.outer(np.arange(37) * 3, np.arange(53) * 2) % 256
RAMP = (BLACK | RAMP << 16 | RAMP * 2 % 256 << 8 | RAMP).astype(np.uint32)
CASES = {
    "noise": (noise(11, 7), {}),
    "one colour": (np.full((9, 9), 0xFF102030, np.uint32), {}),
    "cache": (noise(20, 20, 9), {"cache_bits": 4}),
    "references": (np.tile(noise(5, 8, 20), (6, 1)), {"cache_bits": 3}),
    "cross colour": (noise(19, 21), {"transforms": [(CROSS_COLOUR, 2, noise(5, 6))]}),
    "subtract green": (noise(8, 8), {"transforms": [(SUBTRACT_GREEN,)]}),
    "groups": (RAMP, {"cell_bits": 3, "groups": rng.integers(0, 4, (5, 7))}),
    "all": (RAMP, {"transforms": [(PREDICTOR, 2, BLACK | rng.integers(0, 14, 140) << 8), (CROSS_COLOUR, 3, noise(5, 7)), (SUBTRACT_GREEN,)], "cache_bits": 5}),
    "palette and predictor": (noise(30, 40, 5), {"transforms": [(PALETTE,), (PREDICTOR, 2, BLACK | rng.integers(0, 14, 40) << 8)]}),
} | {f"palette {n}": (noise(13, 29, n), {"transforms": [(PALETTE,)]}) for n in (1, 2, 3, 4, 10, 16, 17, 200)}
CASES |= {f"predictor {m}": (noise(9, 10), {"transforms": [(PREDICTOR, 2, np.full(9, BLACK | m << 8))]}) for m in range(16)}


@pytest.mark.parametrize("name", CASES)
def test_round_trip(name):
    image, options = CASES[name]
    (got,) = decode(encode(image, **options))
    assert (got == image).all()


def test_a_stream_by_hand():
    """A 2 x 1 image of literals under simple codes, bit by bit."""
    bits = [(0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    bits += [(1, 1), (1, 1), (1, 1), (10, 8), (200, 8)]  # green is 10 or 200
    bits += [(1, 1), (0, 1), (0, 1), (1, 1)]  # red is 1
    bits += [(1, 1), (0, 1), (1, 1), (77, 8)]  # blue is 77
    bits += [(1, 1), (0, 1), (1, 1), (255, 8), (1, 1), (0, 1), (0, 1), (0, 1)]
    bits += [(1, 1), (0, 1)]  # the second green, then the first
    value = at = 0
    for v, n in bits:
        value |= v << at
        at += n
    chunk = value.to_bytes((at + 7) // 8, "little")
    body = b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + b"\0" * (len(chunk) % 2)
    (got,) = decode(b"RIFF" + len(body).to_bytes(4, "little") + body)
    assert [hex(x) for x in got[0]] == ["0xff01c84d", "0xff010a4d"]


def test_broken_streams():
    file = encode(noise(20, 20))
    for bad in (b"junk" + file[4:], file[:60], file.replace(b"VP8L", b"VP8 ")):
        with pytest.raises(Exception):
            decode(bad)


def test_code_lengths():
    for counts in ([1], [1, 1], [2**k for k in range(30)], list(range(300))):
        size = lengths_for(np.array(counts), 9)
        used = size[size > 0]
        assert used.max() <= 9 and (len(used) == 1 or (0.5 ** used.astype(float)).sum() == 1)


def test_grey_frames_of_all_kinds():
    frames = [np.frombuffer(filled(t.encode()), np.uint8) for t in ("", "a", "hello world " * 300, "é" * 500)]
    long = "".join(chr(97 + int(k)) for k in rng.geometric(0.2, 60_000).clip(1, 26))
    frames += [np.frombuffer(filled(t.encode()), np.uint8) for t in (long, "ab" * 20_000, "x" * 30_000, long[:20_000] + "y" * 3000 + long[:9000])]
    frames += [rng.integers(0, 256, WIDTH * 40, dtype=np.uint8), np.cumsum(rng.integers(0, 3, WIDTH * 50)).astype(np.uint8), np.cumsum(rng.integers(0, 3, WIDTH * 3)).astype(np.uint8)]
    frames += [rng.integers(0, n, WIDTH * h, dtype=np.uint8) * 3 for n in (2, 3, 4, 5, 16, 17) for h in (2, 60)]
    frames += [np.full(WIDTH, 7, np.uint8), np.array([1, 2] * 288, np.uint8), np.arange(WIDTH).astype(np.uint8), rng.integers(0, 256, WIDTH * 5, dtype=np.uint8)]
    files = encode_grey(frames, WIDTH)
    assert all((a == b).all() for a, b in zip(frames, decode_grey(files)))
    for f, file in zip(frames, files):  # the whole decoder sees the same, as grey
        (image,) = decode(file)
        assert (image.ravel() == (0xFF000000 | f.astype(np.uint32) * 0x010101)).all()


def test_shortest_transform_is_taken():
    plans = {name: grey_plan(f, WIDTH)[0] for name, f in {
        "prose": np.frombuffer(filled(b"It was the best of times, it was the worst of times (1859)! " * 40), np.uint8),
        "few": np.frombuffer(filled(b"0110" * 500), np.uint8),
        "slope": np.cumsum(rng.integers(0, 3, WIDTH * 9)).astype(np.uint8),
    }.items()}
    assert plans == {"prose": None, "few": PALETTE, "slope": PREDICTOR}


@pytest.mark.parametrize("segment,block", [(64, 32), (1000, 512)])
def test_segments_and_blocks_do_not_show(monkeypatch, segment, block):
    monkeypatch.setattr("findara.llm.webp.SEGMENT", segment)
    monkeypatch.setattr("findara.llm.webp.BLOCK", block)
    monkeypatch.setattr("findara.llm.webp.LARGE", 1)
    monkeypatch.setattr("findara.llm.webp.TOGETHER", 700)
    frames = [np.frombuffer(filled(t), np.uint8) for t in (b"", b"abc", b"some words of a text, and more. " * 90)] + [rng.integers(0, 256, WIDTH * 4, dtype=np.uint8), rng.integers(0, 9, WIDTH * 4, dtype=np.uint8)]
    assert all((a == b).all() for a, b in zip(frames, decode_grey(encode_grey(frames, WIDTH))))


def test_foreign_streams_of_grey_images():
    """Back-references, a colour cache and other transforms within large grey images."""
    small = np.frombuffer(filled(b"the same words again and again; " * 700), np.uint8)
    image = (BLACK | small.astype(np.uint32) * 0x010101).reshape(-1, WIDTH)
    for options in ({"transforms": [(SUBTRACT_GREEN,)]}, {"cache_bits": 6}, {"transforms": [(PALETTE,)], "references": False}, {"transforms": [(SUBTRACT_GREEN,), (PALETTE,)], "cache_bits": 2}):
        assert (decode_grey([encode(image, **options)] * 2)[1] == small).all()


def test_one_file_a_payload():
    (stored,) = to_media([filled(b"a text of some length. " * 30_000)])
    assert len(stored) == 8 + int.from_bytes(stored[4:8], "little") and len(decode(stored)) == 1


def test_column(awkward, empty):
    texts = {str(r["doc_id"]): (r["text"] or "").encode() for r in awkward.collect()}
    rows = load(store(awkward, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        want = filled(texts[str(r["doc_id"])])
        assert bytes(r["pixels"]) == want and r["n_bytes"] == len(texts[str(r["doc_id"])]) and r["payload_bytes"] == len(want)
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-32:])
        assert r["media_sha256"] == hashlib.sha256(to_media([want])[0]).hexdigest()
    assert load(store(empty, F.encode("text", "UTF-8"))).count() == 0
