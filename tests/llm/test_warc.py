import gzip
import hashlib
import io

import pytest

from findara.llm.common import new_path
from findara.llm.warc import CHUNK, Reader, Writer, read_chunks, write_archives

BIG = "z" * (3 * CHUNK + 17)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", BIG, "x"), (2, "http://a/2\nb", BIG, "x"), (3, None, None, "x"), (4, "http://a/4", "", "x"), (5, "u", "y" * 150, "x"), (5, "u", "y" * 150, "x"), (9, "u", "y" * 150, "x"), (6, "u", "ab", "x"), (7, "u", "ab", "x"), (None, "u", "é" * 99, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string")


def test_round_trip(spark, pages):
    folder = new_path(spark, "warc")
    manifest = write_archives(pages, folder)
    assert sum(r["records"] for r in manifest.collect()) == pages.count()
    chunks = read_chunks(manifest, folder).collect()
    bodies = {}
    for r in sorted(chunks, key=lambda r: (r["record_id"], r["chunk"])):
        bodies.setdefault(r["record_id"], []).append(r)
    whole = {k: b"".join(bytes(r["data"]) for r in rows) for k, rows in bodies.items() if k != "<urn:page:5>"}
    assert whole["<urn:page:1>"].decode() == BIG and [r["chunks_end"] for r in bodies["<urn:page:1>"]] == [False, False, False, True]
    assert whole["<urn:page:2>"] == b"" and bodies["<urn:page:2>"][0]["refers_to"] == "<urn:page:1>" and bodies["<urn:page:2>"][0]["payload_length"] == len(BIG)
    assert bodies["<urn:page:9>"][0]["record_type"] == "revisit" and [r["record_type"] for r in bodies["<urn:page:5>"]] == ["response"] * 2
    assert {bodies[f"<urn:page:{k}>"][0]["record_type"] for k in (3, 4, 6, 7)} == {"response"}
    last = read_chunks(manifest, folder, payload=False).collect()
    assert len(last) == pages.count() and all(r["chunks_end"] and r["data"] is None for r in last)
    assert {r["digest_so_far"] for r in last if r["record_id"] == "<urn:page:1>"} == {hashlib.sha256(BIG.encode()).hexdigest()}


def test_empty(spark, pages):
    folder = new_path(spark, "warc")
    assert read_chunks(write_archives(pages.limit(0), folder), folder).count() == 0


def test_archives_are_plain_warc(spark, pages):
    folder = new_path(spark, "warc")
    (file,) = [r["file"] for r in write_archives(pages.filter("page_id = 6").coalesce(1), folder).collect() if r["records"]]
    text = gzip.open(f"{folder.removeprefix('file://')}/{file}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"Content-Length: 2\r\n\r\nab\r\n\r\n")


def records(data):
    return [(f["warc-type"], b"".join(c)) for f, c in Reader(io.BytesIO(data)).records()]


def test_reader_on_plain_gzipped_and_cut_archives():
    out = io.BytesIO()
    for body in (b"", b"\r\nWARC/1.1\r\n\r\n", bytes(range(256)) * 1000):
        Writer(out).write([("WARC-Type", "response")], memoryview(body))
    packed = out.getvalue()
    want = [("response", b""), ("response", b"\r\nWARC/1.1\r\n\r\n"), ("response", bytes(range(256)) * 1000)]
    assert records(packed) == want == records(gzip.decompress(packed)) and records(b"") == []
    for cut in (gzip.decompress(packed)[:-5000], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            records(cut)


def test_damage_is_noticed(spark, pages):
    folder = new_path(spark, "warc")
    manifest = write_archives(pages.filter("page_id = 6").coalesce(1), folder)
    path = f"{folder.removeprefix('file://')}/{manifest.filter('records > 0').first()['file']}"
    text = gzip.open(path).read().replace(b"\r\n\r\nab", b"\r\n\r\nxy")
    with open(path, "wb") as f:
        f.write(gzip.compress(text))
    with pytest.raises(Exception, match="does not have its digest"):
        read_chunks(manifest, folder).collect()


def test_the_query_reads_every_chunk_row(spark, tmp_path, monkeypatch):
    from findara.llm import warc

    made = []
    monkeypatch.setattr(warc, "read_chunks", lambda *a, **k: made.append(read_chunks(*a, **k)) or made[-1])
    page = "x" * (3 * CHUNK + 5)
    spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [(r["payload_bytes"], r["record_type"]) for r in warc.op9_warc(spark, str(tmp_path)).collect()] == [(len(page), "response")]
    assert sorted((r["chunk"], len(r["data"])) for r in made[0].collect()) == [(0, CHUNK), (1, CHUNK), (2, CHUNK), (3, 5)]


def test_revisits_are_checked_against_what_was_read(spark):
    from findara.llm.warc import check_revisits

    rows = [("a", "response", None, "x", 5), ("b", "revisit", "a", "x", 5), ("c", "revisit", "a", "x", 5)]
    schema = "record_id string, record_type string, refers_to string, digest string, size long"
    check_revisits(spark.createDataFrame(rows, schema))
    for wrong in (("d", "revisit", "a", "y", 5), ("d", "revisit", "a", "x", 6), ("d", "revisit", "z", "x", 5)):
        with pytest.raises(ValueError, match="does not have the payload"):
            check_revisits(spark.createDataFrame([*rows, wrong], schema))
