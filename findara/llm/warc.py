"""WARC archives as a chunked record table.

Writing: a record for each page, of equal payloads the first a response and the others revisits, as files of gzip
members in the shared folder.  A file has a name of its own for every attempt of its task, and a written manifest
names the files that count, so a task that is run again leaves no record twice.

Reading: archives are streamed.  A record comes out as rows of its identifier and a chunk number, each with a part
of the payload and the digest up to there, so no task ever holds an oversized record.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, lean, new_path, spread_join, written

#: Payload bytes of a chunk, and the shortest payload that others revisit.
CHUNK, REVISIT_FROM = 1 << 16, 100
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


class Writer:
    """Records to a stream, each a gzip member, each payload in chunks."""

    def __init__(self, out: BinaryIO) -> None:
        self.out = out

    def write(self, fields: list[tuple[str, str]], payload: memoryview) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.out.write(pack.compress(header(fields, len(payload))))
        for at in range(0, len(payload), CHUNK):
            self.out.write(pack.compress(payload[at : at + CHUNK]))
        self.out.write(pack.compress(b"\r\n\r\n") + pack.flush())


class Reader:
    """Records from a stream of plain or gzipped WARC, a chunk at a time."""

    def __init__(self, source: BinaryIO) -> None:
        self.source = source
        self.raw = source.read(CHUNK)
        self.gzipped = self.raw[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.gzipped else None
        self.ready = bytearray()

    def _more(self) -> bool:
        """At most about a chunk more of plain bytes."""
        while True:
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    return False
            if not self.gzipped:
                self.ready += self.raw
                self.raw = b""
                return True
            if self.unpack.eof:  # the next member
                self.unpack = zlib.decompressobj(31)
            plain = self.unpack.decompress(self.raw, CHUNK)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if plain:
                self.ready += plain
                return True

    def _line(self) -> bytes | None:
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                return None
        line = bytes(self.ready[:at])
        del self.ready[: at + 2]
        return line

    def records(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        """Lower-case headers and the payload's chunks; the chunks of a record are used before the next record."""
        while True:
            line = self._line()
            while line == b"":  # between records
                line = self._line()
            if line is None:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            fields: dict[str, str] = {}
            while line := self._line():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            if line is None:
                raise ValueError("the archive ends within a record's header")
            yield fields, self._payload(int(fields["content-length"]))

    def _payload(self, length: int) -> Iterator[bytes]:
        while length:
            while len(self.ready) < min(length, CHUNK):
                if not self._more():
                    raise ValueError("the archive ends within a payload")
            part = bytes(self.ready[: min(length, CHUNK)])
            del self.ready[: len(part)]
            length -= len(part)
            yield part


def first_of_copies(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _url, _text, _size, _sha, _first``: the smallest identifier with the same payload."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = in_small_batches(pages).select(F.col(id_col).alias("_id"), url.alias("_url"), text.alias("_text"), F.octet_length(text).cast("long").alias("_size"), F.sha2(F.encode(text, "UTF-8"), 256).alias("_sha"))
    copies = rows.filter(F.col("_size") >= REVISIT_FROM).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    copies = copies.filter("_n > 1").select(F.col("_sha").alias("_of"), "_first")  # payloads without copies need no join partner
    return spread_join(rows, copies, "_sha", "_of", "_id", "left").drop("_of")  # copies of one page go to several archives


def _write_files(folder: str, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        n = 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            writer = Writer(out)
            for b in batches:
                for k in range(b.num_rows):
                    page, url, size, sha, first, html = (b[c][k].as_py() for c in ("_id", "_url", "_size", "_sha", "_first", "_body"))
                    revisit = html is None
                    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date)]
                    fields += [("WARC-Target-URI", clean(url))] if url is not None else []
                    fields += [("WARC-Payload-Digest", f"sha256:{sha}"), ("X-Payload-Length", str(size))]
                    fields += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", REVISIT_PROFILE)] if revisit else []
                    writer.write(fields, memoryview(b"" if revisit else html))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return scan


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", text_col: str = "html", date: datetime.datetime | None = None) -> DataFrame:
    """Write a record for each row and give the manifest ``file, records``.

    Null payloads are empty; equal payloads of at least 100 bytes are stored once, under the smallest identifier,
    null identifiers being the smallest only where there is no other.  Rows that repeat with identifier and
    payload are that response again.  Line breaks in addresses are escaped.  Long payloads are written in chunks, though
    a page is one value of its row.  An empty table gives an empty manifest.  Columns beside identifier, payload and
    ``url`` are not read, so their names may clash with ours.  ``folder`` is an address that every executor reaches,
    such as one below ``spark.checkpoint.dir``.
    """
    rows = first_of_copies(pages, id_col, text_col)
    revisit = F.coalesce(F.col("_first") != F.col("_id"), F.col("_first").isNotNull())
    body = F.when(~revisit, F.encode("_text", "UTF-8"))
    stamp = (date or datetime.datetime(2000, 1, 1)).strftime("%Y-%m-%dT%H:%M:%SZ")
    made = rows.select("_id", "_url", "_size", "_sha", "_first", body.alias("_body"))
    return written(made.mapInArrow(lean(_write_files(folder, stamp)), "file string, records long"), "manifest")


def _read_files(folder: str, payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["file", "record_id", "chunk", "chunks_end", "size_so_far", "digest_so_far", "record_type", "refers_to", "payload_digest", "payload_length", "data"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

        for b in batches:
            for file in b["file"].to_pylist():
                with store.open_input_stream(f"{base}/{file}", compression=None) as source:
                    for fields, chunks in Reader(source).records():
                        digest, size, k = hashlib.sha256(), 0, 0
                        length = int(fields["content-length"])
                        stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        about = (fields["warc-type"], fields.get("warc-refers-to"), stated, int(fields.get("x-payload-length", length)))
                        for data in chunks if length else [b""]:
                            digest.update(data)
                            size += len(data)
                            if payload or size == length:
                                rows.append((file, fields["warc-record-id"], k, size == length, size, digest.hexdigest(), *about, data if payload else None))
                                held += len(data) * payload + 500
                            k += 1
                            if held > 4 << 20:
                                yield flush()
                                rows, held = [], 0
                        if about[0] == "response" and stated and stated != digest.hexdigest():
                            raise ValueError(f"{file}: the payload of {fields['warc-record-id']} does not have its digest")
        if rows:
            yield flush()

    return scan


CHUNKS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("chunks_end", T.BooleanType()),
        T.StructField("size_so_far", T.LongType()),
        T.StructField("digest_so_far", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def read_chunks(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The chunk table of the manifest's files: ``record_id, chunk, data`` with the size and SHA-256 up to there.

    ``chunks_end`` marks a record's last chunk, whose digest is the payload's; without ``payload`` only that row
    comes out, without data.  A payload that does not have its stated digest is an error.
    """
    files = manifest.select("file").repartition(max(1, manifest.count()))  # a file a task
    return files.mapInArrow(lean(_read_files(folder, payload)), CHUNKS)


def check_revisits(records: DataFrame) -> None:
    """An error if a revisit's digest or length is not what was read of the response that it refers to.

    ``records``: record_id, record_type, refers_to, digest, size.  Revisits are counted by response first, so a page
    with many copies is one row here.
    """
    told = records.filter("record_type = 'revisit'").groupBy("refers_to", "digest", "size").agg(F.count("*").alias("n")).alias("t")
    read = records.filter("record_type = 'response'").alias("r")
    same = (F.col("t.refers_to") == F.col("r.record_id")) & (F.col("t.digest") == F.col("r.digest")) & (F.col("t.size") == F.col("r.size"))
    wrong = told.join(read, same, "left_anti").head(1)
    if wrong:
        raise ValueError(f"{wrong[0]['refers_to']} does not have the payload that revisits say")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    folder = new_path(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    chunks = read_chunks(manifest, folder)
    revisit = F.col("record_type") == "revisit"
    read = chunks.filter("chunks_end").select(  # whose running digest and size are the payload's
        "record_id",
        "record_type",
        "refers_to",
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest_so_far")).alias("digest"),
        F.when(revisit, F.col("payload_length")).otherwise(F.col("size_so_far")).alias("size"),
    )
    records = written(read, "records")
    check_revisits(records)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.when(revisit, number(F.col("refers_to"))).alias("refers_to"),
    )


SQL = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN strlen(html) >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(html) >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM f""",
}
