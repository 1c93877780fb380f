"""Language identification by nearest centroid.

A text is the vector of its letter n-grams (one to three letters, word ends included), hashed to a fixed number of
dimensions, weighted by TF-IDF and normalised.  Document frequencies come from all learnable rows; each language's
centroids from spherical k-means over a bounded sample of them.  A text gets the language of the centroid nearest by
cosine, and is rejected if it is much farther from it than three quarters of the sampled texts of that language and length are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_small_batches, lean
from .packing import slices

#: What a text without letters, or a null one, is predicted as.
UNKNOWN = "und"
#: Dimensions, and odd multipliers that hash the letters of an n-gram into them.
DIMENSIONS = 1 << 12
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
#: Texts that are vectors at a time, and bytes of them; a longer text is counted in parts of as many characters.
ROWS, SLICE = 128, 1 << 19


def _letters() -> np.ndarray:
    """Each code point's own number if it is a letter, else 0."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


_table: np.ndarray | None = None


def _codes(text: str) -> np.ndarray:
    """Each character's number if it is a letter, else 0, in lower case; no character's case depends on others."""
    global _table
    if _table is None:
        _table = _letters()
    return _table[np.frombuffer(text.replace("\u03a3", "\u03c3").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def _add(out: np.ndarray, code: np.ndarray, row: np.ndarray) -> None:
    """Count the n-grams that end at the third code or later; ``row``: the first of out's places for each of these.

    An n-gram is one letter; two characters of which one is a letter; three of which the middle one is.
    """
    letter = code != 0
    mixed = [code * m for m in _MIX]
    shift = np.uint32(32 - 12)
    for hashed, keep in (
        ((mixed[0][2:] + np.uint32(1)) * _MIX[1], letter[2:]),
        ((mixed[0][1:-1] + mixed[1][2:] + np.uint32(2)) * _MIX[2], letter[1:-1] | letter[2:]),
        ((mixed[0][:-2] + mixed[1][1:-1] + mixed[2][2:] + np.uint32(3)) * _MIX[0], letter[1:-1]),
    ):
        out += np.bincount(row[keep] + (hashed[keep] >> shift), minlength=len(out))


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x dimensions) and whether each text has a letter.

    Texts have a 0 after them, and before the first, so that n-grams do not reach into the next one.
    """
    out = np.zeros((len(texts), DIMENSIONS), np.int64)
    has = np.zeros(len(texts), bool)
    short = [k for k, t in enumerate(texts) if len(t) <= SLICE]
    if short:
        parts = [_codes(texts[k]) for k in short]  # a character can become two
        sizes = np.array([len(p) + 1 for p in parts])
        code = np.zeros(2 + sizes.sum(), np.uint32)
        for p, end in zip(parts, np.cumsum(sizes) + 1):
            code[end - len(p) : end] = p
        counts = np.zeros(len(short) * DIMENSIONS, np.int64)
        _add(counts, code, np.repeat(np.arange(len(short), dtype=np.int64) * DIMENSIONS, sizes))
        out[short], has[short] = counts.reshape(-1, DIMENSIONS), [p.any() for p in parts]
    for k in set(range(len(texts))) - set(short):
        carried = np.zeros(2, np.uint32)
        for at in range(0, len(texts[k]) + 1, SLICE):  # the last part may be the 0 alone
            part = _codes(texts[k][at : at + SLICE])
            ends = at + SLICE > len(texts[k])
            code = np.concatenate([carried, part, np.zeros(int(ends), np.uint32)])
            if len(code) > 2:
                _add(out[k], code, np.zeros(len(code) - 2, np.int64))
            has[k] |= part.any()
            carried = code[-2:]
    return out, has


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    tf = np.zeros(counts.shape, np.float32)
    np.log(counts, out=tf, where=counts > 0)
    tf += counts > 0
    return unit_rows(tf * idf)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """At most k unit centroids of unit rows; starts from rows far from each other, so it is deterministic."""
    mean = unit_rows(x.mean(axis=0, keepdims=True))
    chosen = [int((x @ mean[0]).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centre = x[chosen]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        centre = unit_rows(np.stack([x[near == j].mean(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))]))
    return centre


def length_class(n: np.ndarray) -> np.ndarray:
    """Texts are held to others with about as many n-grams: classes by powers of four."""
    return np.minimum(np.log2(np.maximum(n, 1)) // 2, 7).astype(int)


@dataclass
class Model:
    """``floor``: the smallest cosine, by language and length class, at which a text is not rejected."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to the nearest centroid (0 to 1) and whether the text is rejected."""
        counts, has = ngram_counts([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0).astype(float)
        language = self.owner[best]
        low = score < self.floor[language, length_class(counts.sum(axis=1))]
        names = [self.languages[i] if h else UNKNOWN for i, h in zip(language, has)]
        return names, score, low | ~has


def _vectors(df: DataFrame, text_col: str, lang: Column) -> DataFrame:
    """``lang, dims, counts`` for each row: the n-gram counts that are not zero."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text", SLICE, ROWS):
                counts, _ = ngram_counts(b["_text"].to_pylist())
                there = [np.flatnonzero(c) for c in counts]
                dims = pa.array([d.astype("<u2").tobytes() for d in there], pa.binary())
                values = pa.array([c[d].astype("<u4").tobytes() for c, d in zip(counts, there)], pa.binary())
                yield pa.RecordBatch.from_arrays([b["lang"], dims, values], ["lang", "dims", "counts"])

    return in_small_batches(df).select(lang.alias("lang"), F.col(text_col).alias("_text")).mapInArrow(lean(scan), "lang string, dims binary, counts binary")


def _document_frequencies(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for whole in batches:
            for b in slices(whole, "_text", SLICE, ROWS):
                counts, _ = ngram_counts(b["_text"].to_pylist())
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMENSIONS)), pa.array([n, *total.tolist()])], ["dim", "n"])

    found = in_small_batches(df).select(F.col(text_col).alias("_text")).mapInArrow(lean(scan), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS, np.int64)
    rows = 0
    for r in found:  # one row a dimension
        if r["dim"] < 0:
            rows = r["n"]
        else:
            out[r["dim"]] = r["n"]
    return out, rows


def class_quantiles(best: np.ndarray, kind: np.ndarray, quantile: float) -> np.ndarray:
    """A quantile of the cosines of each length class; one with too few texts takes the nearest shorter one's, or 0."""
    out = np.zeros(8)
    for j in range(8):
        if (kind == j).sum() >= 20:
            out[j] = np.quantile(best[kind == j], quantile)
        elif j:
            out[j] = out[j - 1]
    return out


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", centroids: int = 3, sample: int = 600, quantile: float = 0.25, slack: float = 0.6) -> Model:
    """Fit on rows with a text and a language; languages are few, as the model has some vectors for each.

    Document frequencies cover all rows.  The centroids are fitted to about ``sample`` different rows of each
    language, chosen by a hash of identifier and text; that bound does not grow with the table, whatever the
    identifiers are: null, repeated, or all the same.  The rejection floor of a language and length class is
    ``slack`` times the ``quantile`` of its sampled cosines: a quartile, which outliers in the sample cannot set.
    Empty texts count as texts without letters.  An empty table gives a model that rejects everything.
    """
    digest = F.xxhash64(F.lit(10), F.col(id_col).cast("string"), text_col)
    rows = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), digest.alias("_digest"))
    per = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.approx_count_distinct("_digest", 0.02).alias("n")).collect()}  # one row a language
    if not per:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int))
    frequency, n = _document_frequencies(rows, "_text")
    idf = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    languages = sorted(per)
    # A hash below this, of 2^20, is in the sample.
    shares = df.sparkSession.createDataFrame([(x, math.ceil(min(1.0, sample / max(1, per[x])) * (1 << 20))) for x in languages], "_of string, _share long")
    chosen = rows.join(F.broadcast(shares), (F.col("_lang") == F.col("_of")) & (F.pmod("_digest", F.lit(1 << 20)) < F.col("_share")))
    chosen = chosen.dropDuplicates(["_lang", "_digest"])
    got = sorted(_vectors(chosen, "_text", F.col("_lang")).collect(), key=lambda r: (r["lang"], bytes(r["dims"]), bytes(r["counts"])))
    centre, owner, floor = [], [], np.zeros((len(languages), 8))
    for k, lang in enumerate(languages):
        mine = [r for r in got if r["lang"] == lang]
        if not mine:
            continue
        counts = np.zeros((len(mine), DIMENSIONS), np.int64)
        for i, r in enumerate(mine):
            counts[i, np.frombuffer(r["dims"], "<u2")] = np.frombuffer(r["counts"], "<u4")
        x = weighted(counts, idf)
        c = spherical_kmeans(x, centroids)
        centre.append(c)
        owner += [k] * len(c)
        best, kind = (x @ c.T).max(axis=1), length_class(counts.sum(axis=1))
        floor[k] = slack * class_quantiles(best, kind, quantile)
    return Model(languages, idf, np.concatenate(centre), np.array(owner, int), floor)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``_row`` (the row as a struct), ``lang_pred, score, rejected``; nothing is moved.

    A text that is null, empty or has no letter is ``und`` with score 0 and rejected.  Only the text is looked at, whole,
    a long one in parts; rows that repeat are judged alike.  An empty table gives an empty result.  The row being a
    struct, its names cannot clash with ours.
    """
    given = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pa.RecordBatch.from_arrays([pc.struct_field(whole["_row"], text_col), whole["_row"]], ["_text", "_row"])
            for b in slices(texts, "_text", SLICE, ROWS):
                names, score, rejected = given.value.predict(b["_text"].to_pylist())
                yield pa.RecordBatch.from_arrays([b["_row"], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["_row", "lang_pred", "score", "rejected"])

    rows = in_small_batches(df).select(F.struct(*df.columns).alias("_row"))
    schema = T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(lean(scan), schema)


def held_out(id_col: Column) -> Column:
    """A third of the rows, by identifier, that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three centroids a language from about 600 texts each; document frequencies from all learnable texts."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    doc_id = F.col("_row.doc_id")
    return found.select(doc_id, held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected")
