"""The best texts of each query under several weightings, straight from the texts.

Without a saved index and without a frame of all pairs: terms are 64-bit hashes of tokens and bigrams, their
frequencies and the texts' norms are worked out bucket by bucket, and every text meets every query as a matrix, of which
a task keeps what may be among the best.  That is a superset: exact scores and ranks are up to the caller.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findara.functions.scores import effective
from findara.functions.text import _MARKED, _PLAIN, WORD_CHARACTER
from findara.session import written

FACETS = ("topic", "domain", "method")
SIGNALS = ("semantic", "lexical", "topic", "domain", "method", "evidence")
#: Bytes of an Arrow batch; bytes of text a bucket of terms; code points looked at together; queries a run.
BATCH, BUCKET, SLICE, QUERIES = 2 << 20, 16 << 20, 1 << 19, 2000
#: Texts, and meetings of their terms with queries, that are scored together; pairs that wait to be ranked.
ROWS, MEETINGS, WAITING = 256, 1 << 19, 100_000
GONE = 0xFFFFFFFF

Batches = Iterator[pa.RecordBatch]


def lean(scan: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``scan``, after which the worker gives free memory back."""

    def run(batches: Batches) -> Batches:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def word_characters(spark: SparkSession) -> bytes:
    """Which code points the engine's patterns take for word characters, a bit each."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    runs = F.regexp_extract_all("c", F.lit(f"{WORD_CHARACTER}+"), F.lit(0))
    found = spark.createDataFrame([(every,)], "c string").select(F.array_join(runs, "").alias("c")).collect()[0]["c"]
    flags = np.zeros(0x110000, bool)
    flags[_codes(found)] = True
    return np.packbits(flags).tobytes()


def _flags(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def _folds() -> np.ndarray:
    """What folding makes of each code point of a lower-case text."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[_codes(_MARKED)] = GONE
    out[_codes(_MARKED[: len(_PLAIN)])] = _codes(_PLAIN)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _runs(codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of word characters, in parts that end between runs."""
    inside = word[codes]
    gaps = np.flatnonzero(~inside)
    parts, at = [], 0
    while at < len(codes):
        k = np.searchsorted(gaps, at + SLICE)
        end = int(gaps[k]) if k < len(gaps) else len(codes)
        here = inside[at:end]
        edges = np.flatnonzero(np.diff(here.view(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            n = ends - starts
            first = np.cumsum(n) - n
            x = codes[at:end][here].astype(np.uint64)
            x += (np.arange(1, len(x) + 1) - np.repeat(first, n)).astype(np.uint64) << np.uint64(21)
            parts.append((starts + at, ends + at, _mix(np.add.reduceat(_mix(x), first))))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, a line break after each, and where each text starts."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return _codes("\n".join(texts) + "\n"), np.cumsum(lengths) - lengths


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about ``SLICE`` characters, each with its first one's place."""
    first = size = 0
    for k, t in enumerate(texts, 1):
        size += len(t)
        if size >= SLICE or k == len(texts):
            yield first, texts[first:k]
            first, size = k, 0


def grams(codes: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, term, tf`` of tokens and bigrams, by text."""
    starts, ends, h = _runs(codes, word)
    long = ends - starts >= 2
    starts, h = starts[long], h[long]
    bounds = np.append(np.searchsorted(starts, at), len(h))
    n = np.diff(bounds)
    if not len(h):
        return np.zeros(0, np.int64), h, np.zeros(0, np.int64)
    both = np.zeros(2 * len(h), np.uint64)
    both[::2] = h
    both[1:-1:2] = _pair(h[:-1], h[1:])
    kept = np.ones(len(both), bool)
    kept[2 * bounds[1:][n > 0] - 1] = False  # a text's last token has no neighbour
    both = both[kept]
    n = np.maximum(2 * n - 1, 0)
    to = np.cumsum(n)
    for a, b in zip((to - n).tolist(), to.tolist(), strict=True):
        both[a:b].sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    new[(to - n)[n > 0]] = True
    first = np.flatnonzero(new)
    return np.repeat(np.arange(len(at)), n)[first], both[first], np.diff(np.append(first, len(both)))


def words(codes: np.ndarray, at: np.ndarray, word: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``text, term`` of the words of folded texts and of pairs with one blank between them, with repeats."""
    codes = folds[codes]
    kept = codes != GONE
    if not kept.all():
        at = at - np.searchsorted(np.flatnonzero(~kept), at)
        codes = codes[kept]
    starts, ends, h = _runs(codes, word)
    text = np.searchsorted(at, starts, "right") - 1
    near = np.flatnonzero((starts[1:] == ends[:-1] + 1) & (codes[ends[:-1]] == 32))
    return np.concatenate([text, text[near]]), np.concatenate([h, _pair(h[near], h[near + 1])])


class Known:
    """Places of hashes in a sorted array of different ones; most others are told by a table of 20 bits."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are known, and their places."""
        at = np.flatnonzero(self.seen[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[place] == h[at]
        return at[same], place[same]


def _rows(kind: list[str], *columns: list) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    named = [k.split() for k in kind]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes each as they take."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _facet_places(codes: np.ndarray, at: np.ndarray, word: np.ndarray, folds: np.ndarray, vocab: Known) -> tuple[np.ndarray, np.ndarray]:
    """``text, place`` of the vocabulary's terms that each text has, once each."""
    text, h = words(codes, at, word, folds)
    found, place = vocab(h)
    size = max(len(vocab.terms), 1)
    return np.divmod(np.unique(text[found] * size + place), size)


TAKEN = ["bucket int", "chunk long", "data binary"]


def taken_apart(packed: bytes, asked: np.ndarray, vocab: np.ndarray, buckets: int) -> Callable[[Batches], Batches]:
    """From (id, lower-case text) to each batch's terms by bucket, and in a bucket below 0 what of it is asked for."""

    def scan(batches: Batches) -> Batches:
        from pyspark import TaskContext

        word, folds, known, facets = _flags(packed), _folds(), Known(asked), Known(vocab)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk += 1
            parts = []
            for start, texts in _groups(batch.column(1).to_pylist()):
                codes, at = _joined(texts)
                text, term, tf = grams(codes, at, word)
                hit, place = known(term)
                of, facet = _facet_places(codes, at, word, folds, facets)
                parts.append((text + start, term, tf, text[hit] + start, place, tf[hit], of + start, facet))
            text, term, tf, *own = (np.concatenate(p) for p in zip(*parts, strict=True))
            del parts, codes
            own = (batch.column(0).to_numpy(), *map(_small, own))
            bucket = ((term >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, term, tf = bucket[order], term[order], tf[order]
            text = text[order].astype(np.uint16 if batch.num_rows <= 1 << 16 else np.uint32)
            used = np.unique(bucket)
            data = []
            for a, b in zip(np.searchsorted(bucket, used), np.searchsorted(bucket, used, "right"), strict=True):
                more = np.flatnonzero(tf[a:b] > 1)
                data.append(pickle.dumps((term[a:b], text[a:b], more.astype(np.uint32), tf[a:b][more].astype(np.uint32))))
            yield _rows(TAKEN, [-1 - chunk % buckets], [chunk], [pickle.dumps(own)])
            del text, term, tf, order, bucket
            for k in range(0, len(used), 16):
                yield _rows(TAKEN, used[k : k + 16].astype(np.int32), [chunk] * len(used[k : k + 16]), data[k : k + 16])

    return lean(scan)


WEIGHED = ["chunk long", "kind int", "data binary"]
OWN, NORMS, FREQUENCIES = 0, 1, 2


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def weighed(n: int, asked: np.ndarray) -> Callable[[Batches], Batches]:
    """From the rows of whole buckets, by bucket, to shares of the texts' squared norms and frequencies of asked terms."""

    def solved(held: list) -> Batches:
        if not held:
            return
        term = np.concatenate([h[1] for h in held])
        order = np.argsort(term)
        term = term[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(first, len(term)))
        term = term[first]
        weight = np.empty(len(order))
        weight[order] = np.repeat(idf(n, df), df)
        place = np.minimum(np.searchsorted(term, asked), len(term) - 1)
        found = np.flatnonzero(term[place] == asked)
        del order, term, first
        yield _rows(WEIGHED, [-1], [FREQUENCIES], [pickle.dumps((found, df[place[found]]))])
        a = 0
        for chunk, _, text, more, tf in held:
            raw = weight[a : a + len(text)]
            a += len(text)
            raw[more] *= 1 + np.log(tf)
            sums = np.bincount(text, raw * raw)
            some = np.flatnonzero(sums)
            yield _rows(WEIGHED, [chunk], [NORMS], [pickle.dumps((some.astype(np.uint32), sums[some]))])

    def scan(batches: Batches) -> Batches:
        held, now = [], None
        for batch in batches:
            for bucket, chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket < 0:
                    yield _rows(WEIGHED, [chunk], [OWN], [data])
                    continue
                if bucket != now:
                    yield from solved(held)
                    held, now = [], bucket
                held.append((chunk, *pickle.loads(data)))
        yield from solved(held)

    return lean(scan)


TEXTS = ["id long", "terms binary", "weights binary", "facets binary"]


def unit(idfs: np.ndarray) -> Callable[[Batches], Batches]:
    """From the rows of whole batches, by batch and kind, to each text's asked terms with weights, and its facets."""

    def told(own: tuple, norms: np.ndarray) -> Batches:
        ids, text, place, tf, of, facet = own
        w = (1 + np.log(tf.astype(np.float64))) * idfs[place] / np.sqrt(norms[text])
        place, facet = place.astype(np.uint32), facet.astype(np.uint32)
        t, f = (np.searchsorted(x, np.arange(len(ids) + 1)).tolist() for x in (text, of))
        for k in range(0, len(ids), 1024):
            rows = range(k, min(k + 1024, len(ids)))
            yield _rows(TEXTS, ids[k : k + 1024], [place[t[i] : t[i + 1]].tobytes() for i in rows], [w[t[i] : t[i + 1]].tobytes() for i in rows], [facet[f[i] : f[i + 1]].tobytes() for i in rows])

    def scan(batches: Batches) -> Batches:
        own = norms = None
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == OWN:
                    if own is not None:
                        yield from told(own, norms)
                    own = pickle.loads(data)
                    norms = np.zeros(len(own[0]))
                else:
                    some, sums = pickle.loads(data)
                    norms[some] += sums
        if own is not None:
            yield from told(own, norms)

    return lean(scan)


def _lists(at: np.ndarray, size: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values by place: where each place's start, and the values in that order."""
    order = np.argsort(at, kind="stable")
    return np.searchsorted(at[order], np.arange(size + 1)), *(v[order] for v in values)


def _meetings(place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry and each value of its place: which entry, which value."""
    n = starts[place + 1] - starts[place]
    entry = np.repeat(np.arange(len(place)), n)
    return entry, np.arange(len(entry)) + np.repeat(starts[place] - (np.cumsum(n) - n), n)


FOUND = ["query long", "id long", "variant int", *(f"{s} double" for s in SIGNALS)]


def best(queries: np.ndarray, vectors: np.ndarray, lexical: tuple, facets: tuple, kinds: np.ndarray, variants: list[dict[str, float]], most: int, least: int) -> Callable[[Batches], Batches]:
    """From texts (id, terms, weights, facets, evidence, vector) to what may be among the best of a query and variant.

    ``lexical``: starts, query, weight by term; ``facets``: starts, query by term; ``kinds``: term x facet.  Pairs that
    share at least ``least`` topics come besides, as variant -1.  Scores count as rounded to 6 digits: where that is
    close, a pair has a lower and an upper score, is kept by the upper and drives others out by the lower.
    """
    q = len(queries)
    weights = [[float(w) for w in effective(v, True).values()] for v in variants]
    asked_sizes = [np.bincount(facets[1], np.repeat(kinds[:, f], np.diff(facets[0])), q) for f in range(3)]
    asked_norm = np.sqrt((vectors * vectors).sum(1))

    def signals(ids, terms, weight, facet, evidence, has, vector):  # noqa: ANN001, ANN202 (a slice of texts)
        m = len(ids)
        entry, at = _meetings(terms[1], lexical[0])
        out = {"lexical": np.bincount(terms[0][entry] * q + lexical[1][at], weight[entry] * lexical[2][at], m * q).reshape(m, q)}
        entry, at = _meetings(facet[1], facets[0])
        pair = facet[0][entry] * q + facets[1][at]
        topics = None
        for f, name in enumerate(FACETS):
            shared = np.bincount(pair, kinds[facet[1], f][entry], m * q).reshape(m, q)
            union = np.bincount(facet[0], kinds[facet[1], f], m)[:, None] + asked_sizes[f] - shared
            out[name] = np.divide(shared, union, out=np.zeros((m, q)), where=union > 0)
            topics = shared if f == 0 else topics
        semantic = np.zeros((m, q))
        if has.any() and vectors.shape[1]:
            size = np.sqrt((vector * vector).sum(1))[:, None] * asked_norm
            semantic[has] = np.divide(vector @ vectors.T, size, out=np.zeros(size.shape), where=size > 1e-12)
        out |= {"semantic": semantic, "evidence": np.broadcast_to(evidence[:, None], (m, q))}
        return [out[s] for s in SIGNALS], topics

    def slices(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, evidence = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        entries = []
        for c, kind in ((1, np.uint32), (2, np.float64), (3, np.uint32)):
            values = batch.column(c).to_pylist()
            entries.append((np.cumsum([0, *(len(v) // np.dtype(kind).itemsize for v in values)]), np.frombuffer(b"".join(values), kind)))
        (t, terms), (_, weight), (f, facet) = entries
        terms, facet = terms.astype(np.int64), facet.astype(np.int64)
        has = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
        vector = batch.column(5).drop_null().flatten().to_numpy().astype(np.float64).reshape(has.sum(), -1) if has.any() else np.zeros((0, 0))
        before = np.cumsum([0, *has])
        cost = np.cumsum([0, *np.diff(lexical[0])[terms]])[t]
        a = 0
        while a < len(ids):
            b = max(a + 1, min(a + ROWS, len(ids), int(np.searchsorted(cost, cost[a] + MEETINGS, "right")) - 1))
            rows = lambda x: np.repeat(np.arange(b - a), np.diff(x[a : b + 1]))  # noqa: B023, E731 (used at once)
            yield (ids[a:b], (rows(t), terms[t[a] : t[b]]), weight[t[a] : t[b]], (rows(f), facet[f[a] : f[b]]), evidence[a:b], has[a:b], vector[before[a] : before[b]])
            a = b

    def scan(batches: Batches) -> Batches:
        groups = len(variants) * q
        low, low_id = np.full(groups, np.iinfo(np.int64).min), np.full(groups, np.iinfo(np.int64).max)
        state, pending, waiting = None, [], 0

        def merged():  # noqa: ANN202
            nonlocal state, pending, waiting
            g, lo, hi, i, v = (np.concatenate(p) for p in zip(*([state] if state else []), *pending, strict=True))
            order = np.lexsort((i, -lo, g))
            sorted_g = g[order]
            last = np.searchsorted(sorted_g, np.arange(groups)) + most - 1
            full = np.flatnonzero(last < len(g))
            full = full[sorted_g[last[full]] == full]
            at = order[last[full]]
            low[full], low_id[full] = lo[at], i[at]
            kept = (hi > low[g]) | ((hi == low[g]) & (i <= low_id[g]))
            state, pending, waiting = (g[kept], lo[kept], hi[kept], i[kept], v[kept]), [], 0

        for batch in batches:
            for part in slices(batch):
                values, topics = signals(*part)
                d, k = np.nonzero(topics >= least)
                if len(d):
                    yield _rows(FOUND, queries[k], part[0][d], np.full(len(d), -1), *[np.zeros(len(d))] * len(SIGNALS))
                lone = (values[2] == 0) & (values[4] > 0)
                for v, w in enumerate(weights):
                    raw = np.zeros(lone.shape)
                    for x, s in zip(w, values, strict=True):
                        if x:
                            raw += x * s
                    raw[lone] *= 0.5
                    raw *= 1e6
                    raw += 0.5
                    g = slice(v * q, (v + 1) * q)
                    hi = np.floor(raw + 1e-4).astype(np.int64)
                    d, k = np.nonzero((hi > low[g]) | ((hi == low[g]) & (part[0][:, None] <= low_id[g])))
                    if len(d):
                        pending.append((k + v * q, np.floor(raw[d, k] - 1e-4).astype(np.int64), hi[d, k], part[0][d], np.stack([s[d, k] for s in values], 1)))
                        waiting += len(d)
                if waiting > WAITING:
                    merged()
        if pending:
            merged()
        if state:
            g, _, _, i, v = state
            for k in range(0, len(g), 10_000):
                own = slice(k, k + 10_000)
                yield _rows(FOUND, queries[g[own] % q], i[own], (g[own] // q).astype(np.int32), *v[own].T)

    return lean(scan)


def plain(texts: DataFrame, items: DataFrame, vectors: DataFrame, vocab: DataFrame) -> tuple[int, int] | None:
    """The number of texts and their bytes if identifiers are different numbers, vectors finite and of one length, and
    the vocabulary words or pairs of words; otherwise None, as :func:`candidates` is not for those.

    ``texts``: id, size (bytes); ``items``: query, ...; ``vectors``: id, vector; ``vocab``: facet, term.
    """
    if any(df.schema[k].dataType.simpleString() != "bigint" for df, k in ((texts, "id"), (items, "query"), (vectors, "id"))):
        return None
    odd = ~F.col("facet").isin(*FACETS) | ~F.regexp_like("term", F.lit(f"^{WORD_CHARACTER}+( {WORD_CHARACTER}+)?$"))
    if vocab.filter(odd).head(1):
        return None
    x = F.col("vector")
    bad = x.isNull() | F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) > 1e100))
    shape = vectors.agg(F.max(F.size(x)).alias("most"), F.min(F.size(x)).alias("least"), F.max(bad).alias("bad")).first()
    if shape["bad"] or shape["most"] != shape["least"]:
        return None
    ids = lambda df, k, size: df.groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).agg(F.max("n").alias("n"), F.max(F.col("k").isNull()).alias("none"), F.count("*").alias("rows"), F.sum("size").alias("size")).first()
    for df, k in ((items, "query"), (vectors, "id"), (texts, "id")):
        r = ids(df, k, F.col("size") if df is texts else F.lit(0))
        if r["none"] or r["n"] != 1:  # no rows at all: null
            return None
    return r["rows"], r["size"]


def candidates(texts: DataFrame, corpus: DataFrame, items: DataFrame, vocab: DataFrame, variants: list[dict[str, float]], most: int, least: int, size: tuple[int, int]) -> DataFrame:
    """``query, id, variant, semantic, lexical, topic, domain, method, evidence``, written: of each query and variant at
    least its best ``most`` texts (score rounded to 6 digits, then id), and as variant -1 all pairs that share ``least``
    topics.

    ``texts``: id, text; ``corpus``: id, evidence, vector (or null); ``items``: query, text, vector (or null), gathered;
    ``size`` from :func:`plain`.
    """
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    lower = lambda df, key: df.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    packed = word_characters(spark)
    word, folds = _flags(packed), _folds()
    hashed = lambda strings: words(*_joined(strings), word, folds)[1]
    terms = {}
    for r in vocab.collect():  # of the queries' texts
        terms.setdefault(r["term"], []).append(FACETS.index(r["facet"]))
    last = np.array([hashed([t])[-1] for t in terms], np.uint64)  # a pair comes after its words
    order = np.argsort(last)
    kinds = np.zeros((len(terms), len(FACETS)))
    for k, own in enumerate(terms.values()):
        kinds[k, own] = 1.0
    vocabulary, kinds = Known(last[order]), kinds[order]
    rows = lower(items, "query").join(items.select("query", "vector"), "query").orderBy("query").collect()
    codes, at = _joined([r["text"] for r in rows])
    text, term, tf = grams(codes, at, word)
    asked = np.unique(term)
    place = np.searchsorted(asked, term)
    facet_text, facet = _facet_places(codes, at, word, folds, vocabulary)

    n, total = size
    buckets = max(1, -(-total // BUCKET))
    schema = ", ".join
    apart = lower(texts, "id").mapInArrow(taken_apart(packed, asked, vocabulary.terms, buckets), schema(TAKEN))
    apart = apart.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    table = written(apart.mapInArrow(weighed(n, asked), schema(WEIGHED)), "norms")
    df = np.zeros(len(asked))
    for r in table.filter(F.col("kind") == FREQUENCIES).select("data").collect():  # of asked terms
        found, counts = pickle.loads(r["data"])
        df[found] = counts
    idfs = idf(n, df)
    by_text = table.filter(F.col("kind") != FREQUENCIES).repartition("chunk").sortWithinPartitions("chunk", "kind")
    scored = by_text.mapInArrow(unit(idfs), schema(TEXTS)).join(corpus.select("id", "evidence", F.col("vector").cast("array<double>").alias("vector")), "id")

    raw = np.where(df[place] > 0, (1 + np.log(tf)) * idfs[place], 0.0)
    q = raw / np.sqrt(np.maximum(np.bincount(text, raw * raw, len(rows)), 1e-300))[text]
    known = df[place] > 0
    long = max((len(r["vector"]) for r in rows if r["vector"] is not None), default=0)
    vectors = np.array([r["vector"] if r["vector"] is not None else [0.0] * long for r in rows], np.float64).reshape(len(rows), long)
    ids = np.array([r["query"] for r in rows], np.int64)
    out = None
    for a in range(0, len(rows), QUERIES):
        b = min(a + QUERIES, len(rows))
        mine, of = known & (text >= a) & (text < b), (facet_text >= a) & (facet_text < b)
        lexical = _lists(place[mine], len(asked), text[mine] - a, q[mine])
        facets = _lists(facet[of], len(vocabulary.terms), facet_text[of] - a)
        found = scored.mapInArrow(best(ids[a:b], vectors[a:b], lexical, facets, kinds, variants, most, least), schema(FOUND))
        out = found if out is None else out.unionByName(found)
    return written(out, "candidates")
