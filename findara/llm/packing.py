"""Packing into fixed windows by non-negative least squares.

A document's ids are cut into whole windows and one rest.  Rests are counted by length class (a class is rounded
up to ``grain`` ids).  Shallow combinations of classes that fill a window exactly, a class repeated and one other
or three classes, are the columns of a non-negative least-squares problem whose right side is that histogram; its
solution, rounded down, says how often each combination is used, and what is left is packed greedily, largest
first.  The problem's size depends on the window only.  The plan gives ranks within a class to sequences, so
placing is a distributed ranking of narrow rows and no list of pieces ever meets in one place.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_name, in_small_batches, lean, sorted_ranks, written

#: A pattern: [(class, how many), ...] and the number of windows that use it.
Pattern = tuple[list[tuple[int, int]], int]

#: Bytes of text that are tokenised at a time, and words encoded as one.
SLICE, JOINED = 2 << 20, 256
#: Bytes of words and their ids that a task remembers, what a word takes beside its own, and the longest such.
MEMORY, EACH, LONGEST = 20 << 20, 16, 64
#: Marks that can follow a word's letters; none begins a contraction.
MARKS = ".,!?;:|"
#: The one letter whose lower case ends in a mark.
DOTTED = "\u0130"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by the active-set method."""
    x = np.zeros(a.shape[1])
    passive: list[int] = []
    slack = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds):
        gradient = a.T @ (b - a[:, passive] @ x[passive])
        gradient[passive] = -np.inf
        enter = int(gradient.argmax())
        if gradient[enter] <= slack:
            break
        passive.append(enter)
        while True:
            used = a[:, passive]
            gram = used.T @ used
            gram[np.diag_indices_from(gram)] *= 1 + 1e-10  # combinations can depend on each other
            z = np.linalg.solve(gram, used.T @ b)
            if (z > 0).all():
                x[passive] = z
                break
            now = x[passive]
            back = z <= 0
            step = (now[back] / np.maximum(now[back] - z[back], 1e-300)).min()
            now = now + step * (z - now)
            x[passive] = now
            out = {p for p, v, was in zip(passive, now, back) if was and v <= 1e-12 * max(1.0, now.max())}
            if not out:
                out = {passive[int(np.where(back, now, np.inf).argmin())]}
            for p in out:
                x[p] = 0
            passive = [p for p in passive if p not in out]
            if not passive:
                break
    return x


def combinations(units: int) -> list[list[tuple[int, int]]]:
    """Classes that sum to ``units``: one repeated, with at most one other, and three different ones."""
    out = [[(units, 1)]]
    for a in range(1, units):
        for k in range(1, units // a + 1):
            b = units - k * a
            if b == 0:
                out.append([(a, k)])
            elif b != a and (k > 1 or a < b):
                out.append([(a, k), (b, 1)])
    for a in range(1, units // 3 + 1):
        for b in range(a + 1, (units - a + 1) // 2):
            c = units - a - b
            if c > b:
                out.append([(a, 1), (b, 1), (c, 1)])
    return out


def plan_windows(counts: dict[int, int], units: int) -> list[Pattern]:
    """Patterns that use every piece of the histogram {class: pieces} exactly once."""
    left = np.zeros(units + 1, np.int64)
    for c, n in counts.items():
        left[c] = n
    out: list[Pattern] = [([(units, 1)], int(left[units]))] if left[units] else []
    left[units] = 0
    usable = [p for p in combinations(units) if all(left[c] >= m for c, m in p)]
    if usable:
        rows = np.flatnonzero(left)
        place = {int(c): k for k, c in enumerate(rows)}
        a = np.zeros((len(rows), len(usable)))
        for j, p in enumerate(usable):
            for c, m in p:
                a[place[c], j] = m
        x = nnls(a, left[rows].astype(float))
        for j in np.argsort(-x):
            n = min(int(x[j] + 1e-6), *(int(left[c]) // m for c, m in usable[j]))
            if n > 0:
                out.append((usable[j], n))
                for c, m in usable[j]:
                    left[c] -= n * m
    while left.any():  # greedily, largest first; each pattern repeats until a class runs out
        room, pattern = units, []
        for c in range(units, 0, -1):
            if left[c] and (m := min(room // c, int(left[c]))):
                pattern.append((c, m))
                room -= m * c
        n = min(int(left[c]) // m for c, m in pattern)
        out.append((pattern, n))
        for c, m in pattern:
            left[c] -= n * m
    return out


def gathered(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Lists, given flat and by size, put together in the order of ``index``; and where each ends, from 0.

    ``block`` lists at a time, so that what is worked with beside the result stays small.
    """
    ends = np.zeros(len(index) + 1, np.int64)
    np.cumsum(sizes[index], out=ends[1:])
    first = np.cumsum(sizes) - sizes
    out = np.empty(ends[-1], flat.dtype)
    for a in range(0, len(index), block):
        part = index[a : a + block]
        lo, hi = ends[a], ends[a + len(part)]
        at = np.repeat(first[part] - (ends[a : a + len(part)] - lo), sizes[part])
        at += np.arange(hi - lo)
        out[lo:hi] = flat[at]
    return out, ends


@functools.lru_cache(maxsize=1)
def tokenizer_at(path: str) -> tuple[object, str | None, int, np.ndarray]:
    """A tokenizer file, loaded once a worker process; a special token and its id; which ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    between, between_id = next(((t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special), (None, -1))
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    last = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    last[[i for t, i in tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
    return tokenizer, between, between_id, last


#: Ids of several words, one after another, and how many each word has.
Coded = tuple[np.ndarray, np.ndarray]


def word_ids(path: str, memory: int = MEMORY) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to (ids of all, end of each text's ids), as the tokenizer file gives them.

    For tokenizers that lower case, drop white space and take letters and marks apart, and never look across either:
    the ids of a word are those of its letters and those of the marks after them, in any text.  So each different
    part is encoded once and remembered in flat arrays of ``memory`` bytes at most, which go with the function; of
    more parts those used last stay.  New parts are encoded many at a time, with a blank or a special token between
    them; long ones one by one.
    """
    tokenizer, between, between_id, last = tokenizer_at(path)
    known = pa.array([""])
    flat, sizes, used = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int32)
    turn = 0

    def joined(words: list[str], sign: str, cut: Callable[[np.ndarray], Coded]) -> Coded | None:
        """Many words as one text, whose ids ``cut`` deals to them; none if that gives another number of words."""
        flat, sizes = [], []
        for k in range(0, len(words), 8 * JOINED):  # the library's results are large
            parts = [words[j : j + JOINED] for j in range(k, min(k + 8 * JOINED, len(words)), JOINED)]
            for part, e in zip(parts, tokenizer.encode_batch_fast([sign.join(p) for p in parts], add_special_tokens=False)):
                ids, n = cut(np.array(e.ids, "<u4"))
                if len(n) != len(part):
                    return None
                flat.append(ids)
                sizes.append(n)
        return np.concatenate(flat), np.concatenate(sizes)

    def one_by_one(words: list[str]) -> Coded:
        lists = [np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4") for w in words]
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def at_ends(ids: np.ndarray) -> Coded:
        whole = len(ids) > 0 and last[ids[-1]]
        return ids, np.diff(np.flatnonzero(last[ids]), prepend=-1) if whole else np.zeros(0, np.int64)

    def at_signs(ids: np.ndarray) -> Coded:
        sign = ids == between_id
        return ids[~sign], np.diff(np.flatnonzero(sign), prepend=-1, append=len(ids)) - 1

    def letters(words: list[str]) -> Coded:
        """Each is one run of letters, whose last token ends a word."""
        return joined(words, " ", at_ends) or separated(words)

    def separated(words: list[str]) -> Coded:
        return joined(words, between, at_signs) or one_by_one(words)

    def new_ids(words: pa.Array) -> Coded:
        alone = pc.or_(pc.greater(pc.binary_length(words), LONGEST), pc.match_substring(words, between) if between else True)
        run = pc.and_(pc.utf8_is_alpha(words), pc.invert(alone))
        alone, run = (x.to_numpy(zero_copy_only=False) for x in (alone, run))
        order, found = [], []
        for of, these in ((one_by_one, alone), (letters, run), (separated, ~alone & ~run)):
            at = np.flatnonzero(these)
            if len(at):
                order.append(at)
                found.append(of(words.take(pa.array(at)).to_pylist()))
        flat, sizes = (np.concatenate(x) for x in zip(*found))
        index = np.argsort(np.concatenate(order))
        return gathered(flat, sizes, index)[0], sizes[index]

    def ids_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of parts, and which of them each of the different ``words`` is."""
        nonlocal known, flat, sizes, used, turn
        turn += 1
        at = pc.fill_null(pc.index_in(known, value_set=words), -1).to_numpy()  # the shorter side is hashed
        hit = np.flatnonzero(at >= 0)
        place = np.full(len(words), -1, np.int64)
        place[at[hit]] = hit
        used[hit] = turn
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = len(known) + np.arange(len(fresh))
            new = words.take(pa.array(fresh))
            ids, n = new_ids(new)
            known, flat, sizes = pa.concat_arrays([known, new]), np.concatenate([flat, ids]), np.concatenate([sizes, n])
            used = np.concatenate([used, np.full(len(fresh), turn, np.int32)])
        found = flat, sizes, place
        takes = EACH + pc.binary_length(known).to_numpy() + 4 * sizes
        if (held := int(takes.sum())) > memory:
            kept = np.flatnonzero(takes <= EACH + 8 * LONGEST)
            kept = kept[np.argsort(-used[kept], kind="stable")[: int(len(kept) * memory / held / 2)]]
            known = known.take(pa.array(kept))
            flat, sizes, used = gathered(flat, sizes, kept)[0], sizes[kept], used[kept]
        return found

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        word = coded.dictionary
        letters_of = pc.utf8_rtrim(word, MARKS)
        marks = pc.replace_substring_regex(word, r"^\pL+", "")
        length = pc.add(pc.binary_length(letters_of), pc.binary_length(marks))
        whole = pc.and_(pc.utf8_is_alpha(pc.utf8_normalize(letters_of, "NFC")), pc.invert(pc.match_substring(letters_of, DOTTED)))
        apart = pc.and_(whole, pc.equal(length, pc.binary_length(word)))
        parts = pa.concat_arrays([pc.if_else(apart, pc.ascii_lower(letters_of), word), pc.if_else(apart, marks, "")]).dictionary_encode()
        flat, sizes, place = ids_of(parts.dictionary)
        index = place[parts.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T.ravel()
        flat, ends = gathered(flat, sizes, index)
        ids, ends = gathered(flat, np.diff(ends[::2]), coded.indices.to_numpy(zero_copy_only=False))
        return ids, ends[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]

    return encode


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, at least a row and at most ``rows``."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        for at in range(a, b, rows):
            yield batch.slice(at, min(rows, b - at))


def _segments(text: pa.Scalar) -> Iterator[str]:
    """A text in parts of about ``SLICE`` bytes that end with white space, which no token crosses."""
    data, at = text.as_buffer().to_pybytes(), 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end - 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].decode()
        at = end


def pieces(df: DataFrame, path: Callable[[], str], window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``<id_col>, start, length, ids_crc32, doc_tokens[, ids]``: each document's whole windows and its rest.

    ``path`` gives the tokenizer file's place on the executor.  Null and empty texts have ``end_id`` alone.  Whole
    texts are tokenised, a slice of ``SLICE`` bytes of rows at a time and a longer text by itself.  Rows that repeat,
    with identifier or wholly, each have their own pieces; an empty table gives none.  Other columns are not read, so
    their names may clash with ours.
    """
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path())
        for whole in batches:
            for b in slices(whole, "_text"):
                if b.num_rows == 1 and (text := b["_text"][0]).as_buffer().size > 2 * SLICE:
                    found = np.concatenate([encode(pa.array([part]))[0] for part in _segments(text)])
                    ends = np.array([len(found)])
                else:
                    found, ends = encode(b["_text"])
                row, start, length, crc, total, lists = [], [], [], [], [], []
                at = 0
                for k, end in enumerate(ends.tolist()):
                    doc = np.append(found[at:end], np.uint32(end_id)).astype("<u4")
                    at = end
                    for cut in range(0, len(doc), window):
                        piece = doc[cut : cut + window]
                        row.append(k)
                        start.append(cut)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(doc))
                        if ids:
                            lists.append(piece.astype(np.int32))
                values = [start, length, crc, total] + [lists] * ids
                yield pa.RecordBatch.from_arrays([b["_id"].take(pa.array(row)), *(pa.array(v, t) for v, t in zip(values, kinds))], names)

    rows = in_small_batches(df).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema["_id"], *(T.StructField(n, T.LongType()) for n in names[1:5])])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(lean(scan), schema).withColumnRenamed("_id", id_col)


def pack(rows: DataFrame, window: int, grain: int = 8, order: list[str] | None = None, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id, offset`` to rows that have a length of 1 to ``window``; no sequence exceeds the window.

    Rows are ranked within a length class by ``order`` (all columns by default), so the result follows from the
    rows alone; rows that tie are alike.  An empty table gives an empty result.  Where ``rows`` has columns named
    like ours, ours get underscores appended.
    """
    if window % grain:
        raise ValueError("the window is a multiple of the grain")
    order = order or [c for c, kind in rows.dtypes if not kind.startswith(("array", "map"))]
    classed = rows.select(F.struct(*rows.columns).alias("_row"), F.ceil(F.col(length_col) / grain).cast("int").alias("_class"), F.col(length_col).alias("_length"))
    ranked = sorted_ranks(classed, ["_class"], [f"_row.`{c}`" for c in order], "pieces")
    counts = {r["_class"]: r["n"] for r in ranked.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # window / grain rows
    base, used, rules = 0, dict.fromkeys(counts, 0), []
    for pattern, n in plan_windows(counts, window // grain):
        for slot, (c, m) in enumerate(sorted(pattern, reverse=True)):
            rules.append((c, used[c], used[c] + n * m, base, n, slot))
            used[c] += n * m
        base += n
    rules = rows.sparkSession.createDataFrame(rules, "_c int, _lo long, _hi long, _base long, _n long, _slot int")
    placed = ranked.join(F.broadcast(rules), (F.col("_class") == F.col("_c")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
    turn = F.col("rank") - F.col("_lo")
    placed = placed.withColumn("_sequence", F.col("_base") + F.pmod(turn, F.col("_n"))).withColumn("_turn", F.floor(turn / F.col("_n")))
    # At most window / grain rows a sequence (classes are at least one grain).
    before = Window.partitionBy("_sequence").orderBy("_slot", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_length").over(before), F.lit(0)).cast("long")
    return placed.select("_row.*", F.col("_sequence").alias(free_name(rows, "sequence_id")), offset.alias(free_name(rows, "offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, tokens``: the token ids of each sequence, from pieces made with ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return packed.groupBy("sequence_id").agg(whole.alias("ids")).withColumn("tokens", F.size("ids").cast("long"))


#: The query's tokenizer, window and the id that ends a document.
TOKENIZER, WINDOW, END = "word_bpe_49k.json", 2048, 1


def tokenizer_path(name: str) -> Callable[[], str]:
    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


def pack_documents(docs: DataFrame) -> DataFrame:
    """``pieces`` of the query's tokenizer, packed; nulls, repeats and empty tables as there."""
    cut = written(pieces(docs, tokenizer_path(TOKENIZER), WINDOW, END), "cut")  # else the ranking's sampling tokenises as well
    return pack(cut, WINDOW, order=["doc_id", "start", "ids_crc32", "length"])


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; whole windows are sequences of their own."""
    return pack_documents(documents(spark, sf_dir))
