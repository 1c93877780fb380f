"""Token counts by a compiled finite-state tokenizer.

Two deterministic machines stand for a byte-level BPE tokenizer:

* The splitter, a transducer over character classes, marks where pre-tokens begin.  A text is cut into chunks of
  equal length; the map from each state before a chunk to the state after it is computed for all chunks in step,
  the maps compose by a parallel prefix scan, and from the states found so the chunks emit their marks in step.
* The counter, a transducer over bytes, holds on each transition by how much the byte changes the number of tokens
  of the pre-token read so far.  A state is what the rest of the merge result can depend on: the longest suffix
  that begins some token, and the last token and relative count at each place in it.  States are compiled when
  first reached and kept.

Each different pre-token of a batch goes through the counter once.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_small_batches, lean, n_bytes
from .packing import slices, tokenizer_path

#: Bytes that end a text and that stand for a special token; neither occurs in UTF-8.
END, SPECIAL = 0xFF, 0xFE
#: Characters a chunk has, and transitions the counter keeps.
CHUNK, TRANSITIONS = 256, 2_000_000
#: Bytes of text that are counted at a time.
SLICE = 12 << 20


class Splitter:
    """Where pre-tokens begin under the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    States: what the token that is being read is.  ``quote`` is an apostrophe that begins a token, ``quote_rv`` and
    ``quote_l`` such a one with a first letter of a contraction, ``done`` a whole contraction; ``one_``/``many_``
    are white space of one or more characters, the last one a blank or another.
    """

    STATES = ["start", "letters", "digits", "other", "quote", "quote_rv", "quote_l", "done", "one_blank", "one_white", "many_blank", "many_white"]
    CLASSES = ["letter", "stmd", "rv", "e", "l", "digit", "other", "quote", "blank", "white", "end", "inside"]
    #: Emitted: a token begins at this character, at the one before it.
    HERE, BEFORE = 1, 2

    def __init__(self) -> None:
        n, m = len(self.STATES), len(self.CLASSES)
        self.next = np.zeros((m, n), np.uint8)
        self.emit = np.zeros((m, n), np.uint8)
        for c, kind in enumerate(self.CLASSES):
            for s, state in enumerate(self.STATES):
                to, out = self._step(state, kind)
                self.next[c, s], self.emit[c, s] = self.STATES.index(to), out
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, self.CLASSES.index("other"), np.uint8)
        for pattern, name in ((r"\p{L}+", "letter"), (r"\p{N}+", "digit"), (r"\s+", "white")):
            for found in regex.finditer(pattern, everything):
                table[ord(found[0][0]) : ord(found[0][-1]) + 1] = self.CLASSES.index(name)
        for chars, name in (("stmd", "stmd"), ("rv", "rv"), ("e", "e"), ("l", "l"), ("'", "quote"), (" ", "blank")):
            for c in chars:
                table[ord(c)] = self.CLASSES.index(name)
        self.of_code = table
        self.of_byte = np.full(256, self.CLASSES.index("inside"), np.uint8)
        self.of_byte[:128] = table[:128]
        self.of_byte[[END, SPECIAL]] = self.CLASSES.index("end")

    def _step(self, state: str, kind: str) -> tuple[str, int]:
        if kind == "inside":  # the further bytes of a character
            return state, 0
        pending = self.BEFORE if state in ("quote_rv", "quote_l") else 0
        if kind == "end":
            return "start", self.HERE | pending
        if state == "quote" and kind in ("stmd", "rv", "l"):
            return {"stmd": "done", "rv": "quote_rv", "l": "quote_l"}[kind], 0
        if (state, kind) in (("quote_rv", "e"), ("quote_l", "l")):
            return "done", 0
        if kind in ("blank", "white"):
            many = state.startswith(("one", "many"))
            return ("many_" if many else "one_") + kind, 0 if many else self.HERE | pending
        to = {"digit": "digits", "other": "other", "quote": "other"}.get(kind, "letters")
        if state in ("one_blank", "many_blank"):  # the blank before belongs to this token
            return to, self.BEFORE if state == "many_blank" else 0
        if state == "many_white":
            pending = self.BEFORE
        runs_on = state == to or (state in ("quote_rv", "quote_l") and to == "letters") or (state == "quote" and to == "other")
        if runs_on:
            return to, pending
        return ("quote" if kind == "quote" else to), self.HERE | pending

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte; a character's class is at its first byte."""
        out = self.of_byte[data]
        lead = np.flatnonzero((data >= 0xC0) & (data < SPECIAL))
        if len(lead):
            b = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 63 for k in range(4)]
            first = data[lead].astype(np.int64)
            two = (first & 31) << 6 | b[1]
            three = (first & 15) << 12 | b[1] << 6 | b[2]
            four = (first & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]
            out[lead] = self.of_code[np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))]
        return out

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Offsets where tokens begin; ``data`` are UTF-8 texts that each end with END, specials being SPECIAL."""
        n, states = len(data), len(self.STATES)
        chunks = -(-n // CHUNK)
        kinds = np.full(chunks * CHUNK, self.CLASSES.index("inside"), np.uint8)
        kinds[:n] = self.classes(data)
        kinds = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)
        row = kinds.astype(np.int16) * states
        flat_next, flat_emit = self.next.ravel(), self.emit.ravel()
        maps = np.tile(np.arange(states, dtype=np.uint8), (chunks, 1))
        for r in row:
            maps = flat_next[r[:, None] + maps]
        step = 1
        while step < chunks:  # maps[i] becomes the map over chunks 0 to i
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
            step *= 2
        state = np.concatenate([[0], maps[:-1, 0]]).astype(np.uint8)
        out = np.empty((CHUNK, chunks), np.uint8)
        for k, r in enumerate(row):
            at = r + state
            out[k] = flat_emit[at]
            state = flat_next[at]
        out = out.T.ravel()[:n]
        begins = (out & self.HERE).astype(bool)
        late = np.flatnonzero(out & self.BEFORE) - 1
        for _ in range(3):
            late -= (data[late] & 0xC0) == 0x80
        begins[late] = True
        return np.flatnonzero(begins)


class Counter:
    """Number of tokens that the merges make of a pre-token."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = vocabulary
        self.token = {i: t for t, i in vocabulary.items()}
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.prefixes = {t[:k] for t in vocabulary for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        # A state: the suffix, and the last token and the count (against the present one) at each place in it;
        # token -1 at the beginning of a pre-token.
        self.states = [(b"", ((-1, 0),))]
        self.number = {self.states[0]: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.kept = 0

    def merged(self, word: bytes) -> list[bytes]:
        """The plain merge procedure."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can be neighbours in a result."""
        known = self.pairs.get((left, right))
        if known is None:
            word = self.token[right]
            want = [word] if left < 0 else [self.token[left], word]
            known = self.pairs[left, right] = self.merged(b"".join(want)) == want
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition: every place has exactly one last token that fits what stands before it."""
        suffix, places = self.states[state]
        longer = suffix + bytes([byte])
        for k in range(len(longer)):
            right = self.ids.get(longer[k:])
            if right is not None and self._fits(places[k][0], right):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        delta = places[k][1] + 1
        cut = next(k for k in range(len(longer) + 1) if k == len(longer) or longer[k:] in self.prefixes)
        key = (longer[cut:], tuple((t, c - delta) for t, c in places[cut:]) + ((right, 0),))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        self.next[state][byte] = found = (to, delta)
        self.kept += 1
        return found

    def count(self, words: list[bytes]) -> np.ndarray:
        if self.kept > TRANSITIONS:
            self._clear()
        if len(self.pairs) > TRANSITIONS:
            self.pairs.clear()
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            state = total = 0
            for b in w:
                state, delta = self.next[state].get(b) or self._compile(state, b)
                total += delta
            out[k] = total
        return out


class Machine:
    """A byte-level BPE tokenizer file, compiled."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # The fixed byte alphabet of such files: printable Latin-1 bytes stand for themselves, the others are
        # numbered on from U+0100.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        code = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        raw = lambda token: bytes(code[c] for c in token)
        split = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.specials = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        special = {t["content"] for t in spec["added_tokens"]}
        self.splitter = Splitter()
        self.counter = Counter({raw(t): i for t, i in model["vocab"].items() if t not in special}, [(raw(a), raw(b)) for a, b in split])

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text; a special token's string counts as that one token."""
        end, mark = bytes([END]), bytes([SPECIAL])
        joined = end.join(texts) + end
        for s in self.specials:
            joined = joined.replace(s, mark)
        data = np.frombuffer(joined, np.uint8)
        starts = self.splitter.starts(data)
        first = data[starts]
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined)])
        coded = words.dictionary_encode()
        different = coded.dictionary.to_pylist()
        plain = [w for w in different if w not in (end, mark)]
        sizes = np.array([w == mark for w in different], np.int64)
        sizes[[w not in (end, mark) for w in different]] = self.counter.count(plain)
        each = sizes[coded.indices.to_numpy()]
        ends = np.flatnonzero(first == END)
        return np.diff(np.concatenate([[0], np.cumsum(each)[ends]]))


@functools.lru_cache(maxsize=1)
def machine_of(path: str) -> Machine:
    """Compiled once a worker process; the counter's states stay from task to task."""
    return Machine(path)


def token_counts(df: DataFrame, path: Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes, n_tokens``, a row for each row; nothing is moved.

    Null texts count as empty: no bytes, no tokens.  Whole texts are counted, a slice of the table at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path())
        for whole in batches:
            for b in slices(whole, "_text", SLICE):
                counts = machine.counts(b["_text"].to_pylist())
                yield pa.RecordBatch.from_arrays([b["_id"], b["n_bytes"], pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = in_small_batches(df).select(F.col(id_col).alias("_id"), n_bytes(text).alias("n_bytes"), F.encode(text, "UTF-8").alias("_text"))
    schema = T.StructType([rows.schema["_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(lean(scan), schema).withColumnRenamed("_id", id_col)


#: The query's tokenizer and limit.
TOKENIZER, LIMIT = "byte_bpe_50k.json", 512


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(documents(spark, sf_dir), tokenizer_path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
