"""Lossless WebP (VP8L): a decoder for whole streams, an encoder, and a batch path for grey frames.

The decoder reads prefix codes (simple and normal, several groups), literals, back-references and the colour cache,
inverts the predictor, cross-colour, subtract-green and palette transforms and gives ARGB arrays.  The encoder
writes any of these as asked.  For columns of grey images it takes, image by image, what is shortest: the samples,
their steps from the left neighbour (predictor), or a palette of few samples with several to a pixel.

Frames whose green code alone has bits are decoded many steps at once: small ones side by side, one lane a frame,
large ones in blocks of bits.  What meets anything but a literal goes on in the whole decoder.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_MULTIPLIER = 0x1E35A7BD
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
BLACK = 0xFF000000
# Near distances, (left, up) for codes 1 to 120.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]

#: Longest code of frames that are decoded in step.
LANE_BITS = 11
#: Pixels from which a frame is decoded in blocks; bits of a block; bytes of a stream that are looked at together.
LARGE, BLOCK, SEGMENT = 1 << 14, 512, 1 << 18
#: Literals whose bits are put together at a time.
TOGETHER = 1 << 20


class Bits:
    """Numbers from a byte string, least significant bit first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def peek(self) -> int:
        """At least 24 bits, zeros beyond the end."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends too early")
        return value


class BitsOut:
    def __init__(self) -> None:
        self.value = self.n = 0
        self.done = bytearray()

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 512:
            whole = self.n >> 3
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n &= 7

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")

    def length(self) -> int:
        return 8 * len(self.done) + self.n


@functools.lru_cache(maxsize=16)
def reversal(bits: int) -> np.ndarray:
    """The numbers below 2^bits with their bits in reverse order."""
    n = np.arange(1 << bits)
    out = np.zeros_like(n)
    for k in range(bits):
        out |= ((n >> k) & 1) << (bits - 1 - k)
    return out


@dataclass
class Code:
    """A canonical prefix code as a table over the next ``bits`` bits: symbol << 4 | length."""

    bits: int
    table: np.ndarray
    list: list[int]

    def read(self, source: Bits) -> int:
        if not self.bits:
            return self.list[0] >> 4
        entry = self.list[source.peek() & ((1 << self.bits) - 1)]
        source.at += entry & 15
        return entry >> 4


def code_of(lengths: np.ndarray) -> Code:
    symbols = np.flatnonzero(lengths)
    if len(symbols) <= 1:  # one symbol takes no bits
        only = int(symbols[0]) << 4 if len(symbols) else 0
        return Code(0, np.array([only], np.uint16), [only])
    order = symbols[np.argsort(lengths[symbols], kind="stable")]
    size = lengths[order]
    bits = int(size[-1])
    spans = 1 << (bits - size)
    if spans.sum() != 1 << bits:
        raise ValueError("the prefix code is not complete")
    table = np.repeat((order << 4 | size).astype(np.uint16), spans)[reversal(bits)]
    return Code(bits, table, table.tolist())


def codes_for(lengths: np.ndarray) -> np.ndarray:
    """The bits to write for each symbol, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    symbols = np.flatnonzero(lengths)
    if len(symbols) > 1:
        order = symbols[np.argsort(lengths[symbols], kind="stable")]
        size = lengths[order]
        bits = int(size[-1])
        start = np.cumsum(1 << (bits - size)) - (1 << (bits - size))
        out[order] = reversal(bits)[start]  # the unused low bits of start are high zeros here
    return out


def lengths_for(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of at most ``limit`` bits from symbol counts, by merging the two rarest again and again."""
    out = np.zeros(len(counts), np.int64)
    symbols = np.flatnonzero(counts)
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    weights = counts[symbols]
    while True:
        order = np.argsort(weights, kind="stable")
        leaves = weights[order].tolist()
        n = len(leaves)
        joined: list[int] = []  # weights of inner nodes, in order; parents of leaves and of inner nodes
        leaf_up, inner_up = [0] * n, [0] * n
        a = b = 0
        for k in range(n - 1):
            total = 0
            for _ in range(2):
                if a < n and (b >= len(joined) or leaves[a] <= joined[b]):
                    total += leaves[a]
                    leaf_up[a] = k
                    a += 1
                else:
                    total += joined[b]
                    inner_up[b] = k
                    b += 1
            joined.append(total)
        depth = [0] * (n - 1)
        for k in range(n - 3, -1, -1):
            depth[k] = depth[inner_up[k]] + 1
        size = [depth[up] + 1 for up in leaf_up]
        if max(size) <= limit:
            out[symbols[order]] = size
            return out
        weights = (weights >> 1) + (weights.max() >> limit) + 1  # flatter, until the code is short enough


def runs_of(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra, extra bits): lengths, repeats of the last one, runs of zeros."""
    begin = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]])
    out, last = [], 8
    for v, n in zip(lengths[begin[:-1]].tolist(), np.diff(begin).tolist()):
        if v and v != last:
            out.append((v, 0, 0))
            last, n = v, n - 1
        while n >= 3:
            if v:
                m = min(n, 6)
                out.append((16, m - 3, 2))
            elif n >= 11:
                m = min(n, 138)
                out.append((18, m - 11, 7))
            else:
                m = min(n, 10)
                out.append((17, m - 3, 3))
            n -= m
        out += [(v, 0, 0)] * n
    return out


def write_code(out: BitsOut, lengths: np.ndarray) -> None:
    symbols = np.flatnonzero(lengths).tolist()
    if len(symbols) <= 2 and max(symbols, default=0) < 256:
        first = symbols[0] if symbols else 0
        out.write(1, 1)
        out.write(max(0, len(symbols) - 1), 1)
        out.write(first > 1, 1)
        out.write(first, 8 if first > 1 else 1)
        if len(symbols) == 2:
            out.write(symbols[1], 8)
        return
    runs = runs_of(lengths)
    used = np.bincount([r[0] for r in runs], minlength=19)
    if np.count_nonzero(used) == 1:
        used[(int(used.argmax()) + 1) % 16] += 1  # a code of one symbol would have to be written without bits
    size = lengths_for(used, 7)
    bits = codes_for(size).tolist()
    ordered = [int(size[s]) for s in CODE_LENGTH_ORDER]
    n = max(4, max(k for k, s in enumerate(ordered) if s) + 1)
    out.write(0, 1)
    out.write(n - 4, 4)
    for s in ordered[:n]:
        out.write(s, 3)
    out.write(0, 1)
    sizes = size.tolist()
    for symbol, extra, more in runs:
        out.write(bits[symbol] | extra << sizes[symbol], sizes[symbol] + more)


def read_code(source: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if source.read(1):
        two = source.read(1)
        first = source.read(8 if source.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[source.read(8)] = 1
        return code_of(lengths)
    size = np.zeros(19, np.int64)
    for s in CODE_LENGTH_ORDER[: 4 + source.read(4)]:
        size[s] = source.read(3)
    inner = code_of(size)
    left = alphabet
    if source.read(1):
        left = 2 + source.read(2 + 2 * source.read(3))
        if left > alphabet:
            raise ValueError("too many code lengths")
    found: list[int] = []
    last, mask, table = 8, (1 << inner.bits) - 1, inner.list
    byte = source.at >> 3
    # All that the lengths can take: one look at the bytes, then shifts.
    ahead = int.from_bytes(source.data[byte : byte + 2 * alphabet + 16], "little") >> (source.at & 7)
    while len(found) < alphabet and left:
        left -= 1
        entry = table[ahead & mask]
        s, used = entry >> 4, entry & 15 if mask else 0
        ahead >>= used
        if s < 16:
            found.append(s)
            last = s or last
        else:
            more, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            found += [last if s == 16 else 0] * (least + (ahead & ((1 << more) - 1)))
            ahead >>= more
            used += more
        source.at += used
    if source.at > 8 * len(source.data):
        raise ValueError("the image ends too early")
    if len(found) > alphabet:
        raise ValueError("the code lengths exceed the alphabet")
    lengths[: len(found)] = found
    return code_of(lengths)


def prefix_value(symbol: int, source: Bits) -> int:
    """A length or distance: small ones are symbols, others a symbol and further bits."""
    if symbol < 4:
        return symbol + 1
    more = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << more) + source.read(more) + 1


def prefix_symbol(value: int) -> tuple[int, int, int]:
    """(symbol, further bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    more = high - 1
    return 2 * high + (v >> more & 1), v & ((1 << more) - 1), more


def cells(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


@dataclass
class Entropy:
    """What stands before an image's pixels; ``source.at`` is at the first of them."""

    source: Bits
    width: int
    height: int
    cache_bits: int
    groups: list[list[Code]]
    cell_bits: int = 0
    cell_group: np.ndarray | None = None

    @classmethod
    def read(cls, source: Bits, width: int, height: int, main: bool) -> Entropy:
        cache = source.read(4) if source.read(1) else 0
        if cache > 11:
            raise ValueError("the colour cache is too large")
        bits, group, n = 0, None, 1
        if main and source.read(1):
            bits = 2 + source.read(3)
            image = cls.read(source, cells(width, bits), cells(height, bits), False).pixels()
            group = (image >> 8 & 0xFFFF).reshape(cells(height, bits), cells(width, bits))
            n = int(group.max()) + 1
        sizes = [LITERALS + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES]
        groups = [[read_code(source, s) for s in sizes] for _ in range(n)]
        return cls(source, width, height, cache, groups, bits, group)

    def reference(self, codes: list[Code], symbol: int | None = None) -> tuple[int, int]:
        """Length and distance of a back-reference; ``symbol``: of its length, if that is read already."""
        source = self.source
        length = prefix_value((codes[GREEN].read(source) if symbol is None else symbol) - LITERALS, source)
        code = prefix_value(codes[DISTANCE].read(source), source)
        if code > len(NEAR):
            return length, code - len(NEAR)
        left, up = NEAR[code - 1]
        return length, max(1, left + up * self.width)

    def pixels(self, start: list[int] | None = None) -> np.ndarray:
        """ARGB values; ``start``: those that are decoded already."""
        source, width, total = self.source, self.width, self.width * self.height
        out = list(start or [])
        cache = [0] * (1 << self.cache_bits) if self.cache_bits else None
        shift = 32 - self.cache_bits
        codes = self.groups[0]
        while len(out) < total:
            if self.cell_group is not None:
                y, x = divmod(len(out), width)
                codes = self.groups[self.cell_group[y >> self.cell_bits, x >> self.cell_bits]]
            s = codes[GREEN].read(source)
            if s < LITERALS:
                red = codes[RED].read(source)
                blue = codes[BLUE].read(source)
                new = [codes[ALPHA].read(source) << 24 | red << 16 | s << 8 | blue]
            elif s < LITERALS + LENGTHS:
                length, distance = self.reference(codes, s)
                if distance > len(out) or len(out) + length > total:
                    raise ValueError("a back-reference leaves the image")
                piece = out[-distance:][:length]
                new = (piece * (length // len(piece) + 1))[:length]
            else:
                if cache is None or s - LITERALS - LENGTHS >= len(cache):
                    raise ValueError("there is no such colour in the cache")
                new = [cache[s - LITERALS - LENGTHS]]
            if cache is not None:
                for p in new:
                    cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
            out += new
            if source.at > 8 * len(source.data):
                raise ValueError("the image ends too early")
        return np.array(out, np.uint32)


def channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def packed(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def mean2(a: int, b: int) -> int:
    """The mean of each channel, rounded down."""
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def added(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def subtracted(a: int, b: int) -> int:
    return packed([(x - y) & 255 for x, y in zip(channels(a), channels(b))])


def _nearer(left: int, top: int, corner: int) -> int:
    to_left = sum(abs(t - c) for t, c in zip(channels(top), channels(corner)))
    to_top = sum(abs(x - c) for x, c in zip(channels(left), channels(corner)))
    return left if to_left < to_top else top


def _clamped(values) -> int:
    return packed([min(255, max(0, v)) for v in values])


def _half(a: int, b: int) -> int:
    return a + (abs(a - b) // 2 if a >= b else -(abs(a - b) // 2))


#: Predictions from the left, top, top right and top left pixels, by mode.
PREDICTIONS = [
    lambda l, t, r, c: BLACK,
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: mean2(mean2(l, r), t),
    lambda l, t, r, c: mean2(l, c),
    lambda l, t, r, c: mean2(l, t),
    lambda l, t, r, c: mean2(c, t),
    lambda l, t, r, c: mean2(t, r),
    lambda l, t, r, c: mean2(mean2(l, c), mean2(t, r)),
    lambda l, t, r, c: _nearer(l, t, c),
    lambda l, t, r, c: _clamped(x + y - z for x, y, z in zip(channels(l), channels(t), channels(c))),
    lambda l, t, r, c: _clamped(_half(x, z) for x, z in zip(channels(mean2(l, t)), channels(c))),
    lambda l, t, r, c: BLACK,
    lambda l, t, r, c: BLACK,
]


def prediction(pixels: list[int], at: int, width: int, mode: int) -> int:
    y, x = divmod(at, width)
    if not y:
        return pixels[at - 1] if x else BLACK
    if not x:
        return pixels[at - width]
    return PREDICTIONS[mode](pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def each_cell(cell: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """The cell's value for each pixel of an image."""
    grid = cell.reshape(cells(height, bits), cells(width, bits))
    return grid[np.arange(height)[:, None] >> bits, np.arange(width) >> bits].ravel()


def predictor_inverse(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    if (modes >> 8 & 15 == 1).all():  # the left one, but the upper one in the first column: running sums
        grid = pixels.reshape(height, width).copy()
        grid[0, 0] = added(int(grid[0, 0]), BLACK)
        grid[:, 0] = sums_of_channels(grid[:, 0])
        return sums_of_channels(grid).ravel()
    mode = each_cell(modes >> 8 & 15, bits, width, height).tolist()
    out = pixels.tolist()
    for at in range(len(out)):
        out[at] = added(out[at], prediction(out, at, width, mode[at]))
    return np.array(out, np.uint32)


def predictor_forward(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    mode = each_cell(modes >> 8 & 15, bits, width, height).tolist()
    whole = pixels.tolist()
    return np.array([subtracted(p, prediction(whole, at, width, mode[at])) for at, p in enumerate(whole)], np.uint32)


def cross_colour(pixels: np.ndarray, width: int, height: int, bits: int, factors: np.ndarray, inverse: bool) -> np.ndarray:
    f = each_cell(factors, bits, width, height)
    part = lambda v, k: (v >> k & 255).astype(np.int8).astype(np.int32)
    change = lambda factor, colour: (factor * colour) >> 5
    green, red, blue = part(pixels, 8), (pixels >> 16 & 255).astype(np.int32), (pixels & 255).astype(np.int32)
    sign = 1 if inverse else -1
    new_red = (red + sign * change(part(f, 0), green)) & 255
    base = new_red if inverse else red
    new_blue = (blue + sign * (change(part(f, 8), green) + change(part(f, 16), base.astype(np.int8).astype(np.int32)))) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (new_red.astype(np.uint32) << np.uint32(16)) | new_blue.astype(np.uint32)


def green_added(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = (pixels >> 8 & 255).astype(np.int64) * sign
    red, blue = ((pixels >> 16 & 255) + green) & 255, ((pixels & 255) + green) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (red << 16).astype(np.uint32) | blue.astype(np.uint32)


def palette_bits(colours: int) -> int:
    """Index bits saved by bundling: 2^this indices share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def palette_inverse(pixels: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    shared = palette_bits(len(colours))
    size = 8 >> shared
    bundle = (pixels >> 8 & 255).reshape(height, -1)
    index = (bundle[:, :, None] >> (np.arange(1 << shared) * size) & ((1 << size) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)  # an index beyond the palette is transparent black
    table[: len(colours)] = colours
    return table[index].ravel()


def palette_forward(pixels: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    shared = palette_bits(len(colours))
    size, each = 8 >> shared, 1 << shared
    index = np.searchsorted(colours, pixels).reshape(height, width)
    index = np.pad(index, ((0, 0), (0, -width % each))).reshape(height, -1, each)
    bundle = (index << (np.arange(each) * size)).sum(axis=2)
    return (BLACK | bundle.ravel() << 8).astype(np.uint32)


def sums_of_channels(deltas: np.ndarray) -> np.ndarray:
    """Running sums along the last axis, channel by channel."""
    out = np.zeros(deltas.shape, np.uint32)
    for k in (24, 16, 8, 0):
        out |= (deltas >> np.uint32(k)).astype(np.uint8).cumsum(axis=-1, dtype=np.uint8).astype(np.uint32) << np.uint32(k)
    return out


@dataclass
class Image:
    """An image's header and transforms, read up to its pixels."""

    width: int
    height: int
    transforms: list[tuple]
    entropy: Entropy

    @classmethod
    def read(cls, data: bytes) -> Image:
        """``data``: the content of a VP8L chunk."""
        source = Bits(data)
        if source.read(8) != SIGNATURE:
            raise ValueError("not a lossless WebP stream")
        width, height = source.read(14) + 1, source.read(14) + 1
        source.read(1)
        if source.read(3):
            raise ValueError("unknown version")
        transforms, inner = [], width
        while source.read(1):
            kind = source.read(2)
            if kind in [t[0] for t in transforms]:
                raise ValueError("a transform comes twice")
            if kind == PALETTE:
                n = source.read(8) + 1
                colours = sums_of_channels(Entropy.read(source, n, 1, False).pixels())
                transforms.append((kind, inner, colours))
                inner = cells(inner, palette_bits(n))
            elif kind == SUBTRACT_GREEN:
                transforms.append((kind, inner))
            else:
                bits = 2 + source.read(3)
                transforms.append((kind, inner, bits, Entropy.read(source, cells(inner, bits), cells(height, bits), False).pixels()))
        return cls(width, height, transforms, Entropy.read(source, inner, height, True))

    def finished(self, pixels: np.ndarray) -> np.ndarray:
        """ARGB values with the transforms undone, the last one first."""
        for kind, width, *more in reversed(self.transforms):
            if kind == PREDICTOR:
                pixels = predictor_inverse(pixels, width, self.height, *more)
            elif kind == CROSS_COLOUR:
                pixels = cross_colour(pixels, width, self.height, *more, inverse=True)
            elif kind == SUBTRACT_GREEN:
                pixels = green_added(pixels, 1)
            else:
                pixels = palette_inverse(pixels, width, self.height, *more)
        return pixels


def contained(files: bytes) -> list[bytes]:
    """The VP8L chunks of one or more WebP files that follow each other."""
    out, at = [], 0
    while at < len(files):
        tag, size, kind = struct.unpack_from("<4sI4s", files, at)
        if tag != b"RIFF" or kind != b"WEBP":
            raise ValueError("not a WebP file")
        inner, end = at + 12, at + 8 + size
        while inner < end:
            name, n = struct.unpack_from("<4sI", files, inner)
            if name == b"VP8L":
                out.append(files[inner + 8 : inner + 8 + n])
            elif name == b"VP8 ":
                raise ValueError("the image is lossy")
            inner += 8 + n + (n & 1)
        at = end
    return out


def container(chunk: bytes) -> bytes:
    padded = chunk + b"\0" * (len(chunk) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(padded), b"WEBP", b"VP8L", len(chunk)) + padded


def decode(files: bytes) -> list[np.ndarray]:
    """Each image as an array (height, width) of ARGB numbers."""
    out = []
    for chunk in contained(files):
        image = Image.read(chunk)
        out.append(image.finished(image.entropy.pixels()).reshape(image.height, image.width))
    return out


# The encoder.


def _tokens(pixels: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """Literals ("p", pixel), cache hits ("c", index) and back-references ("r", length, distance code)."""
    near = {}
    for code, (left, up) in enumerate(NEAR, 1):
        near.setdefault(max(1, left + up * width), code)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    seen: dict[tuple, int] = {}
    out, at = [], 0
    while at < len(pixels):
        length = 0
        key = tuple(pixels[at : at + 3])
        if references and len(key) == 3 and key in seen:
            back = at - seen[key]
            while at + length < len(pixels) and length < 4096 and pixels[at + length] == pixels[at + length - back]:
                length += 1
        if length >= 3:
            out.append(("r", length, near.get(back, back + len(NEAR))))
        else:
            length = 1
            slot = (CACHE_MULTIPLIER * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache else 0
            out.append(("c", slot) if cache and cache[slot] == pixels[at] else ("p", pixels[at]))
        for k in range(at, at + length):
            seen[tuple(pixels[k : k + 3])] = k
            if cache:
                cache[(CACHE_MULTIPLIER * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        at += length
    return out


def _write_entropy(out: BitsOut, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, cell_bits: int = 0, groups: np.ndarray | None = None) -> None:
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    height = len(pixels) // width
    of_pixel = np.zeros(len(pixels), np.int64)
    if main:
        out.write(groups is not None, 1)
        if groups is not None:
            out.write(cell_bits - 2, 3)
            _write_entropy(out, (groups.ravel().astype(np.uint32) << 8) | np.uint32(BLACK), cells(width, cell_bits), False)
            of_pixel = each_cell(groups, cell_bits, width, height)
    n = int(of_pixel.max(initial=0)) + 1
    tokens = _tokens(pixels.tolist(), width, cache_bits, references)
    sizes = [LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES]
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(n)]
    plan, at = [], 0
    for token in tokens:
        g = int(of_pixel[at])
        if token[0] == "p":
            a, r, green, b = channels(token[1])
            parts = [(GREEN, green, 0, 0), (RED, r, 0, 0), (BLUE, b, 0, 0), (ALPHA, a, 0, 0)]
        elif token[0] == "c":
            parts = [(GREEN, LITERALS + LENGTHS + token[1], 0, 0)]
        else:
            s, extra, more = prefix_symbol(token[1])
            d, d_extra, d_more = prefix_symbol(token[2])
            parts = [(GREEN, LITERALS + s, extra, more), (DISTANCE, d, d_extra, d_more)]
        at += token[1] if token[0] == "r" else 1
        for which, s, _, _ in parts:
            counts[g][which][s] += 1
        plan.append((g, parts))
    lengths = [[lengths_for(c, 15) for c in group] for group in counts]
    for group in lengths:
        for size in group:
            write_code(out, size)
    bits = [[codes_for(size) for size in group] for group in lengths]
    single = [[np.count_nonzero(size) < 2 for size in group] for group in lengths]
    for g, parts in plan:
        for which, s, extra, more in parts:
            if not single[g][which]:
                out.write(int(bits[g][which][s]), int(lengths[g][which][s]))
            out.write(extra, more)


def encode(image: np.ndarray, transforms: list[tuple] = (), cache_bits: int = 0, references: bool = True, cell_bits: int = 0, groups: np.ndarray | None = None) -> bytes:
    """A WebP file of an array (height, width) of ARGB numbers.

    ``transforms``, in order: (PREDICTOR, bits, modes), (CROSS_COLOUR, bits, factors), (SUBTRACT_GREEN,) and
    (PALETTE,); modes and factors are a cell's pixel values.  ``groups``: the prefix code group of each cell.
    """
    height, width = image.shape
    out = BitsOut()
    out.write(SIGNATURE, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(int((image >> 24 != 255).any()), 1)
    out.write(0, 3)
    pixels, inner = image.astype(np.uint32).ravel(), width
    for kind, *more in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        if kind == PALETTE:
            colours = np.unique(pixels)
            out.write(len(colours) - 1, 8)
            whole = colours.tolist()
            _write_entropy(out, np.array([subtracted(c, b) for c, b in zip(whole, [0, *whole])], np.uint32), len(whole), False)
            pixels = palette_forward(pixels, inner, height, colours)
            inner = cells(inner, palette_bits(len(colours)))
        elif kind == SUBTRACT_GREEN:
            pixels = green_added(pixels, -1)
        else:
            bits, cell = more
            out.write(bits - 2, 3)
            _write_entropy(out, cell.astype(np.uint32).ravel(), cells(inner, bits), False)
            forward = predictor_forward if kind == PREDICTOR else functools.partial(cross_colour, inverse=False)
            pixels = forward(pixels, inner, height, bits, cell.astype(np.uint32).ravel())
    out.write(0, 1)
    _write_entropy(out, pixels, inner, True, cache_bits, references, cell_bits, groups)
    return container(out.bytes())


# Grey frames in batches.


def entropy_bits(counts: np.ndarray) -> float:
    """About how many bits so many symbols of each kind take, with what their code takes."""
    some = counts[counts > 0]
    return float(some @ np.log2(some.sum() / some)) + 6.0 * len(some)


def grey_plan(f: np.ndarray, width: int) -> tuple[int | None, np.ndarray, np.ndarray]:
    """What is shortest for a frame of 8-bit samples: a transform, the green values to code, and the palette.

    None: the samples; PREDICTOR: steps from the left neighbour, in the first column from the upper one; PALETTE: for
    at most 16 different samples, several to a pixel.
    """
    counts = np.bincount(f, minlength=256)
    values = np.flatnonzero(counts).astype(np.uint8)
    if len(values) <= 16:
        shared = palette_bits(len(values))
        each = 1 << shared
        index = np.searchsorted(values, f).reshape(-1, width)
        index = np.pad(index, ((0, 0), (0, -width % each))).reshape(-1, each)
        return PALETTE, (index << (np.arange(each) * (8 >> shared))).sum(axis=1).astype(np.uint8), values
    steps = np.diff(f, prepend=np.uint8(0))
    steps[width::width] = f[width::width] - f[:-width:width]
    if entropy_bits(np.bincount(steps, minlength=256)) < 0.98 * entropy_bits(counts):
        return PREDICTOR, steps, values
    return None, f, values


def _write_single(out: BitsOut, *symbols: int) -> None:
    """Codes of one symbol, which take no bits."""
    for s in symbols:
        one = np.zeros(256, np.int64)
        one[s] = 1
        write_code(out, one)


def _write_head(out: BitsOut, kind: int | None, values: np.ndarray, width: int, height: int) -> None:
    """All up to the codes: size, no alpha, version 0, transforms, no cache, no groups."""
    out.write(SIGNATURE | (width - 1) << 8 | (height - 1) << 22, 40)
    if kind == PALETTE:
        out.write(1 | PALETTE << 1, 3)
        out.write(len(values) - 1, 8)
        grey = [BLACK | int(v) * 0x010101 for v in values]
        _write_entropy(out, np.array([subtracted(c, b) for c, b in zip(grey, [0, *grey])], np.uint32), len(grey), False)
    else:
        out.write(1 | SUBTRACT_GREEN << 1, 3)
        if kind == PREDICTOR:
            out.write(1 | PREDICTOR << 1 | 7 << 3, 6)  # cells of 512 pixels, all in mode 1
            out.write(0, 1)
            _write_single(out, 1, 0, 0, 255, 0)
    out.write(0, 3)


def encode_grey(frames: list[np.ndarray], width: int) -> list[bytes]:
    """A WebP file of each array of 8-bit samples, whose number is a multiple of ``width``.

    Red, blue and alpha are constant, by the subtract-green transform or the palette, so the green code alone takes
    bits.  A run of one value at the end is a back-reference to the pixel before it; the rest are literals.
    """
    heads, tails, counts, whole, sizes, codes, literals = [], [], [], [], [], [], []
    for samples in frames:
        kind, f, values = grey_plan(samples, width)
        differs = np.flatnonzero(f[::-1] != f[-1])
        run = int(differs[0]) if len(differs) else len(f)  # pixels of the last value at the end
        run = min(run - 1, 4096) if run > 8 else 0
        literal = len(f) - run
        count = np.bincount(f[:literal], minlength=LITERALS + LENGTHS)
        if run:
            s, extra, more = prefix_symbol(run)
            count[LITERALS + s] = 1
        length = lengths_for(count, LANE_BITS)
        code = codes_for(length)
        alone = np.count_nonzero(length) < 2
        out = BitsOut()
        _write_head(out, kind, values, width, len(samples) // width)
        write_code(out, length)
        _write_single(out, 0, 0, 0 if kind == PREDICTOR else 255)
        distance = np.zeros(DISTANCES, np.int64)
        distance[1 if run else 0] = 1  # code 2 is the pixel before
        write_code(out, distance)
        if alone:
            length = np.zeros_like(length)
        heads.append(out)
        tails.append((int(code[LITERALS + s]) | extra << int(length[LITERALS + s]), int(length[LITERALS + s]) + more) if run else (0, 0))
        counts.append(literal)
        whole.append(int(np.bincount(f[:literal], minlength=LITERALS) @ length[:LITERALS]))
        sizes.append(length[:LITERALS].astype(np.uint8))
        codes.append(code[:LITERALS].astype(np.uint16))
        literals.append(f[:literal])
    if not frames:
        return []
    # The literals' bits, many at once: each code adds to two 32-bit words at most.
    head, tail = np.array([h.length() for h in heads], np.int64), np.array([t[1] for t in tails], np.int64)
    whole = np.array(whole, np.int64)
    length = (head + whole + tail + 7) >> 3
    start = np.cumsum(length) - length
    shift = 8 * start + head - (np.cumsum(whole) - whole)
    words = np.zeros((int(length.sum()) >> 2) + 2)
    flat, size_of, code_of_ = np.concatenate(literals), np.concatenate(sizes), np.concatenate(codes)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    done = 0
    for a in range(0, len(flat), TOGETHER):
        part = flat[a : a + TOGETHER]
        own = np.diff(np.clip(bounds, a, a + len(part)))
        index = np.repeat(np.arange(len(frames), dtype=np.int32) * LITERALS, own) + part
        size, value = size_of[index], code_of_[index].astype(np.uint64)
        ends = np.cumsum(size, dtype=np.int64) + done
        done = int(ends[-1])
        at = ends - size + np.repeat(shift, own)
        value <<= (at & 31).astype(np.uint64)
        at >>= 5
        first = int(at[0])
        many = int(at[-1]) - first + 2
        words[first : first + many] += np.bincount(at - first, weights=(value & np.uint64(0xFFFFFFFF)).astype(float), minlength=many)
        words[first + 1 : first + many] += np.bincount(at - first, weights=(value >> np.uint64(32)).astype(float), minlength=many)[:-1]
    data = words.astype("<u4").view(np.uint8)
    out = []
    for k, h in enumerate(heads):
        part = data[start[k] : start[k] + length[k]]
        raw = np.frombuffer(h.bytes(), np.uint8)
        part[: len(raw)] |= raw
        if tails[k][1]:
            where = int(head[k] + whole[k])
            raw = (tails[k][0] << (where & 7)).to_bytes(8, "little")
            last = part[where >> 3 :]
            last |= np.frombuffer(raw, np.uint8)[: len(last)]
        out.append(container(part.tobytes()))
    return out


def decode_grey(files: list[bytes]) -> list[np.ndarray]:
    """The 8-bit samples of the images of grey WebP files (their green channel), in order."""
    images = [(k, Image.read(chunk)) for k, f in enumerate(files) for chunk in contained(f)]
    lanes, out = [], [None] * len(images)
    for k, (_, image) in enumerate(images):
        e = image.entropy
        simple = not e.cache_bits and len(e.groups) == 1 and not any(c.bits for c in e.groups[0][RED : ALPHA + 1]) and e.groups[0][GREEN].bits
        if simple and e.width * e.height < LARGE and e.groups[0][GREEN].bits <= LANE_BITS:
            lanes.append(k)
        elif simple:
            out[k] = _samples(image, _in_blocks(e))
        else:
            out[k] = (image.finished(e.pixels()) >> 8 & 255).astype(np.uint8)
    for k, green in zip(lanes, _in_step([images[k][1] for k in lanes])):
        out[k] = _samples(images[k][1], green)
    parts: list[list[np.ndarray]] = [[] for _ in files]
    for (k, _), o in zip(images, out):
        parts[k].append(o)
    return [p[0] if len(p) == 1 else np.concatenate([*p, np.zeros(0, np.uint8)]) for p in parts]


def _samples(image: Image, green: np.ndarray) -> np.ndarray:
    """A grey image's samples from its coded green values; the other channels' codes have one symbol each."""
    if [t[0] for t in image.transforms] in ([], [SUBTRACT_GREEN]):
        return green
    red, blue, alpha = (c.list[0] >> 4 for c in image.entropy.groups[0][RED : ALPHA + 1])
    pixels = green.astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)
    return (image.finished(pixels) >> 8 & 255).astype(np.uint8)


def _rest(entropy: Entropy, green: np.ndarray, done: int, bit: int) -> None:
    """Fill in the green values from ``done`` on; at ``bit`` of the stream stands something else than a literal."""
    entropy.source.at = bit
    codes = entropy.groups[0]
    length, distance = entropy.reference(codes) if codes[GREEN].list[entropy.source.peek() & ((1 << codes[GREEN].bits) - 1)] >> 4 < LITERALS + LENGTHS else (0, 0)
    if 0 < distance <= done and done + length == len(green):  # it fills the frame
        green[done:] = np.resize(green[done - distance : done], length)
    else:
        entropy.source.at = bit
        red, blue, alpha = (c.list[0] >> 4 for c in codes[RED : ALPHA + 1])
        green[done:] = entropy.pixels((green[:done].astype(np.int64) << 8 | alpha << 24 | red << 16 | blue).tolist())[done:] >> 8 & 255


def _in_blocks(entropy: Entropy) -> np.ndarray:
    """A large image's green values.

    Which bit a code ends at is worked out for every bit of a segment of the stream at once.  The segment is cut into
    blocks; for each of the few bits at which a block's first code can begin, the blocks find in step where their
    last code ends; these maps give every block's true beginning, and from there the blocks are read in step.
    """
    code, data = entropy.groups[0][GREEN], entropy.source.data
    out = np.zeros(entropy.width * entropy.height, np.uint8)
    at, done = entropy.source.at, 0
    while done < len(out):
        if at >= 8 * len(data):
            raise ValueError("the image ends too early")
        part = np.frombuffer(data[at >> 3 : (at >> 3) + SEGMENT + 3].ljust(SEGMENT + 3 if len(data) - (at >> 3) > SEGMENT else len(data) - (at >> 3) + 3, b"\0"), np.uint8).astype(np.uint32)
        words = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        bits = 8 * len(words)
        entry = np.empty(bits, np.uint16)
        for k in range(8):
            entry[k::8] = code.table[words >> np.uint32(k) & np.uint32((1 << code.bits) - 1)]
        step = np.where(entry < LITERALS << 4, entry & 15, 0).astype(np.uint8)
        start = np.arange(at & 7, bits, BLOCK)
        end = np.minimum(start + BLOCK, bits)
        place = (start[:, None] + np.arange(code.bits)).ravel()
        limit = np.repeat(end, code.bits)
        live = np.flatnonzero(place < limit)
        while len(live):
            n = step[place[live]]
            place[live] += n
            live = live[(n > 0) & (place[live] < limit[live])]
        ended = place.reshape(-1, code.bits).tolist()
        begin, first, stopped = [], 0, False
        for k, (s, e) in enumerate(zip(start.tolist(), end.tolist())):
            begin.append(s + first)
            last = ended[k][first]
            if stopped := last < e:
                break
            first = last - e
        place = np.array(begin)
        limit = end[: len(place)]
        found = np.zeros((BLOCK, len(place)), np.uint8)
        n_found = np.zeros(len(place), np.int64)
        live, turn = np.flatnonzero((place < limit) & (step[np.minimum(place, bits - 1)] > 0)), 0
        while len(live):
            p = place[live]
            found[turn, live] = entry[p] >> 4
            n_found[live] += 1
            place[live] = p = p + step[p]
            inside = p < limit[live]
            live = live[inside]
            live = live[step[place[live]] > 0]
            turn += 1
        green = found.T[np.arange(BLOCK) < n_found[:, None]][: len(out) - done]
        out[done : done + len(green)] = green
        done += len(green)
        at = 8 * (at >> 3) + last
        if stopped and done < len(out):
            _rest(entropy, out, done, at)
            break
    return out


def _in_step(images: list[Image]) -> list[np.ndarray]:
    if not images:
        return []
    total = np.array([i.entropy.width * i.entropy.height for i in images])
    order = np.argsort(-total, kind="stable")
    images, total = [images[k] for k in order], total[order]
    chunks = [i.entropy.source.data for i in images]
    data = np.frombuffer(b"".join(chunks) + b"\0\0\0", np.uint8).astype(np.uint32)
    words = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    size = np.array([len(c) for c in chunks])
    greens = [i.entropy.groups[0][GREEN] for i in images]
    table = np.concatenate([np.tile(g.table, 1 << (LANE_BITS - g.bits)) for g in greens])
    at = np.array([i.entropy.source.at for i in images]) + 8 * (np.cumsum(size) - size)
    lane = np.arange(len(images))
    base = lane << LANE_BITS
    begin = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)
    place, left = begin.copy(), total.copy()
    mask = np.uint32((1 << LANE_BITS) - 1)
    last = len(words) - 1
    unfinished = []  # lanes that meet a back-reference: (lane, samples so far, bit)
    step = 0
    while len(lane):
        entry = table[base + (words[np.minimum(at >> 3, last)] >> (at & 7).astype(np.uint32) & mask)]
        if (literal := entry < LITERALS << 4).all():
            out[place] = entry >> 4
            at += entry & 15
        else:
            for k in np.flatnonzero(~literal):
                unfinished.append((int(lane[k]), step, int(at[k])))
            lane, base, at, place, left, entry = (a[literal] for a in (lane, base, at, place, left, entry))
            out[place] = entry >> 4
            at += entry & 15
        step += 1
        place += 1
        alive = np.searchsorted(-left, -step, side="left")  # left falls from lane to lane
        if alive < len(lane):
            lane, base, at, place, left = (a[:alive] for a in (lane, base, at, place, left))
    ends = 8 * (np.cumsum(size) - size)
    for k, done, bit in unfinished:
        _rest(images[k].entropy, out[begin[k] : begin[k] + total[k]], done, bit - int(ends[k]))
    samples = [None] * len(images)
    for k, o in enumerate(order):
        samples[o] = out[begin[k] : begin[k] + total[k]]
    return samples
