"""Lossless WebP (VP8L) columns: reading images into pixel arrays, and storing bytes as images.

The reader takes any VP8L stream: prefix codes in up to many groups, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. The pixel streams of all images of a batch are decoded side by
side, a symbol of each at every step, as a single stream can only be read in order. The writer puts a byte in the green sample of each pixel, codes runs as
back-references, uses the palette transform where an image has at most 16 different bytes, and optimal prefix codes.

Defined cases: null text is empty; a payload has 576 bytes at least; long payloads are several images of ROWS rows, files
in a row. A broken file raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import lean, read_table, small_batches, text_bytes

WIDTH, ROWS = 576, 16
LEAST_RUN, MOST_RUN = 12, 4096
LONGEST = 15

# Fixed values of the format: order of the lengths of the code length code; near distances as (columns to the left, rows up).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3

_U = np.uint64


# ---- prefix codes ----------------------------------------------------------------------------------------------------


def bit_reversed(bits: int) -> np.ndarray:
    if bits not in _REVERSED:
        x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out |= ((x >> k) & 1) << (bits - 1 - k)
        _REVERSED[bits] = out
    return _REVERSED[bits]


_REVERSED: dict[int, np.ndarray] = {}


def lookup(lengths: np.ndarray) -> np.ndarray:
    """symbol * 16 + length for all values of the next bits, as many as the longest code; one symbol alone takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return np.array([(int(used[0]) if len(used) else 0) << 4], np.uint32)
    size = lengths[used]
    longest = int(size.max())
    order = np.argsort(size, kind="stable")
    times = 1 << (longest - size[order])
    if times.sum() != 1 << longest:
        raise ValueError("prefix code isn't complete")
    return np.repeat((used[order] << 4 | size[order]).astype(np.uint32), times)[bit_reversed(longest)]


def huffman_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code; of at most LONGEST bits, by flattening the counts where it would be longer."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        n = len(weights)
        heap, up, at = [(w, i) for i, w in enumerate(weights)], [0] * (2 * n - 1), n
        heapq.heapify(heap)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = at
            heapq.heapreplace(heap, (a + b, at))
            at += 1
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[:n]) <= LONGEST:
            lengths[used] = depth[:n]
            return lengths
        weights = [(w + 1) // 2 for w in weights]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with the first bit lowest, as they are written."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order]
        step = 1 << (LONGEST - size)
        code = np.cumsum(step) - step
        out[order] = bit_reversed(LONGEST)[code]
    return out


# ---- reading ---------------------------------------------------------------------------------------------------------


class Bits:
    """Single bits of a file, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > 8 * len(self.data):
            raise ValueError("file ends early")
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def symbol(self, table: np.ndarray) -> int:
        if len(table) == 1:
            return int(table[0]) >> 4
        byte = self.at >> 3
        entry = int(table[(int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7)) & (len(table) - 1)])
        self.at += entry & 15
        return entry >> 4


def read_code(bits: Bits, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.int64)
    if bits.take(1):  # one or two symbols
        two = bits.take(1)
        symbols = [bits.take(8 if bits.take(1) else 1)] + ([bits.take(8)] if two else [])
        lengths[symbols] = 1
        return lookup(lengths)
    own = np.zeros(19, np.int64)
    for k in range(4 + bits.take(4)):
        own[LENGTH_ORDER[k]] = bits.take(3)
    table, left = lookup(own), size
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        value = bits.symbol(table)
        if value < 16:
            lengths[at] = value
            last = value or last
            at += 1
        else:
            times = 3 + bits.take(2) if value == 16 else 3 + bits.take(3) if value == 17 else 11 + bits.take(7)
            if at + times > size:
                raise ValueError("code lengths run over")
            lengths[at : at + times] = last if value == 16 else 0
            at += times
    return lookup(lengths)


def from_prefix(symbol: int, bits: Bits) -> int:
    """Value of a length or distance symbol with its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


class Stream:
    """What comes before the pixels of one entropy-coded image: cache size, groups of codes, and which group holds where."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.width, self.height = width, height
        self.cache_bits = bits.take(4) if bits.take(1) else 0
        self.group_bits, self.groups_of = 0, None
        n = 1
        if main and bits.take(1):
            self.group_bits = bits.take(3) + 2
            w, h = -(-width >> self.group_bits), -(-height >> self.group_bits)
            w, h = (width + (1 << self.group_bits) - 1) >> self.group_bits, (height + (1 << self.group_bits) - 1) >> self.group_bits
            own = Stream(bits, w, h, False)
            self.groups_of = ((decode_alone(bits, own) >> 8) & 0xFFFF).astype(np.int64).reshape(h, w)
            n = int(self.groups_of.max()) + 1
        sizes = (LITERALS + LENGTH_CODES + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
        self.groups = [[read_code(bits, s) for s in sizes] for _ in range(n)]


def decode_alone(bits: Bits, stream: Stream) -> np.ndarray:
    """Pixels of a small image, as the transforms and the groups have them."""
    out, at = decode_together([(bits, stream)])
    bits.at = at[0]
    return out[0]


def decode_together(images: list[tuple[Bits, Stream]]) -> tuple[list[np.ndarray], list[int]]:
    """Pixels of all images and the bit each ends at: at every step each image that isn't done reads a symbol."""
    lanes = len(images)
    sizes = np.array([s.width * s.height for _, s in images], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # a spare place behind each image
    out = np.zeros(int(sizes.sum()) + lanes, np.uint32)
    files, base = [], np.zeros(lanes, np.int64)
    for k, (bits, _) in enumerate(images):
        base[k] = 8 * sum(map(len, files[-1:])) + (base[k - 1] if k else 0)
        files.append(bits.data)
    data = np.frombuffer(b"".join(files) + bytes(4096), np.uint8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    tables, offset, first, total = [], [], np.zeros(lanes, np.int64), 0
    plain = True
    for k, (_, s) in enumerate(images):
        first[k] = len(offset) // 5
        for group in s.groups:
            for table in group:
                offset.append(total)
                tables.append(table)
                total += len(table)
        plain &= not s.cache_bits and s.groups_of is None and all(len(t) == 1 for t in s.groups[0][1:4])
    offsets, masks = np.array(offset, np.int64).reshape(-1, 5), np.array([len(t) - 1 for t in tables], np.int64).reshape(-1, 5)
    every = np.concatenate(tables).astype(np.int64)
    constant = (every[offsets[:, 3]] >> 4 << 24 | every[offsets[:, 1]] >> 4 << 16 | every[offsets[:, 2]] >> 4).astype(np.int64)
    caches = [np.zeros(1 << s.cache_bits, np.uint32) if s.cache_bits else None for _, s in images]

    at = base + np.array([b.at for b, _ in images], np.int64)
    lane, place, end, group = np.arange(lanes), ends - sizes, ends.copy(), first.copy()
    start = (ends - sizes).tolist()
    finish = np.zeros(lanes, np.int64)
    limit = 8 * len(data) - 64

    def symbols(which: np.ndarray, kind: int) -> np.ndarray:
        """Next symbols of a kind for some of the lanes; moves them on."""
        g = group[which]
        entry = every[offsets[g, kind] + ((words[at[which] >> 3] >> (at[which] & 7).astype(_U)).astype(np.int64) & masks[g, kind])]
        at[which] += entry & 15
        return entry >> 4

    step = 0
    table_at, mask, filler = offsets[group, 0], masks[group, 0], constant[group]
    while len(lane):
        if not plain:
            for k, x in enumerate(lane.tolist()):
                s = images[x][1]
                if s.groups_of is not None and place[k] < end[k]:
                    y, col = divmod(int(place[k]) - start[x], s.width)
                    group[k] = first[x] + s.groups_of[y >> s.group_bits, col >> s.group_bits]
            table_at, mask, filler = offsets[group, 0], masks[group, 0], constant[group]
        entry = every[table_at + ((words[at >> 3] >> (at & 7).astype(_U)).astype(np.int64) & mask)]
        at += entry & 15
        symbol = entry >> 4
        if plain:
            pixel = filler | symbol << 8
        else:
            pixel = np.zeros(len(lane), np.int64)
            literal = np.flatnonzero((symbol < LITERALS) & (place < end))
            red, blue, alpha = (symbols(literal, k) for k in (1, 2, 3))
            pixel[literal] = alpha << 24 | red << 16 | symbol[literal] << 8 | blue
        special = np.flatnonzero((symbol >= LITERALS) & (place < end)) if symbol.max() >= LITERALS else ()
        out[place] = pixel
        moved = np.ones(len(lane), np.int64)
        for k in map(int, special):
            x, code = int(lane[k]), int(symbol[k])
            bits, s = images[x]
            if code >= LITERALS + LENGTH_CODES:
                out[place[k]] = caches[x][code - LITERALS - LENGTH_CODES]
                continue
            reader = Bits(bits.data, int(at[k] - base[x]))
            length = from_prefix(code - LITERALS, reader)
            at[k] = base[x] + reader.at
            mark = int(symbols(np.array([k]), 4)[0])
            reader.at = int(at[k] - base[x])
            back = distance_of(from_prefix(mark, reader), s.width)
            at[k] = base[x] + reader.at
            p = int(place[k])
            if p - back < start[x] or p + length > end[k]:
                raise ValueError("back-reference leaves the image")
            out[p : p + length] = out[p - back : p - back + length] if back >= length else np.resize(out[p - back : p], length)
            moved[k] = length
        if not plain:
            for k, x in enumerate(lane.tolist()):
                if caches[x] is not None and place[k] < end[k]:
                    new = out[place[k] : place[k] + moved[k]]
                    caches[x][(new * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - images[x][1].cache_bits)] = new
        done = place + moved >= end
        place = np.minimum(place + moved, end)
        step += 1
        if done.any():
            just = done & (finish[lane] == 0)
            finish[lane[just]] = at[just]
            if step % 32 == 0 or done.all() or not plain:
                left = ~done
                lane, at, place, end, group = lane[left], at[left], place[left], end[left], group[left]
                table_at, mask, filler = table_at[left], mask[left], filler[left]
        if len(at) and at.max() > limit:
            raise ValueError("file ends early")
    bound = [8 * len(b.data) for b, _ in images]
    if any(f - b > n for f, b, n in zip(finish.tolist(), base.tolist(), bound)):
        raise ValueError("file ends early")
    return [out[a : a + n] for a, n in zip(start, sizes.tolist())], (finish - base).tolist()


def read_header(data: bytes) -> tuple[Bits, Stream, list[tuple], int, int]:
    """Opens a file: its bits, the main stream, the transforms in the order they were applied, width and height."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    transforms, inner = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS):
            size = bits.take(3) + 2
            w, h = (inner + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            transforms.append((kind, size, decode_alone(bits, Stream(bits, w, h, False)).reshape(h, w)))
        elif kind == PALETTE:
            n = bits.take(8) + 1
            colours = decode_alone(bits, Stream(bits, n, 1, False))
            colours = np.cumsum(colours.view(np.uint8).reshape(n, 4), 0, dtype=np.uint8).view(np.uint32).ravel()
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, pack, colours, inner))
            inner = (inner + (1 << pack) - 1) >> pack
        else:
            transforms.append((GREEN,))
    return bits, Stream(bits, inner, height, True), transforms, width, height


def inverted(pixels: np.ndarray, transforms: list[tuple], height: int) -> np.ndarray:
    """Undoes the transforms, the last first."""
    image = pixels.reshape(height, -1)
    for kind, *rest in reversed(transforms):
        if kind == GREEN:
            parts = image.copy().view(np.uint8).reshape(*image.shape, 4)
            parts[..., 0] += parts[..., 1]
            parts[..., 2] += parts[..., 1]
            image = parts.view(np.uint32)[..., 0]
        elif kind == PALETTE:
            pack, colours, width = rest
            index = (image >> 8) & 0xFF
            if pack:
                bits = 8 >> pack
                each = [(index >> (bits * k)) & ((1 << bits) - 1) for k in range(1 << pack)]
                index = np.stack(each, -1).reshape(height, -1)[:, :width]
            known = np.zeros(256, np.uint32)
            known[: len(colours)] = colours
            image = known[index]
        elif kind == CROSS:
            image = without_cross(image, *rest)
        else:
            image = without_prediction(image, *rest)
    return image


def without_cross(image: np.ndarray, size: int, elements: np.ndarray) -> np.ndarray:
    h, w = image.shape
    element = elements[np.ix_(np.arange(h) >> size, np.arange(w) >> size)]
    signed = lambda x: (x & 0xFF).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(image >> 8), image >> 16 & 0xFF, image & 0xFF
    to_red, to_blue, red_to_blue = signed(element), signed(element >> 8), signed(element >> 16)
    red = (red.astype(np.int32) + (to_red * green >> 5)) & 0xFF
    blue = (blue.astype(np.int32) + (to_blue * green >> 5) + (red_to_blue * signed(red) >> 5)) & 0xFF
    return (image & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def predicted(mode: int, left: tuple, up: tuple, up_left: tuple, up_right: tuple) -> tuple:
    """One pixel's prediction from its neighbours, each of four samples."""
    mean = lambda a, b: tuple((x + y) >> 1 for x, y in zip(a, b))
    if mode == 11:
        to_left = sum(abs(u - x) for u, x in zip(up, up_left))
        to_up = sum(abs(x - y) for x, y in zip(left, up_left))
        return left if to_left < to_up else up
    if mode == 12:
        return tuple(min(255, max(0, a + b - c)) for a, b, c in zip(left, up, up_left))
    if mode == 13:
        return tuple(min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(left, up), up_left))
    if mode == 5:
        return mean(mean(left, up_right), up)
    if mode == 10:
        return mean(mean(left, up_left), mean(up, up_right))
    simple = {1: left, 2: up, 3: up_right, 4: up_left}
    if mode in simple:
        return simple[mode]
    pairs = {6: (left, up_left), 7: (left, up), 8: (up_left, up), 9: (up, up_right)}
    return mean(*pairs[mode]) if mode in pairs else (0, 0, 0, 255)


def without_prediction(image: np.ndarray, size: int, modes: np.ndarray) -> np.ndarray:
    h, w = image.shape
    rest = image.copy().view(np.uint8).reshape(h, w, 4).tolist()
    kinds = (modes >> 8 & 0xF).tolist()
    for y in range(h):
        row, above = rest[y], rest[y - 1]
        for x in range(w):
            if y == 0:
                guess = row[x - 1] if x else (0, 0, 0, 255)
            elif x == 0:
                guess = above[0]
            else:
                right = above[x + 1] if x + 1 < w else row[0]  # beside the last column comes the row's own first pixel
                guess = predicted(kinds[y >> size][x >> size], row[x - 1], above[x], above[x - 1], right)
            row[x] = [(a + b) & 0xFF for a, b in zip(row[x], guess)]
    return np.array(rest, np.uint8).view(np.uint32)[..., 0]


def read_images(files: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays (height, width) of ARGB words of all files."""
    heads = [read_header(f) for f in files]
    pixels, _ = decode_together([(h[0], h[1]) for h in heads]) if heads else ([], [])
    return [inverted(p, h[2], h[4]) for p, h in zip(pixels, heads)]


# ---- writing ---------------------------------------------------------------------------------------------------------


def code_items(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(value, bits) that write a code: simple if it has one symbol under 256, else by lengths under a fixed code for them."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256):
        return [(1 | 4 | (used[0] if used else 0) << 3, 11)]
    items = [(0 | 15 << 1, 5), *[(_LENGTH_BITS[k], 3) for k in LENGTH_ORDER], (0, 1)]
    at = 0
    for k in [*used, len(lengths)]:
        while (gap := k - at) > 0:
            if gap >= 11:
                some = min(gap, 138)
                items += [_LENGTH_CODE[18], (some - 11, 7)]
            elif gap >= 3:
                some = gap
                items += [_LENGTH_CODE[17], (some - 3, 3)]
            else:
                some = gap
                items += [_LENGTH_CODE[0]] * gap
            at += some
        if k < len(lengths):
            items.append(_LENGTH_CODE[int(lengths[k])])
            at += 1
    return items


_LENGTH_BITS = np.array([4] * 13 + [5] * 6)[[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 14, 15, 16, 17, 18, 10, 11, 12]].tolist()
_LENGTH_CODE = [(int(c) & ((1 << n) - 1), n) for c, n in zip(codes_of(np.array(_LENGTH_BITS)), _LENGTH_BITS)]


def palette_items(values: np.ndarray) -> list[tuple[int, int]]:
    """The palette transform for these bytes: flat codes for green, 0 or 255 for alpha, differences as pixels."""
    one_length = [(0 | (12 - 4) << 1, 5), *[(1 if k == 8 else 0, 3) for k in LENGTH_ORDER[:12]], (1, 1), (3, 3), (254, 8)]
    items = [(1, 1), (PALETTE, 2), (len(values) - 1, 8), (0, 1), *one_length, (1 | 4, 11), (1 | 4, 11), (1 | 2 | 4 | 0 << 3 | 255 << 11, 19), (1 | 4, 11)]
    turned = bit_reversed(8)
    for k, step in enumerate(np.diff(values, prepend=0) & 0xFF):
        items += [(int(turned[step]), 8), (1 if k == 0 else 0, 1)]
    return items


def write_images(raw: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A file for each stretch of raw, whose lengths are multiples of WIDTH."""
    lanes, heights = len(bounds) - 1, np.diff(bounds) // WIDTH
    if not lanes:
        return []
    lane = np.repeat(np.arange(lanes), np.diff(bounds))
    present = np.bincount(lane * 256 + raw, minlength=256 * lanes).reshape(lanes, 256) > 0
    few = np.flatnonzero(present.sum(1) <= 16)
    heads: list[list[tuple[int, int]]] = [[] for _ in range(lanes)]
    if len(few):  # palette: several pixels in one
        parts, sizes = np.split(raw, bounds[1:-1]), np.diff(bounds)
        for k in few.tolist():
            values = np.flatnonzero(present[k])
            heads[k] = palette_items(values)
            pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
            index = np.searchsorted(values, parts[k]).reshape(-1, 1 << pack)
            parts[k] = (index << ((8 >> pack) * np.arange(1 << pack))).sum(1).astype(np.uint8)
            sizes[k] = len(parts[k])
        raw, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        lane = np.repeat(np.arange(lanes), sizes)

    same = np.zeros(len(raw) + 1, np.int8)
    same[1:-1] = raw[1:] == raw[:-1]
    same[bounds] = 0
    turn = np.diff(np.concatenate([[0], same]).astype(np.int8))
    begin, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = stop - begin >= LEAST_RUN
    begin, stop = begin[long], stop[long]
    times = -(-(stop - begin) // MOST_RUN)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    begin = np.repeat(begin, times) + nth * MOST_RUN
    length = np.minimum(np.repeat(stop, times) - begin, MOST_RUN)
    covered = np.zeros(len(raw) + 1, np.int64)
    covered[begin] += 1
    np.add.at(covered, begin + length, -1)
    token = np.cumsum(covered[:-1]) == 0
    token[begin] = True
    token = np.flatnonzero(token)
    symbol, extra, extra_bits = raw[token].astype(np.int64), np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
    at, v = np.searchsorted(token, begin), length - 1
    high = np.floor(np.log2(v)).astype(np.int64)
    symbol[at], extra_bits[at] = LITERALS + 2 * high + ((v >> (high - 1)) & 1), high - 1
    extra[at] = v & ((1 << (high - 1)) - 1)

    size, own = LITERALS + LENGTH_CODES, lane[token]
    counts = np.bincount(own * size + symbol, minlength=size * lanes).reshape(lanes, size)
    codes, lengths = np.zeros((lanes, size), np.int64), np.zeros((lanes, size), np.int64)
    for k in range(lanes):
        found = huffman_lengths(counts[k])
        written = code_items(found)
        if np.count_nonzero(found) > 1:
            lengths[k] = found
            codes[k] = codes_of(found)
        opaque = (1 | 4 | 255 << 3, 11)
        heads[k] = [(WIDTH - 1, 14), (int(heights[k]) - 1, 14), (0, 4), *heads[k], (0, 1), (0, 1), (0, 1), *written, (1 | 4, 11), (1 | 4, 11), opaque, (1 | 4 | 1 << 3, 11)]
    head_sizes = np.array([len(h) for h in heads])
    values = np.array([v for h in heads for v, _ in h], np.int64)
    widths = np.array([n for h in heads for _, n in h], np.int64)
    body_bits = lengths[own, symbol]
    body = codes[own, symbol] | extra << body_bits

    # items of all files in order: the head, then the tokens of each
    order = np.argsort(np.concatenate([np.repeat(np.arange(lanes), head_sizes), own]), kind="stable")
    values, widths = np.concatenate([values, body])[order], np.concatenate([widths, body_bits + extra_bits])[order]
    item_lane = np.concatenate([np.repeat(np.arange(lanes), head_sizes), own])[order]
    bits = np.bincount(item_lane, widths, lanes).astype(np.int64)
    words = (bits + 31) // 32
    first_word = np.cumsum(words) - words
    ends = np.cumsum(widths)
    begin = ends - widths - np.repeat(np.cumsum(bits) - bits, np.bincount(item_lane, minlength=lanes)) + 32 * first_word[item_lane]
    shifted = values.astype(_U) << (begin & 31).astype(_U)
    word = begin >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums = np.add.reduceat(shifted, first)
    out = np.zeros(int(words.sum()) + 1, _U)
    out[word[first]] += sums & _U(0xFFFFFFFF)
    out[word[first] + 1] += sums >> _U(32)
    data = out.astype("<u4").tobytes()
    files = []
    for a, n, b in zip((4 * first_word).tolist(), (4 * words).tolist(), bits.tolist()):
        body_bytes = b"\x2f" + data[a : a + (b + 7) // 8]
        padded = body_bytes + b"\0" * (len(body_bytes) & 1)
        files.append(b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body_bytes).to_bytes(4, "little") + padded)
    return files


# ---- columns ---------------------------------------------------------------------------------------------------------


def payloads(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes followed by bytes 255 up to a positive multiple of WIDTH."""
    sizes = np.diff(offsets)
    padded = np.maximum(1, -(-sizes // WIDTH)) * WIDTH
    bounds = np.concatenate([[0], np.cumsum(padded)])
    out = np.full(int(bounds[-1]), 255, np.uint8)
    out[np.arange(len(raw)) + np.repeat(bounds[:-1] - offsets[:-1], sizes)] = raw
    return out, bounds


def stored(batch_text: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The stored form of every text, and the lengths of the texts in bytes."""
    raw, offsets = text_bytes(batch_text)
    data, bounds = payloads(raw, offsets)
    times = -(-np.diff(bounds) // (WIDTH * ROWS))
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    cuts = np.concatenate([np.repeat(bounds[:-1], times) + nth * WIDTH * ROWS, bounds[-1:]])
    files, at = write_images(data, cuts), np.concatenate([[0], np.cumsum(times)]).tolist()
    return [b"".join(files[a:b]) for a, b in zip(at, at[1:])], np.diff(offsets)


def split_files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def read_back(media: list[bytes]) -> list[np.ndarray]:
    """The green samples of all images of every stored form, in a row."""
    files = [split_files(m) for m in media]
    images = read_images([f for some in files for f in some])
    at = np.concatenate([[0], np.cumsum([len(f) for f in files])]).tolist()
    return [np.concatenate([(x >> 8).astype(np.uint8).ravel() for x in images[a:b]]) for a, b in zip(at, at[1:])]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and a histogram of 16 bins of the samples, in 1/255."""
    shares = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    return f"{samples.mean():.3f};{samples.std():.3f};" + bytes(shares.astype(np.uint8)).hex()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, most=4 << 20):
        media, sizes = stored(batch.column("text"))
        back = read_back(media)
        data = [x.tobytes() for x in back]
        columns = [
            batch.column("doc_id"),
            pa.array(sizes.astype(np.int64)),
            pa.array([len(x) for x in data], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in data]),
            pa.array([zlib.crc32(x[-32:]) for x in data], pa.int64()),
            pa.array([len(x) for x in media], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in media]),
            pa.array([feature_of(x) for x in back]),
        ]
        yield pa.record_batch(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id and media: every text as lossless WebP."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=4 << 20):
            yield pa.record_batch([batch.column("doc_id"), pa.array(stored(batch.column("text"))[0], pa.binary())], ["doc_id", "media"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, media binary")


def pixels(files: DataFrame, media="media") -> DataFrame:
    """Adds width, height and pixels (ARGB words as array<long>) of all images of each value of a binary column, one below the other,
    and sizes, the width and height of each image; null stays null. Where widths differ, width and height are null. Columns of these names are replaced."""
    kinds = (("width", "int"), ("height", "int"), ("pixels", "array<bigint>"), ("sizes", "array<struct<width:int,height:int>>"))
    files = files.drop(*[c for c, _ in kinds if c != media])
    names = files.columns
    schema = files.withColumns({c: F.lit(None).cast(k) for c, k in kinds}).schema
    size = pa.struct([("width", pa.int32()), ("height", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, media):
            found = [split_files(m) if m else None for m in batch.column(names.index(media)).to_pylist()]
            images = iter(read_images([f for some in found if some for f in some]))
            images = [[next(images) for _ in some] if some else None for some in found]
            same = [x is not None and len({i.shape[1] for i in x}) == 1 for x in images]
            columns = [
                pa.array([x[0].shape[1] if one else None for x, one in zip(images, same)], pa.int32()),
                pa.array([sum(i.shape[0] for i in x) if one else None for x, one in zip(images, same)], pa.int32()),
                pa.array([None if x is None else np.concatenate([i.ravel() for i in x]).astype(np.int64) for x in images], pa.list_(pa.int64())),
                pa.array([None if x is None else [{"width": i.shape[1], "height": i.shape[0]} for i in x] for x in images], pa.list_(size)),
            ]
            yield pa.record_batch([*batch.columns, *columns], schema.names)

    return files.mapInArrow(lean(run), schema)


def op4_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.mapInArrow(lean(digests), schema)


QUERIES = {"op4_lossless_webp": op4_lossless_webp}
