"""The reader against streams that use each part of the format, written here bit by bit."""

import random

import numpy as np
import pyarrow as pa

from tapewright.llm import webp


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, bits):
        self.value |= value << self.n
        self.n += bits

    def one(self, symbol):
        """A code of a single symbol, which then takes no bits."""
        self.put(1 | 4 | symbol << 3, 11)

    def flat(self, symbols):
        """A code in which the first symbols, 2 ** k of them, have k bits each."""
        k = symbols.bit_length() - 1
        assert symbols == 1 << k
        self.put(0 | (19 - 4) << 1, 5)
        for x in webp.LENGTH_ORDER:
            self.put(1 if x in (0, k) else 0, 3)
        low, high = sorted((0, k))
        code = {low: 0, high: 1}
        self.put(1, 1)
        self.put(6, 3)
        self.put(symbols - 2, 14)
        for _ in range(symbols):
            self.put(code[k], 1)

    def file(self):
        body = b"\x2f" + self.value.to_bytes((self.n + 7) // 8, "little")
        body += b"\0" * (len(body) & 1)
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body

    def head(self, w, h):
        self.put(w - 1, 14)
        self.put(h - 1, 14)
        self.put(0, 4)

    def literals(self, pixels, main=True):
        """An image of literal pixels with flat codes."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        for _ in range(4):
            self.flat(256)
        self.one(0)
        for p in pixels:
            for shift in (8, 16, 0, 24):
                self.put(int(f"{p >> shift & 255:08b}"[::-1], 2), 8)


def random_pixels(n, seed=1):
    rnd = random.Random(seed)
    return [rnd.getrandbits(32) for _ in range(n)]


def read(writer):
    return webp.read_images([writer.file()])[0]


def test_literals():
    w = Writer()
    w.head(5, 7)
    w.put(0, 1)
    w.literals(p := random_pixels(35))
    assert read(w).ravel().tolist() == p


def test_subtract_green():
    w = Writer()
    w.head(4, 4)
    w.put(1 | webp.GREEN << 1, 3)
    w.put(0, 1)
    w.literals(p := random_pixels(16))
    green = lambda x: x >> 8 & 255
    assert read(w).ravel().tolist() == [x & 0xFF00FF00 | ((x >> 16 & 255) + green(x) & 255) << 16 | (x + green(x) & 255) for x in p]


def test_palette_with_packed_pixels():
    colours = random_pixels(4)
    steps, before = [], 0
    for c in colours:
        steps.append(sum(((c >> s & 255) - (before >> s & 255) & 255) << s for s in (0, 8, 16, 24)))
        before = c
    w = Writer()
    w.head(6, 2)
    w.put(1 | webp.PALETTE << 1, 3)
    w.put(len(colours) - 1, 8)
    w.literals(steps, main=False)
    w.put(0, 1)
    index = [0, 1, 2, 3, 3, 1, 2, 2, 0, 0, 1, 3]
    packed = []
    for row in (index[:6], index[6:]):
        for at in (0, 4):
            packed.append(sum(v << 2 * k for k, v in enumerate(row[at : at + 4])) << 8)
    w.literals(packed)
    assert read(w).ravel().tolist() == [colours[k] for k in index]


def signed(x):
    return x - 256 if x > 127 else x


def test_cross_colour():
    element = 0xFF000000 | 0xE0 << 16 | 0x21 << 8 | 0x9C  # red to blue, green to blue, green to red
    w = Writer()
    w.head(4, 3)
    w.put(1 | webp.CROSS << 1, 3)
    w.put(0, 3)
    w.literals([element], main=False)
    w.put(0, 1)
    w.literals(p := random_pixels(12))
    wanted = []
    for x in p:
        g, r, b = signed(x >> 8 & 255), x >> 16 & 255, x & 255
        r = r + (signed(0x9C) * g >> 5) & 255
        b = b + (signed(0x21) * g >> 5) + (signed(0xE0) * signed(r) >> 5) & 255
        wanted.append(x & 0xFF00FF00 | r << 16 | b)
    assert read(w).ravel().tolist() == wanted


def test_all_predictors():
    width, height = 9, 6
    for mode in range(14):
        w = Writer()
        w.head(width, height)
        w.put(1 | webp.PREDICTOR << 1, 3)
        w.put(0, 3)
        w.literals([mode << 8] * (3 * 2), main=False)
        w.put(0, 1)
        w.literals(p := random_pixels(width * height, mode))
        image = read(w).tolist()
        split = lambda v: [v >> s & 255 for s in (24, 16, 8, 0)]
        half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
        clip = lambda v: max(0, min(255, v))
        for y in range(height):
            for x in range(width):
                rest, own = split(p[y * width + x]), split(image[y][x])
                if x == 0 and y == 0:
                    guess = [255, 0, 0, 0]
                elif y == 0:
                    guess = split(image[0][x - 1])
                elif x == 0:
                    guess = split(image[y - 1][0])
                else:
                    le, t, tl = split(image[y][x - 1]), split(image[y - 1][x]), split(image[y - 1][x - 1])
                    tr = split(image[y - 1][x + 1]) if x + 1 < width else split(image[y][0])
                    near = sum(abs(a + b - c - a) for a, b, c in zip(le, t, tl)) < sum(abs(a + b - c - b) for a, b, c in zip(le, t, tl))
                    guess = [
                        lambda: [255, 0, 0, 0], lambda: le, lambda: t, lambda: tr, lambda: tl, lambda: half(half(le, tr), t), lambda: half(le, tl), lambda: half(le, t), lambda: half(tl, t),
                        lambda: half(t, tr), lambda: half(half(le, tl), half(t, tr)), lambda: le if near else t, lambda: [clip(a + b - c) for a, b, c in zip(le, t, tl)],
                        lambda: [clip(a + int((a - c) / 2)) for a, c in zip(half(le, t), tl)],
                    ][mode]()
                assert own == [(a + b) & 255 for a, b in zip(rest, guess)], (mode, x, y)


def test_cache_references_and_groups():
    """Two groups of codes by rows of blocks; a literal, a cached colour, and a reference to the pixel on the left."""
    w = Writer()
    w.head(4, 8)
    w.put(0, 1)
    w.put(1 | 3 << 1, 5)  # a cache of 8 colours
    w.put(1 | 0 << 1, 4)  # groups by blocks of 4 x 4
    w.literals([0 << 8, 1 << 8], main=False)
    red, blue = 0xFF123400 | 0x77, 0xFF0099AA
    place = (red * webp.CACHE_FACTOR & 0xFFFFFFFF) >> 29

    def green_code(lengths):
        w.put(0 | (19 - 4) << 1, 5)
        used = sorted(set(lengths.values()) | {0})
        for x in webp.LENGTH_ORDER:
            w.put({0: 1, 18: 2, 2: 2}.get(x, 0) if used == [0, 2] else {0: 1, 18: 2, 1: 2}.get(x, 0), 3)
        w.put(0, 1)
        own = max(used)
        code = {0: (0, 1), own: (1, 2), 18: (3, 2)}  # lengths 1, 2, 2: codes 0, 10, 11, first bit lowest
        at = 0
        for s in [*sorted(lengths), 256 + 24 + 8]:
            while s - at >= 11:
                some = min(s - at, 138)
                w.put(*code[18])
                w.put(some - 11, 7)
                at += some
            for _ in range(s - at):
                w.put(*code[0])
            at = s
            if s in lengths:
                w.put(*code[own])
                at += 1

    symbols = [0x34, 0x99, 256 + 2, 280 + place]  # two literals, length 3, the cached colour
    green_code({s: 2 for s in symbols})
    w.one(0x12)
    w.one(0x77)
    w.one(255)
    w.one(1)  # distance code 2: one pixel to the left
    green_code({0x99: 1, 280 + place: 1})
    w.one(0)
    w.one(0xAA)
    w.one(255)
    w.one(0)
    first = {s: (int(f"{k:02b}"[::-1], 2), 2) for k, s in enumerate(sorted(symbols))}
    for s in (0x34, 258, 280 + place, 0x34, 258, 0x34, 258, *[280 + place] * 3):
        w.put(*first[s])
    second = {s: (k, 1) for k, s in enumerate(sorted([0x99, 280 + place]))}
    for k in range(16):
        w.put(*second[0x99 if k % 2 else 280 + place])
    got = read(w)
    assert got[:4].ravel().tolist() == [red] * 16
    assert got[4:].ravel().tolist() == [blue if k % 2 else red for k in range(16)]


def test_column_of_pixels(spark):
    w = Writer()
    w.head(3, 2)
    w.put(0, 1)
    w.literals(p := random_pixels(6))
    files = spark.createDataFrame([(1, bytearray(w.file())), (2, None)], "id long, media binary")
    rows = {r.id: r for r in webp.pixels(files).collect()}
    assert (rows[1].width, rows[1].height, rows[1].pixels) == (3, 2, p) and rows[2].pixels is None


def test_writer_uses_the_palette_and_references():
    media, _ = webp.stored(pa.array(["ab" * 400 + "a" * 900]))
    _, _, transforms, width, height = webp.read_header(media[0])
    assert [t[0] for t in transforms] == [webp.PALETTE] and (width, height) == (576, 3)
    assert len(media[0]) < 400
    assert np.array_equal(webp.read_back(media)[0][:800:2], np.full(400, ord("a"), np.uint8))


def test_pixels_of_a_text_in_several_images(spark):
    texts = {1: "several images " * 2000, 2: "short", 3: ""}
    one = webp.stored(pa.array(["x" * 600]))[0][0]
    w = Writer()
    w.head(3, 2)
    w.put(0, 1)
    w.literals(p := random_pixels(6))
    files = webp.store(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    files = files.unionByName(spark.createDataFrame([(4, bytearray(one + w.file())), (5, None)], "doc_id long, media binary"))
    rows = {r.doc_id: r for r in webp.pixels(files).collect()}
    for i, text in texts.items():
        data = text.encode()
        lines = max(1, -(-len(data) // webp.WIDTH))
        assert (rows[i].width, rows[i].height) == (webp.WIDTH, lines)
        assert bytes(x >> 8 & 255 for x in rows[i].pixels) == data + b"\xff" * (lines * webp.WIDTH - len(data))
    assert [s.height for s in rows[1].sizes] == [16, 16, 16, 5]
    assert rows[4].width is None and rows[4].pixels[-6:] == p and [tuple(s) for s in rows[4].sizes] == [(webp.WIDTH, 2), (3, 2)]
    assert rows[5].pixels is None and rows[5].sizes is None
