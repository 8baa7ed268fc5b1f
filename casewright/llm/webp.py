"""Lossless WebP (VP8L) images in pure numpy: a decoder of the whole format, and an encoder for 8-bit samples.

The decoder reads prefix codes (simple and normal, with groups chosen by an entropy image), back-references with the
two-dimensional short distances, the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
Where an image has one code group, symbols are found for all bit positions at once and the positions in use are followed by
jumps; with an entropy image pixels are decoded one by one. Pixels are ARGB in uint32.

The encoder stores samples in the green channel, in images of 64 pixels' width; payloads above 1 MiB become several images one
after another. A palette packs samples of few values, a predictor (the left or the upper neighbour) is taken where its residuals have
less entropy, and repeated runs become back-references where that makes the image smaller. A colour cache or cross-colour transform can't pay
for a single channel, as a cache symbol costs what the literal does; the decoder reads them.

Defined results: null and empty texts are 64 zero bytes; equal payloads give equal files; broken files raise ``ValueError``.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, MAX_ROWS = 64, 16_384

# Fixed values of the format: the order of code length codes, the places of short distances, and the alphabets' sizes.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
LENGTH_RANK = {s: k for k, s in enumerate(LENGTH_ORDER)}
PREFIXES, GREEN, CHANNEL, DISTANCES, SHORT_DISTANCES = 24, 256, 256, 40, 120
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: The encoder's repeats: bytes that show one, the longest, and the farthest that a distance code can name.
SEED, MOST_LONG, MOST_FAR = 8, 4096, (1 << 20) - SHORT_DISTANCES
#: Zero bytes after the data, so that the last symbols can be looked up like the others.
TAIL = 128
#: Bytes whose symbols are looked up at once.
CHUNK = 1 << 12
#: Bits that eight symbols can't exceed: codes of 15 bits, and 18 more for a length and a distance.
EIGHT = 8 * (4 * 15 + 2 * 18)


def short_distances() -> list[tuple[int, int]]:
    """(x, y) of the distance codes 1 to 120: nearest first; of equally near ones the least aside first, and right before left."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


NEAR = short_distances()


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(TAIL), 0, 8 * len(data)

    def read(self, n: int) -> int:
        """The next bits, 57 at most."""
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("image data cut short")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)


@functools.lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """The numbers of that many bits, read backwards."""
    out = np.zeros(1, dtype=np.intp)
    for k in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def _canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols in the order of their canonical codes, their lengths, where their codes begin among those of the longest length, and that length."""
    keyed = np.array(sorted([n << 16 | s for s, n in lengths.items()]), dtype=np.intp)
    symbols, sizes = keyed & 0xFFFF, keyed >> 16
    longest = int(sizes[-1])
    spans = 1 << (longest - sizes)
    return symbols, sizes, spans.cumsum() - spans, longest


@functools.lru_cache(maxsize=16)
def _reversed_list(bits: int) -> list[int]:
    return _reversed(bits).tolist()


def _small_table(lengths: dict[int, int]) -> list[tuple[int, int]]:
    """The table of a code of few symbols, as (symbol, length); a symbol alone takes no bits."""
    if len(lengths) == 1:
        return [(next(iter(lengths)), 0)]
    longest = max(lengths.values(), default=0)
    back, size, start = _reversed_list(longest), 1 << longest, 0
    table = [(0, 0)] * size
    for n, s in sorted((n, s) for s, n in lengths.items()):
        span = size >> n
        if start + span > size:
            break
        table[back[start] :: 1 << n] = [(s, n)] * span
        start += span
    else:
        if start == size and lengths:
            return table
    raise ValueError("prefix code isn't complete")


class Code:
    """A prefix code as a table over the next ``bits`` bits: the symbol, and its length above bit 16."""

    def __init__(self, lengths: dict[int, int]):
        if not lengths:
            raise ValueError("prefix code without symbols")
        self.only, self.bits, self.table = (next(iter(lengths)), 0, None) if len(lengths) == 1 else (None, 0, None)
        self.largest = max(lengths)
        if self.only is not None:
            return
        keyed = sorted([(n << 16) + s for s, n in lengths.items()])
        self.bits = longest = keyed[-1] >> 16
        table = np.array(keyed, dtype=np.intp).repeat([1 << longest - (x >> 16) for x in keyed])
        if len(table) != 1 << self.bits:
            raise ValueError("prefix code isn't complete")
        self.table = table.take(_reversed(self.bits))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        at = bits.at
        found = int(self.table[int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << self.bits) - 1)])
        bits.at = at = at + (found >> 16)
        if at > bits.end:
            raise ValueError("image data cut short")
        return found & 0xFFFF


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two_wide = bits.read(2)
        first = bits.read(8 if two_wide & 2 else 1)
        symbols = [first, bits.read(8)] if two_wide & 1 else [first]
        if max(symbols) >= alphabet:
            raise ValueError("symbol outside its alphabet")
        return Code(dict.fromkeys(symbols, 1))
    order = LENGTH_ORDER[: 4 + bits.read(4)]
    word = bits.read(3 * len(order))
    table = _small_table({s: n for k, s in enumerate(order) if (n := word >> 3 * k & 7)})
    mask = len(table) - 1
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths: dict[int, int] = {}
    at, previous, data, place = 0, 8, bits.data, bits.at
    word = have = 0
    while at < alphabet and left and place < bits.end:
        left -= 1
        if have < 14:  # the most that a length takes, with its repeats
            word, have = int.from_bytes(data[place >> 3 : (place >> 3) + 8], "little") >> (place & 7), 64 - (place & 7)
        s, n = table[word & mask]
        if s < 16:
            word >>= n
            have -= n
            place += n
            if s:
                lengths[at] = previous = s
            at += 1
            continue
        more, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        times = least + (word >> n & ((1 << more) - 1))
        n += more
        word >>= n
        have -= n
        place += n
        if at + times > alphabet:
            raise ValueError("too many code lengths")
        if s == 16:
            lengths.update(dict.fromkeys(range(at, at + times), previous))
        at += times
    bits.at = place
    if place > bits.end:
        raise ValueError("image data cut short")
    return Code(lengths)


def _extra(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _far(code: int, width: int) -> int:
    if code > SHORT_DISTANCES:
        return code - SHORT_DISTANCES
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Extra bits and first value of each length and distance prefix.
EXTRA_BITS = np.array([0, 0, 0, 0, *((p - 2) >> 1 for p in range(4, DISTANCES))])
EXTRA_BASE = np.array([1, 2, 3, 4, *(((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(4, DISTANCES))])


def _symbols(bits: Bits, codes: list[Code], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of one code group from here on, some thousands at once: green symbol, pixel (of literals), length, distance code."""
    first = bits.at >> 3
    # the next 32 bits from each byte on, which overlap, and from them, from each bit on, as many as the longest code has
    words = np.ndarray((min(len(bits.data) - first, CHUNK) - 3,), "<u4", bits.data, first, (1,)).astype(np.intp)
    n, most_bits = 8 * len(words), max(code.bits for code in codes)
    index = words.repeat(8)
    index >>= _places_in_bytes()[:n]
    index &= (1 << most_bits) - 1

    def look(code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if code.only is not None:
            return np.full(len(at), code.only), at
        found = code.table.take(index.take(at, mode="clip") & ((1 << code.bits) - 1))
        return found & 0xFFFF, at + (found >> 16)

    def more(prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = EXTRA_BITS.take(prefix)
        return EXTRA_BASE.take(prefix) + (words.take(at >> 3, mode="clip") >> (at & 7) & ((1 << k) - 1)), at + k

    table = codes[0].table
    if table is None or codes[0].bits < most_bits:
        table = np.resize(codes[0].only if table is None else table, 1 << most_bits)
    step = (table >> 16).take(index)
    step += _all_places()[:n]
    channels = [code.only for code in codes[1:4]]
    if None in channels:
        after = step
        for k, code in enumerate(codes[1:4]):
            if code.only is None:
                channels[k], step = look(code, step)
        step = np.where(((table & 0xFFFF) < GREEN).take(index), step, after)
    if codes[0].largest >= GREEN:
        # a length's extra bits, a distance symbol and its extra bits
        prefix = (table & 0xFFFF) - GREEN
        refs = (prefix >= 0).take(index).nonzero()[0]
        prefix = prefix.take(index.take(refs))
        if codes[0].largest >= GREEN + PREFIXES:
            refs, prefix = refs[prefix < PREFIXES], prefix[prefix < PREFIXES]
        at = step.take(refs)
        at += EXTRA_BITS.take(prefix)
        prefix, at = look(codes[4], at)
        at += EXTRA_BITS.take(prefix, mode="clip")
        step[refs] = at
    two = step.take(step, mode="clip")
    four = two.take(two, mode="clip")
    jump, p, starts = memoryview(four.take(four, mode="clip")), bits.at & 7, []
    limit = n - EIGHT
    for _ in range((most + 7) // 8):
        if p >= limit:
            break
        starts.append(p)
        p = jump[p]
    s = np.empty((len(starts), 8), dtype=np.intp)
    s[:, 0] = starts
    s[:, 1] = step.take(s[:, 0])
    s[:, 2:4] = two.take(s[:, :2])
    s[:, 4:] = four.take(s[:, :4])
    s = s.reshape(-1)[:most]
    red, blue, alpha = (c if isinstance(c, int) else c.take(s) for c in channels)
    entry = table.take(index.take(s))
    green = entry & 0xFFFF
    pixel = ((green & 255) << 8 | (alpha << 24 | red << 16 | blue)).astype(np.uint32)
    length, far = np.ones(len(s), dtype=np.intp), np.zeros(len(s), dtype=np.intp)
    if codes[0].largest >= GREEN:
        refs = (green >= GREEN).nonzero()[0]
        found = entry.take(refs)
        prefix = (found & 0xFFFF) - GREEN
        if codes[0].largest >= GREEN + PREFIXES:
            refs, found, prefix = (x[prefix < PREFIXES] for x in (refs, found, prefix))
        length[refs], at = more(prefix, s.take(refs) + (found >> 16))
        prefix, at = look(codes[4], at)
        far[refs], _ = more(prefix, at)
    # as many symbols as the image still has room for
    used = min(len(s), int(length.cumsum().searchsorted(most)) + 1)
    bits.at = 8 * first + (int(step[s[used - 1]]) if used else bits.at & 7)
    if not used or bits.at > bits.end:
        raise ValueError("image data cut short")
    return green[:used], pixel[:used], length[:used], far[:used]


@functools.lru_cache(maxsize=1)
def _all_places() -> np.ndarray:
    return np.arange(8 * CHUNK)


@functools.lru_cache(maxsize=1)
def _places_in_bytes() -> np.ndarray:
    return _all_places() & 7


def _slot(pixel: int, cache_bits: int) -> int:
    """A pixel's place in the colour cache (a fixed value of the format)."""
    return (0x1E35A7BD * pixel & 0xFFFFFFFF) >> (32 - cache_bits)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The entropy-coded pixels of an image; only the main image may have an entropy image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, shift, across = None, 0, 0
    if main and bits.read(1):
        shift = 2 + bits.read(3)
        across = (width + (1 << shift) - 1) >> shift
        groups = (read_pixels(bits, across, (height + (1 << shift) - 1) >> shift, False) >> 8) & 0xFFFF
    sizes = [GREEN + PREFIXES + (1 << cache_bits if cache_bits else 0), CHANNEL, CHANNEL, CHANNEL, DISTANCES]
    codes = [[read_code(bits, n) for n in sizes] for _ in range(1 if groups is None else int(groups.max()) + 1)]
    out = np.zeros(width * height, dtype=np.uint32)
    cells = memoryview(out)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    cached, at, total = 0, 0, width * height

    def copy(at: int, length: int, code: int) -> None:
        far, end = _far(code, width), at + length
        if far > at or end > total:
            raise ValueError("back-reference outside the image")
        if far >= length:
            cells[at:end] = cells[at - far : end - far]
        else:
            out[at:end] = np.resize(out[at - far : at], length)  # what overlaps repeats

    def recall(at: int, key: int) -> None:
        nonlocal cached
        for p in out[cached:at].tolist():  # the cache is brought up to date when it is read
            cache[_slot(p, cache_bits)] = p
        cached = at
        out[at] = cache[key]

    while at < total:
        if groups is None:
            green, pixel, length, code = _symbols(bits, codes[0], total - at)
            place = length.cumsum()
            place += at - length
            at = int(place[-1] + length[-1])
            # what isn't a literal is written over after it, from left to right
            out[place] = pixel
            rest = (green >= GREEN).nonzero()[0]
            for g, p, n, c in zip(green.take(rest).tolist(), place.take(rest).tolist(), length.take(rest).tolist(), code.take(rest).tolist()):
                copy(p, n, c) if g < GREEN + PREFIXES else recall(p, g - GREEN - PREFIXES)
            continue
        group = codes[int(groups[(at // width >> shift) * across + (at % width >> shift)])]
        s = group[0].read(bits)
        if s < GREEN:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < GREEN + PREFIXES:
            length = _extra(s - GREEN, bits)
            copy(at, length, _extra(group[4].read(bits), bits))
            at += length
        else:
            recall(at, s - GREEN - PREFIXES)
            at += 1
    return out


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """Channels (blue, green, red, alpha) of pixels."""
    return np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4")[..., 0]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction from neighbours, all int32 channels."""
    if mode == 1:
        return left
    if mode in (2, 3, 4):
        return (top, right, corner)[mode - 2]
    mean = lambda a, b: (a + b) >> 1
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = mean(left, top)
        d = m - corner
        return np.clip(m + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return np.array([0, 0, 0, 255], dtype=np.int32)


def invert_predictor(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = pixels.shape
    res = _bytes(pixels).astype(np.int32)
    out = np.zeros_like(res)
    out[0, 0] = (res[0, 0] + [0, 0, 0, 255]) & 255
    out[0, 1:] = (out[0, 0] + np.cumsum(res[0, 1:], axis=0)) & 255
    for y in range(1, height):
        out[y, 0] = (res[y, 0] + out[y - 1, 0]) & 255
        above = np.concatenate([out[y - 1], out[y, :1]])  # right of the last pixel stands this row's first
        for x0 in range(0, width, 1 << shift):
            a, b = max(1, x0), min(width, x0 + (1 << shift))
            mode = int(modes[y >> shift, x0 >> shift] >> 8) & 15
            if a >= b:
                continue
            if mode == 1:
                out[y, a:b] = (out[y, a - 1] + np.cumsum(res[y, a:b], axis=0)) & 255
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):
                out[y, a:b] = (res[y, a:b] + _predict(mode, None, above[a:b], above[a + 1 : b + 1], above[a - 1 : b - 1])) & 255
            else:
                for x in range(a, b):
                    out[y, x] = (res[y, x] + _predict(mode, out[y, x - 1], above[x], above[x + 1], above[x - 1])) & 255
    return _pixels(out)


def invert_cross_color(pixels: np.ndarray, elements: np.ndarray, shift: int) -> np.ndarray:
    height, width = pixels.shape
    e = _bytes(elements).view(np.int8).astype(np.int32)[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    c = _bytes(pixels).astype(np.int32)
    signed = lambda x: ((x & 255) ^ 128) - 128
    green = signed(c[..., 1])
    red = (c[..., 2] + (e[..., 0] * green >> 5)) & 255
    blue = c[..., 0] + (e[..., 1] * green >> 5) + (e[..., 2] * signed(red) >> 5)
    return _pixels(np.stack([blue & 255, c[..., 1], red, c[..., 3]], axis=-1))


def decode_vp8l(data: bytes) -> np.ndarray:
    """The ARGB pixels (height x width) of a VP8L chunk."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    across, undo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            shift = 2 + bits.read(3)
            w, h = (across + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            undo.append((kind, shift, read_pixels(bits, w, h, False).reshape(h, w), across))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            colors = _pixels(np.cumsum(_bytes(read_pixels(bits, size, 1, False)).astype(np.int64), axis=0) & 255)
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, shift, colors, across))
            across = (across + (1 << shift) - 1) >> shift
        else:
            undo.append((kind, 0, None, across))
    pixels = read_pixels(bits, across, height, True).reshape(height, across)
    for kind, shift, extra, w in reversed(undo):
        if kind == PREDICTOR:
            pixels = invert_predictor(pixels, extra, shift)
        elif kind == CROSS_COLOR:
            pixels = invert_cross_color(pixels, extra, shift)
        elif kind == SUBTRACT_GREEN:
            c = _bytes(pixels).astype(np.int32)
            pixels = _pixels(np.stack([c[..., 0] + c[..., 1] & 255, c[..., 1], c[..., 2] + c[..., 1] & 255, c[..., 3]], axis=-1))
        else:
            each = 8 >> shift
            index = (pixels >> 8) & 255
            index = (index[:, :, None] >> (np.arange(1 << shift, dtype=np.uint32) * each)) & ((1 << each) - 1)
            index = index.reshape(height, -1)[:, :w]
            pixels = np.append(extra, np.zeros(256, dtype=np.uint32))[index]
    return pixels


def decode_images(data: bytes) -> Iterator[np.ndarray]:
    """The images of one or more WebP files that stand one after another."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("no WebP file")
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        chunk, found = at + 12, False
        while chunk + 8 <= end:
            size = int.from_bytes(data[chunk + 4 : chunk + 8], "little")
            if data[chunk : chunk + 4] == b"VP8L":
                yield decode_vp8l(data[chunk + 8 : chunk + 8 + size])
                found = True
            chunk += 8 + size + (size & 1)
        if not found:
            raise ValueError("no lossless image")
        at = end


def code_lengths(counts: dict[int, int], longest: int) -> dict[int, int]:
    """Huffman code lengths of at most ``longest`` bits (two symbols or more): leaves and inner nodes both come by rising weight."""
    symbols = sorted(counts, key=counts.__getitem__)
    n = len(symbols)
    weights = [counts[s] for s in symbols]
    while True:
        weights.append(math.inf)  # never the smaller one
        inner = [math.inf] * n
        parent, leaf, node = [0] * (2 * n - 1), 0, 0
        for new in range(n - 1):
            w, v = weights[leaf], inner[node]
            if w <= v:
                parent[leaf] = n + new
                leaf += 1
                total, w = w, weights[leaf]
            else:
                parent[n + node] = n + new
                node += 1
                total, v = v, inner[node]
            if w <= v:
                parent[leaf] = n + new
                leaf += 1
                inner[new] = total + w
            else:
                parent[n + node] = n + new
                node += 1
                inner[new] = total + v
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= longest:  # no leaf is deeper than the lightest
            return dict(zip(symbols, depth))
        weights = [(w >> 2) + 1 for w in weights[:n]]


def reversed_codes(lengths: dict[int, int]) -> dict[int, int]:
    """Canonical codes, with their first bit lowest."""
    longest = max(lengths.values())
    back, size, start, codes = _reversed_list(longest), 1 << longest, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        codes[s] = back[start]
        start += size >> n
    return codes


class Writer:
    """Collects bits, lowest first."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def write_code(out: Writer, lengths: dict[int, int], alphabet: int) -> None:
    """A prefix code's description: simple for a single symbol, else run-length coded lengths."""
    if len(lengths) == 1:
        s = next(iter(lengths))
        out.put(1, 1), out.put(0, 1), out.put(int(s > 1), 1), out.put(s, 8 if s > 1 else 1)
        return
    tokens, at = [], 0
    for s in sorted(lengths):
        gap = s - at
        while gap >= 3:
            n = min(gap, 138)
            tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            gap -= n
        if gap:
            tokens += [(0, 0, 0)] * gap
        tokens.append((lengths[s], 0, 0))
        at = s + 1
    counts: dict[int, int] = {}
    for t, _, _ in tokens:
        counts[t] = counts.get(t, 0) + 1
    inner = code_lengths(counts, 7) if len(counts) > 1 else {**dict.fromkeys(counts, 1), (0 if 0 not in counts else 1): 1}
    codes = reversed_codes(inner)
    order = LENGTH_ORDER[: max(4, *(LENGTH_RANK[s] + 1 for s in inner))]
    out.put(0, 1), out.put(len(order) - 4, 4)
    out.put(sum(inner[s] << 3 * k for k, s in enumerate(order) if s in inner), 3 * len(order))
    count = len(tokens) - 2
    nbits = next(k for k in range(8) if count < 1 << (2 + 2 * k))
    out.put(1, 1), out.put(nbits, 3), out.put(count, 2 + 2 * nbits)
    value = size = 0
    for t, extra, k in tokens:
        n = inner[t]
        value |= (codes[t] | extra << n) << size
        size += n + k
    out.put(value, size)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distance codes, with their extra bits' values and numbers."""
    symbol = EXTRA_BASE.searchsorted(values, side="right") - 1
    return symbol, values - EXTRA_BASE.take(symbol), EXTRA_BITS.take(symbol)


@functools.lru_cache(maxsize=4)
def _near_codes(width: int) -> np.ndarray:
    """Distance codes of the smallest distances; 0 where there is no short one."""
    out = np.zeros(8 * width + 16, dtype=np.intp)
    for code in range(SHORT_DISTANCES, 0, -1):
        out[_far(code, width)] = code
    return out


def find_repeats(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of runs that occur before, from left to right: each begins where the nearest earlier one with its next bytes goes on longest from there."""
    n = len(samples) - SEED + 1
    none = np.zeros(0, dtype=np.intp)
    if n < 2:
        return none, none, none
    words = np.ndarray((n,), "<u8", np.ascontiguousarray(samples), 0, (1,)).copy()  # the next bytes from each place on, which overlap
    # 44 bits of a hash and the place in one number: sorted, equal bytes stand together in order of place
    place = np.uint64((1 << 20) - 1)
    keyed = words * np.uint64(0x9E3779B97F4A7C15)
    keyed &= ~place
    keyed |= np.arange(n, dtype=np.uint64)
    keyed.sort()
    same = (keyed[1:] ^ keyed[:-1] <= place).nonzero()[0]
    keyed = (keyed & place).view(np.intp)
    later, before = keyed[1:].take(same), keyed.take(same)
    true = words.take(later) == words.take(before)  # not only their hash
    if not true.all():
        later, before = later[true], before[true]
    far = np.zeros(n, dtype=np.intp)
    far[later] = later - before
    if n > MOST_FAR:
        far[far > MOST_FAR] = 0
    bounds = np.concatenate([[0], (far[1:] != far[:-1]).nonzero()[0] + 1, [n]])  # of runs of one distance
    own = far.take(bounds[:-1])
    runs = own.nonzero()[0]
    at, found = 0, []  # place, length and distance of one after the other
    for begin, end, back in zip(bounds.take(runs).tolist(), bounds.take(runs + 1).tolist(), own.take(runs).tolist()):
        while at < end:
            if begin < at:
                begin = at
            at = end - 1 + SEED
            if at > begin + MOST_LONG:
                at = begin + MOST_LONG
            found += begin, at - begin, back
    found = np.array(found, dtype=np.intp)
    return found[::3], found[1::3], found[2::3]


def _tokens(samples: np.ndarray, width: int, repeats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """Green symbols of the samples, which of them are references, and the prefixes of the references' lengths and distance codes."""
    place, length, far = repeats
    inside = np.zeros(len(samples) + 1, dtype=np.int8)
    inside[place + 1] = 1
    inside[place + length] = -1
    at = (inside[:-1].cumsum(dtype=np.int8) == 0).nonzero()[0]
    green = samples.take(at).astype(np.intp)
    refs = at.searchsorted(place)
    near = _near_codes(width)
    short = near.take(far, mode="clip")
    lengths = _prefixes(length)
    green[refs] = GREEN + lengths[0]
    return green, refs, lengths, _prefixes(np.where((far < len(near)) & (short > 0), short, far + SHORT_DISTANCES))


def _lengths_of(counts: np.ndarray) -> dict[int, int]:
    used = counts.nonzero()[0]
    symbols = used.tolist()
    return code_lengths(dict(zip(symbols, counts.take(used).tolist())), 12) if len(symbols) > 1 else {symbols[0] if symbols else 0: 0}


def _table(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(size, dtype=np.intp), np.zeros(size, dtype=np.intp)
    if len(lengths) > 1:
        symbols, own, starts, longest = _canonical(lengths)
        codes[symbols], sizes[symbols] = _reversed(longest)[starts], own
    return codes, sizes


def _entropy_bits(counts: np.ndarray) -> float:
    """Bits of symbols that occur so often under their own frequencies; a prefix code of two symbols or more takes one for each at least."""
    n = counts[counts > 0]
    total = int(n.sum())
    return max(float((n * np.log2(total / n)).sum()), total) if len(n) > 1 else 0.0


@functools.lru_cache(maxsize=8)
def _plain_channels(alpha: int) -> tuple[int, int]:
    """The codes of red and blue, which are 0, and of an alpha that is the same everywhere: bits and their number."""
    out = Writer()
    for s in (0, 0, alpha):
        write_code(out, {s: 0}, CHANNEL)
    return out.value, out.size


def _packed(fields: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """Fields of at most 31 bits one after another, the first lowest, as a number, and how many bits that are."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return 0, 0
    at = ends - sizes
    # a field begins in each word of 32 bits but the last; those of one word don't overlap, and what the last has above bit 32 is the next word's
    word = at >> 5
    heads = np.append(0, (word[1:] != word[:-1]).nonzero()[0] + 1)
    sums = np.append(np.add.reduceat(fields << (at & 31), heads), 0)
    words = sums & 0xFFFFFFFF
    words[1:] |= sums[:-1] >> 32
    return int.from_bytes(words.astype("<u4").tobytes(), "little"), total


def write_image(out: Writer, samples: np.ndarray, width: int, alpha: int, main: bool = True) -> None:
    """An entropy-coded image of green samples: with back-references if these take fewer bits."""
    repeats = find_repeats(samples)
    green, counts, refs = samples, np.bincount(samples), None
    dist_lengths = {0: 0}
    if len(repeats[0]):
        found, at, (_, len_extra, len_bits), (dist, dist_extra, dist_bits) = _tokens(samples, width, repeats)
        found_counts, dist_counts = np.bincount(found), np.bincount(dist)
        bits = _entropy_bits(found_counts) + _entropy_bits(dist_counts) + int(len_bits.sum() + dist_bits.sum())
        if bits + 64 < _entropy_bits(counts):  # another code must be described
            green, counts, refs, dist_lengths = found, found_counts, at, _lengths_of(dist_counts)
    lengths = _lengths_of(counts)
    codes, n = _table(lengths, GREEN + PREFIXES)
    fields, sizes = codes.take(green), n.take(green)
    if refs is not None:
        # a reference's length follows its green symbol in one field, and a field with its distance comes next
        fields[refs] |= len_extra << sizes.take(refs)
        sizes[refs] += len_bits
        codes, n = _table(dist_lengths, DISTANCES)
        n = n.take(dist)
        after = refs + np.arange(1, len(refs) + 1)
        kept = np.ones(len(fields) + len(refs), dtype=bool)
        kept[after] = False
        kept = kept.nonzero()[0]
        both = np.empty((2, len(fields) + len(refs)), dtype=np.intp)
        both[0, kept], both[1, kept] = fields, sizes
        both[0, after], both[1, after] = codes.take(dist) | dist_extra << n, n + dist_bits
        fields, sizes = both
    out.put(0, 1 + main)  # no colour cache, no entropy image
    write_code(out, lengths, GREEN + PREFIXES)
    out.put(*_plain_channels(alpha))
    write_code(out, dist_lengths, DISTANCES)
    out.put(*_packed(fields, sizes))


def residuals(samples: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Samples less their left (1) or upper (2) neighbours; the first row has left ones, the first column upper ones."""
    grid = samples.reshape(-1, width).astype(np.intp)
    guess = np.zeros_like(grid)
    guess[0, 1:] = grid[0, :-1]
    guess[1:, 0] = grid[:-1, 0]
    guess[1:, 1:] = grid[1:, :-1] if mode == 1 else grid[:-1, 1:]
    return ((grid - guess) & 255).astype(np.uint8).reshape(-1)


def encode_image(samples: np.ndarray, width: int = WIDTH) -> bytes:
    """A WebP file with uint8 ``samples`` in its green channel, ``width`` a row."""
    height = len(samples) // width
    out = Writer()
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(0, 1 + 3)
    counts = np.bincount(samples, minlength=256)
    colours = np.flatnonzero(counts)
    if len(colours) <= 16:
        # colours in order, each as the difference from the one before; their alpha is 255, the differences' 0 but for the first
        shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        out.put(1, 1), out.put(PALETTE, 2), out.put(len(colours) - 1, 8)
        write_palette(out, np.diff(colours, prepend=0))
        index = np.zeros(256, dtype=np.uint8)
        index[colours] = np.arange(len(colours))
        across = -(-width >> shift)
        grid = np.zeros((height, across << shift), dtype=np.uint8)
        grid[:, :width] = index[samples].reshape(height, width)
        grid = grid.reshape(height, across, 1 << shift) << (np.arange(1 << shift, dtype=np.uint8) * (8 >> shift))
        samples, width, alpha = grid.sum(axis=2).astype(np.uint8).reshape(-1), across, 255
    else:
        alpha, tried = 255, []
        # neighbours that are nearer to each other than values are to their mean
        values = np.arange(256)
        spread = float(counts @ np.abs(values - int(counts @ values) / len(samples))) / len(samples)
        for mode, step in ((1, 1), (2, width)):
            if len(samples) > step and int(np.abs((samples[step:] - samples[:-step]).view(np.int8)).view(np.uint8).sum()) < 0.75 * spread * (len(samples) - step):
                rest = residuals(samples, width, mode)
                tried.append((_entropy_bits(np.bincount(rest)), mode, rest))
        cost, mode, rest = min(tried, key=lambda x: x[:2], default=(0.0, 0, None))
        if tried and cost < 0.9 * _entropy_bits(counts):
            out.put(1, 1), out.put(PREDICTOR, 2), out.put(7, 3)  # blocks of 512 pixels
            blocks = -(-height >> 9)
            modes = np.full(blocks, mode, dtype=np.uint8)
            write_image(out, modes, 1, 255, main=False)
            samples, alpha = rest, 0
    out.put(0, 1)
    write_image(out, samples, width, alpha)
    data = out.value.to_bytes((out.size + 7) // 8, "little")
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def write_palette(out: Writer, steps: np.ndarray) -> None:
    """An image of one row with the steps in its green channel, alpha 255 at its first pixel and 0 at the others."""
    out.put(0, 1)  # no colour cache
    steps = steps.astype(np.intp)
    alphas = np.append(255, np.zeros(len(steps) - 1, dtype=np.intp))
    channels = [(steps, GREEN + PREFIXES), (steps * 0, CHANNEL), (steps * 0, CHANNEL), (alphas, CHANNEL)]
    tables = []
    for values, size in channels:
        lengths = _lengths_of(np.bincount(values))
        write_code(out, lengths, size)
        tables.append(_table(lengths, size))
    write_code(out, {0: 0}, DISTANCES)
    for k in range(len(steps)):
        for (values, _), (codes, sizes) in zip(channels, tables):
            out.put(int(codes[values[k]]), int(sizes[values[k]]))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def store(payload: bytes) -> bytes:
    """Samples as one WebP file for each MiB."""
    step = WIDTH * MAX_ROWS
    return b"".join(encode_image(np.frombuffer(payload[k : k + step], dtype=np.uint8)) for k in range(0, len(payload), step))


def load(media: bytes) -> np.ndarray:
    """The samples of ``store``: the green channel of the decoded pixels."""
    return np.concatenate([_bytes(p)[..., 1].reshape(-1) for p in decode_images(media)])


def feature(samples: np.ndarray) -> str:
    """A short description of the pixel array: rows, mean, deviation, distinct values and entropy."""
    p, values = np.bincount(samples, minlength=256) / len(samples), np.arange(256)
    weighted = p * values
    mean = float(weighted.sum())
    spread = math.sqrt(max(0.0, float((weighted * values).sum()) - mean * mean))
    some = p[p > 0]
    entropy = float((some * np.log2(some)).sum())
    return f"{WIDTH}x{len(samples) // WIDTH};mean={mean:.3f};std={spread:.3f};distinct={len(some)};bits={abs(entropy):.3f}"


MEDIA_SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_columns(docs: DataFrame, text: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text as an image, read it back and describe it (``MEDIA_SCHEMA``; with the file and the samples if asked for)."""
    schema = MEDIA_SCHEMA + ", media binary, samples binary" * with_media
    columns = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def columns_of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            raw = (t or "").encode("utf-8", "replace")
            media = store(padded(raw))
            samples = load(media)
            back = samples.tobytes()
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
            rows.append((*row, media, back) if with_media else row)
        return pd.DataFrame(rows, columns=columns)

    names = [c for c in docs.columns if c not in columns and c != "__media"]
    return docs.select(*names, columns_of(F.col(text)).alias("__media")).select(*names, *[F.col(f"__media.{c}").alias(c) for c in columns])
