"""Lossless WebP: a decoder of the whole bitstream and an encoder, for one image at a time.

The decoder reads prefix codes, meta prefix codes, back-references and the
colour cache, and inverts the predictor, cross-colour, green and palette
transforms.  webp_lanes.py does the same for many small images at once and chooses
transforms by content; media.py makes the media column of it.
Pixels are uint32 arrays (alpha, red, green, blue from the top byte).
"""

from __future__ import annotations

import struct
from collections import Counter
from functools import cached_property, lru_cache

import numpy as np

from .textops import mix

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
#: Near places of back-references: by distance from the pixel, then from its column, right before left.
NEAR = sorted([(x, 0) for x in range(1, 9)] + [(x, y) for y in range(1, 8) for x in range(-7, 9)], key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class WebpError(ValueError):
    """The bytes are no lossless WebP stream."""


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > len(self.data) * 8:
            raise WebpError("the stream ends early")
        return (int.from_bytes(self.data[a >> 3 : (a >> 3) + 6], "little") >> (a & 7)) & ((1 << n) - 1)


class PrefixCode:
    """A canonical prefix code; a lone symbol takes no bits."""

    def __init__(self, lengths: tuple[int, ...]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.lone = used[0][1] if len(used) == 1 else None
        self.words: dict[int, tuple[int, int]] = {}
        self.longest = 0
        if not used:
            self.lone = 0
        elif self.lone is None:
            if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
                raise WebpError("a prefix code isn't complete")
            code, last = 0, 0
            for n, s in sorted(used):
                code <<= n - last
                last = n
                self.words[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
                code += 1
            self.longest = last

    @cached_property
    def peek(self) -> np.ndarray:
        """symbol << 4 | length by the next `longest` bits of the stream."""
        out = np.full(1 << self.longest, (self.lone or 0) << 4, np.int32)
        for s, (word, n) in self.words.items():
            out[word :: 1 << n] = s << 4 | n
        return out

    @cached_property
    def steps(self) -> list[int]:
        return self.peek.tolist()

    def arrays(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(words as the stream holds them, lengths) by symbol; a lone symbol has none."""
        words, lengths = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        if self.words:
            at = list(self.words)
            words[at], lengths[at] = np.array(list(self.words.values()), np.uint64).T
        return words, lengths

    def read(self, bits: Bits) -> int:
        if self.lone is not None:
            return self.lone
        a = bits.at
        found = self.steps[(int.from_bytes(bits.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7)) & ((1 << self.longest) - 1)]
        bits.at = a + (found & 15)
        if bits.at > len(bits.data) * 8:
            raise WebpError("the stream ends early")
        return found >> 4


prefix_code = lru_cache(4096)(PrefixCode)


def read_code(bits: Bits, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return prefix_code(tuple(lengths))
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    code = prefix_code(tuple(own))
    steps = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and steps:
        steps -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + n > size:
            raise WebpError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return prefix_code(tuple(lengths))


def _value(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def words_of(data: bytes, begin: int, end: int) -> list[int]:
    """The eight bytes from each byte on, of a part of the data, filled up with zeros."""
    part = data[begin:end] + bytes(16)
    return np.ndarray((len(part) - 7,), "<u8", part, strides=(1,)).tolist()


def _back(code: int, width: int) -> int:
    """How many pixels back a distance code means."""
    if code > 120:
        return code - 120
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def step_values(steps: np.ndarray, code: int) -> np.ndarray:
    """symbol << 6 | length of symbol << 4 | length: green and red in their place of a pixel, other symbols of the first code beyond 1 << 16.

    Six bits hold the sum of three lengths, so steps of a pixel's parts can be added up.
    """
    size, symbol = steps & 15, steps >> 4
    if code == 0:
        symbol = np.where(symbol < 256, symbol << 8, symbol + 65536)
    return (symbol << 16 if code == 1 else symbol) << 6 | size


def entropy_pixels(words: list[int], at: int, tables: list[list[int]], width: int, total: int, cache_bits: int, known: list[int] | None = None) -> tuple[list[int], int]:
    """The pixels of an image of one code group, and the bit after it.

    words: see words_of(); tables: see step_values(), for each of the five
    codes, by the bits that follow; known: the pixels before the bit at.
    """
    greens, reds, blues, alphas, distances = tables
    opaque = len(alphas) == 1
    g_mask, r_mask, b_mask, a_mask, d_mask = (len(x) - 1 for x in tables)
    base = alphas[0] >> 6 << 24 if opaque else 0
    out: list[int] = known or []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    add, filled, limit, literal = out.append, 0, 65536 + 280 + (1 << cache_bits if cache_bits else 0), 65536 << 6
    last = len(words) - 9
    try:
        while len(out) < total:
            ahead = words[at >> 3] >> (at & 7)
            step = greens[ahead & g_mask]
            if step < literal:
                ahead >>= step & 63
                red = reds[ahead & r_mask]
                step += red + blues[(ahead >> (red & 63)) & b_mask]
                at += step & 63
                if opaque:
                    add(base + (step >> 6))
                else:
                    alpha = alphas[words[at >> 3] >> (at & 7) & a_mask]
                    at += alpha & 63
                    add((alpha >> 6 << 24) + (step >> 6))
                continue
            n = step & 63
            symbol = step >> 6
            at += n
            if symbol >= 65536 + 280:
                if symbol >= limit:
                    raise WebpError("no such colour in the cache")
                for p in out[filled:]:  # what has come since the last look into the cache
                    cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
                filled = len(out)
                add(cache[symbol - 65536 - 280])
                continue
            symbol -= 65536 + 256
            if symbol < 4:
                n = symbol + 1
            else:
                more = (symbol - 2) >> 1
                n = ((2 + (symbol & 1)) << more) + (words[at >> 3] >> (at & 7) & ((1 << more) - 1)) + 1
                at += more
            step = distances[words[at >> 3] >> (at & 7) & d_mask]
            at += step & 63
            symbol = step >> 6
            if symbol < 4:
                far = symbol + 1
            else:
                more = (symbol - 2) >> 1
                far = ((2 + (symbol & 1)) << more) + (words[at >> 3] >> (at & 7) & ((1 << more) - 1)) + 1
                at += more
            back, many = _back(far, width), len(out)
            if back > many or many + n > total:
                raise WebpError("a back-reference leaves the image")
            out += out[many - back : many - back + n] if n <= back else (out[many - back :] * (n // back + 1))[:n]
    except IndexError:
        raise WebpError("the stream ends early") from None
    if at > 8 * last:
        raise WebpError("the stream ends early")
    return out, at


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    tile, which, count = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        which = (_read_image(bits, across, (height + (1 << tile) - 1) >> tile, False) >> 8) & 0xFFFF
        count = int(which.max()) + 1
        which = which.tolist()
    groups = [[read_code(bits, n + (k == 0 and cache_bits > 0) * (1 << cache_bits)) for k, n in enumerate(ALPHABETS)] for _ in range(count)]
    total = width * height
    if count == 1:
        begin = bits.at >> 3
        found, at = entropy_pixels(words_of(bits.data, begin, len(bits.data)), bits.at & 7, [step_values(c.peek, k).tolist() for k, c in enumerate(groups[0])], width, total, cache_bits)
        bits.at = 8 * begin + at
        return np.array(found, np.uint32)
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    group = groups[0]
    while len(out) < total:
        at = len(out)
        if which is not None:
            y, x = divmod(at, width)
            group = groups[which[(y >> tile) * across + (x >> tile)]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _value(bits, s - 256)
            back = _back(_value(bits, group[4].read(bits)), width)
            if back > at or at + n > total:
                raise WebpError("a back-reference leaves the image")
            for k in range(n):
                out.append(out[at - back + k])
        else:
            if s - 280 >= len(cache) or not cache_bits:
                raise WebpError("no such colour in the cache")
            out.append(cache[s - 280])
        if cache_bits:
            for p in out[at:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    return ((pixels[..., None] >> np.array([24, 16, 8, 0], np.uint32)) & 0xFF).astype(np.int64)


def _pixels(channels: np.ndarray) -> np.ndarray:
    return ((channels & 0xFF).astype(np.uint32) << np.array([24, 16, 8, 0], np.uint32)).sum(-1, dtype=np.uint32)


def predict(mode: int, left, top, corner, right) -> np.ndarray:
    """What a predictor of the format makes of the four channels of a pixel's neighbours."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return np.where(np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        half = mean(left, top)
        return np.clip(half + np.trunc((half - corner) / 2).astype(np.int64), 0, 255)
    raise WebpError("no such predictor")


BLACK = np.array([255, 0, 0, 0])


def _predictions(image: np.ndarray, modes: list[int]) -> dict[int, np.ndarray]:
    """What each predictor makes of a known image; the first row is predicted from the left, the first column from above."""
    left, top, corner, right = (np.zeros_like(image) for _ in range(4))
    left[:, 1:] = image[:, :-1]
    top[1:] = image[:-1]
    corner[1:, 1:] = image[:-1, :-1]
    right[1:, :-1] = image[:-1, 1:]
    right[:, -1] = image[:, 0]
    out = {}
    for mode in modes:
        own = out[mode] = np.broadcast_to(predict(mode, left, top, corner, right), image.shape).copy()
        own[1:, 0] = top[1:, 0]
        own[0] = left[0]
        own[0, 0] = BLACK
    return out


def _unpredicted(rest: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """The image of which the predictors left `rest`: row by row, in runs of one predictor."""
    height, width, _ = rest.shape
    image = rest.copy()
    image[0, 0] += BLACK
    image[0] = np.cumsum(image[0], axis=0) & 0xFF
    image[:, 0] = np.cumsum(image[:, 0], axis=0) & 0xFF
    wide = np.repeat(modes, 1 << tile, axis=1)[:, 1:width]
    runs = []
    for row in wide:
        cuts = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)]
        runs.append([(int(row[a]), a + 1, b + 1) for a, b in zip(cuts, cuts[1:]) if a < b])  # noqa: B905
    for y in range(1, height):
        own, above = image[y], image[y - 1]
        for mode, a, b in runs[y >> tile]:
            if mode == 1:
                own[a:b] = (own[a - 1] + np.cumsum(own[a:b], axis=0)) & 0xFF
                continue
            right = np.concatenate([above[a + 1 : b + 1], own[:1]]) if b == width else above[a + 1 : b + 1]
            if mode in (0, 2, 3, 4, 8, 9):
                own[a:b] = (own[a:b] + predict(mode, None, above[a:b], above[a - 1 : b - 1], right)) & 0xFF
                continue
            for x in range(a, b):
                own[x] = (own[x] + predict(mode, own[x - 1], above[x], above[x - 1], right[x - a])) & 0xFF
    return image


def _cross(channels: np.ndarray, factors: np.ndarray, tile: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what cross-colour factors (red to blue, green to blue, green to red) make of other channels."""
    ys, xs = np.arange(channels.shape[0]) >> tile, np.arange(channels.shape[1]) >> tile
    f = factors[ys][:, xs]
    signed = lambda v: (v & 0xFF) - ((v & 0x80) << 1)
    red_blue, green_blue, green_red = (signed(f[..., k]) for k in (1, 2, 3))
    green = signed(channels[..., 2])
    out = channels.copy()
    out[..., 1] = (channels[..., 1] + sign * ((green_red * green) >> 5)) & 0xFF
    red = signed((out if sign > 0 else channels)[..., 1])
    out[..., 3] = (channels[..., 3] + sign * (((green_blue * green) >> 5) + ((red_blue * red) >> 5))) & 0xFF
    return out


def decode_image(data: bytes) -> np.ndarray:
    """Pixels (height by width, uint32) of one lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise WebpError("not a lossless WebP file")
    bits = Bits(data, 21)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("unknown version")
    steps, own = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            across, down = (own + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            steps.append((kind, tile, _channels(_read_image(bits, across, down, False).reshape(down, across)), own))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            colours = np.cumsum(_channels(_read_image(bits, size, 1, False)), axis=0) & 0xFF
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            steps.append((kind, pack, colours, own))
            own = (own + (1 << pack) - 1) >> pack
        else:
            steps.append((kind, 0, None, own))
    image = _channels(_read_image(bits, own, height, True).reshape(height, own))
    for kind, tile, more, before in reversed(steps):
        if kind == SUBTRACT_GREEN:
            image[..., 1] = (image[..., 1] + image[..., 2]) & 0xFF
            image[..., 3] = (image[..., 3] + image[..., 2]) & 0xFF
        elif kind == CROSS_COLOUR:
            image = _cross(image, more, tile, 1)
        elif kind == PREDICTOR:
            image = _unpredicted(image, more[..., 2], tile)
        else:
            each = 1 << tile
            depth = 8 >> tile
            index = (image[..., 2][:, np.arange(before) // each] >> (depth * (np.arange(before) % each))) & ((1 << depth) - 1)
            table = np.zeros((256, 4), np.int64)
            table[: len(more)] = more
            image = table[index]
    return _pixels(image)


class BitsOut:
    def __init__(self):
        self.value, self.size = 0, 0

    def write(self, value: int, n: int):
        self.value |= value << self.size
        self.size += n

    def word(self, code: PrefixCode, symbol: int):
        if code.lone is None:
            self.write(*code.words[symbol])

    def extend(self, values: np.ndarray, sizes: np.ndarray):
        """Many fields of at most 63 bits, as uint64."""
        ends = np.cumsum(sizes)
        if not len(ends):
            return
        at = ends - sizes
        words = np.zeros(int(ends[-1] >> np.uint64(6)) + 2, np.uint64)
        place, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.add.at(words, place, values << shift)
        np.add.at(words, place + 1, (values >> np.uint64(1)) >> (np.uint64(63) - shift))
        self.write(int.from_bytes(words.tobytes(), "little"), int(ends[-1]))


def code_lengths(counts: dict[int, int], size: int, most: int = 15) -> list[int]:
    """Huffman code lengths; counts are evened out until none is longer than `most`."""
    out = [0] * size
    if len(counts) == 1:
        out[next(iter(counts))] = 1
        return out
    while counts:
        order = sorted(counts, key=lambda s: (counts[s], s))
        weight, many = [counts[s] for s in order], len(order)
        parent, leaf, inner = [0] * (2 * many - 1), 0, many
        for node in range(many, 2 * many - 1):
            total = 0
            for _ in range(2):
                if leaf < many and (inner >= node or weight[leaf] <= weight[inner]):
                    least, leaf = leaf, leaf + 1
                else:
                    least, inner = inner, inner + 1
                parent[least] = node
                total += weight[least]
            weight.append(total)
        depth = [0] * (2 * many - 1)
        for node in range(2 * many - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:many]) <= most:
            for s, n in zip(order, depth[:many], strict=True):
                out[s] = n
            break
        counts = {s: (n + 1) // 2 for s, n in counts.items()}
    return out


def _write_code(out: BitsOut, lengths: list[int]) -> PrefixCode:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        symbol = used[0] if used else 0
        out.write(1, 1)
        out.write(0, 1)
        out.write(1, 1)
        out.write(symbol, 8)
        return prefix_code(tuple(lengths))
    runs: list[tuple[int, int, int]] = []
    at, last, end = 0, 8, used[-1] + 1
    while at < end:
        n = 1
        while at + n < end and lengths[at + n] == lengths[at]:
            n += 1
        if lengths[at] == 0 and n >= 3:
            take = min(n, 138)
            runs.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
        elif lengths[at] == last and n >= 3:
            take = min(n, 6)
            runs.append((16, take - 3, 2))
        else:
            take = 1
            runs.append((lengths[at], 0, 0))
            last = lengths[at] or last
        at += take
    if len(runs) == 1:  # a number of steps is 2 at least
        runs.append((0, 0, 0))
    own = code_lengths(Counter(s for s, _, _ in runs), 19, 7)
    code = prefix_code(tuple(own))
    out.write(0, 1)
    many = max([4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if own[s])])
    out.write(many - 4, 4)
    for s in LENGTH_ORDER[:many]:
        out.write(own[s], 3)
    out.write(1, 1)
    width = max(2, (len(runs) - 2).bit_length() + 1 & ~1)
    out.write((width - 2) // 2, 3)
    out.write(len(runs) - 2, width)
    for s, value, n in runs:
        out.word(code, s)
        out.write(value, n)
    return prefix_code(tuple(lengths))


def _symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra bits and how many for lengths or distances."""
    v = values - 1
    n = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    few = np.maximum(n - 1, 0)
    small = v < 4
    return np.where(small, v, 2 * n + ((v >> few) & 1)), np.where(small, 0, v & ((1 << few) - 1)), np.where(small, 0, few)


@lru_cache(4096)
def _near(width: int) -> dict[int, int]:
    """The distance code of the places near a pixel, by how far back they are."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _last_equal(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it of the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _repeats(pixels: np.ndarray, most: int = 4096) -> list[tuple[int, int, int]]:
    """(place, how many, distance) of the copies, of three pixels or more, that a greedy pass takes."""
    if len(pixels) < 4:
        return []
    p = pixels.astype(np.uint64)
    key = mix(mix(p[:-2] << np.uint64(32) | p[1:-1]) ^ p[2:])
    last, values, out, free = _last_equal(key), pixels.tolist(), [], 0
    for at in np.flatnonzero(last >= 0).tolist():
        back = int(last[at])
        if at < free or values[back : back + 3] != values[at : at + 3]:
            continue
        n = 3
        while n < most and at + n < len(values) and values[back + n] == values[at + n]:
            n += 1
        out.append((at, n, at - back))
        free = at + n
    return out


def _write_image(out: BitsOut, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, tile: int = 0):
    """An entropy-coded image; references: runs and repeats as back-references; tile: one code group for each tile."""
    out.write(cache_bits > 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    pixels = np.asarray(pixels).ravel().astype(np.uint32)
    height, many = len(pixels) // width, 1
    if main:
        out.write(tile > 0, 1)
        if tile:
            out.write(tile - 2, 3)
            across, down = (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            many = across * down
            _write_image(out, np.arange(many) << 8, across, False)
    copies = _repeats(pixels) if references else []
    begins, length, distance = np.ones(len(pixels), bool), np.zeros(len(pixels), np.int64), np.zeros(len(pixels), np.int64)
    near = _near(width)
    for at, n, back in copies:
        begins[at + 1 : at + n] = False
        length[at], distance[at] = n, near.get(back, back + 120)
    cached = np.zeros(len(pixels), bool)
    if cache_bits:
        slots = ((pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        last = _last_equal(slots)
        cached = (last >= 0) & (pixels[last] == pixels)
    at = np.flatnonzero(begins)
    group = (at // width >> tile) * across + (at % width >> tile) if tile and main else np.zeros(len(at), np.int64)
    p, length, distance = pixels[at], length[at], distance[at]
    copy = length > 0
    cached = cached[at] & ~copy
    literal = ~copy & ~cached
    parts = [((p >> np.uint32(k)) & np.uint32(255)).astype(np.int64) for k in (8, 16, 0, 24)]
    green = parts[0].copy()
    if cache_bits:
        green[cached] = 280 + slots[at][cached]
    lengths, distances = _symbols(length), _symbols(distance)
    green[copy] = 256 + lengths[0][copy]
    symbols, used = [green, *parts[1:], distances[0]], [np.ones(len(at), bool), literal, literal, literal, copy]
    values, sizes = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)

    def append(which, value, size):
        values[which] |= value.astype(np.uint64) << sizes[which]
        sizes[which] += size.astype(np.uint64)

    alphabets = [n + (k == 0 and cache_bits > 0) * (1 << cache_bits) for k, n in enumerate(ALPHABETS)]
    own = [np.arange(len(at))] if many == 1 else [np.flatnonzero(group == g) for g in range(many)]
    for which in own:
        codes = []
        for s, u, n in zip(symbols, used, alphabets, strict=True):
            counts = np.bincount(s[which][u[which]], minlength=n)
            some = np.flatnonzero(counts)
            codes.append(_write_code(out, code_lengths(dict(zip(some.tolist(), counts[some].tolist(), strict=True)), n)).arrays(n))
        for k in range(5):
            now = which[used[k][which]]
            append(now, codes[k][0][symbols[k][now]], codes[k][1][symbols[k][now]])
            more = lengths if k == 0 else distances if k == 4 else None
            if more is not None:
                now = now[copy[now]]
                append(now, more[1][now], more[2][now])
    out.extend(values, sizes)


def _file(body: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode_image(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = True, tile: int = 0) -> bytes:
    """A lossless WebP file of the pixels.

    transforms, in the order they are applied: ("green",), ("predictor", bits,
    modes by tile), ("cross", bits, factors by tile: 0, red to blue, green to
    blue, green to red) and ("palette",), which the pixels must allow.
    """
    height, width = pixels.shape
    out = BitsOut()
    out.write(0x2F, 8)
    for value, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.write(value, n)
    image = _channels(pixels.astype(np.uint32))
    for step in transforms:
        out.write(1, 1)
        kind = {"predictor": 0, "cross": 1, "green": 2, "palette": 3}[step[0]]
        out.write(kind, 2)
        if kind == SUBTRACT_GREEN:
            image[..., [1, 3]] = (image[..., [1, 3]] - image[..., 2:3]) & 0xFF
        elif kind == PALETTE:
            colours = np.unique(_pixels(image))
            table = _channels(colours)
            out.write(len(colours) - 1, 8)
            _write_image(out, _pixels(np.diff(table, axis=0, prepend=0)), len(colours), False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = np.searchsorted(colours, _pixels(image))
            across = (image.shape[1] + (1 << pack) - 1) >> pack
            index = np.pad(index, ((0, 0), (0, (across << pack) - image.shape[1]))).reshape(height, across, 1 << pack)
            image = np.zeros((height, across, 4), np.int64)
            image[..., 2] = (index << ((8 >> pack) * np.arange(1 << pack))).sum(-1)
            image[..., 0] = 255
        else:
            bits, table = step[1], np.asarray(step[2])
            out.write(bits - 2, 3)
            if kind == PREDICTOR:
                _write_image(out, table << 8, table.shape[1], False)
                made = _predictions(image, np.unique(table).tolist())
                wide = np.repeat(np.repeat(table, 1 << bits, axis=0)[:height], 1 << bits, axis=1)[:, : image.shape[1], None]
                image = (image - sum(np.where(wide == mode, x, 0) for mode, x in made.items())) & 0xFF
            else:
                _write_image(out, _pixels(table), table.shape[1], False)
                image = _cross(image, table, bits, -1)
    out.write(0, 1)
    _write_image(out, _pixels(image), image.shape[1], True, cache_bits, references, tile)
    return _file(out.value.to_bytes((out.size + 7) // 8, "little"))
