"""Lossless WebP for many small images at once.

A payload is an image of 64 pixels a row.  Images of a batch are stacked, so
transforms, copies, counts and bit fields of all of them come from the same
few array operations, and prefix codes are built and read for all images in
step, one lane for each image.  What an image is stored as depends on that
image alone.  webp.py reads and writes single images; lanes that need what
is read there only (several code groups, predictors that need the pixel to the
left one by one, large images with few others of their size) go there.
"""

from __future__ import annotations

import struct
from functools import cache, cached_property

import numpy as np

from .textops import mix
from .webp import ALPHABETS, CACHE_FACTOR, CROSS_COLOUR, LENGTH_ORDER, NEAR, PALETTE, PREDICTOR, WebpError, _channels, _cross, _near, _pixels, _symbols, code_lengths, decode_image, entropy_pixels, step_values

WIDTH, MOST_ROWS = 64, 16384
TILE = 4
MODES = (0, 1, 2, 4, 8, 9)
FACTORS = (0, 16, 32)
#: Fewer images than this of about one size are read one by one.
FEW = 16
#: Fewer images than this are not worth a step of array operations for each pixel.
LEAST_IN_STEP = 64
#: Images and pixels that are read in step at once.
MOST_LANES, MOST_PIXELS = 1536, 1 << 21
_BY_ROW = np.isin(np.arange(16), (0, 1, 2, 3, 4, 8, 9))
_EMPTY = np.zeros(0, np.int64)
_LITERAL = 65536 << 6
_VALUE_BITS = np.maximum(np.arange(40) - 2 >> 1, 0)
_VALUE_LEAST = np.where(np.arange(40) < 4, np.arange(40), (2 + (np.arange(40) & 1)) << _VALUE_BITS) + 1
_NEAR_X, _NEAR_Y = np.array([(0, 0), *NEAR]).T.copy()


@cache
def _reversed15() -> np.ndarray:
    v, out = np.arange(1 << 15), np.zeros(1 << 15, np.int64)
    for k in range(15):
        out |= ((v >> k) & 1) << (14 - k)
    return out


@cache
def _logs() -> np.ndarray:
    """log2 of whole numbers in 256ths of a bit."""
    return np.round(256 * np.log2(np.maximum(np.arange((1 << 20) + 1), 1))).astype(np.int32)


def _first(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


class Streams:
    """The bit fields of many streams, gathered segment by segment."""

    def __init__(self, many: int):
        self.many, self.parts, self.sizes = many, [], np.zeros(many, np.int64)

    def add(self, owner: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        """Fields of at most 63 bits, in ascending order of their streams."""
        sizes = np.asarray(sizes, np.int64)
        total = np.bincount(owner, weights=sizes, minlength=self.many).astype(np.int64)
        at = np.cumsum(sizes) - sizes - _first(total)[owner] + self.sizes[owner]
        self.parts.append((owner, np.asarray(values).astype(np.uint64), at))
        self.sizes += total

    def each(self, value, size):
        """One field for each stream."""
        own = np.arange(self.many)
        self.add(own, np.broadcast_to(value, own.shape), np.broadcast_to(size, own.shape))

    def bodies(self) -> list[bytes]:
        words = (self.sizes + 63) // 64 + 1
        base = _first(words)
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        for owner, values, at in self.parts:
            at = at + 64 * base[owner]
            place, shift = at >> 6, (at & 63).astype(np.uint64)
            np.add.at(out, place, values << shift)
            np.add.at(out, place + 1, (values >> np.uint64(1)) >> (np.uint64(63) - shift))
        data = out.tobytes()
        return [data[8 * b : 8 * b + n] for b, n in zip(base.tolist(), ((self.sizes + 7) // 8).tolist(), strict=True)]


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by several keys of no negative values, which together differ everywhere; the first counts most."""
    packed, used = np.zeros(len(keys[0]), np.int64), 0
    for key in reversed(keys):
        packed |= key.astype(np.int64) << used
        used += int(key.max(initial=0)).bit_length()
    if used > 62:
        return np.lexsort(keys[::-1])
    own = len(packed).bit_length()
    if used + own > 62:
        return np.argsort(packed)
    packed = packed << own | np.arange(len(packed))
    packed.sort()
    return packed & ((1 << own) - 1)


def huffman_lengths(row: np.ndarray, symbol: np.ndarray, count: np.ndarray, rows: int, most: int) -> np.ndarray:
    """Huffman code lengths of the entries (ordered by row) of many codes; counts are halved until none is longer than `most`."""
    many = np.bincount(row, minlength=rows)
    out = np.ones(len(row), np.int64)
    if rows <= 5 * FEW:
        for r, a in zip(np.flatnonzero(many > 1).tolist(), _first(many)[many > 1].tolist(), strict=True):
            b = a + many[r]
            own = code_lengths(dict(zip(symbol[a:b].tolist(), count[a:b].tolist(), strict=True)), int(symbol[a:b].max()) + 1, most)
            out[a:b] = np.array(own)[symbol[a:b]]
        return out
    # rows of many symbols first, so that the rows still at work are a prefix
    rank = np.argsort(-many, kind="stable")
    place = np.empty(rows, np.int64)
    place[rank] = np.arange(rows)
    rows = int((many > 1).sum())
    if not rows:
        return out
    order = _order(place[row], count, symbol)
    n = many[rank][:rows]
    order = order[: n.sum()]
    at_row, at = np.repeat(np.arange(rows), n), np.arange(n.sum()) - np.repeat(_first(n), n)
    k = int(n[0])
    none = np.iinfo(np.int64).max // 4
    # by rank of the node, then row: what is next in a row moves on by `rows`
    leaf_w, inner_w = np.full((k + 1) * rows, none), np.full(k * rows, none)
    leaf_w[at * rows + at_row] = count[order]
    leaf_up, inner_up = np.zeros((k + 1) * rows, np.int64), np.zeros(k * rows, np.int64)
    leaf, inner = np.arange(rows), np.arange(rows)
    active = [int(x) for x in np.searchsorted(-n, -(np.arange(k - 1) + 1), "left")]  # rows with more than t + 1 symbols
    for t, live in enumerate(active):
        total = inner_w[t * rows : t * rows + live]
        least = []
        for _ in range(2):
            a, b = leaf[:live], inner[:live]
            x, y = leaf_w.take(a), inner_w.take(b)
            least.append(np.minimum(x, y))
            leaf_up[a], inner_up[b] = t, t  # the one that isn't taken is written again when it is
            step = np.where(x <= y, rows, 0)
            a += step
            b += rows - step
        np.add(*least, out=total)
    depth = np.zeros(k * rows, np.int64)
    lanes = np.arange(rows)
    for t in range(k - 3, -1, -1):
        live = active[t + 1]
        depth[t * rows : t * rows + live] = depth.take(inner_up[t * rows : t * rows + live] * rows + lanes[:live]) + 1
    found = depth[leaf_up[at * rows + at_row] * rows + at_row] + 1
    out[order] = found
    long = np.bincount(at_row, weights=found > most, minlength=rows) > 0
    if long.any():
        again = np.flatnonzero(np.isin(row, rank[:rows][long]))
        _, dense = np.unique(row[again], return_inverse=True)
        out[again] = huffman_lengths(dense, symbol[again], (count[again] + 1) // 2, int(dense.max()) + 1, most)
    return out


def _words(row: np.ndarray, symbol: np.ndarray, length: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits as the stream holds them, how many) of canonical codes' entries, ordered by row; a lone symbol takes none."""
    order = _order(row, length, symbol)
    share = np.int64(1) << (15 - length[order])
    many = np.bincount(row, minlength=rows)
    running = np.cumsum(share) - share
    begin = _first(many)[row[order]]
    words, sizes = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    alone = many[row] == 1
    words[order] = _reversed15()[np.where(alone[order], 0, running - running[begin]) if len(row) else _EMPTY]
    sizes[:] = np.where(alone, 0, length)
    words[alone] = 0
    return words, sizes


def _write_codes(out: Streams, row: np.ndarray, symbol: np.ndarray, length: np.ndarray):
    """One prefix code for each stream from its entries, ordered by stream and symbol."""
    rows = out.many
    many = np.bincount(row, minlength=rows)
    begin = _first(many)
    lone = np.zeros(rows, np.int64)
    lone[many == 1] = symbol[begin[many == 1]]
    simple = (many <= 1) & (lone < 256)
    keep = ~simple[row]
    row, symbol, length = row[keep], symbol[keep], length[keep]
    n = len(row)
    fresh = np.ones(n, bool)
    fresh[1:] = row[1:] != row[:-1]
    gap = symbol.copy()
    gap[1:] = np.where(fresh[1:], symbol[1:], symbol[1:] - symbol[:-1] - 1)
    # runs of one length: the first is written, the rest in sixes, then a shorter repeat or one by one
    head = np.ones(n, bool)
    head[1:] = fresh[1:] | (gap[1:] > 0) | (length[1:] != length[:-1])
    run = np.cumsum(head) - 1
    size = np.bincount(run, minlength=1) if n else _EMPTY
    offset = np.arange(n) - (_first(size)[run] if n else 0)
    left = (size[run] - 1 if n else _EMPTY) - (offset - 1)  # how many of the run from this one on
    q, rest = offset - 1, (size[run] - 1) % 6 if n else _EMPTY
    in_six = (offset > 0) & (left > rest)
    six = in_six & (q % 6 == 0)
    short = (offset > 0) & ~in_six & (rest >= 3)
    last = short & (left == rest)
    emits = ~((in_six & ~six) | (short & ~last))
    token = np.where(six | last, 16, length)
    extra = np.where(six, 3, np.where(last, rest - 3, 0))
    bits = np.where(six | last, 2, 0)
    full, tail = gap // 138, gap % 138
    zeros = full + np.where(tail >= 3, 1, tail)
    each = zeros + emits
    entry = np.repeat(np.arange(n), each)
    k = np.arange(len(entry)) - _first(each)[entry]
    is_zero, is_full = k < zeros[entry], k < full[entry]
    t = tail[entry]
    t_token = np.where(is_full, 18, np.where(is_zero, np.where(t >= 11, 18, np.where(t >= 3, 17, 0)), token[entry]))
    t_extra = np.where(is_full, 127, np.where(is_zero, np.where(t >= 11, t - 11, np.where(t >= 3, t - 3, 0)), extra[entry]))
    t_bits = np.where(t_token == 18, 7, np.where(t_token == 17, 3, np.where(is_zero, 0, bits[entry])))
    t_row = row[entry]
    steps = np.bincount(t_row, minlength=rows)
    counts = np.bincount(t_row * 19 + t_token, minlength=rows * 19)
    used = np.flatnonzero(counts)
    own_row, own_symbol = used // 19, used % 19
    own = huffman_lengths(own_row, own_symbol, counts[used], rows, 7)
    table = np.zeros((rows, 19), np.int64)
    table[own_row, own_symbol] = own
    ordered = table[:, LENGTH_ORDER]
    written = np.maximum(4, 19 - np.argmax(ordered[:, ::-1] > 0, axis=1))
    out.each(np.where(simple, 5 | lone << 3, (written - 4) << 1), np.where(simple, 11, 5))
    lengths = (ordered << (3 * np.arange(19))).sum(1)
    out.each(np.where(simple, 0, lengths), np.where(simple, 0, 3 * written))
    more = np.maximum(steps - 2, 0)
    width = np.maximum(2, (np.frexp(more.astype(np.float64))[1] + 1) & ~1).astype(np.int64)
    out.each(np.where(simple, 0, 1 | ((width - 2) // 2) << 1 | more << 4), np.where(simple, 0, 4 + width))
    words, sizes = _words(own_row, own_symbol, own, rows)
    word, bits = np.zeros((rows, 19), np.int64), np.zeros((rows, 19), np.int64)
    word[own_row, own_symbol], bits[own_row, own_symbol] = words, sizes
    w, b = word[t_row, t_token], bits[t_row, t_token]
    out.add(t_row, w | t_extra << b, b + t_bits)


def _last_equal(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it of the same key, of at most 43 bits, or -1."""
    keyed = keys.astype(np.uint64) << np.uint64(21) | np.arange(len(keys), dtype=np.uint64)
    keyed.sort()
    order = (keyed & np.uint64((1 << 21) - 1)).astype(np.int64)
    keyed >>= np.uint64(21)
    out = np.full(len(keys), -1, np.int64)
    same = (keyed[1:] == keyed[:-1]).nonzero()[0]
    out[order[same + 1]] = order[same]
    return out


def _copies(p: np.ndarray, owner: np.ndarray, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, how many, distance) of the copies, of three pixels or more, that a greedy pass takes; none leaves its image."""
    n = len(p) - 2
    if n < 2:
        return _EMPTY, _EMPTY, _EMPTY
    wide = p.astype(np.uint64)
    key, own = mix(mix(wide[:-2] << np.uint64(32) | wide[1:-1]) ^ wide[2:]), owner[:-2]
    whole = own == owner[2:]
    # a part of the hash nearly always does; where other windows share it, all of it is sorted
    last = _last_equal(own.astype(np.uint64) << np.uint64(33) | key >> np.uint64(31))
    same = (p[last] == p[:-2]) & (p[last + 1] == p[1:-1]) & (p[last + 2] == p[2:])
    if (whole & (last >= 0) & ~same).any():
        order = np.lexsort((key, own))
        equal = ((key[order[1:]] == key[order[:-1]]) & (own[order[1:]] == own[order[:-1]])).nonzero()[0]
        last = np.full(n, -1, np.int64)
        last[order[equal + 1]] = order[equal]
        same = (p[last] == p[:-2]) & (p[last + 1] == p[1:-1]) & (p[last + 2] == p[2:])
    ok = whole & (last >= 0) & same
    breaks = np.ones(n, bool)
    breaks[1:] = ~(ok[1:] & ok[:-1] & (last[1:] == last[:-1] + 1))
    end = np.append(np.flatnonzero(breaks)[1:], n)[np.cumsum(breaks) - 1]  # where this run of windows ends
    at = np.flatnonzero(ok)
    length = np.minimum(end[at] - at + 2, most)
    taken, free = [], 0
    for k, (a, b) in enumerate(zip(at.tolist(), (at + length).tolist(), strict=True)):
        if a >= free:
            taken.append(k)
            free = b
    taken = np.array(taken, np.int64)
    return at[taken], length[taken], at[taken] - last[at[taken]]


def _write_images(out: Streams, pixels: np.ndarray, owner: np.ndarray, width: int = 0, cache_bits: np.ndarray | None = None):
    """One entropy-coded image for each stream; with cache_bits it is the main one, with copies and a colour cache."""
    pixels = pixels.astype(np.uint32)
    n = len(pixels)
    begins, length, distance = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    cached = np.zeros(n, bool)
    alphabet = ALPHABETS[0]
    if cache_bits is None:
        out.each(0, 1)
    else:
        out.each(1 | cache_bits << 1, 6)  # a cache; no meta codes
        at, many, back = _copies(pixels, owner)
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, at + 1, 1)
        np.add.at(inside, at + many, -1)
        begins = np.cumsum(inside[:n]) == 0
        near = np.arange(8 * width + 9) + 120
        for far, code in _near(width).items():
            near[far] = code
        length[at], distance[at] = many, np.where(back < len(near), near[np.minimum(back, len(near) - 1)], back + 120)
        slots = ((pixels * np.uint32(CACHE_FACTOR)) >> (32 - cache_bits[owner]).astype(np.uint32)).astype(np.int64)
        last = _last_equal(owner << 11 | slots)
        cached = (last >= 0) & (pixels[last] == pixels)
        alphabet += 1 << int(cache_bits.max())
    at = np.flatnonzero(begins)
    p, length, distance, owner = pixels[at], length[at], distance[at], owner[at]
    copy = length > 0
    cached = cached[at] & ~copy
    literal = ~copy & ~cached
    green, red, blue, alpha = (((p >> np.uint32(k)) & np.uint32(255)).astype(np.int64) for k in (8, 16, 0, 24))
    if cached.any():
        green[cached] = 280 + slots[at][cached]
    values, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    lengths = distances = [np.zeros(len(at), np.int64)] * 3
    if copy.any():
        lengths, distances = _symbols(length), _symbols(distance)
        green[copy] = 256 + lengths[0][copy]
    streams = ((green, None, alphabet, lengths), (red, literal, 256, None), (blue, literal, 256, None), (alpha, literal, 256, None), (distances[0], copy, 40, distances))
    cells, entries, counted = [], [], []
    for symbol, used, size, _ in streams:
        some = slice(None) if used is None else used
        cells.append(owner[some] * size + symbol[some])
        counts = np.bincount(cells[-1], minlength=out.many * size)
        entries.append(np.flatnonzero(counts))
        counted.append(counts[entries[-1]])
    rows = [k * out.many + entry // size for k, (entry, (_, _, size, _)) in enumerate(zip(entries, streams, strict=True))]
    syms = [entry % size for entry, (_, _, size, _) in zip(entries, streams, strict=True)]
    built = huffman_lengths(np.concatenate(rows), np.concatenate(syms), np.concatenate(counted), 5 * out.many, 15)
    built = np.split(built, np.cumsum([len(x) for x in entries])[:-1])
    for k, (_, used, size, more) in enumerate(streams):
        row = rows[k] - k * out.many
        _write_codes(out, row, syms[k], built[k])
        words, bits = (np.zeros(out.many * size, np.int64) for _ in range(2))
        words[entries[k]], bits[entries[k]] = _words(row, syms[k], built[k], out.many)
        some = np.arange(len(at)) if used is None else np.flatnonzero(used)
        values[some] |= words[cells[k]] << sizes[some]
        sizes[some] += bits[cells[k]]
        if more is not None and copy.any():
            now = np.flatnonzero(copy)
            values[now] |= more[1][now] << sizes[now]
            sizes[now] += more[2][now]
    out.add(owner, values, sizes)


def _cost(values: np.ndarray, image: np.ndarray, total: np.ndarray) -> np.ndarray:
    """256ths of a bit for each sample (rows, 64), by its image's own counts."""
    cell = (image[:, None] << 8) + values
    counts = np.bincount(cell.ravel(), minlength=len(total) << 8)
    return (np.repeat(_logs()[total], 256) - _logs()[counts]).take(cell)


class _Batch:
    """Images of 64 pixels a row, stacked: rows by image, and tiles."""

    def __init__(self, samples: list[np.ndarray]):
        self.heights = np.array([len(x) for x in samples], np.int64)
        self.many = len(samples)
        self.stack = np.concatenate(samples)
        self.image = np.repeat(np.arange(self.many), self.heights)
        self.row = np.arange(len(self.stack)) - _first(self.heights)[self.image]
        self.total = self.heights * WIDTH
        self.tiles = (self.heights + (1 << TILE) - 1 >> TILE) * (WIDTH >> TILE)
        self.tile = (_first(self.tiles)[self.image] + (self.row >> TILE) * (WIDTH >> TILE))[:, None] + (np.arange(WIDTH) >> TILE)
        self.tile_row = np.flatnonzero(self.row & ((1 << TILE) - 1) == 0)
        self.tile_image = np.repeat(np.arange(self.many), self.tiles)

    def by_tile(self, cost: np.ndarray) -> np.ndarray:
        rows = np.add.reduceat(cost, self.tile_row, axis=0, dtype=np.int64)
        return rows.reshape(len(rows), -1, 1 << TILE).sum(2).ravel()

    def predictions(self, image: np.ndarray):
        """What each of MODES makes of the stacked image, one after the other."""
        left, top, corner, right = (np.zeros_like(image) for _ in range(4))
        left[:, 1:] = image[:, :-1]
        top[1:] = image[:-1]
        corner[:, 1:] = top[:, :-1]
        right[:, :-1] = top[:, 1:]
        right[:, -1] = image[:, 0]
        first = self.row == 0
        for mode in MODES:
            made = _predicted(mode, left, top, corner, right).copy()
            made[:, 0] = top[:, 0]
            made[first] = left[first]
            yield made


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


def _predicted(mode: int, left, top, corner, right) -> np.ndarray:
    """Predictors that bytes alone can express; without alpha, of which nothing is left here."""
    if mode == 0:
        return np.zeros_like(top)
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    return _mean(corner, top) if mode == 8 else _mean(top, right)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int8).astype(np.int16)


def _transformed(batch: _Batch, out: Streams) -> np.ndarray:
    """Writes green, predictor and cross-colour transforms that estimated entropy chooses; what is left of the samples."""
    image = batch.stack
    less = image.copy()
    less[..., 0] -= image[..., 1]
    less[..., 2] -= image[..., 1]
    cost = [sum(_cost(x[..., c], batch.image, batch.total).sum(1, dtype=np.int64) for c in (0, 2)) for x in (image, less)]
    green = np.bincount(batch.image, weights=cost[1] - cost[0], minlength=batch.many) < 0
    image = np.where(green[batch.image][:, None, None], less, image)
    out.each(np.where(green, 5, 0), np.where(green, 3, 0))
    rests, costs = [], []
    for made in batch.predictions(image):
        rests.append(image - made)
        costs.append(batch.by_tile(sum(_cost(rests[-1][..., c], batch.image, batch.total) for c in range(3))))
    best = np.argmin(costs, axis=0)
    chosen, image = best[batch.tile], rests[0]
    for k in range(1, len(rests)):
        np.copyto(image, rests[k], where=(chosen == k)[..., None])
    out.each(1 | PREDICTOR << 1 | (TILE - 2) << 3, 6)
    _write_images(out, np.array(MODES)[best] << 8, batch.tile_image)
    factors = np.zeros((4, len(best)), np.int64)
    taken = np.zeros(image.shape[:2], np.int16)
    for channel, source, place in ((0, 1, 3), (2, 1, 2), (2, 0, 1)):
        base, other, tried = image[..., channel].astype(np.int16), _signed(np.ascontiguousarray(image[..., source])), []
        for f in FACTORS:
            tried.append(batch.by_tile(_cost((base - taken - (f * other >> 5)).astype(np.uint8), batch.image, batch.total)))
        factors[place] = np.array(FACTORS)[np.argmin(tried, axis=0)]
        change = (factors[place].astype(np.int16)[batch.tile] * other) >> 5
        if place == 3:
            red = (base - change).astype(np.uint8)
        else:
            taken += change
    image = np.stack([red, image[..., 1], (image[..., 2].astype(np.int16) - taken).astype(np.uint8)], -1)
    out.each(1 | CROSS_COLOUR << 1 | (TILE - 2) << 3, 6)
    _write_images(out, 255 << 24 | factors[1] << 16 | factors[2] << 8 | factors[3], batch.tile_image)
    return image


def _packed(batch: _Batch, out: Streams, pack: int) -> np.ndarray:
    """Writes palettes; the bundled indices, as green samples (rows, width)."""
    colour = _rgb(batch.stack).astype(np.int64).ravel() | np.repeat(batch.image, WIDTH) << 32
    known, index = np.unique(colour, return_inverse=True)
    owner = known >> 32
    size = np.bincount(owner, minlength=batch.many)
    index = index.reshape(-1, WIDTH) - _first(size)[batch.image][:, None]
    out.each(1 | PALETTE << 1 | (size - 1) << 3, 11)
    table = _channels((known & 0xFFFFFFFF).astype(np.uint32))
    step = np.diff(table, axis=0, prepend=0)
    begin = _first(size)
    step[begin] = table[begin]
    _write_images(out, _pixels(step), owner)
    depth = 8 >> pack
    return (index.reshape(len(index), WIDTH >> pack, 1 << pack) << (depth * np.arange(1 << pack))).sum(-1)


def _rgb(samples: np.ndarray) -> np.ndarray:
    red, green, blue = (samples[..., k].astype(np.uint32) for k in range(3))
    return np.uint32(255 << 24) | red << np.uint32(16) | green << np.uint32(8) | blue


def _file(body: bytes) -> bytes:
    padded = len(body) + (len(body) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + padded, b"WEBP", b"VP8L", len(body)) + body + b"\0" * (padded - len(body))


def encode_batch(samples: list[np.ndarray]) -> list[bytes]:
    """A lossless WebP file of each array of 8-bit samples (height, 64, red green blue): a palette where it is short, else transforms by content."""
    heights = np.array([len(x) for x in samples])
    image = np.repeat(np.arange(len(samples)), heights)
    keyed = np.sort(np.repeat(image, WIDTH) << 24 | (_rgb(np.concatenate(samples)).ravel() & 0xFFFFFF))
    colours = np.bincount(keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])] >> 24)
    small = (colours <= 256) & (2 * colours <= heights * WIDTH)
    pack = np.where(small, np.select([colours <= 2, colours <= 4, colours <= 16], [3, 2, 1], 0), -1)
    files: list[bytes] = [b""] * len(samples)
    for kind in np.unique(pack).tolist():
        own = np.flatnonzero(pack == kind).tolist()
        batch = _Batch([samples[k] for k in own])
        out = Streams(len(own))
        out.each(0x2F | (WIDTH - 1) << 8 | (batch.heights - 1) << 22 | 1 << 36, 40)
        if kind < 0:
            rest, width = _transformed(batch, out), WIDTH
            pixels = (rest[..., 0].astype(np.uint32) << np.uint32(16)) | (rest[..., 1].astype(np.uint32) << np.uint32(8)) | rest[..., 2]
        else:
            pixels, width = 255 << 24 | _packed(batch, out, kind) << 8, WIDTH >> kind
        out.each(0, 1)
        total = batch.heights * width
        cache_bits = np.clip(np.frexp(total.astype(np.float64))[1] - 2, 1, 10).astype(np.int64)
        _write_images(out, pixels.ravel(), np.repeat(np.arange(len(own)), total), width, cache_bits)
        for k, body in zip(own, out.bodies(), strict=True):
            files[k] = _file(body)
    return files


class _Codes:
    """Prefix codes of many lanes, read in step."""

    ROOT = 9

    def __init__(self, row: np.ndarray, symbol: np.ndarray, length: np.ndarray, rows: int):
        """Entries in the order of rows and symbols."""
        many = np.bincount(row, minlength=rows)
        self.alone = many <= 1
        order = np.argsort(row << 4 | length, kind="stable")
        row, symbol, length = row[order], symbol[order], length[order]
        share = np.int64(1) << (15 - length)
        whole = np.bincount(row, weights=share, minlength=rows)
        if (whole[~self.alone] != 1 << 15).any():
            raise WebpError("a prefix code isn't complete")
        lone = np.zeros(rows, np.int64)
        lone[row[self.alone[row]]] = symbol[self.alone[row]]
        running = np.cumsum(share) - share
        begin = _first(many)
        running = running - running[begin[row]] if len(row) else running
        self.row, self.symbol, self.length, self.running, self.many, self.begin, self.lone = row, symbol, length, running, many, begin, lone
        self.some = not self.alone.all()

    @cached_property
    def table(self) -> np.ndarray:
        """symbol << 5 | length by lane and the next bits; 0 where the word is longer."""
        row, length = self.row, self.length
        out = np.zeros((len(self.many), 1 << self.ROOT), np.int64)
        out[self.alone] = (self.lone[self.alone] << 5 | 16)[:, None]  # 16: no bits
        short = np.flatnonzero((length <= self.ROOT) & ~self.alone[row])
        wide = np.int64(1) << (self.ROOT - length[short])
        at = np.repeat((row[short] << self.ROOT) + (self.running[short] >> (15 - self.ROOT)) - _first(wide), wide) + np.arange(wide.sum())
        out = out.ravel()
        out[at] = np.repeat(self.symbol[short] << 5 | length[short], wide)
        return out

    @cached_property
    def limits(self) -> tuple[np.ndarray, np.ndarray]:
        """By lane and length: where longer words begin, and the first symbol's place."""
        rows = len(self.many)
        cell = self.row << 4 | self.length
        count = np.bincount(cell, minlength=rows << 4).reshape(rows, 16)
        return np.cumsum(count << (15 - np.arange(16)), axis=1), self.begin[:, None] + np.cumsum(count, axis=1) - count

    def steps(self, code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """step_values() of all lanes, by the bits that follow; where a lane's begin, and how many bits its longest word has."""
        rows = len(self.many)
        longest = np.zeros(rows, np.int64)
        some = ~self.alone
        longest[some] = self.length[(self.begin + self.many - 1)[some]]
        size = np.int64(1) << longest
        begin = _first(size)
        own = np.flatnonzero(some[self.row])
        ordered = np.zeros(int(size.sum()), np.int32)
        ordered[begin[self.alone]] = step_values(self.lone[self.alone] << 4, code)
        words = step_values(self.symbol[own] << 4 | self.length[own], code).astype(np.int32)
        ordered[np.repeat(some, size)] = np.repeat(words, np.int64(1) << (longest[self.row[own]] - self.length[own]))
        at = np.arange(len(ordered)) - np.repeat(begin, size)
        return ordered[np.repeat(begin, size) + (_reversed15()[at] >> np.repeat(15 - longest, size))].astype(np.int64), begin, longest

    def read(self, lanes: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, bits taken) for the lanes from the bits that follow."""
        if not self.some:
            return self.lone[lanes], np.zeros(len(lanes), np.int64)
        value = _reversed15()[ahead & 0x7FFF]
        found = self.table[(lanes << self.ROOT) + (value >> (15 - self.ROOT))]
        size, symbol = found & 15, found >> 5
        long = np.flatnonzero(found == 0)
        if len(long):
            r, v = lanes[long], value[long]
            limit, start = self.limits
            n = 1 + (v[:, None] >= limit[r, 1:15]).sum(1)
            size[long] = n
            symbol[long] = self.symbol[start[r, n] + ((v - limit[r, n - 1]) >> (15 - n))]
        return symbol, size


class _Reader:
    """Bit positions of many streams in one buffer."""

    def __init__(self, bodies: list[bytes]):
        sizes = np.array([len(x) for x in bodies], np.int64)
        data = b"".join(bodies) + bytes(16)
        self.at = 8 * _first(sizes)
        self.end = self.at + 8 * sizes
        self.most = len(data) - 8
        self.words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))

    @cached_property
    def pairs(self) -> np.ndarray:
        """The eight bytes from every second byte on."""
        return np.ascontiguousarray(self.words[::2]).view(np.int64)

    def ahead(self, lanes: np.ndarray) -> np.ndarray:
        """At least 57 of the bits that follow."""
        at = self.at[lanes]
        return (self.words[np.minimum(at >> 3, self.most)] >> (at & 7).astype(np.uint64)).view(np.int64)

    def read(self, lanes: np.ndarray, n) -> np.ndarray:
        value = self.ahead(lanes) & ((np.int64(1) << n) - 1)
        self.at[lanes] += n
        return value

    def check(self):
        if (self.at > self.end).any():
            raise WebpError("a stream ends early")


def _read_codes(bits: _Reader, lanes: np.ndarray, size: np.ndarray) -> _Codes:
    """One prefix code for each lane; size: its alphabet."""
    rows = len(lanes)
    own = np.arange(rows)
    simple = bits.read(lanes, 1) > 0
    found = []
    s = own[simple]
    if len(s):
        two, wide = bits.read(lanes[s], 1), bits.read(lanes[s], 1)
        found.append((s, bits.read(lanes[s], np.where(wide > 0, 8, 1)), np.ones(len(s), np.int64)))
        both = s[two > 0]
        found.append((both, bits.read(lanes[both], 8), np.ones(len(both), np.int64)))
    s = own[~simple]
    if len(s):
        many = 4 + bits.read(lanes[s], 4)
        table = np.zeros((len(s), 19), np.int64)
        packed = bits.ahead(lanes[s]) & ((np.int64(1) << 3 * many) - 1)
        bits.at[lanes[s]] += 3 * many
        table[:, LENGTH_ORDER] = (packed[:, None] >> (3 * np.arange(19))) & 7
        r, sym = np.nonzero(table)
        code = _Codes(r, sym, table[r, sym], len(s))
        limited = bits.read(lanes[s], 1) > 0
        steps = size[s].copy()
        some = np.flatnonzero(limited)
        width = 2 + 2 * bits.read(lanes[s][some], 3)
        steps[some] = 2 + bits.read(lanes[s][some], width)
        r, sym, length, bits.at[lanes[s]] = _lengths_in_step(bits, bits.at[lanes[s]], code, steps, size[s])
        found.append((s[r], sym, length))
    row, symbol, length = (np.concatenate(x) for x in zip(*found, strict=True))
    if (symbol >= size[row]).any():
        raise WebpError("no such symbol")
    order = np.argsort(row << 12 | symbol, kind="stable")
    return _Codes(row[order], symbol[order], length[order], rows)


def _lengths_in_step(bits: _Reader, at: np.ndarray, code: _Codes, steps: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lanes, symbols, code lengths) that run-length tokens of each lane mean, as many as steps or until size symbols are named, and the bits after them."""
    table, begin, longest = code.steps(2)
    token, n_bits = table >> 6, table & 63
    extra = np.where(token < 16, 0, np.array([2, 3, 7])[np.maximum(token - 16, 0)])
    least = np.where(token < 16, 1, np.where(token == 18, 11, 3))
    # a token's least run, mask of extra bits, bits in all, bits of its word, and itself
    table = ((least << 7 | (1 << extra) - 1) << 5 | n_bits + extra) << 8 | n_bits << 5 | token
    # a column for each lane at work
    state = np.stack([np.arange(len(at)), at, np.zeros_like(at), steps, size, begin, (1 << longest) - 1])
    ends, tokens = at.copy(), []
    words = bits.pairs
    while state.shape[1]:
        lane, at, place, left, most, begin, mask = state
        live = True
        while live:
            ahead = words.take(at >> 4, mode="clip")
            ahead >>= at & 15
            index = ahead & mask
            index += begin
            step = table.take(index)
            ahead >>= step >> 5 & 7
            ahead &= step >> 13 & 127
            ahead += step >> 20
            tokens.append((lane, step & 31, ahead))
            at += step >> 8 & 31
            place += ahead
            left -= 1
            done = (left <= 0) | (place >= most)
            live = not done.any()
        if (place > most).any():
            raise WebpError("too many code lengths")
        ends[lane[done]] = at[done]
        state = state[:, ~done]
    lane, token, n = (np.concatenate(x) for x in zip(*tokens, strict=True))
    order = np.argsort(lane.astype(np.uint16 if len(ends) <= 1 << 16 else np.int64), kind="stable")
    lane, token, n = lane[order], token[order], n[order]
    place = _first(n)
    many = np.bincount(lane, minlength=len(ends))
    first = _first(many)
    place -= place[first][lane]
    # a repeat means the last length before it that isn't zero
    known = np.where((token > 0) & (token < 16), np.arange(len(token)), -1)
    last = np.maximum.accumulate(known)
    value = np.where(last >= first[lane], token[last], 8)
    n = np.where(token == 16, n, known >= 0)
    entry = np.repeat(np.arange(len(n)), n)
    return lane[entry], place[entry] + np.arange(len(entry)) - _first(n)[entry], value[entry], ends


def _read_lanes(bits: _Reader, lanes: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """The entropy-coded image of each lane as flat pixels, and which lanes have several code groups and were left."""
    cache_bits = np.zeros(len(lanes), np.int64)
    with_cache = bits.read(lanes, 1) > 0
    cache_bits[with_cache] = bits.read(lanes[with_cache], 4)
    if (cache_bits > 11).any():
        raise WebpError("the colour cache is too large")
    left = (bits.read(lanes, 1) > 0) if main else np.zeros(len(lanes), bool)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(lanes)
    ids = np.flatnonzero(~left)
    lanes, width, cache_bits = lanes[ids], width[ids], cache_bits[ids]
    total = width * height[ids]
    if not len(ids):
        return out, left
    codes = [_read_codes(bits, lanes, np.full(len(lanes), n) + (np.where(cache_bits > 0, 1 << cache_bits, 0) if k == 0 else 0)) for k, n in enumerate(ALPHABETS)]
    bare = np.logical_and.reduce([c.alone for c in codes[:4]]) & (codes[0].lone < 256)  # no bits at all
    colour = codes[3].lone << 24 | codes[1].lone << 16 | codes[0].lone << 8 | codes[2].lone
    for k in np.flatnonzero(bare).tolist():
        out[ids[k]] = np.full(total[k], colour[k], np.uint32)
    some = np.flatnonzero(~bare)
    if len(some):
        found = _pixels_in_step(bits, lanes, some, codes, width, total, cache_bits)
        for k, pixels in zip(some.tolist(), found, strict=True):
            out[ids[k]] = pixels
    return out, left


def _pixels_in_step(bits: _Reader, lanes: np.ndarray, some: np.ndarray, codes: list[_Codes], width: np.ndarray, total: np.ndarray, cache_bits: np.ndarray) -> list[np.ndarray]:
    """The pixels of some lanes: a pixel or a copy of each lane in a step, and one by one once few lanes are left."""
    tables, masks, begins = [], [], []
    held = 0
    for k, code in enumerate(codes):
        table, begin, longest = code.steps(k)
        tables.append(table)
        begins.append(begin[some] + held)
        masks.append((np.int64(1) << longest[some]) - 1)
        held += len(table)
    table = np.concatenate(tables)
    total, width, cache_bits = total[some], width[some], cache_bits[some]
    first = _first(total)
    out = np.zeros(int(total.sum()), np.int64)
    colours = np.int64(1) << cache_bits
    cache, with_cache = np.zeros(int(colours.sum()), np.int64), bool(cache_bits.any())
    opaque = bool(codes[3].alone[some].all())
    alpha = codes[3].lone[some] << 24 if opaque else np.zeros(len(some), np.int64)
    # a column for each lane at work
    state = np.stack([np.arange(len(some)), bits.at[lanes[some]], first, first + total, *begins[:3], *masks[:3], alpha, 32 - cache_bits, _first(colours)])
    stopped = np.zeros((2, len(some)), np.int64)
    words = bits.pairs
    while state.shape[1] >= LEAST_IN_STEP:
        lane, at, place, end, g_begin, r_begin, b_begin, g_mask, r_mask, b_mask, base, shift, slots = state
        live = True
        while live:
            ahead = words.take(at >> 4, mode="clip")
            ahead >>= at & 15
            index = ahead & g_mask
            index += g_begin
            step = table.take(index)
            special = (step >= _LITERAL).nonzero()[0]
            ahead >>= step & 63
            index = ahead & r_mask
            index += r_begin
            red = table.take(index)
            ahead >>= red & 63
            index = ahead & b_mask
            index += b_begin
            red += table.take(index)
            if len(special):
                first_step = step[special]
            step += red
            taken = step & 63
            step >>= 6
            step += base
            if not opaque:
                index = words.take((at + taken) >> 4, mode="clip") >> (at + taken & 15)
                index = table[begins[3][lane] + (index & masks[3][lane])]
                taken += index & 63
                step += index >> 6 << 24
            if len(special):
                taken[special] = first_step & 63
                symbol = (first_step >> 6) - 65536 - 280  # within its alphabet, so a colour that the cache has
                step[special] = cache.take(slots[special] + symbol, mode="clip")
                copies = (symbol < 0).nonzero()[0]
                if len(copies):
                    of = special[copies]
                    own = lane[of]
                    many, now = _values_in_step(words, at[of] + taken[of], symbol[copies] + 24)
                    found = table.take(begins[4][own] + (words.take(now >> 4, mode="clip") >> (now & 15) & masks[4][own]))
                    far, now = _values_in_step(words, now + (found & 63), found >> 6)
                    near = np.maximum(1, _NEAR_X.take(far, mode="clip") + _NEAR_Y.take(far, mode="clip") * width[own])
                    back = np.where(far > 120, far - 120, near)
                    to = place[of]
                    if (back > to - first[own]).any() or (to + many > end[of]).any():
                        raise WebpError("a back-reference leaves the image")
                    taken[of] = now - at[of]
                    k = np.arange(int(many.sum())) - np.repeat(_first(many), many)
                    copied = out[np.repeat(to - back, many) + k % np.repeat(back, many)]
                    out[np.repeat(to, many) + k] = copied
                    if with_cache:
                        cache[np.repeat(slots[of], many) + ((copied * CACHE_FACTOR & 0xFFFFFFFF) >> np.repeat(shift[of], many))] = copied
                    step[of] = copied[np.cumsum(many) - 1]
                    place[of] += many - 1
            out[place] = step
            if with_cache:
                step_slot = step * CACHE_FACTOR
                step_slot &= 0xFFFFFFFF
                step_slot >>= shift
                step_slot += slots
                cache[step_slot] = step
            at += taken
            place += 1
            live = bool((place < end).all())
        done = place >= end
        stopped[:, lane[done]] = state[1:3, done]
        state = state[:, ~done]
    stopped[:, state[0]] = state[1:3]
    pixels = out.astype(np.uint32)
    bits.at[lanes[some]] = stopped[0]
    found = [pixels[a:b] for a, b in zip(first.tolist(), (first + total).tolist(), strict=True)]
    for k in state[0].tolist():
        begin = int(stopped[0, k])
        own = [table[begins[j][k] : begins[j][k] + masks[j][k] + 1].tolist() for j in range(5)]
        known = out[first[k] : stopped[1, k]].tolist()
        ahead = bits.words[begin >> 3 : (int(bits.end[lanes[some[k]]]) >> 3) + 9].tolist()
        one, to = entropy_pixels(ahead, begin & 7, own, int(width[k]), int(total[k]), int(cache_bits[k]), known)
        bits.at[lanes[some[k]]] = (begin & ~7) + to
        found[k] = np.array(one, np.uint32)
    return found


def _values_in_step(words: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols, and the bits after them."""
    more = _VALUE_BITS.take(symbol)
    extra = words.take(at >> 4, mode="clip") >> (at & 15) & ((1 << more) - 1)
    return _VALUE_LEAST.take(symbol) + extra, at + more


def _unpredicted(rests: list[np.ndarray], modes: list[np.ndarray], tile: int) -> list[np.ndarray]:
    """Images (height, width, alpha red green blue) of one width and tile size, in step: a row's tiles from left to right."""
    height = np.array([len(x) for x in rests])
    order = np.argsort(-height, kind="stable")
    many, width = len(rests), rests[0].shape[1]
    image = np.zeros((many, int(height.max()), width, 4), np.uint8)
    mode = np.zeros((many, int(height.max() - 1 >> tile) + 1, modes[0].shape[1]), np.uint8)
    for lane, k in enumerate(order.tolist()):
        image[lane, : height[k]] = rests[k]
        mode[lane, : len(modes[k])] = modes[k]
    height = height[order]
    image[:, 0, 0, 0] += np.uint8(255)
    image[:, 0] = np.cumsum(image[:, 0], axis=1, dtype=np.uint8)
    image[:, :, 0] = np.cumsum(image[:, :, 0], axis=1, dtype=np.uint8)
    for y in range(1, int(height[0])):
        live = int(np.searchsorted(-height, -y, "left"))
        own, above = image[:live, y], image[:live, y - 1]
        for t in range(mode.shape[2]):
            a, b = max(1, t << tile), min(width, (t + 1) << tile)
            if a >= b:
                continue
            which = mode[:live, y >> tile, t]
            for m in np.unique(which).tolist():
                lanes = np.flatnonzero(which == m)
                part = own[lanes, a:b]
                if m == 1:
                    part[:, 0] += own[lanes, a - 1]
                    part = np.cumsum(part, axis=1, dtype=np.uint8)
                elif m == 0:
                    part[..., 0] += np.uint8(255)
                else:
                    top, corner = above[lanes, a:b], above[lanes, a - 1 : b - 1]
                    right = above[lanes, a + 1 : b + 1] if b < width else np.concatenate([above[lanes, a + 1 : b], own[lanes, :1]], axis=1)
                    part = part + _predicted(m, None, top, corner, right)
                own[lanes, a:b] = part
    out: list[np.ndarray] = [None] * many
    for lane, k in enumerate(order.tolist()):
        out[k] = image[lane, : height[lane]]
    return out


def _decode_lanes(files: list[bytes]) -> list[np.ndarray | None]:
    """Samples (height, width, red green blue) of each file; None where it needs the single decoder."""
    for x in files:
        if len(x) < 25 or x[:4] != b"RIFF" or x[8:16] != b"WEBPVP8L" or x[20] != 0x2F:
            raise WebpError("not a lossless WebP file")
    bits = _Reader([x[21:] for x in files])
    lanes = np.arange(len(files))
    width, height = bits.read(lanes, 14) + 1, bits.read(lanes, 14) + 1
    if (bits.read(lanes, 4) >> 1).any():
        raise WebpError("unknown version")
    own, steps = width.copy(), [[] for _ in files]
    single = np.zeros(len(files), bool)
    live = lanes
    while len(live := live[bits.read(live, 1) > 0]):
        kind = bits.read(live, 2)
        for k in np.unique(kind).tolist():
            some = live[kind == k]
            if k in (PREDICTOR, CROSS_COLOUR):
                tile = bits.read(some, 3) + 2
                across, down = (own[some] + (1 << tile) - 1) >> tile, (height[some] + (1 << tile) - 1) >> tile
                found, _ = _read_lanes(bits, some, across, down, False)
                for i, p, w, t in zip(some.tolist(), found, across.tolist(), tile.tolist(), strict=True):
                    steps[i].append((k, t, p.reshape(-1, w), int(own[i])))
                    single[i] |= k == PREDICTOR and not _BY_ROW[p >> 8 & 15].all()
            elif k == PALETTE:
                size = bits.read(some, 8) + 1
                found, _ = _read_lanes(bits, some, size, np.ones(len(some), np.int64), False)
                pack = np.select([size <= 2, size <= 4, size <= 16], [3, 2, 1], 0)
                for i, p, t in zip(some.tolist(), found, pack.tolist(), strict=True):
                    steps[i].append((k, t, p, int(own[i])))
                own[some] = (own[some] + (1 << pack) - 1) >> pack
            else:
                for i in some.tolist():
                    steps[i].append((k, 0, None, int(own[i])))
    found, left = _read_lanes(bits, lanes, own, height, True)
    single |= left
    bits.check()
    images = [None if single[i] else np.ascontiguousarray(p.reshape(-1, int(own[i]))).view(np.uint8).reshape(-1, int(own[i]), 4)[..., ::-1] for i, p in enumerate(found)]
    return _inverted(images, steps)


def _inverted(images: list, steps: list) -> list[np.ndarray | None]:
    """The transforms undone, last first; lanes whose next one is of one kind and shape are taken together."""
    todo = [i for i, x in enumerate(images) if x is not None]
    while todo := [i for i in todo if steps[i]]:
        groups: dict[tuple, list[int]] = {}
        for i in todo:
            kind, tile, _, before = steps[i][-1]
            groups.setdefault((kind, tile, before), []).append(i)
        for (kind, tile, before), own in groups.items():
            more = [steps[i].pop()[2] for i in own]
            if kind == PREDICTOR:
                made = _unpredicted([images[i] for i in own], [(x >> 8).astype(np.uint8) for x in more], tile)
            elif kind == PALETTE:
                made = [_from_palette(images[i], colours, tile, before) for i, colours in zip(own, more, strict=True)]
            else:
                cut = np.cumsum([len(images[i]) for i in own])[:-1]
                stack = np.concatenate([images[i] for i in own])
                if kind == CROSS_COLOUR:
                    wide = np.concatenate([np.repeat(x, 1 << tile, axis=0)[: len(images[i])] for i, x in zip(own, more, strict=True)])
                    stack = _uncrossed(stack, np.repeat(wide, 1 << tile, axis=1)[:, :before])
                else:
                    stack[..., 1] += stack[..., 2]
                    stack[..., 3] += stack[..., 2]
                made = np.split(stack, cut)
            for i, x in zip(own, made, strict=True):
                images[i] = x
    return [None if x is None else np.ascontiguousarray(x[..., 1:]) for x in images]


def _uncrossed(image: np.ndarray, factors: np.ndarray) -> np.ndarray:
    part = lambda k: (factors >> k & 0xFF).astype(np.uint8).view(np.int8).astype(np.int16)
    green = _signed(np.ascontiguousarray(image[..., 2]))
    image[..., 1] += ((part(0) * green) >> 5).astype(np.uint8)
    red = _signed(np.ascontiguousarray(image[..., 1]))
    image[..., 3] += (((part(8) * green) >> 5) + ((part(16) * red) >> 5)).astype(np.uint8)
    return image


def _from_palette(image: np.ndarray, colours: np.ndarray, pack: int, width: int) -> np.ndarray:
    table = np.zeros((256, 4), np.uint8)
    table[: len(colours)] = np.cumsum(_channels(colours), axis=0)
    at, depth = np.arange(width), 8 >> pack
    return table[(image[..., 2][:, at >> pack] >> (depth * (at & ((1 << pack) - 1))).astype(np.uint8)) & np.uint8((1 << depth) - 1)]


def _pixels_of(file: bytes) -> int:
    size = int.from_bytes(file[21:25], "little")
    return ((size & 0x3FFF) + 1) * ((size >> 14 & 0x3FFF) + 1)


def decode_batch(files: list[bytes]) -> list[np.ndarray]:
    """Samples (height, width, red green blue) of each lossless WebP file."""
    out: list[np.ndarray | None] = [None] * len(files)
    order = sorted(range(len(files)), key=lambda k: len(files[k]))
    pixels = [_pixels_of(x) for x in files]
    begin = 0
    while begin < len(order):
        end, held = begin, 0
        while end < len(order) and end - begin < MOST_LANES and (held == 0 or held + pixels[order[end]] <= MOST_PIXELS) and len(files[order[end]]) <= 256 + 3 * len(files[order[begin]]):
            held += pixels[order[end]]
            end += 1
        own = order[begin:end]
        if len(own) >= FEW:
            for k, x in zip(own, _decode_lanes([files[k] for k in own]), strict=True):
                out[k] = x
        begin = end
    for k, x in enumerate(out):
        if x is None:
            pixels = decode_image(files[k])
            out[k] = np.ascontiguousarray(np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)[..., 2::-1])
    return out


def store_payloads(payloads: list[bytes], most_pixels: int = 1 << 19) -> list[bytes]:
    """Bytes, a positive multiple of 192 each, as WebP files of 64 pixels by at most 16,384 rows, one after the other."""
    parts, owner = [], []
    for k, payload in enumerate(payloads):
        samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
        for a in range(0, len(samples), MOST_ROWS):
            parts.append(samples[a : a + MOST_ROWS])
            owner.append(k)
    media: list[list[bytes]] = [[] for _ in payloads]
    order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
    files: list[bytes] = [b""] * len(parts)
    begin = 0
    while begin < len(order):
        end, held = begin, 0
        while end < len(order) and end - begin < 1024 and (held == 0 or held + len(parts[order[end]]) * WIDTH <= most_pixels):
            held += len(parts[order[end]]) * WIDTH
            end += 1
        own = order[begin:end]
        for k, x in zip(own, encode_batch([parts[k] for k in own]), strict=True):
            files[k] = x
        begin = end
    for k, x in zip(owner, files, strict=True):
        media[k].append(x)
    return [b"".join(x) for x in media]


def read_payloads(media: list[bytes]) -> list[np.ndarray]:
    """The samples (height, 64, 3) of stored payloads."""
    files, owner = [], []
    for k, data in enumerate(media):
        at = 0
        while at < len(data):
            size = 8 + struct.unpack_from("<I", data, at + 4)[0]
            files.append(data[at : at + size])
            owner.append(k)
            at += size
    parts: list[list[np.ndarray]] = [[] for _ in media]
    for k, x in zip(owner, decode_batch(files), strict=True):
        parts[k].append(x)
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in parts]
