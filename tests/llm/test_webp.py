"""Round trips of the WebP codecs: every transform, code groups, copies and the cache, and what stored payloads hold."""

from __future__ import annotations

import numpy as np
import pytest

from motifspark.llm import webp, webp_lanes

RNG = np.random.default_rng(1)
IMAGES = {
    "noise": RNG.integers(0, 2**32, (9, 37), dtype=np.uint32),
    "few": RNG.integers(0, 5, (20, 33)).astype(np.uint32) * np.uint32(0x01030507),
    "slope": (np.add.outer(np.arange(17), np.arange(64)) * 0x010203).astype(np.uint32),
    "row": RNG.integers(0, 2**32, (1, 7), dtype=np.uint32),
    "column": RNG.integers(0, 2**32, (7, 1), dtype=np.uint32),
}


@pytest.mark.parametrize("name", IMAGES)
@pytest.mark.parametrize("options", [{"references": False}, {}, {"cache_bits": 5}, {"cache_bits": 3, "tile": 2}], ids=str)
def test_transforms_come_back(name, options):
    image = IMAGES[name]
    tried = [(), (("green",),), (("cross", 2, RNG.integers(0, 256, (-(-image.shape[0] // 4), -(-image.shape[1] // 4), 4))),)]
    tried += [(("predictor", 2, np.full((-(-image.shape[0] // 4), -(-image.shape[1] // 4)), mode)),) for mode in range(14)]
    tried.append((("green",), ("predictor", 3, RNG.integers(0, 14, (-(-image.shape[0] // 8), -(-image.shape[1] // 8)))), tried[2][0]))
    if len(np.unique(image)) <= 256:
        tried.append((("palette",),))
    for transforms in tried:
        assert (webp.decode_image(webp.encode_image(image, transforms, **options)) == image).all(), transforms


def _payload(text: bytes) -> bytes:
    return text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))


TEXTS = [b"", b"a", b"abc" * 400, b"the same words " * 500, " ".join(f"line {k} of some words, {k * k % 977}" for k in range(400)).encode(), RNG.integers(0, 256, 5000).astype(np.uint8).tobytes(), bytes(range(256)) * 9]


def _many(n: int = 60) -> list[bytes]:
    words = [bytes(RNG.integers(97, 123, RNG.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    return [_payload(x) for x in TEXTS] + [_payload(b"ab c" * k) for k in range(1, 60)] + [_payload(b" ".join(words[i] for i in RNG.integers(0, 300, n_words))) for n_words in RNG.integers(1, 900, n)]


@pytest.mark.parametrize("few", [webp_lanes.FEW, 1 << 30], ids=["in step", "one by one"])
def test_payloads_come_back_from_both_decoders(monkeypatch, few):
    """Batches are read back by the lanes and by the single decoder, and hold every part of the format that their content asks for."""
    monkeypatch.setattr(webp_lanes, "FEW", few)
    payloads, seen = _many(), set()
    for name, found in (("_unpredicted", "predictor"), ("_uncrossed", "cross"), ("_from_palette", "palette")):
        inner = getattr(webp_lanes, name)
        monkeypatch.setattr(webp_lanes, name, lambda *a, inner=inner, found=found: seen.add(found) or inner(*a))
    inner = webp_lanes.entropy_pixels

    def counted(words, at, tables, *more):
        pixels, to = inner(words, at, tables, *more)
        seen.update("codes" for t in tables[:3] if len({x & 15 for x in t}) > 1)
        seen.update({"copy"} if len(tables[4]) > 1 else set())
        seen.update({"cache"} if any(x >> 4 >= 65536 + 280 for x in tables[0]) else set())
        return pixels, to

    monkeypatch.setattr(webp_lanes, "entropy_pixels", counted)
    media = webp_lanes.store_payloads(payloads)
    assert [x.tobytes() for x in webp_lanes.read_payloads(media)] == payloads
    for file, payload in zip(media, payloads, strict=True):
        pixels = webp.decode_image(file)
        assert np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)[..., 2::-1].tobytes() == payload
    assert few > 1000 or seen == {"predictor", "cross", "palette", "codes", "copy", "cache"}


def test_stored_form_depends_on_the_payload_alone():
    payloads = _many(40)
    whole = webp_lanes.store_payloads(payloads)
    assert whole == [webp_lanes.store_payloads([x])[0] for x in payloads]
    assert sum(map(len, whole)) < 0.9 * sum(map(len, payloads))


def test_tall_payloads_are_cut_into_files():
    payload = _payload(b"".join(b"%d lines of a long text\n" % k for k in range(130_000)))
    assert len(payload) > 192 * webp_lanes.MOST_ROWS
    media = webp_lanes.store_payloads([payload])[0]
    assert media.count(b"RIFF") >= 2 and webp_lanes.read_payloads([media])[0].tobytes() == payload


def test_lanes_read_what_the_single_encoder_writes():
    """Also palettes of every size, code groups and predictors that only the single decoder inverts."""
    images = [IMAGES[k] for k in IMAGES] * 4 + [(RNG.integers(0, n, (11, 64)) * 77 + 5).astype(np.uint32) for n in (1, 2, 3, 4, 9, 16, 17, 200)]
    options = [(("green",),), (("predictor", 2, None),), (("cross", 3, None),), ()]
    files = []
    for k, image in enumerate(images):
        steps = []
        for step in options[k % 4] if k < 20 else (("palette",),):
            if len(step) > 1:
                shape = tuple(-(-n // (1 << step[1])) for n in image.shape)
                step = (step[0], step[1], RNG.integers(0, 14 if k % 3 else 5, shape) if step[0] == "predictor" else RNG.integers(0, 256, (*shape, 4)))
            steps.append(step)
        files.append(webp.encode_image(image, tuple(steps), cache_bits=k % 5, tile=2 if k % 7 == 0 else 0))
    found = webp_lanes._decode_lanes(files)
    assert sum(x is None for x in found) < len(files) / 2
    for image, x, y in zip(images, found, webp_lanes.decode_batch(files), strict=True):
        want = np.stack([(image >> np.uint32(k)) & np.uint32(255) for k in (16, 8, 0)], -1)
        assert (y == want).all() and (x is None or (x == want).all())


def test_long_codes_stay_within_the_limit():
    """Fibonacci counts make Huffman words of more than 15 bits before they are evened out; lanes and the single builder agree on cost."""
    fib = [1, 1]
    while len(fib) < 24:
        fib.append(fib[-1] + fib[-2])
    rows = 40
    row, symbol, count = np.repeat(np.arange(rows), 24), np.tile(np.arange(24), rows), np.tile(np.array(fib), rows)
    got = webp_lanes.huffman_lengths(row, symbol, count, rows, 15).reshape(rows, 24)
    assert got.max() <= 15 and (np.sum(1 << (15 - got), axis=1) == 1 << 15).all() and (got == got[0]).all()
    counts = RNG.integers(1, 1000, (rows, 24))
    got = webp_lanes.huffman_lengths(row, symbol, counts.ravel(), rows, 15).reshape(rows, 24)
    for mine, c in zip(got, counts, strict=True):
        assert (mine * c).sum() == (np.array(webp.code_lengths(dict(enumerate(c.tolist())), 24)) * c).sum()


def test_broken_streams_are_refused():
    file = webp_lanes.store_payloads([_payload(TEXTS[4])])[0]
    for broken in (file[:60], b"RIFX" + file[4:], file[:20] + b"\0" + file[21:]):
        with pytest.raises(webp.WebpError):
            webp_lanes.decode_batch([broken])
        with pytest.raises(webp.WebpError):
            webp_lanes._decode_lanes([broken] * 20)


def _one_by_one(monkeypatch) -> list[int]:
    """How many pixels each call of the single symbol loop adds."""
    inner, added = webp_lanes.entropy_pixels, []

    def counted(words, at, tables, width, total, cache_bits, known=None):
        before = len(known or ())
        found = inner(words, at, tables, width, total, cache_bits, *([known] if known else []))
        added.append(len(found[0]) - before)
        return found

    monkeypatch.setattr(webp_lanes, "entropy_pixels", counted)
    return added


def test_many_images_are_read_in_step(monkeypatch):
    """Most pixels of a large batch don't pass the loop over one image's symbols."""
    added, payloads = _one_by_one(monkeypatch), _many(1500)
    assert [x.tobytes() for x in webp_lanes.read_payloads(webp_lanes.store_payloads(payloads))] == payloads
    assert sum(added) < 0.25 * sum(map(len, payloads)) / 3


@pytest.mark.parametrize("least", [1, 8, 1 << 30])
def test_lanes_in_step_read_as_the_single_decoder(monkeypatch, least):
    """All images in step, some handed over before their end, none in step: alpha, caches of every size, copies near and far, runs of bare codes."""
    monkeypatch.setattr(webp_lanes, "LEAST_IN_STEP", least)
    added, files = _one_by_one(monkeypatch), []
    for k in range(60):
        name = list(IMAGES)[k % len(IMAGES)]
        image = IMAGES[name] if k % 2 else RNG.choice(np.array([3, 0x12345678, 0xFF000001, 1 << 24], np.uint32), (1 + k % 11, 1 + k * 3))
        files.append(webp.encode_image(image, cache_bits=k % 12))
    repeated = np.tile(RNG.integers(0, 2**32, (3, 50), dtype=np.uint32), (40, 1))
    files.append(webp.encode_image(repeated, cache_bits=4))
    found = webp_lanes._decode_lanes(files)
    for file, x in zip(files, found, strict=True):
        image = webp.decode_image(file)
        assert (x == np.stack([(image >> np.uint32(k)) & np.uint32(255) for k in (16, 8, 0)], -1)).all()
    assert (sum(added) == 0) == (least == 1)


def test_copies_do_not_depend_on_the_part_of_the_hash_that_is_sorted(monkeypatch):
    payloads = _many(40)
    whole, mix = webp_lanes.store_payloads(payloads), webp_lanes.mix
    monkeypatch.setattr(webp_lanes, "mix", lambda x: mix(x) & np.uint64((1 << 31) - 1))
    assert webp_lanes.store_payloads(payloads) == whole


def test_codes_of_many_rows_cost_what_single_ones_do():
    many = RNG.integers(1, 90, 300)
    row, symbol = np.repeat(np.arange(300), many), np.concatenate([np.sort(RNG.choice(300, n, replace=False)) for n in many])
    count = np.maximum(1, RNG.pareto(0.7, len(row)).astype(np.int64) % 100_000)
    got = webp_lanes.huffman_lengths(row, symbol, count, 300, 15)
    for r in range(300):
        own = row == r
        want = np.array(webp.code_lengths(dict(zip(symbol[own].tolist(), count[own].tolist(), strict=True)), 300))
        assert (got[own] == want[symbol[own]]).all()
