"""Phrases of two or three words that occur more often than their parts suggest, by language.

Candidates come level by level: words, then pairs of frequent words, then
triples of which both pairs are frequent.  A table of bits, of bounded size at
any number of candidates, tells the next level what may be frequent: it errs
only by letting more through, so every occurrence of what is frequent is
counted and a level's sums are exact.  The texts are read once for each level.

A word is known by its text and language at the first level and by a key of
64 bits made of both at the next ones, where an n-gram is the keys of its
words.  So counts of parts come from joins of the levels, and the texts of
words are joined to the few phrases that may rank.  Of 10**7 different
frequent words, two share a key with a chance of some 3 * 10**-6.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textops import SEPARATOR, _powers, batches, byte_class, lower_bytes, mix, stored

MOST_SLOTS = 600_000  # n-grams that a task gathers before it hands their counts on
MOST_BITS = 1 << 27  # of the table of what may be frequent: 16 MB
SHARDS = 16  # parts of a language that are ranked side by side
LONGEST = 3
_BREAKS = byte_class([*b".,;:!?", *range(0x0A, 0x0E), SEPARATOR])
_IN_WORD = ~(_BREAKS | byte_class(b" \t"))
_CODES = np.random.default_rng(71).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = mix(np.arange(101, 101 + LONGEST, dtype=np.uint64))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits, each for the keys that were alone at their place; a slot is the rank of a key's bit."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = len(keys)
        before = 0
        while len(keys):
            if len(self.levels) == 64:
                raise ValueError("keys are not distinct")
            size = 2 * len(keys) + 64
            at = self._places(keys, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(np.append(alone, np.zeros(-size % 64, bool)), bitorder="little").view(np.uint64)
            ranks = before + np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
            self.levels.append((size, words, ranks))
            before, keys = int(ranks[-1]), keys[~alone[at]]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any or none (-1) for keys that are not members."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = self._places(keys[rest], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[rest[hit]] = ranks[at[hit] >> 6] + below
            rest = rest[~hit]
        return out


class Index:
    """Slots of candidates; the stored keys, compared at each look-up, turn others away."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray, homes: np.ndarray):
        self.hash = PerfectHash(self._joined(keys, checks))
        at = self.hash.slots(self._joined(keys, checks))
        self.keys, self.checks, self.homes = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint8)
        self.keys[at], self.checks[at], self.homes[at] = keys, checks, homes

    @staticmethod
    def _joined(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        return mix(keys ^ mix(checks.astype(np.uint64) + np.uint64(1)))

    def slots(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The slot of each n-gram, -1 for those that are no candidates."""
        at = self.hash.slots(self._joined(keys, checks))
        own = at >= 0
        own[own] = (self.keys[at[own]] == keys[own]) & (self.checks[at[own]] == checks[own])
        return np.where(own, at, -1)


def rolled(words: Sequence[np.ndarray]) -> np.ndarray:
    """A key for each n-gram, from those of its first, second, ... words."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for place, own in zip(_PLACES, words, strict=False):
        out += mix(own ^ place)
    return mix(out)


class Grams:
    """The n-grams of some texts, by length, as keys by their first words. Words' keys carry their language."""

    def __init__(self, texts: Sequence[bytes], langs: Sequence[str]):
        self.raw = b"\xff".join(texts) + b"\xff"
        buffer = np.frombuffer(self.raw, np.uint8)
        edge = np.flatnonzero(np.diff(_IN_WORD[buffer], prepend=False, append=False))
        self.start, self.end = edge[0::2], edge[1::2]
        broken = np.cumsum(_BREAKS[buffer], dtype=np.int64)[self.start]
        follows = broken[1:] == broken[:-1]
        self.owner = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), self.start, "right")
        names = {x: np.uint64(int.from_bytes(sha256(x.encode()).digest()[:8], "little")) for x in set(langs)}
        lang = mix(np.array([names[x] for x in langs], np.uint64))[self.owner] if len(self.start) else np.zeros(0, np.uint64)
        up, down = _powers(len(buffer) + 1)
        codes = _CODES[buffer]
        total = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=total[1:])
        self.words = mix(mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64)) ^ lang)
        self.whole = [np.ones(len(self.start), bool), follows, follows[:-1] & follows[1:]]

    def of(self, n: int) -> np.ndarray:
        """Keys of the n-grams by their first word, also of those that cross a break."""
        count = max(len(self.words) - n + 1, 0)
        return self.words if n == 1 else rolled([self.words[k : k + count] for k in range(n)])

    def texts(self, at: np.ndarray) -> np.ndarray:
        """The words at these places, as bytes."""
        out = np.empty(len(at), object)
        out[:] = [self.raw[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]
        return out


def _parts(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about so many bytes, cut where pieces end, which no phrase crosses."""
    at = 0
    while len(text) - at > most:
        ends = np.flatnonzero(_BREAKS[np.frombuffer(text, np.uint8, most, at)])
        if not len(ends):
            later = np.flatnonzero(_BREAKS[np.frombuffer(text, np.uint8, offset=at)])
            if not len(later):
                break
            ends = later[:1]
        yield text[at : at + ends[-1] + 1]
        at += int(ends[-1]) + 1
    yield text[at:]


def grams_of(batch: pa.RecordBatch) -> Iterator[tuple[Grams, list[str]]]:
    """The n-grams of a batch's texts, some 1 MB at a time, with the language of each text."""
    texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
    for begin, end in batches(texts, 1 << 20):
        cut = [(part, lang) for text, lang in zip(texts[begin:end], langs[begin:end], strict=True) for part in _parts(lower_bytes(text))]
        parts, held, size = [], [], 0
        for part, lang in cut:
            parts.append(part)
            held.append(lang)
            size += len(part)
            if size > 1 << 20:
                yield Grams(parts, held), held
                parts, held, size = [], [], 0
        if parts:
            yield Grams(parts, held), held


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and how often it occurs (n: how often at each place)."""
    order = np.argsort(keys)
    found = keys[order]
    at = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(keys) else np.zeros(0, np.int64)
    return order[at], np.diff(np.append(at, len(keys))) if n is None else np.add.reduceat(n[order], at) if len(at) else n


def _bits(frequent: DataFrame, size: int) -> np.ndarray:
    """A table of bits at the leading bits of the keys of what is frequent; Spark builds it, 4 KB a row."""
    shift = 64 - (size.bit_length() - 1)
    at = F.shiftrightunsigned("key", shift) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(max(size // 8, 4096), np.uint8)
    for bucket, bits in rows.toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _may_be(table: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _count_words(docs: DataFrame, most: int) -> DataFrame:
    """(w1, lang, word, f): how often each word occurs in a language; a null word has the sum of all."""

    def work(stream):
        pile, size = [], 0

        def rows():
            keys, count, langs, texts = (np.concatenate(x) for x in zip(*pile, strict=True))
            at, n = _summed(keys, count)
            return pa.RecordBatch.from_pydict({"w1": pa.array(keys[at].view(np.int64)), "lang": pa.array(langs[at], pa.string()), "word": pa.array(texts[at], pa.string()), "f": pa.array(n)})

        for batch in stream:
            total = {}
            for grams, langs in grams_of(batch):
                for lang, n in zip(langs, np.bincount(grams.owner, minlength=len(langs)).tolist(), strict=True):
                    total[lang] = total.get(lang, 0) + n
                at, n = _summed(grams.words)
                if len(at):
                    pile.append((grams.words[at], n, np.array(langs, object)[grams.owner[at]], grams.texts(at)))
                    size += len(at)
                if size > most // 4:
                    yield rows()
                    pile, size = [], 0
            yield pa.RecordBatch.from_pydict({"w1": pa.array([0] * len(total), pa.int64()), "lang": pa.array(list(total), pa.string()), "word": pa.nulls(len(total), pa.string()), "f": pa.array(list(total.values()), pa.int64())})
        if pile:
            yield rows()

    return docs.mapInArrow(work, "w1 long, lang string, word string, f long").groupBy("w1", "lang", "word").agg(F.sum("f").alias("f"))


def _count(docs: DataFrame, n: int, held, most: int) -> DataFrame:
    """(w1, .., wn, f): how often each n-gram occurs, for those whose parts of n - 1 words may be frequent."""
    names = [f"w{k + 1}" for k in range(n)]

    def work(stream):
        pile, size = [], 0

        def rows():
            keys, *words = (np.concatenate(x) for x in zip(*pile, strict=True))
            at, count = _summed(keys)
            return pa.RecordBatch.from_arrays([*(pa.array(w[at].view(np.int64)) for w in words), pa.array(count)], names=[*names, "f"])

        table, bits = held.value
        for batch in stream:
            for grams, _ in grams_of(batch):
                parts = _may_be(table, bits, grams.of(n - 1))
                at = np.flatnonzero(grams.whole[n - 1] & parts[:-1] & parts[1:])
                if len(at):
                    words = [grams.words[at + k] for k in range(n)]
                    pile.append((rolled(words), *words))
                    size += len(at)
                if size > most:
                    yield rows()
                    pile, size = [], 0
        if pile:
            yield rows()

    return docs.mapInArrow(work, ", ".join(f"{x} long" for x in [*names, "f"])).groupBy(*names).agg(F.sum("f").alias("f"))


def _keyed(grams: DataFrame, n: int) -> DataFrame:
    """(key) of n-grams, as Grams.of() gives it."""

    def work(stream):
        for batch in stream:
            words = [batch.column(k).to_numpy().view(np.uint64) for k in range(n)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(rolled(words).view(np.int64))})

    return grams.select(*(f"w{k + 1}" for k in range(n))).mapInArrow(work, "key long")


def _levels(docs: DataFrame, least: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words; and the words, pairs and triples that occur `least` times or more in their language, with how often: (w1, lang, word, f), (w1, w2, f), (w1, w2, w3, f)."""
    words = stored(_count_words(docs, most).filter(F.col("word").isNull() | (F.col("f") >= least)), "frequent-1")
    found = [words.filter("word IS NOT NULL")]
    for n in range(2, LONGEST + 1):
        size = 1 << min(max(64 * found[-1].count(), 1 << 16).bit_length(), MOST_BITS.bit_length() - 1)
        keys = found[-1].select(F.col("w1").alias("key")) if n == 2 else _keyed(found[-1], n - 1)
        held = docs.sparkSession.sparkContext.broadcast((_bits(keys, size), size))
        found.append(stored(_count(docs, n, held, most).filter(F.col("f") >= least), f"frequent-{n}"))
    return words.filter("word IS NULL").select("lang", F.col("f").alias("n")), found


def candidates(docs: DataFrame, least: int, most: int = MOST_SLOTS) -> DataFrame:
    """(n, w1, w2, w3, f) of the words, pairs and triples that occur `least` times or more in their language, and how often they do."""
    none = lambda name: F.lit(None).cast("long").alias(name)
    _, found = _levels(docs, least, most)
    rows = [x.select(F.lit(n).alias("n"), *(F.col(f"w{k}") if k <= n else none(f"w{k}") for k in range(1, LONGEST + 1)), "f") for n, x in enumerate(found, 1)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def cut_scores(f: Sequence[int], million: int = 1_000_000) -> tuple[int, int, int, int]:
    """(a, l, r, score) of a phrase by its lowest-scoring cut, ties to the first; f: counts of w1, w2, w3, w1w2, w2w3, w1w2w3, with 0 for what a pair lacks."""
    if not f[5]:
        a, cuts = f[3], [(f[0], f[1])]
    else:
        a, cuts = f[5], [(f[0], f[4]), (f[3], f[2])]
    score, k = min((million * a * a // (left * right), k) for k, (left, right) in enumerate(cuts))
    return a, *cuts[k], score


def _scored(phrases: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score) from (lang, w1, w2, w3, f), f as in cut_scores()."""

    def work(stream):
        for batch in stream:
            found = np.array([cut_scores(f) for f in batch.column("f").to_pylist()], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("lang", "w1", "w2", "w3")), *(pa.array(x) for x in found.T.copy())], names=["lang", "w1", "w2", "w3", "a", "l", "r", "score"])

    return phrases.select("lang", "w1", "w2", "w3", "f").mapInArrow(work, "lang string, w1 long, w2 long, w3 long, a long, l long, r long, score long")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covers: int = 50, most_slots: int = MOST_SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, a and phrase.

    Pairs inside a triple that has `covers` percent of their occurrences or
    more are dropped.  Null texts are empty, null languages are `und`;
    repeated rows count each by itself; other columns are ignored; an empty
    table gives no rows.  Long texts are cut where pieces end, so a task holds
    a few megabytes of text at a time, and counts of some `most_slots`
    n-grams.  The texts are read three times, however many candidates they have.
    """
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    totals, (words, pairs, triples) = _levels(docs, least, most_slots)
    of = lambda frame, f, *names: frame.select(*(F.col(f"w{k + 1}").alias(x) for k, x in enumerate(names)), F.col("f").alias(f))
    spoken = words.select("w1", "lang", F.col("f").alias("f1"))
    two = of(pairs, "a", "w1", "w2").join(spoken, "w1").join(of(words, "f2", "w2"), "w2")
    three = of(triples, "a", "w1", "w2", "w3").join(of(pairs, "f12", "w1", "w2"), ["w1", "w2"]).join(of(pairs, "f23", "w2", "w3"), ["w2", "w3"]).join(spoken, "w1").join(of(words, "f3", "w3"), "w3")
    three = stored(three, "triples")
    covered = lambda f: 100 * F.col("a") >= covers * F.col(f)
    redundant = three.filter(covered("f12")).select("w1", "w2").union(three.filter(covered("f23")).select("w2", "w3")).distinct()
    none = F.lit(0).cast("long")
    kept = two.join(redundant, ["w1", "w2"], "left_anti").select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), F.array("f1", "f2", none, "a", none, none).alias("f"))
    scored = _scored(kept.unionByName(three.select("lang", "w1", "w2", "w3", F.array("f1", none, "f3", "f12", "f23", "a").alias("f"))))
    # what ties with the last that may rank is kept until the phrases' texts are there
    best = (F.desc("score"), F.desc("a"))
    ahead = lambda frame, rank, *order: frame.withColumn("rank", rank.over(Window.partitionBy("lang", "shard").orderBy(*order))).filter(F.col("rank") <= top)
    first = ahead(scored.withColumn("shard", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SHARDS))), F.rank(), *best)
    for k in (1, 2, 3):
        first = first.join(words.select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    named = first.withColumn("phrase", F.concat_ws(" ", "word1", "word2", "word3"))
    ranked = ahead(named, F.row_number(), *best, F.asc("phrase"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, F.asc("phrase"))).cast("long")).filter(F.col("rank") <= top)
    few = F.broadcast(totals)  # a row for each language
    return ranked.join(few, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
