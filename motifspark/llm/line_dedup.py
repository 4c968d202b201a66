"""Fuzzy line deduplication: MinHash candidates, exact verification, distributed union-find.

1. Every line (A-Z lower-cased, white space at its ends cut) is hashed, and
   equal lines collapse by a hash aggregation.
2. A line's set holds its distinct runs of 5 characters, so one changed letter
   inside a line of 50 characters or more leaves a similarity above 0.8.  One
   permutation hashing gives 64 minima; for a similarity of 0.8, 48 of them
   make 12 bands of 4, and such lines miss each other in all bands with
   probability 0.0018.  Lower similarities have fewer rows a band and more
   bands (see shape()).
3. Lines that share a band are compared by two bits of each minimum: where a
   similarity of 0.8 expects 54 equal ones, fewer than 44 (probability 0.0003)
   are no candidate.  Buckets of any size are compared by this rule.
4. In a bucket, lines that agree, directly or through others, are a group; all
   groups of one least line are a cluster.  Clusters are verified by exact
   Jaccard similarity: many small ones in a task, which tests each line with
   the first and only the others with all, large ones in blocks of bounded
   size.  The lines travel there, not their sets, which are eight times their
   size.
5. Star contraction over the verified links gives components; a component
   keeps its first line, by document and place, and the others are cut out.

Texts are read four times and shuffled once at most; what travels otherwise
are keys.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .block_product import exact_links, holds_each, place_bitmap
from .components import components
from .textops import batches, byte_class, distinct, free_name, lower_bytes, mix, stored, tidy, word_table

WIDTH = 5
SIZE, BANDED = 64, 48  # minima of a line, and those that make bands; two bits of each travel with each band key
MISSED = 0.002  # chance that all bands miss a pair of the least similarity
PAIRWISE = 32  # lines of a bucket that are compared all at once; a larger one line by line
SMALL = 64  # lines of a cluster that shares a task with others
CHUNK = 1024  # lines of a large cluster that are multiplied at once, with as many others
MOST_BROADCAST = 300_000  # documents with cuts: some 40 MB
#: For each try, which bin fills each empty one.
_BORROWED = np.stack([np.random.default_rng(k).permutation(SIZE) for k in range(64)])
_ODD_BITS = np.uint64(0x5555555555555555)
_NOT_BREAK = ~byte_class([0x0A, 0x0D, 0xFF])


def split_lines(text: bytes) -> list[bytes]:
    """A text's lines as they are compared; empty ones stay, to keep the count."""
    return [x.strip(b" \t\x0b\x0c\r") for x in text.split(b"\n")]


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each line, 0 for an empty one."""
    out = np.zeros(len(lines), np.uint64)
    hashes, owner, _, _ = word_table([x.replace(b"\r", b" ") for x in lines], _NOT_BREAK)
    out[owner] = hashes
    return out


def _runs(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of a run of 5 characters, its line's index) for all lines; a shorter line is one run, filled up."""
    data = b"".join(lines)
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    lengths = np.diff(starts[np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)])
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    room = np.maximum(lengths, WIDTH)
    buffer = np.zeros(int(room.sum()) + WIDTH, np.uint64)
    owner = np.repeat(np.arange(len(lines)), lengths)
    begin = np.cumsum(room) - room
    buffer[begin[owner] + np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = points
    total = len(buffer) - WIDTH
    runs = buffer[:total].copy()
    for k in range(1, WIDTH):
        runs *= np.uint64(0x9E3779B97F4A7C15)
        runs += buffer[k : k + total]
    keep = np.ones(total, bool)
    keep[((begin + room)[:, None] - np.arange(1, WIDTH)).ravel()] = False
    return mix(runs[keep]), np.repeat(np.arange(len(lines)), room - WIDTH + 1)


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The distinct runs of each line."""
    runs, owner = _runs(lines)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    fresh = np.concatenate([[True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])]) if len(runs) else np.zeros(0, bool)
    return np.split(runs[fresh], np.searchsorted(owner[fresh], np.arange(1, len(lines))))


def shape(percent: int) -> tuple[int, int, int]:
    """(rows, bands, agree): the most rows a band whose bands miss a pair of this similarity with probability MISSED at most, and how many of all minima must agree.

    Raises ValueError for similarities that even single rows would miss more often.
    """
    s = percent / 100
    same = s + (1 - s) / 4
    below = [sum(comb(SIZE, k) * same**k * (1 - same) ** (SIZE - k) for k in range(least)) for least in range(SIZE)]
    for rows in (4, 3, 2, 1):
        if (1 - s**rows) ** (BANDED // rows) <= MISSED:
            return rows, BANDED // rows, max(k for k in range(SIZE) if below[k] <= 0.0003)
    raise ValueError(f"a similarity of {percent} percent is too low for {BANDED} minima")


def band_keys(lines: list[bytes], rows: int = 4, bands: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """A row of band keys and a sketch, two numbers, for each line: one permutation hashing, empty bins filled from bins that a fixed random order names."""
    hashes, owner = _runs(lines)
    keyed = owner.astype(np.uint64)
    keyed *= np.uint64(SIZE)
    keyed += hashes & np.uint64(SIZE - 1)  # the bin; SIZE is a power of two
    keyed <<= np.uint64(31)
    keyed |= hashes >> np.uint64(33)  # 31 bits
    keyed.sort()
    place = keyed >> np.uint64(31)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    own = np.full(len(lines) * SIZE, -1, np.int64)
    own[place[first].astype(np.int64)] = (keyed[first] & np.uint64((1 << 31) - 1)).astype(np.int64)
    own = own.reshape(len(lines), SIZE)
    minima = own.copy()
    thin = np.flatnonzero((own < 0).any(axis=1))
    for step, source in enumerate(_BORROWED):
        if not len(thin):
            break
        lent = own[thin][:, source]
        minima[thin] = np.where((minima[thin] < 0) & (lent >= 0), lent + ((step + 1) << 32), minima[thin])
        thin = thin[(minima[thin] < 0).any(axis=1)]
    values = mix(minima.astype(np.uint64))
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    sketch = np.bitwise_or.reduce((values.reshape(len(lines), 2, 32) >> np.uint64(62)) << shifts, axis=2)
    values = values[:, : rows * bands].reshape(len(lines), bands, rows)
    keys = np.zeros((len(lines), bands), np.uint64)
    for k in range(rows):
        keys = mix(keys ^ values[:, :, k])
    return keys ^ mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)), sketch


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the minima of two sketches agree; the last axis has the two numbers of a sketch."""
    x = a ^ b
    return SIZE - np.bitwise_count((x | (x >> np.uint64(1))) & _ODD_BITS).sum(axis=-1, dtype=np.int64)


def _each_line(batch: pa.RecordBatch):
    """(row in the batch, line's place, hash, line) arrays for the non-empty lines, part by part."""
    texts = batch.column("text").to_pylist()
    for a, b in batches(texts, 1 << 18):
        split = [split_lines(lower_bytes(x)) if x is not None else [] for x in texts[a:b]]
        lines = [x for own in split for x in own]
        row = np.repeat(np.arange(a, b), [len(x) for x in split])
        place = np.concatenate([np.arange(len(x)) for x in split]) if lines else np.zeros(0, np.int64)
        hashes = line_hashes(lines)
        at = np.flatnonzero(hashes)
        yield row[at], place[at].astype(np.int32), hashes[at].view(np.int64), [lines[k] for k in at]


KEY = "doc_id long, row_id long, row_check int"


def _rows(docs: DataFrame) -> DataFrame:
    """A row's name are two hashes of its id and text, 96 bits."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_names(F.col("doc_id").cast("long")), "text")


def _names(doc_id: Column) -> list[Column]:
    return [F.xxhash64(doc_id, "text").alias("row_id"), F.hash(doc_id, "text").alias("row_check")]


def _lines(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, row_id, row_check, place) for each non-empty line."""

    def work(stream):
        tidy()
        for batch in stream:
            for row, place, hashes, _ in _each_line(batch):
                if len(row):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), *(batch.column(c).take(at) for c in ("doc_id", "row_id", "row_check")), pa.array(place, pa.int32())], names=["hash", "doc_id", "row_id", "row_check", "place"])

    return _rows(docs).mapInArrow(work, f"hash long, {KEY}, place int")


def groups_of(sketch: np.ndarray, agree: int) -> np.ndarray:
    """For each line of a bucket, the first one that it reaches over pairs that agree in enough minima."""
    label, rest = np.arange(len(sketch)), np.arange(len(sketch))
    while len(rest):
        seed, waiting, rest = rest[0], [rest[0]], rest[1:]
        while waiting and len(rest):
            near = agreement(sketch[rest], sketch[waiting.pop()]) >= agree
            label[rest[near]] = seed
            waiting += rest[near].tolist()
            rest = rest[~near]
    return label


def _groups(sketch: np.ndarray, agree: int) -> np.ndarray:
    """The same for buckets of equal size (buckets, lines, 2)."""
    n, g, _ = sketch.shape
    if g > PAIRWISE:
        return np.stack([groups_of(own, agree) for own in sketch])
    near = agreement(sketch[:, :, None], sketch[:, None]) >= agree
    label = np.tile(np.arange(g), (n, 1))
    while True:
        new = np.where(near, label[:, None], g).min(-1)
        if (new == label).all():
            return label
        label = new


def _candidates(docs: DataFrame, shards: int, percent: int) -> DataFrame:
    """Edges (a, b) of line hashes: each line that agrees with others of a bucket, and the least line that it reaches there."""
    rows, bands, agree = shape(percent)

    def deal(stream):
        tidy()
        for batch in stream:
            for _, _, hashes, lines in _each_line(batch):
                node, first = np.unique(hashes, return_index=True)
                if not len(node):
                    continue
                keys, sketch = band_keys([lines[k] for k in first], rows, bands)
                keys, row = keys.ravel(), np.repeat(np.arange(len(node)), bands)
                shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                at, begin = np.unique(shard[order], return_index=True)
                part = lambda x: pa.array([y.tobytes() for y in np.split(x[order], begin[1:])], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), part(keys.astype(np.uint32)), part(node[row]), part(sketch[row])], names=["shard", "keys", "nodes", "sketches"])

    def meet(table: pa.Table) -> pa.Table:
        keys, node, sketch = (np.frombuffer(b"".join(table.column(n).to_pylist()), kind) for n, kind in (("keys", np.uint32), ("nodes", np.int64), ("sketches", np.uint64)))
        ordered = np.sort(keys)
        several = ordered[1:][ordered[1:] == ordered[:-1]]
        at = np.flatnonzero(several[np.minimum(np.searchsorted(several, keys), len(several) - 1)] == keys) if len(several) else np.zeros(0, np.int64)
        at = at[np.lexsort((node[at], keys[at]))]
        keys, node, sketch = keys[at], node[at], sketch.reshape(-1, 2)[at]
        if not len(keys):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])])
        keys, node, sketch = keys[fresh], node[fresh], sketch[fresh]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.append(begin, len(keys)))
        found = [np.zeros((0, 2), np.int64)]
        for g in np.unique(length[length > 1]).tolist():
            starts = begin[length == g]
            for some in np.array_split(starts, 1 + len(starts) * min(g, PAIRWISE) ** 2 // 200_000):
                at = some[:, None] + np.arange(g)
                to = node[np.take_along_axis(at, _groups(sketch[at], agree), axis=1)].ravel()
                pairs = np.stack([node[at].ravel(), to], axis=1)
                found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
        edges = np.concatenate(found)
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    dealt = docs.select("text").mapInArrow(deal, "shard int, keys binary, nodes binary, sketches binary")
    return dealt.groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


def overlaps(runs: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """How many runs the sets of each pair share; runs: all sets' distinct numbers below 2**32, each set from `first` to the next."""
    out = np.zeros(len(pairs), np.int64)
    size = np.diff(first)
    upto = np.cumsum(size[pairs].sum(axis=1))
    for lo, hi in _slices(upto, 1 << 21):
        some = pairs[lo:hi].T.ravel()
        n = size[some]
        at = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.sort(np.repeat(np.tile(np.arange(hi - lo), 2), n).astype(np.uint64) << np.uint64(32) | runs[at])
        out[lo:hi] = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=hi - lo)
    return out


def _slices(upto: np.ndarray, most: int):
    """Ranges of items whose sizes, of which upto are the sums, add up to about `most`; one large item is a range."""
    lo = 0
    while lo < len(upto):
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")), lo + 1)
        yield lo, hi
        lo = hi


def small_links(cluster: np.ndarray, node: np.ndarray, lines: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked nodes (a, b) of many clusters, rows of (cluster, node, line): each line is tested with its cluster's first, those that aren't linked with it with all others."""
    order = np.lexsort((node, cluster))
    cluster, node = cluster[order], node[order]
    known, line = np.unique(node, return_inverse=True)
    own = np.zeros(len(known), np.int64)
    own[line] = order
    runs, owner = _runs([lines[k] for k in own])
    dense = np.unique(runs, return_inverse=True)[1].astype(np.uint64)
    sets = distinct(owner.astype(np.uint64) << np.uint64(32) | dense)
    first = np.searchsorted(sets >> np.uint64(32), np.arange(len(known) + 1, dtype=np.uint64))
    sets &= np.uint64((1 << 32) - 1)
    size = np.diff(first)

    def linked(pairs: np.ndarray) -> np.ndarray:
        n = size[pairs]
        out = 100 * n.min(axis=1, initial=1 << 40) >= percent * n.max(axis=1, initial=0)  # sizes alone tell the others apart
        out[out] = near(pairs[out])
        return out

    def near(pairs: np.ndarray) -> np.ndarray:
        both = overlaps(sets, first, pairs)
        return 100 * both >= percent * (size[pairs].sum(axis=1) - both)

    begin = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
    hub = np.repeat(begin, np.diff(np.append(begin, len(cluster))))
    others = np.flatnonzero(np.arange(len(cluster)) != hub)
    pairs = np.stack([line[hub[others]], line[others]], axis=1)
    close = linked(pairs)
    found, rest = [pairs[close]], others[~close]
    end = np.append(begin[1:], len(cluster))[np.searchsorted(begin, rest, "right") - 1]
    count = end - hub[rest] - 1  # all members but the first
    a = np.repeat(rest, count)
    b = np.repeat(hub[rest] + 1 - (np.cumsum(count) - count), count) + np.arange(len(a))
    pairs = np.unique(np.sort(np.stack([line[a], line[b]], axis=1)[a != b], axis=1), axis=0)
    found.append(pairs[linked(pairs)])
    links = known[np.concatenate(found)]
    return links[:, 0], links[:, 1]


def _verified(clusters: DataFrame, found: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Edges (a, b) that hold together what is linked inside each cluster; clusters: (node, component), found: (node, shingles), the lines."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    sized = stored(clusters.join(sizes, "component"), "clusters")
    small = sized.filter(F.col("size") <= SMALL)
    blocks = small.count() // 512 + 1

    def links(table: pa.Table) -> pa.Table:
        a, b = small_links(table.column("component").to_numpy(), table.column("node").to_numpy(), table.column("shingles").to_pylist(), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    placed = small.select("node", "component", F.pmod(F.xxhash64("component"), F.lit(blocks)).alias("block")).join(found, "node")
    of_small = placed.groupBy("block").applyInArrow(links, "a long, b long")
    return of_small.unionByName(exact_links(sized.filter(F.col("size") > SMALL).select("node", "component"), found, percent, chunk, line_sets))


def duplicate_lines(docs: DataFrame, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, row_id, row_check, place): the lines that repeat another one and are not its component's first.

    Lines are compared with A-Z lower-cased and the white space at their ends
    cut; empty lines are no lines here.  row_id and row_check are hashes of
    doc_id and text, so rows that agree in both count as one row, of which
    dedup_lines keeps one.  Null texts have no lines.
    Components are kept by their first line in the order of doc_id (nulls
    first), row_id, row_check and place.
    """
    return _duplicates(docs, stored(_lines(docs), "lines"), percent, chunk)


def _duplicates(docs: DataFrame, lines: DataFrame, percent: int, chunk: int) -> DataFrame:
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.struct("doc_id", "row_id", "row_check", "place")
    edges = stored(_candidates(docs, shards, percent), "candidates")
    clusters = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    classes = lines.groupBy("hash").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    owners = clusters.select(F.col("node").alias("hash")).distinct().join(classes.select("hash", F.col("first.row_id").alias("row_id")), "hash")
    wanted = spark.sparkContext.broadcast(place_bitmap(owners, "hash", "row_id"))

    def verified(stream):
        tidy()
        for batch in stream:
            ids = batch.column("row_id").to_numpy()
            for row, _, hashes, texts in _each_line(batch):
                at = np.flatnonzero(holds_each(wanted.value, hashes, ids[row]))
                if len(at):
                    yield pa.RecordBatch.from_pydict({"node": pa.array(hashes[at], pa.int64()), "shingles": pa.array([texts[k] for k in at], pa.binary())})

    found = _rows(docs).mapInArrow(verified, "node long, shingles binary").dropDuplicates(["node"])
    links = stored(_verified(clusters, stored(found, "candidate-lines"), percent, chunk), "links")
    wanted.destroy()
    joined = classes.join(components(links).withColumnRenamed("node", "hash"), "hash", "left")
    repeated = joined.filter("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "hash"))
    kept = repeated.groupBy("component").agg(F.min("first").alias("kept"))
    named = stored(repeated.select("hash", "component").join(kept, "component").select("hash", "kept"), "kept-lines")
    return lines.join(named, "hash").filter(~first.eqNullSafe(F.col("kept"))).select("doc_id", "row_id", "row_check", "place")


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one line kept of each component of near-equal lines; all columns stay.

    A text's other lines keep their order.  A document of which every line
    goes is removed, as are all but one (any one) of rows that agree in doc_id
    and text; null texts and texts without lines stay as they are, each row
    of them, as does a text that loses nothing.  See duplicate_lines().
    """
    lines = stored(_lines(docs), "lines")
    cut = stored(_duplicates(docs, lines, percent, CHUNK).groupBy("row_id", "row_check").agg(F.collect_set("place").alias("places_cut")), "cuts")
    names = docs.columns
    row_id, check, places, again = (free_name(n, names) for n in ("row_id", "row_check", "places_cut", "repeats"))
    key = [row_id, check]
    keyed = docs.withColumns(dict(zip(key, _names(F.col("doc_id").cast("long")), strict=True)))
    with_lines = F.col("text").rlike(r"[^ \t\x0B\x0C\r\n]")
    # a row's line comes up once at each place, but for repeated rows
    repeats = stored(lines.groupBy("row_id", "row_check", "place").count().filter("count > 1").select("row_id", "row_check").distinct().toDF(*key), "repeats")
    few = cut.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    cut = cut.toDF(*key, places)
    if repeats.isEmpty():
        single = keyed
    else:
        # rows that agree in id and text: of each kind one is taken, by a partial aggregation before they are shuffled
        several = keyed.join(repeats.withColumn(again, F.lit(True)), key, "left")
        one = several.filter(F.col(again) & with_lines).groupBy(*key).agg(F.first(F.struct(*names)).alias(places)).select(f"{places}.*", *key)
        single = several.filter(F.col(again).isNull() | ~F.coalesce(with_lines, F.lit(False))).select(*names, *key).unionByName(one)
    joined = single.join(F.broadcast(cut) if few else cut, key, "left").select(*names, places)
    at, schema = names.index("text"), docs.schema

    def work(stream):
        tidy()
        for batch in stream:
            texts, cuts = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            keep = np.ones(len(texts), bool)
            for k, places in enumerate(cuts):
                if places:
                    gone = set(places)
                    left = [x for i, x in enumerate(texts[k].split("\n")) if i not in gone]
                    keep[k] = any(x.strip() for x in left)
                    texts[k] = "\n".join(left)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(work, schema)


