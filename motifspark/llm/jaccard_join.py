"""N-gram Jaccard join: documents that share most of their word shingles.

The document by shingle incidence is a sparse 0/1 matrix M; the wanted links
are the large entries of M x M'.  The product is taken in blocks:

1. Equal shingle sets collapse to one row of M (a hash aggregation), so a
   group of copies costs one row.
2. Rows are put in one global shingle order: shingles that many rows share go
   last, in a bitmap of fixed size, the rest follow their hash.  Of a row with
   n shingles only the first n - ceil(t n) + 1 can hold the first shingle that
   it has in common with a linked row.
3. These short prefixes are dealt out by shingle.  Rows that meet there are
   discarded unless the overlap still possible after the meeting place
   reaches ceil(t (n + m) / (1 + t)), and the sizes' ratio reaches t.  For the
   remaining pairs the overlap inside both prefixes is counted, and the bound
   that it leaves is tested again.
4. What is left falls into small candidate clusters.  A cluster's full rows
   are multiplied in blocks of a bounded number of rows, overlap counts
   accumulate over slices of columns, and each block returns a spanning
   forest of its exact links.  Clusters above a block's size are cut into
   chunks and every pair of chunks is multiplied, so no link is lost.
5. Components come from star contraction over the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_product import exact_links, forest, holds, place_bitmap
from .components import components
from .textops import batches, distinct_counts, lower_bytes, mix, shingle_sets, stored

#: Shingles whose hash lies in the first quarter are counted to find the shared ones.
REGION = np.uint64(1 << 62)
FLAG_BITS = 26
MOST_FLAGS = 4 << 20
#: A group in which a row may link with more rows than this on average is held together by a forest instead of by tested pairs.
MOST_TESTED = 32
#: Beyond this many rows such a forest joins all rows of the group to one.
TESTED = 2048


def signature(shingles: np.ndarray) -> int:
    """One number for a set of shingles."""
    total = mix(np.add.reduce(mix(shingles), keepdims=True) ^ np.uint64(len(shingles)))
    return int(total.view(np.int64)[0])


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column("text").to_pylist()
    for a, b in batches(texts, 1 << 19):
        yield from enumerate(shingle_sets([lower_bytes(x) for x in texts[a:b]], width), a)


def _deal(owner: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that gathers each shard's entries, and where each shard begins."""
    shard = (owner % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _shared_shingles(docs: DataFrame, width: int, shards: int) -> np.ndarray:
    """A bitmap of fixed size over shingle hashes: set where many documents share one.

    The threshold starts at two documents and doubles until what is set fits,
    so the bitmap has the same size for any corpus.  It only orders shingles;
    no result depends on what is set.
    """

    def gather(stream):
        for batch in stream:
            found = [s[s < REGION] for _, s in _sets(batch, width)]
            if found and len(hashes := np.concatenate(found)):
                order, begin = _deal(hashes >> np.uint64(20), shards)
                hashes = hashes[order]
                keep = [k for k in range(shards) if begin[k] < begin[k + 1]]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(keep, pa.int32()), "hashes": pa.array([hashes[begin[k] : begin[k + 1]].tobytes() for k in keep], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        hashes, times = distinct_counts(np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64))
        level = np.minimum(np.log2(times).astype(np.int32), 40)
        rows = [(int(k), (hashes[level == k] & np.uint64((1 << FLAG_BITS) - 1)).astype(np.uint32)) for k in np.unique(level) if k > 0]
        return pa.table({"level": pa.array([k for k, _ in rows], pa.int32()), "n": pa.array([len(x) for _, x in rows], pa.int64()), "places": pa.array([x.tobytes() for _, x in rows], pa.binary())})

    dealt = docs.select("text").mapInArrow(gather, "shard int, hashes binary")
    found = stored(dealt.groupBy("shard").applyInArrow(count, "level int, n long, places binary"), "shared-shingles")
    sizes = dict(found.groupBy("level").agg(F.sum("n")).collect())
    level = 1
    while sum(n for k, n in sizes.items() if k >= level) > MOST_FLAGS:
        level += 1
    bitmap = np.zeros(1 << (FLAG_BITS - 3), np.uint8)
    for row in found.filter(F.col("level") >= level).select("places").toLocalIterator():
        places = np.frombuffer(row[0], np.uint32)
        np.bitwise_or.at(bitmap, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))
    return bitmap


def prefix_length(n: int, percent: int) -> int:
    """How many of n shingles can hold the first one shared with a linked row."""
    return n + (-percent * n // 100) + 1


def _prefixes(docs: DataFrame, width: int, percent: int, bitmap) -> DataFrame:
    """A row for each document: its set's size and signature, and the prefix in the global order."""

    def work(stream):
        shared = bitmap.value
        for batch in stream:
            ids, sizes, signs, heads = batch.column("doc_id"), [], [], []
            for _, s in _sets(batch, width):
                sizes.append(len(s))
                if not len(s):
                    signs.append(None)
                    heads.append(None)
                    continue
                place = (s & np.uint64((1 << FLAG_BITS) - 1)).astype(np.uint32)
                flag = (shared[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                signs.append(signature(s))
                heads.append(np.concatenate([s[flag == 0], s[flag == 1]])[: prefix_length(len(s), percent)].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": ids.cast(pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "sign": pa.array(signs, pa.int64()), "head": pa.array(heads, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_shingles long, sign long, head binary")


def _may_link(n: np.ndarray, m: np.ndarray, at_n: np.ndarray, at_m: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of n and m shingles that first meet at these places can reach the similarity."""
    needed = -(-percent * (n + m) // (100 + percent))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (1 + np.minimum(n - at_n, m - at_m) - 1 >= needed)


def _meet_in_large(size: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a large group that may link, or, if there are very many, a forest that holds them together (True)."""
    g, found, n_found = len(size), [], 0
    for first in range(0, g, 512):
        rows = np.arange(first, min(first + 512, g))
        i, j = np.nonzero(_may_link(size[rows, None], size[None], place[rows, None], place[None], percent) & (rows[:, None] < np.arange(g)))
        found.append((rows[i], j))
        n_found += len(i)
        if n_found > MOST_TESTED * g:
            break
    else:
        return *(np.concatenate([x[k] for x in found]) for k in (0, 1)), False
    if g > TESTED:
        return np.zeros(g, np.int64), np.arange(g), True
    return np.arange(g), forest(_may_link(size[:, None], size[None], place[:, None], place[None], percent)), True


def _candidates(classes: DataFrame, percent: int, shards: int) -> DataFrame:
    """Pairs (a, b) of signatures that meet in their prefixes and pass the bound of the meeting place.

    joins: the pair stands for a whole group of rows that meet, so it must
    hold the group together and isn't tested by itself.
    """

    def deal(stream):
        for batch in stream:
            heads = [np.frombuffer(x, np.uint64) for x in batch.column("head").to_pylist()]
            if not heads:
                continue
            lengths = np.array([len(x) for x in heads])
            hashes = np.concatenate(heads)
            sign = np.repeat(batch.column("sign").to_numpy(), lengths)
            size = np.repeat(batch.column("n_shingles").to_numpy(), lengths).astype(np.int32)
            place = (np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            order, begin = _deal(hashes >> np.uint64(20), shards)
            columns = [x[order] for x in (hashes, sign, size, place)]
            keep = [k for k in range(shards) if begin[k] < begin[k + 1]]
            yield pa.RecordBatch.from_pydict({"shard": pa.array(keep, pa.int32())} | {name: pa.array([x[begin[k] : begin[k + 1]].tobytes() for k in keep], pa.binary()) for name, x in zip(("hashes", "signs", "sizes", "places"), columns)})

    def meet(table: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        hashes, sign, size, place = whole("hashes", np.uint64), whole("signs", np.int64), whole("sizes", np.int32).astype(np.int64), whole("places", np.int32).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, sign, size, place = hashes[order], sign[order], size[order], place[order]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        length = np.diff(np.append(begin, len(hashes)))
        pairs = []
        for g in np.unique(length[length > 1]):
            starts = begin[length == g]
            if g <= 64:
                i, j = np.triu_indices(g, 1)
                for block in np.array_split(starts, 1 + len(starts) * len(i) // 500_000):
                    a, b = (block[:, None] + i).ravel(), (block[:, None] + j).ravel()
                    ok = _may_link(size[a], size[b], place[a], place[b], percent)
                    pairs.append((sign[a[ok]], sign[b[ok]], np.zeros(ok.sum(), bool)))
                continue
            for start in starts:
                a, b, joins = _meet_in_large(size[start : start + g], place[start : start + g], percent)
                pairs.append((sign[start + a], sign[start + b], np.full(len(a), joins)))
        a, b, joins = (np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in range(3))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), joins], 1)[a != b], axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64()), "joins": pa.array(both[:, 2] > 0)})

    dealt = classes.select("sign", "n_shingles", "head").mapInArrow(deal, "shard int, hashes binary, signs binary, sizes binary, places binary")
    return dealt.groupBy("shard").applyInArrow(meet, "a long, b long, joins boolean").groupBy("a", "b").agg(F.max("joins").alias("joins"))


def _bounded(candidates: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) whose overlap can reach the similarity, given how much their prefixes share.

    One prefix ends no later in the global order than the other, so all that
    the rows share beyond the counted part lies in that row's rest.
    """

    def work(stream):
        for batch in stream:
            n, m = (batch.column(k).to_numpy() for k in ("n_a", "n_b"))
            heads = [[np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in ("head_a", "head_b")]
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*heads, strict=True)], np.int64)
            rest = np.maximum(n - [len(x) for x in heads[0]], m - [len(x) for x in heads[1]])
            keep = shared + rest >= -(-percent * (n + m) // (100 + percent))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(keep)), "b": batch.column("b").filter(pa.array(keep))})

    own = classes.select("sign", "n_shingles", "head")
    tested = candidates.filter("NOT joins").join(own.toDF("a", "n_a", "head_a"), "a").join(own.toDF("b", "n_b", "head_b"), "b")
    return tested.select("a", "b", "n_a", "n_b", "head_a", "head_b").mapInArrow(work, "a long, b long").unionByName(candidates.filter("joins").select("a", "b"))


def _exact_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, width: int, percent: int, chunk: int) -> DataFrame:
    """Edges (a, b) that span the exact links inside each candidate cluster."""
    clusters = stored(components(candidates).join(classes.select(F.col("sign").alias("node"), "smallest"), "node"), "clusters")
    wanted = docs.sparkSession.sparkContext.broadcast(place_bitmap(clusters, "node", "smallest"))

    def work(stream):
        for batch in stream:
            ids = batch.column("doc_id").to_pylist()
            kept = [(node, s.tobytes()) for k, s in _sets(batch, width) if len(s) and holds(wanted.value, node := signature(s), ids[k])]
            yield pa.RecordBatch.from_pydict({"node": pa.array([x[0] for x in kept], pa.int64()), "shingles": pa.array([x[1] for x in kept], pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = texts.mapInArrow(work, "node long, shingles binary").dropDuplicates(["node"])
    links = stored(exact_links(clusters, sets, percent, chunk), "links")
    wanted.destroy()
    return links


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, chunk: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that each document reaches by links.

    Words are maximal runs without ASCII white space after A-Z is lower-cased;
    a document's set holds its distinct runs of `width` words, or the whole
    sequence if it has fewer.  Two documents are linked when
    100 * intersection >= percent * union.  A null or wordless text has size 0
    and links with nothing; equal texts link; a null doc_id is the component
    only of documents that reach no other id.  One row per input row;
    other columns are ignored.  No rows in, no rows out.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bitmap = spark.sparkContext.broadcast(_shared_shingles(docs, width, shards))
    rows = stored(_prefixes(docs, width, percent, bitmap), "prefixes")
    bitmap.destroy()
    classes = stored(rows.filter("sign IS NOT NULL").groupBy("sign").agg(F.min("doc_id").alias("smallest"), F.min("n_shingles").alias("n_shingles"), F.min("head").alias("head")), "classes")
    candidates = stored(_candidates(classes, percent, shards), "candidates")
    bounded = stored(_bounded(candidates, classes, percent), "bounded")
    links = _exact_links(docs, classes, bounded, width, percent, chunk)
    linked = components(links).join(classes.select(F.col("sign").alias("node"), "smallest"), "node")
    least = linked.groupBy("component").agg(F.min("smallest").alias("least"))
    named = linked.join(least, "component").select(F.col("node").alias("sign"), "least")
    ids = classes.select("sign", "smallest").join(named, "sign", "left").select("sign", F.coalesce("least", "smallest").alias("class_id"))
    return rows.select("doc_id", "n_shingles", "sign").join(ids, "sign", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))
