"""Exact Jaccard links inside candidate clusters, by blocked products of incidence matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import mix

#: Bits of the bitmap that tells which sets a pass over the texts must return.
PLACE_BITS = 26


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric link matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def block_links(signs: np.ndarray, sets: list[np.ndarray], percent: int, columns: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the exact links in one block.

    Rows that are linked to one row, the first or another, need no further
    test among themselves; what is left is multiplied with all rows: the
    product of its incidence with the transpose of the block's.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    shingles, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(count), sizes)
    keep = shared[where]
    row, where = owner[keep], column[where[keep]]
    total = int(shared.sum())
    linked = lambda both, i: 100 * both >= percent * (sizes + sizes[i] - both)
    star, hub = np.zeros(count, bool), 0
    for rep in dict.fromkeys((0, count // 2, count - 1)) if count > 32 else ():
        member = np.zeros(total, bool)
        member[where[row == rep]] = True
        own = linked(np.bincount(row[member[where]], minlength=count), rep)
        own[rep] = True
        if own.sum() > star.sum():
            star, hub = own, rep
    label = np.arange(count)
    label[star] = hub
    rest = np.flatnonzero(~star)
    if not len(rest):
        return signs, signs[label]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    columns = min(columns, max(512, (1 << 23) // count))
    overlap = np.zeros((len(rest), count), np.float32)
    for first in range(0, total, columns):
        a, b = np.searchsorted(where, [first, first + columns])
        part = np.zeros((count, min(columns, total - first)), np.float32)
        part[row[a:b], where[a:b] - first] = 1
        overlap += part[rest] @ part.T
    both = overlap.astype(np.int64)
    links = np.zeros((count, count), bool)
    links[rest] = 100 * both >= percent * (sizes[rest][:, None] + sizes[None, :] - both)
    links[hub, star] = True
    return signs, signs[forest(links | links.T)]


def _places(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(first.view(np.uint64) ^ mix(second.view(np.uint64))) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def place_bitmap(rows: DataFrame, first: str, second: str) -> np.ndarray:
    """A bitmap of fixed size (8 MB) of the rows' pairs of numbers, put together by executors; a null second counts as 0.

    It may hold more pairs than given, never fewer.
    """

    def work(stream):
        for batch in stream:
            a, b = (np.array([x or 0 for x in batch.column(k).to_pylist()], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"place": pa.array(_places(a, b), pa.int64())})

    words = rows.select(F.col(first).cast("long"), F.col(second).cast("long")).mapInArrow(work, "place long")
    merged = words.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (PLACE_BITS - 6), np.int64)
    for part in merged.toLocalIterator():
        out[part[0]] = part[1]
    return out


def holds_each(bitmap: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A flag for each pair of int64 numbers: whether the bitmap may hold it."""
    place = _places(np.ascontiguousarray(first), np.ascontiguousarray(second))
    return ((bitmap[place >> 6] >> (place & 63)) & 1).astype(bool)


def holds(bitmap: np.ndarray, first: int, second: int | None) -> bool:
    return bool(holds_each(bitmap, np.array([first], np.int64), np.array([second or 0], np.int64))[0])


def packed_sets(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in packed]


def exact_links(clusters: DataFrame, sets: DataFrame, percent: int, chunk: int, unpack: Callable[[list[bytes]], list[np.ndarray]] = packed_sets, together: int = 0) -> DataFrame:
    """Edges (a, b) that span the links with 100 * intersection >= percent * union inside each cluster.

    clusters: (node, component), a node in any number of them; sets: (node,
    shingles), what `unpack` makes sets of distinct uint64 of; by default,
    these packed.
    A cluster of more than `chunk` sets is cut into chunks, and each pair of
    chunks is one block, so a task holds two chunks at most.  Where `together`
    is given, smaller clusters share blocks of about so many sets; what such
    a block links across clusters is a link as well.
    """
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    placed = clusters.select("node", "component").join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = F.col("component")
    if together:
        shared = F.pmod(F.xxhash64("component"), F.lit(clusters.count() // together + 1))
        block = F.when(F.col("chunks") == 1, shared).otherwise(block)
    blocks = placed.select("node", block.alias("component"), F.when(F.col("chunks") == 1, -1).otherwise(F.least("own", "other")).alias("low"), F.greatest("own", "other").alias("high"))

    def multiply(table: pa.Table) -> pa.Table:
        a, b = block_links(table.column("node").to_numpy(), unpack(table.column("shingles").to_pylist()), percent)
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    return blocks.join(sets, "node").groupBy("component", "low", "high").applyInArrow(multiply, "a long, b long")
