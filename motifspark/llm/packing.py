"""Best-fit packing of token pieces by linear grouping.

A packing depends on lengths alone, and there are only as many lengths as a
sequence has tokens.  So pieces are counted by length on Spark, the packing is
planned over these counts (its size doesn't grow with the corpus), and every
piece finds its place from its length and its rank within that length.

The plan: lengths above a bound are cut into groups of equal numbers of
pieces and rounded up to their group's longest; over these few sizes, fillings
of a sequence are chosen one after another, each the fullest that is left, and
used as often as the groups allow; real pieces then take the places, longest
first; small pieces go into the fullest sequence that still has room.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import stored
from .tokenizing import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


@dataclass(frozen=True)
class Span:
    """Pieces of one length: ranks first..first+count-1 go to sequences from `sequence` on, `each` to a sequence."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size make the fullest sequence: a knapsack over what is left, larger sizes first among equals."""
    best: list[tuple[int, ...] | None] = [None] * (capacity + 1)
    best[0] = (0,) * len(sizes)
    reach = 0
    for k, size in enumerate(sizes):
        most = min(left[k], capacity // size)
        if not most:
            continue
        for filled in range(min(reach, capacity), -1, -1):
            base = best[filled]
            if base is None or base[k]:
                continue
            for n in range(1, min(most, (capacity - filled) // size) + 1):
                if best[filled + n * size] is None:
                    best[filled + n * size] = (*base[:k], n, *base[k + 1 :])
                    reach = max(reach, filled + n * size)
    return list(best[reach])


def plan_packing(counts: dict[int, int], capacity: int, groups: int = 100, small: float = 0.4) -> tuple[list[Span], int]:
    """Spans for all pieces and how many sequences they take; counts: pieces by length."""
    spans: list[Span] = []
    used = dict.fromkeys(counts, 0)
    bins: list[list[int]] = []  # [room left, first sequence, how many]: alike so far
    n_sequences = 0

    large = sorted((n for n in counts if small * capacity < n and counts[n]), reverse=True)
    total = sum(counts[n] for n in large)
    runs: list[list[list[int]]] = [[] for _ in range(groups)]  # of each group: [length, how many]
    g, room = 0, -(-total // groups)
    for n in large:
        left = counts[n]
        while left:
            take = min(left, room)
            runs[g].append([n, take])
            left, room = left - take, room - take
            if not room and g + 1 < groups:
                g, room = g + 1, -(-total // groups)
    runs = [r for r in runs if r]
    sizes, left = [r[0][0] for r in runs], [sum(n for _, n in r) for r in runs]
    while any(left):
        filling = fullest(sizes, left, capacity)
        times = min(have // n for have, n in zip(left, filling, strict=True) if n)
        alike = [[capacity, n_sequences, times, 0]]  # room, first sequence, how many, next offset
        for k, n in enumerate(filling):
            left[k] -= n * times
            for _ in range(n):
                after = []
                for free, first, many, offset in alike:
                    while many:
                        length, have = runs[k][0]
                        take = min(many, have)
                        spans.append(Span(length, used[length], take, first, 1, offset))
                        used[length] += take
                        after.append([free - length, first, take, offset + length])
                        first, many = first + take, many - take
                        runs[k][0][1] -= take
                        if not runs[k][0][1]:
                            runs[k].pop(0)
                alike = after
        bins += [[free, first, many] for free, first, many, _ in alike]
        n_sequences += times

    rooms: dict[int, list[list[int]]] = {}
    for free, first, many in bins:
        rooms.setdefault(free, []).append([first, many])
    order = sorted(rooms)

    def put_back(free: int, first: int, many: int):
        if many:
            if free not in rooms:
                rooms[free] = []
                insort(order, free)
            rooms[free].append([first, many])

    for n in sorted((n for n in counts if 0 < n <= small * capacity), reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(order, n)
            if at == len(order):
                many = -(-left // (capacity // n))
                put_back(capacity, n_sequences, many)
                n_sequences += many
                continue
            free = order[at]
            first, many = rooms[free].pop()
            if not rooms[free]:
                del rooms[free]
                order.pop(at)
            each = free // n
            whole = min(many, left // each)
            if whole:
                spans.append(Span(n, used[n], whole * each, first, each, capacity - free))
                used[n] += whole * each
                left -= whole * each
                put_back(free - each * n, first, whole)
            elif left:
                spans.append(Span(n, used[n], left, first, left, capacity - free))
                used[n] += left
                put_back(free - left * n, first, 1)
                left, whole = 0, 1
            put_back(free, first + whole, many - whole)
    return spans, n_sequences


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut where longer than a sequence."""

    def work(stream):
        own = encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in stream:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for name, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                data = own.ids(text) + tail
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    rows.append((name, k, a // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, shard_rows: int = 200_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    A null text counts as the empty one, which is its end id alone.  Only
    documents longer than a sequence are cut.  Repeated rows are packed each
    by itself; which of equal pieces gets which place is left open.  Other columns are ignored; no rows in, no rows out.  Ranks are
    counted within shards of about `shard_rows` pieces, and shards' counts add
    up over all, so no task holds more than a shard.
    """
    pieces = stored(token_pieces(docs, path, capacity, end), "pieces")
    rows = pieces.count()
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 + rows // shard_rows)).cast("int")
    pieces = pieces.withColumn("shard", shard)
    by_shard = stored(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r[0]: r[1] for r in by_shard.groupBy("length").agg(F.sum("n")).collect()}  # as many rows as lengths
    spans, _ = plan_packing(counts, capacity)
    spans.sort(key=lambda s: (s.length, s.first))
    columns = ("length", "first", "count", "sequence", "each", "offset")
    plan = docs.sparkSession.sparkContext.broadcast({c: np.array([getattr(s, c) for s in spans], np.int64) for c in columns})
    before = F.sum("n").over(_window("length", "shard")) - F.col("n")
    offsets = by_shard.select("shard", "length", before.alias("before"))
    local = F.row_number().over(_window("shard", "length", "doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("local", local).join(offsets, ["shard", "length"]).withColumn("rank", F.col("before") + F.col("local")).drop("shard", "local", "before")

    def place(stream):
        p = plan.value
        key = p["length"] << 44 | p["first"]
        for batch in stream:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            k = rank - p["first"][at]
            sequence = p["sequence"][at] + k // p["each"][at]
            offset = p["offset"][at] + k % p["each"][at] * length
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "piece", "start")} | {"length": pa.array(length), "ids_crc32": batch.column("ids_crc32"), "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _window(*columns: str):
    from pyspark.sql import Window

    keys = 2 if columns[0] == "shard" else 1
    return Window.partitionBy(*columns[:keys]).orderBy(*columns[keys:])
