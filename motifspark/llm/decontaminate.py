"""Benchmark decontamination: word windows of test items found in training texts.

The benchmark's windows are small and the corpus is large, so windows travel:
items are dealt into blocks of a bounded number of words (one block for any
ordinary benchmark), each block's windows become a hash set that is broadcast,
and one pass over the texts looks every token window up.  Words first become
ids of the block's vocabulary; only runs of known words as long as a window
are hashed, and each hash that is found is verified word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import WORD_BYTES, batches, free_name, lower_bytes, mix, stored, tidy, word_table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "row_id long, doc_id long, n_words long, starts binary, ends binary, items array<long>"


class WindowSet:
    """The windows of one block of items: a vocabulary and, for each window length, sorted hashes."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall(text)]
            for k in range(max(len(ids) - window + 1, 1) if ids else 0):
                self.owners[tuple(ids[k : k + window])].add(item)
        hashes, _, start, end = word_table([b" ".join(self.vocabulary)], WORD_BYTES)
        order = np.argsort(hashes)
        self.words, self.ids = hashes[order], order.astype(np.int64)
        by_length = defaultdict(list)
        for w in self.owners:
            by_length[len(w)].append(w)
        self.lengths = {n: np.unique(self.hashed(np.array(ws, np.int64))) for n, ws in sorted(by_length.items())}

    @staticmethod
    def hashed(windows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(windows), np.uint64)
        for k in range(windows.shape[1]):
            total = mix(total ^ mix(windows[:, k].astype(np.uint64) + np.uint64(k + 1)))
        return total

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The ids of words by hash, -1 for words of no item."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.ids[at], -1)

    def occurrences(self, hashes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, tuple[int, ...]]]:
        """(first word, past the last word, window) of each verified occurrence; owner: the text of each word."""
        ids = self.known(hashes)
        breaks = np.flatnonzero(ids < 0)
        fresh = np.flatnonzero(np.diff(owner, prepend=-1))
        stops = np.union1d(breaks, np.append(fresh, len(ids)))
        run = stops[np.searchsorted(stops, np.arange(len(ids)), "right")] - np.arange(len(ids)) if len(ids) else ids
        found = []
        for n, wanted in self.lengths.items():
            at = np.flatnonzero((ids >= 0) & (run >= n))
            if not len(at):
                continue
            windows = ids[at[:, None] + np.arange(n)]
            for k in np.flatnonzero(np.isin(self.hashed(windows), wanted)):
                if (key := tuple(windows[k].tolist())) in self.owners:
                    found.append((int(at[k]), int(at[k]) + n, key))
        return found


def _hits(rows: DataFrame, windows) -> DataFrame:
    def work(stream):
        block = windows.value
        for batch in stream:
            texts = batch.column("text").to_pylist()
            for a, b in batches(texts, 1 << 19):
                hashes, owner, _, _ = word_table([lower_bytes(x) for x in texts[a:b]], WORD_BYTES)
                begin = np.searchsorted(owner, np.arange(b - a + 1))
                starts, ends, items = defaultdict(list), defaultdict(list), defaultdict(set)
                for first, last, key in block.occurrences(hashes, owner):
                    k = int(owner[first])
                    starts[k].append(first - begin[k])
                    ends[k].append(last - begin[k])
                    items[k] |= block.owners[key]
                pack = lambda x: pa.array([np.array(x.get(k, []), np.int32).tobytes() for k in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "row_id": batch.column("row_id")[a:b], "doc_id": batch.column("doc_id")[a:b], "n_words": pa.array(np.diff(begin), pa.int64()),
                    "starts": pack(starts), "ends": pack(ends), "items": pa.array([sorted(items.get(k, ())) for k in range(b - a)], pa.list_(pa.int64())),
                })

    return rows.mapInArrow(work, HITS)


def covered_words(starts: bytes, ends: bytes) -> int:
    """How many words the spans cover together."""
    total = last = 0
    for a, b in sorted(zip(np.frombuffer(starts, np.int32).tolist(), np.frombuffer(ends, np.int32).tolist(), strict=True)):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_words: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, starts, ends, items): every occurrence of an item's window in each text.

    Words are runs of digits, letters and characters beyond ASCII, A-Z
    lower-cased.  A window is `window` consecutive words of an item; an item of
    fewer words, but not none, is one window.  starts and ends are packed int32
    word positions, items the ids whose windows occur.  Null texts have no
    words; null item ids count for nothing, as do repeated items.  One row per
    input row; an empty benchmark hits nothing.  Other columns are ignored.

    most_words bounds what is broadcast: a larger benchmark is dealt into
    blocks of items, the texts are passed over once for each, and the hits of
    a text are put together again.
    """
    spark = docs.sparkSession
    tests = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // (4 * most_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("row_id", F.lit(0).cast("long") if blocks == 1 else F.xxhash64("doc_id", "text"))
    found = None
    for k in range(blocks):
        items = [(r[0], lower_bytes(r[1])) for r in tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toLocalIterator()]
        part = _hits(rows, spark.sparkContext.broadcast(WindowSet(items, window)))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        together = lambda c: F.expr(f"unhex(array_join(transform(collect_list({c}), x -> hex(x)), ''))").alias(c)
        copies = F.expr(f"cast(count(*) / {blocks} as int)")
        found = found.groupBy("row_id", "doc_id", "n_words").agg(together("starts"), together("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), copies.alias("copies"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")
    return found.drop("row_id")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each document; see contamination()."""
    found = contamination(docs, benchmark, window)

    def work(stream):
        for batch in stream:
            hit = [covered_words(a, b) for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": pa.array(hit, pa.int64()), "items": batch.column("items")})

    counted = found.mapInArrow(work, "doc_id long, n_words long, n_hit long, items array<long>")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return counted.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_share: float = 0.2, most_chars: int = 8_000_000) -> DataFrame:
    """The documents without the benchmark's passages, with all their columns.

    Verified windows are cut out of a text; a document of which windows cover
    more than `most_share` of the words is removed.  Documents without hits
    stay as they are, as do null texts.  An empty benchmark changes nothing.

    most_chars bounds what is broadcast at once: a larger benchmark is dealt
    into blocks of items.  Each block's hits are found on the original text and
    travel with the row; the share is tested and the text cut once, after the
    last block, so the number of blocks doesn't change the result.
    """
    spark = docs.sparkSession
    tests = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // most_chars
    spans = free_name("window_spans", docs.columns)
    out = docs
    for k in range(blocks):
        items = [(r[0], lower_bytes(r[1])) for r in tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toLocalIterator()]
        mark, schema = _marking(out.schema, spark.sparkContext.broadcast(WindowSet(items, window)), spans)
        if k < blocks - 1:
            # written, so that a task holds one block of the benchmark
            out = stored(out.mapInArrow(mark, schema), "marked")
    cut, last = _cutting(schema, spans, most_share)
    return out.mapInArrow(lambda stream: cut(mark(stream)), last)


def _words(texts: list):
    """(raw texts, hashes, owner, start, end, each text's first word) of the words of some texts."""
    raw = [lower_bytes(x) for x in texts]
    hashes, owner, start, end = word_table(raw, WORD_BYTES)
    return raw, hashes, owner, start, end, np.searchsorted(owner, np.arange(len(texts) + 1))


def _marking(schema: T.StructType, windows, spans: str):
    """(a function of batches, its schema): adds a block's hits, pairs of int32 word positions, behind those in the column `spans`, which is made if missing."""
    names = schema.names
    at, held = names.index("text"), names.index(spans) if spans in names else None
    kept = [x for x in schema if x.name != spans]
    made = T.StructType([*kept, T.StructField(spans, T.BinaryType())])

    def work(stream):
        tidy()
        block = windows.value
        for batch in stream:
            texts = batch.column(at).to_pylist()
            found = [b""] * len(texts) if held is None else [x or b"" for x in batch.column(held).to_pylist()]
            for a, b in batches(texts, 1 << 19):
                _, hashes, owner, _, _, begin = _words(texts[a:b])
                own = defaultdict(list)
                for first, last, _ in block.occurrences(hashes, owner):
                    k = int(owner[first])
                    own[k] += [first - begin[k], last - begin[k]]
                for k, places in own.items():
                    found[a + k] += np.array(places, np.int32).tobytes()
            columns = batch.columns if held is None else [*batch.columns[:held], *batch.columns[held + 1 :]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=made.names)

    return work, made


def _cutting(schema: T.StructType, spans: str, most_share: float):
    """(a function of batches, its schema): leaves out the words that `spans` cover and that column, its last one."""
    at, made = schema.names.index("text"), T.StructType(schema.fields[:-1])

    def work(stream):
        for batch in stream:
            texts, found = batch.column(at).to_pylist(), batch.column(spans).to_pylist()
            keep = np.ones(len(texts), bool)
            hit = [k for k, x in enumerate(found) if x]
            for a, b in batches([texts[k] for k in hit], 1 << 19):
                raw, _, _, start, end, begin = _words([texts[k] for k in hit[a:b]])
                offset = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
                for i, k in enumerate(hit[a:b]):
                    merged: list[list[int]] = []
                    for first, last in sorted(np.frombuffer(found[k], np.int32).reshape(-1, 2).tolist()):
                        if merged and first <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], last)
                        else:
                            merged.append([first, last])
                    if sum(y - x for x, y in merged) > most_share * (begin[i + 1] - begin[i]):
                        keep[k] = False
                        continue
                    data, out, done = texts[k].encode("utf-8", "surrogatepass"), b"", 0
                    for first, last in merged:
                        out += data[done : start[begin[i] + first] - offset[i]]
                        done = int(end[begin[i] + last - 1] - offset[i])
                    texts[k] = (out + data[done:]).decode("utf-8", "surrogatepass")
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=made.names).filter(pa.array(keep))

    return work, made
