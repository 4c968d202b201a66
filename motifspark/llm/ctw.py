"""Context-tree weighting over bytes, learnt from a corpus and applied to every text.

A byte is predicted as eight binary decisions; each decision has a node in
every context of the last 0..depth bytes.  A node holds how often its bit was
0 and 1; its own estimate is Krichevsky-Trofimov's, and the weighted
probability of all its bits is half that estimate's plus half the product of
its children's, the children having one more byte of context.  Both need only
counts, since the estimate doesn't depend on the order of the bits, so the
tree of a whole corpus is made of n-gram counts:

1. Each block of texts (a split of the input) is reduced to its distinct
   tokens and (depth + 1)-grams with their counts in training texts.  They go
   to shards as packed arrays; an n-gram's shard follows from its last two
   context bytes, so a shard holds whole subtrees.
2. Shards weight their subtrees bottom up.  What they say about contexts of
   two bytes (at most 65,536, whatever the corpus) is joined to the root.
3. Shards mix the estimates of all depths for every n-gram of any text and
   send each block its own n-grams and tokens with their values.
4. Each block's texts meet these values once and are scored.

Work and shuffles grow with the distinct n-grams and tokens of each block;
no task holds more than one block or shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import NOT_SPACE, batches, crc, distinct, distinct_counts, lower_bytes, mix, stored, word_table

END = 0xFF  # the byte that ends each text and fills the context before its start
END_TOKEN = np.uint64(0xE4D0_0000_0000_00E1)
SHARDS_A_PARTITION = 4  # a task holds the levels of one shard at a time
_SMALL = 1 << 14


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


_LOG_INT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])  # ln gamma(n + 1)
_LOG_HALF = 0.5 * np.log(np.pi) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL) - 0.5))])  # ln gamma(n + 1/2)


def _table(table: np.ndarray, shift: float, n: np.ndarray) -> np.ndarray:
    small = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = n >= _SMALL
    if large.any():
        small[large] = _stirling(n[large] + shift)
    return small


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The natural logarithm of the Krichevsky-Trofimov probability of any order of these bits."""
    return _table(_LOG_HALF, 0.5, zeros) + _table(_LOG_HALF, 0.5, ones) - _table(_LOG_INT, 1.0, zeros + ones) - np.log(np.pi)


class Level:
    """The n-grams of one context depth, sorted by (context, byte), their counts and each deeper n-gram's place here."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, up: np.ndarray | None):
        self.keys, self.counts, self.up = keys, counts, up


class Bits:
    """A level's nodes for one position of the bit: each n-gram's node, and each node's first n-gram and counts."""

    def __init__(self, level: Level, j: int):
        byte = (level.keys & np.uint64(0xFF)).astype(np.uint8)
        node = (level.keys & ~np.uint64(0xFF)) | (np.uint64(1 << j) | (byte >> (8 - j)).astype(np.uint64))
        fresh = np.concatenate([[True], node[1:] != node[:-1]])
        self.start = np.flatnonzero(fresh)
        self.group = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.node = node[self.start]
        self.bit = (byte >> (7 - j)) & 1
        self.ones = np.add.reduceat(level.counts * self.bit, self.start).astype(np.float64)
        self.zeros = np.add.reduceat(level.counts, self.start) - self.ones


def contexts(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2) -> list[Level]:
    """Levels depth..top of sorted distinct n-grams, the latest context byte first, the predicted byte last."""
    levels = [Level(keys, counts, None)]
    for _ in range(depth - top):
        below = levels[-1]
        cut = ((below.keys >> np.uint64(16)) << np.uint64(8)) | (below.keys & np.uint64(0xFF))
        own, up = np.unique(cut, return_inverse=True)
        levels.append(Level(own, np.bincount(up, weights=below.counts, minlength=len(own)).astype(np.int64), up.astype(np.int32)))
    return levels


def subtrees(levels: list[Level], j: int) -> tuple[list[Bits], np.ndarray, list[np.ndarray]]:
    """The nodes of bit j level by level, the top level's log weighted probabilities, and the weights of the nodes' own estimates.

    Nodes of different bits never meet, so only one bit's are held at a time.
    """
    nodes, log_p, weight = [], None, []
    for level in levels:
        own = Bits(level, j)
        kt = log_kt(own.zeros, own.ones)
        if log_p is None:
            log_p = kt
            weight.append(np.ones(len(kt)))
        else:
            inner = np.bincount(own.group[level.up[nodes[-1].start]], weights=log_p, minlength=len(kt))
            both = np.logaddexp(kt, inner)
            log_p = both - np.log(2)
            weight.append(np.exp(kt - both))
        nodes.append(own)
    return nodes, log_p, weight


def join_top(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_p: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For context depths 1 and 0: weights and counts of each node, as dense arrays.

    nodes: (latest byte, byte before, place in the byte's tree) of depth 2, with counts and log weighted probability.
    """
    out = {}
    nodes = nodes.astype(np.int64)
    for d in (1, 0):
        nodes = ((nodes >> 16) << 8) | (nodes & 0xFF)
        size = 256 ** (d + 1)
        zeros, ones, inner = (np.bincount(nodes, weights=x, minlength=size) for x in (zeros, ones, log_p))
        kt = log_kt(zeros, ones)
        both = np.logaddexp(kt, inner)
        out[d] = (np.exp(kt - both), zeros, ones)
        log_p, nodes = both - np.log(2), np.arange(size)
    return out


def byte_scores(keys: np.ndarray, counts: np.ndarray, depth: int, top: dict) -> np.ndarray:
    """log10 of the mixed probability of each n-gram's last byte in its context; the counts are training's."""
    levels = contexts(keys, counts, depth)
    total = np.zeros(len(keys))
    for j in range(8):
        nodes, _, weight = subtrees(levels, j)
        at, p, bit = None, None, nodes[0].bit == 1
        for level, own, weights in zip(levels, nodes, weight, strict=True):
            at = level.up if at is None else level.up[at]
            g = own.group if at is None else own.group[at]
            zeros, ones = own.zeros[g], own.ones[g]
            here = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
            p = here if p is None else p + weights[g] * (here - p)
        node = nodes[-1].node.astype(np.int64)[g]
        for d in (1, 0):
            node = ((node >> 16) << 8) | (node & 0xFF)
            w, zeros, ones = (x[node] for x in top[d])
            p = p + w * ((np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1) - p)
        total += np.log10(p)
    return total


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram keys of all texts, each text's end included, and where each text's keys begin."""
    pad = bytes([END]) * depth
    buffer = np.frombuffer(pad + b"".join(x + pad for x in texts), np.uint8)
    lengths = np.array([len(x) for x in texts], np.int64)
    end = depth + np.cumsum(lengths + depth) - depth
    keep = np.ones(len(buffer), bool)
    keep[:depth] = False
    if depth > 1:
        keep[(end[:, None] + np.arange(1, depth)).ravel()] = False
    code = np.zeros(len(buffer) - depth, np.uint64)
    for k in range(1, depth + 1):
        code = (code << np.uint64(8)) | buffer[depth - k : len(buffer) - k]
    code = (code << np.uint64(8)) | buffer[depth:]
    return code[keep[depth:]], np.concatenate([[0], np.cumsum(lengths + 1)])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and where each text's begin; each text ends with the end token."""
    hashes, owner, _, _ = word_table(texts, NOT_SPACE)
    at = np.searchsorted(owner, np.arange(1, len(texts) + 1))
    return np.insert(hashes, at, END_TOKEN), np.concatenate([[0], at + np.arange(1, len(texts) + 1)])


def _sum_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def pack_numbers(numbers: np.ndarray) -> bytes:
    """All first bytes of the numbers before all second ones, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpack_numbers(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def short(numbers: np.ndarray) -> np.ndarray:
    """Rounded to 17 significant bits (by 2**-17 of the number at most), as 32-bit numbers whose last bits are 0 and take no space."""
    bits = numbers.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(1 << 6)) & np.uint32(0xFFFFFF80)).view(np.float32)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys: how many leading bytes each shares with the one before, then place by place the bytes that it doesn't share."""
    step = keys ^ np.concatenate([np.zeros(1, np.uint64), keys[:-1]]) if len(keys) else keys
    shared = np.zeros(len(keys), np.uint8)
    for i in range(1, 8):
        shared += step < np.uint64(1 << (64 - 8 * i))
    places = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
    return zstandard.compress(b"".join([np.int64(len(keys)).tobytes(), shared.tobytes(), *(places[shared <= i, i].tobytes() for i in range(8))]), 1)


def unpack_sorted(packed: bytes) -> np.ndarray:
    sent = np.frombuffer(zstandard.decompress(packed), np.uint8)
    n = int(sent[:8].view(np.int64)[0])
    shared, at = sent[8 : 8 + n], 8 + n
    places = np.zeros((n, 8), np.uint8)
    for i in range(8):
        own = np.cumsum(shared <= i, dtype=np.int32)
        count = int(own[-1]) if n else 0
        places[:, i] = np.concatenate([np.zeros(1, np.uint8), sent[at : at + count]])[own]
        at += count
    return places.view(">u8").ravel().astype(np.uint64)


def _shard_of(kind: int, keys: np.ndarray, depth: int, shards: int) -> np.ndarray:
    spread = mix(keys >> np.uint64(8 * (depth - 1))) if kind else keys >> np.uint64(20)
    return (spread % np.uint64(shards)).astype(np.int64)


def _split(kind: int, keys: np.ndarray, depth: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = _shard_of(kind, keys, depth, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def split_block(docs: DataFrame, most_bytes: int = 16 << 20) -> Column:
    """A label that any pass over the same rows repeats: the input split, cut further where it is large.

    Rows that come from no file are dealt by their id into as many blocks as their size asks for.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.input_file_block_length() / most_bytes)))
    spread = 1 if docs.inputFiles() else 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes
    return F.when(F.input_file_block_start() >= 0, F.xxhash64(F.input_file_name(), F.input_file_block_start(), part)).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(spread)))


def corpus_scores(docs: DataFrame, depth: int = 4, modulus: int = 7, held_out: int = 2, block: Column | None = None) -> DataFrame:
    """Scores each text by the weighted context tree and by add-one token frequencies of the training texts.

    A text trains unless crc32(doc_id as text) mod `modulus` is `held_out` (a
    null id counts as empty text).  Columns: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score, n_bytes.  score is the model's
    log10 probability of the text's bytes (A-Z lower-cased) and its end;
    -score / n_bytes * log2(10) is its code length in bits a byte.  Null texts
    are empty ones, whose only token is the end.  Repeated rows count each
    time.  Other columns are ignored; no rows in, no rows out.  Without
    training rows every bit has probability 1/2.

    block: labels rows so that a label's texts fit in a task's memory; it must
    come out alike in each pass over docs.
    """
    spark = docs.sparkSession
    shards = SHARDS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (split_block(docs) if block is None else block).alias("block"))
    learns = lambda value: crc(value) % modulus != held_out

    def pack(block: int, found: tuple[list, list]):
        for kind, parts in enumerate(found):
            keys, counts = _sum_up([x[0] for x in parts], [x[1] for x in parts])
            order, begin = _split(kind, keys, depth, shards)
            keys, counts = keys[order], counts[order].astype(np.uint32)
            at = [k for k in range(shards) if begin[k] < begin[k + 1]]
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(at), pa.int32()), "block": pa.array([block] * len(at), pa.int64()), "shard": pa.array(at, pa.int32()), "keys": pa.array([pack_sorted(keys[begin[k] : begin[k + 1]]) for k in at], pa.binary()), "counts": pa.array([pack_numbers(counts[begin[k] : begin[k + 1]]) for k in at], pa.binary())})

    def gather(stream):
        held: dict[int, tuple[list, list]] = {}
        size = 0
        for batch in stream:
            labels, texts = batch.column("block").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            trains = np.array([learns(x) for x in batch.column("doc_id").to_pylist()], bool)
            for label in np.unique(labels):
                at = np.flatnonzero(labels == label)
                for a, b in batches([texts[i] for i in at], 1 << 19):
                    part, own = [lower_bytes(texts[i]) for i in at[a:b]], trains[at[a:b]]
                    for kind, (keys, begin) in enumerate((tokens(part), grams(part, depth))):
                        learnt = np.repeat(own, np.diff(begin))
                        known, other = distinct_counts(keys[learnt]), distinct(keys[~learnt])
                        held.setdefault(int(label), ([], []))[kind].extend([known, (other, np.zeros(len(other), np.int64))])
                        size += len(known[0]) + len(other)
                    if size > 6_000_000:
                        for kept, found in held.items():
                            held[kept] = tuple([_sum_up([x[0] for x in parts], [x[1] for x in parts])] for parts in found)
                        if sum(len(x[0][0]) for found in held.values() for x in found) > 5_000_000:
                            for kept, found in held.items():
                                yield from pack(kept, found)
                            held = {}
                        size = sum(len(x[0][0]) for found in held.values() for x in found)
        for kept, found in held.items():
            yield from pack(kept, found)

    packed = stored(rows.mapInArrow(gather, "kind int, block long, shard int, keys binary, counts binary"), "ngrams")
    keys_of = lambda table: [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts_of = lambda table: [unpack_numbers(x, np.uint32) for x in table.column("counts").to_pylist()]

    def weigh(table: pa.Table) -> pa.Table:
        keys, counts = _sum_up(keys_of(table), counts_of(table))
        known = counts > 0
        if table.column("kind")[0].as_py() == 0:
            out = [[0], [int(counts.sum())], [int(known.sum())], [b""], [b""], [b""], [b""]]
        elif known.any():
            levels = contexts(keys[known], counts[known], depth)
            tops = [(nodes[-1], log_p) for nodes, log_p, _ in (subtrees(levels, j) for j in range(8))]
            out = [[1], [0], [0], *([np.concatenate(x).tobytes()] for x in zip(*((own.node, own.zeros, own.ones, log_p) for own, log_p in tops), strict=True))]
        else:
            out = [[]] * 7
        return pa.table({k: pa.array(x, kind) for (k, kind), x in zip((("kind", pa.int32()), ("total", pa.int64()), ("distinct", pa.int64()), ("node", pa.binary()), ("zeros", pa.binary()), ("ones", pa.binary()), ("log_p", pa.binary())), out, strict=True)})

    weighed = stored(packed.groupBy("kind", "shard").applyInArrow(weigh, "kind int, total long, distinct long, node binary, zeros binary, ones binary, log_p binary"), "weights")
    total, n_distinct = weighed.filter("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    parts = [[np.frombuffer(r[k], np.float64 if k else np.uint64) for r in weighed.filter("kind = 1").select("node", "zeros", "ones", "log_p").toLocalIterator()] for k in range(4)] if total else [[]] * 4
    top = spark.sparkContext.broadcast(join_top(*(np.concatenate(x) if x else np.zeros(0) for x in parts)))

    def answer(table: pa.Table) -> pa.Table:
        block, kind = table.column("block").to_numpy(), table.column("kind")[0].as_py()
        all_keys = keys_of(table)
        keys, counts = _sum_up(all_keys, counts_of(table))
        values = short(byte_scores(keys, counts, depth, top.value)) if kind else counts
        names, sent = np.unique(block), []
        for name in names:
            own = [all_keys[i] for i in np.flatnonzero(block == name)]
            own = distinct(np.concatenate(own))
            sent.append((pack_sorted(own), pack_numbers(values[np.searchsorted(keys, own)])))
        return pa.table({"block": pa.array(names, pa.int64()), "kind": pa.array([kind] * len(names), pa.int32()), "keys": pa.array([x[0] for x in sent], pa.binary()), "sent": pa.array([x[1] for x in sent], pa.binary())})

    answers = packed.groupBy("kind", "shard").applyInArrow(answer, "block long, kind int, keys binary, sent binary")

    def score(texts: pa.Table, sent: pa.Table) -> pa.Table:
        ids, raw = texts.column("doc_id"), texts.column("text").to_pylist()
        lookup, out = [], {k: [] for k in ("tokens", "known", "logs", "score", "bytes")}
        for kind, number in enumerate((np.int64, np.float32)):
            own = sent.filter(pa.compute.equal(sent.column("kind"), kind))
            lookup.append(Lookup(
                np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x.as_py()) for x in own.column("keys"))]),
                np.concatenate([np.zeros(0, number), *(unpack_numbers(x.as_py(), number) for x in own.column("sent"))]),
            ))
        for a, b in batches(raw, 1 << 19):
            part = [lower_bytes(x) for x in raw[a:b]]
            (words, word_at), (codes, code_at) = tokens(part), grams(part, depth)
            known = lookup[0](words)
            out["tokens"].append(np.diff(word_at))
            out["known"].append(np.add.reduceat((known > 0).astype(np.int64), word_at[:-1]))
            out["logs"].append(np.add.reduceat(np.log10(known + 1.0), word_at[:-1]))
            out["bytes"].append(np.diff(code_at) - 1)
            out["score"].append(np.add.reduceat(lookup[1](codes).astype(np.float64), code_at[:-1]))
        merged = {k: np.concatenate(x) if x else np.zeros(0) for k, x in out.items()}
        return pa.table({"doc_id": ids, "n_tokens": pa.array(merged["tokens"], pa.int64()), "n_known": pa.array(merged["known"], pa.int64()), "logs": pa.array(merged["logs"], pa.float64()), "score": pa.array(merged["score"], pa.float64()), "n_bytes": pa.array(merged["bytes"], pa.int64())})

    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, logs double, score double, n_bytes long")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == held_out
    return scored.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(total + n_distinct + 1))).alias("base_score"), "score", "n_bytes",
    )


class Lookup:
    """Values by key for distinct keys in any order: one probe for most, keys that share a slot have a smaller table of their own."""

    FEW = 64

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.tables = keys, values, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left) > self.FEW:
            bits = int(len(left)).bit_length()
            place = self._slot(keys[left], len(self.tables), bits)
            at = np.full(1 << bits, -1, np.int32)
            at[place] = left
            shared = at[place] != left
            crowded = np.unique(place[shared])
            at[crowded] = -2
            self.tables.append((bits, at))
            left = left[at[place] == -2]
        self.rest = left[np.argsort(keys[left])]

    def _slot(self, keys: np.ndarray, table: int, bits: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([table], np.uint64))) >> np.uint64(64 - bits)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        for k, (bits, table) in enumerate(self.tables):
            at = table[self._slot(keys[left], k, bits)]
            found[left] = at
            left = left[at == -2]
        if len(left) and len(self.rest):
            found[left] = self.rest[np.minimum(np.searchsorted(self.keys[self.rest], keys[left]), len(self.rest) - 1)]
        if (found < 0).any() or (self.keys[found] != keys).any():
            raise RuntimeError("a block's texts differ between two passes; give corpus_scores a stable block label")
        return self.values[found]
