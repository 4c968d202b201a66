"""Vectorised text helpers for the operators of this subpackage.

A column of texts is laid out as one byte buffer (A-Z lower-cased, one
separator byte between rows), so that words, shingles and byte contexts of a
whole Arrow batch come from a few numpy passes instead of a Python loop for
each character.  Every helper takes nulls as empty texts.
"""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = 0xFF  # never occurs in UTF-8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FINAL_1, _FINAL_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = 0x9E3779B97F4A7C15  # the multiplier of the rolling hash
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library: it keeps what it keeps
    _LIBC = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value over all others."""
    x = x ^ (x >> np.uint64(33))
    x *= _FINAL_1
    x ^= x >> np.uint64(33)
    x *= _FINAL_2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: What clears each thing that workers remember from task to task.
FORGET: list = []


def tidy() -> None:
    """Gives back what earlier tasks of this worker have left: what is remembered for other operators, and freed memory that allocators hold."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_LOWER)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by one sort, which numbers take fastest."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def byte_class(members: Iterable[int]) -> np.ndarray:
    """A table of 256 flags that are set for the members."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words that end at ASCII white space.
NOT_SPACE = ~byte_class([*range(0x09, 0x0E), 0x20, SEPARATOR])
#: Bytes of words made of digits, small letters and everything beyond ASCII.
WORD_BYTES = ~byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80), SEPARATOR])


def word_table(texts: list[bytes], members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: (hash, text's index, start, end); positions count in the joined buffer."""
    buffer = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    inside = members[buffer]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[buffer] * up[:-1], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(bounds, start, "right"), start, end


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of `width` words.

    A text of fewer words, but not none, has the whole sequence as its one
    shingle; a text without words has the empty set.
    """
    hashes, owner, _, _ = word_table(texts, NOT_SPACE)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    salts = mix(np.arange(1, width + 1, dtype=np.uint64))
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += mix(hashes[k : k + len(rolled)] ^ salts[k])
    rolled = mix(rolled)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield distinct(rolled[a : b - width + 1])
        elif b > a:
            yield mix(np.sum(mix(hashes[a:b] ^ salts[: b - a]), keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def batches(texts: list, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about `most_bytes` characters each; one long text stays whole."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += 0 if text is None else len(text)
        if held >= most_bytes:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores in front as far as columns of any case have it already."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def crc(value) -> int:
    """crc32 of a number as text; a null counts as the empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def crc_column(column: str, modulus: int) -> Column:
    """The same remainder in Spark; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder that driver and executors share.

    Where the session names none, as in tests, it is set to a folder below
    the warehouse, which all of Spark can reach as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: a cut of its lineage that survives lost executors."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
