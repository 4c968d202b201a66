"""The contract of feature generators, and those that the package has.

A generator gives each site of a sequence at most one feature.  It looks at
the bases around the site (`left` before and `right` after it) or at its
position.  A subclass says how many features it has and what they are called,
and numbers the sites of many sequences at once; it is sent to the tasks, so
it has to be picklable.  FeatureSet puts generators side by side: each
numbers its features after those of the one before.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Collection, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = "acgt"


class FeatureGenerator(ABC):
    """Gives each site one feature or none; to be subclassed."""

    left = right = 0  # bases before and after a site that its feature depends on
    fixed = False  # whether features depend on the position instead of the bases

    @property
    @abstractmethod
    def labels(self) -> list[str]:
        """The name of each feature."""

    @abstractmethod
    def index(self, codes: np.ndarray) -> np.ndarray:
        """codes: a row of base numbers (-1 unknown or beyond the end) for each sequence. The feature of each site, -1 where it has none."""

    @property
    def size(self) -> int:
        return len(self.labels)

    def without(self, removed: Collection[int]) -> FeatureGenerator:
        """The generator of the other features, numbered anew in their order; sites of removed ones have none."""
        return Reduced(self, removed) if removed else self


class MotifFeatures(FeatureGenerator):
    """The k bases around a site, `left` of them before it, numbered in base 4."""

    def __init__(self, k: int, left: int):
        if not 0 <= left < k:
            raise ValueError("a motif holds its site")
        self.k, self.left, self.right = k, left, k - 1 - left

    @property
    def labels(self) -> list[str]:
        return ["".join(BASES[i // 4**p % 4] for p in range(self.k - 1, -1, -1)) for i in range(4**self.k)]

    @property
    def size(self) -> int:
        return 4**self.k

    def index(self, codes: np.ndarray) -> np.ndarray:
        wide = np.pad(codes.astype(np.int32), ((0, 0), (self.left, self.right)), constant_values=-1)
        n = codes.shape[1]
        out, known = np.zeros(codes.shape, np.int32), np.ones(codes.shape, bool)
        for at in range(self.k):
            base = wide[:, at : at + n]
            out = out * 4 + base
            known &= base >= 0
        return np.where(known, out, -1)


class PositionFeatures(FeatureGenerator):
    """The label of the interval [break, next break) that holds a site's position, from 1; labels may repeat."""

    fixed = True

    def __init__(self, breaks: Sequence[int], labels: Sequence[str]):
        if len(breaks) != len(labels) + 1 or list(breaks) != sorted(breaks):
            raise ValueError("breaks rise, and there is one more of them than labels")
        self.breaks, self.intervals = list(breaks), list(labels)

    @property
    def labels(self) -> list[str]:
        return sorted(set(self.intervals))

    def index(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.breaks, np.arange(1, codes.shape[1] + 1), "right") - 1
        inside = (at >= 0) & (at < len(self.intervals))
        number = np.array([self.labels.index(x) for x in self.intervals], np.int32)
        row = np.where(inside, number[np.where(inside, at, 0)], -1)
        return np.where(codes >= 0, row, -1).astype(np.int32)


class Reduced(FeatureGenerator):
    """A generator less some of its features."""

    def __init__(self, whole: FeatureGenerator, removed: Collection[int]):
        self.whole, self.removed = whole, frozenset(removed)
        self.left, self.right, self.fixed = whole.left, whole.right, whole.fixed
        kept = [i for i in range(whole.size) if i not in self.removed]
        self.number = np.full(whole.size + 1, -1, np.int32)  # the last place serves -1
        self.number[kept] = np.arange(len(kept))

    @property
    def labels(self) -> list[str]:
        return [x for i, x in enumerate(self.whole.labels) if i not in self.removed]

    def index(self, codes: np.ndarray) -> np.ndarray:
        return self.number[self.whole.index(codes)]


class FeatureSet:
    """Generators side by side, with the offset of each one's features."""

    def __init__(self, generators: Sequence[FeatureGenerator]):
        self.generators = list(generators)
        self.offsets = np.append(0, np.cumsum([g.size for g in self.generators])).tolist()
        self.size = self.offsets[-1]
        self.left, self.right = max(g.left for g in self.generators), max(g.right for g in self.generators)
        self.fixed = any(g.fixed for g in self.generators)

    @property
    def labels(self) -> list[tuple[int, str]]:
        """(number of the generator, name) of each feature."""
        return [(i, x) for i, g in enumerate(self.generators) for x in g.labels]

    def index(self, codes: np.ndarray) -> np.ndarray:
        """(sequences, sites, generators): the features of each site, -1 where a generator gives none."""
        found = [g.index(codes) for g in self.generators]
        return np.stack([np.where(x >= 0, x + o, -1) for x, o in zip(found, self.offsets, strict=False)], axis=2).astype(np.int32)

    def without(self, removed: Collection[int]) -> FeatureSet:
        """The set of the other features, numbered anew."""
        inside = lambda lo, hi: [i - lo for i in removed if lo <= i < hi]
        return FeatureSet([g.without(inside(lo, hi)) for g, lo, hi in zip(self.generators, self.offsets, self.offsets[1:], strict=False)])


_CODE = np.full(256, -1, np.int8)
_CODE[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(4)


def codes_of(texts: Sequence[str | None]) -> np.ndarray:
    """A row of base numbers for each text, -1 for other letters and beyond its end."""
    raw = [(x or "").encode() for x in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    out = np.full((len(raw), int(sizes.max(initial=0))), -1, np.int8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = _CODE[np.frombuffer(b"".join(raw), np.uint8)]
    return out


def feature_sites(seqs: DataFrame, features: FeatureSet, key: str = "sk", text: str = "gs") -> DataFrame:
    """(key, pos, generator, feat_idx): the features of each site at which all generators' windows lie inside the sequence."""
    arrow = pa.schema([(key, pa.int64()), ("pos", pa.int32()), ("generator", pa.int32()), ("feat_idx", pa.int64())])

    def work(stream):
        for batch in stream:
            keys, texts = batch.column(key), batch.column(text).to_pylist()
            for lo in range(0, len(texts), 4096):
                part = texts[lo : lo + 4096]
                found = features.index(codes_of(part))
                at = np.arange(1, found.shape[1] + 1)
                inside = (at > features.left) & (at <= np.array([len(x or "") for x in part])[:, None] - features.right)
                row, site, which = np.nonzero((found >= 0) & inside[:, :, None])
                columns = [keys.take(pa.array(row + lo)), pa.array(site + 1, pa.int32()), pa.array(which, pa.int32()), pa.array(found[row, site, which], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return seqs.select(F.col(key).cast("long").alias(key), text).mapInArrow(work, f"{key} long, pos int, generator int, feat_idx long")
