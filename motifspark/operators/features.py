"""Motif and position features of sites."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifspark.functions.sequences import motif_index, motif_text


def motif_dimension(spark: SparkSession, k: int) -> DataFrame:
    """(motif_idx, motif): all 4**k motifs, numbered in base 4."""
    return spark.range(4**k).select(F.col("id").alias("motif_idx"), motif_text("id", k).alias("motif"))


def sites(seqs: DataFrame, k: int, left: int, text: str = "gs") -> DataFrame:
    """A row for each site with a full motif: the columns of seqs, pos and motif; `left` bases of the motif lie before the site."""
    right = k - 1 - left
    spread = seqs.filter(F.length(text) >= k).withColumn("pos", F.explode(F.sequence(F.lit(left + 1), F.length(text) - right)))
    return spread.withColumn("motif", F.substring(F.col(text), F.col("pos") - left, F.lit(k)))


def position_features(found: DataFrame, breaks: Sequence[int], labels: Sequence[str], pos: str = "pos") -> DataFrame:
    """Adds label and label_idx of the interval [break, next break) that holds the position; null outside.

    Labels may repeat; their numbers follow their sorted order.
    """
    order = {x: i for i, x in enumerate(sorted(set(labels)))}
    label, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for lo, hi, name in zip(breaks[:-1], breaks[1:], labels, strict=True):
        inside = (F.col(pos) >= lo) & (F.col(pos) < hi)
        label, number = F.when(inside, F.lit(name)).otherwise(label), F.when(inside, F.lit(order[name])).otherwise(number)
    return found.withColumns({"label": label, "label_idx": number})


def hierarchical_features(seqs: DataFrame, blocks: Sequence[tuple[int, int]], key: str = "sk", text: str = "gs") -> DataFrame:
    """(key, pos, feat_idx): features of several motif lengths and offsets side by side, each block numbered after the one before.

    blocks: (k, bases before the site) of each.
    """
    parts, offset = [], 0
    for k, left in blocks:
        parts.append(sites(seqs.select(key, text), k, left, text).select(key, "pos", (motif_index("motif") + offset).alias("feat_idx")))
        offset += 4**k
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("feat_idx IS NOT NULL")


def without_features(dimension: DataFrame, removed: DataFrame, key: str = "motif") -> DataFrame:
    """The features that stay, numbered anew in their order; a dimension has 4**k rows at most."""
    return dimension.join(removed.select(key).distinct(), key, "left_anti").withColumn("feat_idx", F.row_number().over(Window.orderBy("motif_idx")) - 1)


def possible_targets(spark: SparkSession, k: int, left: int) -> DataFrame:
    """(motif, target, possible): a motif can't mutate to its own base."""
    targets = spark.range(4).select(F.substring(F.lit("acgt"), (F.col("id") + 1).cast("int"), F.lit(1)).alias("target"))
    return motif_dimension(spark, k).crossJoin(F.broadcast(targets)).withColumn("possible", F.substring("motif", left + 1, 1) != F.col("target"))


def neighbours(dimension: DataFrame) -> DataFrame:
    """(motif, other): motifs that differ in one base, each pair in both orders; 3 k rows a motif, without comparing all pairs."""
    spread = dimension.select("motif", F.explode(F.sequence(F.lit(1), F.length("motif"))).alias("at")).crossJoin(F.broadcast(dimension.sparkSession.range(4)))
    other = F.overlay("motif", F.substring(F.lit("acgt"), (F.col("id") + 1).cast("int"), F.lit(1)), F.col("at"), F.lit(1))
    return spread.select("motif", other.alias("other")).filter("motif <> other")


def aggregate_theta(full: DataFrame, blocks: Sequence[tuple[int, int, DataFrame]]) -> DataFrame:
    """(motif, theta): each full motif's sum of the coefficients of the shorter motifs inside it.

    blocks: (offset in the full motif, k, frame of motif and theta).
    """
    out, total = full.select("motif"), F.lit(0.0)
    for i, (offset, k, theta) in enumerate(blocks):
        inner = theta.select(F.col("motif").alias(f"inner_{i}"), F.col("theta").alias(f"theta_{i}"))
        out = out.join(F.broadcast(inner), F.substring("motif", offset + 1, k) == F.col(f"inner_{i}"), "left")
        total = total + F.coalesce(F.col(f"theta_{i}"), F.lit(0.0))
    return out.select("motif", total.alias("theta"))


def state_after(start: Column, mutations: Column, steps: Column) -> Column:
    """The sequence after the first `steps` of its ordered mutations."""
    return F.aggregate(F.slice(mutations, F.lit(1), steps), start, lambda s, x: F.overlay(s, x["target"], x["pos"], F.lit(1)))


def site_counts(seqs: DataFrame, k: int, left: int, text: str = "gs", end: str = "es") -> DataFrame:
    """(motif, target, n): how many sites have each full motif and mutate to this base, null where they don't; summed up in each task before the shuffle.

    A letter is whatever the texts have. Sites that the end lacks mutate to ''.
    """

    def work(stream):
        for batch in stream:
            starts, ends = batch.column(text).to_pylist(), batch.column(end).to_pylist()
            for lo in range(0, len(starts), 4096):
                yield from _site_counts(starts[lo : lo + 4096], ends[lo : lo + 4096], k, left)

    return seqs.select(text, end).mapInArrow(work, "motif string, target string, n long").groupBy("motif", "target").agg(F.sum("n").alias("n"))


def _site_counts(starts: Sequence[str | None], ends: Sequence[str | None], k: int, left: int):
    rows = [(a, b) for a, b in zip(starts, ends, strict=True) if a is not None and len(a) >= k]
    width = max((len(a) for a, _ in rows), default=0)
    if not width:
        return
    points = lambda texts: np.frombuffer("".join(x[:width].ljust(width, "\0") for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
    a, b = points([x for x, _ in rows]), points([x or "" for _, x in rows])
    b = np.where([[x is None] for _, x in rows], a, b)  # an unknown end differs nowhere
    letters, both = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    a, b = both[: a.size].reshape(a.shape), both[a.size :].reshape(b.shape)
    size, places = len(letters), width - k + 1
    inside = np.arange(places) <= np.array([len(x) for x, _ in rows])[:, None] - k
    motif = np.zeros(inside.shape, np.int64)
    for at in range(k):
        motif = motif * size + a[:, at : at + places]
    own, other = a[:, left : left + places], b[:, left : left + places]
    cell = (motif * (size + 1) + np.where(own == other, size, other))[inside]
    if size**k * (size + 1) <= 1 << 20:
        n = np.bincount(cell)
        cells = np.flatnonzero(n)
        n = n[cells]
    else:
        cells, n = np.unique(cell, return_counts=True)
    name = lambda x: chr(letters[x]).replace("\0", "")
    motifs = ["".join(chr(letters[x // size**at % size]) for at in range(k - 1, -1, -1)) for x in (cells // (size + 1)).tolist()]
    targets = [None if x == size else name(x) for x in (cells % (size + 1)).tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(motifs, pa.string()), pa.array(targets, pa.string()), pa.array(n.astype(np.int64))], names=["motif", "target", "n"])


def mutability(labelled: DataFrame, times: str | None = None) -> DataFrame:
    """(motif, mutability): how often a motif's site mutates, the sum over motifs scaled to 1; labelled: (motif, target), null where none, and a column of how many sites a row stands for, if not one."""
    n = F.col(times) if times else F.lit(1)
    rates = labelled.groupBy("motif").agg((F.coalesce(F.sum(F.when(F.col("target").isNotNull(), n)), F.lit(0)) / F.sum(n)).alias("rate"))
    total = rates.agg(F.sum("rate")).first()[0]
    return rates.select("motif", (F.col("rate") / F.lit(total)).alias("mutability"))


def substitution(labelled: DataFrame, times: str | None = None) -> DataFrame:
    """(motif, target, substitution): a motif's shares of targets among its mutations; times: as in mutability()."""
    counts = labelled.filter("target IS NOT NULL").groupBy("motif", "target").agg(F.sum(times or F.lit(1)).alias("n"))
    return counts.withColumn("substitution", F.col("n") / F.sum("n").over(Window.partitionBy("motif"))).drop("n")


def targeting(found: DataFrame, rates: DataFrame) -> DataFrame:
    """(motif, target, n, targeting): how many sites have each motif, and what their rates towards each target add up to; a null rate stays null."""
    return found.groupBy("motif").agg(F.count("*").alias("n")).join(F.broadcast(rates), "motif").select("motif", "target", "n", (F.col("n") * F.col("rate")).alias("targeting"))
