"""Many trees at once: their levels, most parsimonious ancestors, mutations along edges, and likelihoods.

Edges are rows (tree, parent_id, child_id), sequences rows (tree, node,
sequence).  Work goes level by level over all trees, each level one join by
(tree, node); a level's rows are written once, so a lost executor costs a
level and not the way to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from motifspark.functions.sequences import BASES, cleaned_pair, differing, disambiguate
from motifspark.functions.texts import ends_of, padded, texts_of

from .fitting import kept
from .generators import FeatureSet
from .sampling import set_marginal_likelihoods

# A set of bases is four bits.  In texts it is a letter, n for all four, or the character of its bits.
_BITS = np.zeros(256, np.uint8)
_BITS[:16] = np.arange(16)
_BITS[np.frombuffer(b"acgtn", np.uint8)] = 1, 2, 4, 8, 15
_LETTERS = np.zeros(16, np.uint8)
_LETTERS[[1, 2, 4, 8]] = np.frombuffer(BASES.encode(), np.uint8)
_MOST_ROWS = 1 << 15  # children that are counted at once, in 16 bits
_COUNTERS = sum((np.arange(16, dtype=np.uint64) >> np.uint64(k) & np.uint64(1)) << np.uint64(16 * k) for k in range(4))  # by set: one counter for each base


def levels(edges: DataFrame) -> DataFrame:
    """(tree, node, depth): 0 at roots. Raises ValueError where a node can't be reached from a root or has two parents."""
    return reduce(DataFrame.unionByName, [x.drop("parent_id") for x in _levels(edges)])


def _levels(edges: DataFrame) -> list[DataFrame]:
    """(tree, node, parent_id, depth) by level, roots first; edges may repeat."""
    parent = F.col("parent_id")
    ups = edges.groupBy("tree", F.col("child_id").alias("node")).agg(F.min(parent).alias("parent_id"), F.max(parent).alias("last"), F.count(parent).alias("known"), F.count("*").alias("n"))
    ups = kept(ups.select("tree", "node", "parent_id", (F.coalesce(parent != F.col("last"), F.lit(False)) | F.col("known").between(1, F.col("n") - 1)).alias("several")), "edges")
    if ups.filter("several").limit(1).count():
        raise ValueError("a node has two parents")
    roots = ups.select("tree", parent.alias("node")).distinct().join(ups.select("tree", "node"), ["tree", "node"], "left_anti")
    found = [kept(roots.select("tree", "node", F.lit(None).cast(ups.schema["parent_id"].dataType).alias("parent_id"), F.lit(0).alias("depth")), "level")]
    left = ups.count()
    while left:
        here = found[-1].select("tree", F.col("node").alias("parent_id"))
        below = kept(ups.join(here, ["tree", "parent_id"]).select("tree", "node", "parent_id", F.lit(len(found)).alias("depth")), "level")
        if not (n := below.count()):
            raise ValueError("a node can't be reached from a root")
        found.append(below)
        left -= n
    return found


def _counted(below: DataFrame, name: str) -> DataFrame:
    """(tree, node, counted): for each parent, at each position the bases that the most of its children's sets have; below: (tree, parent_id, bases).

    Children come sorted by their parent, so a task adds up one parent after the other, however many children it has.
    """
    kinds = ", ".join(f"{c} {below.schema[x].dataType.simpleString()}" for c, x in (("tree", "tree"), ("node", "parent_id")))

    def work(stream):
        held = None  # the parent that the next batch may go on with, and its counts

        def rows(trees, nodes, counts):
            most = counts.max(axis=0)
            bases = np.zeros(most.shape, np.uint8)
            for k in range(4):
                bases |= ((counts[k] == most) & (most > 0)).astype(np.uint8) << k
            return pa.RecordBatch.from_arrays([trees, nodes, texts_of(bases)], names=["tree", "node", "counted"])

        for batch in (b.slice(lo, _MOST_ROWS) for b in stream for lo in range(0, b.num_rows, _MOST_ROWS)):
            trees, nodes = batch.column("tree"), batch.column("parent_id")
            sets = _BITS[padded(batch.column("bases"))]
            new = np.ones(batch.num_rows, bool)
            same = pc.and_(pc.equal(trees[1:], trees[:-1]), pc.equal(nodes[1:], nodes[:-1]))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            packed = np.add.reduceat(_COUNTERS[sets], first, axis=0)  # four counters of 16 bits
            counts = np.stack([(packed >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)])
            if held is not None:
                own, before = held
                if own == (trees[0].as_py(), nodes[0].as_py()):
                    wide = max(before.shape[2], counts.shape[2])
                    counts = np.pad(counts, ((0, 0), (0, 0), (0, wide - counts.shape[2])))
                    counts[:, 0, : before.shape[2]] += before[:, 0]
                else:
                    yield rows(pa.array([own[0]], trees.type), pa.array([own[1]], nodes.type), before)
            if len(first) > 1:
                at = pa.array(first[:-1])
                yield rows(trees.take(at), nodes.take(at), counts[:, :-1])
            held = (trees[int(first[-1])].as_py(), nodes[int(first[-1])].as_py()), counts[:, -1:]
        if held is not None:
            yield rows(pa.array([held[0][0]], trees.type), pa.array([held[0][1]], nodes.type), held[1])

    parts = int(below.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = below.select("tree", "parent_id", "bases").repartition(parts, "tree", "parent_id").sortWithinPartitions("tree", "parent_id")
    return dealt.mapInArrow(work, f"{kinds}, counted string").withColumnRenamed("counted", name)


def _chosen(sets: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """(tree, node, base): at each position the parent's base if the set has it, else one by a digest of tree, node and position; sets: (tree, node, bases, above), above null at roots; also: columns that stay."""
    columns = ["tree", "node", *also]
    schema = StructType([*(sets.schema[c] for c in columns), StructField("base", StringType())])

    def work(stream):
        for batch in stream:
            bases, above = _BITS[padded(batch.column("bases"))], _BITS[padded(batch.column("above"))]
            root = batch.column("above").is_null().to_numpy(zero_copy_only=False)
            wide = max(bases.shape[1], above.shape[1])
            bases, above = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (bases, above))
            bases[~root] *= above[~root] > 0  # positions that both have
            base = np.where(bases & above, above, bases)
            rows, places = (x.tolist() for x in np.nonzero(_LETTERS[base] < (base > 0)))
            if rows:
                names = batch.column("name").to_pylist()
                for row, at in zip(rows, places, strict=True):
                    bits = [1 << k for k in range(4) if base[row, at] >> k & 1]
                    base[row, at] = bits[int(md5(f"{names[row]}-{at + 1}".encode()).hexdigest()[:6], 16) % len(bits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), texts_of(_LETTERS[base])], names=[*columns, "base"])

    name = F.concat_ws("-", F.col("tree").cast("string"), F.col("node").cast("string")).alias("name")
    return sets.select("bases", "above", *(c for c in columns if c != "above"), name).mapInArrow(work, schema)


def impute_ancestors(edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """(tree, node, sequence) of all nodes, with the fewest mutations that the given sequences allow.

    sequences: of all leaves, and of those inner nodes (such as the root) that
    are known; those of a tree are equally long.  Upwards, a node's set at a
    position has the bases that the most of its children's sets have; a node
    with several children of one is exact as well.  Downwards, a node takes its
    parent's base if its set has it, else one of its set by a digest of tree,
    node and position.  Unknown bases of leaves are filled the same way; known
    sequences of inner nodes stay as they are.
    """
    levels = _imputed(edges, sequences)
    levels[-1] = kept(levels[-1], "bases")
    return reduce(DataFrame.unionByName, levels).filter("base <> ''").select("tree", "node", F.col("base").alias("sequence"))


def imputed_pairs(edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """The edge_pairs() of impute_ancestors(), without a join: where a node's bases are chosen, its parent's are at hand. Edges that repeat count once."""
    found = reduce(DataFrame.unionByName, _imputed(edges, sequences, ("parent_id", "above"))).filter("above <> '' AND base <> ''")
    return found.select("tree", "parent_id", F.col("node").alias("child_id"), F.col("above").alias("start"), F.col("base").alias("end"))


def _imputed(edges: DataFrame, sequences: DataFrame, also: Sequence[str] = ()) -> list[DataFrame]:
    """(tree, node, base) by level, roots first; also: columns of the sets, parent_id or above, that stay. All levels but the last are written."""
    depth = _levels(edges)
    deepest = len(depth) - 1
    # a node's sets are a text: a node is one row
    given = sequences.select("tree", "node", disambiguate("sequence").alias("given"), F.lit(True).alias("known"))
    nodes = kept(reduce(DataFrame.unionByName, depth).join(given, ["tree", "node"], "left"), "nodes")
    # upwards: sets of the deepest level first
    sets: dict[int, DataFrame] = {}
    for level in range(deepest, -1, -1):
        here = nodes.filter(F.col("depth") == level)
        if level < deepest:
            here = here.join(_counted(sets[level + 1], "counted"), ["tree", "node"], "left").withColumn("given", F.when(F.col("known"), F.col("given")).otherwise(F.col("counted")))
        here = here.filter(F.length("given") > 0).select("tree", "node", "parent_id", F.col("given").alias("bases"))
        sets[level] = kept(here, "sets") if level < deepest else here  # the deepest sets are given
    # downwards
    chosen = [_chosen(sets[0].withColumn("above", F.lit(None).cast("string")), also)]
    for level in range(1, deepest + 1):
        chosen[-1] = kept(chosen[-1], "bases")
        above = chosen[-1].select("tree", F.col("node").alias("parent_id"), F.col("base").alias("above"))
        chosen.append(_chosen(sets[level].join(above, ["tree", "parent_id"]), also))
    return chosen


def mutations_needed(edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """(tree, n_mutations): the bases that differ along the edges."""
    return edge_pairs(edges, sequences).groupBy("tree").agg(F.sum(F.size(differing("start", "end"))).cast("long").alias("n_mutations"))


def edge_pairs(edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """(tree, parent_id, child_id, start, end): the sequences at both ends of each edge."""
    up = sequences.select("tree", F.col("node").alias("parent_id"), F.col("sequence").alias("start"))
    down = sequences.select("tree", F.col("node").alias("child_id"), F.col("sequence").alias("end"))
    return edges.select("tree", "parent_id", "child_id").join(up, ["tree", "parent_id"]).join(down, ["tree", "child_id"])


def observed_pairs(pairs: DataFrame, left: int, right: int, key: Column | str, start: str = "start", end: str = "end", most_unknown: float = 1.0, clean: bool = False) -> DataFrame:
    """Pairs made ready for the likelihood: adds gs, es, mutations and unknown to the other columns.

    Both sequences are cleaned alike (see cleaned_pair(): unknown runs are cut
    to the wider flank), then trimmed to what lies between `left` and `right`
    conserved bases, and widened again by these flanks.  mutations are the
    differing places of gs between the flanks, in order of place, with their
    new base.  Pairs of
    different lengths, without a known base, shorter than both flanks or with
    a greater share of unknown bases than most_unknown are left out; pairs
    without a mutation stay.  clean: the sequences are known to be of acgt.
    """
    same = (F.length(start) == F.length(end)) & (F.length(start) > 0)
    if clean:
        pair = F.when(same, F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.lit(0.0).alias("unknown")))
    else:
        # pairs without an unknown base are clean as they are
        plain = lambda x: F.lower(x).rlike(rf"\A[{BASES}]+\z")
        lower = F.struct(F.lower(start).alias("start"), F.lower(end).alias("end"), F.lit(0.0).alias("unknown"))
        pair = F.when(same & plain(start) & plain(end), lower).otherwise(cleaned_pair(start, end, max(left, right), key))
    added = StructType.fromDDL("gs string, es string, unknown double, mutations array<struct<pos:int,target:string>>").fields
    others = [c for c in pairs.columns if c not in {f.name for f in added}]
    inner = pa.list_(pa.struct([("pos", pa.int32()), ("target", pa.string())]))

    def work(stream):
        for batch in stream:
            found = batch.column("pair_")
            share = pc.struct_field(found, "unknown")
            batch = batch.filter(pc.fill_null(pc.less_equal(share, most_unknown), False))
            found = batch.column("pair_")
            a, b = (padded(pc.struct_field(found, c)) for c in ("start", "end"))
            first, last = _between(a, b, left, right)
            stays = np.flatnonzero(last - first >= left + right)
            first, last, a, b = first[stays, None], last[stays, None], a[stays], b[stays]
            place = np.arange(a.shape[1])
            inside = (place >= first) & (place < last)
            row, at = np.nonzero((a != b) & (place >= first + left) & (place < last - right))
            targets = pa.StringArray.from_buffers(len(row), pa.py_buffer(np.arange(len(row) + 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(b[row, at])))
            events = pa.StructArray.from_arrays([pa.array(at - first[row, 0] + 1, pa.int32()), targets], fields=list(inner.value_type))
            mutations = pa.ListArray.from_arrays(pa.array(ends_of(np.bincount(row, minlength=len(stays)))), events, type=inner)
            batch = batch.take(pa.array(stays))
            new = [texts_of(a, inside), texts_of(b, inside), pc.struct_field(batch.column("pair_"), "unknown"), mutations]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *new], names=[*others, *(f.name for f in added)])

    schema = StructType([*(pairs.schema[c] for c in others), *added])
    made = pairs.select(*others, pair.alias("pair_")).mapInArrow(work, schema)
    return made.select(*pairs.columns, *(f.name for f in added if f.name not in pairs.columns))


def _between(a: np.ndarray, b: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where (before the latter) a pair's rows stay: what the flanks of trimmed() begin and end with; a and b: (row, place), 0 beyond the end."""
    differs, size = a != b, (a > 0).sum(axis=1)
    half, width = size // 2, a.shape[1]
    first, last = np.zeros(len(a), np.int64), size.astype(np.int64)
    for p in range(width):
        # the first place after `left` equal ones ends it
        first = np.where(differs[:, p] & (p < half) & (p - first < left), p + 1, first)
        if not (p + 1 - first < left).any():
            break
    for p in range(1, width + 1):
        at = size - p
        hit = differs[np.arange(len(a)), np.maximum(at, 0)] & (at >= half) & (last - at <= right)
        last = np.where(hit, at, last)
        if not (last - at < right).any():
            break
    return first, last


def tree_likelihoods(edges: DataFrame, sequences: DataFrame, features: FeatureSet, theta: np.ndarray, samples: int = 1000, seed: int = 0) -> DataFrame:
    """(tree, n_edges, n_mutated, log_lik): pairs_likelihoods() of a tree's edges, each counted once; sequences: of all nodes."""
    return pairs_likelihoods(edge_pairs(edges.select("tree", "parent_id", "child_id").distinct(), sequences), features, theta, samples, seed)


def pairs_likelihoods(pairs: DataFrame, features: FeatureSet, theta: np.ndarray, samples: int = 1000, seed: int = 0, clean: bool = False) -> DataFrame:
    """(tree, n_edges, n_mutated, log_lik): the sum over a tree's edges of the marginal log-likelihood of the end, whatever the order of mutations; pairs: see edge_pairs().

    Edges between sequences that observed_pairs() leaves out don't count; clean:
    see there.  An edge's random numbers are seeded by its tree and nodes.
    """
    named = pairs.withColumn("edge", F.concat_ws("-", F.col("tree").cast("string"), F.col("parent_id").cast("string"), F.col("child_id").cast("string"))).select("tree", "edge", "start", "end")
    ready = observed_pairs(named, features.left, features.right, "edge", clean=clean).select("tree", "edge", "gs", "mutations")
    found = set_marginal_likelihoods(ready, features, theta, samples, seed, "edge", others=["tree"])
    return found.groupBy("tree").agg(F.count("*").alias("n_edges"), F.count_if(F.col("n_events") > 0).alias("n_mutated"), F.sum("log_lik").alias("log_lik"))
