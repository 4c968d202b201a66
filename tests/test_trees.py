"""Trees against all assignments of ancestors, and their likelihoods against exact sums."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.operators import trees
from motifspark.operators.generators import FeatureSet, MotifFeatures
from motifspark.operators.sampling import SetScore

EDGES, SEQUENCES = "tree long, parent_id long, child_id long", "tree long, node long, sequence string"


def random_tree(rng, key, nodes=7, length=6):
    """Edges of a random tree, with leaves' sequences (some bases unknown), the root's in half of the trees."""
    parent = {k: int(rng.integers(0, k)) for k in range(1, nodes)}
    leaves = set(range(nodes)) - set(parent.values())
    sequences = {k: "".join(rng.choice(list("acgt"), length)) for k in leaves}
    if key % 2 and 0 not in leaves:
        sequences[0] = "".join(rng.choice(list("acgt"), length))
    if key % 3 == 0:
        some = max(leaves)
        sequences[some] = "n" + sequences[some][1:]
    return parent, sequences


def fewest(parent, sequences, length=6):
    """The least number of differing bases along edges over all assignments."""
    total = 0
    nodes = sorted({0, *parent})
    for at in range(length):
        choices = [[sequences[k][at]] if k in sequences and sequences[k][at] != "n" else list("acgt") for k in nodes]
        total += min(sum(x[nodes.index(k)] != x[nodes.index(p)] for k, p in parent.items()) for x in itertools.product(*choices))
    return total


def test_ancestors_need_the_fewest_mutations(spark):
    """All assignments of 40 trees of 7 nodes, with nodes of one, two and many children."""
    rng = np.random.default_rng(3)
    made = {key: random_tree(rng, key) for key in range(40)}
    edges = spark.createDataFrame([(t, p, k) for t, (parent, _) in made.items() for k, p in parent.items()], EDGES).repartition(3)
    sequences = spark.createDataFrame([(t, k, s) for t, (_, own) in made.items() for k, s in own.items()], SEQUENCES).repartition(3)
    found = trees.impute_ancestors(edges, sequences).cache()
    rows = {(r["tree"], r["node"]): r["sequence"] for r in found.collect()}
    assert set(rows) == {(t, k) for t, (parent, _) in made.items() for k in {0, *parent}}
    for (t, k), text in rows.items():
        given = made[t][1].get(k)
        assert re.fullmatch("[acgt]{6}", text) and (given is None or all(a in (b, "n") for a, b in zip(given, text, strict=True)))
    got = {r["tree"]: r["n_mutations"] for r in trees.mutations_needed(edges, found).collect()}
    assert got == {t: fewest(*x) for t, x in made.items()}
    again = {(r["tree"], r["node"]): r["sequence"] for r in trees.impute_ancestors(edges.repartition(5), sequences).collect()}
    assert again == rows  # ties go by digest


def test_levels_and_broken_trees(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 1, 3), (1, 1, 3), (2, 5, 6)], EDGES)
    assert sorted(tuple(r) for r in trees.levels(edges).collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 5, 0), (2, 6, 1)]
    with pytest.raises(ValueError, match="two parents"):
        trees.levels(spark.createDataFrame([(1, 0, 2), (1, 1, 2)], EDGES))
    with pytest.raises(ValueError, match="reached"):
        trees.levels(spark.createDataFrame([(1, 0, 1), (1, 2, 3), (1, 3, 2)], EDGES))
    assert trees.impute_ancestors(edges.limit(0), spark.createDataFrame([], SEQUENCES)).count() == 0


def clean(a, b, flank, key, filler):
    """By plain Python: mask, cut the ends, cut inner runs, fill."""
    if len(a) != len(b):
        return None
    a, b = (re.sub("[^acgt]", "n", x.lower()) for x in (a, b))
    both = [(x, y) if "n" not in (x, y) else ("n", "n") for x, y in zip(a, b, strict=True)]
    while both and both[0][0] == "n":
        both.pop(0)
    while both and both[-1][0] == "n":
        both.pop()
    if not both:
        return None
    out, run = [], 0
    for pair in both:
        run = run + 1 if pair[0] == "n" else 0
        if run <= flank:
            out.append(pair)
    filled = [(filler(key, i + 1),) * 2 if pair[0] == "n" else pair for i, pair in enumerate(out)]
    return "".join(x for x, _ in filled), "".join(y for _, y in filled)


def trim(a, b, left, right):
    """(start, end): each half scanned from outside for so many equal bases in a row."""

    def side(pairs, want):
        at = run = 0
        for i, (x, y) in enumerate(pairs):
            if run == want:
                break
            run = run + 1 if x == y else 0
            at = at if x == y else i + 1
        return at + want

    half = len(a) // 2
    pairs = list(zip(a, b, strict=True))
    return side(pairs[:half], left), len(a) - side(pairs[half:][::-1], right)


def test_pairs_are_cleaned_alike_and_trimmed(spark):
    import hashlib

    rng = np.random.default_rng(8)
    rows = [(0, "acgtacgtac", "acgtaccta"), (1, "nnnn", "acgt"), (2, "", ""), (3, None, "acgt"), (4, "ac", "gt"), (5, "acgtacgt", "acgtacgt")]
    for key in range(6, 120):
        a = "".join(rng.choice(list("acgtACGTn.-"), int(rng.integers(6, 40)), p=[0.2, 0.2, 0.2, 0.2, 0.02, 0.02, 0.02, 0.02, 0.08, 0.02, 0.02]))
        b = "".join(x if rng.random() < 0.8 else str(rng.choice(list("acgtn"))) for x in a)
        rows.append((key, a, b))
    filler = lambda key, i: "acgt"[int(hashlib.md5(f"{key}-{i}".encode()).hexdigest()[0], 16) % 4]
    for left, right in ((2, 2), (1, 3), (0, 0)):
        got = {r["key"]: r for r in trees.observed_pairs(spark.createDataFrame(rows, "key long, start string, end string"), left, right, "key").collect()}
        want = {}
        for key, a, b in rows:
            pair = a is not None and b is not None and clean(a, b, max(left, right), key, filler)
            if pair and (cut := trim(*pair, left, right))[1] >= cut[0]:
                gs, es = (x[cut[0] - left : cut[1] + right] for x in pair)
                want[key] = gs, es, [(i + 1, y) for i, (x, y) in enumerate(zip(gs, es, strict=True)) if x != y and left <= i < len(gs) - right]
        assert {k: (r["gs"], r["es"], [tuple(m) for m in r["mutations"]]) for k, r in got.items()} == want
        assert len(want) > 20
    bounded = trees.observed_pairs(spark.createDataFrame(rows, "key long, start string, end string"), 1, 1, "key", most_unknown=0.1)
    assert bounded.agg(F.max("unknown")).first()[0] <= 0.1


@pytest.mark.parametrize("columns", [1, 5])
def test_likelihood_of_a_tree_is_the_sum_of_its_edges(spark, columns):
    """Each edge by the sum over all orders of its mutations."""
    rng = np.random.default_rng(14)
    features = FeatureSet([MotifFeatures(3, 1)])
    theta = rng.normal(0, 0.5, (64, columns))
    edges, sequences, want = [], [], {}
    for tree in range(6):
        texts = {0: "".join(rng.choice(list("acgt"), 20))}
        for node in range(1, 4):
            up = int(rng.integers(0, node))
            text = list(texts[up])
            for p in rng.permutation(np.arange(3, 17))[: int(rng.integers(0, 4))]:
                text[p] = str(rng.choice([b for b in "acgt" if b != text[p]]))
            texts[node] = "".join(text)
            edges.append((tree, up, node))
            ready = trim(texts[up], texts[node], 1, 1)
            gs, es = texts[up][ready[0] - 1 : ready[1] + 1], texts[node][ready[0] - 1 : ready[1] + 1]
            targets = {i + 1: y for i, (x, y) in enumerate(zip(gs, es, strict=True)) if x != y}
            if targets:
                score = SetScore(gs, targets, features, theta)
                want[tree] = want.get(tree, 0.0) + math.log(sum(math.exp(score(o)) for o in itertools.permutations(targets)))
            else:
                want.setdefault(tree, 0.0)
        sequences += [(tree, k, s) for k, s in texts.items()]
    got = {r["tree"]: r for r in trees.tree_likelihoods(spark.createDataFrame(edges, EDGES), spark.createDataFrame(sequences, SEQUENCES), features, theta).collect()}
    assert set(got) == set(want) and all(abs(got[t]["log_lik"] - x) < 1e-9 and got[t]["n_edges"] == 3 for t, x in want.items())


def test_edges_count_once(spark):
    """An edge that came twice was counted four times, as its likelihood was joined back by its name."""
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 2)], EDGES)
    sequences = spark.createDataFrame([(1, 0, "acgtacgtacgt"), (1, 1, "acgtaagtacgt"), (1, 2, "acgtacgtacgt")], SEQUENCES)
    features, theta = FeatureSet([MotifFeatures(3, 1)]), np.zeros((64, 1))
    want = [tuple(r) for r in trees.tree_likelihoods(edges, sequences, features, theta).collect()]
    assert want[0][:3] == (1, 2, 1)
    assert [tuple(r) for r in trees.tree_likelihoods(edges.unionByName(edges), sequences, features, theta).collect()] == want


def test_imputed_pairs_are_the_pairs_along_edges(spark):
    """Trees of unknown bases and of uneven lengths, without a join of the sequences."""
    rng = np.random.default_rng(4)
    made = {key: random_tree(rng, key) for key in range(20)}
    made[3][1][max(made[3][1])] = "ac"
    edges = spark.createDataFrame([(t, p, k) for t, (parent, _) in made.items() for k, p in parent.items()], EDGES)
    sequences = spark.createDataFrame([(t, k, s) for t, (_, own) in made.items() for k, s in own.items()], SEQUENCES)
    want = trees.edge_pairs(edges, trees.impute_ancestors(edges, sequences)).select("tree", "parent_id", "child_id", "start", "end").collect()
    got = trees.imputed_pairs(edges.unionByName(edges), sequences)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 120
    assert got.columns == ["tree", "parent_id", "child_id", "start", "end"]
    assert trees.imputed_pairs(edges.limit(0), sequences.limit(0)).count() == 0
    ready = lambda clean: sorted(map(str, trees.observed_pairs(got, 1, 1, "child_id", clean=clean).collect()))
    assert ready(True) == ready(False)
