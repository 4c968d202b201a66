"""Orders of many sequences at once against single ones."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from motifspark.operators import orders, sampling
from motifspark.operators.generators import FeatureSet, MotifFeatures, PositionFeatures

ROW = "sk long, gs string, mutations array<struct<pos:int,target:string>>"
SETS = [
    (FeatureSet([MotifFeatures(3, 1)]), 1),
    (FeatureSet([MotifFeatures(3, 1), PositionFeatures([1, 6, 40], ["x", "y"])]), 1),
    (FeatureSet([MotifFeatures(1, 0).without([2]), MotifFeatures(3, 2)]), 5),
]


def made(seed: int, n: int, features: FeatureSet, longest: int = 14):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(n + 5, longest + 1))
    text = "".join(rng.choice(list("acgtn"), length, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    places = rng.permutation(np.arange(1 + features.left, length - features.right + 1))[:n]
    return text, {int(p): str(rng.choice([b for b in "acgt" if b != text[p - 1]])) for p in places}


@pytest.mark.parametrize("which", range(3))
def test_steps_and_sums_are_those_of_single_rows(which):
    features, columns = SETS[which]
    theta = np.random.default_rng(which).normal(size=(features.size, columns))
    windows = orders.Windows(features, theta, 14)
    for n in (1, 2, 4, 6):
        rows = [made(seed, n, features) for seed in range(8)]
        places = np.array([sorted(t) for _, t in rows])
        targets = np.array([["acgt".index(t[p]) for p in sorted(t)] for _, t in rows])
        logs = orders.step_logs(windows, orders.codes_of([x for x, _ in rows]), np.array([len(x) for x, _ in rows]), places - 1, targets)
        for r, (text, own) in enumerate(rows):
            score = sampling.SetScore(text, own, features, theta)
            for state in range(1 << n):
                for i, p in enumerate(sorted(own)):
                    want = score.step(state, p) if not state >> i & 1 else -math.inf
                    assert logs[r, state, i] == pytest.approx(want, abs=1e-9)
            if n <= 4:
                want = np.logaddexp.reduce([score(o) for o in itertools.permutations(own)])
                assert orders.summed(logs)[r] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("which", range(3))
@pytest.mark.parametrize("wide", [1.0, 30.0])
def test_sums_are_those_of_the_steps(which, wide):
    """With and without logarithms: mutations next to each other and apart, at sites that can't mutate, of rates far apart."""
    features, columns = SETS[which]
    theta = np.random.default_rng(which).normal(size=(features.size, columns)) * wide
    theta[::9] = -np.inf
    windows = orders.Windows(features, theta, 30)
    assert (windows.least < orders.LEAST_STEP * 30) == (wide > 1)
    for n in (1, 2, 5, 9):
        rows = [made(seed, n, features, longest) for seed in range(12) for longest in (14, 30)]
        places = np.array([sorted(t) for _, t in rows])
        targets = np.array([["acgt".index(t[p]) for p in sorted(t)] for _, t in rows])
        given = windows, orders.codes_of([x for x, _ in rows]), np.array([len(x) for x, _ in rows]), places - 1, targets
        assert orders.sums(*given) == pytest.approx(orders.summed(orders.step_logs(*given)), abs=1e-9)


def test_drawn_orders_follow_their_likelihood_however_rows_are_dealt(spark):
    features, theta = SETS[0][0], np.random.default_rng(5).normal(size=(64, 1))
    text, own = made(3, 3, features)
    row = [(text, [(p, b) for p, b in own.items()])]
    frame = spark.createDataFrame([(k, *row[0]) for k in range(4000)], ROW)
    found = sampling.set_orders(frame, features, theta, burn_in=5, samples=1, seed=2)
    got = {r["sk"]: tuple(m["pos"] for m in r["mutations"]) for r in found.collect()}
    assert got == {r["sk"]: tuple(m["pos"] for m in r["mutations"]) for r in sampling.set_orders(frame.repartition(3), features, theta, burn_in=5, samples=1, seed=2).collect()}
    score, times = sampling.SetScore(text, own, features, theta), Counter(got.values())
    logs = {o: score(o) for o in itertools.permutations(own)}
    total = np.logaddexp.reduce(list(logs.values()))
    for o, x in logs.items():
        assert times[o] / 4000 == pytest.approx(math.exp(x - total), abs=0.04)


def test_sums_of_many_mutations_are_exact_and_odd_rows_go_one_by_one(spark):
    """Six to eight mutations were an estimate before."""
    features, theta = SETS[0][0], np.random.default_rng(7).normal(size=(64, 1))
    some = {k: made(k, 6 + k % 3, features, 24) for k in range(6)}
    rows = [(k, text, [(p, b) for p, b in own.items()]) for k, (text, own) in some.items()] + [(9, "acgtacgt", [(1, "c")]), (10, "acgtacgt", [(3, "a"), (1, "c")]), (11, "acg", [])]
    got = {r["sk"]: (r["n_events"], r["log_lik"]) for r in sampling.set_marginal_likelihoods(spark.createDataFrame(rows, ROW), features, theta).collect()}
    for k, (text, own) in some.items():
        score = sampling.SetScore(text, own, features, theta)
        assert got[k] == (len(own), pytest.approx(np.logaddexp.reduce([score(o) for o in itertools.permutations(own)]), abs=1e-8))
    assert got[9] == (0, 0.0) and got[10][0] == 1 and got[11] == (0, 0.0)
    wide = made(1, 17, features, 40)
    near = sampling.set_marginal_likelihoods(spark.createDataFrame([(1, wide[0], [(p, b) for p, b in wide[1].items()])], ROW), features, theta, samples=5).collect()
    assert near[0]["n_events"] == 17 and np.isfinite(near[0]["log_lik"])
