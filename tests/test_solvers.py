"""Fused lasso, logistic models by folds, ranks and lags against grids, optimality conditions and plain numpy."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.operators import fitting, logistic, models, proximal, sampling, statistics, tables
from motifspark.operators.generators import FeatureSet, MotifFeatures, PositionFeatures

ROW = "sk long, gs string, mutations array<struct<pos:int,target:string>>"


def test_edges_join_motifs_that_differ_in_one_base():
    features = FeatureSet([MotifFeatures(2, 0), MotifFeatures(3, 1), PositionFeatures([1, 5, 9], ["a", "b"])])
    names = features.labels
    want = {(i, j) for i, j in itertools.combinations(range(features.size), 2) if names[i][0] == names[j][0] < 2 and sum(a != b for a, b in zip(names[i][1], names[j][1], strict=True)) == 1}
    assert set(map(tuple, proximal.motif_edges(features).tolist())) == want


def fused_value(x, v, edges, sparse, fused):
    return ((x - v) ** 2).sum() / 2 + sparse * np.abs(x).sum() + fused * np.abs(x[edges[:, 0]] - x[edges[:, 1]]).sum()


def test_fused_lasso_against_a_fine_grid():
    """16 motifs of two bases: no point of a fine grid of two of them at once around the optimum is better, nor any random move."""
    rng = np.random.default_rng(1)
    edges = proximal.motif_edges(FeatureSet([MotifFeatures(2, 0)]))
    assert len(edges) == 48
    for sparse, fused in ((0.0, 0.1), (0.1, 0.05), (0.3, 0.02), (0.05, 2.0), (0.0, 0.0)):
        v = rng.normal(size=16)
        x = proximal.fused_lasso(edges, sparse, fused).prox(v, 1.0)
        best = fused_value(x, v, edges, sparse, fused)
        grid = np.linspace(-0.05, 0.05, 41)
        for i, j in itertools.combinations(range(16), 2):
            moved = np.repeat(x[None], 41 * 41, axis=0)
            moved[:, i] += np.repeat(grid, 41)
            moved[:, j] += np.tile(grid, 41)
            values = ((moved - v) ** 2).sum(axis=1) / 2 + sparse * np.abs(moved).sum(axis=1) + fused * np.abs(moved[:, edges[:, 0]] - moved[:, edges[:, 1]]).sum(axis=1)
            assert values.min() >= best - 1e-7
        for _ in range(2000):
            assert fused_value(x + rng.normal(size=16) * 10 ** rng.uniform(-5, 0), v, edges, sparse, fused) >= best - 1e-9
    assert np.ptp(proximal.fused_prox(rng.normal(size=16), edges, 50.0)) < 1e-6


def test_fused_fit_never_rises(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key in range(80):
        start = "".join(rng.choice(list("acgt"), 30))
        rows.append((key, start, [(p, t) for _, p, t in sampling.simulate(start, {"aca": 2.0, "act": 2.0}, 3, 1, rng, share=0.15)]))
    orders, features = spark.createDataFrame(rows, ROW).cache(), FeatureSet([MotifFeatures(3, 1)])
    edges = proximal.motif_edges(features)
    point, values = proximal.fit_proximal(orders, features, proximal.fused_lasso(edges, 0.01, 0.004), rounds=12)
    assert len(values) > 3 and all(b <= a + 1e-12 for a, b in zip(values, values[1:], strict=False)) and values[-1] < values[0] - 0.05
    # the lasso through the same door as by Newton steps
    plain, _ = proximal.fit_proximal(orders, features, proximal.lasso(0.03), rounds=150, tolerance=1e-6)
    newton = models.fit_orders(orders, features, (0.03, 0.0))
    assert np.abs(plain.theta - newton.theta).max() < 2e-3


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(7)
    rows = []
    for key in range(300):
        start = "".join(rng.choice(list("acgt"), 25))
        found = []
        for p in range(1, 26):
            if rng.random() < (0.5 if start[p - 1 : p + 1] == "ac" else 0.08):
                others = [b for b in "acgt" if b != start[p - 1]]
                found.append((p, str(rng.choice(others, p=[0.7, 0.2, 0.1]))))
        rows.append((key, start, found, key % 3))
    return rows, spark.createDataFrame(rows, ROW + ", fold int").repartition(4).cache()


FEATURES = FeatureSet([MotifFeatures(1, 0), MotifFeatures(2, 0)])


def test_outcomes_are_counted(sites):
    rows, frame = sites
    counts = logistic.collected(logistic.outcome_counts(frame, FEATURES, "fold"), 2)
    want = {}
    for _, start, found, fold in rows:
        targets = dict(found)
        for p in range(1, len(start)):
            own = "acgt".index(start[p - 1])
            key = (fold, own, 4 + own * 4 + "acgt".index(start[p]), own, "acgt".index(targets[p]) if p in targets else -1)
            want[key] = want.get(key, 0) + 1
    got = {(f, a, b, o, t): n for f, (a, b), o, t, n in zip(counts.fold.tolist(), counts.features.tolist(), counts.own.tolist(), counts.target.tolist(), counts.n.tolist(), strict=True)}
    assert got == want


@pytest.mark.parametrize("columns", [1, 5])
def test_logistic_fit_meets_its_optimality_conditions(sites, columns):
    counts = logistic.collected(logistic.outcome_counts(sites[1], FEATURES), 2)
    penalty, size = 20.0, FEATURES.size
    model = logistic.fit_logistic_model(counts, size, penalty, columns, tolerance=1e-7)
    # gradient by differences
    slope, free = model.gradient(counts)
    for i, c in itertools.product((0, 5, 7), range(columns)):
        for sign in (1, -1):
            model.theta[i, c] += sign * 1e-5
            value = model.log_likelihood(counts)
            model.theta[i, c] -= sign * 1e-5
            up, down = (value, 0) if sign == 1 else (up, value)
        assert abs((up - down) / 2e-5 - slope[i, c]) < 1e-3
    assert abs(free) < 1e-2
    zero = model.theta == 0
    assert (np.abs(slope[zero]) <= penalty + 1e-2).all() and np.abs(slope[~zero] - penalty * np.sign(model.theta[~zero])).max() < 1e-2
    assert zero.any() and (~zero).any()
    names = [x for _, x in FEATURES.labels]
    assert np.abs(model.theta[:, 0]).argmax() == names.index("ac") and model.theta[names.index("ac"), 0] > 0.5


def test_penalty_by_folds(sites):
    counts = logistic.collected(logistic.outcome_counts(sites[1], FEATURES, "fold"), 2)
    penalty, scores = logistic.best_penalty(counts, FEATURES.size, [3000.0, 5.0, 300.0], 5)
    assert [p for p, _ in scores] == [3000.0, 300.0, 5.0] and penalty == max(scores, key=lambda x: x[1])[0] == 5.0
    by_hand = sum(logistic.fit_logistic_model(counts.of(counts.fold != k), FEATURES.size, 300.0, 5).log_likelihood(counts.of(counts.fold == k)) for k in range(3))
    assert abs(by_hand - dict(scores)[300.0]) < 0.05
    empty = logistic.collected(logistic.outcome_counts(sites[1].limit(0), FEATURES), 2)
    assert not logistic.fit_logistic_model(empty, FEATURES.size, 1.0).theta.any()


def test_running_totals_ranks_and_medians_of_skewed_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("large", float(x), float(rng.random())) for x in rng.random(3000)] + [("ties", float(x), float(y)) for x, y in rng.integers(0, 4, (500, 2))] + [(None, 1.0, 2.0), ("one", 5.0, 6.0), ("two", 1.0, 2.0), ("two", 3.0, 1.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    totals = statistics.running_totals(frame, ["g"], ["x"], F.lit(1), "place")
    for g in ("large", "ties", None):
        got = [(r["x"], r["place"]) for r in totals.filter(F.col("g").eqNullSafe(g)).orderBy("place").collect()]
        assert [x for x, _ in got] == sorted(x for k, x, _ in rows if k == g) and [p for _, p in got] == list(range(1, len(got) + 1))
    got = {r["g"]: r["median"] for r in statistics.medians(frame, ["g"], "x").collect()}
    assert got == {g: float(np.median([x for k, x, _ in rows if k == g])) for g in {k for k, _, _ in rows}}

    def rank(values):
        values = np.array(values)
        return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])

    found = {r["g"]: r["spearman"] for r in statistics.spearman(frame, "x", "y", ["g"]).collect()}
    for g in ("large", "ties"):
        x, y = zip(*[(a, b) for k, a, b in rows if k == g], strict=True)
        assert abs(found[g] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9


@pytest.mark.parametrize(("block", "lags"), [(8, 40), (64, 5), (1 << 14, 299)])
def test_lags_in_blocks(spark, block, lags):
    """Lags longer than a block, shorter, and all of a series, with gaps in its order."""
    rng = np.random.default_rng(block)
    series = {"a": np.cumsum(rng.normal(size=300)), "b": rng.normal(size=7), "c": np.full(20, 3.0), "d": np.array([1.0])}
    rows = [(k, int(i * 3 + i % 2), float(v)) for k, values in series.items() for i, v in enumerate(values)]
    got = statistics.autocorrelation(spark.createDataFrame(rows, "k string, at int, v double").repartition(5), ["k"], "at", "v", lags, block).collect()
    want = {}
    for k, values in series.items():
        c = values - values.mean()
        for lag in range(1, min(lags, len(values) - 1) + 1):
            want[k, lag] = float((c[:-lag] * c[lag:]).sum() / (c * c).sum()) if (c * c).sum() > 0 else None
    assert {(r["k"], r["lag"]) for r in got} == set(want)
    assert all((r["correlation"] is None) == (want[r["k"], r["lag"]] is None) and (r["correlation"] is None or abs(r["correlation"] - want[r["k"], r["lag"]]) < 1e-9) for r in got)


@pytest.mark.parametrize("penalty", [0.0, 0.01, 0.2])
def test_closed_form_of_single_motifs(spark, penalty):
    """Against a fine grid of each motif's own objective."""
    counts = {"a": (3, 40), "b": (20, 40), "c": (39, 40), "d": (1, 2), "e": (7, 10)}
    rows = [(m, i < hits) for m, (hits, n) in counts.items() for i in range(n)]
    got = fitting.fit_logistic(spark.createDataFrame(rows, "motif string, mutated boolean"), penalty)
    grid = np.linspace(-6, 6, 120_001)
    for m, (hits, n) in counts.items():
        value = (n * np.logaddexp(0, grid) - hits * grid) / len(rows) + penalty * np.abs(grid)
        assert abs(got[m] - grid[value.argmin()]) < 2e-4
    always = fitting.fit_logistic(spark.createDataFrame([("x", True), ("y", False)], "motif string, mutated boolean"), 0.0)
    assert always == {"x": np.inf, "y": -np.inf}


def test_groups_are_balanced_over_folds(spark):
    sizes = {"a": 9, "b": 7, "c": 7, "d": 4, "e": 3, "f": 3, "g": 2, "h": 1, None: 5}
    frame = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string").repartition(3)
    got = {r["g"]: r["fold"] for r in tables.group_folds(frame, "g", 3).collect()}
    held, want = [0, 0, 0], {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0] is not None, str(x[0]))):
        want[g] = held.index(min(held))
        held[want[g]] += n
    assert got == want and max(held) - min(held) <= 2
    some = {r["g"]: r["fold"] for r in tables.group_folds(frame, "g", 3, most=4).collect()}
    assert set(some) == set(sizes) and all(some[g] == want[g] for g in "abc") and set(some.values()) <= {0, 1, 2}


def test_lines_of_intervals(spark):
    rows = [("aa", 0.1, 0.25, 0.4), ("ac", -2.0, -1.0, 0.0), ("ag", None, None, None), ("at", -1.0, float("-inf"), 1.0)]
    got = tables.interval_lines(spark.createDataFrame(rows, "m string, lo double, v double, hi double"), "m", "lo", "v", "hi").orderBy("place").collect()
    assert [tuple(r) for r in got] == [(1, "-1.000, [-2.000, 0.000] (ac)"), (2, "0.250, [0.100, 0.400] (aa)")]
