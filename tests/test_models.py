"""Feature sets, the likelihood over them, two-stage fits, comparisons and paths against brute force and optimality conditions."""

from __future__ import annotations

import itertools
import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from motifspark.operators import hazards, likelihood, models, sampling
from motifspark.operators.generators import FeatureGenerator, FeatureSet, MotifFeatures, PositionFeatures, codes_of, feature_sites
from motifspark.operators.statistics import chain_intervals, corrected_interval

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import the tests
ROW = "sk long, gs string, mutations array<struct<pos:int,target:string>>"


class PairOfEnds(FeatureGenerator):
    """A generator of the tests' own: whether both neighbours of a site are equal."""

    left = right = 1

    @property
    def labels(self):
        return ["different", "equal"]

    def index(self, codes):
        wide = np.pad(codes, ((0, 0), (1, 1)), constant_values=-1)
        before, after = wide[:, :-2], wide[:, 2:]
        return np.where((before >= 0) & (after >= 0), (before == after).astype(np.int32), -1)


SETS = {"motifs": FeatureSet([MotifFeatures(3, 1)]), "mixed": FeatureSet([MotifFeatures(1, 0), MotifFeatures(2, 1), PositionFeatures([1, 9, 18, 40], ["a", "b", "a"])]), "own": FeatureSet([PairOfEnds(), MotifFeatures(2, 0).without([3, 5])])}


def made(n, length=24, many=5, seed=1):
    """Rows of random sequences with random mutations, some near the ends, one without any."""
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(n):
        start = "".join(rng.choice(list("acgt"), length + int(rng.integers(0, 5))))
        places = rng.permutation(len(start))[: int(rng.integers(1, many + 1)) if key else 0] + 1
        rows.append((key, start, [(int(p), str(rng.choice([b for b in "acgt" if b != start[p - 1]]))) for p in places]))
    return rows


def brute(row, features, theta):
    """(log-likelihood, events): step by step, site by site, from the generators' own numbers."""
    _, start, mutations = row
    text, gone, total, events = list(start), set(), 0.0, 0
    for pos, target in mutations:
        rates = {}
        for q in range(features.left, len(text) - features.right):
            if q + 1 in gone:
                continue
            own = [i for i in features.index(codes_of(["".join(text)]))[0, q] if i >= 0]
            if theta.shape[1] == 1:
                rates[q + 1, None] = math.exp(sum(theta[i, 0] for i in own))
            else:
                rates.update({(q + 1, b): math.exp(sum(theta[i, 0] + theta[i, 1 + k] for i in own)) for k, b in enumerate("acgt") if b != text[q]})
        if (hit := (pos, None if theta.shape[1] == 1 else target)) in rates:
            total += math.log(rates[hit] / sum(rates.values()))
            events += 1
        text[pos - 1] = target
        gone.add(pos)
    return total, events


def random_theta(features, columns, seed=3):
    return np.random.default_rng(seed).normal(0, 0.7, (features.size, columns))


@pytest.mark.parametrize("columns", [1, 5])
@pytest.mark.parametrize("name", SETS)
def test_likelihood_against_brute_force(spark, name, columns):
    rows, features = made(30), SETS[name]
    theta = random_theta(features, columns)
    found = hazards.row_likelihoods(spark.createDataFrame(rows, ROW).repartition(3), features, [theta, 0 * theta]).collect()
    want = {r[0]: brute(r, features, theta) for r in rows}
    assert {r["sk"]: r["n_steps"] for r in found} == {k: n for k, (_, n) in want.items() if n}
    assert all(abs(r["log_lik_0"] - want[r["sk"]][0]) < 1e-9 for r in found)


@pytest.mark.parametrize("columns", [1, 5])
@pytest.mark.parametrize("name", SETS)
def test_derivatives_against_differences(name, columns):
    """Gradient and second derivatives of each row, at steps of 1e-5."""
    features, rows = SETS[name], made(6, seed=4)
    theta = random_theta(features, columns)
    steps = hazards.steps_of([r[1] for r in rows], [np.array([p for p, _ in r[2]], np.int64) for r in rows], [np.array(["acgt".index(b) for _, b in r[2]], np.int64) for r in rows], features)

    def slope(x):
        return hazards.slopes(hazards.evaluate(steps, x), steps.row, len(rows), features, columns)

    own, bend, h = slope(theta), hazards.curvature(hazards.evaluate(steps, theta), features, columns), 1e-5
    for k in np.random.default_rng(0).permutation(theta.size)[:12]:
        moved = np.zeros(theta.size)
        moved[k] = h
        up, down = (theta + s * moved.reshape(theta.shape) for s in (1, -1))
        rise = [np.bincount(steps.row, hazards.evaluate(steps, x).log_lik, len(rows)) for x in (up, down)]
        assert np.abs((rise[0] - rise[1]) / (2 * h) - own[:, k]).max() < 1e-7
        assert np.abs((slope(up) - slope(down)).sum(axis=0) / (2 * h) - bend[k]).max() < 1e-7


def test_generators_number_side_by_side(spark):
    features = SETS["mixed"]
    assert features.offsets == [0, 4, 20, 22] and features.size == 22 and features.labels[4:6] == [(1, "aa"), (1, "ac")]
    less = features.without([1, 4, 21])
    assert less.offsets == [0, 3, 18, 19] and less.labels[-1] == (2, "a") and less.labels[:3] == [(0, "a"), (0, "g"), (0, "t")]
    text = "acgtacgtacgtnacgt"
    found = {(r["pos"], r["generator"]): r["feat_idx"] for r in feature_sites(spark.createDataFrame([(1, text)], "sk long, gs string"), features).collect()}
    for at in range(2, len(text) + 1):
        assert found.get((at, 0)) == ({b: i for i, b in enumerate("acgt")}.get(text[at - 1]))
        pair = text[at - 2 : at]
        assert found.get((at, 1)) == (None if "n" in pair else 4 + 4 * "acgt".index(pair[0]) + "acgt".index(pair[1]))
        if text[at - 1] != "n":
            assert found[at, 2] == 20 + (9 <= at < 18)
    assert (1, 0) not in found  # the widest window doesn't fit
    with pytest.raises(ValueError, match="site"):
        MotifFeatures(3, 3)
    with pytest.raises(ValueError, match="rise"):
        PositionFeatures([3, 1], ["a"])


@pytest.mark.parametrize("columns", [1, 5])
@pytest.mark.parametrize("name", SETS)
def test_scores_of_orders_against_brute_force(name, columns):
    """What the sampler scores is the likelihood of the order, and its places are those of whole orders."""
    features = SETS[name]
    theta = random_theta(features, columns)
    for row in made(5, many=4, seed=8)[1:]:
        inside = [(p, b) for p, b in row[2] if features.left < p <= len(row[1]) - features.right]
        score = sampling.SetScore(row[1], dict(inside), features, theta)
        for order in itertools.permutations(inside):
            assert abs(score([p for p, _ in order]) - brute((0, row[1], order), features, theta)[0]) < 1e-9
        if len(inside) > 1:
            rest = [p for p, _ in inside[1:]]
            want = [score([*rest[:k], inside[0][0], *rest[k:]]) for k in range(len(rest) + 1)]
            assert np.allclose(score.places(rest, inside[0][0]), want)


def test_sampled_orders_follow_the_likelihood(spark):
    features = SETS["motifs"]
    theta = random_theta(features, 1, seed=5) * 2
    row = (7, "acgtacgttgca", [(3, "a"), (4, "g"), (9, "c")])
    drawn = sampling.set_orders(spark.createDataFrame([row], ROW), features, theta, burn_in=20, samples=3000, seed=1)
    counts = {tuple(r[0]): r[1] / 3000 for r in drawn.groupBy(F.transform("mutations", lambda m: m["pos"]).alias("o")).count().collect()}
    logs = {tuple(p for p, _ in o): brute((0, row[1], o), features, theta)[0] for o in itertools.permutations(row[2])}
    total = sum(map(math.exp, logs.values()))
    assert all(abs(counts.get(o, 0) - math.exp(x) / total) < 0.04 for o, x in logs.items())


@pytest.fixture(scope="module")
def orders(spark):
    """Known orders, simulated with 3-mers of which a few matter."""
    theta = {m: v for m, v in zip(["aca", "tgt", "ggg"], [2.0, 1.5, -2.0], strict=True)}
    rng = np.random.default_rng(12)
    rows = []
    for key in range(250):
        start = "".join(rng.choice(list("acgt"), 40))
        rows.append((key, start, [(p, t) for _, p, t in sampling.simulate(start, theta, 3, 1, rng, share=0.15)]))
    frame = spark.createDataFrame(rows, ROW).repartition(4)
    return frame.cache()


@pytest.mark.parametrize("columns", [1, 5])
def test_two_stages_meet_their_optimality_conditions(orders, columns):
    features = FeatureSet([MotifFeatures(3, 1)]) if columns == 1 else FeatureSet([MotifFeatures(1, 0), MotifFeatures(2, 0)])
    penalties = (0.02, 0.01)
    found = models.refit_orders(orders, features, penalties, columns)
    first = models.point_at(orders, features, found.penalised)
    weights = np.tile([penalties[0]] + [penalties[1]] * (columns - 1), features.size)
    slope, theta = -first.slope / first.n, found.penalised.ravel()
    zero = np.abs(theta) < models.ZERO
    assert (np.abs(slope[zero]) <= weights[zero] + 1e-4).all()
    assert np.abs(slope[~zero] + weights[~zero] * np.sign(theta[~zero])).max() < 1e-4
    # what has no coefficient is gone, what is zero stays zero, the rest has no slope
    assert found.removed == [i for i in range(features.size) if (np.abs(found.penalised[i]) < models.ZERO).all()] and found.removed
    assert found.features.size == features.size - len(found.removed) and found.features.labels == [x for i, x in enumerate(features.labels) if i not in set(found.removed)]
    assert (found.refit[~found.active] == 0).all() and found.active.any(axis=1).all()
    again = models.point_at(orders, found.features, found.refit)
    assert np.abs(again.slope[found.active.ravel()] / again.n).max() < 1e-4
    assert again.log_lik > first.log_lik
    bounds = found.intervals()
    assert (bounds[:, 0] <= bounds[:, 1]).all() and (bounds[:, 1] <= bounds[:, 2]).all() and (bounds[found.active.ravel(), 0] < bounds[found.active.ravel(), 1]).any()
    if columns == 1:
        kept = [x for _, x in found.features.labels]
        assert {"aca", "tgt"} <= set(kept) and found.refit[kept.index("aca"), 0] > 1
        sums = found.residuals().groupBy("sk").agg(F.sum("residual").alias("s")).agg(F.max(F.abs("s"))).first()[0]
        assert sums < 1e-9


def test_penalty_that_keeps_nothing(orders):
    found = models.refit_orders(orders, SETS["motifs"], (10.0, 0.0))
    assert len(found.removed) == 64 and found.refit.shape == (0, 1) and found.intervals().shape == (0, 3)


def test_too_many_coefficients_are_refused(orders):
    with pytest.raises(ValueError, match="at most"):
        models.fit_orders(orders, FeatureSet([MotifFeatures(6, 2)]))


def test_more_samples_are_drawn_only_while_the_interval_holds_zero(spark, orders):
    features = SETS["motifs"]
    rng = np.random.default_rng(2)
    seqs = orders.limit(20)
    reference = np.zeros((64, 1))
    far = models.LikelihoodComparer(seqs, features, reference, samples=6, burn_in=2).compare(random_theta(features, 1) * 3)
    assert far.samples == 6 and not far.lower < 0 < far.upper
    comparer = models.LikelihoodComparer(seqs, features, reference, samples=6, burn_in=2)
    near = rng.normal(0, 1, (64, 1))
    near *= 1e-4 / np.abs(near).max()
    # moved along the direction that leaves the mean ratio at 0
    lift = comparer.ratios(near).mean()
    slope = comparer.ratios(near * 2).mean() - lift
    if lift * slope > 0:
        twin = rng.normal(0, 1e-4, (64, 1))
        near = near - twin * (lift / comparer.ratios(twin).mean())
    found = comparer.compare(near, rounds=3)
    assert found.samples in (12, 24) or not found.lower < 0 < found.upper
    grown = models.LikelihoodComparer(seqs, features, reference, samples=6, burn_in=2)
    grown._more()
    assert grown.samples == 12 and sorted(r[0] for r in grown.drawn.select("sample").distinct().collect()) == list(range(12))
    assert grown.drawn.groupBy("sk").count().select("count").distinct().collect()[0][0] == 12
    # no more than the bound in all
    held = models.LikelihoodComparer(seqs, features, reference, samples=6, burn_in=2, most_samples=100)
    held.ratios = lambda theta: np.array([-1.0, 1.0, 0.5, -0.5, 0.2, -0.2])
    assert held.compare(near).samples == 6
    open_end = models.LikelihoodComparer(seqs, features, reference, samples=6, burn_in=2)
    open_end.ratios = held.ratios
    assert open_end.compare(near, rounds=3).samples == 24  # three draws: 6, 12 and 24


def naive_interval(values, z, difference):
    n, mean, var = len(values), np.mean(values), np.var(values)
    if var < 1e-10:
        return 0.0, mean, mean, -1.0
    lags = [sum((values[i] - mean) * (values[i + k] - mean) for i in range(n - k)) / (n - k) / var for k in range(n)]
    below = [k for k, x in enumerate(lags) if x < 0]
    size = n / (1 + 2 * sum(lags[1 : below[0]] if len(below) > 1 else lags[1:]))
    if var / size < 0:
        return None, -np.inf, np.inf, size
    se = math.sqrt(var / size)
    return se, difference - z * se, difference + z * se, size


def test_intervals_of_correlated_draws(spark):
    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(size=60)) * 0.1 + rng.normal(size=60)
    chains = {"walk": walk, "noise": rng.normal(size=41), "same": np.full(9, 2.5), "rising": np.arange(5.0), "pair": np.array([1.0, 2.0]), "turns": np.array([1.0, -1.0] * 8)}
    for values in chains.values():
        got, want = corrected_interval(values, 1.96, 0.3), naive_interval(list(values), 1.96, 0.3)
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
    frame = spark.createDataFrame([(name, i, float(v)) for name, values in chains.items() for i, v in enumerate(values)], "name string, i int, v double").repartition(5)
    for r in chain_intervals(frame, "name", "i", "v").collect():
        want = naive_interval(list(chains[r["name"]]), 1.96, float(chains[r["name"]].mean()))
        assert r["n"] == len(chains[r["name"]]) and abs(r["ess"] - want[3]) < 1e-9 and (r["se"] is None if want[0] is None else abs(r["se"] - want[0]) < 1e-9)


def test_observed_information_three_ways(spark):
    """By Louis' sums over rows, by the relational form, and from differences of single orders' gradients."""
    features, samples = SETS["motifs"], 3
    theta = (np.arange(64) % 7 / 7.0)[:, None]
    seqs = spark.createDataFrame([r for r in made(8, many=4, seed=21)], ROW)
    drawn = sampling.set_orders(seqs, features, theta, 2, samples, 1, 3).repartition(3).cache()
    got = models.observed_information(drawn, features, theta, samples)
    rows = drawn.collect()
    own, bend = {}, np.zeros((64, 64))
    for r in rows:
        steps = hazards.steps_of([r["gs"]], [np.array([m["pos"] for m in r["mutations"]], np.int64)], [np.array(["acgt".index(m["target"]) for m in r["mutations"]], np.int64)], features)
        found = hazards.evaluate(steps, theta)
        own.setdefault(r["sk"], []).append(hazards.slopes(found, steps.row, 1, features, 1)[0])
        bend += hazards.curvature(found, features, 1)
    gradients = [g for x in own.values() for g in x]
    sums = [sum(x) for x in own.values()]
    want = (-bend - sum(np.outer(g, g) for g in gradients)) / samples - (np.outer(sum(sums), sum(sums)) - sum(np.outer(s, s) for s in sums)) / samples**2
    assert np.abs(got - want).max() < 1e-9
    coefficients = spark.createDataFrame([(x, float(t)) for (_, x), t in zip(features.labels, theta[:, 0], strict=True)], "motif string, theta double")
    named = drawn.withColumn("drawn", F.concat_ws("-", "sk", "sample"))
    counts = likelihood.risk_counts(named, 3, 1, "drawn").join(named.select("drawn", "sk"), "drawn")
    place = {x: i for i, (_, x) in enumerate(features.labels)}
    relational = np.zeros((64, 64))
    for r in likelihood.observed_information(counts, coefficients, "sk", samples, "drawn").collect():
        relational[place[r["f1"]], place[r["f2"]]] = r["value"]
    assert np.abs(relational - want).max() < 1e-8


def test_path_stops_early_and_side_by_side_is_as_one_by_one(spark, orders):
    features = SETS["motifs"]
    folded = orders.withColumn("fold", (F.col("sk") % 3).cast("int"))
    solve, score = models.orders_solver(features)
    penalties = [1e-5, 0.03, 0.5, 0.01, 0.00002, 0.00001]
    path = models.penalty_path(folded, 3, penalties, solve, score)
    tried = [s.penalty for s in path.steps]
    assert tried == sorted(penalties, reverse=True)[: len(tried)] and len(tried) < len(penalties)
    assert path.best == len(tried) - 2 and path.steps[-1].lower < 0 and path.steps[0].lower is None
    # the largest penalty keeps nothing, the best one does
    assert not np.abs(path.steps[0].thetas[0]).max() > models.ZERO and np.abs(path.steps[path.best].thetas[0]).max() > 0.5
    serial = models.penalty_path(folded, 3, penalties, solve, score, at_once=1)
    assert [s.penalty for s in serial.steps] == tried and serial.best == path.best
    for one, other in zip(path.steps, serial.steps, strict=True):
        assert np.allclose(one.thetas, other.thetas, atol=1e-7) and np.allclose(one.ratios, other.ratios, atol=1e-7)
    assert isinstance(path.same_support, bool) and path.penalty == tried[path.best]


def test_saturated_path_stops(orders):
    folded = orders.withColumn("fold", (F.col("sk") % 2).cast("int"))
    full = lambda train, penalty, start: np.full((2, 1), 1 + penalty)
    path = models.penalty_path(folded, 2, [0.1, 0.2, 0.3], full, lambda held, theta, before: 1.0)
    assert [s.penalty for s in path.steps] == [0.3] and path.best == 0


def test_fits_of_unknown_orders(spark, orders):
    """Monte-Carlo EM finds what matters without the orders, and the second stage has positive variances."""
    shuffled = orders.select("sk", "gs", F.sort_array("mutations").alias("mutations")).limit(120)
    features = SETS["motifs"]
    em = dict(samples=2, most_samples=4, burn_in=2, seed=4, tolerance=1e-3)
    first = models.fit_sampled(shuffled, features, (0.03, 0.0), iterations=3, **em)
    place = {x: i for i, (_, x) in enumerate(features.labels)}
    assert first.point.theta[place["aca"], 0] > 0.5 and first.iterations <= 3 and first.samples <= 4
    assert np.abs(first.point.theta).max() == first.point.theta[[place["aca"], place["tgt"]], 0].max()
    found = models.refit_sampled(shuffled, features, (0.03, 0.0), penalised=first.point.theta, refit_iterations=2, **em)
    assert found.refit.shape == (64 - len(found.removed), 1) and found.variance.shape == (found.active.sum(),) * 2
    assert found.residuals().count() > 0
    nothing = models.fit_sampled(shuffled, features, (50.0, 0.0), iterations=5, **em)
    assert nothing.iterations == 1 and not nothing.point.theta.any()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], ROW)
    features = SETS["motifs"]
    point = models.fit_orders(empty, features, (0.1, 0.0))
    assert point.n == 0 and not point.theta.any()
    assert hazards.site_residuals(empty, features, point.theta).count() == 0
    assert models.LikelihoodComparer(empty, features, point.theta, 2, 1).compare(point.theta).samples == 0
