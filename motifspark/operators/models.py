"""Fits over feature sets: penalised and unpenalised, of known and of sampled orders, over penalties and folds.

The data stay in Spark: each evaluation is one pass over the orders, of which
a log-likelihood, a gradient and second derivatives reach the driver, numbers
by coefficients.  Coefficients are few (a 5-mer model with its targets has
some 5,000; second derivatives of up to MOST_SECOND are asked for).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hazards
from .fitting import kept
from .generators import FeatureSet
from .sampling import set_orders
from .statistics import corrected_interval

ZERO = 1e-6  # coefficients below count as zero
MOST_SECOND = 3000  # coefficients whose second derivatives are held on the driver: 72 MB


@dataclass
class Point:
    """The likelihood of n rows at some theta."""

    theta: np.ndarray
    n: int
    log_lik: float
    slope: np.ndarray
    bend: np.ndarray | None


def point_at(orders: DataFrame, features: FeatureSet, theta: np.ndarray, second: bool = False) -> Point:
    """Evaluates all rows in one pass."""
    size = theta.size
    rows = hazards.sums(orders, features, theta, second).toArrow()
    i, j, value = (rows.column(x).to_numpy() for x in ("i", "j", "value"))
    total = {int(k): float(v) for k, v in zip(j[i < 0], value[i < 0], strict=True)}
    slope, bend = np.zeros(size), np.zeros((size, size)) if second else None
    first = (i >= 0) & (j < 0)
    slope[i[first]] = value[first]
    if second:
        inner = (i >= 0) & (j >= 0)
        bend[i[inner], j[inner]] = value[inner]
    return Point(theta, int(total.get(1, 0)), total.get(0, 0.0), slope, bend)


def _objective(point: Point, weights: np.ndarray) -> float:
    return -point.log_lik / max(point.n, 1) + float(weights @ np.abs(point.theta.ravel()))


def violation(point: Point, weights: np.ndarray, active: np.ndarray) -> np.ndarray:
    """How far each active coefficient is from the optimality condition of the penalised mean: 0 lies in the slope plus the penalty's subgradient."""
    slope, theta = -point.slope / max(point.n, 1), point.theta.ravel()
    out = np.where(np.abs(theta) > 0, np.abs(slope + weights * np.sign(theta)), np.maximum(np.abs(slope) - weights, 0))
    return np.where(active, out, 0)


def _quadratic(slope: np.ndarray, bend: np.ndarray, theta: np.ndarray, weights: np.ndarray, active: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """The step that minimises the quadratic model plus the penalty, by coordinates."""
    if not weights.any():
        step = np.zeros(len(theta))
        inside = np.flatnonzero(active)
        step[inside] = np.linalg.lstsq(bend[np.ix_(inside, inside)], -slope[inside], rcond=1e-10)[0]
        return step
    step, pull = np.zeros(len(theta)), slope.copy()
    places = np.flatnonzero(active & (np.diag(bend) > 1e-12))
    for _ in range(sweeps):
        most = 0.0
        for k in places:
            curve = bend[k, k]
            at = theta[k] + step[k] - pull[k] / curve
            new = np.sign(at) * max(abs(at) - weights[k] / curve, 0) - theta[k]
            if (moved := new - step[k]) != 0:
                pull += bend[k] * moved
                step[k] = new
                most = max(most, abs(moved))
        if most < 1e-9:
            break
    return step


def fit_orders(orders: DataFrame, features: FeatureSet, penalties: tuple[float, float] = (0.0, 0.0), start: np.ndarray | None = None, columns: int = 1, active: np.ndarray | None = None, tolerance: float = 1e-5, rounds: int = 50) -> Point:
    """theta that minimises the mean negative log-likelihood of known orders plus the penalties of shared and of target coefficients.

    Newton steps, each one pass with second derivatives, halved until the
    objective falls; ends when no active coefficient violates its optimality
    condition by more than the tolerance.  Coefficients outside `active` keep
    their start, 0 by default.
    """
    if features.size * columns > MOST_SECOND:
        raise ValueError(f"{features.size * columns} coefficients; at most {MOST_SECOND} are fitted at once")
    theta = np.zeros((features.size, columns)) if start is None else start.astype(float).copy()
    weights = np.tile([penalties[0]] + [penalties[1]] * (columns - 1), features.size).astype(float)
    active = np.ones(theta.size, bool) if active is None else active.ravel()
    now = point_at(orders, features, theta, True)
    for _ in range(rounds):
        if not now.n or violation(now, weights, active).max(initial=0) <= tolerance:
            break
        slope, bend = -now.slope / now.n, -now.bend / now.n + 1e-9 * np.eye(theta.size)
        step = _quadratic(slope, bend, now.theta.ravel(), weights, active)
        value, length = _objective(now, weights), 1.0
        fall = slope @ step + weights @ (np.abs(now.theta.ravel() + step) - np.abs(now.theta.ravel()))
        while length > 1e-6:
            new = point_at(orders, features, (now.theta.ravel() + length * step).reshape(theta.shape), True)
            if _objective(new, weights) <= value + 1e-4 * length * fall + 1e-13:
                break
            length /= 2
        else:
            break
        now = new
    return now


@dataclass
class Comparison:
    """A mean log-likelihood ratio with its interval; `size` is the effective number of samples, -1 of constant ratios."""

    mean: float
    lower: float
    upper: float
    size: float
    samples: int


class LikelihoodComparer:
    """Compares coefficients with reference ones, over orders that are sampled under the reference.

    The mean of log-likelihood ratios of the sampled orders bounds the ratio
    of the marginal likelihoods from below.  While its interval holds 0, as
    many samples again are drawn, each chain going on where it stopped.
    """

    def __init__(self, seqs: DataFrame, features: FeatureSet, reference: np.ndarray, samples: int = 10, burn_in: int = 10, seed: int = 0, key: str = "sk", most_samples: int = 50_000):
        self.features, self.reference, self.key, self.seed, self.most = features, reference, key, seed, most_samples
        self.burst, self.samples, self.draws = samples, samples, 1
        self.drawn = kept(set_orders(seqs, features, reference, burn_in, samples, 1, seed, key), "compared")
        self.sequences = self.drawn.filter("sample = 0").count()

    def _more(self) -> None:
        last = self.drawn.filter(F.col("sample") == self.samples - 1).select(self.key, "gs", "mutations")
        added = set_orders(last, self.features, self.reference, 0, self.samples, 1, self.seed + self.draws, self.key, resume=True)
        added = kept(added.withColumn("sample", F.col("sample") + self.samples), "compared")
        self.drawn, self.samples, self.draws = self.drawn.unionByName(added), 2 * self.samples, self.draws + 1

    def ratios(self, theta: np.ndarray) -> np.ndarray:
        """For each sample number, the mean over sequences of the log-likelihood ratio of their orders."""
        found = hazards.row_likelihoods(self.drawn, self.features, [theta, self.reference], "sample")
        rows = found.groupBy("sample").agg(F.sum(F.col("log_lik_0") - F.col("log_lik_1")).alias("v")).orderBy("sample").collect()
        return np.array([r["v"] for r in rows]) / max(self.sequences, 1)

    def compare(self, theta: np.ndarray, z: float = 1.96, rounds: int = 3) -> Comparison:
        """rounds: at most so many draws, the first included, and no more than most_samples orders in all."""
        for turn in range(1, rounds + 1):
            values = self.ratios(theta)
            if not len(values):
                return Comparison(0.0, 0.0, 0.0, 0.0, 0)
            mean = float(values.mean())
            _, lower, upper, size = corrected_interval(values, z, mean)
            if not lower < 0 < upper or turn == rounds or self.samples * 2 * self.sequences > self.most:
                break
            self._more()
        return Comparison(mean, lower, upper, size, self.samples)


@dataclass
class Fitted:
    """What a fit of sampled orders gives."""

    point: Point
    drawn: DataFrame
    samples: int
    lower: float  # bound of the last iteration's gain
    iterations: int
    gains: list[float] = field(default_factory=list)


def fit_sampled(seqs: DataFrame, features: FeatureSet, penalties: tuple[float, float] = (0.0, 0.0), start: np.ndarray | None = None, columns: int = 1, active: np.ndarray | None = None, iterations: int = 20, samples: int = 10, most_samples: int = 40, burn_in: int = 10, seed: int = 0, key: str = "sk", least_gain: float = 1e-3, tolerance: float = 1e-4) -> Fitted:
    """Monte-Carlo EM: orders sampled under theta, then a fit to them, in turns.

    Within a turn, samples are added until the lower bound of the penalised
    gain, widened by the autocorrelation of the samples, is positive or each
    sequence has most_samples.  Ends when that bound is negative or below
    least_gain, when all coefficients are zero, or after `iterations` turns.
    """
    theta = np.zeros((features.size, columns)) if start is None else start
    weights = np.tile([penalties[0]] + [penalties[1]] * (columns - 1), features.size).astype(float)
    gains: list[float] = []
    for turn in range(iterations):
        comparer = LikelihoodComparer(seqs, features, theta, samples, burn_in, seed + 1000 * turn, key)
        while True:
            point = fit_orders(comparer.drawn, features, penalties, theta, columns, active, tolerance)
            values = comparer.ratios(point.theta)
            gain = float(values.mean() if len(values) else 0) - float(weights @ (np.abs(point.theta) - np.abs(theta)).ravel())
            lower = corrected_interval(values, 1.96, gain)[1] if len(values) else 0.0
            if lower >= 0 or comparer.samples >= most_samples or not np.abs(point.theta).max(initial=0) > ZERO:
                break
            comparer._more()
        theta = point.theta
        gains.append(gain)
        if lower < least_gain or not np.abs(theta).max(initial=0) > ZERO:
            break
    return Fitted(point, comparer.drawn, comparer.samples, lower, len(gains), gains)


@dataclass
class TwoStage:
    """A penalised fit and the unpenalised one of what it keeps."""

    penalised: np.ndarray
    removed: list[int]  # features without a coefficient
    features: FeatureSet  # the others
    active: np.ndarray  # which of their coefficients are fitted
    refit: np.ndarray
    point: Point
    variance: np.ndarray  # of the active coefficients, by rows of refit
    drawn: DataFrame  # the orders of the last fit

    def intervals(self, z: float = 1.96) -> np.ndarray:
        """(lower, value, upper) of each coefficient of refit, in its order; no width where a variance is negative or the coefficient isn't fitted."""
        spread = np.zeros(self.refit.size)
        spread[self.active.ravel()] = np.sqrt(np.maximum(np.diag(self.variance), 0))
        value = self.refit.ravel()
        return np.stack([value - z * spread, value, value + z * spread], axis=1)

    def residuals(self, key: str = "sk") -> DataFrame:
        """(key, site, residual): the mean over a sequence's orders."""
        found = hazards.site_residuals(self.drawn, self.features, self.refit, key)
        return found.groupBy(key, "site").agg(F.avg("residual").alias("residual"))


def truncate(theta: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(features that have no coefficient, which coefficients of the others aren't zero)."""
    zero = (np.abs(theta) < ZERO) | ~np.isfinite(theta)
    gone = zero.all(axis=1)
    return np.flatnonzero(gone).tolist(), ~zero[~gone]


def observed_information(drawn: DataFrame, features: FeatureSet, theta: np.ndarray, samples: int, key: str = "sk") -> np.ndarray:
    """By Louis' method, from `samples` orders of each sequence."""
    rows = hazards.louis_sums(drawn, features, theta, samples, key).toArrow()
    i, j, value = (rows.column(x).to_numpy() for x in ("i", "j", "value"))
    whole, total = np.zeros(theta.size), np.zeros((theta.size, theta.size))
    whole[i[j < 0]] = value[j < 0]
    total[i[j >= 0], j[j >= 0]] = value[j >= 0]
    return total - np.outer(whole, whole) / samples**2


def _two_stage(penalised: np.ndarray, features: FeatureSet, fit: Callable[[FeatureSet, np.ndarray, np.ndarray], tuple[Point, DataFrame, np.ndarray]]) -> TwoStage:
    removed, active = truncate(penalised)
    rest = features.without(removed)
    gone = set(removed)
    start = np.where(active, penalised[[i for i in range(len(penalised)) if i not in gone]], 0)
    point, drawn, information = fit(rest, start, active)
    inside = np.flatnonzero(active.ravel())
    variance = np.linalg.pinv(information[np.ix_(inside, inside)], hermitian=True)
    return TwoStage(penalised, removed, rest, active, point.theta, point, variance, drawn)


def refit_orders(orders: DataFrame, features: FeatureSet, penalties: tuple[float, float], columns: int = 1, tolerance: float = 1e-6, start: np.ndarray | None = None) -> TwoStage:
    """Known orders: a penalised fit; features without a coefficient go; the others are fitted again without penalty."""
    first = fit_orders(orders, features, penalties, start, columns)

    def again(rest: FeatureSet, theta: np.ndarray, active: np.ndarray):
        point = fit_orders(orders, rest, start=theta, columns=columns, active=active, tolerance=tolerance)
        return point, orders, -point.bend

    return _two_stage(first.theta, features, again)


def refit_sampled(seqs: DataFrame, features: FeatureSet, penalties: tuple[float, float], columns: int = 1, key: str = "sk", penalised: np.ndarray | None = None, iterations: int = 20, refit_iterations: int = 80, **em) -> TwoStage:
    """The same of sequences whose orders are unknown: both fits by Monte-Carlo EM, the information by Louis' method."""
    if penalised is None:
        penalised = fit_sampled(seqs, features, penalties, columns=columns, key=key, iterations=iterations, **em).point.theta

    def again(rest: FeatureSet, theta: np.ndarray, active: np.ndarray):
        found = fit_sampled(seqs, rest, start=theta, columns=columns, active=active, key=key, iterations=refit_iterations, **em)
        return found.point, found.drawn, observed_information(found.drawn, rest, found.point.theta, found.samples, key)

    return _two_stage(penalised, features, again)


@dataclass
class PathStep:
    """One penalty of a path: the fit of each fold, and how each compares with the penalty before on the fold's held-out sequences."""

    penalty: float
    thetas: list[np.ndarray]
    ratios: list[float]
    lower: float | None  # their mean less one standard error; None of the first


@dataclass
class Path:
    steps: list[PathStep]
    best: int

    @property
    def penalty(self) -> float:
        return self.steps[self.best].penalty

    @property
    def same_support(self) -> bool:
        """Whether the best penalty's fits of all folds have the same nonzero coefficients."""
        nonzero = [np.abs(t) > ZERO for t in self.steps[self.best].thetas]
        return all(np.array_equal(nonzero[0], x) for x in nonzero[1:])


#: (training rows, penalty, start) -> theta
Solver = Callable[[DataFrame, float, np.ndarray | None], np.ndarray]
#: (held-out rows, theta, theta before) -> mean log-likelihood ratio
Scorer = Callable[[DataFrame, np.ndarray, np.ndarray], float]


def penalty_path(folded: DataFrame, folds: int, penalties: Sequence[float], solve: Solver, score: Scorer, at_once: int = 8) -> Path:
    """From the largest penalty to the smallest, until the held-out likelihood falls.

    folded has a column `fold`; each fold is held out once.  The folds of a
    penalty are fitted as concurrent Spark jobs, `at_once` at most, each from
    its own fit of the penalty before.  Stops when the mean ratio less one
    standard error is negative, or when no coefficient is zero any more.
    """
    steps: list[PathStep] = []
    best = 0
    held = kept(folded, "folds")

    def one(fold: int, penalty: float, before: np.ndarray | None) -> tuple[np.ndarray, float | None]:
        theta = solve(held.filter(F.col("fold") != fold), penalty, before)
        return theta, None if before is None else score(held.filter(F.col("fold") == fold), theta, before)

    with ThreadPoolExecutor(max(min(folds, at_once), 1)) as pool:
        for turn, penalty in enumerate(sorted(penalties, reverse=True)):
            before = steps[-1].thetas if steps else [None] * folds
            found = list(pool.map(one, range(folds), [penalty] * folds, before))
            thetas, ratios = [t for t, _ in found], [r for _, r in found if r is not None]
            error = float(np.std(ratios) / np.sqrt(len(ratios))) if ratios else 0.0
            lower = float(np.mean(ratios)) - error if ratios else None
            steps.append(PathStep(penalty, thetas, ratios, lower))
            nonzero = [np.count_nonzero(np.abs(t) > ZERO) for t in thetas]
            if any(nonzero) and turn and lower < -ZERO:
                break
            best = turn
            if min(nonzero) == thetas[0].size:
                break
    return Path(steps, best)


def orders_solver(features: FeatureSet, columns: int = 1) -> tuple[Solver, Scorer]:
    """Of known orders."""

    def solve(train, penalty, start):
        return fit_orders(train, features, (penalty, penalty if columns > 1 else 0.0), start, columns).theta

    def score(held, theta, before):
        found = hazards.row_likelihoods(held, features, [theta, before])
        return found.agg(F.avg(F.col("log_lik_0") - F.col("log_lik_1"))).first()[0] or 0.0

    return solve, score


def sampled_solver(features: FeatureSet, columns: int = 1, key: str = "sk", samples: int = 10, burn_in: int = 10, seed: int = 0, **em) -> tuple[Solver, Scorer]:
    """Of unknown orders: Monte-Carlo EM, and a comparer over held-out sequences."""

    def solve(train, penalty, start):
        return fit_sampled(train, features, (penalty, penalty if columns > 1 else 0.0), start, columns, key=key, samples=samples, burn_in=burn_in, seed=seed, **em).point.theta

    def score(held, theta, before):
        return LikelihoodComparer(held, features, before, samples, burn_in, seed, key).compare(theta).mean

    return solve, score
