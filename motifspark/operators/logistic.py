"""Logistic models of sites: whether a site mutates, and to which base, with a lasso whose penalty is chosen by folds.

A site mutates with the probability 1 / (1 + exp(-x)), x the sum of its
features' shared coefficients and an intercept for each of them; where it
does, its target has a share in proportion to exp(-x_t), x_t the sum of its
features' coefficients of that target.  The likelihood depends on how often
each combination of features occurs with each outcome, so Spark counts these
once; combinations are as many as windows (4**k), not as sites.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import soft
from .generators import FeatureSet, codes_of

MOST_COMBINATIONS = 1_000_000  # rows of counts that the driver takes


def _distinct_rows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, in order, and how often each occurs; rows are sorted as one number each where they fit into it."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    low = keys.min(axis=0)
    spans = [int(x) for x in keys.max(axis=0) - low + 1]
    if math.prod(spans) >= 1 << 62:
        return np.unique(keys, axis=0, return_counts=True)
    kept, n = np.unique(np.ravel_multi_index(tuple((keys - low).T), spans), return_counts=True)
    return np.column_stack(np.unravel_index(kept, spans)) + low, n


def outcome_counts(seqs: DataFrame, features: FeatureSet, fold: str | None = None) -> DataFrame:
    """(fold, features, own, target, n): how many sites have these features, this base and this outcome (-1: not mutated); rows (gs, mutations).

    Sites count where all windows lie inside the sequence. Counted before the shuffle.
    """
    schema = "fold int, features array<int>, own int, target int, n long"

    def work(stream):
        for batch in stream:
            texts, listed, folds = batch.column("gs").to_pylist(), batch.column("mutations"), np.array(batch.column("fold").to_pylist(), np.int64)
            owner, flat = pc.list_parent_indices(listed).to_numpy(), pc.list_flatten(listed)
            at, base = flat.field("pos").to_numpy(zero_copy_only=False) - 1, pc.index_in(flat.field("target"), pa.array(list("acgt")))
            if base.null_count:
                raise ValueError("a mutation's target is none of acgt")
            base = base.to_numpy()
            for lo in range(0, len(texts), 2048):
                part = [x or "" for x in texts[lo : lo + 2048]]
                codes = codes_of(part)
                target = np.full(codes.shape, -1, np.int64)
                own = slice(*np.searchsorted(owner, [lo, lo + 2048]))
                target[owner[own] - lo, at[own]] = base[own]
                place = np.arange(codes.shape[1])
                inside = (place >= features.left) & (place < np.array([len(x) for x in part])[:, None] - features.right) & (codes >= 0)
                row, site = np.nonzero(inside)
                keys = np.column_stack([folds[lo + row], codes[row, site], target[row, site], features.index(codes)[row, site]])
                kept, n = _distinct_rows(keys)
                yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0], pa.int32()), pa.array(kept[:, 3:].tolist(), pa.list_(pa.int32())), pa.array(kept[:, 1], pa.int32()), pa.array(kept[:, 2], pa.int32()), pa.array(n)], names=["fold", "features", "own", "target", "n"])

    number = F.col(fold).cast("int") if fold else F.lit(0)
    return seqs.select("gs", "mutations", number.alias("fold")).mapInArrow(work, schema).groupBy("fold", "features", "own", "target").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Counts on the driver, combination by combination."""

    features: np.ndarray  # (combination, generator), -1 for none
    own: np.ndarray
    target: np.ndarray
    n: np.ndarray
    fold: np.ndarray

    def of(self, chosen: np.ndarray) -> Counts:
        return Counts(self.features[chosen], self.own[chosen], self.target[chosen], self.n[chosen], self.fold[chosen])


def collected(counts: DataFrame, parts: int) -> Counts:
    """parts: how many generators the features have. Refuses more than MOST_COMBINATIONS rows."""
    rows = counts.limit(MOST_COMBINATIONS + 1).toArrow()
    if rows.num_rows > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations")
    column = lambda name: rows.column(name).to_numpy()
    found = np.array(rows.column("features").to_pylist(), np.int64).reshape(-1, parts)
    order = np.lexsort((*found.T, column("target"), column("own"), column("fold")))
    return Counts(found[order], column("own")[order], column("target")[order], column("n")[order].astype(float), column("fold")[order])


@dataclass
class LogisticModel:
    """theta: a row for each feature, one column or five; the intercept belongs to every feature's shared coefficient."""

    theta: np.ndarray
    intercept: float

    def _sums(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        padded = np.vstack([self.theta, np.zeros((1, self.theta.shape[1]))])
        return padded[counts.features].sum(axis=1), (counts.features >= 0).sum(axis=1)

    def log_likelihoods(self, counts: Counts) -> np.ndarray:
        """Of one site of each combination."""
        sums, parts = self._sums(counts)
        x = sums[:, 0] + self.intercept * parts
        mutated = counts.target >= 0
        out = -np.logaddexp(0, np.where(mutated, -x, x))
        if self.theta.shape[1] > 1:
            score = np.where(np.arange(4) == counts.own[:, None], -np.inf, -sums[:, 1:])
            top = score.max(axis=1)
            share = score[np.arange(len(x)), np.maximum(counts.target, 0)] - top - np.log(np.exp(score - top[:, None]).sum(axis=1))
            out = out + np.where(mutated, share, 0)
        return out

    def log_likelihood(self, counts: Counts) -> float:
        return float(self.log_likelihoods(counts) @ counts.n)

    def gradient(self, counts: Counts) -> tuple[np.ndarray, float]:
        """Of the log-likelihood, by theta and by the intercept."""
        sums, parts = self._sums(counts)
        mutated = counts.target >= 0
        pull = np.zeros((len(sums), self.theta.shape[1]))
        with np.errstate(over="ignore"):
            pull[:, 0] = mutated - 1 / (1 + np.exp(-(sums[:, 0] + self.intercept * parts)))
        if self.theta.shape[1] > 1:
            score = np.where(np.arange(4) == counts.own[:, None], -np.inf, -sums[:, 1:])
            share = np.exp(score - score.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            pull[:, 1:] = (share - (np.arange(4) == counts.target[:, None])) * mutated[:, None]
        pull *= counts.n[:, None]
        slope = np.zeros((self.theta.shape[0] + 1, self.theta.shape[1]))
        for part in counts.features.T:
            np.add.at(slope, part, pull)
        return slope[:-1], float(pull[:, 0] @ parts)


def fit_logistic_model(counts: Counts, size: int, penalty: float, columns: int = 1, start: LogisticModel | None = None, tolerance: float = 1e-6, rounds: int = 20_000) -> LogisticModel:
    """Maximises the log-likelihood less penalty * sum of |theta|; the intercept is free.

    Accelerated proximal gradients with restarts, until no coefficient misses
    its optimality condition by more than tolerance * (number of sites).
    """
    model = start or LogisticModel(np.zeros((size, columns)), 0.0)
    total = max(counts.n.sum(), 1.0)
    flat = lambda m: np.append(m.theta.ravel(), m.intercept)
    made = lambda x: LogisticModel(x[:-1].reshape(size, columns), float(x[-1]))
    weights = np.append(np.full(size * columns, penalty), 0.0) / total
    loss = lambda m: -m.log_likelihood(counts) / total

    def slope_of(m: LogisticModel) -> np.ndarray:
        slope, free = m.gradient(counts)
        return -np.append(slope.ravel(), free) / total

    x = y = flat(model)
    pace, step = 1.0, 4.0
    for _ in range(rounds):
        at = made(y)
        slope, here = slope_of(at), loss(at)
        while True:
            new = soft(y - step * slope, step * weights)
            moved = new - y
            if loss(made(new)) <= here + slope @ moved + moved @ moved / (2 * step) + 1e-15 or step < 1e-10:
                break
            step /= 2
        if (y - new) @ (new - x) > 0:
            pace = 1.0
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        y, x, pace = new + (pace - 1) / next_pace * (new - x), new, next_pace
        own = slope_of(made(x))
        miss = np.where(np.abs(x) > 0, np.abs(own + weights * np.sign(x)), np.maximum(np.abs(own) - weights, 0))
        if miss.max() <= tolerance:
            break
        step *= 1.1
    return made(x)


def best_penalty(counts: Counts, size: int, penalties: Sequence[float], columns: int = 1) -> tuple[float, list[tuple[float, float]]]:
    """(the best penalty, (penalty, score) of each): the greatest log-likelihood of folds that a fit of the other folds gives, summed over folds; ties to the larger penalty."""
    scores = []
    folds = np.unique(counts.fold)
    starts: dict[int, LogisticModel] = {}
    for penalty in sorted(penalties, reverse=True):
        value = 0.0
        for fold in folds:
            held = counts.fold == fold
            starts[fold] = fit_logistic_model(counts.of(~held), size, penalty, columns, starts.get(fold))
            value += starts[fold].log_likelihood(counts.of(held))
        scores.append((penalty, value))
    return max(scores, key=lambda x: x[1])[0], scores
