"""Proximal operators, among them the fused lasso's on a graph of motifs, and a fit that takes any of them.

A penalty is a pair of callables on a vector of coefficients: its value, and
its proximal operator with a step.  Fits evaluate the likelihood in Spark, a
pass for each trial; vectors of the size of theta are on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .fitting import soft
from .generators import FeatureSet, MotifFeatures
from .models import Point, point_at


class Penalty(NamedTuple):
    """value(theta), and prox(v, step): the x that minimises |x - v|**2 / 2 + step * value(x)."""

    value: Callable[[np.ndarray], float]
    prox: Callable[[np.ndarray, float], np.ndarray]


def lasso(weight: float) -> Penalty:
    return Penalty(lambda x: weight * float(np.abs(x).sum()), lambda v, step: soft(v, step * weight))


def motif_edges(features: FeatureSet) -> np.ndarray:
    """(i, j) of each generator's motifs that differ in one base, i below j; reduced generators and positions have none."""
    out = [np.zeros((0, 2), np.int64)]
    for g, offset in zip(features.generators, features.offsets, strict=False):
        if isinstance(g, MotifFeatures):
            number = np.arange(g.size)
            for place in 4 ** np.arange(g.k):
                digit = number // place % 4
                for more in (1, 2, 3):
                    below = number[digit + more < 4]
                    out.append(np.stack([below, below + more * place], axis=1) + offset)
    return np.concatenate(out)


def fused_prox(v: np.ndarray, edges: np.ndarray, weight: float, tolerance: float = 1e-10, rounds: int = 20_000) -> np.ndarray:
    """The x that minimises |x - v|**2 / 2 + weight * the sum of |x_i - x_j| over edges.

    By its dual, one bounded number for each edge: accelerated projected
    gradients with restarts, until the duality gap is below the tolerance.
    """
    if not len(edges) or weight <= 0:
        return v.copy()
    one, other = edges.T
    step = 1 / (2 * np.bincount(edges.ravel(), minlength=len(v)).max())

    def inner(u):  # v less what the edges pull
        return v - np.bincount(one, u, len(v)) + np.bincount(other, u, len(v))

    u = y = np.zeros(len(edges))
    pace = 1.0
    for turn in range(rounds):
        x = inner(y)
        new = np.clip(y + step * (x[one] - x[other]), -weight, weight)
        if (y - new) @ (new - u) > 0:
            pace = 1.0  # momentum points away: begin again
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        y, u, pace = new + (pace - 1) / next_pace * (new - u), new, next_pace
        if turn % 10 == 9:
            x = inner(u)
            apart = x[one] - x[other]
            if weight * np.abs(apart).sum() - u @ apart <= tolerance * max(1.0, float(v @ v)):
                break
    return inner(u)


def fused_lasso(edges: np.ndarray, sparse: float, fused: float) -> Penalty:
    """sparse * sum of |x_i| plus fused * sum of |x_i - x_j| over edges; its operator is that of the differences, then soft thresholding."""

    def value(x: np.ndarray) -> float:
        return sparse * float(np.abs(x).sum()) + fused * float(np.abs(x[edges[:, 0]] - x[edges[:, 1]]).sum())

    return Penalty(value, lambda v, step: soft(fused_prox(v, edges, step * fused), step * sparse))


def fit_proximal(orders: DataFrame, features: FeatureSet, penalty: Penalty, start: np.ndarray | None = None, rounds: int = 100, step: float = 8.0, tolerance: float = 1e-7) -> tuple[Point, list[float]]:
    """theta of known orders under any penalty: (the point, the objective after each round), which never rises.

    Proximal gradient steps, halved until the quadratic bound holds; ends when
    the step moves less than the tolerance, by its length.
    """
    theta = np.zeros(features.size) if start is None else start.ravel().astype(float)
    now = point_at(orders, features, theta[:, None])
    mean = lambda p: -p.log_lik / max(p.n, 1)
    values = [mean(now) + penalty.value(theta)]
    for _ in range(rounds):
        if not now.n:
            break
        slope = -now.slope / now.n
        while step > 1e-8:
            new_theta = penalty.prox(theta - step * slope, step)
            moved = new_theta - theta
            new = point_at(orders, features, new_theta[:, None])
            if mean(new) <= mean(now) + slope @ moved + moved @ moved / (2 * step) + 1e-12:
                break
            step /= 2
        else:
            break
        small = np.abs(moved).max(initial=0) / step <= tolerance
        if (value := mean(new) + penalty.value(new_theta)) > values[-1] + 1e-12:
            break
        theta, now = new_theta, new
        values.append(value)
        if small:
            break
        step *= 1.5
    return now, values
