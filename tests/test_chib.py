"""The marginal log-likelihood against the exact sum over all orders, at the registered count of samples."""

from __future__ import annotations

import inspect
import itertools

import numpy as np
import pytest

from motifspark.operators import sampling

THETA = {"".join(m): (i % 7) / 7.0 for i, m in enumerate(itertools.product("acgt", repeat=3))}


def case(many, spacing):
    rng = np.random.default_rng(many)
    start = "".join(rng.choice(list("acgt"), 64))
    return start, {p: "acgt"["acgt".index(start[p - 1]) - 1] for p in range(3, 3 + many * spacing, spacing)}


def exact(start, targets):
    """Brute force: the hazards of the whole text anew at each step of each order, shared by what has mutated."""

    def of(done):
        if len(done) == len(targets):
            return 1.0
        text = list(start)
        for p in done:
            text[p - 1] = targets[p]
        hazard = sampling._hazards("".join(text), THETA, 3, 1)
        hazard[[p - 1 for p in done]] = 0
        return sum(hazard[p - 1] / hazard.sum() * value(done | {p}) for p in targets if p not in done)

    held = {}

    def value(done):
        if done not in held:
            held[done] = of(done)
        return held[done]

    return float(np.log(value(frozenset())))


@pytest.mark.parametrize("many", [6, 7, 8])
@pytest.mark.parametrize("spacing", [1, 7])
def test_chib_is_near_the_sum_of_all_orders(many, spacing):
    start, targets = case(many, spacing)
    samples = inspect.signature(sampling.marginal_likelihoods).parameters["samples"].default
    found = [sampling.marginal_log_lik(start, targets, THETA, 3, 1, np.random.default_rng(seed), samples) for seed in range(6)]
    assert np.allclose(found, exact(start, targets), atol=1.5)
    assert abs(np.mean(found) - exact(start, targets)) < 0.5
    assert abs(sampling.marginal_log_lik(start, targets, THETA, 3, 1, np.random.default_rng(0), 10 * samples) - exact(start, targets)) < 0.4


def test_a_held_chain_keeps_its_order():
    start, targets = case(6, 1)
    held = [7, 3, 5]
    drawn = list(sampling.gibbs(start, targets, THETA, 3, 1, 0, 50, 1, np.random.default_rng(0), [*held, 4, 6, 8], held))
    assert all([x for x in o if x in held] == held for o in drawn)
    assert len(set(map(tuple, drawn))) > 10


def test_the_query_takes_the_default_count(monkeypatch):
    from motifspark.plans import model_queries

    taken = {}
    for name in ("seqs", "theta"):
        monkeypatch.setattr(model_queries, name, lambda *a: None)
    monkeypatch.setattr(model_queries.sampling, "marginal_likelihoods", lambda *a, **k: taken.update(k))
    model_queries.g3(None, None)
    assert not taken
