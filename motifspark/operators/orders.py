"""Orders of many sequences' mutations at once: what each step is likely to be, drawn orders, and sums over all of them.

What has mutated before a step, not its order, decides the step, so a
sequence of n mutations has 2**n states.  A mutation changes the hazards of
the sites whose windows hold it and of no others: a state's hazard is that of
the untouched sites plus those of at most n windows.  Rows of equally many
mutations are worked out together; a window's hazards are read from a table of
all windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .generators import FeatureSet, codes_of

MOST_TOGETHER = 16  # mutations of a row whose states are held: 65,536 of them
MOST_WINDOWS = 1 << 20  # entries of the table of windows
MOST_CELLS = 1 << 20  # states x sites that are held at once
LEAST_STEP = 1e-16  # a step's probability from which on those of orders are summed as they are, not by their logarithms


def _mixed(x: np.ndarray) -> np.ndarray:
    """Steele's finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """Uniform numbers of each row, from a digest of its key and a counter: whatever batch a row comes in, it gets the same ones."""

    def __init__(self, seed: int, keys: Sequence):
        digests = b"".join(blake2b(f"{seed}-{k}".encode(), digest_size=8).digest() for k in keys)
        self.keys, self.used = np.frombuffer(digests, np.uint64), 0

    def of(self, rows: np.ndarray) -> Draws:
        out = object.__new__(Draws)
        out.keys, out.used = self.keys[rows], 0
        return out

    def next(self, count: int) -> np.ndarray:
        """(row, count) in [0, 1)"""
        at = np.arange(self.used + 1, self.used + count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.used += count
        return (_mixed(self.keys[:, None] + at) >> np.uint64(11)) * 2.0**-53


class Windows:
    """The hazards of a site by the bases around it, and by its place where features depend on it; twice as many entries, the latter half of sites that have mutated."""

    def __init__(self, features: FeatureSet, theta: np.ndarray, longest: int):
        left, right = features.left, features.right
        self.left, self.right, self.fixed = left, right, features.fixed
        self.wide = left + right + 1
        self.size = 5**self.wide
        digits = np.arange(self.size)[:, None] // 5 ** np.arange(self.wide - 1, -1, -1) % 5 - 1
        padded = np.vstack([theta, np.zeros((1, theta.shape[1]))])
        parts = []
        for q in range(left, longest - right) if self.fixed else (left,):
            codes = np.full((self.size, q + right + 1), -1, np.int8)
            codes[:, q - left :] = digits
            score = padded[features.index(codes)[:, q]].sum(axis=1)
            own = np.exp(score) if theta.shape[1] == 1 else np.where(np.arange(4) == digits[:, left, None], 0.0, np.exp(score[:, :1] + score[:, 1:]))
            parts.append(np.vstack([own, np.zeros_like(own)]))
        self.rates = np.concatenate(parts) if parts else np.zeros((2 * self.size, 1))
        self.total = self.rates.sum(axis=1)
        with np.errstate(divide="ignore"):
            self.logs = np.log(self.rates)
        # the least possible rate over the greatest of a site
        self.least = self.rates.min(initial=np.inf, where=self.rates > 0) / max(self.total.max(initial=0.0), 1e-300)

    @staticmethod
    def fit(features: FeatureSet, longest: int) -> bool:
        return 5 ** (features.left + features.right + 1) * (longest if features.fixed else 1) <= MOST_WINDOWS


def _keys(windows: Windows, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, site): the entry of each site in the table, and whether it is at risk."""
    left, right, width = windows.left, windows.right, codes.shape[1]
    wide = np.pad(codes.astype(np.int64) + 1, ((0, 0), (left, right)))
    key = np.zeros(codes.shape, np.int64)
    for d in range(windows.wide):
        key = key * 5 + wide[:, d : d + width]
    if windows.fixed:
        key += 2 * windows.size * np.maximum(np.arange(width) - left, 0)
    return key, (np.arange(width) >= left) & (np.arange(width) < lengths[:, None] - right)


def step_logs(windows: Windows, codes: np.ndarray, lengths: np.ndarray, places: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """(row, state, mutation): the log-probability that a mutation is next in a state, minus infinity where impossible.

    codes: (row, site) base numbers; places: (row, mutation) from 0, rising;
    targets: their base numbers.  Bit i of a state tells whether mutation i is done.
    """
    rows, n = places.shape
    left, right, size, width = windows.left, windows.right, windows.size, codes.shape[1]
    here = np.arange(rows)[:, None]
    key, valid = _keys(windows, codes, lengths)
    # the sites whose windows hold a mutation, each once
    near = np.sort((places[:, :, None] + np.arange(-right, left + 1)).reshape(rows, -1), axis=1)
    inside = (near >= 0) & (near < width)
    inside[:, 1:] &= near[:, 1:] != near[:, :-1]
    site = np.clip(near, 0, width - 1)
    inside &= valid[here, site]
    touched = np.zeros(codes.shape, bool)
    touched[np.broadcast_to(here, site.shape)[inside], site[inside]] = True
    rest = np.where(valid & ~touched, windows.total[np.where(valid, key, size)], 0.0).sum(axis=1)
    moved = targets.astype(np.int64) - codes[here, places]

    def states(sites: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """(row, state, site): entries of the table."""
        out = np.where(alive, key[here, sites], size)[:, None, :]
        for i in range(n):
            apart = places[:, i : i + 1] - sites + left  # the mutation's place in each window
            own = alive & (apart >= 0) & (apart < windows.wide)
            delta = np.where(own, moved[:, i : i + 1] * 5 ** np.clip(windows.wide - 1 - apart, 0, windows.wide - 1), 0) + np.where(own & (apart == left), size, 0)
            out = np.concatenate([out, out + delta[:, None, :]], axis=1)
        return out

    total = rest[:, None] + windows.total[states(site, inside)].sum(axis=2)
    own = states(places, valid[here, places])
    column = targets[:, None, :] if windows.rates.shape[1] > 1 else 0
    with np.errstate(divide="ignore", invalid="ignore"):
        out = windows.logs[own, column] - np.log(total)[:, :, None]
    return np.where(np.isnan(out), -np.inf, out)


def drawn(logs: np.ndarray, order: np.ndarray | None, draws: Draws, burn_in: int, samples: int, rate: int) -> np.ndarray:
    """(row, sample, place): orders as numbers of mutations, by Gibbs sampling as in sampling.gibbs(), all rows' chains side by side; order: the first ones, drawn if none."""
    rows, _, n = logs.shape
    flat, here = logs.reshape(rows, -1), np.arange(rows)[:, None]
    order = np.argsort(draws.next(n), axis=1) if order is None else order
    out, sweep, place = np.empty((rows, samples, n), np.int64), 0, np.arange(n)
    kept = 0
    while kept < samples:
        turns, chances = np.argsort(draws.next(n), axis=1), draws.next(n)
        for t in range(n):
            own = turns[:, t : t + 1]
            rest = order[order != own].reshape(rows, n - 1)
            done = np.zeros((rows, n), np.int64)
            np.cumsum(1 << rest, axis=1, out=done[:, 1:])
            before, after = np.zeros((rows, n)), np.zeros((rows, n))
            np.cumsum(flat[here, done[:, :-1] * n + rest], axis=1, out=before[:, 1:])
            within = flat[here, (done[:, :-1] | (1 << own)) * n + rest]
            after[:, :-1] = np.cumsum(within[:, ::-1], axis=1)[:, ::-1]
            score = before + flat[here, done * n + own] + after
            share = np.cumsum(np.exp(score - score.max(axis=1, keepdims=True)), axis=1)
            at = np.minimum((chances[:, t : t + 1] * share[:, -1:] >= share).sum(axis=1, keepdims=True), n - 1)
            moved = np.where(place < at, np.pad(rest, ((0, 0), (0, 1))), np.pad(rest, ((0, 0), (1, 0))))
            order = np.where(place == at, own, moved)
        sweep += 1
        if sweep > burn_in and (sweep - burn_in) % rate == 0:
            out[:, kept] = order
            kept += 1
    return out


def summed(logs: np.ndarray) -> np.ndarray:
    """(row): ln of the sum over all orders of their probabilities, state by state."""
    rows, states, n = logs.shape
    reached = np.full((rows, states), -np.inf)
    reached[:, 0] = 0.0
    state = np.arange(states)
    done = np.bitwise_count(state)
    for count in range(n):
        for i in range(n):
            at = state[(done == count) & (state >> i & 1 == 0)]
            to = at | 1 << i
            reached[:, to] = np.logaddexp(reached[:, to], reached[:, at] + logs[:, at, i])
    return reached[:, -1]


@lru_cache(64)
def _ways(n: int, apart: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each count of done mutations from 1: its states, and (state, i) the state before the i-th of their mutations and its row in the tables of sums()."""
    state, every = np.arange(1 << n), np.arange(n)
    lo, hi = np.maximum(every - apart, 0), np.minimum(every + apart + 1, n)
    first = np.cumsum(1 << hi - lo) - (1 << hi - lo)
    out = []
    for count in range(1, n + 1):
        to = state[np.bitwise_count(state) == count]
        last = np.nonzero(to[:, None] >> every & 1)[1].reshape(len(to), count)
        before = to[:, None] ^ 1 << last
        out.append((to, before, first[last] + (before >> lo[last] & (1 << (hi - lo)[last]) - 1)))
    return out


def sums(windows: Windows, codes: np.ndarray, lengths: np.ndarray, places: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """(row,): summed() of step_logs(), without their logarithms where no order is too unlikely for a number.

    As places rise, a window holds no mutations but some next to each other,
    so a site has a small table by the states of these alone.  It is counted
    with the last of them.
    """
    if windows.least < LEAST_STEP * codes.shape[1]:
        return summed(step_logs(windows, codes, lengths, places, targets))
    rows, n = places.shape
    left, right, size, width = windows.left, windows.right, windows.size, codes.shape[1]
    here, near = np.arange(rows), windows.wide - 1
    key, valid = _keys(windows, codes, lengths)
    places, moved = places.T, (targets.astype(np.int64) - codes[here[:, None], places]).T
    power = 5 ** np.arange(near, -1, -1)

    def states(site: np.ndarray, alive: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """(state of the mutations from lo to before hi, row): entries of the table at a site of each row."""
        out = np.where(alive, key[here, site], size)[None, :]
        for i in range(lo, hi):
            apart = places[i] - site + left  # the mutation's place in the window
            own = alive & (apart >= 0) & (apart <= near)
            delta = np.where(own, moved[i] * power[np.where(own, apart, 0)] + np.where(apart == left, size, 0), 0)
            out = np.concatenate([out, out + delta])
        return out

    rest = np.where(valid, key, size)
    total, tables = np.zeros((1, rows)), []
    for i in range(n):
        total = np.concatenate([total, total])
        lo = max(i - near, 0)
        by_state = total.reshape(-1, 1 << lo, rows)
        for at in places[i] + np.arange(-right, left + 1)[:, None]:
            site = np.clip(at, 0, width - 1)
            alive = (at == site) & valid[here, site]
            if i + 1 < n:
                alive &= places[i + 1] > at + right
            by_state += windows.total[states(site, alive, lo, i + 1)][:, None, :]
            rest[here[alive], site[alive]] = size
        own = states(places[i], valid[here, places[i]], lo, min(i + near + 1, n))
        tables.append(windows.rates[own, targets[:, i] if windows.rates.shape[1] > 1 else 0])
    total += windows.total[rest].sum(axis=1)
    with np.errstate(divide="ignore"):
        rates, found = np.concatenate(tables), np.ones((1, rows))
        share = np.where(total > 0, 1 / total, 0.0)  # of a rate in a state, and of it in all orders once the state's own is known
        for to, before, table in _ways(n, near):
            found = share[before[:, 0]] * rates[table[:, 0]]
            for j in range(1, before.shape[1]):
                found += share[before[:, j]] * rates[table[:, j]]
            share[to] *= found
        return np.log(found[0])


class Group(NamedTuple):
    """Rows of a batch that have equally many events, in order of place, with what their steps are likely to be."""

    rows: np.ndarray
    places: np.ndarray  # (row, event), from 1, rising
    targets: np.ndarray
    order: np.ndarray  # (row, event): the events as the row names them
    logs: np.ndarray  # what `of` gives


def groups(batch: pa.RecordBatch, features: FeatureSet, theta: np.ndarray, known: dict, events_only: bool, of: Callable = step_logs) -> Iterator[Group | np.ndarray]:
    """A batch's rows (gs, mutations) in groups; those that no group takes come as arrays of row numbers.

    events_only: mutations that are never at risk are left out; else such a row
    is in no group.  Nor are rows of more than MOST_TOGETHER events, of repeated
    places or of unknown targets.  Rows without a mutation have no events.
    of: step_logs() or sums().
    """
    texts = batch.column("gs").to_pylist()
    listed = batch.column("mutations")
    count = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = listed.flatten()
    pos = pc.fill_null(inner.field("pos"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    target = pc.fill_null(pc.index_in(inner.field("target"), value_set=pa.array(list("acgt"))), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.array([len(x or "") for x in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), count)
    event = (pos > features.left) & (pos <= lengths[row] - features.right)
    odd = np.zeros(len(texts), bool)
    if events_only:
        row, pos, target = row[event], pos[event], target[event]
    else:
        odd[row[~event]] = True
    count = np.bincount(row, minlength=len(texts))
    odd |= (count > MOST_TOGETHER) | np.array([not x or not x.isascii() for x in texts], bool)
    odd[row[target < 0]] = True
    rising = np.lexsort((pos, row))
    twice = (row[rising][1:] == row[rising][:-1]) & (pos[rising][1:] == pos[rising][:-1])
    odd[row[rising][1:][twice]] = True
    longest = int(lengths.max(initial=0))
    if not Windows.fit(features, longest):
        odd[:] = True
    elif known.get("longest", -1) < longest and (features.fixed or not known):
        known.update(longest=longest, windows=Windows(features, theta, longest))
    first = np.cumsum(count) - count
    rank = np.empty(len(rising), np.int64)  # of each event among its row's by place
    rank[rising] = np.arange(len(rising)) - first[row[rising]]
    for n in np.unique(count[~odd & (count > 0)]).tolist():
        own = np.flatnonzero(~odd & (count == n))
        step = max(MOST_CELLS // ((n * (features.left + features.right + 1)) << n), 1)
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            at = first[part][:, None] + np.arange(n)
            places, targets = pos[rising][at], target[rising][at]
            logs = of(known["windows"], codes_of([texts[i] for i in part]), lengths[part], places - 1, targets)
            yield Group(part, places, targets, rank[at], logs)
    if odd.any():
        yield np.flatnonzero(odd)


def order_rows(keys: pa.Array, group: Group, texts: pa.Array, orders: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Rows (key, sample, gs, mutations) of drawn orders."""
    rows, samples, n = orders.shape
    at = np.repeat(np.arange(rows), samples)
    chosen = orders.reshape(-1, n)
    pos = group.places[at[:, None], chosen].ravel()
    letters = pa.array(list("acgt")).take(pa.array(group.targets[at[:, None], chosen].ravel()))
    inner = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), letters], fields=list(schema.field("mutations").type.value_type))
    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pos) + 1, n), pa.int32()), inner, type=schema.field("mutations").type)
    took = pa.array(group.rows[at])
    return pa.RecordBatch.from_arrays([keys.take(took), pa.array(np.tile(np.arange(samples), rows), pa.int32()), texts.take(took), listed], schema=schema)
