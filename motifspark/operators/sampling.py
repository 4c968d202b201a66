"""Samplers and simulators of mutation orders.

Each sequence is one row, and a task draws for its rows one after another
(mapInArrow), so work spreads over partitions however large a family is.
Random numbers are seeded by the row's key, so results don't depend on how
rows are dealt out, nor on tasks that run again.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import orders
from .generators import FeatureSet, MotifFeatures, codes_of

Theta = Mapping[str, float]


def theta_dict(theta: DataFrame) -> dict[str, float]:
    """Coefficients on the driver: 4**k rows at most."""
    return {r[0]: r[1] for r in theta.select("motif", "theta").toLocalIterator()}


def _spread(frame: DataFrame, key: str) -> DataFrame:
    """Deals rows out by their key: the work in a row is far larger than the row."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _rng(seed: int, key) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def _hazards(text: str, theta: Theta, k: int, left: int) -> np.ndarray:
    """The hazard of each site, 0 where it has no full motif."""
    out = np.zeros(len(text))
    for p in range(left, len(text) - (k - 1 - left)):
        out[p] = math.exp(theta.get(text[p - left : p - left + k], 0.0))
    return out


class OrderScore:
    """The log-likelihood of orders of one sequence's mutations; what has mutated before a step, not its order, decides the step."""

    def __init__(self, start: str, targets: Mapping[int, str], theta: Theta, k: int, left: int):
        self.start, self.targets, self.theta, self.k, self.left = start, targets, theta, k, left
        self.bit = {pos: 1 << i for i, pos in enumerate(sorted(targets))}
        self.base = _hazards(start, theta, k, left).tolist()
        self.steps: dict[int, dict[int, float]] = {}

    def step(self, done: int, pos: int) -> float:
        """The log-probability that `pos` mutates next after the positions whose bits are in `done`; minus infinity where impossible."""
        if (found := self.steps.get(done)) is None:
            if len(self.steps) >= 1 << 16:
                self.steps.clear()
            found = self.steps[done] = self._after(done)
        return found[pos]

    def _after(self, done: int) -> dict[int, float]:
        k, left = self.k, self.left
        text, hazard, changed = list(self.start), self.base.copy(), [p - 1 for p, b in self.bit.items() if done & b]
        for at in changed:
            text[at] = self.targets[at + 1]
        for at in changed:
            for q in range(max(left, at - (k - 1 - left)), min(len(text) - (k - 1 - left), at + left + 1)):
                hazard[q] = math.exp(self.theta.get("".join(text[q - left : q - left + k]), 0.0))
        for at in changed:
            hazard[at] = 0.0
        total = sum(hazard)
        return {p: math.log(hazard[p - 1] / total) if hazard[p - 1] > 0 else -math.inf for p, b in self.bit.items() if not done & b}

    def __call__(self, order: Sequence[int]) -> float:
        """order: positions from 1, of all or some mutations. Minus infinity where a step is impossible."""
        done, out = 0, 0.0
        for pos in order:
            out += self.step(done, pos)
            done |= self.bit[pos]
        return out

    def places(self, rest: Sequence[int], pos: int) -> np.ndarray:
        """The log-likelihood of `rest` with `pos` put in at each place."""
        own, done, before, without, within = self.bit[pos], 0, [0.0], [], []
        for x in rest:
            before.append(before[-1] + self.step(done, x))
            without.append(self.step(done, pos))
            within.append(self.step(done | own, x))
            done |= self.bit[x]
        without.append(self.step(done, pos))
        after = [0.0]
        for x in reversed(within):
            after.append(after[-1] + x)
        return np.array([a + b + c for a, b, c in zip(before, without, reversed(after), strict=True)])


class SetScore(OrderScore):
    """The same under a feature set's coefficients; hazards are remembered by the bases around a site."""

    def __init__(self, start: str, targets: Mapping[int, str], features: FeatureSet, theta: np.ndarray, known: dict | None = None):
        self.start, self.targets, self.features, self.coefficients = start, targets, features, theta
        self.bit = {pos: 1 << i for i, pos in enumerate(sorted(targets))}
        self.steps: dict[int, dict[int, float]] = {}
        self.known = {} if known is None else known
        self.base = [self._rates(start, q) for q in range(len(start))]

    def _rates(self, text: Sequence[str], q: int) -> tuple[float, ...]:
        """The hazards of a site towards each target, or its one hazard; none outside."""
        left, right = self.features.left, self.features.right
        if q < left or q + right >= len(text):
            return ()
        around = "".join(text[q - left : q + right + 1])
        name = (around, q) if self.features.fixed else around
        if (found := self.known.get(name)) is None:
            codes = np.full((1, q + right + 1), -1, np.int8)
            codes[0, q - left :] = codes_of([around])[0]
            padded = np.vstack([self.coefficients, np.zeros((1, self.coefficients.shape[1]))])
            score = padded[self.features.index(codes)[0, q]].sum(axis=0)
            rates = np.exp(score) if len(score) == 1 else np.where(np.arange(4) == codes[0, q], 0.0, np.exp(score[0] + score[1:]))
            if len(self.known) >= 1 << 18:
                self.known.clear()
            found = self.known[name] = tuple(rates.tolist())
        return found

    def _after(self, done: int) -> dict[int, float]:
        text, rates, changed = list(self.start), self.base.copy(), [p - 1 for p, b in self.bit.items() if done & b]
        for at in changed:
            text[at] = self.targets[at + 1]
        for q in {q for at in changed for q in range(max(at - self.features.right, 0), min(at + self.features.left + 1, len(text)))}:
            rates[q] = self._rates(text, q)
        for at in changed:
            rates[at] = ()
        total = sum(map(sum, rates))

        def log(pos: int) -> float:
            own = rates[pos - 1]
            rate = own and own["acgt".index(self.targets[pos]) if len(own) > 1 else 0]
            return math.log(rate / total) if rate else -math.inf

        return {p: log(p) for p, b in self.bit.items() if not done & b}


def gibbs(start: str, targets: Mapping[int, str], theta: Theta, k: int, left: int, burn_in: int, samples: int, rate: int, rng: np.random.Generator, order: Sequence[int] = (), held: Sequence[int] = (), score: OrderScore | None = None) -> Iterator[list[int]]:
    """Orders drawn by taking out one position at a time and putting it back in proportion to the likelihood.

    order: the first one, drawn where it isn't given.  The positions in `held`
    keep the relative order that the first one has; only the others move.
    """
    order = list(order) or list(rng.permutation(sorted(targets)))
    moved = sorted(set(targets) - set(held))
    score, kept, sweep = score or OrderScore(start, targets, theta, k, left), 0, 0
    while kept < samples:
        for pos in rng.permutation(moved):
            rest = [x for x in order if x != pos]
            logs = score.places(rest, pos)
            p = np.exp(logs - logs.max())
            at = rng.choice(len(p), p=p / p.sum())
            order = rest[:at] + [pos] + rest[at:]
        sweep += 1
        if sweep > burn_in and (sweep - burn_in) % rate == 0:
            kept += 1
            yield [int(x) for x in order]


def _motif_set(theta: Theta, k: int, left: int) -> tuple[FeatureSet, np.ndarray]:
    """Coefficients by motif as those of a feature set; motifs without one have 0."""
    features = FeatureSet([MotifFeatures(k, left)])
    return features, np.array([theta.get(x, 0.0) for _, x in features.labels])[:, None]


def _order_schema(key: str) -> tuple[pa.Schema, str]:
    arrow = pa.schema([(key, pa.int64()), ("sample", pa.int32()), ("gs", pa.string()), ("mutations", pa.list_(pa.struct([("pos", pa.int32()), ("target", pa.string())])))])
    return arrow, f"{key} long, sample int, gs string, mutations array<struct<pos:int,target:string>>"


def gibbs_orders(seqs: DataFrame, theta: DataFrame, k: int = 3, left: int = 1, burn_in: int = 10, samples: int = 10, rate: int = 1, seed: int = 0, key: str = "sk") -> DataFrame:
    """(key, sample, gs, mutations): sampled orders of each sequence's mutations."""
    features, values = _motif_set(theta_dict(theta), k, left)
    return _drawn(seqs, features, values, burn_in, samples, rate, seed, key, False, False)


def set_orders(seqs: DataFrame, features: FeatureSet, theta: np.ndarray, burn_in: int = 10, samples: int = 10, rate: int = 1, seed: int = 0, key: str = "sk", resume: bool = False) -> DataFrame:
    """(key, sample, gs, mutations): sampled orders of each sequence's mutations under a feature set; resume: chains begin with the rows' own order.

    Mutations at sites that aren't at risk, near the ends, are left out: they
    are no events.  Sequences without an event have no rows.
    """
    return _drawn(seqs, features, theta, burn_in, samples, rate, seed, key, resume, True)


def _drawn(seqs: DataFrame, features: FeatureSet, theta: np.ndarray, burn_in: int, samples: int, rate: int, seed: int, key: str, resume: bool, events_only: bool) -> DataFrame:
    """Chains of rows of equally many mutations run side by side; those that orders.groups() leaves out run one by one."""
    held = seqs.sparkSession.sparkContext.broadcast((features, theta))
    arrow, schema = _order_schema(key)

    def work(stream):
        (features, theta), windows, known = held.value, {}, {}
        for batch in stream:
            draws = orders.Draws(seed, batch.column(key).to_pylist())
            for group in orders.groups(batch, features, theta, windows, events_only):
                if isinstance(group, orders.Group):
                    found = orders.drawn(group.logs, group.order if resume else None, draws.of(group.rows), burn_in, samples, rate)
                    yield orders.order_rows(batch.column(key), group, batch.column("gs"), found, arrow)
                    continue
                for row in batch.take(pa.array(group)).to_pylist():
                    inside = [m for m in row["mutations"] if not events_only or features.left < m["pos"] <= len(row["gs"]) - features.right]
                    targets = {m["pos"]: m["target"] for m in inside}
                    if not targets:
                        continue
                    score = SetScore(row["gs"], targets, features, theta, known)
                    order = [m["pos"] for m in inside] if resume else ()
                    out = gibbs(row["gs"], targets, {}, 0, 0, burn_in, samples, rate, _rng(seed, row[key]), order, score=score)
                    yield pa.RecordBatch.from_pylist([{key: row[key], "sample": i, "gs": row["gs"], "mutations": [{"pos": p, "target": targets[p]} for p in found]} for i, found in enumerate(out)], schema=arrow)

    return _spread(seqs.filter(F.size("mutations") > 0).select(F.col(key).cast("long").alias(key), "gs", "mutations"), key).mapInArrow(work, schema)


def marginal_log_lik(start: str, targets: Mapping[int, str], theta: Theta, k: int, left: int, rng: np.random.Generator, samples: int = 200, exact: int = 5, score: OrderScore | None = None) -> float:
    """ln of the probability of the end sequence: the sum over all orders, or by the candidate's identity.

    Up to `exact` mutations all orders are summed; beyond, Chib's method: the
    log-likelihood of the most frequent sampled order less the log of its
    share.  The order is fixed from its end: the share of its last two
    positions is that among unconditional draws, the share of each position
    before them is that among `samples` draws of a chain held to the positions
    fixed so far, and that of the first position is computed.  A chain goes on
    until one of its draws agrees.
    """
    score = score or OrderScore(start, targets, theta, k, left)
    if len(targets) <= exact:
        logs = np.array([score(x) for x in itertools.permutations(sorted(targets))])
        return float(logs.max() + np.log(np.exp(logs - logs.max()).sum()))
    drawn = list(map(tuple, gibbs(start, targets, theta, k, left, 10, samples, 1, rng, score=score)))
    counts = Counter(drawn)
    best = max(counts, key=lambda o: (counts[o], o))
    agree = lambda orders, at: sum(o.index(best[at]) < o.index(best[at + 1]) for o in orders)
    share = math.log(agree(drawn, len(best) - 2) / len(drawn))
    for at in range(len(best) - 3, 0, -1):
        agrees = total = 0
        order = best
        while not agrees:
            held = list(gibbs(start, targets, theta, k, left, 0, samples, 1, rng, order, best[at + 1 :], score))
            agrees, total, order = agree(held, at), total + samples, held[-1]
        share += math.log(agrees / total)
    logs = score.places(best[1:], best[0])
    share += logs[0] - logs.max() - math.log(np.exp(logs - logs.max()).sum())
    return score(best) - share


def marginal_likelihoods(seqs: DataFrame, theta: DataFrame, k: int = 3, left: int = 1, samples: int = 200, seed: int = 0, key: str = "sk") -> DataFrame:
    """(key, log_lik): the marginal log-likelihood of each sequence's end, whatever the order."""
    features, values = _motif_set(theta_dict(theta), k, left)
    rows = seqs.filter(F.size("mutations") > 0).withColumn(key, F.col(key).cast("long"))
    return _summed(rows, features, values, samples, seed, key, orders.MOST_TOGETHER, False).drop("n_events")


def set_marginal_likelihoods(seqs: DataFrame, features: FeatureSet, theta: np.ndarray, samples: int = 200, seed: int = 0, key: str = "sk", exact: int = orders.MOST_TOGETHER, others: Sequence[str] = ()) -> DataFrame:
    """(others, key, n_events, log_lik): the same under a feature set's coefficients; others: columns that stay. Mutations that are no events are left out; without any the log-likelihood is 0."""
    return _summed(seqs, features, theta, samples, seed, key, exact, True, others)


def _summed(seqs: DataFrame, features: FeatureSet, theta: np.ndarray, samples: int, seed: int, key: str, exact: int, events_only: bool, others: Sequence[str] = ()) -> DataFrame:
    """Up to `exact` mutations the sum over all orders, state by state; beyond that, and for rows that orders.groups() leaves out, marginal_log_lik()."""
    held = seqs.sparkSession.sparkContext.broadcast((features, theta))
    names = [*others, key]
    schema = StructType([*(seqs.schema[c] for c in names), StructField("n_events", LongType()), StructField("log_lik", DoubleType())])

    def work(stream):
        (features, theta), windows, known = held.value, {}, {}
        for batch in stream:
            counts, found = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            left_out = []
            for group in orders.groups(batch, features, theta, windows, events_only, orders.sums):
                if not isinstance(group, orders.Group):
                    left_out.append(group)
                elif group.places.shape[1] > exact:
                    left_out.append(group.rows)
                else:
                    counts[group.rows], found[group.rows] = group.places.shape[1], group.logs
            rest = np.concatenate(left_out) if left_out else np.zeros(0, np.int64)
            for i, row in zip(rest.tolist(), batch.take(pa.array(rest)).to_pylist(), strict=True):
                targets = {m["pos"]: m["target"] for m in row["mutations"] if not events_only or features.left < m["pos"] <= len(row["gs"]) - features.right}
                counts[i] = len(targets)
                if targets:
                    score = SetScore(row["gs"], targets, features, theta, known)
                    found[i] = marginal_log_lik(row["gs"], targets, {}, 0, 0, _rng(seed, row[key]), samples, min(exact, 5), score)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts), pa.array(found)], names=[*names, "n_events", "log_lik"])

    return _spread(seqs.select(*names, "gs", "mutations"), key).mapInArrow(work, schema)


def simulate(start: str, theta: Theta, k: int, left: int, rng: np.random.Generator, censor: float = 0.0, share: float = 0.0, baseline: float = 1.0) -> list[tuple[float, int, str]]:
    """Mutations (time, pos, target), each site once: exponential waits until the censoring time, or a share of the inner sites."""
    text, out, time, done = list(start), [], 0.0, set()
    most = math.ceil(share * (len(start) - k + 1)) if share else len(start)
    while len(out) < most:
        hazard = _hazards("".join(text), theta, k, left)
        hazard[list(done)] = 0
        if hazard.sum() == 0:
            break
        time += rng.exponential(1 / (baseline * hazard.sum()))
        if not share and time > censor:
            break
        at = int(rng.choice(len(text), p=hazard / hazard.sum()))
        target = str(rng.choice([b for b in "acgt" if b != text[at]]))
        text[at] = target
        done.add(at)
        out.append((time, at + 1, target))
    return out


def simulate_seqs(genes: DataFrame, theta: DataFrame, k: int = 3, left: int = 1, censor: float = 0.0, share: float = 0.0, baseline: float = 1.0, copies: int = 1, seed: int = 0, key: str = "gk") -> DataFrame:
    """(key, copy, gs, es, mutations): a star tree, `copies` mutated sequences for each gene."""
    held = genes.sparkSession.sparkContext.broadcast(theta_dict(theta))
    arrow = pa.schema([(key, pa.int64()), ("copy", pa.int32()), ("gs", pa.string()), ("es", pa.string()), ("mutations", pa.list_(pa.struct([("time", pa.float64()), ("pos", pa.int32()), ("target", pa.string())])))])

    def work(stream):
        for batch in stream:
            out = []
            for row in batch.to_pylist():
                found = simulate(row["gs"], held.value, k, left, _rng(seed, f"{row[key]}-{row['copy']}"), censor, share, baseline)
                text = list(row["gs"])
                for _, p, target in found:
                    text[p - 1] = target
                out.append(row | {"es": "".join(text), "mutations": [{"time": t, "pos": p, "target": x} for t, p, x in found]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    spread = genes.select(F.col(key).cast("long").alias(key), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "gs")
    return _spread(spread, key).mapInArrow(work, f"{key} long, copy int, gs string, es string, mutations array<struct<time:double,pos:int,target:string>>")
