"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Every text becomes a short vector of statistics (shares of character classes,
word and line lengths, repetition).  Random cosine features approximate a
Gaussian kernel over the standardised vectors, so ridge regression needs only
sums over rows: each partition adds up its normal equations and the sums meet
in one small solve.  Part of the labelled sample is kept from the fit and
calibrates raw scores by isotonic regression (pool adjacent violators).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import NOT_SPACE, batches, crc_column, distinct_counts, stored, tidy, word_table

#: Character classes: each byte has one; shares of them are statistics.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".", ",;:", "!", "?", "|", "%", "&", "$", "#", "*", "<>{}[]()=/\\", "@_~^+-", "'\"`")
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _members in enumerate(CLASSES):
    _CLASS_OF[[ord(c) for c in _members]] = _k
_CLASS_OF[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
N_STATISTICS = N_CLASSES + 12


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of N_STATISTICS numbers for each text; null and empty texts have zeros."""
    out = np.zeros((len(texts), N_STATISTICS))
    for a, b in batches(texts, 1 << 19):
        raw = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts[a:b]]
        hashes, owner, start, end = word_table(raw, NOT_SPACE)
        at = np.searchsorted(owner, np.arange(len(raw) + 1))
        lengths = (end - start).astype(np.float64)
        for k, data in enumerate(raw):
            if not data:
                continue
            row, size = out[a + k], len(data)
            share = np.bincount(_CLASS_OF[np.frombuffer(data, np.uint8)], minlength=N_CLASSES) / size
            row[:N_CLASSES] = np.sqrt(share)
            used = share[share > 0]
            own, words = lengths[at[k] : at[k + 1]], hashes[at[k] : at[k + 1]]
            lines = data.split(b"\n")
            more = [np.log1p(size), -(used * np.log(used)).sum(), np.log1p(size / len(lines)), len(set(lines)) / len(lines)]
            if len(own):
                distinct, times = distinct_counts(words)
                more += [own.mean(), own.std(), len(distinct) / len(own), times.max() / len(own), (own <= 3).mean(), (own >= 12).mean(), np.log1p(len(own)), np.sqrt((words[1:] == words[:-1]).mean()) if len(own) > 1 else 0.0]
            row[N_CLASSES : N_CLASSES + len(more)] = more
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares non-decreasing fit of y on x: mean x and value of each pooled block."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            right, left = blocks.pop(), blocks[-1]
            n = left[2] + right[2]
            blocks[-1] = [(left[0] * left[2] + right[0] * right[2]) / n, (left[1] * left[2] + right[1] * right[2]) / n, n]
    return np.array([z[0] for z in blocks]), np.array([z[1] for z in blocks])


@dataclass
class QualityModel:
    centre: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0.0, 1.0)


def _packed(stream, fold):
    for batch in stream:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, N_STATISTICS)
        yield from fold(x, batch.column("label").to_numpy(), batch.column("fold").to_numpy())


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, most_rows: int = 20_000, features: int = 400, ridge: float = 1e-3, seed: int = 7) -> QualityModel | None:
    """Fits the model to at most `most_rows` labelled documents, those of the smallest hashes; repeated rows count each.

    Labels of ids with crc32(doc_id as text) mod `modulus` equal to `held_out`
    are not looked at; null ids and labels are left out, and an id's labels
    are averaged.  A fifth of the sample calibrates.  None without any rows.
    """
    learnt = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(crc_column("doc_id", modulus) != held_out)
    sample = learnt.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).join(F.broadcast(sample), "doc_id")

    def measure(stream):
        tidy()
        for batch in stream:
            x = statistics(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "x": pa.array([v.tobytes() for v in x], pa.binary()), "label": batch.column("label"), "fold": batch.column("fold")})

    measured = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5))).mapInArrow(measure, "doc_id long, mark long, x binary, label double, fold long").orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(most_rows).select("x", "label", "fold")
    data = stored(measured, "quality-sample").repartition(16)

    def sums(x, label, fold):
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64()), "sums": pa.array([np.stack([x.sum(0), (x * x).sum(0)]).tobytes()], pa.binary())})

    parts = data.mapInArrow(lambda s: _packed(s, sums), "n long, sums binary").collect()
    n = sum(p.n for p in parts)
    if not n:
        return None
    first, second = np.sum([np.frombuffer(p.sums, np.float64).reshape(2, -1) for p in parts], axis=0) / n
    spread = np.sqrt(np.maximum(second - first * first, 0))
    rng = np.random.default_rng(seed)
    model = QualityModel(first, np.where(spread > 1e-9, spread, 1.0), rng.normal(0, np.sqrt(1 / N_STATISTICS), (N_STATISTICS, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), (np.zeros(1), np.zeros(1)))

    def equations(x, label, fold):
        own = fold != 0
        z = model.features(x[own])
        yield pa.RecordBatch.from_pydict({"n": pa.array([int(own.sum())], pa.int64()), "sums": pa.array([np.vstack([z.T @ z, (z.T @ label[own])[None]]).tobytes()], pa.binary())})

    def summed(stream):
        total, count = np.zeros((features + 2, features + 1)), 0
        for batch in _packed(stream, equations):
            total += np.frombuffer(batch.column("sums")[0].as_py(), np.float64).reshape(total.shape)
            count += batch.column("n")[0].as_py()
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = data.mapInArrow(summed, "n long, sums binary").collect()
    total = np.sum([np.frombuffer(p.sums, np.float64).reshape(features + 2, features + 1) for p in parts], axis=0)
    model.weights = np.linalg.solve(total[:-1] + ridge * max(1, sum(p.n for p in parts)) / features * np.eye(features + 1), total[-1])

    def raw(x, label, fold):
        own = fold == 0
        yield pa.RecordBatch.from_pydict({"raw": pa.array(model.raw(x[own]), pa.float64()), "label": pa.array(label[own], pa.float64())})

    kept = data.mapInArrow(lambda s: _packed(s, raw), "raw double, label double").collect()
    if kept:
        model.steps = isotonic(np.array([r.raw for r in kept]), np.array([r.label for r in kept]))
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, modulus: int = 3, held_out: int = 1, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, or with keep=True all rows of docs that are predicted good.

    Only the text is looked at; a null text counts as the empty one.  Without
    a model every score is 1/2.  Repeated rows are scored each by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score = lambda texts: np.full(len(texts), 0.5) if shared.value is None else shared.value.score(statistics(texts))

    def work(stream):
        tidy()
        for batch in stream:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score(batch.column("text").to_pylist()), pa.float64())})

    def kept(stream):
        tidy()
        for batch in stream:
            yield batch.filter(pa.array(score(batch.column("text").to_pylist()) >= 0.5))

    if keep:
        return docs.mapInArrow(kept, docs.schema)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", (crc_column("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
