"""The quality classifier's statistics, normal equations and calibration, computed from plain Python and dense algebra."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from motifspark.llm import quality as Q


def by_hand(text: str | None) -> list[float]:
    data = (text or "").encode()
    if not data:
        return [0.0] * Q.N_STATISTICS
    kinds = Counter()
    for byte in data:
        c = chr(byte)
        kinds[len(Q.CLASSES) + 1 if byte >= 128 else next((k for k, members in enumerate(Q.CLASSES) if c in members), len(Q.CLASSES))] += 1
    shares = [kinds[k] / len(data) for k in range(Q.N_CLASSES)]
    words, word = [], b""
    for byte in data + b" ":
        if byte in b"\t\n\x0b\x0c\r ":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([byte])
    lines = data.split(b"\n")
    out = [math.sqrt(x) for x in shares] + [math.log1p(len(data)), -sum(x * math.log(x) for x in shares if x), math.log1p(len(data) / len(lines)), len(set(lines)) / len(lines)]
    if words:
        n, times = [len(w) for w in words], Counter(words)
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out += [np.mean(n), np.std(n), len(times) / len(words), max(times.values()) / len(words), np.mean([x <= 3 for x in n]), np.mean([x >= 12 for x in n]), math.log1p(len(words)), math.sqrt(same / (len(words) - 1)) if len(words) > 1 else 0.0]
    return out + [0.0] * (Q.N_STATISTICS - len(out))


TEXTS = [None, "", " \n\t", "A", "word word word", "Ärger & 日本 #tag\n\n***", "one | two | three\nsame\nsame", "x" * 30 + " y", "a,b;c:d!e?f%g$h@i~\"'`"]


def test_statistics():
    assert np.allclose(Q.statistics(TEXTS), [by_hand(t) for t in TEXTS])


def test_weights_solve_the_normal_equations_and_scores_are_calibrated(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (0, None)], "doc_id long, quality int"))
    model = Q.fit_quality(docs, labels, features=12, ridge=1e-2)
    rows = docs.join(labels, "doc_id").filter("quality IS NOT NULL").select("doc_id", "text", "quality", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)).alias("fold")).collect()
    learnt = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert 20 < len(learnt) < len(rows)
    x, y, fold = np.array([by_hand(r.text) for r in learnt]), np.array([r.quality for r in learnt], float), np.array([r.fold for r in learnt])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.spread[x.std(axis=0) > 1e-6], x.std(axis=0)[x.std(axis=0) > 1e-6])
    z = np.clip((x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), -6, 6)
    phi = np.hstack([np.cos(z @ model.directions + model.phases) * math.sqrt(2 / 12), np.ones((len(x), 1))])
    own = fold != 0
    weights = np.linalg.solve(phi[own].T @ phi[own] + 1e-2 * own.sum() / 12 * np.eye(13), phi[own].T @ y[own])
    assert np.allclose(model.weights, weights, atol=1e-8)
    steps = Q.isotonic(phi[~own] @ weights, y[~own])
    assert all(np.allclose(a, b) for a, b in zip(model.steps, steps, strict=True))
    got = {r.doc_id: r for r in Q.score_quality(docs, model).collect()}
    for r in rows:
        raw = np.hstack([np.cos(np.clip((np.array(by_hand(r.text)) - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), -6, 6) @ model.directions + model.phases) * math.sqrt(2 / 12), [1.0]]) @ weights
        want = float(np.clip(np.interp(raw, *steps), 0, 1))
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def test_random_features_approximate_a_gaussian_kernel():
    """With many features the products come near the kernel of unit width over the mean squared difference."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, Q.N_STATISTICS))
    model = Q.QualityModel(np.zeros(Q.N_STATISTICS), np.ones(Q.N_STATISTICS), rng.normal(0, math.sqrt(1 / Q.N_STATISTICS), (Q.N_STATISTICS, 20_000)), rng.uniform(0, 2 * math.pi, 20_000), np.zeros(20_001), (np.zeros(1), np.zeros(1)))
    phi = model.features(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2) / Q.N_STATISTICS
    assert np.abs(phi @ phi.T - np.exp(-apart / 2)).max() < 0.05
