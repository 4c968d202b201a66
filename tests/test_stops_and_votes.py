"""Ends of trimmed pairs and votes of a consensus, found from the few differing bases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from motifspark.functions.sequences import trimmed
from motifspark.operators import tables
from motifspark.operators.logistic import _distinct_rows


def test_consensus_counts_only_differing_bases_and_takes_odd_members(spark):
    rows = [("a", 1, "acgt", "acgt"), ("a", 2, "acgt", "tcgtaa"), ("b", 3, "acgt", "nagn"), ("b", 4, "cgg", "aagt"), ("c", 5, "acgt", None), ("d", 6, "ac", ""), (None, 7, "ac", "ac"), ("e", 8, None, "acg"), ("f", 9, "ac", "acgn")]
    frame = spark.createDataFrame(rows, "fam string, k int, s string, t string")
    want = {}
    for fam in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == fam and r[3] is not None]
        text = ""
        for i in range(min((len(r[3]) for r in own), default=0)):
            votes = [(hashlib.md5(f"v{k}-{i}".encode()).hexdigest(), t[i]) for _, k, s, t in own if s is not None and t[i] != s[i : i + 1] and t[i] != "n"]
            text += min(votes)[1] if votes else min((s[i : i + 1] for _, _, s, _ in own if s is not None), default="")
        if any(r[3] for r in own) and min(len(r[3]) for r in own):
            want[fam] = text
    found = tables.consensus(frame, "fam", "s", "t", "k")
    assert {r[0]: r[1] for r in found.collect()} == want
    assert "posexplode" not in found._jdf.queryExecution().toString()


def test_trimmed_finds_its_ends_from_the_stops(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("acgtn") for _ in range(n)), "".join(rng.choice("acgtn") for _ in range(n))) for n in range(24)]
    pairs += [(a, "".join(rng.choice("acgt") if rng.random() < 0.2 else x for x in a)) for a, _ in pairs]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for left, right in ((0, 0), (1, 3), (2, 2)):
        found = frame.select("a", "b", trimmed("a", "b", left, right).alias("x"))
        for a, b, x in found.collect():
            flags, half = "".join("1" if p != q or p == "n" else "0" for p, q in zip(a, b, strict=True)), len(a) // 2
            skipped = lambda text, n: len(re.match(f"(?:0{{0,{n - 1}}}1)*", text)[0]) if n else 0
            assert tuple(x) == (skipped(flags[:half], left) + left, len(a) - skipped(flags[half:][::-1], right) - right)
    assert "regexp_extract" not in found._jdf.queryExecution().toString()


def test_distinct_rows_as_numbers_and_as_rows():
    rng = np.random.default_rng(2)
    for high in (3, 1 << 40):
        keys = rng.integers(-1, high, (500, 3))
        keys = np.vstack([keys, keys[:100]])
        kept, n = _distinct_rows(keys)
        want, count = np.unique(keys, axis=0, return_counts=True)
        assert (kept == want).all() and (n == count).all()
    assert len(_distinct_rows(keys[:0])[0]) == 0
