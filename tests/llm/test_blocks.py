"""Decontamination in one and in several blocks of the benchmark, and links inside blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from motifspark.llm.block_product import block_links
from motifspark.llm.decontaminate import decontaminate


def test_blocks_do_not_change_the_result(spark):
    """Windows of two items that overlap, and a share that only both items together exceed."""
    names = lambda kind, n: [f"{kind}{k}" for k in range(n)]
    shared = names("s", 25)
    rows = [(k, " ".join(x)) for k, x in enumerate([shared[:15], shared[10:], names("p", 12), names("q", 12)])]
    benchmark = spark.createDataFrame([*rows, (None, "s1 s2"), (7, None)], "item_id long, text string")
    texts = [
        " ".join([*names("a", 100), *shared, *names("b", 100)]),
        " ".join([*names("a", 40), *names("p", 12), *names("c", 3), *names("q", 12), *names("b", 13)]),
        " ".join([*names("a", 40), *names("p", 12), *names("b", 28)]),
        "nothing here", None, "",
    ]
    docs = spark.createDataFrame([(k, x, "b") for k, x in enumerate([*texts, texts[0]])], "doc_id long, text string, window_spans string")
    rest = lambda **more: sorted(map(str, decontaminate(docs, benchmark, **more).collect()))
    size = sum(len(x) for _, x in rows) + 5
    owners = {r[0] for r in benchmark.filter("item_id < 4").select(F.pmod(F.xxhash64("item_id"), F.lit(1 + size // 60))).collect()}
    assert len(owners) > 1
    assert rest(most_chars=60) == rest()
    whole = {r.doc_id: r.text for r in decontaminate(docs, benchmark, most_chars=60).collect()}
    assert set(whole) == {0, 2, 3, 4, 5, 6} and whole[4] is None
    assert whole[0] == whole[6] == " ".join(names("a", 100)) + "  " + " ".join(names("b", 100))


def test_block_links_match_all_pairs():
    """Blocks of one star, of several, of unlinked rows and of mixtures hold together what all pairs hold together."""
    rng = np.random.default_rng(4)
    for kind in range(12):
        base = [rng.choice(1 << 20, 40, replace=False) for _ in range(1 + kind % 4)]
        sets = []
        for k in range(20 + 15 * kind):
            own = base[k % len(base)].copy()
            own[: rng.integers(0, 8 if kind < 8 else 25)] = rng.integers(1 << 20, 1 << 21)
            sets.append(np.unique(own).astype(np.uint64))
        signs = np.arange(len(sets)) * 7 + 3
        a, b = block_links(signs, sets, 80)
        least = {int(s): int(s) for s in signs}
        links = [(int(signs[i]), int(signs[j])) for i in range(len(sets)) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)]

        def closed(pairs, least=least):
            out = dict(least)
            while any(out[x] != out[y] for x, y in pairs):
                for x, y in pairs:
                    out[x] = out[y] = min(out[x], out[y])
            return out

        assert closed(links) == closed(list(zip(a.tolist(), b.tolist(), strict=True)))
