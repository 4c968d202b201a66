"""Fuzzy line deduplication against all pairs, its banding's recall, and repeated rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from motifspark.llm import line_dedup as D

RNG = random.Random(5)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyzäé", k=RNG.randint(2, 9))) for _ in range(400)]


def line(n):
    return " ".join(RNG.choices(WORDS, k=n))


def edited(text, n):
    """The line with n letters changed."""
    out = list(text)
    for k in RNG.sample(range(len(out)), n):
        out[k] = RNG.choice("xyz0")
    return "".join(out)


def shingles(x):
    x = x.strip()
    return {x[k : k + D.WIDTH] for k in range(max(len(x) - D.WIDTH + 1, 1))}


def alike(x, y, percent=80):
    a, b = shingles(x), shingles(y)
    return 100 * len(a & b) >= percent * len(a | b)


def lower(x):
    return "".join(c.lower() if c.isascii() else c for c in x)


def test_sets_are_runs_of_characters():
    lines = ["ärger über ärger", "abc", "aaaaaaaaaa", "日本語の文字列です"]
    found = D.line_sets([x.encode() for x in lines])
    assert [len(x) for x in found] == [len(shingles(x)) for x in lines]
    assert len(np.intersect1d(*D.line_sets([b"one common run of text", b"one common run of words"]))) == len(shingles("one common run of text") & shingles("one common run of words"))


def test_banding_finds_similar_lines_and_few_others():
    near, far = [0, 0], [0, 0]
    for _ in range(1500):
        x = line(RNG.randint(8, 60))
        y = edited(x, max(1, round(len(x) * RNG.choice([0.01, 0.02, 0.03, 0.15]))))
        (a, b), (s, t) = D.band_keys([x.encode(), y.encode()])
        found = (a == b).any() and D.agreement(s, t) >= D.shape(80)[2]
        if (kind := near if alike(x, y) else None if alike(x, y, 50) else far) is not None:
            kind[0] += found
            kind[1] += 1
    assert near[1] > 500 and near[0] / near[1] > 0.995
    assert far[1] > 200 and far[0] / far[1] < 0.1


def brute(rows):
    """The texts that stay: one line of each component, by document and place; of repeated rows one."""
    own = sorted({(d, t) for d, t in rows if t and t.strip()}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    lines = [(d, k, x) for d, t in own for k, x in enumerate(t.split("\n")) if x.strip()]
    least = list(range(len(lines)))
    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if alike(lower(lines[i][2]), lower(lines[j][2]))]
    for _ in lines:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    gone = {(lines[k][0], lines[k][1]) for k in range(len(lines)) if least[k] != k}
    out = [(d, t) for d, t in rows if not (t and t.strip())]
    for d, t in own:
        left = [x for k, x in enumerate(t.split("\n")) if (d, k) not in gone]
        if any(x.strip() for x in left):
            out.append((d, "\n".join(left)))
    return sorted(out, key=str)


def test_whole_operator_matches_all_pairs(spark):
    base = [line(RNG.randint(2, 14)) for _ in range(25)]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(RNG.randint(1, 5)):
            x = RNG.choice(base) if RNG.random() < 0.7 else line(RNG.randint(1, 10))
            own.append(RNG.choice([x, x, x.upper(), f"  {x}\t", edited(x, 1), edited(x, 2), "", x + "s"]))
        texts.append("\n".join(own))
    rows = [(k, x) for k, x in enumerate(texts)] + [(100, None), (100, None), (101, ""), (102, " \n\t"), (102, " \n\t")]
    rows += [(3, texts[3]), (3, texts[3]), (103, texts[4]), (104, "new " + line(9)), (105, "a line that nobody else has\nand one more of these")]
    frame = spark.createDataFrame([(*x, "p") for x in rows], "doc_id long, text string, places_cut string")
    got = D.dedup_lines(frame)
    assert got.columns == frame.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == brute(rows)


def test_buckets_of_any_size_hold_together(monkeypatch, spark):
    """All lines of one text with a letter changed: compared in pairs, by a forest, and held by one line."""
    text = line(30)
    rows = [(k, edited(text, 1)) for k in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert D.dedup_lines(frame).count() == 1
    _, sketch = D.band_keys([x.encode() for _, x in rows])
    agree = D.shape(80)[2]
    for most, n in ((1 << 20, 90), (10, 90), (10, 20)):
        monkeypatch.setattr(D, "PAIRWISE", most)
        assert (D._groups(sketch[None, :n], agree) == 0).all()
        apart = np.concatenate([sketch[:3], ~sketch[:3]])
        assert D._groups(np.stack([apart, apart[::-1]]), agree).tolist() == [[0, 0, 0, 3, 3, 3]] * 2


def test_bands_suit_the_similarity():
    """Fewer rows a band for lower similarities, so that pairs of it aren't missed; where no bands would do, an error."""
    assert D.shape(80) == (4, 12, 44)
    assert [D.shape(p)[0] for p in (95, 80, 70, 50, 30)] == [4, 4, 3, 2, 1]
    for percent in (50, 60, 70):
        rows, bands, agree = D.shape(percent)
        near = [0, 0]
        for _ in range(2500):
            x = line(RNG.randint(8, 40))
            y = edited(x, max(1, round(len(x) * RNG.choice([0.03, 0.05, 0.08, 0.1]))))
            if alike(x, y, percent) and not alike(x, y, percent + 10):
                (a, b), (s, t) = D.band_keys([x.encode(), y.encode()], rows, bands)
                near[0] += (a == b).any() and D.agreement(s, t) >= agree
                near[1] += 1
        assert near[1] > 200 and near[0] / near[1] > 0.985
    with pytest.raises(ValueError, match="too low"):
        D.shape(5)


def test_agreement_counts_equal_minima():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (2, 500, 2, 32)).astype(np.uint64)
    b[:, :, ::3] = a[:, :, ::3]
    packed = [np.bitwise_or.reduce(x << np.arange(0, 64, 2, dtype=np.uint64), axis=2) for x in (a, b)]
    assert D.agreement(*packed).tolist() == (a == b).sum(axis=(1, 2)).tolist()


def test_links_of_small_clusters_against_all_pairs():
    """What is linked inside a cluster, directly or through others, is so by the edges that are found; nodes are in several clusters."""
    base = [line(10) for _ in range(6)]
    lines = [edited(RNG.choice(base), RNG.choice([0, 1, 3, 6])).encode() for _ in range(80)] + [b"x", b"xy", b"x"]
    cluster = np.array([RNG.randint(0, 8) for _ in range(160)])
    node = np.array([RNG.randint(0, len(lines) - 1) for _ in range(160)])
    cluster, node = np.unique(np.stack([cluster, node]), axis=1)
    a, b = D.small_links(cluster, node * 7, [lines[k] for k in node], 80)
    edges = set(zip((a // 7).tolist(), (b // 7).tolist(), strict=True))

    def joined(pairs, members):
        least = {k: k for k in members}
        for _ in members:
            for i, j in pairs:
                if i in least and j in least:
                    least[i] = least[j] = min(least[i], least[j])
        return least

    assert all(alike(lines[i].decode(), lines[j].decode()) for i, j in edges)
    for c in set(cluster.tolist()):
        members = node[cluster == c].tolist()
        true = [(i, j) for i, j in itertools.combinations(members, 2) if alike(lines[i].decode(), lines[j].decode())]
        assert joined(true, members) == joined([*edges], members) or all(joined([*edges], members)[i] == joined([*edges], members)[j] for i, j in true)


def test_cuts_by_shuffle_and_large_groups_in_chunks(monkeypatch, spark):
    """More documents with cuts than are broadcast, and groups of more lines than a chunk: the same rows."""
    base = [line(12) for _ in range(4)]
    rows = [(k, edited(RNG.choice(base), 1) + "\n" + line(9)) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sorted([(r.doc_id, r.text) for r in D.dedup_lines(frame).collect()], key=str) == want
    monkeypatch.setattr(D, "MOST_BROADCAST", 0)
    monkeypatch.setattr(D, "SMALL", 3)
    monkeypatch.setattr(D, "CHUNK", 8)
    assert sorted([(r.doc_id, r.text) for r in D.dedup_lines(frame).collect()], key=str) == want


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, row_id int, repeats int")
    assert D.dedup_lines(empty).columns == empty.columns and D.dedup_lines(empty).count() == 0
    same = [(None, "one line that all rows have\nand another one")] * 30 + [(None, None)] * 3
    got = D.dedup_lines(spark.createDataFrame([(*r, 7, 8) for r in same], empty.schema).repartition(4)).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(*same[0], 7, 8)] + [(None, None, 7, 8)] * 3, key=str)
