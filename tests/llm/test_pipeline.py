"""Stages of the corpus pipeline on rows of null and repeated ids, and each stage on its predecessor's rows by brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from motifspark.llm.quality import fit_quality, statistics
from motifspark.llm.queries import tokenizer_path
from motifspark.llm.textops import stored

from test_line_dedup import brute as brute_lines


def test_one_row_of_each_group_stays(spark):
    words = lambda kind, n=60: " ".join(f"{kind}{k}" for k in range(n))
    rows = [
        (1, words("a")), (2, words("a") + " end"), (None, words("a")), (None, words("a")),
        (3, words("b")), (3, words("b")), (3, words("b")),
        (None, words("c")), (None, words("c")),
        (2, words("clean")), (None, words("other")), (5, None), (5, None), (6, ""),
    ]
    docs = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, row_key int")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, words("a")), (3, words("b")), (None, words("c")), (2, words("clean")), (None, words("other")), (5, None), (5, None), (6, "")], key=str)


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.fixture(scope="module")
def inputs(spark, sf, tmp_path_factory):
    """The small tables, with rows of null and repeated ids, null, empty and wordless texts, benchmark passages, copies and extra columns."""
    folder = tmp_path_factory.mktemp("tables")
    more = f"{sf}/../sf0.01"
    labels = spark.read.parquet(f"{more}/labels.parquet")
    # few, as all pairs of their lines are compared by hand
    chosen = labels.filter("quality = 0").orderBy("doc_id").limit(25).unionByName(labels.filter("quality = 1").orderBy("doc_id").limit(45))
    docs = spark.read.parquet(f"{more}/documents.parquet").join(chosen.select("doc_id"), "doc_id", "left_semi")
    items = [r.text for r in spark.read.parquet(f"{more}/benchmark.parquet").collect()]
    some = docs.filter("length(text) > 900").limit(3).collect()
    odd = [(None, some[0].text), (900001, None), (900002, ""), (900003, " \n\t "), (900004, some[1].text + "\n" + items[0]), (900005, items[1]), (900006, some[2].text), (900006, some[2].text)]
    extra = spark.createDataFrame([(d, t, "en", "more", len(t or "")) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(extra).withColumns({"score": F.lit(1), "places_cut": F.lit("x"), "row_key": F.lit(2), "window_spans": F.lit(3)}).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{more}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder), items


def test_each_stage_on_what_the_one_before_kept(spark, inputs):
    """Every stage's rows follow from its own input: by brute force, and by the library's ids for packing."""
    folder, items = inputs
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda frame: [(r.doc_id, r.text, r.n_chars) for r in frame.collect()]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)

    # the classifier's verdicts, row by row, with all columns
    model = fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    verdicts = model.score(statistics([r.text for r in docs.collect()])) >= 0.5
    kept = stored(stages["quality"](spark, docs, folder), "stage")
    assert kept.columns == docs.columns
    assert Counter(rows(kept)) == Counter(r for r, good in zip(rows(docs), verdicts, strict=True) if good)
    assert 0 < kept.count() < docs.count()

    lines = stored(stages["line_dedup"](spark, kept, folder), "stage")
    assert lines.columns == docs.columns
    want = brute_lines([(d, t) for d, t, _ in rows(kept)])
    assert sorted([(d, t) for d, t, _ in rows(lines)], key=str) == want
    assert all(n == len(t or "") or t is None for _, t, n in rows(lines))

    near = stored(stages["near_duplicates"](spark, lines, folder), "stage")
    assert near.columns == docs.columns
    texts = [(d, t) for d, t, _ in rows(lines)]
    sets = []
    for _, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    groups = {}
    for k, name in enumerate(least):
        groups.setdefault(name, []).append(texts[k])
    got = Counter((d, t) for d, t, _ in rows(near))
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        best = min(((d is None, d or 0), t or "") for d, t in members)[0]
        assert any(got[d, t] for d, t in members if (d is None, d or 0) == best)

    clean = stored(stages["decontamination"](spark, near, folder), "stage")
    assert clean.columns == docs.columns
    windows = set()
    for w in map(words_of, items):
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} or ({tuple(w)} if w else set())
    left = {}
    for d, t, _ in rows(near):
        w = words_of(t)
        hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if 5 * len(hit) <= len(w):
            left[d, t] = [x for i, x in enumerate(w) if i not in hit], bool(hit)
    assert clean.count() == len(left)
    assert Counter(tuple(x) for x, _ in left.values()) == Counter(tuple(words_of(t)) for _, t, _ in rows(clean))
    assert {(d, t) for (d, t), (_, hit) in left.items() if not hit} <= {(d, t) for d, t, _ in rows(clean)}

    packed = stages["packing"](spark, clean, folder).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    ids = Counter((d, zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, t, _ in rows(clean))
    by_row, places = Counter(), {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 0 < r.length <= 2048
        by_row[r.doc_id, r.ids_crc32] += r.piece == 0 and r.length < 2048
    assert all(sorted(x)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) and sum(n for _, n in x) <= 2048 for x in places.values())
    assert all(ids[k] == n for k, n in by_row.items() if n)
    assert sum(r.length for r in packed) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows(clean))

    # the chain, and the session as it was
    spark.conf.set(size, before)
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    assert spark.conf.get(size) == before


def test_stages_on_empty_tables(spark, inputs):
    folder, _ = inputs
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (stage is corpus_pipeline.packing or out.columns == empty.columns)
