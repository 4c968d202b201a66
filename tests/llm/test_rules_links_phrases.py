"""Quality rules, alignment and phrases against brute force, and what they do with odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.llm import queries
from motifspark.llm.alignment import MOST_LISTED, SHIFT, _pairs, align, aligned, alignment_groups, merge_ends, tokenizers_of
from motifspark.llm.collocations import Index, PerfectHash, _parts, candidates, collocations, cut_scores
from motifspark.llm.quality_rules import bucket, features, fences, merge_sketches, quality_filter, quality_report, quality_sketch, quartiles

DOCS = "doc_id long, text string, lang string, source string"
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (None, "one two three", None, None), (3, "same words " * 30, "en", "a"), (3, "same words " * 30, "en", "a"),
    (4, " \t\n\x0b\x0c\r ", None, "a"), (5, "é ä▁ö <|endoftext|> x y  z\n\tq", "fr", None), (6, "😀😀😀 日本語のテキスト " * 5, "ja", "b"), (7, "a" * 3000, "en", "b"),
]


def pairs_of(spark, name, sf="/root/testdata/sf0.01"):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    by = sorted(got.columns)
    return sorted(map(str, got[by].values.tolist())), sorted(map(str, want[by].values.tolist()))


@pytest.mark.parametrize("name", ["op12_quality_rules", "op13_collocations"])
def test_twins(spark, name):
    got, want = pairs_of(spark, name)
    assert len(got) > 900
    assert got == want


# quality rules


def brute_counts(text: str | None) -> tuple[int, ...]:
    text, blanks = text or "", " \t\n\x0b\x0c\r"
    cut = lambda s: "".join(" " if c in blanks else c for c in s).split(" ")
    words = [w for w in cut(text) if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if any(w for w in cut(x))]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "x", *("".join(rng.choice(["a", "b", "é"]) + rng.choice([" ", "\n", "\t ", " "]) for _ in range(rng.randint(1, 60))) + rng.choice(["", "#*", "\n\na \n"]) for _ in range(120)), *(t for _, t, _, _ in ODD)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[x] for x in names) for r in features(docs).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_only_dataframe_functions(spark, sf):
    plan = queries.op12_quality_rules(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_sketches_merge_to_the_sketch_of_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    measured = features(docs)
    parts = [quality_sketch(measured.filter(F.col("doc_id") % 3 == k)) for k in range(3)]
    rows = lambda s: sorted(map(tuple, s.collect()), key=str)
    whole = quality_sketch(measured)
    assert rows(merge_sketches([merge_sketches(parts[:2]), parts[2]]).select(whole.columns)) == rows(whole)
    exact = {r["lang"]: r["q"] for r in measured.filter("NOT base_failed").groupBy("lang").agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY mean_length)").alias("q")).collect()}
    for r in quartiles(whole, ["lang"]).filter("measure = 'mean_length'").collect():
        assert exact[r["lang"]] * 31 / 32 <= r["upper"] <= exact[r["lang"]]


def test_buckets(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 123456, 2**40 + 12345]
    got = [r[1] for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", bucket(F.col("v"))).collect()]
    assert got == [v if v < 64 else v >> (v.bit_length() - 6) << (v.bit_length() - 6) for v in values]


def test_small_groups_take_the_sketch_above(spark):
    plain = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, plain, "en", "large" if i < 40 else "small") for i in range(45)] + [(100 + i, plain, "de", "small") for i in range(3)] + [(200, plain.replace(" ", "### "), "en", "large"), (201, plain.replace(" ", "!? ") + "!?", "de", "small")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in quality_report(docs, least=20).collect()}
    assert (got[0]["level"], got[44]["level"], got[100]["level"]) == ("source", "lang", "corpus")
    assert got[200]["broken"] == ["mean_length", "symbols"] and not got[200]["kept"]
    assert got[201]["broken"] == ["mean_length", "marks"] and not got[201]["kept"]
    assert all(r["kept"] for i, r in got.items() if i < 200)


def test_rules_on_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"words_": F.lit(1), "row_": F.lit(2), "fence": F.lit(3), "kept": F.lit("x"), "n_words": F.lit(4)})
    got = [(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in quality_report(docs).collect()]
    want = [(i, *[(n := brute_counts(t))[0], n[0] < 20 or 100 * n[4] > 30 * n[0]], False) for i, t, _, _ in ODD]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert quality_filter(docs).columns == docs.columns
    assert quality_filter(docs).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert quality_report(empty).count() == quality_filter(empty).count() == 0


def test_filter_keeps_what_the_report_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("h1_", F.lit(0))
    kept = {r[0] for r in quality_report(docs, least=20).filter("kept").select("doc_id").collect()}
    got = quality_filter(docs, least=20)
    assert {r[0] for r in got.select("doc_id").collect()} == kept
    # bounds of an earlier corpus
    bounds = fences(quality_sketch(features(docs)), 20)
    assert quality_filter(docs, bounds).count() == len(kept)


# alignment


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


HOSTILE = ["it's we'll  don't\n\n\nx", "tabs\t\there \t and  two spaces   three", "<|endoftext|> <s> </s> <0x41>", "日本語 中文 한국어 ไทย", "áè ​‍ 👩‍👩‍👧", " nbsp em x", "12345 67,890.12 0x1F", "===== ---- ______ ####", " lead and trail ", "\x00\x01 control \x1c\x1d", "é", " ", "\n", "don’t “quote” �", "a ' s 're x", "ﬁ ½ Ａ"]


def brute_alignment(texts: list, paths) -> list[tuple]:
    """Whole texts through both libraries, groups by sets of ends, links one by one."""
    own, rows = tokenizers_of(*paths), []
    for text in texts:
        if not text:
            rows.append(([], []))
            continue
        a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
        raw = (" " + text).encode()
        sides = [[own.bytes_a[x] for x in a], [own.bytes_b[x] for x in b]]
        if any(b"".join(x) != raw for x in sides):
            rows.append(([], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in sides]
        groups, common = [], sorted(set(ends[0]) & set(ends[1]))
        for lo, hi in zip([0, *common], common, strict=False):
            groups.append(([x for x, e in zip(a, ends[0], strict=True) if lo < e <= hi], [x for x, e in zip(b, ends[1], strict=True) if lo < e <= hi]))
        rows.append((groups, [(x, y) for one, other in groups for x in one for y in other]))
    counts = Counter(pair for _, links in rows for pair in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for groups, links in rows:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("most_pairs", [1_000_000, 0])
def test_alignment_against_brute_force(spark, paths, sf, most_pairs):
    """By broadcast, and by the join that takes over beyond the bound."""
    texts = HOSTILE + [t for _, t, _, _ in ODD] + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r["doc_id"]: tuple(r[x] for x in names) for r in align(docs, *paths, most_pairs=most_pairs).collect()}
    assert got == dict(enumerate(brute_alignment(texts, paths)))


def test_large_groups_are_counted_by_their_ids(paths):
    """A group beyond MOST_LISTED links gives the same pairs as one that is listed."""
    own = tokenizers_of(*paths)
    assert merge_ends(np.array([2, 3, 5, 9]), np.array([1, 3, 4, 6, 9]))[0].tolist() == [1, 3]
    import motifspark.llm.alignment as module

    text = "lower unbelievable 日本語 éèê internationalisation"
    one = aligned(own, [text, "x"])
    module.MOST_LISTED = 1
    try:
        other = aligned(own, [text, "x"])
    finally:
        module.MOST_LISTED = MOST_LISTED
    assert one[0][3] is None and other[0][3] is not None
    assert [x.tolist() for x in _pairs(one)] == [x.tolist() for x in _pairs(other)]
    assert [x[:2] for x in one] == [x[:2] for x in other]
    assert np.frombuffer(one[0][1], np.int32)[3] == len(one[0][2]) // 8 and SHIFT == 32


def test_alignment_of_odd_rows(spark, paths):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"row": F.lit(1), "n_a": F.lit(2), "pairs": F.lit(3)})
    got = align(docs, *paths).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)
    assert all(r["n_links"] == r["count_sum"] == 0 and r["groups_sha256"] == "" for r in got if r["doc_id"] in (1, 2))
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1
    assert align(docs.limit(0), *paths).count() == 0
    groups = alignment_groups(docs.filter("doc_id = 6"), *paths).orderBy("group").collect()
    own = tokenizers_of(*paths)
    assert b"".join(own.bytes_a[x] for r in groups for x in r["a_ids"]).decode() == " " + ODD[7][1] and len(groups) == next(r["n_groups"] for r in got if r["doc_id"] == 6)


# phrases


def brute_phrases(rows: list[tuple], least: int, top: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang, piece = "und" if lang is None else lang, ""
        for c in (text or "").translate({i: i + 32 for i in range(65, 91)}) + "\n":
            if c not in ".,;:!?\n\x0b\x0c\r":
                piece += c
                continue
            words, piece = [w for w in piece.replace("\t", " ").split(" ") if w], ""
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    chosen = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= least:
            score, k = min((1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            chosen[lang, words] = (a, f[lang, words[:k]], f[lang, words[k:]], score)
    gone = {(lang, w[k : k + 2]) for (lang, w), v in chosen.items() if len(w) == 3 for k in (0, 1) if 100 * v[0] >= 50 * f[lang, w[k : k + 2]]}
    out = []
    for lang in n:
        kept = sorted(((-v[3], -v[0], " ".join(w).encode(), w, v) for (x, w), v in chosen.items() if x == lang and (x, w) not in gone), key=lambda r: r[:3])
        out += [(lang, i + 1, " ".join(w), *v[:3], n[lang], v[3]) for i, (_, _, _, w, v) in enumerate(kept[:top])]
    return sorted(out)


@pytest.mark.parametrize(("most_slots", "top"), [(2_000_000, 10_000), (40, 10_000), (2_000_000, 7)])
def test_phrases_against_brute_force(spark, most_slots, top):
    """In one round, in many rounds, and cut to the first few."""
    rng = random.Random(9)
    words = ["a", "B", "ç", "dd", "e-e", " ", "日本", "x1"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ";"]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None])) for _ in range(60)] + [(None, "en"), ("", None), ("a a a a a a a a", "en"), ("a a a a a a a a", "en"), ("unique words only", "fr")]
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase int, n int").repartition(4)
    got = sorted(tuple(r) for r in collocations(docs, least=3, top=top, most_slots=most_slots).collect())
    assert got == brute_phrases(rows, 3, top)
    assert len(got) > 20


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert collocations(docs).count() == 0
    got = sorted(tuple(r) for r in collocations(spark.createDataFrame(ODD, DOCS), least=50).collect())
    assert got == brute_phrases([(t, lang) for _, t, lang, _ in ODD], 50, 2000) and len(got) == 2


def test_perfect_hash_is_minimal_and_its_index_turns_others_away():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    assert sorted(PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))
    checks = rng.integers(0, 1 << 32, len(keys), dtype=np.uint64).astype(np.uint32)
    homes = checks.astype(np.uint8)
    index = Index(keys, checks, homes)
    own = index.slots(keys, checks)
    assert sorted(own.tolist()) == list(range(len(keys))) and (index.homes[own] == homes).all()
    assert (index.slots(keys, checks + np.uint32(1)) == -1).all()
    assert (index.slots(rng.integers(1 << 63, 1 << 64, 50_000, dtype=np.uint64), checks[:1].repeat(50_000)) == -1).all()
    same = Index(np.array([7, 7], np.uint64), np.array([1, 2], np.uint32), homes[:2])  # one key with two checks
    assert sorted(same.slots(np.array([7, 7, 7], np.uint64), np.array([1, 2, 3], np.uint32)).tolist()) == [-1, 0, 1]
    assert len(Index(keys[:0], checks[:0], homes[:0]).slots(keys, checks)) == len(keys)
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash(np.array([5, 5], np.uint64))


def test_candidates_hold_all_that_is_frequent(spark, sf):
    """Counting up to the bound before the shuffle loses nothing: as many candidates as there are frequent n-grams."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    got = {r["n"]: r["count"] for r in candidates(docs, 10).groupBy("n").count().collect()}
    rows = [tuple(r) for r in docs.collect()]
    f = Counter()
    for text, lang in rows:
        piece = ""
        for c in (text or "").translate({i: i + 32 for i in range(65, 91)}) + "\n":
            if c in ".,;:!?\n\x0b\x0c\r":
                words, piece = [w for w in piece.replace("\t", " ").split(" ") if w], ""
                f.update((k, lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
            else:
                piece += c
    assert got == dict(Counter(k for (k, _, _), n in f.items() if n >= 10))


def test_long_texts_are_cut_where_pieces_end():
    text = b"ab cd. " * 50 + b"x" * 200 + b". tail"
    parts = list(_parts(text, 64))
    assert b"".join(parts) == text and all(p.rstrip(b" ")[-1:] in b".x" or p == parts[-1] for p in parts) and len(parts) > 5
    assert list(_parts(b"x" * 500, 64)) == [b"x" * 500] and list(_parts(b"")) == [b""]


def test_cut_scores_are_exact():
    a = 3 * 10**11
    assert cut_scores([a + 1, a + 2, a + 5, a + 3, a + 4, a]) == min([(a, a + 1, a + 4, 10**6 * a * a // ((a + 1) * (a + 4))), (a, a + 3, a + 5, 10**6 * a * a // ((a + 3) * (a + 5)))], key=lambda x: x[3])
    assert cut_scores([10, 20, 0, 10, 0, 0]) == (10, 10, 20, 500_000)
    assert cut_scores([20, 20, 20, 20, 20, 20]) == (20, 20, 20, 10**6)


def test_texts_are_read_once_for_each_length_however_many_candidates(spark):
    read = spark.sparkContext.accumulator(0)

    def passed(stream):
        for batch in stream:
            read.add(batch.num_rows)
            yield batch

    rows = [(f"w{i} x{i} y{i}. " * 3, "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "text string, lang string").mapInArrow(passed, "text string, lang string")
    assert collocations(docs, least=3, most_slots=40).count() == 100
    assert read.value == 3 * len(rows)
