"""Each operator against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.llm import components as C
from motifspark.llm import ctw, media, queries
from motifspark.llm.decontaminate import contamination_report, decontaminate
from motifspark.llm.jaccard_join import jaccard_components
from motifspark.llm.language_id import fit_languages, identify
from motifspark.llm.line_dedup import dedup_lines
from motifspark.llm.packing import pack, plan_packing
from motifspark.llm.quality import fit_quality, isotonic, score_quality
from motifspark.llm.tokenizing import Encoder, spliced_count, token_counts
from motifspark.llm.url_filters import Rule, judge_urls, literal_tokens

ODD = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "word", None), (4, "word", None), (None, "word two three four five six", "y"), (5, "Ärger " * 20000, "y"), (6, "a|b c,d", "y")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and a column whose name clashes with the operators' own."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"score": F.lit(1), "shard": F.lit("s"), "length": F.lit(3), "places_cut": F.lit(0), "block": F.lit("b")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def closure(links, nodes):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def ctw_by_hand(train, text, depth):
    """log10 probability of a text by the weighted tree of the training texts, node by node."""
    pad = [0xFF] * depth
    counts = defaultdict(lambda: [0, 0])
    steps = lambda raw: [(tuple((pad + list(raw) + [0xFF])[i : i + depth][::-1]), b, j, (b >> (7 - j)) & 1) for i, b in enumerate(list(raw) + [0xFF]) for j in range(8)]
    for raw in train:
        for context, b, j, bit in steps(raw):
            for d in range(depth + 1):
                counts[context[:d], j, b >> (8 - j)][bit] += 1
    kids = defaultdict(set)
    for context, j, head in list(counts):
        if context:
            kids[context[:-1], j, head].add((context, j, head))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weigh(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[0]) == depth else np.logaddexp(own, sum(weigh(k) for k in kids[node])) - math.log(2)
        return memo[node]

    total = 0.0
    for context, b, j, bit in steps(text):
        p = None
        for d in range(depth, -1, -1):
            node = (context[:d], j, b >> (8 - j))
            have = counts.get(node, [0, 0])
            own = (have[bit] + 0.5) / (sum(have) + 1)
            if d == depth:
                p = own
            else:
                w = math.exp(kt(*have) - math.log(2) - weigh(node)) if sum(have) else 0.5
                p = w * own + (1 - w) * p
        total += math.log10(p)
    return total


def test_context_tree_matches_a_tree_built_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(["abracadabra", "banana band", "Abra", None, "", "zebra abra"])]
    got = {r.doc_id: r for r in ctw.corpus_scores(spark.createDataFrame(rows, "doc_id long, text string"), depth=3, block=F.lit(0)).collect()}
    train = [lower(t).encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for i, t in rows:
        assert got[i].score == pytest.approx(ctw_by_hand(train, lower(t).encode(), 3), abs=1e-3)


def test_context_tree_counts_and_base(spark, docs, texts):
    got = {r.doc_id: r for r in queries.op1_context_tree(spark, "/root/testdata/sf0.001").collect()}
    counts = Counter(t for i, x in texts if zlib.crc32(str(i).encode()) % 7 != 2 for t in [*words(x), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for i, x in texts:
        own = [*words(x), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(t in counts for t in own), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))
        assert got[i].score < 0 and got[i].n_bytes == len((x or "").encode())


def test_jaccard_components_match_all_pairs(spark, docs, texts):
    def shingles(x):
        w = words(x)
        return {tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set()

    sets = {i: shingles(x) for i, x in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) > 0]
    want = closure(links, sets)
    got = jaccard_components(docs, 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()} and len(got) == len(sets)
    assert any(i != c for i, c in want.items())


def test_line_dedup_keeps_one_of_near_equal_lines(spark):
    base = "the committee found that several of the older bridges along the northern river need repair before winter comes again this year"
    rows = [(1, f"{base}\nfirst own line of text"), (2, f"second own line here\n{base.upper()}"), (3, base + "s"), (4, "a line that nobody else has at all"), (5, None), (6, "")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "second own line here", 4: rows[3][1], 5: None, 6: ""}


def test_decontamination_cuts_passages_and_drops_documents(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    filler = " ".join(f"f{i}" for i in range(100))
    rows = [(1, f"{filler} {passage.upper()} {filler}"), (2, passage), (3, filler), (4, None), (5, "tiny item")]
    tests = spark.createDataFrame([(7, passage), (8, "tiny item"), (9, None), (None, "f1 f2")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_hit, r.n_items) for r in contamination_report(docs, tests).collect()}
    assert found == {1: (12, 1), 2: (12, 1), 3: (0, 0), 4: (0, 0), 5: (2, 1)}
    kept = {r.doc_id: r.text for r in decontaminate(docs, tests).collect()}
    assert set(kept) == {1, 3, 4} and "W5" not in kept[1] and kept[3] == filler


def test_url_rules(spark):
    urls = ["https://Example.org/en/12?q", "http://a.example.org/es/x", "http://x.com/fr/", "http://x.com/de/y#z", "no scheme", None, "ftp://notcom/fr/", "http://com/DE/", "http://x.net/?utm_source=1"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [
        ("example.org", "/en/12", "example.org/en/1", "block"), ("a.example.org", "/es/x", "example.org/es/", "block"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/y", "com/de/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("notcom", "/fr/", None, "allow"), ("com", "/DE/", None, "allow"), ("x.net", "/", None, "block"),
    ]
    assert Rule("allow", "org/").path == "/"


def test_literal_tokens_of_patterns():
    want = {r"[?&]utm_[a-z]+=": {"utm"}, r"://blog\.": {"blog"}, r"/login\b": {"login"}, r"blog": set(), r"/a(?:b|c)/": set(), r"/(shop)/sale-\d+/": {"shop", "sale"}, r"/xs?/": set(), r"/ad[sx]/b/": {"b"}, r"[^a]foo/": set(), r"\Aftp:": {"ftp"}}
    assert {x: literal_tokens(x) for x in want} == want


def test_many_rules_and_patterns_match_a_scan_of_all(spark):
    import random

    rng = random.Random(2)
    hosts = [f"{rng.choice('abcdefgh')}{rng.randint(0, 40)}.{rng.choice(['com', 'org', 'net'])}" for _ in range(300)]
    rules = {f"{h}/{rng.choice(['', 'en/', 'de/', 'en/1', 'x-'])}" for h in hosts for _ in range(8)} | {"com/", "org/de/"}
    rules = [Rule(rng.choice(["allow", "block"]), x) for x in sorted(rules)]
    patterns = [rf"/w{k}\b" for k in range(200)] + [r"[?&]q\d=", r"(?:ad|promo)s/"]
    urls = [f"http://{rng.choice(['', 'www.', 'A.'])}{rng.choice(hosts)}/{rng.choice(['', 'en/', 'de/2', 'en/12', 'x-y', f'W{rng.randint(0, 300)}', 'ads/', 'a?q1=2'])}" for _ in range(600)]

    def scan(url):
        host, path = re.match(r"http://([^/]*)([^?]*)", url).groups()
        host = host.lower()
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            best = max(fits, key=lambda r: (len(r.name), r.action, r.name))
            return host, path, best.name, best.action
        return host, path, None, "block" if any(re.search(p, url.lower()) for p in patterns) else "allow"

    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame, rules, patterns).collect()}
    assert got == {k: scan(x) for k, x in enumerate(urls)}
    assert judge_urls(frame.limit(0), rules, patterns).count() == 0


def test_media_payloads_come_back(spark, texts):
    got = {r.doc_id: r for r in queries.op7_webp_media(spark, "/root/testdata/sf0.001").collect()}
    for i, x in texts:
        data = (x or "").encode()
        padded = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_token_counts_match_the_library(spark, docs, texts, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    count = lambda x: len(plain.encode(x or "", add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, queries.tokenizer_path()).collect()} == {i: count(x) for i, x in texts}
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts(odd, queries.tokenizer_path(), huge=1000, overlap=8).collect())
    assert got == Counter((i, count(x)) for i, x, _ in ODD)


def test_overlaps_widen_where_nothing_is_stable():
    own = Encoder(queries.tokenizer_path())
    text = "word " * 50 + "x" * 700 + " tail" * 100
    n, widened = spliced_count(text, own.boundaries, 200, 16)
    assert n == len(own.tokenizer.encode(text, add_special_tokens=False).ids) and widened > 0


def test_packing_is_gapless_and_whole(spark, docs, texts, odd):
    for frame, n in ((docs, len(texts)), (odd, len(ODD))):
        rows = pack(frame, queries.tokenizer_path(), 2048).collect()
        by_sequence, by_doc = defaultdict(list), defaultdict(int)
        for r in rows:
            by_sequence[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id] += r.piece == 0
        assert sum(by_doc.values()) == n
        for own in by_sequence.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r.length for r in rows)
        assert len(by_sequence) <= 1.1 * -(-total // 2048) + 2


def test_packing_plan_places_every_piece_once():
    counts = {2048: 3, 1500: 7, 1024: 5, 900: 11, 500: 20, 48: 30, 1: 9}
    spans, n = plan_packing(counts, 2048)
    for length, many in counts.items():
        own = sorted((s.first, s.count) for s in spans if s.length == length)
        assert sum(c for _, c in own) == many and [a for a, _ in own] == [sum(c for _, c in own[:k]) for k in range(len(own))]
    assert n <= 1.15 * sum(k * v for k, v in counts.items()) / 2048 + 1


def test_pieces_are_the_librarys_ids(spark, docs, texts, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    for frame, own in ((docs, texts), (odd, [(i, x) for i, x, _ in ODD])):
        want = Counter()
        for i, x in own:
            ids = np.array([*plain.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
            want.update((i, k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512)))
        got = pack(frame, queries.tokenizer_path(), 512, 0).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert pack(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_language_model_matches_dense_algebra(spark, docs):
    """Features and ridge weights against kernels and normal equations computed from sets of byte runs."""
    model = fit_languages(docs, landmarks=24, most_rows=300)
    grams = lambda x: {x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}
    sample = docs.filter("lang IS NOT NULL AND length(text) > 0").limit(12).collect()
    raw = [lower(r.text).encode() for r in sample]
    x = model.features(raw)
    kernel = np.array([[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in raw] for a in raw])
    own = np.linalg.norm(x, axis=1)
    assert (own <= 1 + 1e-3).all() and (x @ x.T <= kernel + 0.15).all()
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model).collect()}
    values = x @ model.weights
    for r, v in zip(sample, values, strict=True):
        assert got[r.doc_id] == (model.langs[int(v.argmax())], pytest.approx(min(max(float(v.max()), 0), 1), abs=1e-5))


def test_samples_do_not_depend_on_the_run(spark, odd, docs):
    """Repeated ids with different texts: bounded samples are the same whatever the order of rows."""
    few = docs.select((F.col("doc_id") % 7).alias("doc_id"), "text", "lang")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int")
    one, other = (f(few.repartition(n)) for f, n in ((lambda d: fit_languages(d, most_rows=40, landmarks=8), 3), (lambda d: fit_languages(d, most_rows=40, landmarks=8), 5)))
    assert np.allclose(one.weights, other.weights, atol=1e-4)
    one, other = (fit_quality(few.repartition(n), labels, most_rows=40, features=10) for n in (3, 5))
    assert np.allclose(one.weights, other.weights, atol=1e-6)


def test_language_accuracy_held_out(spark, docs):
    got = identify(docs, fit_languages(docs)).filter("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und' AND length(text) > 40").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.85


def test_quality_accuracy_held_out(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    more = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    rows = score_quality(more, fit_quality(more, labels)).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.8


def test_isotonic_is_the_least_squares_monotone_fit():
    """Against the min-max formula: the largest over beginnings of the smallest mean over ends."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        values = rng.integers(0, 2, n).astype(float)
        x, y = isotonic(np.arange(n, dtype=float), values)
        fit = [max(min(values[a : b + 1].mean() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        assert (np.diff(y) > 0).all() and len(x) == len(y) == len(set(np.round(fit, 9)))
        assert y == pytest.approx(sorted(set(np.round(fit, 9))))


def test_components_find_the_smallest_node(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3), (100, 101)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_odd_rows_and_empty_tables(spark, odd, sf):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    tests = spark.createDataFrame([(1, "word two three"), (2, None), (3, "")], "item_id long, text string")
    for frame, n in ((odd, len(ODD)), (odd.limit(0), 0)):
        assert ctw.corpus_scores(frame, block=F.lit(0)).count() == n
        assert contamination_report(frame, tests).count() == n
        assert contamination_report(frame, tests.limit(0)).filter("contaminated").count() == 0
        assert identify(frame, fit_languages(frame)).count() == n
        assert jaccard_components(frame).count() == n
        assert score_quality(frame, fit_quality(frame, labels)).count() == n
        assert token_counts(frame, queries.tokenizer_path()).count() == n
        assert media.media_digest(frame).count() == n
        assert judge_urls(frame.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))).count() == n
        assert pack(frame, queries.tokenizer_path()).filter("piece = 0").count() == n
        left = dedup_lines(frame)
        assert left.columns == frame.columns and left.count() <= n
        assert decontaminate(frame, tests).columns == frame.columns
