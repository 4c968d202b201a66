from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.functions import sequences as S
from motifspark.operators import features, fitting, likelihood, sampling
from motifspark.sources import readers

START, TARGETS = "gcatgaccatgtcgata", {3: "t", 7: "g", 11: "c"}
THETA = {"".join(m): (i % 7) / 7 for i, m in enumerate(itertools.product("acgt", repeat=3))}


def naive(start, targets, order, theta, k=3, left=1):
    text, done, out = list(start), set(), 0.0
    for pos in order:
        hazard = {p: math.exp(theta.get("".join(text[p - 1 - left : p - 1 - left + k]), 0.0)) for p in range(left + 1, len(text) - (k - 1 - left) + 1) if p not in done}
        out += math.log(hazard[pos]) - math.log(sum(hazard.values()))
        text[pos - 1] = targets[pos]
        done.add(pos)
    return out


def orders(spark, order, start=START, targets=TARGETS):
    rows = [(1, start, [(p, targets[p]) for p in order])]
    return spark.createDataFrame(rows, "sk long, gs string, mutations array<struct<pos:int,target:string>>")


def frame(spark, theta):
    return spark.createDataFrame(sorted(theta.items()), "motif string, theta double")


@pytest.mark.parametrize("order", list(itertools.permutations(TARGETS)))
def test_log_likelihood_of_an_order(spark, order):
    got = likelihood.log_likelihood(likelihood.risk_counts(orders(spark, order)), frame(spark, THETA)).first()["log_lik"]
    assert got == pytest.approx(naive(START, TARGETS, order, THETA))
    assert sampling.OrderScore(START, TARGETS, THETA, 3, 1)(order) == pytest.approx(got)


def test_sites_without_coefficient_have_hazard_one(spark):
    some = {m: t for m, t in THETA.items() if m[1] != "t"}
    got = likelihood.log_likelihood(likelihood.risk_counts(orders(spark, [7, 3])), frame(spark, some)).first()["log_lik"]
    assert got == pytest.approx(naive(START, TARGETS, [7, 3], some))


def test_gradient_and_hessian_match_differences(spark):
    counts = likelihood.risk_counts(orders(spark, [7, 3, 11])).cache()
    slope = {r[0]: r[1] for r in likelihood.gradient(counts, frame(spark, THETA)).collect()}
    second = {(r[0], r[1]): r[2] for r in likelihood.hessian(counts, frame(spark, THETA)).collect()}
    motif, step = "atg", 1e-4
    value = lambda by: naive(START, TARGETS, [7, 3, 11], THETA | {motif: THETA[motif] + by})
    assert slope[motif] == pytest.approx((value(step) - value(-step)) / (2 * step), abs=1e-6)
    assert second[motif, motif] == pytest.approx((value(step) - 2 * value(0) + value(-step)) / step**2, abs=1e-5)
    assert sum(slope.values()) == pytest.approx(0, abs=1e-9)


def test_gibbs_draws_orders_by_their_likelihood():
    drawn = Counter(map(tuple, sampling.gibbs(START, TARGETS, THETA, 3, 1, 10, 4000, 1, np.random.default_rng(1))))
    all_orders = list(itertools.permutations(TARGETS))
    p = np.exp([naive(START, TARGETS, o, THETA) for o in all_orders])
    share = np.array([drawn[o] for o in all_orders]) / 4000
    assert np.abs(share - p / p.sum()).max() < 0.04


def test_marginal_likelihood_by_samples_is_near_the_exact_sum():
    rng = np.random.default_rng(2)
    exact = sampling.marginal_log_lik(START, TARGETS, THETA, 3, 1, rng)
    near = sampling.marginal_log_lik(START, TARGETS, THETA, 3, 1, rng, 4000, exact=0)
    assert exact == pytest.approx(np.logaddexp.reduce([naive(START, TARGETS, o, THETA) for o in itertools.permutations(TARGETS)]))
    assert near == pytest.approx(exact, abs=0.1)


def test_simulation_mutates_a_share_of_the_sites(spark):
    genes = spark.createDataFrame([(i, START * 2) for i in range(20)], "gk long, gs string")
    rows = sampling.simulate_seqs(genes, frame(spark, THETA), share=0.1, copies=2).collect()
    assert len(rows) == 40
    for r in rows:
        assert len(r["mutations"]) == math.ceil(0.1 * (2 * len(START) - 2)) == sum(a != b for a, b in zip(r["gs"], r["es"], strict=True))


def test_lasso_fit_meets_its_conditions(spark):
    rows = [(i, START, [(p, TARGETS[p]) for p in o]) for i, o in enumerate(itertools.permutations(TARGETS))]
    counts = likelihood.risk_counts(spark.createDataFrame(rows, "sk long, gs string, mutations array<struct<pos:int,target:string>>"), 1, 0).cache()
    theta = fitting.fit_lasso(counts, list("acgt"), 0.05, rounds=40, tolerance=1e-7)
    slope = {r[0]: -r[1] / len(rows) for r in likelihood.gradient(counts, frame(spark, dict(zip("acgt", map(float, theta), strict=True)))).collect()}
    for m, t in zip("acgt", theta, strict=True):
        assert abs(slope.get(m, 0) + 0.05 * np.sign(t)) < 0.02 if t else abs(slope.get(m, 0)) < 0.06


def test_em_runs_to_the_end(spark):
    theta = fitting.monte_carlo_em(orders(spark, [7, 3, 11]), list("acgt"), 0.1, 1, 0, rounds=1, samples=2, m_rounds=2)
    assert theta.shape == (4,) and np.isfinite(theta).all()


def test_logistic_fit(spark):
    rows = [("aaa", i < 25) for i in range(100)] + [("ccc", i < 75) for i in range(100)]
    theta = fitting.fit_logistic(spark.createDataFrame(rows, "motif string, mutated boolean"), 0.0)
    assert theta["aaa"] == pytest.approx(-math.log(3), abs=1e-3) and theta["ccc"] == pytest.approx(math.log(3), abs=1e-3)


def test_fitch(spark):
    tree = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "parent_id int, child_id int")
    leaves = spark.createDataFrame([(2, "aa"), (3, "ac"), (4, "gc")], "node int, sequence string")
    got = {(r["node"], r["pos"]): r["bases"] for r in fitting.fitch(tree, leaves, 2).collect()}
    assert (got[1, 1], got[1, 2]) == (0b101, 0b10)
    assert (got[0, 1], got[0, 2]) == (0b1, 0b11)


def masked_by_hand(a, b, flank):
    """The first of two texts: unknown wherever either is, inner runs cut to the flank, letter by letter."""
    both = ["n" if x not in "acgt" or y not in "acgt" else x for x, y in zip(a, b, strict=True)]
    known = [i for i, x in enumerate(both) if x != "n"]
    out, run = [], 0
    for i, x in enumerate(both):
        run = run + 1 if x == "n" else 0
        if not known or i < known[0] or i > known[-1] or run <= flank:
            out.append(x)
    return "".join(out)


def test_masking_and_collapsing_unknown_bases(spark):
    rng = np.random.default_rng(31)
    texts = ["".join(rng.choice(list("acgtn-?"), 40, p=[0.16] * 4 + [0.2, 0.08, 0.08])) for _ in range(40)]
    pairs = list(zip(texts[::2], texts[1::2], strict=True)) + [("n" * 6, "acgtac"), ("acgt", "acgt")]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, a string, b string")
    clean = frame.select("i", S.disambiguate("a").alias("a"), S.disambiguate("b").alias("b"))
    for flank in (1, 2, 4):
        got = {r[0]: (r[1], r[2]) for r in clean.select("i", S.collapse_unknown(S.mask_both("a", "b"), flank), S.collapse_unknown(S.mask_both("b", "a"), flank)).collect()}
        assert got == {i: (masked_by_hand(a, b, flank), masked_by_hand(b, a, flank)) for i, (a, b) in enumerate(pairs)}


def test_motif_numbers(spark):
    frame = spark.createDataFrame([("aat",), ("ttt",), ("ant",)], "m string").select(S.motif_index("m").alias("i"))
    assert [r[0] for r in frame.collect()] == [3, 63, None]


def test_position_labels_may_repeat(spark):
    found = features.position_features(spark.range(30).select(F.col("id").alias("pos")), [3, 7, 8, 21, 26], ["x", "w", "y", "x"]).collect()
    assert [r["label"] for r in found] == [None] * 3 + ["x"] * 4 + ["w"] + ["y"] * 13 + ["x"] * 5 + [None] * 4
    assert {r["label"]: r["label_idx"] for r in found} == {None: None, "w": 0, "x": 1, "y": 2}


def test_readers(spark, tmp_path):
    (tmp_path / "genes.csv").write_text("germline_name,germline_sequence\ng1,ACGTx\n")
    (tmp_path / "seqs.csv").write_text("germline_name,sequence_name,sequence,species\ng1,s1,ACTT.,mouse\ng2,s2,AC,man\n")
    got = readers.read_gene_seq(spark, str(tmp_path / "genes.csv"), str(tmp_path / "seqs.csv")).collect()
    assert [(r["sequence"], r["germline_sequence"], r["species"]) for r in got] == [("acttn", "acgtn", "mouse")]
    (tmp_path / "a.fasta").write_text(">one text\nACG\nTT\n>two\nGG\n")
    assert {(r[0], r[1]) for r in readers.read_fasta(spark, str(tmp_path / "a.fasta")).collect()} == {("one", "acgtt"), ("two", "gg")}
    (tmp_path / "mut.csv").write_text('"motif" mutability\n"AAA" 1.0\n"AAC" 0\n"AAG" NA\n')
    assert {r[0]: r[1] for r in readers.read_mutability(spark, str(tmp_path / "mut.csv")).collect()} == {"aaa": 0.0, "aac": -math.inf, "aag": -math.inf}
    tree = {r["name"]: r for r in readers.read_newick(spark, "((a:1,b:2)c:3,d:4);").collect()}
    assert set(tree) == {"a", "b", "c", "d"} and tree["a"]["parent_id"] == tree["c"]["child_id"] and tree["d"]["dist"] == 4.0
