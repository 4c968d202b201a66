"""What queries write, broadcast or compute twice: figures that must not grow faster than the input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from motifspark.operators import features, hazards, models, statistics, trees
from motifspark.plans.model_queries import THREE
from motifspark.sources.derived import ends, seqs

EDGES, SEQUENCES = "tree long, parent_id long, child_id long", "tree long, node long, sequence string"


def test_ancestors_write_a_row_for_each_node(spark, monkeypatch):
    """Sets were rows by node and position: 64 times as many."""
    edges = spark.createDataFrame([(t, *e) for t in range(3) for e in [(0, 1), (1, 2), (1, 3), (0, 4)]], EDGES)
    sequences = spark.createDataFrame([(t, n, "acgtnacgt"[n:] + "acgtnacgt"[:n]) for t in range(3) for n in (2, 3, 4)], SEQUENCES)
    written, kept = [], trees.kept

    def counted(frame, name):
        out = kept(frame, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(trees, "kept", counted)
    assert trees.impute_ancestors(edges, sequences).count() == 15
    assert max(written) == 15


def test_likelihoods_of_trees_are_not_joined_back(spark, sf):
    """Pairs came from two joins of all sequences, were written, and their likelihoods were joined to them by name."""
    plan = __spark_entry__.queries()["T3_tree_likelihoods"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "edge = " not in plan


def test_known_bases_are_not_cleaned(spark, monkeypatch):
    """Pairs without an unknown base went through the column functions that fill them, place by place."""
    monkeypatch.setattr(trees, "cleaned_pair", lambda *a: F.raise_error(F.lit("cleaned")))
    rows = spark.createDataFrame([(1, "acgtacgtacgt", "ACGTACTTACGT")], "key long, start string, end string")
    assert [(r["gs"], r["mutations"][0]["pos"]) for r in trees.observed_pairs(rows, 2, 1, "key").collect()] == [("acgtacgtacgt", 7)]


def test_pairs_are_cleaned_once(spark):
    """The optimiser put the cleaning in wherever a filter or a field named it."""
    rows = spark.createDataFrame([(1, "acgtnacgtacgt", "acgttacgaacgt")], "key long, start string, end string")
    plan = trees.observed_pairs(rows, 2, 1, "key", most_unknown=0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("md5(") <= 4


@pytest.mark.parametrize("name", ["L8_penalised_objective", "E10_fused_objective", "W7_running_denominators", "F6_step_motifs", "F6_step_features"])
def test_steps_are_not_dealt_out_site_by_site(spark, sf, name):
    """Rows by step and motif were shuffled; a row's likelihood and counts come from the row."""
    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


@pytest.mark.parametrize("name", ["M16_target_probabilities", "M11_aggregate_variance", "J7_aggregate_theta", "E12_substitution_model", "E12_mutability_model"])
def test_counts_are_read_once(spark, sf, name):
    """No join or broadcast of these waits for a pass over the sequences, which took longer than a broadcast may."""
    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan


def test_ends_are_those_of_the_sequences(spark, sf):
    """They need no order of mutations."""
    assert ends(spark, sf).exceptAll(seqs(spark, sf).select("sk", "gk", "es")).count() == 0 and ends(spark, sf).count() == seqs(spark, sf).count()


def test_runs_are_found_in_their_row(spark, sf):
    assert "Window" not in __spark_entry__.queries()["W5_run_lengths"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_sites_are_counted_with_any_letters(spark):
    rows = spark.createDataFrame([("acgn", "aCgn"), ("aég", "aég"), ("acg", "a"), ("acg", None), (None, "acg"), ("ac", "ac")], "gs string, es string")
    got = sorted(map(tuple, features.site_counts(rows, 3, 1).collect()), key=str)
    assert got == sorted([("acg", "C", 1), ("cgn", None, 1), ("aég", None, 1), ("acg", "", 1), ("acg", None, 1)], key=str)


def test_compact_steps_give_the_same_sums(spark, sf):
    """A fit's passes worked every sequence out anew."""
    orders = seqs(spark, sf).select("sk", "gs", "mutations").limit(200).cache()
    compact = hazards.compacted(orders, THREE)
    assert "_risk_3_1" in compact.columns
    theta = np.random.default_rng(1).normal(size=(64, 1))
    for features_, values in ((THREE, theta), (THREE.without([0, 5, 63]), theta[[i for i in range(64) if i not in (0, 5, 63)]])):
        want, got = models.point_at(orders, features_, values, True), models.point_at(compact, features_, values, True)
        assert got.n == want.n and got.log_lik == pytest.approx(want.log_lik)
        assert np.allclose(got.slope, want.slope, atol=1e-8) and np.allclose(got.bend, want.bend, atol=1e-8)


def test_probabilities_of_large_values(spark):
    """Counts grow with the tables, and exp(-count / 100) is 0 from 9,000,000 sequences on: the shares were divided by 0."""
    values = {"acg": [1800.0, 1801.0, 1803.0], "cgt": [-1800.0, -1799.0, 5000.0], "gta": [0.5, 0.25, 0.0]}
    rows = spark.createDataFrame([(m, t, x) for m, own in values.items() for t, x in zip("acg", own, strict=True)], "motif string, target string, theta double")
    got = {(r["motif"], r["target"]): r["probability"] for r in statistics.target_probabilities(rows, "motif", "theta").collect()}
    for motif, own in values.items():
        share = np.exp(min(own) - np.array(own))
        assert [got[motif, t] for t in "acg"] == pytest.approx(share / share.sum())
