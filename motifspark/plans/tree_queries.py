"""Queries over trees: pairs along edges made ready, ancestors of fewest mutations, likelihoods of trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from motifspark.functions.sequences import rounded
from motifspark.operators import trees
from motifspark.operators.generators import FeatureSet, MotifFeatures
from motifspark.sources import datasets
from motifspark.sources.derived import ends, genes, seqs

from .comparison_queries import _HEX, _PAIR32, _pair32
from .registry import derived, register

_STRING = "list_aggregate([{} FOR i IN range(1, length({}) + 1)], 'string_agg', '')"
_FILL = f"CASE WHEN {{0}}[i] = 'n' THEN substr('acgt', 1 + (instr('{_HEX}', substr(md5(gk || '-' || i), 1, 1)) - 1) % 4, 1) ELSE {{0}}[i] END"


@register("T1_observed_pairs", f"""
    WITH masked AS (SELECT gk, {_STRING.format("CASE WHEN b[i] = 'n' THEN 'n' ELSE a[i] END", "a")} AS a, {_STRING.format("CASE WHEN a[i] = 'n' THEN 'n' ELSE b[i] END", "a")} AS b FROM ({_PAIR32})),
    cut AS (SELECT gk, regexp_replace(trim(a, 'n'), 'n{{3,}}', 'nn', 'g') AS a, regexp_replace(trim(b, 'n'), 'n{{3,}}', 'nn', 'g') AS b, length(trim(a, 'n')) AS long, length(replace(a, 'n', '')) AS known FROM masked WHERE trim(a, 'n') <> ''),
    clean AS (SELECT gk, {_STRING.format(_FILL.format("a"), "a")} AS a, {_STRING.format(_FILL.format("b"), "b")} AS b, 1 - known / long::DOUBLE AS unknown FROM cut),
    flags AS (SELECT *, length(a) AS n, {_STRING.format("CASE WHEN a[i] <> b[i] THEN '1' ELSE '0' END", "a")} AS f FROM clean),
    ends AS (SELECT *, length(regexp_extract(f[1:n // 2], '^(?:0{{0,1}}1)*')) + 2 AS lo, n - length(regexp_extract(reverse(f[n // 2 + 1:n]), '^(?:1)*')) - 1 AS hi FROM flags),
    ready AS (SELECT gk, substr(a, lo - 1, hi - lo + 3) AS gs, substr(b, lo - 1, hi - lo + 3) AS es, unknown FROM ends WHERE hi >= lo AND unknown <= 0.3)
    SELECT gk, gs, es, round(unknown, 6) + 0.0 AS unknown, coalesce(list_aggregate([i || es[i] FOR i IN range(3, length(gs)) IF gs[i] <> es[i]], 'string_agg', ','), '') AS mutations FROM ready""")
def t1_observed(spark, d):
    """Pairs with unknown bases, cleaned alike and trimmed to flanks of two bases before and one after."""
    found = trees.observed_pairs(_pair32(spark, d), 2, 1, "gk", "a", "b", most_unknown=0.3)
    shown = F.array_join(F.transform("mutations", lambda m: F.concat(m["pos"].cast("string"), m["target"])), ",")
    return found.select("gk", "gs", "es", rounded("unknown").alias("unknown"), shown.alias("mutations"))


def _families(spark, d):
    """A tree for each gene: the gene at the root (node 0), three inner nodes without a sequence, and its sequences as leaves."""
    rows = seqs(spark, d).select(F.col("gk").alias("tree"), (F.col("sk") + 10).alias("leaf"), (F.col("sk") % 3 + 1).alias("inner"))
    leaves = ends(spark, d).select(F.col("gk").alias("tree"), (F.col("sk") + 10).alias("node"), F.col("es").alias("sequence"))
    edges = rows.select("tree", F.col("inner").alias("parent_id"), F.col("leaf").alias("child_id")).unionByName(rows.select("tree", F.lit(0).cast("long").alias("parent_id"), F.col("inner").alias("child_id")).distinct())
    roots = genes(spark, d).select(F.col("gk").alias("tree"), F.lit(0).cast("long").alias("node"), F.col("gs").alias("sequence")).join(rows.select("tree").distinct(), "tree", "left_semi")
    return edges, roots.unionByName(leaves)


_IMPUTED = """,
    counts AS (SELECT gk, sk % 3 + 1 AS node, pos, max(sc) AS root, count_if(ec = 'a') AS na, count_if(ec = 'c') AS nc, count_if(ec = 'g') AS ng, count_if(ec = 't') AS nt FROM sites GROUP BY ALL),
    sets AS (SELECT *, list_filter([CASE WHEN na = m THEN 'a' END, CASE WHEN nc = m THEN 'c' END, CASE WHEN ng = m THEN 'g' END, CASE WHEN nt = m THEN 't' END], lambda x: x IS NOT NULL) AS bases FROM (SELECT *, greatest(na, nc, ng, nt) AS m FROM counts)),
    picked AS (SELECT *, CASE WHEN list_contains(bases, root) THEN root ELSE bases[1 + ('0x' || substr(md5(gk || '-' || node || '-' || pos), 1, 6))::BIGINT % len(bases)] END AS base FROM sets)
    """


@register("T2_imputed_ancestors", derived("sites", _IMPUTED + "SELECT gk AS tree, node::BIGINT AS node, string_agg(base, '' ORDER BY pos) AS sequence FROM picked GROUP BY gk, node").replace("\n,", ","))
def t2(spark, d):
    edges, sequences = _families(spark, d)
    return trees.impute_ancestors(edges, sequences).filter("node BETWEEN 1 AND 3")


@register("T2_mutations_needed", derived("sites", _IMPUTED + "SELECT gk AS tree, sum((base <> root)::INT + na + nc + ng + nt - m)::BIGINT AS n_mutations FROM picked GROUP BY gk").replace("\n,", ","))
def t2_needed(spark, d):
    edges, sequences = _families(spark, d)
    return trees.mutations_needed(edges, trees.impute_ancestors(edges, sequences))


@register("T3_tree_likelihoods")
def t3(spark, d):
    """The likelihood of each gene's tree with its imputed ancestors, under 3-mer coefficients."""
    edges, sequences = _families(spark, d)
    return trees.pairs_likelihoods(trees.imputed_pairs(edges, sequences), FeatureSet([MotifFeatures(3, 1)]), (np.arange(64) % 7 / 7.0)[:, None], samples=50, clean=True)


def _members(spark, d):
    rows = seqs(spark, d)
    return rows.select(F.col("gk").cast("string").alias("germline_name"), F.col("gs").alias("germline_sequence"), F.col("sk").cast("string").alias("sequence_name"), F.col("es").alias("sequence"))


_MEMBERS = "SELECT gk::VARCHAR AS germline_name, gs AS germline_sequence, sk::VARCHAR AS sequence_name, es AS sequence FROM (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY gk ORDER BY {}md5('0-' || sk::VARCHAR)) = 1) WHERE gs <> es"


@register("D1_random_member", derived("ends", _MEMBERS.format("")))
def d1_random(spark, d):
    """One sequence of each family by chance; families whose pick has no mutation go."""
    return datasets.one_for_each_family(_members(spark, d), False)


@register("D1_most_mutated_member", derived("ends", _MEMBERS.format("hamming(gs, es) DESC, ")))
def d1_most(spark, d):
    return datasets.one_for_each_family(_members(spark, d), True)
