"""Queries of the survival model: features, likelihoods, residuals, sampled and fitted quantities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifspark.functions.sequences import motif_index, motif_text, rounded, soft_threshold
from motifspark.operators import features, fitting, hazards, likelihood, models, sampling
from motifspark.operators.generators import FeatureSet, MotifFeatures
from motifspark.sources.derived import genes, seqs

from .registry import derived, register


def theta(spark, k: int = 3) -> DataFrame:
    """(motif, theta): the motif's number modulo 7, over 7."""
    return features.motif_dimension(spark, k).select("motif", ((F.col("motif_idx") % 7) / 7.0).alias("theta"))


#: All 3-mers around their middle, with the coefficients of theta().
THREE = FeatureSet([MotifFeatures(3, 1)])
THREE_THETA = (np.arange(64) % 7 / 7.0)[:, None]


def named(found: DataFrame, *columns: str) -> DataFrame:
    """Numbers of 3-mers as their texts."""
    out = found
    for c in columns:
        out = out.withColumn(c, motif_text(F.col(c), 3))
    return out


def target_theta(spark) -> DataFrame:
    """(motif, target, theta): the shared coefficient plus a tenth of the target's number; own bases are impossible."""
    targets = features.possible_targets(spark, 3, 1).filter("possible").join(F.broadcast(theta(spark)), "motif")
    return targets.select("motif", "target", (F.col("theta") + (F.instr(F.lit("acgt"), F.col("target")) - 1) * 0.1).alias("theta"))


@register("F1_motif_features", derived("genes", "SELECT ((instr('acgt', m[1]) - 1) * 16 + (instr('acgt', m[2]) - 1) * 4 + instr('acgt', m[3]) - 1)::BIGINT AS feat_idx, count(*) AS n FROM (SELECT substr(gs, p, 3) AS m FROM (SELECT gs, unnest(range(1, 63)) AS p FROM genes)) GROUP BY 1"))
def f1(spark, d):
    return features.sites(genes(spark, d), 3, 1).groupBy(motif_index("motif").alias("feat_idx")).agg(F.count("*").alias("n"))


@register("F2_position_features", derived("genes", "SELECT CASE WHEN p < 10 OR p >= 40 THEN 'A' ELSE 'B' END AS label, (CASE WHEN p < 10 OR p >= 40 THEN 0 ELSE 1 END)::INT AS label_idx, count(*) AS n FROM (SELECT unnest(range(2, 64)) AS p FROM genes) GROUP BY ALL"))
def f2(spark, d):
    return features.position_features(features.sites(genes(spark, d), 3, 1), [0, 10, 40, 100], ["A", "B", "A"]).groupBy("label", "label_idx").agg(F.count("*").alias("n"))


_HIER = derived("genes", """,
    p AS (SELECT gk, gs, unnest(range(1, 65)) AS pos FROM genes),
    parts AS (
        SELECT gk, pos, (instr('acgt', substr(gs, pos, 1)) - 1) AS feat_idx FROM p
        UNION ALL SELECT gk, pos, 4 + (instr('acgt', substr(gs, pos - 1, 1)) - 1) * 16 + (instr('acgt', substr(gs, pos, 1)) - 1) * 4 + instr('acgt', substr(gs, pos + 1, 1)) - 1 FROM p WHERE pos BETWEEN 2 AND 63
        UNION ALL SELECT gk, pos, 68 + (instr('acgt', substr(gs, pos, 1)) - 1) * 16 + (instr('acgt', substr(gs, pos + 1, 1)) - 1) * 4 + instr('acgt', substr(gs, pos + 2, 1)) - 1 FROM p WHERE pos <= 62)
    SELECT feat_idx::BIGINT AS feat_idx, count(*) AS n, sum(pos)::BIGINT AS places FROM parts GROUP BY 1""").replace("\n,", ",")


@register("F3_hierarchical_features", _HIER)
def f3(spark, d):
    found = features.hierarchical_features(genes(spark, d), [(1, 0), (3, 1), (3, 0)], "gk")
    return found.groupBy("feat_idx").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("places"))


@register("F4_combined_features", derived("genes", "SELECT substr(gs, p - 1, 3) AS motif, CASE WHEN p < 32 THEN 'left' ELSE 'right' END AS label, count(*) AS n FROM (SELECT gs, unnest(range(2, 64)) AS p FROM genes) GROUP BY ALL"))
def f4(spark, d):
    return features.position_features(features.sites(genes(spark, d), 3, 1), [0, 32, 100], ["left", "right"]).groupBy("motif", "label").agg(F.count("*").alias("n"))


@register("F6_step_motifs", derived("risk", "SELECT step, motif, count(*) AS n, count_if(hit)::BIGINT AS hits FROM risk GROUP BY ALL"))
def f6(spark, d):
    found = hazards.step_counts(seqs(spark, d), THREE)
    return named(found, "feat_idx").select("step", F.col("feat_idx").alias("motif"), "n", "hits")


@register("L1_log_likelihood", derived("rated", "SELECT sk, count(*) AS n_steps, round(sum(theta - ln(den)), 6) + 0.0 AS log_lik FROM rated WHERE hit GROUP BY sk"))
def l1(spark, d):
    return hazards.row_likelihoods(seqs(spark, d), THREE, [THREE_THETA]).select("sk", "n_steps", rounded("log_lik_0").alias("log_lik"))


@register("L3_target_log_likelihood", derived("risk", """, r AS (
        SELECT *, sum(exp((idx % 7) / 7.0::DOUBLE) * (list_sum([exp(0.1::DOUBLE * k) FOR k IN [0, 1, 2, 3] IF k + 1 <> instr('acgt', motif[2])]))) OVER (PARTITION BY sk, step) AS den FROM risk)
    SELECT sk, count(*) AS n_steps, round(sum((idx % 7) / 7.0::DOUBLE + 0.1::DOUBLE * (instr('acgt', target) - 1) - ln(den)), 6) + 0.0 AS log_lik FROM r WHERE hit GROUP BY sk""").replace("\n,", ","))
def l3(spark, d):
    """A shared coefficient for each motif, and for each target a tenth of its number."""
    by_target = np.hstack([THREE_THETA, np.tile(np.arange(4) / 10.0, (64, 1))])
    return hazards.row_likelihoods(seqs(spark, d), THREE, [by_target]).select("sk", "n_steps", rounded("log_lik_0").alias("log_lik"))


@register("L4_gradient", derived("rated", "SELECT motif, round(sum(hit::INT - h / den), 5) + 0.0 AS gradient FROM rated GROUP BY motif"))
def l4(spark, d):
    found = hazards.sums(seqs(spark, d), THREE, THREE_THETA).filter("i >= 0 AND j < 0 AND value <> 0")
    return named(found, "i").select(F.col("i").alias("motif"), rounded("value", 5).alias("gradient"))


_SHARES = """, shares AS (SELECT sk, step, motif AS f, sum(h) / max(den) AS s, count_if(hit) AS hits FROM rated GROUP BY sk, step, motif)"""


def _base_theta(spark):
    return features.motif_dimension(spark, 1).select("motif", ((F.col("motif_idx") + 1) / 5.0).alias("theta"))


def _base_counts(spark, d):
    inner = likelihood.risk_counts(seqs(spark, d)).withColumn("motif", F.substring("motif", 2, 1))
    return inner.groupBy("sk", "step", "motif").agg(F.sum("n").alias("n"), F.max("hit").alias("hit"), F.max("target").alias("target"))


@register("L5_hessian", derived("rated", _SHARES + " SELECT a.f AS f1, b.f AS f2, round(sum(a.s * b.s - CASE WHEN a.f = b.f THEN a.s ELSE 0 END), 5) + 0.0 AS value FROM shares a JOIN shares b USING (sk, step) GROUP BY ALL").replace("\n,", ","))
def l5(spark, d):
    """Second derivatives by all pairs of 3-mers."""
    found = hazards.sums(seqs(spark, d), THREE, THREE_THETA, second=True).filter("i >= 0 AND j >= 0")
    return named(found, "i", "j").select(F.col("i").alias("f1"), F.col("j").alias("f2"), rounded("value", 5).alias("value"))


@register("L6_score_products", derived("rated", _SHARES + ", g AS (SELECT sk, f, sum(hits - s) AS g FROM shares GROUP BY sk, f) SELECT a.f AS f1, b.f AS f2, round(sum(a.g * b.g), 5) + 0.0 AS value FROM g a JOIN g b USING (sk) GROUP BY ALL").replace("\n,", ","))
def l6(spark, d):
    """Products of sequences' gradients by all pairs of 3-mers."""
    found = hazards.score_sums(seqs(spark, d), THREE, THREE_THETA)
    return named(found, "i", "j").select(F.col("i").alias("f1"), F.col("j").alias("f2"), rounded("value", 5).alias("value"))


@register("L7_log_lik_ratio", derived("rated", ", steps AS (SELECT sk, step, count(*) AS n, max(den) AS den, max(CASE WHEN hit THEN theta END) AS theta FROM rated GROUP BY sk, step) SELECT sk, round(sum(theta - ln(den) + ln(n)), 6) + 0.0 AS ratio FROM steps GROUP BY sk").replace("\n,", ","))
def l7(spark, d):
    found = hazards.row_likelihoods(seqs(spark, d), THREE, [THREE_THETA, np.zeros((64, 1))])
    return found.select("sk", rounded(F.col("log_lik_0") - F.col("log_lik_1")).alias("ratio"))


@register("L8_penalised_objective", derived("rated", ", ll AS (SELECT sk, sum(theta - ln(den)) AS ll FROM rated WHERE hit GROUP BY sk) SELECT round(-avg(ll) + 0.1 * (SELECT sum((i % 7) / 7.0::DOUBLE) FROM range(64) t(i)), 6) AS objective FROM ll").replace("\n,", ","))
def l8(spark, d):
    return hazards.penalised_objective(seqs(spark, d), THREE, THREE_THETA, 0.1).withColumn("objective", rounded("objective"))


@register("L9_residuals", derived("rated", ", r AS (SELECT sk, site, sum(hit::INT - h / den) AS residual FROM rated GROUP BY sk, site) SELECT sk, count(*) AS n_sites, round(sum(residual), 6) + 0.0 AS total, round(max(residual), 6) + 0.0 AS greatest FROM r GROUP BY sk").replace("\n,", ","))
def l9(spark, d):
    found = hazards.site_residuals(seqs(spark, d), THREE, THREE_THETA)
    return found.groupBy("sk").agg(F.count("*").alias("n_sites"), rounded(F.sum("residual")).alias("total"), rounded(F.max("residual")).alias("greatest"))


@register("M18_residual_profile", derived("rated", ", r AS (SELECT sk, site, sum(hit::INT - h / den) AS residual FROM rated GROUP BY sk, site) SELECT p::INT AS site, count(residual) AS n, round(avg(residual), 6) + 0.0 AS residual FROM range(1, 65) t(p) LEFT JOIN r ON site = p GROUP BY p").replace("\n,", ","))
def m18(spark, d):
    places = spark.range(1, 65).select(F.col("id").cast("int").alias("site"))
    found = hazards.site_residuals(seqs(spark, d), THREE, THREE_THETA).groupBy("site").agg(F.count("*").alias("n"), F.avg("residual").alias("residual"))
    return places.join(found, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("n"), rounded("residual").alias("residual"))


@register("E12_mutability_counts", derived("sites", ", m AS (SELECT mu, lag(sc, 2) OVER w || lag(sc) OVER w || sc || lead(sc) OVER w || lead(sc, 2) OVER w AS motif FROM sites WINDOW w AS (PARTITION BY sk ORDER BY pos)) SELECT motif, count(*) AS n, count_if(mu)::BIGINT AS mutated, round(count_if(mu) / count(*)::DOUBLE, 6) AS mutability FROM m WHERE motif IS NOT NULL GROUP BY motif").replace("\n,", ","))
def e12(spark, d):
    found = features.sites(seqs(spark, d), 5, 2)
    counts = found.groupBy("motif").agg(F.count("*").alias("n"), F.count_if(F.substring("gs", F.col("pos"), F.lit(1)) != F.substring("es", F.col("pos"), F.lit(1))).alias("mutated"))
    return counts.withColumn("mutability", rounded(F.col("mutated") / F.col("n")))


@register("U9_substitution_shares", derived("sites", ", c AS (SELECT sc, ec, count(*) AS n FROM sites WHERE mu GROUP BY sc, ec) SELECT sc AS base, ec AS target, n, round(n / sum(n) OVER (PARTITION BY sc)::DOUBLE, 6) AS share FROM c").replace("\n,", ","))
def u9(spark, d):
    found = seqs(spark, d).select("gs", F.inline("mutations")).groupBy(F.substring("gs", F.col("pos"), F.lit(1)).alias("base"), "target").agg(F.count("*").alias("n"))
    return found.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("base"))))


@register("E9_logistic_counts", derived("sites", ", m AS (SELECT mu, lag(sc) OVER w || sc || lead(sc) OVER w AS motif FROM sites WINDOW w AS (PARTITION BY sk ORDER BY pos)) SELECT motif, count(*) AS n, round(sum(ln(1 / (1 + exp(CASE WHEN mu THEN -1 ELSE 1 END * -2.0::DOUBLE)))), 4) + 0.0 AS score FROM m WHERE motif IS NOT NULL GROUP BY motif").replace("\n,", ","))
def e9(spark, d):
    """Log-likelihood by motif of the logistic model whose every coefficient is -2."""
    found = features.sites(seqs(spark, d), 3, 1).withColumn("mu", F.substring("gs", F.col("pos"), F.lit(1)) != F.substring("es", F.col("pos"), F.lit(1)))
    counts = found.groupBy("motif", "mu").agg(F.count("*").alias("n"))
    one = F.ln(1 / (1 + F.exp(F.when(F.col("mu"), 2.0).otherwise(-2.0))))
    return counts.groupBy("motif").agg(F.sum("n").alias("n"), rounded(F.sum(F.col("n") * one), 4).alias("score"))


@register("E9_logistic_fit", derived("sites", ", m AS (SELECT mu, lag(sc) OVER w || sc || lead(sc) OVER w AS motif FROM sites WINDOW w AS (PARTITION BY sk ORDER BY pos)), c AS (SELECT motif, count_if(mu)::DOUBLE AS h, count(*)::DOUBLE AS n, (SELECT count(*) FROM m WHERE motif IS NOT NULL) * 0.0001::DOUBLE AS t FROM m WHERE motif IS NOT NULL GROUP BY motif) SELECT motif, round(CASE WHEN h - t > n / 2 THEN ln(h - t) - ln(n - h + t) WHEN n - h - t > n / 2 THEN ln(h + t) - ln(n - h - t) ELSE 0 END, 6) + 0.0 AS theta FROM c").replace("\n,", ","))
def e9_fit(spark, d):
    found = features.sites(seqs(spark, d), 3, 1).withColumn("mutated", F.substring("gs", F.col("pos"), F.lit(1)) != F.substring("es", F.col("pos"), F.lit(1)))
    return fitting.logistic_theta(found, 1e-4).withColumn("theta", rounded("theta"))


@register("G1_gibbs_orders")
def g1(spark, d):
    drawn = sampling.gibbs_orders(seqs(spark, d), theta(spark), burn_in=1, samples=1)
    return drawn.select("sk", "sample", F.array_join(F.transform("mutations", lambda x: x["pos"]), ",").alias("positions"))


@register("G3_marginal_log_likelihood")
def g3(spark, d):
    return sampling.marginal_likelihoods(seqs(spark, d), theta(spark))


@register("Z5_star_tree")
def z5(spark, d):
    return sampling.simulate_seqs(genes(spark, d), theta(spark), share=0.05).select("gk", "copy", "gs", "es", F.size("mutations").alias("n_mutations"))


@register("E2_lasso_fit")
def e2(spark, d):
    """Motif coefficients of the known orders, by proximal gradient."""
    rows = fitting.kept(hazards.compacted(seqs(spark, d).select("gs", "mutations"), THREE), "orders")
    middle, points = np.arange(64) // 4 % 4, {}

    def at(x: np.ndarray) -> models.Point:
        """A base's coefficient is that of all 3-mers around it; a pass gives both value and slope."""
        if (name := x.tobytes()) not in points:
            points[name] = models.point_at(rows, THREE, x[middle][:, None])
        return points[name]

    theta = np.zeros(4)
    if total := at(theta).n:
        theta = fitting.lasso_descent(lambda x: -at(x).log_lik / total, lambda x: -np.bincount(middle, at(x).slope, 4) / total, theta, 0.01, 5, 4.0, 1e-4)
    return spark.createDataFrame([(m, float(t) + 0.0) for m, t in zip("acgt", theta, strict=True)], "motif string, theta double")
