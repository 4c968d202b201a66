"""Queries over coefficients that are counted from the derived sequences.

A motif's coefficient x is its mutations per thousand of its sites, less the
62 that a sixteenth makes, in thousandths: whole numbers up to the last
division, so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from motifspark.functions import sequences as S
from motifspark.operators import features, statistics, tables
from motifspark.operators.fitting import kept
from motifspark.sources.derived import genes, seqs, table

from .registry import derived, register


def site_counts(spark, d, k: int = 3, left: int = 1):
    """(motif, target, n) of all sites with a full motif: some hundred rows, written once, so that a query that uses them twice reads the sequences once and joins don't wait for them."""
    return kept(features.site_counts(seqs(spark, d), k, left), "site-counts")


def by_motif(counts):
    """(motif, n, hits, theta)"""
    found = counts.groupBy("motif").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("target").isNotNull(), F.col("n"))), F.lit(0)).alias("hits"))
    return found.withColumn("theta", F.expr("((hits * 1000) div n - 62) / 1000.0D"))


def by_target(spark, counts):
    """(motif, target, possible, hits): all 256 pairs."""
    hits = counts.filter("target IS NOT NULL").select("motif", "target", F.col("n").alias("hits"))
    return features.possible_targets(spark, 3, 1).join(hits, ["motif", "target"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def counted(spark, d, k: int = 3, left: int = 1):
    """(motif, n, hits, theta)"""
    return by_motif(site_counts(spark, d, k, left))


def counted_targets(spark, d):
    """(motif, target, possible, hits): all 256 pairs."""
    return by_target(spark, site_counts(spark, d))


_IDX = "((instr('acgt', motif[1]) - 1) * 16 + (instr('acgt', motif[2]) - 1) * 4 + instr('acgt', motif[3]) - 1)"
_GRAMS = """,
    grams AS (SELECT mu, ec, lag(sc) OVER w || sc || lead(sc) OVER w AS motif FROM sites WINDOW w AS (PARTITION BY sk ORDER BY pos)),
    counted AS (SELECT motif, """ + _IDX + """ AS idx, count(*) AS n, count_if(mu)::BIGINT AS hits, ((count_if(mu)::BIGINT * 1000) // count(*) - 62) / 1000.0::DOUBLE AS x FROM grams WHERE motif IS NOT NULL GROUP BY motif),
    bases AS (SELECT sc AS base, count_if(mu)::BIGINT AS hits, ((count_if(mu)::BIGINT * 1000) // count(*) - 62) / 1000.0::DOUBLE AS x FROM sites GROUP BY sc),
    pairs AS (SELECT c.motif, c.idx, c.x, k, t.target, coalesce(h.hits, 0) AS hits FROM counted c, (SELECT k, substr('acgt', k + 1, 1) AS target FROM range(4) r(k)) t
        LEFT JOIN (SELECT motif, ec AS target, count(*) AS hits FROM grams WHERE mu AND motif IS NOT NULL GROUP BY ALL) h ON h.motif = c.motif AND h.target = t.target)"""


def _sql(statement: str) -> str:
    return derived("sites", _GRAMS + "\n" + statement).replace("\n,", ",")


@register("P20_motifs", _sql("SELECT idx::BIGINT AS motif_idx, motif, n FROM counted"))
def p20(spark, d):
    """The numbered motifs, with how many sites have each."""
    return features.motif_dimension(spark, 3).join(counted(spark, d), "motif").select("motif_idx", "motif", "n")


@register("W11_codon_frame", derived("genes", "SELECT codon_start::INT AS codon_start, count(*) AS n, count(DISTINCT substr(gs, codon_start, 3)) AS n_codons, count_if(gs[pos] = 'a')::BIGINT AS n_a FROM (SELECT gs, pos, pos - (pos - 1) % 3 AS codon_start FROM (SELECT gs, unnest(range(1, 64)) AS pos FROM genes)) GROUP BY 1"))
def w11(spark, d):
    """Sites by the codon that holds them."""
    found = features.sites(genes(spark, d), 1, 0).filter("pos <= 63").withColumn("codon_start", S.codon_start("pos"))
    codon = F.substring(F.col("gs"), F.col("codon_start"), F.lit(3))
    return found.groupBy("codon_start").agg(F.count("*").alias("n"), F.count_distinct(codon).alias("n_codons"), F.count_if(F.col("motif") == "a").alias("n_a"))


@register("J11_parameter_grid", "SELECT family, k, seed, n FROM (SELECT c_mktsegment AS family, count(*) AS n FROM customer GROUP BY 1), (VALUES (3::BIGINT), (5)) a(k), (SELECT i AS seed FROM range(3) t(i)) WHERE NOT (k = 5 AND seed > 1)")
def j11(spark, d):
    """A grid of the families that the table has, motif lengths and seeds, less some cells, with the genes of each."""
    sizes = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("family")).agg(F.count("*").alias("n"))
    families = [r[0] for r in sizes.select("family").limit(1000).collect()]  # the grid's values; more are no grid
    grid = tables.parameter_grid(spark, {"family": sorted(families), "k": [3, 5], "seed": [0, 1, 2]}, ~((F.col("k") == 5) & (F.col("seed") > 1)))
    return grid.join(sizes, "family").select("family", "k", "seed", "n")


@register("P19_nonzero_counts", _sql("SELECT count_if(abs(x) > 1e-6)::BIGINT AS n_nonzero, count(DISTINCT x) AS n_unique FROM counted"))
def p19(spark, d):
    return tables.nonzero_counts(counted(spark, d), "theta")


@register("W10_gap_aligned", "SELECT gk, sum(a3)::BIGINT AS total, max(a3)::BIGINT AS last FROM (SELECT gk, a2 + (a2 >= 40)::INT AS a3 FROM (SELECT gk, a1 + (a1 >= gk % 7 + 9)::INT AS a2 FROM (SELECT gk, i + (i >= gk % 5 + 2)::INT AS a1 FROM (SELECT c_custkey AS gk, unnest(range(64)) AS i FROM customer)))) GROUP BY gk")
def w10_gaps(spark, d):
    """Places of each gene among three gaps of its own."""
    gaps = F.array((F.col("gk") % 5 + 2).cast("int"), (F.col("gk") % 7 + 9).cast("int"), F.lit(40))
    places = genes(spark, d).select("gk", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return places.groupBy("gk").agg(F.sum(tables.gap_aligned(F.col("i"), gaps)).cast("long").alias("total"), F.max(tables.gap_aligned(F.col("i"), gaps)).cast("long").alias("last"))


@register("S1_nonzero_lines", _sql("SELECT row_number() OVER (ORDER BY x, motif)::INT AS place, printf('%.3f, (%s)', x, motif) AS line FROM counted WHERE abs(x) > 1e-6"))
def s1(spark, d):
    return tables.nonzero_lines(counted(spark, d), "motif", "theta")


_SE = "sqrt(hits::DOUBLE * (n - hits) / n) / n"


@register("IO16_interval_lines", _sql(f"SELECT row_number() OVER (ORDER BY x, motif)::INT AS place, printf('%.3f, [%.3f, %.3f] (%s)', x, x - 1.96 * {_SE}, x + 1.96 * {_SE}, motif) AS line FROM counted"))
def io16(spark, d):
    """Coefficients with the intervals of their shares."""
    se = F.sqrt(F.col("hits").cast("double") * (F.col("n") - F.col("hits")) / F.col("n")) / F.col("n")
    return tables.interval_lines(statistics.with_interval(counted(spark, d).withColumn("se", se), "theta", "se"), "motif", "lower", "theta", "upper")


@register("M11_aggregate_variance", _sql("""SELECT full_motif, round(sum(CASE WHEN a.i = b.i THEN a.h / 100.0 ELSE ((a.h * b.h) % 11) / 20.0 END)::DOUBLE, 6) AS variance
    FROM (SELECT motif AS full_motif, idx AS i, hits AS h FROM counted UNION ALL SELECT motif, 64 + instr('acgt', base) - 1, b.hits FROM counted JOIN bases b ON base = motif[2]) a
    JOIN (SELECT motif AS full_motif, idx AS i, hits AS h FROM counted UNION ALL SELECT motif, 64 + instr('acgt', base) - 1, b.hits FROM counted JOIN bases b ON base = motif[2]) b USING (full_motif) GROUP BY 1"""))
def m11(spark, d):
    """Variances of sums of a 3-mer's and its middle base's coefficients, with covariances made of their counts."""
    number = lambda text, k: F.conv(F.translate(text, "acgt", "0123"), 4, 10).cast("long") + (0 if k == 3 else 64)
    own = counted(spark, d).select("motif", number("motif", 3).alias("i"), "hits")
    bases = counted(spark, d, 1, 0).select(number("motif", 1).alias("i"), "hits")
    matches = own.select(F.col("motif").alias("full"), F.col("i").alias("feat_idx")).unionByName(own.select(F.col("motif").alias("full"), number(F.substring("motif", 2, 1), 1).alias("feat_idx")))
    both = own.select("i", "hits").unionByName(bases)
    # 68 coefficients: every pair of them is a cell of the matrix
    other = F.broadcast(both.select(F.col("i").alias("j"), F.col("hits").alias("more"), F.lit(1).alias("one")))
    cells = both.withColumn("one", F.lit(1)).join(other, "one")
    value = F.when(F.col("i") == F.col("j"), F.col("hits") / 100.0).otherwise(((F.col("hits") * F.col("more")) % 11) / 20.0)
    return statistics.aggregate_variance(matches, cells.select("i", "j", value.alias("value"))).select(F.col("full").alias("full_motif"), S.rounded("variance").alias("variance"))


@register("M13_possible_targets", _sql("SELECT motif, target, motif[2] <> target AS possible, hits FROM pairs"))
def m13(spark, d):
    """Which targets a motif may have, and how often it has each."""
    return counted_targets(spark, d).select("motif", "target", "possible", "hits")


@register("M14_theta_index", _sql("SELECT motif, target, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY target, motif) - 1 ELSE -1 END::BIGINT AS theta_idx FROM (SELECT *, hits % 3 > 0 AS ok FROM pairs)"))
def m14(spark, d):
    """Numbers of the wanted coefficients: those whose count isn't a multiple of three."""
    return statistics.theta_index(counted_targets(spark, d), "motif", "target", F.col("hits") % 3 > 0).select("motif", "target", "theta_idx")


@register("M16_target_probabilities", _sql("SELECT motif, target, round(exp(-t) / sum(exp(-t)) OVER (PARTITION BY motif), 6) AS probability FROM (SELECT motif, target, x + hits / 100.0::DOUBLE AS t FROM pairs WHERE motif[2] <> target)"))
def m16(spark, d):
    counts = site_counts(spark, d)
    rows = by_target(spark, counts).filter("possible").join(by_motif(counts).select("motif", "theta"), "motif").withColumn("theta", F.col("theta") + F.col("hits") / 100.0)
    return statistics.target_probabilities(rows.select("motif", "target", "theta"), "motif", "theta").select("motif", "target", S.rounded("probability").alias("probability"))


@register("M17_median_scaled", _sql("SELECT motif, round(x / (SELECT median(abs(x)) FROM counted WHERE abs(x) > 1e-6), 6) + 0.0 AS scaled FROM counted"))
def m17(spark, d):
    return statistics.median_scaled(counted(spark, d), "theta", "x").select("motif", S.rounded("x").alias("scaled"))


@register("IO13_padded_motifs", _sql("SELECT motif, upper(rpad('N' || motif, 5, 'N')) AS padded, n FROM counted"))
def io13(spark, d):
    return counted(spark, d).select("motif", tables.padded_motif("motif", 1, 2, 2).alias("padded"), "n")


@register("F8_reindexed_features", _sql("SELECT motif, (row_number() OVER (ORDER BY motif) - 1)::INT AS feat_idx FROM counted WHERE x >= 0"))
def f8(spark, d):
    """Features that mutate less than a sixteenth of the time go; the others are numbered anew."""
    return features.without_features(features.motif_dimension(spark, 3), counted(spark, d).filter("theta < 0")).select("motif", "feat_idx")


@register("E3_soft_threshold", _sql("SELECT idx::BIGINT AS motif_idx, round(greatest(x - 0.005, 0) + least(x + 0.005, 0), 6) + 0.0 AS value FROM counted"))
def e3(spark, d):
    rows = features.motif_dimension(spark, 3).join(counted(spark, d), "motif")
    return rows.select("motif_idx", S.rounded(S.soft_threshold(F.col("theta"), 0.005)).alias("value"))


@register("J7_aggregate_theta", _sql("SELECT motif, round(c.x + b.x, 6) + 0.0 AS theta FROM counted c JOIN bases b ON base = motif[2]"))
def j7(spark, d):
    blocks = [(1, 1, counted(spark, d, 1, 0).select("motif", "theta")), (0, 3, counted(spark, d).select("motif", "theta"))]
    return features.aggregate_theta(features.motif_dimension(spark, 3), blocks).withColumn("theta", S.rounded("theta"))


@register("J8_fused_edges", _sql("SELECT m.motif AS motif, n.motif AS other, round(abs(m.x - n.x), 6) AS apart FROM counted m JOIN counted n ON hamming(m.motif, n.motif) = 1"))
def j8(spark, d):
    """How far the coefficients of motifs that differ in one base are apart."""
    values = counted(spark, d).select("motif", "theta")
    ends = features.neighbours(values).join(values, "motif").join(values.select(F.col("motif").alias("other"), F.col("theta").alias("than")), "other")
    return ends.select("motif", "other", S.rounded(F.abs(F.col("theta") - F.col("than"))).alias("apart"))
