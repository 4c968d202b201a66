"""Queries of the sequence layer: cleaning, differences, k-mers, codons, ordered computations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifspark.functions import sequences as S
from motifspark.operators import features
from motifspark.sources.derived import genes, seqs, table

from .registry import derived, register

#: Known hot and cold spots as IUPAC motifs, first match first.
SPOTS = (("WRC", "hot"), ("WA", "hot"), ("SYC", "cold"))


def _unknown(name: str) -> str:
    """SQL of a sequence of 32 with unknown bases, from a digest."""
    return f"translate(md5('{name}' || c_custkey::VARCHAR), '0123456789abcdef', 'acgtnnnnnnacgtac')"


def _with_unknown(spark, d):
    key = F.col("c_custkey").cast("string")
    text = lambda name: F.translate(F.md5(F.concat(F.lit(name), key)), "0123456789abcdef", "acgtnnnnnnacgtac")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("gk"), text("p").alias("a"), text("q").alias("b"))


@register("P1_disambiguate", "SELECT p_partkey, regexp_replace(lower(p_name), '[^acgtn]', 'n', 'g') AS cleaned FROM part")
def p1(spark, d):
    return table(spark, d, "part").select("p_partkey", S.disambiguate("p_name").alias("cleaned"))


@register("P2_strip_unknown", f"SELECT c_custkey AS gk, regexp_replace({_unknown('p')}, '^n+|n+$', '', 'g') AS stripped FROM customer")
def p2(spark, d):
    return _with_unknown(spark, d).select("gk", S.strip_unknown("a").alias("stripped"))


@register("P3_mutate", derived("genes", "SELECT gk, substr(gs, 1, gk % 64) || 'n' || substr(gs, gk % 64 + 2) AS mutated FROM genes"))
def p3(spark, d):
    return genes(spark, d).select("gk", S.mutate("gs", (F.col("gk") % 64 + 1).cast("int"), F.lit("n")).alias("mutated"))


@register("P4_reverse_complement", derived("genes", "SELECT gk, reverse(translate(upper(gs), 'AGCTYRSWMKBDHVN', 'TCGARYSWKMVHDBN')) AS other FROM genes"))
def p4(spark, d):
    return genes(spark, d).select("gk", S.reverse_complement("gs").alias("other"))


@register("P5_hot_cold_spots", derived("genes", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(upper(substr(gs, p)), '^[AT][AG][C]') OR regexp_matches(upper(substr(gs, p)), '^[AT][A]') THEN 'hot' WHEN regexp_matches(upper(substr(gs, p)), '^[CG][CT][C]') THEN 'cold' ELSE 'other' END AS label FROM (SELECT gs, unnest(range(1, 63)) AS p FROM genes)) GROUP BY label"))
def p5(spark, d):
    label = F.lit("other")
    for motif, name in reversed(SPOTS):
        label = F.when(F.upper("motif").rlike("^" + S.iupac_pattern(motif)), name).otherwise(label)
    return features.sites(genes(spark, d), 3, 0).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


_MASKED = f"SELECT c_custkey AS gk, list_aggregate([CASE WHEN b[i] = 'n' THEN 'n' ELSE a[i] END FOR i IN range(1, 33)], 'string_agg', '') AS m FROM (SELECT c_custkey, {_unknown('p')} AS a, {_unknown('q')} AS b FROM customer)"


@register("P6_mask_and_collapse", f"SELECT gk, m AS masked, CASE WHEN trim(m, 'n') = '' THEN m ELSE regexp_extract(m, '^n*') || regexp_replace(trim(m, 'n'), 'n{{3,}}', 'nn', 'g') || regexp_extract(m, 'n*$') END AS collapsed FROM ({_MASKED})")
def p6(spark, d):
    masked = _with_unknown(spark, d).select("gk", S.mask_both("a", "b").alias("masked"))
    return masked.withColumn("collapsed", S.collapse_unknown("masked", 2))


@register("P7_mutations", derived("sites", "SELECT sk, pos::INT AS pos, sc AS base, ec AS target FROM sites WHERE mu"))
def p7(spark, d):
    found = seqs(spark, d).withColumn("pos", F.explode(S.differing("gs", "es")))
    at = lambda text: F.substring(F.col(text), F.col("pos"), F.lit(1))
    return found.select("sk", "pos", at("gs").alias("base"), at("es").alias("target"))


@register("P9_single_difference", derived("sites", "SELECT sk, CASE WHEN count_if(mu) = 1 THEN max(CASE WHEN mu THEN pos END) END::INT AS pos FROM sites GROUP BY sk"))
def p9(spark, d):
    return seqs(spark, d).select("sk", S.single_difference("gs", "es").alias("pos"))


@register("P10_hamming", derived("ends", "SELECT sk, hamming(gs, es)::BIGINT AS n FROM ends"))
def p10(spark, d):
    return seqs(spark, d).select("sk", S.hamming("gs", "es").alias("n"))


@register("P12_sequence_filters", derived("ends", "SELECT sk FROM ends WHERE hamming(gs, es) / 64.0 >= 0.03 AND hamming(gs, es) / 64.0 < 0.1 AND family IN ('BUILDING', 'MACHINERY')"))
def p12(spark, d):
    share = S.hamming("gs", "es") / 64.0
    return seqs(spark, d).filter((share >= 0.03) & (share < 0.1) & F.col("family").isin("BUILDING", "MACHINERY")).select("sk")


@register("P12_known_length", f"SELECT c_custkey AS gk, length(replace({_unknown('p')}, 'n', ''))::BIGINT AS n FROM customer WHERE length(replace({_unknown('p')}, 'n', '')) > 16")
def p12_length(spark, d):
    return _with_unknown(spark, d).select("gk", S.known_length("a").alias("n")).filter("n > 16")


@register("P13_mutated_pairs", derived("ends", "SELECT sk, gs, es FROM ends WHERE gs <> es"))
def p13(spark, d):
    return seqs(spark, d).filter("gs <> es").select("sk", "gs", "es")


@register("P14_reject_unknown_inside", f"SELECT c_custkey AS gk FROM customer WHERE NOT contains(trim({_unknown('p')}, 'n'), 'n')")
def p14(spark, d):
    return _with_unknown(spark, d).filter(~S.strip_unknown("a").contains("n")).select("gk")


@register("P15_productive", derived("genes", "SELECT gk, len(list_filter([substr(gs, 1 + 3 * i, 3) FOR i IN range(21)], lambda x: x IN ('taa', 'tag', 'tga'))) = 0 AS productive FROM genes"))
def p15(spark, d):
    codons = F.expr("transform(sequence(0, 20), i -> substr(gs, 1 + 3 * i, 3))")
    return genes(spark, d).select("gk", (~F.exists(codons, lambda x: x.isin("taa", "tag", "tga"))).alias("productive"))


@register("P18_gene_family", "SELECT p_partkey, regexp_extract(p_brand || '*01', '^[^*S-]*') AS family FROM part")
def p18(spark, d):
    return table(spark, d, "part").select("p_partkey", S.gene_family(F.concat("p_brand", F.lit("*01"))).alias("family"))


@register("W1_sliding_motifs", derived("genes", "SELECT motif, count(*) AS n FROM (SELECT substr(gs, p, 5) AS motif FROM (SELECT gs, unnest(range(1, 61)) AS p FROM genes)) GROUP BY motif"))
def w1(spark, d):
    return features.sites(genes(spark, d), 5, 2).groupBy("motif").agg(F.count("*").alias("n"))


@register("W2_neighbourhood", derived("sites", "SELECT m.sk, m.pos::INT AS pos, count(*) AS n_neighbours FROM sites m JOIN sites s ON s.sk = m.sk AND s.pos BETWEEN m.pos - 2 AND m.pos + 2 AND s.pos <> m.pos AND NOT coalesce(s.stp < m.stp, false) WHERE m.mu GROUP BY m.sk, m.pos"))
def w2(spark, d):
    """The sites within two of a mutation that haven't mutated before it."""
    steps = seqs(spark, d).select("sk", "mutations", F.posexplode("mutations").alias("i", "m")).select("sk", "m.pos", F.expr("slice(transform(mutations, x -> x.pos), 1, i)").alias("done"))
    near = F.expr("filter(sequence(pos - 2, pos + 2), p -> p <> pos AND p BETWEEN 1 AND 64 AND NOT array_contains(done, p))")
    return steps.select("sk", "pos", F.size(near).cast("long").alias("n_neighbours")).filter("n_neighbours > 0")


@register("W3_state_after_two", derived("sites", "SELECT sk, string_agg(CASE WHEN stp <= 2 THEN ec ELSE sc END, '' ORDER BY pos) AS state FROM sites GROUP BY sk"))
def w3(spark, d):
    return seqs(spark, d).select("sk", features.state_after(F.col("gs"), F.col("mutations"), F.lit(2)).alias("state"))


@register("W4_lagged_differences", "SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER w AS gap, (sum(o_orderkey) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def w4(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.lag("o_orderkey").over(w)).alias("gap"), F.sum("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


@register("W5_run_lengths", derived("genes", ", p AS (SELECT gk, pos, substr(gs, pos, 1) AS b FROM (SELECT *, unnest(range(1, 65)) AS pos FROM genes)), r AS (SELECT gk, b, pos - row_number() OVER (PARTITION BY gk, b ORDER BY pos) AS isle FROM p) SELECT b AS base, n AS run, count(*) AS times FROM (SELECT gk, b, isle, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL"))
def w5(spark, d):
    # a row's runs come from the row itself: nothing is sorted or shuffled but counts
    runs = genes(spark, d).select(F.explode(F.regexp_extract_all("gs", F.lit(r"((.)\2*)"), F.lit(1))).alias("x"))
    return runs.groupBy(F.substring("x", 1, 1).alias("base"), F.length("x").cast("long").alias("run")).agg(F.count("*").alias("times"))


#: The standard genetic code, codons in the order t, c, a, g of each base.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_AMINO = "substr('" + CODE + "', (instr('tcag', substr({0}, 1, 1)) - 1) * 16 + (instr('tcag', substr({0}, 2, 1)) - 1) * 4 + instr('tcag', substr({0}, 3, 1)), 1)"


@register("M19_codon_mutations", derived("sites", ", c AS (SELECT sk, (pos - 1) // 3 AS codon, string_agg(sc, '' ORDER BY pos) AS a, string_agg(ec, '' ORDER BY pos) AS b FROM sites WHERE pos <= 63 GROUP BY ALL) SELECT CASE WHEN y = '*' THEN 'Stop' WHEN x = y THEN 'S' ELSE 'R' END AS kind, count(*) AS n FROM (SELECT " + _AMINO.format("a") + " AS x, " + _AMINO.format("b") + " AS y FROM c WHERE a <> b) GROUP BY 1"))
def m19(spark, d):
    """Codons that changed: silent, replaced or stopped."""
    codons = seqs(spark, d).select("gs", "es", F.explode(F.sequence(F.lit(1), F.lit(61), F.lit(3))).alias("p")).select(F.expr("substr(gs, p, 3)").alias("a"), F.expr("substr(es, p, 3)").alias("b")).filter("a <> b")
    amino = codons.select(F.expr(_AMINO.format("a")).alias("x"), F.expr(_AMINO.format("b")).alias("y"))
    return amino.groupBy(F.when(F.col("y") == "*", "Stop").when(F.col("x") == F.col("y"), "S").otherwise("R").alias("kind")).agg(F.count("*").alias("n"))
