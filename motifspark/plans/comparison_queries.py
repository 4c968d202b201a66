"""Queries of model comparison, allocation, trees, flanks and reports; each calls an operator of the package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from motifspark.functions import sequences as S
from motifspark.operators import features, hazards, likelihood, proximal, statistics, tables
from motifspark.operators.fitting import kept
from motifspark.sources.derived import genes, seqs, spread, table

from .model_queries import THREE, THREE_THETA, target_theta, theta
from .registry import derived, register
from .table_queries import _PAIRS, _pairs

_HEX = "0123456789abcdef"
_U = "(('0x' || substr(md5('{0}' || {1}), 1, 6))::BIGINT / 16777216.0::DOUBLE)"
_BASE = "substr('acgt', 1 + ({0})::INT, 1)"
_TRIPLES = "SELECT i::BIGINT AS idx, " + " || ".join(_BASE.format(x) for x in ("i // 16", "(i // 4) % 4", "i % 4")) + " AS motif FROM range(64) t(i)"


@register("J2_suffixed_join", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity AS l_quantity_truth FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber) WHERE a.l_quantity > 10 AND b.l_discount < 0.05")
def j2(spark, d):
    items = table(spark, d, "lineitem")
    left = items.filter("l_quantity > 10").select("l_orderkey", "l_linenumber", "l_quantity")
    right = items.filter("l_discount < 0.05").select("l_orderkey", "l_linenumber", "l_quantity")
    return tables.suffixed_join(left, right, ["l_orderkey", "l_linenumber"], "_truth")


@register("J3_chained_join", "SELECT c_nationkey AS nation, n_name, n_customers, n_suppliers FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey")
def j3(spark, d):
    count = lambda name, key, to: table(spark, d, name).groupBy(F.col(key).alias("nation")).agg(F.count("*").alias(to))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return tables.chained_join(count("customer", "c_nationkey", "n_customers"), [count("supplier", "s_nationkey", "n_suppliers"), names], "nation")


@register("J9_risk_sets", derived("risk", "SELECT sk, step, count(*) AS n_at_risk, min(site)::INT AS first_site FROM risk GROUP BY sk, step"))
def j9(spark, d):
    found = likelihood.risk_sites(seqs(spark, d)).groupBy("sk", "step").agg(F.count("*").alias("n_at_risk"), F.min("site").alias("first_site"))
    return found.withColumn("step", F.col("step").cast("long"))


@register("A1_clusters", derived("seqs", "SELECT gk, count(*) AS n, min(sk) AS first_member, max(sk) AS last_member FROM seqs0 GROUP BY gk"))
def a1(spark, d):
    return tables.cluster_summary(seqs(spark, d), "gk", "sk")


@register("A4_mean_report", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(sqrt(var_pop(value) / count(value)), 6) AS se, printf('%.3f (%.3f)', avg(value), sqrt(var_pop(value) / count(value))) AS report FROM events GROUP BY event_type")
def a4(spark, d):
    found = statistics.mean_report(table(spark, d, "events"), "value", ["event_type"])
    return found.withColumns({c: S.rounded(c) for c in ("mean", "sd", "se")})


_BINNED = "(SELECT event_type, (floor(value / 20) * 1.0)::DOUBLE AS truth, (user_id % 10)::DOUBLE AS fitted FROM events)"


@register("A5_error_table", f"WITH c AS (SELECT event_type, fitted AS x, truth AS y, count(*) AS n FROM {_BINNED} GROUP BY ALL), k AS (SELECT a.event_type, sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(a.n * b.n * abs(sign(a.x - b.x)))::DOUBLE * sum(a.n * b.n * abs(sign(a.y - b.y)))::DOUBLE) AS kendall FROM c a JOIN c b ON a.event_type = b.event_type GROUP BY 1) SELECT event_type, round(sqrt(sum((fitted - truth) ** 2)), 4) AS error, round(max(kendall), 6) + 0.0 AS kendall FROM {_BINNED} JOIN k USING (event_type) GROUP BY event_type")
def a5(spark, d):
    events = table(spark, d, "events").select("event_type", F.floor(F.col("value") / 20).cast("double").alias("truth"), (F.col("user_id") % 10).cast("double").alias("fitted"))
    found = statistics.error_table(events, "fitted", "truth", ["event_type"])
    return found.select("event_type", S.rounded("error", 4).alias("error"), S.rounded("kendall").alias("kendall"))


@register("A9_grouped_ratios", "WITH r AS (SELECT o_custkey, o_orderkey, (o_orderkey % 17) / 16.0::DOUBLE - 0.5 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rep FROM orders) SELECT rep::INT AS rep, round(sum(v) / (SELECT count(DISTINCT o_custkey) FROM orders), 6) + 0.0 AS value FROM r GROUP BY rep")
def a9(spark, d):
    ratios = table(spark, d, "orders").select("o_custkey", "o_orderkey", ((F.col("o_orderkey") % 17) / 16.0 - 0.5).alias("v"))
    return statistics.grouped_ratios(ratios, "o_custkey", "o_orderkey", "v").withColumn("value", S.rounded("value"))


@register("A10_allocation", f"WITH p AS (SELECT n_name, n_regionkey + 1 AS f, sum(n_regionkey + 1) OVER (ORDER BY n_name) AS hi FROM nation), t AS (SELECT sum(f) AS t FROM p), o AS (SELECT o_orderkey, {_U.format('a', 'o_orderkey')} AS u FROM orders) SELECT n_name, count(*) AS n, min(o_orderkey) AS least FROM o, t, p WHERE u >= (hi - f) / t AND u < hi / t GROUP BY n_name")
def a10(spark, d):
    prevalence = table(spark, d, "nation").select("n_name", (F.col("n_regionkey") + 1).alias("freq"))
    drawn = tables.allocate(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", prevalence, "n_name", "freq")
    return drawn.groupBy("n_name").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


@register("A11_unique_counts", derived("seqs", "SELECT family, count(DISTINCT gs) AS n_naive, count(DISTINCT gk) AS n_genes FROM seqs0 GROUP BY family"))
def a11(spark, d):
    return seqs(spark, d).groupBy("family").agg(F.countDistinct("gs").alias("n_naive"), F.countDistinct("gk").alias("n_genes"))


@register("A15_consensus", derived("sites", ", v AS (SELECT gk, pos, min(sc) AS gl, min_by(ec, md5('v' || sk || '-' || (pos - 1))) FILTER (ec <> sc) AS other FROM sites GROUP BY gk, pos) SELECT gk, string_agg(coalesce(other, gl), '' ORDER BY pos) AS consensus FROM v GROUP BY gk"))
def a15(spark, d):
    return tables.consensus(seqs(spark, d), "gk", "gs", "es", "sk")


@register("A16_fold_categories", "SELECT c_mktsegment, row_number() OVER (ORDER BY md5('c' || c_mktsegment))::INT AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def a16(spark, d):
    return tables.distinct_categories(table(spark, d, "customer"), "c_mktsegment")


@register("P16_resampled_families", f"WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <= 12), r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders), w AS (SELECT o_custkey, draw, floor({_U.format('r', chr(39) + chr(39) + ' || o_custkey || ' + chr(39) + '-' + chr(39) + ' || draw')} * n)::INT AS place FROM s, range(3) t(draw)) SELECT o_custkey, draw::INT AS draw, o_orderkey FROM w JOIN r USING (o_custkey, place)")
def p16(spark, d):
    return tables.resampled_families(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 12, 3)


_PAIR32 = f"SELECT c_custkey AS gk, a, list_aggregate([CASE WHEN substr(q, i, 1) IN ('0', '1') THEN 'a' WHEN substr(q, i, 1) = '2' THEN 'n' ELSE a[i] END FOR i IN range(1, 33)], 'string_agg', '') AS b FROM (SELECT c_custkey, translate(md5('p' || c_custkey::VARCHAR), '{_HEX}', 'acgtacgtnacgtacg') AS a, md5('q' || c_custkey::VARCHAR) AS q FROM customer)"


def _pair32(spark, d):
    """Pairs of 32 bases, some unknown in either or both."""
    key = F.col("c_custkey").cast("string")
    a = F.translate(F.md5(F.concat(F.lit("p"), key)), _HEX, "acgtacgtnacgtacg")
    digit = lambda x, p: F.substring(x["q"], p, F.lit(1))
    letters = lambda x: F.transform(F.sequence(F.lit(1), F.lit(32)), lambda p: F.when(digit(x, p).isin("0", "1"), "a").when(digit(x, p) == "2", "n").otherwise(F.substring(x["a"], p, F.lit(1))))
    b = F.array_join(S.bound({"a": a, "q": F.md5(F.concat(F.lit("q"), key))}, letters), "")
    return spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("gk"), a.alias("a"), b.alias("b"))


_FLAGS = f"SELECT gk, a, b, list_aggregate([CASE WHEN a[i] <> b[i] OR a[i] = 'n' OR b[i] = 'n' THEN '1' ELSE '0' END FOR i IN range(1, 33)], 'string_agg', '') AS f FROM ({_PAIR32})"


@register("P7_trimmed_flanks", f"SELECT gk, lo::INT AS lo, hi::INT AS hi, substr(a, lo + 1, greatest(hi - lo, 0)) AS start_inside FROM (SELECT gk, a, length(regexp_extract(f[1:16], '^(?:0{{0,1}}1)*')) + 2 AS lo, 32 - length(regexp_extract(reverse(f[17:32]), '^(?:0{{0,1}}1)*')) - 2 AS hi FROM ({_FLAGS}))")
def p7_trimmed(spark, d):
    found = _pair32(spark, d).withColumn("x", S.trimmed("a", "b", 2, 2)).select("gk", "a", F.col("x.start").alias("lo"), F.col("x.end").alias("hi"))
    return found.select("gk", "lo", "hi", F.expr("substr(a, lo + 1, greatest(hi - lo, 0))").alias("start_inside"))


@register("P6_filled", f"WITH m AS (SELECT gk, list_aggregate([CASE WHEN b[i] = 'n' THEN 'n' ELSE a[i] END FOR i IN range(1, 33)], 'string_agg', '') AS m FROM ({_PAIR32})), e AS (SELECT gk, m, length(regexp_extract(m, '^n*')) AS lo, 32 - length(regexp_extract(m, 'n*$')) AS hi, trim(m, 'n') AS t FROM m) SELECT gk, list_aggregate([CASE WHEN m[i] = 'n' AND i > lo AND i <= hi THEN substr('acgt', 1 + (instr('{_HEX}', substr(md5(gk || '-' || i), 1, 1)) - 1) % 4, 1) ELSE m[i] END FOR i IN range(1, 33)], 'string_agg', '') AS filled, round(CASE WHEN t = '' THEN 0 ELSE 1 - length(replace(t, 'n', '')) / length(t)::DOUBLE END, 6) + 0.0 AS unknown FROM e")
def p6_filled(spark, d):
    masked = _pair32(spark, d).select("gk", S.mask_both("a", "b").alias("m"))
    return masked.select("gk", S.filled("m", "gk").alias("filled"), S.rounded(S.unknown_share("m")).alias("unknown"))


@register("P15_productive_pairs", derived("ends", ", c AS (SELECT sk, gs, substr(es, 1, 63 - (sk % 2)::INT) AS s FROM ends) SELECT sk, len(list_filter([substr(s, 1 + 3 * i, 3) FOR i IN range(length(s) // 3)], lambda x: x IN ('taa', 'tag', 'tga'))) = 0 AND length(s) % 3 = 0 AND s[4:6] = gs[4:6] AND s[31:33] = gs[31:33] AS productive FROM c"))
def p15_pairs(spark, d):
    """Neither stops nor broken codons, and the second and the eleventh codon as in the gene."""
    found = seqs(spark, d).withColumn("s", F.expr("substr(es, 1, cast(63 - sk % 2 as int))"))
    return found.select("sk", S.productive("s", "gs", [1, 10]).alias("productive"))


@register("P14_known_inside", f"SELECT c_custkey AS gk FROM customer WHERE NOT contains(trim(substr(translate(md5('p' || c_custkey::VARCHAR), '{_HEX}', 'acgtnnnnnnacgtac'), 1, 6), 'n'), 'n')")
def p14_some(spark, d):
    text = F.substring(F.translate(F.md5(F.concat(F.lit("p"), F.col("c_custkey").cast("string"))), _HEX, "acgtnnnnnnacgtac"), 1, 6)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("gk"), text.alias("a")).filter(~S.strip_unknown("a").contains("n")).select("gk")


@register("U3_category_difference", "SELECT DISTINCT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 1")
def u3_some(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).subtract(table(spark, d, "supplier").filter("s_suppkey % 10 = 1").select("s_nationkey"))


@register("J1_genes_without_kept_seqs", "SELECT c_custkey AS gk FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def j1_anti_some(spark, d):
    return genes(spark, d).join(seqs(spark, d).filter("sk % 7 = 0"), "gk", "left_anti").select("gk")


@register("W7_running_denominators", derived("rated", "SELECT sk, step, round(max(den), 6) AS den FROM rated GROUP BY sk, step"))
def w7(spark, d):
    return hazards.denominators(seqs(spark, d), THREE, THREE_THETA).select("sk", "step", S.rounded("den").alias("den"))


@register("W10_recentred", derived("sites", "SELECT (pos + 24 - c_nationkey)::BIGINT AS place, count_if(mu)::BIGINT AS n FROM sites JOIN customer ON gk = c_custkey GROUP BY 1").replace("24", "(SELECT max(c_nationkey) FROM customer)"))
def w10(spark, d):
    centres = table(spark, d, "customer").select(F.col("c_custkey").alias("gk"), "c_nationkey")
    spread = seqs(spark, d).select("gk", F.transform("mutations", lambda x: x["pos"]).alias("all"), F.explode(F.sequence(F.lit(1), F.lit(64))).alias("pos")).join(centres, "gk")
    found = tables.recentred(spread.withColumn("mu", F.array_contains("all", F.col("pos"))), "pos", "c_nationkey")
    return found.groupBy(F.col("pos").cast("long").alias("place")).agg(F.count_if("mu").alias("n"))


@register("S3_best_penalty", "SELECT event_type, user_id % 10 AS penalty, round(score, 6) AS score FROM (SELECT event_type, user_id % 10 AS user_id, avg(value) AS score FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id) = 1")
def s3(spark, d):
    scores = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("penalty")).agg(F.avg("value").alias("score"))
    return tables.best_by(scores, ["event_type"], "score", "penalty").withColumn("score", S.rounded("score"))


@register("S4_fallback_model", "SELECT min(s_suppkey) AS s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def s4_fallback(spark, d):
    """No bound is positive: the first refitted model."""
    models = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("refit"), (-F.abs("s_acctbal")).alias("bound"))
    return tables.pick_best_model(models, "s_suppkey", "refit", "bound")


@register("U2_filter_intersection", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20 INTERSECT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.05")
def u2(spark, d):
    keys = lambda test: table(spark, d, "lineitem").filter(test).select("l_orderkey", "l_linenumber")
    return keys("l_quantity > 20").intersect(keys("l_discount < 0.05"))


@register("U8_transposed", "SELECT 'n' AS name, " + ", ".join(f"max(CASE WHEN n_regionkey = {k} THEN n END)::DOUBLE AS \"{k}\"" for k in range(5)) + " FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) UNION ALL SELECT 'most', " + ", ".join(f"max(CASE WHEN n_regionkey = {k} THEN n_nationkey END)::DOUBLE" for k in range(5)) + " FROM nation")
def u8(spark, d):
    wide = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").cast("double").alias("n"), F.max("n_nationkey").cast("double").alias("most"))
    return tables.transposed(wide, "n_regionkey", ["n", "most"], [str(k) for k in range(5)])


@register("U10_finite_or_null", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal), 6) END AS logged FROM supplier")
def u10(spark, d):
    logged = F.when(F.col("s_acctbal") > 0, F.ln("s_acctbal")).otherwise(float("-inf"))
    return table(spark, d, "supplier").select("s_suppkey", S.rounded(tables.finite_or_null(logged)).alias("logged"))


@register("M9_intervals", "SELECT s_suppkey, round(s_acctbal - 1.65 * (s_suppkey % 5), 6) + 0.0 AS lower, round(s_acctbal + 1.65 * (s_suppkey % 5), 6) + 0.0 AS upper FROM supplier")
def m9(spark, d):
    found = statistics.with_interval(table(spark, d, "supplier").withColumn("se", (F.col("s_suppkey") % 5).cast("double")), "s_acctbal", "se", 1.65)
    return found.select("s_suppkey", S.rounded("lower").alias("lower"), S.rounded("upper").alias("upper"))


_TARGETS = f"(SELECT idx, motif, k, substr('acgt', k + 1, 1) AS target FROM ({_TRIPLES}), range(4) t(k))"


@register("M15_paired_t", f"SELECT event_type, count(*) AS n, round(avg(fitted - truth) / (stddev_pop(fitted - truth) / sqrt(count(*) - 1)), 5) + 0.0 AS t FROM {_PAIRS} GROUP BY event_type HAVING count(*) > 1")
def m15(spark, d):
    found = statistics.paired_t(_pairs(spark, d).withColumn("x", F.col("fitted") - F.col("truth")), "x", ["event_type"])
    return found.filter("n > 1").withColumn("t", S.rounded("t", 5))


@register("M20_targeting", derived("genes", ", w AS (SELECT gk, replace(gs, 't', '') AS s FROM genes), m AS (SELECT substr(s, p, 3) AS motif FROM (SELECT s, unnest(range(1, length(s) - 1)) AS p FROM w)) SELECT motif, target, count(*) AS n, round(CASE WHEN motif[2] <> target THEN count(*) * (idx % 7) / 7.0::DOUBLE * (k + 1) / 10.0 END, 4) + 0.0 AS targeting FROM m JOIN " + _TARGETS + " USING (motif) GROUP BY motif, target, idx, k"))
def m20(spark, d):
    """Rates of mutation towards each target over all sites, t standing for a gap that is removed; none towards a motif's own base."""
    found = features.sites(genes(spark, d).select("gk", F.replace("gs", F.lit("t"), F.lit("")).alias("gs")), 3, 1)
    place = F.instr(F.lit("acgt"), F.col("target")) - 1
    rates = features.possible_targets(spark, 3, 1).join(F.broadcast(theta(spark)), "motif").select("motif", "target", F.when(F.col("possible"), F.col("theta") * (place + 1) / 10.0).alias("rate"))
    return features.targeting(found, rates).select("motif", "target", "n", S.rounded("targeting", 4).alias("targeting"))


_FIVE = ", m AS (SELECT mu, sc, ec, lag(sc, 2) OVER w || lag(sc) OVER w || sc || lead(sc) OVER w || lead(sc, 2) OVER w AS motif FROM sites WINDOW w AS (PARTITION BY sk ORDER BY pos)), c AS (SELECT motif, count(*) AS n, count_if(mu)::DOUBLE AS mutated FROM m WHERE motif IS NOT NULL GROUP BY motif)"


@register("E12_mutability_model", derived("sites", _FIVE + " SELECT motif, round((mutated / n) / (SELECT sum(mutated / n) FROM c), 8) AS mutability FROM c"))
def e12_model(spark, d):
    return features.mutability(_labelled(spark, d), "n").select("motif", S.rounded("mutability", 8).alias("mutability"))


@register("E12_substitution_model", derived("sites", _FIVE + ", t AS (SELECT motif, ec AS target, count(*)::DOUBLE AS n FROM m WHERE motif IS NOT NULL AND mu GROUP BY ALL) SELECT motif, target, round(n / sum(n) OVER (PARTITION BY motif), 6) AS substitution, round((SELECT (c.mutated / c.n) / (SELECT sum(mutated / n) FROM c) FROM c WHERE c.motif = t.motif) * n / sum(n) OVER (PARTITION BY motif), 8) AS targeting FROM t"))
def e12_substitution(spark, d):
    """Each motif's targets, and its targeting: mutability by substitution."""
    labelled = _labelled(spark, d)
    found = features.substitution(labelled, "n").join(features.mutability(labelled, "n"), "motif")
    return found.select("motif", "target", S.rounded("substitution").alias("substitution"), S.rounded(F.col("mutability") * F.col("substitution"), 8).alias("targeting"))


def _labelled(spark, d):
    """Sites counted by their 5-mers and the target of those that mutate: read and counted once, however often it is used."""
    return kept(features.site_counts(seqs(spark, d), 5, 2), "site-counts")


_TREE = ", tree AS (SELECT gk // 2 AS parent_id, gk AS child_id FROM genes WHERE gk // 2 IN (SELECT gk FROM genes))"


def _tree(spark, d):
    keys = genes(spark, d).select("gk")
    return keys.select(F.expr("gk div 2").alias("parent_id"), F.col("gk").alias("child_id")).join(keys.select(F.col("gk").alias("parent_id")), "parent_id", "left_semi")


@register("T1_tree_pairs", derived("genes", _TREE + " SELECT parent_id, child_id, hamming(p.gs, c.gs)::BIGINT AS n FROM tree JOIN genes p ON p.gk = parent_id JOIN genes c ON c.gk = child_id"))
def t1(spark, d):
    found = tables.tree_pairs(_tree(spark, d), genes(spark, d).select(F.col("gk").alias("node"), F.col("gs").alias("sequence")))
    return found.select("parent_id", "child_id", S.hamming("start", "end").alias("n"))


@register("T4_graph_nodes", derived("genes", _TREE + " SELECT node, count_if(up)::BIGINT AS n_children, NOT bool_or(NOT up) AS is_root FROM (SELECT parent_id AS node, true AS up FROM tree UNION ALL SELECT child_id, false FROM tree) GROUP BY node"))
def t4(spark, d):
    return tables.graph_nodes(_tree(spark, d))


@register("E8_group_folds", derived("seqs", "SELECT fold, count(*) AS n_families FROM (SELECT family, ((row_number() OVER (ORDER BY n DESC, family) - 1) % 5)::INT AS fold FROM (SELECT family, count(*) AS n FROM seqs0 GROUP BY 1)) GROUP BY fold"))
def e8_groups(spark, d):
    """Five segments, five folds: one each."""
    return tables.group_folds(seqs(spark, d).select("sk", "family"), "family", 5).groupBy("fold").agg(F.count("*").alias("n_families"))


@register("E8_balanced_folds", """
    WITH RECURSIVE sizes AS (SELECT c_nationkey AS nation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey::VARCHAR) AS i FROM customer GROUP BY 1),
    dealt AS (
        SELECT 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS held, 0::BIGINT AS place, NULL::INT AS nation
        UNION ALL
        SELECT i, list_transform(range(1, 5), lambda k: held[k] + CASE WHEN k = place THEN n ELSE 0 END), place, nation
        FROM (SELECT s.i, s.n, s.nation, d.held, list_position(d.held, list_min(d.held))::BIGINT AS place FROM dealt d JOIN sizes s ON s.i = d.i + 1))
    SELECT nation, (place - 1)::INT AS fold FROM dealt WHERE i > 0""")
def e8_balanced(spark, d):
    """25 nations of unequal sizes in four folds."""
    return tables.group_folds(table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), "nation", 4)


@register("E7_category_split", "SELECT c_custkey AS gk, CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) ORDER BY md5('c' || c_mktsegment) LIMIT (SELECT floor(0.2 * count(DISTINCT c_mktsegment))::INT + 1 FROM customer)) THEN 'validation' ELSE 'train' END AS part FROM customer")
def e7_categories(spark, d):
    train, held = tables.category_split(genes(spark, d).select("gk", "family"), "family", 0.2)
    held = held.select("gk", F.lit("validation").alias("part"))
    return train.select("gk", F.lit("train").alias("part")).unionByName(held)


@register("E10_fused_objective", derived("rated", f", ll AS (SELECT sk, sum(theta - ln(den)) AS ll FROM rated WHERE hit GROUP BY sk), m AS (SELECT motif, (idx % 7) / 7.0::DOUBLE AS x FROM ({_TRIPLES})) SELECT round(-avg(ll) + 0.1 * (SELECT sum(x) FROM m) + 0.05 * (SELECT sum(abs(a.x - b.x)) FROM m a, m b WHERE hamming(a.motif, b.motif) = 1), 6) AS objective FROM ll").replace("\n,", ","))
def e10(spark, d):
    pairs = proximal.motif_edges(THREE)
    both = np.concatenate([pairs, pairs[:, ::-1]])
    return hazards.penalised_objective(seqs(spark, d), THREE, THREE_THETA, 0.1, both, 0.05).withColumn("objective", S.rounded("objective"))
