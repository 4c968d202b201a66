"""The survival likelihood of mutation orders, over compressed risk sets.

Rows of orders: (key, gs, mutations).  Before each step the sequence has a
state; a site that hasn't mutated yet is at risk with the hazard
exp(theta of its motif).  Which motifs are at risk, and how often, doesn't
depend on theta: risk_counts() holds it once for any number of evaluations.
Each sequence's rows stay in the partition that its key hashes to, so that
all that follows needs no further shuffle up to the last aggregation.
Theta has at most 4**k rows, or four times as many, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import state_after


def states(orders: DataFrame, key: str = "sk") -> DataFrame:
    """(key, step, pos, target, state, done): the sequence before each step, and the places that have mutated."""
    steps = orders.select(key, "gs", "mutations", F.posexplode("mutations").alias("i", "m"))
    done = F.transform(F.slice("mutations", F.lit(1), F.col("i")), lambda x: x["pos"])
    return steps.select(key, (F.col("i") + 1).alias("step"), "m.pos", "m.target", state_after(F.col("gs"), F.col("mutations"), F.col("i")).alias("state"), done.alias("done"))


def risk_sites(orders: DataFrame, k: int = 3, left: int = 1, key: str = "sk") -> DataFrame:
    """(key, step, site, motif, hit, target): the sites at risk before each step; hit marks the one that mutates."""
    dealt = orders.repartition(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    spread = states(dealt, key).withColumn("site", F.explode(F.sequence(F.lit(left + 1), F.length("state") - (k - 1 - left))))
    return spread.filter(~F.array_contains("done", F.col("site"))).select(key, "step", "site", F.substring(F.col("state"), F.col("site") - left, F.lit(k)).alias("motif"), (F.col("site") == F.col("pos")).alias("hit"), "target")


def risk_counts(orders: DataFrame, k: int = 3, left: int = 1, key: str = "sk") -> DataFrame:
    """(key, step, motif, n, hit, target): how many sites at risk have each motif before each step."""
    return risk_sites(orders, k, left, key).groupBy(key, "step", "motif").agg(F.count("*").alias("n"), F.max("hit").alias("hit"), F.max(F.when(F.col("hit"), F.col("target"))).alias("target"))


def _with_theta(counts: DataFrame, theta: DataFrame) -> DataFrame:
    """Adds num (log hazard of the mutation) and hazard; a motif without coefficient has the hazard 1."""
    return counts.join(F.broadcast(theta.select("motif", "theta")), "motif", "left").withColumns({"num": F.coalesce("theta", F.lit(0.0)), "hazard": F.exp(F.coalesce("theta", F.lit(0.0)))})


def _with_targets(counts: DataFrame, theta: DataFrame) -> DataFrame:
    """The same for coefficients by (motif, target); impossible ones have theta null and no part in the hazard."""
    total = theta.groupBy("motif").agg(F.sum(F.exp("theta")).alias("hazard"))
    own = theta.select("motif", F.col("target").alias("to"), F.col("theta").alias("num"))
    return counts.join(F.broadcast(total), "motif", "left").join(F.broadcast(own), (counts["motif"] == own["motif"]) & (counts["target"] == own["to"]), "left").drop(own["motif"]).withColumn("hazard", F.coalesce("hazard", F.lit(4.0)))


def log_likelihood(counts: DataFrame, theta: DataFrame, key: str = "sk") -> DataFrame:
    """(key, n_steps, log_lik): over steps, the log hazard of the mutation less that of all sites at risk."""
    rated = _with_targets(counts, theta) if "target" in theta.columns else _with_theta(counts, theta)
    steps = rated.groupBy(key, "step").agg(F.sum(F.when(F.col("hit"), F.col("num"))).alias("num"), F.sum(F.col("n") * F.col("hazard")).alias("den"))
    return steps.groupBy(key).agg(F.count("*").alias("n_steps"), F.sum(F.col("num") - F.ln("den")).alias("log_lik"))


def denominators(counts: DataFrame, theta: DataFrame, key: str = "sk") -> DataFrame:
    """(key, step, den): the hazard of all sites at risk before each step."""
    return _with_theta(counts, theta).groupBy(key, "step").agg(F.sum(F.col("n") * F.col("hazard")).alias("den"))


def weights(counts: DataFrame, theta: DataFrame, key: str = "sk") -> DataFrame:
    """(key, step, motif, share, hit): each motif's share of the hazard before each step."""
    rated = _with_theta(counts, theta)
    inside = F.collect_list(F.struct("motif", (F.col("n") * F.col("hazard")).alias("h"), "hit"))
    steps = rated.groupBy(key, "step").agg(F.sum(F.col("n") * F.col("hazard")).alias("den"), inside.alias("all"))
    return steps.select(key, "step", "den", F.inline("all")).select(key, "step", "motif", (F.col("h") / F.col("den")).alias("share"), "hit")


def gradient(counts: DataFrame, theta: DataFrame, key: str = "sk") -> DataFrame:
    """(motif, gradient): the derivative of the sum of log-likelihoods."""
    return weights(counts, theta, key).groupBy("motif").agg(F.sum(F.col("hit").cast("double") - F.col("share")).alias("gradient"))


def hessian(counts: DataFrame, theta: DataFrame, key: str = "sk") -> DataFrame:
    """(f1, f2, value): second derivatives; a step gives the pairs of its own motifs."""
    shares = weights(counts, theta, key).groupBy(key, "step").agg(F.collect_list(F.struct("motif", "share")).alias("all"))
    pairs = shares.select("all", F.inline("all").alias("f1", "s1")).select("f1", "s1", F.inline("all").alias("f2", "s2"))
    return pairs.groupBy("f1", "f2").agg(F.sum(F.col("s1") * F.col("s2") - F.when(F.col("f1") == F.col("f2"), F.col("s1")).otherwise(0.0)).alias("value"))


def score_products(counts: DataFrame, theta: DataFrame, key: str = "sk") -> DataFrame:
    """(f1, f2, value): sums over sequences of the products of their gradients, for the observed information."""
    own = weights(counts, theta, key).groupBy(key, "motif").agg(F.sum(F.col("hit").cast("double") - F.col("share")).alias("g"))
    listed = own.groupBy(key).agg(F.collect_list(F.struct("motif", "g")).alias("all"))
    pairs = listed.select("all", F.inline("all").alias("f1", "g1")).select("f1", "g1", F.inline("all").alias("f2", "g2"))
    return pairs.groupBy("f1", "f2").agg(F.sum(F.col("g1") * F.col("g2")).alias("value"))


def residuals(orders: DataFrame, theta: DataFrame, k: int = 3, left: int = 1, key: str = "sk") -> DataFrame:
    """(key, site, residual): whether a site mutates, less its accumulated risk; a sequence's residuals sum to zero."""
    rated = _with_theta(risk_sites(orders, k, left, key), theta)
    inside = F.collect_list(F.struct("site", "hazard", "hit"))
    steps = rated.groupBy(key, "step").agg(F.sum("hazard").alias("den"), inside.alias("all"))
    spread = steps.select(key, "den", F.inline("all"))
    return spread.groupBy(key, "site").agg(F.sum(F.col("hit").cast("double") - F.col("hazard") / F.col("den")).alias("residual"))


def penalised_objective(counts: DataFrame, theta: DataFrame, penalty: float, key: str = "sk") -> DataFrame:
    """One row: the mean negative log-likelihood plus the lasso penalty."""
    norm = theta.agg(F.sum(F.abs("theta"))).first()[0] or 0.0
    return log_likelihood(counts, theta, key).agg((-F.avg("log_lik") + penalty * norm).alias("objective"))


def fused_objective(counts: DataFrame, theta: DataFrame, edges: DataFrame, penalty: float, fused: float, key: str = "sk") -> DataFrame:
    """The lasso's objective plus a penalty on the differences of neighbouring motifs; edges: (motif, other), each pair in both orders."""
    ends = edges.join(F.broadcast(theta.select("motif", F.col("theta").alias("x"))), "motif").join(F.broadcast(theta.select(F.col("motif").alias("other"), F.col("theta").alias("y"))), "other")
    apart = ends.agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0] or 0.0
    return penalised_objective(counts, theta, penalty, key).select((F.col("objective") + fused * apart).alias("objective"))


def observed_information(counts: DataFrame, theta: DataFrame, label: str, samples: int, key: str = "sk") -> DataFrame:
    """(f1, f2, value): the information of the observed data by Louis' method.

    counts: one `key` for each sampled order, with the `label` of its
    observation, which has `samples` of them.  Per observation only its own
    gradient is held; sums are of 4**k by 4**k numbers.
    """
    own = weights(counts, theta, key).join(counts.select(key, label).distinct(), key).groupBy(label, "motif").agg(F.sum(F.col("hit").cast("double") - F.col("share")).alias("g"))
    listed = own.groupBy(label).agg(F.collect_list(F.struct("motif", "g")).alias("all"))
    whole = own.groupBy("motif").agg(F.sum("g").alias("g")).agg(F.collect_list(F.struct("motif", "g")).alias("all"))
    pairs = lambda frame: frame.select("all", F.inline("all").alias("f1", "g1")).select("f1", "g1", F.inline("all").alias("f2", "g2")).groupBy("f1", "f2").agg(F.sum(F.col("g1") * F.col("g2")).alias("value"))
    m = float(samples)
    parts = [(hessian(counts, theta, key), -1 / m), (score_products(counts, theta, key), -1 / m), (pairs(whole), -1 / m**2), (pairs(listed), 1 / m**2)]
    out = parts[0][0].select("f1", "f2", (F.col("value") * parts[0][1]).alias("value"))
    for frame, by in parts[1:]:
        out = out.unionByName(frame.select("f1", "f2", (F.col("value") * by).alias("value")))
    return out.groupBy("f1", "f2").agg(F.sum("value").alias("value"))
