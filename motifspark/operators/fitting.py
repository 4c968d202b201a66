"""Model fits: lasso by proximal gradient, Monte-Carlo EM, penalty paths, logistic motif models.

The data stay in Spark; the driver holds what has the size of theta (4**k
numbers).  Orders and their compressed risk sets are written to the shared
folder once an iteration, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .likelihood import gradient, hessian, log_likelihood, risk_counts
from .sampling import gibbs_orders


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame written below spark.checkpoint.dir and read again; below the warehouse where the session names none."""
    spark = frame.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def soft(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def _frame(spark, motifs: list[str], theta: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(m, float(t)) for m, t in zip(motifs, theta, strict=True)], "motif string, theta double")


def fit_lasso(counts: DataFrame, motifs: list[str], penalty: float, start: np.ndarray | None = None, rounds: int = 30, step: float = 4.0, tolerance: float = 1e-4, key: str = "sk") -> np.ndarray:
    """theta that minimises the mean negative log-likelihood plus penalty * |theta|: proximal gradient with backtracking."""
    spark = counts.sparkSession
    theta = np.zeros(len(motifs)) if start is None else start.copy()
    total = counts.select(key).distinct().count()
    place = {m: i for i, m in enumerate(motifs)}

    def loss(x: np.ndarray) -> float:
        return -log_likelihood(counts, _frame(spark, motifs, x), key).agg(F.sum("log_lik")).first()[0] / total

    def slope(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(motifs))
        for r in gradient(counts, _frame(spark, motifs, x), key).toLocalIterator():
            if r[0] in place:
                out[place[r[0]]] = -r[1] / total
        return out

    return lasso_descent(loss, slope, theta, penalty, rounds, step, tolerance) if total else theta


def lasso_descent(loss: Callable[[np.ndarray], float], slope_of: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, penalty: float, rounds: int, step: float, tolerance: float) -> np.ndarray:
    """Proximal gradient steps from theta, halved until the quadratic bound holds, until one gains less than the tolerance."""
    now = loss(theta)
    for _ in range(rounds):
        slope = slope_of(theta)
        while step > 1e-6:
            new = soft(theta - step * slope, step * penalty)
            moved, value = new - theta, loss(new)
            if value <= now + slope @ moved + moved @ moved / (2 * step) + 1e-12:
                break
            step /= 2
        else:
            break
        gain = now + penalty * np.abs(theta).sum() - value - penalty * np.abs(new).sum()
        theta, now = new, value
        if gain < tolerance:
            break
    return theta


def monte_carlo_em(seqs: DataFrame, motifs: list[str], penalty: float, k: int = 3, left: int = 1, rounds: int = 3, samples: int = 4, burn_in: int = 4, seed: int = 0, start: np.ndarray | None = None, m_rounds: int = 8) -> np.ndarray:
    """theta from sequences whose mutation orders are unknown: sampled orders, then a lasso fit, in turns."""
    spark = seqs.sparkSession
    theta = np.zeros(len(motifs)) if start is None else start
    for i in range(rounds):
        drawn = gibbs_orders(seqs, _frame(spark, motifs, theta), k, left, burn_in, samples, 1, seed + i)
        named = drawn.select(F.concat_ws("-", "sk", "sample").alias("drawn"), "gs", "mutations")
        counts = kept(risk_counts(named, k, left, "drawn"), "risk-counts")
        theta = fit_lasso(counts, motifs, penalty, theta, m_rounds, key="drawn")
    return theta


def split(frame: DataFrame, share: float, by: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a hash of a column, so that its groups stay whole and any run gives the same rows."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(by)), F.lit(1 << 20)) / float(1 << 20)
    return frame.filter(place >= share), frame.filter(place < share)


def contiguous_folds(frame: DataFrame, folds: int, order: str) -> DataFrame:
    """Adds fold: rows in order, cut into folds of equal size.

    Ranks come from each range partition's count, so rows are never gathered in one task.
    """
    dealt = kept(frame.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size"))
    total = before.agg(F.sum("size")).first()[0] or 0
    at = F.row_number().over(Window.partitionBy("part").orderBy(order)) + F.col("before") - 1
    big, small = total % folds, total // folds
    fold = F.when(F.col("at") < big * (small + 1), F.floor(F.col("at") / (small + 1))).otherwise(F.lit(big) + F.floor((F.col("at") - big * (small + 1)) / max(small, 1)))
    return dealt.join(F.broadcast(before.select("part", "before")), "part").withColumn("at", at).withColumn("fold", fold.cast("int")).drop("part", "before", "at")


def penalty_path(seqs: DataFrame, motifs: list[str], penalties: list[float], share: float = 0.2, k: int = 3, left: int = 1, seed: int = 0, **em) -> tuple[float, np.ndarray]:
    """The best penalty and its theta: from large to small, until the validation log-likelihood falls."""
    train, held = (kept(x, "split") for x in split(seqs, share, "sk", seed))
    spark, best, theta = seqs.sparkSession, None, None
    for penalty in sorted(penalties, reverse=True):
        theta = monte_carlo_em(train, motifs, penalty, k, left, seed=seed, start=theta, **em)
        drawn = gibbs_orders(held, _frame(spark, motifs, theta), k, left, 4, 4, 1, seed)
        named = drawn.select(F.concat_ws("-", "sk", "sample").alias("drawn"), "gs", "mutations")
        score = log_likelihood(risk_counts(named, k, left, "drawn"), _frame(spark, motifs, theta), "drawn").agg(F.avg("log_lik")).first()[0]
        if best is not None and (score is None or score <= best[0]):
            break
        best = (score, penalty, theta)
    return best[1], best[2]


def information_inverse(counts: DataFrame, motifs: list[str], theta: np.ndarray, key: str = "sk") -> np.ndarray:
    """The pseudo-inverse of the information of known orders; matrices of 4**k rows come together on the driver."""
    frame, place = _frame(counts.sparkSession, motifs, theta), {m: i for i, m in enumerate(motifs)}
    info = np.zeros((len(motifs), len(motifs)))
    for f1, f2, value in hessian(counts, frame, key).toLocalIterator():
        if f1 in place and f2 in place:
            info[place[f1], place[f2]] -= value
    return np.linalg.pinv(info)


def intervals(motifs: list[str], theta: np.ndarray, inverse: np.ndarray, z: float = 1.96) -> list[tuple[str, float, float, float]]:
    se = np.sqrt(np.maximum(np.diag(inverse), 0))
    return [(m, float(t - z * s), float(t), float(t + z * s)) for m, t, s in zip(motifs, theta, se, strict=True)]


def logistic_theta(labelled: DataFrame, penalty: float) -> DataFrame:
    """(motif, theta) of P(mutated) = 1 / (1 + exp(-theta)) with a lasso, by its closed form; labelled: (motif, mutated).

    A motif's own counts decide: the penalty takes its share of the sites from
    the mutated or the other ones, and theta is 0 where it takes the majority.
    Without a penalty a motif that always or never mutates has an infinite theta.
    """
    counts = labelled.groupBy("motif").agg(F.count_if("mutated").cast("double").alias("hits"), F.count("*").cast("double").alias("n"))
    taken = F.lit((labelled.count() or 0) * penalty)
    up, down = F.col("hits") - taken, F.col("n") - F.col("hits") - taken
    theta = F.when(up > F.col("n") / 2, F.ln(up) - F.ln(F.col("n") - up)).when(down > F.col("n") / 2, F.ln(F.col("n") - down) - F.ln(down)).otherwise(0.0)
    exact = F.when(up >= F.col("n"), float("inf")).when(down >= F.col("n"), float("-inf")).otherwise(theta)
    return counts.select("motif", exact.alias("theta"))


def fit_logistic(labelled: DataFrame, penalty: float) -> dict[str, float]:
    """The same as a dict; 4**k rows."""
    return {r[0]: r[1] for r in logistic_theta(labelled, penalty).collect()}


def fitch(tree: DataFrame, leaves: DataFrame, rounds: int) -> DataFrame:
    """(node, pos, bases): the base sets of inner nodes of given trees, from the leaves up, one level a round.

    tree: (parent_id, child_id); leaves: (node, sequence).  Sets are bit masks of acgt; a node's set is the
    intersection of its children's, or their union where that is empty.
    """
    masks = leaves.select("node", F.posexplode(F.split("sequence", "")).alias("i", "base")).select("node", (F.col("i") + 1).alias("pos"), F.expr("shiftleft(1, instr('acgt', base) - 1)").alias("bases"))
    known = kept(masks, "fitch")
    children = tree.groupBy("parent_id").agg(F.count("*").alias("n_children"))
    for _ in range(rounds):
        up = known.join(tree, known["node"] == tree["child_id"]).groupBy("parent_id", "pos").agg(F.count("*").alias("n"), F.bit_and("bases").alias("both"), F.bit_or("bases").alias("any"))
        ready = up.join(children, "parent_id").filter("n = n_children").join(known.select(F.col("node").alias("parent_id"), "pos"), ["parent_id", "pos"], "left_anti")
        known = kept(known.unionByName(ready.select(F.col("parent_id").alias("node"), "pos", F.expr("if(both = 0, any, both)").alias("bases"))), "fitch")
    return known
