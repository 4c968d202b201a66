"""Statistics for the comparison of models; squares are averaged over the population."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fitting import kept


def mean_interval(frame: DataFrame, value: str, by: list[str], z: float = 1.96) -> DataFrame:
    """n, mean, se, lower and upper of a value by group."""
    stats = frame.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sqrt(F.var_pop(value) / F.count(value)).alias("se"))
    return stats.withColumns({"lower": F.col("mean") - z * F.col("se"), "upper": F.col("mean") + z * F.col("se")})


def relative_error(frame: DataFrame, fitted: str, truth: str, by: list[str]) -> DataFrame:
    """The norm of the difference over the truth's norm, and Pearson's correlation."""
    norms = frame.groupBy(*by).agg(F.sqrt(F.sum(F.pow(F.col(fitted) - F.col(truth), 2))).alias("d"), F.sqrt(F.sum(F.pow(truth, 2))).alias("t"), F.corr(fitted, truth).alias("pearson"))
    return norms.select(*by, F.when(F.col("t") > 0, F.col("d") / F.col("t")).alias("relative_error"), "pearson")


def running_totals(frame: DataFrame, by: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Adds the sum of a weight over the rows of the group up to this one, in order.

    Rows are dealt out by ranges of group and order and written once; each
    range adds what the ranges before it hold of the group.  So a task sees a
    range at most, however large a group is.  Rows of equal order keep an
    order of their own.
    """
    columns = [*by, *order]
    dealt = kept(frame.withColumn("_w", weight).repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part", *by).agg(F.sum("_w").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_size")).drop("_size")
    inside = dealt.withColumn("_upto", F.sum("_w").over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    a, b = inside.alias("a"), before.alias("b")
    joined = a.join(b, [F.col("a._part") == F.col("b._part"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by)])
    return joined.select(*(F.col(f"a.{c}") for c in frame.columns), (F.col("a._upto") + F.col("b._before")).alias(name))


def average_ranks(frame: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Adds the rank within the group; ties share their mean rank.

    Ranks come from the counts of distinct values in ranges, joined back, so
    neither rows nor distinct values of a group are sorted in one task.
    """
    cells = running_totals(frame.groupBy(*by, value).agg(F.count("*").alias("_n")), by, [value], F.col("_n"), "_upto_n")
    ranks = cells.select(*by, value, (F.col("_upto_n") - (F.col("_n") - 1) / 2.0).alias(name))
    return frame.join(ranks, [*by, value])


def medians(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) of the values that aren't null, exactly: the mean of the middle two of an even number; from counts of distinct values in ranges."""
    cells = frame.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(cells, by, [value], F.col("_n"), "_upto_n")
    sizes = cells.groupBy(*by).agg(F.sum("_n").alias("_all"))
    a, b = ranked.alias("a"), sizes.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]).select(*(F.col(f"a.{k}") for k in by), F.col(f"a.{value}").alias("_v"), (F.col("_upto_n") - F.col("_n")).alias("_from"), F.col("_upto_n"), "_all")
    holds = lambda place: F.max(F.when((F.col("_from") < place) & (F.col("_upto_n") >= place), F.col("_v")))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    return joined.groupBy(*by).agg(holds(low).alias("_low"), holds(high).alias("_high")).select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def spearman(frame: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(frame, x, by, "rank_x"), y, by, "rank_y")
    return ranked.groupBy(*by).agg(F.corr("rank_x", "rank_y").alias("spearman"))


def kendall(frame: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Kendall's tau-b of few distinct values: equal (x, y) rows are counted first, then counts are paired, not rows."""
    cells = frame.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    a, b = cells.alias("a"), cells.alias("b")
    pairs = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]).select(*[F.col(f"a.{k}").alias(k) for k in by], F.signum(F.col("a.x") - F.col("b.x")).alias("dx"), F.signum(F.col("a.y") - F.col("b.y")).alias("dy"), (F.col("a.n") * F.col("b.n")).cast("double").alias("w"))
    sums = pairs.groupBy(*by).agg(F.sum(F.col("w") * F.col("dx") * F.col("dy")).alias("s"), F.sum(F.col("w") * F.abs("dx")).alias("tx"), F.sum(F.col("w") * F.abs("dy")).alias("ty"))
    return sums.select(*by, F.when((F.col("tx") > 0) & (F.col("ty") > 0), F.col("s") / F.sqrt(F.col("tx") * F.col("ty"))).alias("kendall"))


def coverage(frame: DataFrame, by: list[str], lower: str = "lower", upper: str = "upper", truth: str = "truth", slack: float = 1e-5, zero: float = 1e-6) -> DataFrame:
    """The share of true values inside their intervals: of all, and of the negative, zero and positive ones; null where there are none."""
    inside = ((F.col(lower) - slack <= F.col(truth)) & (F.col(truth) <= F.col(upper) + slack)).cast("double")
    signs = {"negative": F.col(truth) < -zero, "zero": F.abs(truth) <= zero, "positive": F.col(truth) > zero}
    return frame.groupBy(*by).agg(F.count("*").alias("n"), F.avg(inside).alias("covered"), *[F.avg(F.when(which, inside)).alias(f"covered_{k}") for k, which in signs.items()])


def discoveries(frame: DataFrame, by: list[str], fitted: str, truth: str, zero: float = 1e-6) -> DataFrame:
    """How many values that aren't zero were found, and how many found ones are zero in truth."""
    found, real = F.abs(fitted) > zero, F.abs(truth) > zero
    return frame.groupBy(*by).agg(F.count_if(found & real).alias("discovered"), F.count_if(found & ~real).alias("false_positive"))


def autocorrelation(frame: DataFrame, by: list[str], at: str, value: str, most_lag: int, block: int = 1 << 14) -> DataFrame:
    """(by, lag, correlation) for lags 1..most_lag of a group's values in the order of `at`; null where all are equal, no row for lags beyond the group.

    Values are numbered through ranges and laid out in blocks; a task has a
    block with the one after it, or what most_lag needs if that is longer,
    and gives its sums of products of all lags at once, by Fourier transform.
    """
    size = max(block, most_lag)
    means = frame.groupBy(*by).agg(F.avg(value).alias("_mean"))
    numbered = running_totals(frame.select(*by, at, F.col(value).cast("double").alias("_v")), by, [at], F.lit(1), "_place")
    a, b = numbered.alias("a"), means.alias("b")
    centred = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]).select(*(F.col(f"a.{k}") for k in by), (F.col("a._place") - 1).alias("_place"), (F.col("a._v") - F.col("b._mean")).alias("_c"))
    whole = F.floor(F.col("_place") / size)
    # each value goes to its own block and, as what follows, to the one before
    laid = centred.withColumn("_block", F.explode(F.when(whole > 0, F.array(whole, whole - 1)).otherwise(F.array(whole))))

    def sums(key, part):
        first, length = int(key[-1]) * size, 2 * size
        values = np.zeros(length)
        values[part["_place"].to_numpy(np.int64) - first] = part["_c"].to_numpy(float)
        own = values.copy()
        own[size:] = 0
        wide = 1 << (length + size - 1).bit_length()
        lags = np.fft.irfft(np.conj(np.fft.rfft(own, wide)) * np.fft.rfft(values, wide), wide)[: most_lag + 1]
        out = pd.DataFrame({"lag": np.arange(most_lag + 1), "s": lags})
        for name, k in zip(by, key, strict=False):
            out[name] = k
        return out

    kinds = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in by)
    blocks = laid.groupBy(*by, "_block").applyInPandas(sums, f"{kinds}, lag long, s double")
    total = centred.groupBy(*by).agg(F.max("_place").alias("_last"))
    added = blocks.groupBy(*by, "lag").agg(F.sum("s").alias("s"))
    zero = added.filter("lag = 0").select(*by, F.col("s").alias("_var")).alias("z")
    found, ends = added.filter("lag > 0").alias("f"), total.alias("t")
    on = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in by]
    joined = found.join(zero, on("f", "z")).join(ends, on("f", "t")).filter("f.lag <= t._last")
    return joined.select(*(F.col(f"f.{k}") for k in by), F.col("f.lag").alias("lag"), F.when(F.col("_var") > 0, F.col("f.s") / F.col("_var")).alias("correlation"))


def log_sum_exp(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """ln of the sum of exponentials, shifted by each group's greatest value."""
    top = frame.groupBy(*by).agg(F.max(value).alias("top"))
    return frame.join(top, by).groupBy(*by).agg((F.max("top") + F.ln(F.sum(F.exp(F.col(value) - F.col("top"))))).alias("log_sum_exp"))


def median_centred(frame: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the value less its group's exact median."""
    return frame.join(medians(frame, by, value).withColumnRenamed("median", "_mid"), by).withColumn(name, F.col(value) - F.col("_mid")).drop("_mid")


def median_scaled(frame: DataFrame, value: str, name: str) -> DataFrame:
    """The value over the median magnitude of those that aren't zero."""
    mid = frame.filter(F.abs(value) > 1e-6).agg(F.median(F.abs(value))).first()[0]
    return frame.withColumn(name, F.col(value) / F.lit(mid))


def mean_report(frame: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, sd, se and both as text, "mean (se)"."""
    out = frame.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.sqrt(F.var_pop(value) / F.count(value)).alias("se"))
    return out.withColumn("report", F.format_string("%.3f (%.3f)", "mean", "se"))


def error_table(frame: DataFrame, fitted: str, truth: str, by: list[str]) -> DataFrame:
    """The norm of the difference and Kendall's tau by group."""
    norms = frame.groupBy(*by).agg(F.sqrt(F.sum(F.pow(F.col(fitted) - F.col(truth), 2))).alias("error"))
    return norms.join(kendall(frame, fitted, truth, by), by)


def grouped_ratios(ratios: DataFrame, label: str, order: str, value: str) -> DataFrame:
    """(rep, value): the r-th samples of all observations, summed and divided by how many observations there are.

    A label's samples are ranked within it; there are as many as were drawn for one observation.
    """
    ranked = ratios.withColumn("rep", F.row_number().over(Window.partitionBy(label).orderBy(order)))
    total = ratios.select(label).distinct().count()
    return ranked.groupBy("rep").agg((F.sum(value) / F.lit(max(total, 1))).alias("value"))


def paired_t(frame: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """The t statistic of a mean difference; null where all are equal or there is one."""
    out = frame.groupBy(*by).agg(F.count(difference).alias("n"), F.avg(difference).alias("mean"), F.stddev_pop(difference).alias("sd"))
    return out.select(*by, "n", F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt(F.col("n") - 1))).alias("t"))


def with_interval(frame: DataFrame, value: str, se: str, z: float = 1.96) -> DataFrame:
    return frame.withColumns({"lower": F.col(value) - z * F.col(se), "upper": F.col(value) + z * F.col(se)})


def corrected_interval(values: np.ndarray, z: float, difference: float) -> tuple[float | None, float, float, float]:
    """(se, lower, upper, effective size) of the mean of correlated draws, around a penalised difference.

    Lags count up to the first negative autocorrelation, if two or more are
    negative.  A constant series has the size -1; a negative variance gives no
    standard error and no bounds.
    """
    n, mean, var = len(values), float(np.mean(values)), float(np.var(values))
    if var < 1e-10:
        return 0.0, mean, mean, -1.0
    wide = np.fft.rfft(values - mean, 2 * n)
    lags = np.fft.irfft(wide * np.conj(wide), 2 * n)[:n] / (var * np.arange(n, 0, -1))
    below = np.flatnonzero(lags < 0)
    kappa = 1 + 2 * float(np.sum(lags[1 : below[0] if len(below) > 1 else n]))
    size = n / kappa
    if var / size < 0:
        return None, -np.inf, np.inf, size
    se = float(np.sqrt(var / size))
    return se, difference - z * se, difference + z * se, size


def chain_intervals(frame: DataFrame, by: str, order: str, value: str, z: float = 1.96) -> DataFrame:
    """(by, n, mean, se, lower, upper, ess) of each chain of draws; a chain is as long as its sampler ran."""

    def work(key, part):
        values = part.sort_values("at")["v"].to_numpy(float)
        return pd.DataFrame([(key[0], len(values), values.mean(), *corrected_interval(values, z, float(values.mean())))], columns=["chain", "n", "mean", "se", "lower", "upper", "ess"])

    kind = frame.schema[by].dataType.simpleString()
    rows = frame.select(F.col(by).alias("chain"), F.col(order).alias("at"), F.col(value).alias("v"))
    return rows.groupBy("chain").applyInPandas(work, f"chain {kind}, n long, mean double, se double, lower double, upper double, ess double").withColumnRenamed("chain", by)


def aggregate_variance(matches: DataFrame, covariance: DataFrame) -> DataFrame:
    """(full, variance): the covariances of all pairs of coefficients that a full motif is the sum of."""
    one, other = matches.select("full", F.col("feat_idx").alias("i")), matches.select("full", F.col("feat_idx").alias("j"))
    return one.join(other, "full").join(F.broadcast(covariance), ["i", "j"]).groupBy("full").agg(F.sum("value").alias("variance"))


def theta_index(theta: DataFrame, row: str, col: str, wanted: Column) -> DataFrame:
    """Adds theta_idx, which numbers the wanted coefficients column by column, and is -1 for others; theta has 5 * 4**k rows at most."""
    found = F.sum(wanted.cast("int")).over(Window.orderBy(col, row)) - 1
    return theta.withColumn("theta_idx", F.when(wanted, found).otherwise(-1).cast("long"))


def target_probabilities(theta: DataFrame, by: str, value: str) -> DataFrame:
    """Adds probability of each target, in proportion to exp(-theta); shifted by each group's least value, so that the greatest term is 1, however large the values are."""
    least = F.broadcast(theta.groupBy(by).agg(F.min(value).alias("least")))
    shifted = theta.join(least, by).withColumn("share", F.exp(F.col("least") - F.col(value))).drop("least")
    total = shifted.groupBy(by).agg(F.sum("share").alias("total"))
    return shifted.join(F.broadcast(total), by).withColumn("probability", F.col("share") / F.col("total")).drop("share", "total")


def masked_means(frame: DataFrame, by: str, value: str, most_missing: float) -> DataFrame:
    """(by, n, mean) of the known values; no mean where more than this share is missing."""
    out = frame.groupBy(by).agg(F.count(value).alias("n"), F.avg(F.col(value).isNull().cast("int")).alias("missing"), F.avg(value).alias("mean"))
    return out.select(by, "n", F.when(F.col("missing") <= most_missing, F.col("mean")).alias("mean"))
