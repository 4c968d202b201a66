"""Tabular operators: joins, groups, allocation, consensus, ordering, reshaping."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import differing


def suffixed_join(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Inner join on several keys; the right side's other columns get the suffix where the left has them too."""
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c not in on}
    return left.join(right.withColumnsRenamed(names), on)


def chained_join(frame: DataFrame, others: Sequence[DataFrame], on: str) -> DataFrame:
    """Inner joins of several tables by one key, one after the other."""
    for other in others:
        frame = frame.join(other, on)
    return frame


def interval_labels(frame: DataFrame, value: str, intervals: Sequence[tuple[float, float, str]]) -> DataFrame:
    """Adds label of the interval [lo, hi) that holds the value; null outside of all."""
    label = F.lit(None).cast("string")
    for lo, hi, name in reversed(intervals):
        label = F.when((F.col(value) >= lo) & (F.col(value) < hi), name).otherwise(label)
    return frame.withColumn("label", label)


def ordered_pairs(names: DataFrame, name: str) -> DataFrame:
    """(model, other): ordered pairs of different names of a small dimension."""
    own, other = names.select(F.col(name).alias("model")), names.select(F.col(name).alias("other"))
    return own.join(F.broadcast(other), F.col("model") != F.col("other"))


def parameter_grid(spark: SparkSession, values: Mapping[str, Sequence], keep: Column | None = None) -> DataFrame:
    """All combinations of small lists of values, those that `keep` accepts."""
    rows = spark.createDataFrame(list(itertools.product(*values.values())), list(values))
    return rows if keep is None else rows.filter(keep)


def cluster_summary(frame: DataFrame, by: str, member: str) -> DataFrame:
    """(by, n, first_member, last_member): the clusters and what bounds their members."""
    return frame.groupBy(by).agg(F.count("*").alias("n"), F.min(member).alias("first_member"), F.max(member).alias("last_member"))


def distinct_categories(frame: DataFrame, by: str, seed: str = "c") -> DataFrame:
    """(by, place): the categories in an order that a digest gives; a few, so one task ranks them."""
    digest = F.md5(F.concat(F.lit(seed), F.col(by).cast("string")))
    return frame.select(by).distinct().withColumn("place", F.row_number().over(Window.orderBy(digest, by)))


def digest_uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that a digest of the key gives."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 6), 16, 10).cast("double") / float(1 << 24)


def allocate(frame: DataFrame, key: str, prevalence: DataFrame, name: str, freq: str, seed: str = "a") -> DataFrame:
    """Gives each row a category in proportion to its frequency, by inverse distribution; prevalence: a few categories."""
    order = Window.orderBy(name)
    total = prevalence.agg(F.sum(freq)).first()[0]
    upto = prevalence.select(name, (F.sum(freq).over(order) / total).alias("hi"), ((F.sum(freq).over(order) - F.col(freq)) / total).alias("lo"))
    drawn = frame.withColumn("u", digest_uniform(F.col(key), seed))
    return drawn.join(F.broadcast(upto), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).drop("u", "lo", "hi")


def resampled_families(frame: DataFrame, by: str, member: str, most: int, draws: int, seed: str = "r") -> DataFrame:
    """(by, draw, member): families of at most `most` members, and `draws` members of each, drawn with replacement.

    The bound comes first, so no family above it is ever ranked.
    """
    sizes = frame.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    ranked = frame.join(sizes, by).withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(member)) - 1)
    wanted = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    wanted = wanted.withColumn("at", F.floor(digest_uniform(F.concat_ws("-", by, "draw"), seed) * F.col("n")).cast("int"))
    return wanted.drop("n").join(ranked.select(by, "at", member), [by, "at"]).select(by, "draw", member)


def consensus(frame: DataFrame, by: str, start: str, text: str, key: str, seed: str = "v") -> DataFrame:
    """(by, consensus): at each position a base of a member that isn't the start's, picked by a digest, else the start's.

    Positions beyond the shortest member are cut.  Only bases that differ from the start's are votes, and these are
    pre-aggregated by position, so a family of any size is one row each.  Members of one family may have different
    starts: the least of their bases counts then.  Null families and texts are left out.
    """
    # each member once: a row for itself (at 0) and one for each vote
    rows = frame.select(by, key, start, text, F.explode(F.concat(F.array(F.lit(0)), differing(text, start))).alias("at"))
    own, i, base = F.col("at") == 0, F.col("at") - 1, F.substring(F.col(text), F.col("at"), F.lit(1))
    tie = F.unhex(F.md5(F.concat(F.lit(seed), F.concat_ws("-", key, i))))
    rows = rows.select(by, i.alias("i"), F.when(own, F.col(start)).alias("begin"), F.when(own, F.length(text)).alias("length"), F.when(~own, F.struct(tie.alias("tie"), base.alias("base"))).alias("vote"))
    rows = rows.filter(F.col(by).isNotNull() & (F.col("vote").isNull() | ~F.col("vote.base").isin("", "n")))
    chosen = rows.groupBy(by, "i", "begin").agg(F.min("vote")["base"].alias("base"), F.min("length").alias("length"))
    families = chosen.groupBy(by).agg(F.min("length").alias("least"), F.collect_list("begin").alias("starts"), F.array_sort(F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "base")))).alias("changes"))
    letters = F.transform(F.sequence(F.lit(1), F.col("least")), lambda p: F.coalesce(F.array_min(F.transform("starts", lambda s: F.substring(s, p, F.lit(1)))), F.lit("")))
    spread = F.aggregate("changes", letters, lambda all, c: F.when(c["i"] < F.size(all), F.concat(F.slice(all, F.lit(1), c["i"]), F.array(c["base"]), F.slice(all, c["i"] + 2, F.size(all)))).otherwise(all))
    # one start as long as the result, as nearly always: bases are put into the text
    whole = F.aggregate("changes", F.substring(F.get("starts", F.lit(0)), F.lit(1), F.col("least")), lambda all, c: F.when(c["i"] < F.length(all), F.overlay(all, c["base"], c["i"] + 1, F.lit(1))).otherwise(all))
    plain = (F.size("starts") == 1) & (F.length(F.get("starts", F.lit(0))) >= F.col("least"))
    return families.filter("least > 0").select(by, F.when(plain, whole).otherwise(F.array_join(spread, "")).alias("consensus"))


def gap_aligned(pos: Column, gaps: Column) -> Column:
    """A position (from 0) after a null is inserted at each gap index, one after the other."""
    return F.aggregate(gaps, pos.cast("int"), lambda p, g: F.when(p >= g, p + 1).otherwise(p))


def recentred(frame: DataFrame, pos: str, centre: str) -> DataFrame:
    """Positions shifted so that all rows' centres fall on the greatest one."""
    most = frame.agg(F.max(centre)).first()[0]
    return frame.withColumn(pos, F.col(pos) + F.lit(most) - F.col(centre))


def best_by(frame: DataFrame, by: list[str], score: str, choice: str) -> DataFrame:
    """The choice of the greatest score in each group; of equal scores the least choice."""
    return frame.groupBy(*by).agg(F.min(F.struct((-F.col(score)).alias("less"), F.col(choice))).alias("x")).select(*by, f"x.{choice}", (-F.col("x.less")).alias(score))


def pick_best_model(models: DataFrame, order: str, refit: str, bound: str) -> DataFrame:
    """The last refitted model with a positive lower bound, else the first refitted one; no refitted model, no row."""
    place = F.struct((F.col(bound) > 0).alias("good"), F.when(F.col(bound) > 0, F.col(order)).otherwise(-F.col(order)).alias("place"), F.col(order).alias(order))
    return models.filter(F.col(refit)).agg(F.max(place).alias("x")).filter("x IS NOT NULL").select(f"x.{order}")


def model_search(scores: Sequence, ratio: Callable[[object, object], float | None]) -> object:
    """The model that a greedy search by complexity ends at: stops at the first that is no better than the one before; ratio(model, reference)."""
    best = scores[0]
    for model in scores[1:]:
        value = ratio(model, best)
        if value is None or value < 0:
            break
        best = model
    return best


def transposed(frame: DataFrame, key: str, columns: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows and columns exchanged: a row (name) for each column, a column for each of the key's values given."""
    tall = frame.select(F.col(key).cast("string").alias("k"), *columns).unpivot("k", list(columns), "name", "value")
    return tall.groupBy("name").pivot("k", list(values)).agg(F.first("value"))


def finite_or_null(value: Column | str) -> Column:
    """Null for infinities and not-a-number."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def nonzero_counts(frame: DataFrame, value: str, zero: float = 1e-6) -> DataFrame:
    """One row: how many finite values aren't zero, and how many stay apart by more than `zero` in order."""
    known = frame.select(finite_or_null(value).alias("v")).filter("v IS NOT NULL")
    cells = known.groupBy("v").agg(F.count("*").alias("n"))  # distinct coefficients: 4**k at most
    step = F.col("v") - F.lag("v").over(Window.orderBy("v"))
    return cells.withColumn("step", step).agg(F.coalesce(F.sum(F.when(F.abs("v") > zero, F.col("n"))), F.lit(0)).alias("n_nonzero"), F.count_if(F.col("step").isNull() | (F.col("step") > zero)).alias("n_unique"))


def nonzero_lines(theta: DataFrame, label: str, value: str, zero: float = 1e-6) -> DataFrame:
    """(place, line): non-zero coefficients as text, from the least to the greatest."""
    known = theta.select(label, finite_or_null(value).alias("v")).filter(F.abs("v") > zero)
    line = F.format_string("%.3f, (%s)", "v", label)
    return known.select(F.row_number().over(Window.orderBy("v", label)).alias("place"), line.alias("line"))


def interval_lines(theta: DataFrame, label: str, lower: str, value: str, upper: str) -> DataFrame:
    """(place, line): coefficients with their intervals as text, from the least to the greatest; unknown and infinite ones are left out. Theta has 5 * 4**k rows at most."""
    known = theta.select(label, lower, upper, finite_or_null(value).alias("v")).filter("v IS NOT NULL")
    line = F.format_string("%.3f, [%.3f, %.3f] (%s)", "v", lower, upper, label)
    return known.select(F.row_number().over(Window.orderBy("v", label)).alias("place"), line.alias("line"))


def padded_motif(motif: Column | str, left: int, most_left: int, most_right: int) -> Column:
    """A motif in capitals, filled with N to the width of the longest motifs on both sides of the mutating base."""
    motif = F.col(motif) if isinstance(motif, str) else motif
    return F.upper(F.rpad(F.concat(F.lit("N" * (most_left - left)), motif), most_left + 1 + most_right, "N"))


def tree_pairs(tree: DataFrame, sequences: DataFrame) -> DataFrame:
    """(parent_id, child_id, start, end): the sequences at both ends of each edge; tree: (parent_id, child_id), sequences: (node, sequence)."""
    up = sequences.select(F.col("node").alias("parent_id"), F.col("sequence").alias("start"))
    down = sequences.select(F.col("node").alias("child_id"), F.col("sequence").alias("end"))
    return tree.select("parent_id", "child_id").join(up, "parent_id").join(down, "child_id").select("parent_id", "child_id", "start", "end")


def graph_nodes(tree: DataFrame) -> DataFrame:
    """(node, n_children, is_root) of an edge table."""
    ends = tree.select(F.col("parent_id").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(tree.select(F.col("child_id").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("n_children"), (F.max("above") == 0).alias("is_root"))


def group_folds(frame: DataFrame, by: str, folds: int, most: int = 100_000) -> DataFrame:
    """(by, fold): whole groups, the largest first, each into the fold that is smallest so far; ties by the group's name as text.

    The largest `most` groups are balanced by the driver, a few megabytes of
    sizes; groups beyond them, none larger than these, are dealt by a digest,
    which at such a number evens out by itself.
    """
    sizes = frame.groupBy(by).agg(F.count("*").alias("size"))
    order = (F.desc("size"), F.col(by).cast("string").asc_nulls_first())
    large = sizes.orderBy(*order).limit(most).collect()
    held, rows = [0] * folds, []
    for name, size in sorted(large, key=lambda r: (-r[1], r[0] is not None, str(r[0]))):
        fold = held.index(min(held))
        held[fold] += size
        rows.append((name, fold))
    found = frame.sparkSession.createDataFrame(rows, f"{by} {frame.schema[by].dataType.simpleString()}, fold int")
    if len(rows) < most:
        return found
    named = found.select(F.col(by).alias("_done"))
    rest = sizes.join(named, sizes[by].eqNullSafe(named["_done"]), "left_anti")
    return found.unionByName(rest.select(by, F.pmod(F.xxhash64(by), F.lit(folds)).cast("int").alias("fold")))


def category_split(frame: DataFrame, by: str, share: float, seed: str = "c") -> tuple[DataFrame, DataFrame]:
    """(train, validation) by whole categories: int(share * categories) + 1 of them are held out, picked by a digest."""
    ranked = distinct_categories(frame, by, seed)
    held = F.broadcast(ranked.filter(F.col("place") <= int(share * ranked.count()) + 1).select(by))
    return frame.join(held, by, "left_anti"), frame.join(held, by, "left_semi")
