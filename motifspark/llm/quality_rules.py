"""Quality rules whose thresholds follow the corpus: quantile sketches per language and source.

Everything is DataFrame functions.  Each document has a row of measures in
whole thousandths.  A sketch is a frame (lang, source, measure, bucket, n):
counts of values by logarithmic buckets of six significant bits, so a quantile
is at most 1/32 below its true value, and sketches of different inputs merge
by adding counts, in any order, to the same result.  A document stays if all
its measures lie inside the fences of its group, median quartiles less and
plus a multiple of their distance.  Groups of few documents take the merged
sketch of their language, and those of rare languages that of the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textops import free_name, stored

BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS, MARKS, CAPITALS = "#*$%&|<>", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDTH = 8  # words of a window
PRECISION = 6  # significant bits of a sketch's buckets
SPREAD = 6  # quartile distances between a quartile and its fence
MOST_GROUPS = 100_000  # fences of so many groups, some 10 MB, are broadcast; those of more are joined by shuffle


class Measure(NamedTuple):
    """A measure with its fences: `slack` is the least distance of a fence from its quartile."""

    name: str
    slack: int
    low: bool = False


#: Thousandths: of a character a word, symbols and marks a word, of the lines or words or characters.
MEASURES = (Measure("mean_length", 1000, low=True), Measure("symbols", 100), Measure("marks", 200), Measure("capitals", 200), Measure("dup_lines", 200), Measure("repeats", 200))


def _without(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _next(hashes: Column, by: int) -> Column:
    """Hashes of runs twice as long, from those of neighbouring runs of `by` words."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def _covered(words: Column, hashes: Column, width: int) -> Column:
    """Words inside windows that occur twice or more; equal hashes count only where the words are equal too."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, width) == F.slice(words, b["i"] + 1, width))

    def places(rows: Column) -> Column:
        nothing = F.lit(False)
        twice = F.filter(rows, lambda x, j: F.coalesce(same(x, F.get(rows, j - 1)), nothing) | F.coalesce(same(x, F.get(rows, j + 1)), nothing))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    # the sorted rows are bound once, by a lambda, as they are looked into at every place
    found = F.flatten(F.transform(F.array(ordered), places))
    return F.aggregate(found, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])


def features(docs: DataFrame, columns: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns asked for, the counts of the base rules and the measures of each document.

    A null or empty text has zeros.  Repeated rows count each by itself.  A
    text is one row of one task: some forty times its bytes are held while it
    is measured, once its windows repeat.
    """
    text, words, lines = (free_name(x, docs.columns) for x in ("text_", "words_", "lines_"))
    h1, h2, h4, h8 = (free_name(f"h{k}_", docs.columns) for k in (1, 2, 4, 8))
    raw = F.col(text)
    cut = docs.select(*columns, F.coalesce("text", F.lit("")).alias(text))
    cut = cut.select("*", F.filter(F.split(raw, BLANKS), lambda x: x != "").alias(words), F.filter(F.split(raw, "\n"), lambda x: F.translate(x, BLANK_CHARACTERS, "") != "").alias(lines))
    cut = cut.withColumn(h1, F.transform(words, lambda x: F.xxhash64(x)))
    cut = cut.withColumn(h2, _next(F.col(h1), 1)).withColumn(h4, _next(F.col(h2), 2)).withColumn(h8, _next(F.col(h4), 4))
    repeats = F.when(F.size(F.array_distinct(h8)) == F.size(h8), 0).otherwise(_covered(F.col(words), F.col(h8), WIDTH))
    counts = {
        "n_words": F.size(words), "word_chars": F.length(F.translate(raw, BLANK_CHARACTERS, "")), "n_symbols": _without(raw, SYMBOLS), "n_marks": _without(raw, MARKS), "n_capitals": _without(raw, CAPITALS),
        "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeats,
    }
    counted = cut.select(*columns, *(c.cast("long").alias(name) for name, c in counts.items()))
    share = lambda a, b: F.expr(f"({a} * 1000) div greatest({b}, 1L)")
    return counted.select(
        "*", share("word_chars", "n_words").alias("mean_length"), share("n_symbols", "n_words").alias("symbols"), share("n_marks", "n_words").alias("marks"),
        share("n_capitals", "word_chars").alias("capitals"), share("n_dup_lines", "n_lines").alias("dup_lines"), share("n_repeat_words", "n_words").alias("repeats"),
        F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
    )


def bucket(value: Column) -> Column:
    """The least number with the same PRECISION leading bits: a bucket is named by its lower end."""
    shift = F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def quality_sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of documents that pass the base rules; counted before anything is shuffled."""
    each = F.array(*(F.struct(F.lit(m.name).alias("measure"), bucket(F.col(m.name)).alias("bucket")) for m in MEASURES))
    return measured.filter("NOT base_failed").select("lang", "source", F.inline(each)).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merge_sketches(sketches: Sequence[DataFrame]) -> DataFrame:
    """The sketch of all inputs together, from sketches of each; counts add up, so order and grouping don't matter."""
    return reduce(DataFrame.unionByName, sketches).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, measure, n, lower, upper) at the ranks ceil(n/4) and ceil(3n/4). A group has at most some 32 buckets for each power of two, however many rows."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    keys = Window.partitionBy(*by, "measure")
    ranked = merged.select("*", F.sum("n").over(keys.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(keys).alias("total"))
    at = lambda quarter: F.min(F.when(F.col("upto") * 4 >= F.col("total") * quarter, F.col("bucket")))
    return ranked.groupBy(*by, "measure").agg(F.max("total").alias("n"), at(1).alias("lower"), at(3).alias("upper"))


def fences(sketch: DataFrame, least: int = 200) -> DataFrame:
    """(lang, source, level, fence): the fence has low_ and high_ of each measure, by the first of source, lang and corpus with `least` documents or more.

    Where not even the corpus has so many, it decides all the same.
    """
    slack = F.create_map(*(x for m in MEASURES for x in (F.lit(m.name), F.lit(m.slack))))[F.col("measure")]
    reach = F.greatest((F.col("upper") - F.col("lower")) * SPREAD, slack)
    names = [(x, m.name) for m in MEASURES for x in ("low", "high")]

    def level(name: str, by: Sequence[str]) -> DataFrame:
        found = quartiles(sketch, by).select(*by, "measure", "n", (F.col("lower") - reach).alias("low"), (F.col("upper") + reach).alias("high"))
        wide = found.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{x}_{m}") for x, m in names))
        return wide.select(*(F.col(x).alias(f"{name}_{x}") for x in by), F.lit(1).alias(f"{name}_one"), F.struct("n", *(f"{x}_{m}" for x, m in names)).alias(name))

    own, lang, whole = level("source", ("lang", "source")), level("lang", ("lang",)), level("corpus", ())
    joined = own.join(lang, own["source_lang"].eqNullSafe(lang["lang_lang"]), "left").join(whole, own["source_one"] == whole["corpus_one"], "left")
    enough = [(F.col(f"{x}.n") >= least, x) for x in ("source", "lang")]
    pick = lambda value: F.when(enough[0][0], value("source")).when(enough[1][0], value("lang")).otherwise(value("corpus"))
    return joined.select(F.col("source_lang").alias("lang"), F.col("source_source").alias("source"), pick(F.lit).alias("level"), pick(F.col).alias("fence"))


def judged(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds level, broken (the names of the measures outside their fences) and kept.

    A group without fences has no document that passes the base rules, so none
    of its rows needs them.  Fences are joined by broadcast if there are
    MOST_GROUPS of them at most, else by shuffle; rows have no texts.
    """
    few = bounds.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    by = F.broadcast(bounds) if few else bounds
    on = measured["lang"].eqNullSafe(by["lang"]) & measured["source"].eqNullSafe(by["source"])
    outside = [F.when((F.col(m.name) > F.col(f"fence.high_{m.name}")) | ((F.col(m.name) < F.col(f"fence.low_{m.name}")) if m.low else F.lit(False)), F.lit(m.name)) for m in MEASURES]
    joined = measured.join(by, on, "left").drop(by["lang"]).drop(by["source"])
    return joined.withColumn("broken", F.array_compact(F.array(*outside))).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("fence")


def quality_report(docs: DataFrame, least: int = 200) -> DataFrame:
    """A row for each document: counts, level, broken rules and the verdict.

    A null or empty text has no words and fails.  Null langs and sources are
    groups of their own.  Repeated rows count and are judged each by itself.
    An empty table gives no rows.  Columns of docs other than doc_id, text,
    lang and source are ignored.
    """
    measured = stored(features(docs.select("doc_id", "text", "lang", "source")), "quality-measures")
    return judged(measured, stored(fences(quality_sketch(measured), least), "quality-fences"))


def quality_filter(docs: DataFrame, bounds: DataFrame | None = None, least: int = 200) -> DataFrame:
    """The documents that are kept, with the columns of docs; bounds: fences of an earlier corpus, or of this one where not given."""
    if bounds is None:
        bounds = stored(fences(quality_sketch(features(docs.select("text", "lang", "source"), ("lang", "source"))), least), "quality-fences")
    row = free_name("row_", docs.columns)
    whole = docs.select(F.struct(*docs.columns).alias(row), "text", "lang", "source")
    measured = features(whole, (row, "lang", "source"))
    return judged(measured, bounds).filter("kept").select(f"{row}.*")
