"""Scans and sinks: genes and sequences, FASTA, motif tables, zero motifs, model specifications, trees, fitted models."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.functions.sequences import disambiguate


def read_gene_seq(spark: SparkSession, genes: str, seqs: str) -> DataFrame:
    """Sequences with their gene's: all columns of seqs (metadata included), and germline_sequence; both cleaned."""
    left, right = (spark.read.csv(x, header=True) for x in (genes, seqs))
    joined = right.join(left.select("germline_name", "germline_sequence"), "germline_name")
    return joined.withColumns({"sequence": disambiguate("sequence"), "germline_sequence": disambiguate("germline_sequence")})


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of a FASTA file; records are split by the reader, so a large file is read in parallel."""
    rows = spark.read.option("lineSep", ">").text(path).filter("value <> ''")
    return rows.select(F.regexp_extract("value", r"^([^\s]*)", 1).alias("name"), F.lower(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("sequence"))


def germline_alleles(records: DataFrame, seed: int = 0) -> DataFrame:
    """(name, sequence) in a reading frame and without unknown bases; records as read_fasta() gives them.

    What is over a multiple of three is cut off, a part of it (by a digest of
    seed and name) before and the rest after; unknown bases are replaced by
    bases that a digest of name and position picks.
    """
    digit = lambda *x: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "name", *x)), 1, 6), 16, 10).cast("int")
    over = F.length("sequence") % 3
    cut = records.withColumn("cut_", digit() % (over + 1)).select("name", F.substring(F.col("sequence"), F.col("cut_") + 1, F.length("sequence") - over).alias("sequence"))
    letters = F.transform(F.split("sequence", ""), lambda x, i: F.when(x.isin("a", "c", "g", "t", ""), x).otherwise(F.substring(F.lit("acgt"), digit(i.cast("string")) % 4 + 1, F.lit(1))))
    return cut.select("name", F.array_join(letters, "").alias("sequence"))


def read_mutability(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(motif, theta) of a mutability table: tall, with blanks between its columns, or wide, one line of motifs and one of values between commas."""
    if wide:
        rows = spark.read.csv(path, header=True)
        rows = rows.limit(1).unpivot([], rows.columns[1:], "motif", "mutability")
    else:
        rows = spark.read.csv(path, sep=" ", header=True, schema="motif string, mutability string")
    value = F.col("mutability")
    return rows.select(F.lower("motif").alias("motif"), F.when(value.isin("NA", "0", "0.0"), float("-inf")).otherwise(F.ln(value.try_cast("double"))).alias("theta"))


def read_substitution(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(motif, target, theta) of a substitution table (motif, A, C, G, T)."""
    rows = spark.read.csv(path, sep=sep, header=True, schema="motif string, A string, C string, G string, T string")
    tall = rows.unpivot("motif", ["A", "C", "G", "T"], "target", "value")
    value = F.col("value")
    return tall.select(F.lower("motif").alias("motif"), F.lower("target").alias("target"), F.when(value.isin("NA", "0", "0.0"), float("-inf")).otherwise(F.ln(value.try_cast("double"))).alias("theta"))


def read_zero_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(motif, pos) whose flag says that they are zero; the file has no header."""
    return spark.read.csv(path, schema="motif string, pos int, flag int").filter("flag = 1").select(F.lower("motif").alias("motif"), "pos")


def read_zero_thetas(spark: SparkSession, path: str) -> DataFrame:
    """(motif, pos, zero, removed) of a file with flags for the shared coefficient and those of a, c, g and t, without a header.

    zero names the coefficients that are held at zero (n for the shared one);
    with four or more of them the motif is removed.
    """
    flags = ["n", "a", "c", "g", "t"]
    rows = spark.read.csv(path, schema="motif string, pos int, " + ", ".join(f"{x}_ int" for x in flags), ignoreLeadingWhiteSpace=True)
    zero = F.array_compact(F.array(*(F.when(F.col(f"{x}_") == 1, F.lit(x)) for x in flags)))
    return rows.select(F.lower("motif").alias("motif"), "pos", zero.alias("zero"), (F.size(zero) >= 4).alias("removed"))


def model_spec(text: str) -> list[dict]:
    """Feature blocks of a model's JSON: motif blocks (motif_length, distances_from_motif_start) and position blocks (breaks, labels)."""
    out = []
    for block in json.loads(text):
        kind = block.get("feature_type")
        if kind not in ("motif", "position"):
            raise ValueError(f"no feature_type {kind!r}")
        out.append(block)
    return out


def read_newick(spark: SparkSession, text: str) -> DataFrame:
    """(parent_id, child_id, name, dist) of a small Newick tree; ids count in reading order, the root's is 0."""
    rows: dict[int, list] = {}
    open_nodes, at = [], -1
    for token in re.findall(r"[(),]|[^(),;\s]+", text):
        if token == "(" or (token not in "()," and at is None):
            at = len(rows)
            rows[at] = [open_nodes[-1] if open_nodes else None, at, "", 0.0]
        if token == "(":
            open_nodes.append(at)
            at = None
        elif token == ",":
            at = None
        elif token == ")":
            at = open_nodes.pop()
        else:
            name, _, dist = token.partition(":")
            rows[at][2], rows[at][3] = name, float(dist or 0)
    return spark.createDataFrame([tuple(r) for r in rows.values() if r[0] is not None], "parent_id int, child_id int, name string, dist double")


def write_model(theta: DataFrame, path: str, notes: dict) -> None:
    """A fitted model: its coefficients as Parquet, with the notes as a JSON column of their own file."""
    theta.write.mode("overwrite").parquet(f"{path}/theta")
    theta.sparkSession.createDataFrame([(json.dumps(notes),)], "notes string").coalesce(1).write.mode("overwrite").text(f"{path}/notes")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/theta"), json.loads(spark.read.text(f"{path}/notes").first()[0])
