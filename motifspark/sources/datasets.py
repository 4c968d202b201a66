"""Datasets of annotated families: which files to read, their scan, sampling and preparation, and sinks that can run again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.functions.sequences import disambiguate, hamming, known_length
from motifspark.operators.fitting import kept, split
from motifspark.operators.tables import category_split
from motifspark.operators.trees import edge_pairs, impute_ancestors, observed_pairs

from .readers import read_gene_seq

SUFFIX = "-cluster-annotations.csv"
REGIONS, FAMILIES = ("v", "d", "j", "vdj"), ("v", "d", "j")


def resolve_datasets(spark: SparkSession, metadata: str, root: str, wanted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The rows of a metadata file (dataset and other columns) that have a wanted value in each named column, with its annotations_file."""
    rows = spark.read.csv(metadata, header=True)
    for column, values in (wanted or {}).items():
        rows = rows.filter(F.col(column).isin(list(values)))
    return rows.withColumn("annotations_file", F.concat(F.lit(f"{root.rstrip('/')}/partitions/"), F.col("dataset"), F.lit(SUFFIX)))


class Annotations(NamedTuple):
    """What a scan gives: families' genes, their sequences, and the records that could not be used, with a reason."""

    genes: DataFrame
    seqs: DataFrame
    bad: DataFrame


def _listed(column: Column) -> Column:
    """An array of texts, from a JSON array or from parts between colons; null where the JSON is broken."""
    return F.when(F.trim(column).startswith("["), F.from_json(column, "array<string>")).otherwise(F.split(F.coalesce(column, F.lit("")), ":", -1))


def scan_annotations(
    spark: SparkSession, datasets: DataFrame, region: str = "v", germline_family: str = "v", seq_filters: Mapping[str, Sequence[str]] | None = None,
    min_family: int = 0, min_length: int = 0, min_mutated: float = 0.0, max_mutated: float = 1.0, suffix: str = "",
) -> Annotations:
    """Reads the annotation files of the datasets that resolve_datasets() gives; other files are neither listed nor opened.

    A record is a family: v_gene, d_gene and j_gene, its germline (v_gl_seq,
    or naive_seq for the region vdj), and lists with an element for each
    sequence: unique_ids, seqs or v_qr_seqs, mut_freqs where given, and the
    columns of seq_filters.  Sequences stay if their share of mutated bases
    lies in [min_mutated, max_mutated), they have more than min_length known
    bases and their elements have one of the filters' values.  Families of
    fewer than min_family sequences go, and those of which no sequence stays.

    Records without a gene, with broken lists or lists of different lengths
    and lines that aren't records come back as `bad` (dataset, reason, record).
    A family's name has its dataset and a digest of its record, so it doesn't
    depend on how files are read.  The datasets' paths, one for each, are held
    by the driver; their columns are joined by broadcast.
    """
    if region not in REGIONS or germline_family not in FAMILIES:
        raise ValueError(f"region is one of {REGIONS}, germline_family one of {FAMILIES}")
    filters = dict(seq_filters or {})
    germline, texts = ("naive_seq", "seqs") if region == "vdj" else (f"{region}_gl_seq", f"{region}_qr_seqs")
    files = sorted(r[0] for r in datasets.select("annotations_file").distinct().collect())
    meta = [c for c in datasets.columns if c != "annotations_file"]
    if not files:
        kinds = "germline_name string, sequence_name string, sequence string, germline_family string, v_gene string, region string"
        empty = lambda schema: spark.createDataFrame([], schema)
        return Annotations(empty("germline_name string, germline_sequence string"), empty(kinds + "".join(f", {c} string" for c in meta)), empty("dataset string, reason string, record string"))
    columns = spark.read.csv(files[0], header=True, escape='"').columns
    read = spark.read.csv(files, header=True, schema=", ".join(f"`{c}` string" for c in [*columns, "broken_"]), columnNameOfCorruptRecord="broken_", mode="PERMISSIVE", escape='"')
    rows = read.select("*", F.regexp_replace(F.col("_metadata.file_name"), SUFFIX + "$", "").alias("dataset_"))
    lists = {"unique_ids": _listed(F.col("unique_ids")), "text": _listed(F.col(texts)), **{f"filter_{i}": _listed(F.col(c)) for i, c in enumerate(filters)}}
    if "mut_freqs" in columns:
        lists["freq"] = _listed(F.col("mut_freqs"))
    named = rows.select("*", *(v.alias(f"l_{k}") for k, v in lists.items()))
    uneven = reduce(lambda a, b: a | b, (F.coalesce(F.size(f"l_{k}") != F.size("l_text"), F.lit(True)) for k in lists))
    reason = F.when(F.col("broken_").isNotNull(), "not a record").when(F.coalesce("v_gene", F.lit("")) == "", "no gene").when(F.coalesce(F.col(germline), F.lit("")) == "", "no germline").when(uneven, "lists of different lengths")
    record = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    judged = kept(named.withColumns({"reason": reason, "record": record}), "annotations")
    bad = judged.filter("reason IS NOT NULL").select(F.col("dataset_").alias("dataset"), "reason", "record")
    good = judged.filter(F.col("reason").isNull() & (F.size("l_text") >= min_family))
    name = F.concat_ws("-", F.concat(F.lit("clone"), F.col("dataset_")), F.substring(F.md5("record"), 1, 16), *([F.lit(suffix)] if suffix else []))
    family = F.substring(f"{germline_family}_gene", 1, 5)
    spread = good.select("dataset_", name.alias("germline_name"), F.lower(germline).alias("germline_sequence"), family.alias("germline_family"), "v_gene", F.inline(F.arrays_zip(*(F.col(f"l_{k}") for k in lists))).alias(*lists))
    spread = spread.withColumn("sequence", F.lower("text"))
    freq = F.col("freq").try_cast("double") if "freq" in lists else hamming("germline_sequence", "sequence") / F.greatest(known_length("sequence"), F.lit(1))
    wanted = (freq >= min_mutated) & (freq < max_mutated) & (known_length("sequence") > min_length)
    for i, values in enumerate(filters.values()):
        wanted &= F.coalesce(F.col(f"filter_{i}"), F.lit("")).isin([str(x) for x in values])
    chosen = kept(spread.filter(wanted).select("dataset_", "germline_name", "germline_sequence", F.concat_ws("-", "germline_name", "unique_ids").alias("sequence_name"), "sequence", "germline_family", "v_gene", F.lit(region).alias("region")), "chosen")
    seqs = chosen.join(F.broadcast(datasets.select(F.col("dataset").alias("dataset_"), *meta)), "dataset_").drop("dataset_", "germline_sequence")
    return Annotations(chosen.select("germline_name", "germline_sequence").distinct(), seqs, bad)


def one_for_each_family(full: DataFrame, most_mutated: bool, seed: int = 0) -> DataFrame:
    """One sequence of each family (germline_name), by chance or the most mutated one, ties by chance; with the columns of full, both sequences cleaned.

    Families whose pick has no mutation go; for the most mutated one only
    sequences as long as the germline count.  Chance is a digest of seed and
    sequence_name.  A partial aggregation: no family is gathered in a task.
    """
    cleaned = full.withColumns({x: disambiguate(F.lower(x)) for x in ("sequence", "germline_sequence")})
    cleaned = cleaned.filter(F.length("sequence") == F.length("germline_sequence")) if most_mutated else cleaned
    less = -hamming("germline_sequence", "sequence") if most_mutated else F.lit(0).cast("long")
    tie = F.md5(F.concat_ws("-", F.lit(str(seed)), "sequence_name"))
    best = cleaned.groupBy("germline_name").agg(F.min(F.struct(less.alias("less"), tie.alias("tie"), F.struct(*cleaned.columns).alias("row"))).alias("x"))
    return best.select("x.row.*").filter("sequence <> germline_sequence")


def read_observed(spark: SparkSession, genes: str, seqs: str, left: int, right: int, most_unknown: float = 1.0) -> DataFrame:
    """Files of genes and sequences as pairs for the likelihood: joined, cleaned alike, trimmed to flanks, mutations extracted; see observed_pairs(). Metadata stays; pairs without a mutation go."""
    pairs = read_gene_seq(spark, genes, seqs)
    found = observed_pairs(pairs, left, right, "sequence_name", "germline_sequence", "sequence", most_unknown)
    return found.filter(F.size("mutations") > 0)


def imputed_pairs(full: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs along the edges of families' trees, with imputed ancestors, as rows of (germline_name, germline_sequence, sequence_name, sequence).

    edges: (tree, parent_id, child_id): tree and its root are a family's
    germline_name, leaves are sequence_names.  Sequences with inner unknown
    bases or another length than their germline are left out beforehand, and
    their leaves with them; pairs without a mutation too.
    """
    trimmed_ends = lambda x: F.regexp_replace(disambiguate(F.lower(x)), "^n+|n+$", "")
    clean = kept(full.select("germline_name", "sequence_name", trimmed_ends("germline_sequence").alias("g"), trimmed_ends("sequence").alias("s")).filter("NOT contains(s, 'n') AND length(s) = length(g)"), "clean")
    leaves = clean.select(F.col("germline_name").alias("tree"), F.col("sequence_name").alias("node"), F.col("s").alias("sequence"))
    roots = clean.select(F.col("germline_name").alias("tree"), F.col("germline_name").alias("node"), F.col("g").alias("sequence")).distinct()
    given = kept(leaves.unionByName(roots), "given")
    # leaves without a usable sequence go, and inner nodes that have none left below them
    alive = kept(edges.join(roots.select("tree"), "tree", "left_semi"), "edges")
    while True:
        parents = alive.select("tree", F.col("parent_id").alias("node")).distinct()
        dead = alive.join(parents.withColumnRenamed("node", "child_id"), ["tree", "child_id"], "left_anti").join(given.select("tree", F.col("node").alias("child_id")), ["tree", "child_id"], "left_anti").select("tree", "child_id")
        if not dead.limit(1).count():
            break
        alive = kept(alive.join(dead, ["tree", "child_id"], "left_anti"), "edges")
    nodes = alive.select("tree", F.col("parent_id").alias("node")).unionByName(alive.select("tree", F.col("child_id").alias("node"))).distinct()
    found = impute_ancestors(alive, given.join(nodes, ["tree", "node"], "left_semi"))
    pairs = edge_pairs(alive, found).filter("start <> end")
    return pairs.select(F.col("parent_id").alias("germline_name"), F.col("start").alias("germline_sequence"), F.col("child_id").alias("sequence_name"), F.col("end").alias("sequence"))


def write_parts(frame: DataFrame, path: str, by: str, kind: str = "csv") -> None:
    """Writes a folder for each value of `by`; a second run replaces the folders that it writes and leaves others, so rows never double."""
    out = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
    (out.option("header", True).csv if kind == "csv" else out.parquet)(path)


def read_parts(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """What write_parts() wrote; columns of text files are texts."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path) if kind == "csv" else spark.read.parquet(path)


def write_gene_seqs(genes: DataFrame, seqs: DataFrame, path: str, by: str = "germline_family", kind: str = "csv") -> None:
    """Families' germlines and sequences below path/genes and path/seqs, both in parts by a column of seqs."""
    family = seqs.select("germline_name", by).distinct()
    write_parts(genes.join(family, "germline_name"), f"{path}/genes", by, kind)
    write_parts(seqs, f"{path}/seqs", by, kind)


def read_concatenated(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All rows of CSV files, whose columns may differ in order and be missing in some."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.csv(p, header=True) for p in paths))


def prepare(spark: SparkSession, out: str, genes: str | None = None, seqs: str | None = None, annotations: Annotations | None = None, pick: str = "all", edges: DataFrame | None = None, held_out: float = 0.0, held_out_by: str | None = None, seed: int = 0, kind: str = "csv") -> DataFrame:
    """The whole preparation: read, pick or impute, write genes and sequences, split off a held-out part; gives the pairs with their column `part`.

    Input: files of genes and sequences, or scanned annotations.  pick: all,
    random or most_mutated (one of each family), or imputed (pairs along the
    trees of `edges`).  held_out is the share of families that is held out, or
    of the values of held_out_by, whole.  Everything below `out` is replaced
    by a second run.
    """
    if pick not in ("all", "random", "most_mutated", "imputed") or (pick == "imputed") != (edges is not None):
        raise ValueError("pick is all, random, most_mutated or imputed; edges belong to imputed")
    if annotations is None:
        full = read_gene_seq(spark, genes, seqs)
    else:
        full = annotations.seqs.join(annotations.genes, "germline_name")
    full = kept(full, "pairs")
    if pick == "imputed":
        chosen = imputed_pairs(full, edges)
    else:
        chosen = full if pick == "all" else one_for_each_family(full, pick == "most_mutated", seed)
    chosen = kept(chosen, "chosen")
    if held_out_by:
        train, held = category_split(chosen, held_out_by, held_out, f"c{seed}")
    else:
        train, held = split(chosen, held_out, "germline_name", seed)
    parts = kept(train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("held_out"))), "parts")
    write_parts(parts.select("germline_name", "germline_sequence", "part").distinct(), f"{out}/genes", "part", kind)
    write_parts(parts.drop("germline_sequence"), f"{out}/seqs", "part", kind)
    return parts
