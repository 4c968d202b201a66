"""A training-corpus pipeline: five stages, each on all that the one before has kept.

Quality classifier, fuzzy line dedup, n-gram Jaccard join, benchmark
decontamination and best-fit packing.  Every stage takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.llm.decontaminate import decontaminate
from motifspark.llm.jaccard_join import jaccard_components
from motifspark.llm.line_dedup import dedup_lines
from motifspark.llm.packing import pack
from motifspark.llm.quality import fit_quality, score_quality
from motifspark.llm.queries import table, tokenizer_path
from motifspark.llm.textops import free_name, stored


#: Rows of an Arrow batch: 10,000 whole texts are tens of megabytes, held several times by the JVM and the worker.
BATCH_ROWS = 2_000


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to BATCH_ROWS; a lower setting stays. No result depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are, repeated rows each by itself.

    Null and empty texts are scored as the empty text; a score of exactly 1/2
    stays.  Without a label for any document all stay.
    """
    _small_batches(spark)
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), keep=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line stays of each component of lines of similarity 0.8; n_chars follows the text.

    A document of which no line stays goes, as do all but one of rows that
    agree in id and text.  Null texts and texts without lines stay, each row
    of them.  Of equal lines the first one stays, by id (nulls first) and place.
    """
    _small_batches(spark)
    return _counted(dedup_lines(docs, percent=80), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows linked by 5-word shingles of similarity 0.8, directly or through others, one stays.

    It is the one of the smallest id, nulls last, and of rows that share it any
    one.  Rows are told apart by a key that is stored with them, so rows of
    null or repeated ids count each by its own text.  Null and wordless texts
    link with nothing and stay.
    """
    _small_batches(spark)
    key = free_name("row_key", docs.columns)
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80)
    rows = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id")).join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    kept = rows.groupBy("component_id").agg(F.min(F.struct(F.isnull("id").alias("last"), "id", "row")).alias("best")).select(F.col("best.row").alias(key))
    gone = keyed.select(key).join(kept, key, "left_anti")
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which they are more than a fifth of the words go.

    Null and wordless texts and texts without a passage stay as they are,
    repeated rows each by itself; with no benchmark all stay.
    """
    _small_batches(spark)
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 2048 tokens.

    A null or empty text is one piece of one token, the end; repeated rows are
    packed each by itself.
    """
    _small_batches(spark)
    return pack(docs, tokenizer_path(), capacity=2048)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars again, where the documents have it."""
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the session's rows a batch are as they were when it ends."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        docs = table(spark, sf_dir, "documents")
        for stage_name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{stage_name}")
    finally:
        spark.conf.set(name, before)
    return docs


#: The classifier, MinHash and the tokenizer are beyond SQL; tests/llm/test_pipeline.py follows each stage and the chain by brute force.
ORACLE_SQL = None
