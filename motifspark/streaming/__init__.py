"""Incremental statistics over a stream of sequence files (an addition; the rest of the package is batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.functions.sequences import hamming


def family_statistics(pairs: DataFrame) -> DataFrame:
    """Sequences and mutations by family over a streaming frame of (family, gs, es), for output mode complete or update."""
    return pairs.groupBy("family").agg(F.count("*").alias("n_seqs"), F.sum(hamming("gs", "es")).alias("n_mutations"))
