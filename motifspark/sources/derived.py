"""Genes and mutated sequences derived from the tables customer and orders.

A gene has 64 bases, translated from digests of its key.  A sequence (an
order) has a mutation at each place 2..63 where a digest's digit is 0; its
target and its place in the order of mutations come from further digests.
Every column is computed row by row, so nothing is shuffled but the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.functions.sequences import BASES
from motifspark.functions.texts import padded, texts_of

HEX = "0123456789abcdef"
LENGTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Dealt out by a key where a small table lies in fewer splits than there are cores: the work in a row is far larger than the row."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores, key)


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gk, family, gs)"""
    key = F.col("c_custkey").cast("string")
    digest = F.concat(F.md5(F.concat(F.lit("g"), key)), F.md5(F.concat(F.lit("h"), key)))
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(F.col("c_custkey").alias("gk"), F.col("c_mktsegment").alias("family"), F.translate(digest, HEX, "acgt" * 4).alias("gs"))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sk, gk, family, gs, es, mutations): mutations in their order, as structs of pos and target."""
    orders = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sk"), F.col("o_custkey").alias("gk")), "sk")
    joined = orders.join(genes(spark, sf_dir), "gk")
    # the digests are bound once a row: named inside a lambda, they would be computed anew for every place; the mask is split at its zeros,
    # so that lambdas run over the mutations and not over all places
    found = F.expr(f"""
        transform(array(struct(sk, gs, split(substr(concat(md5(concat('m', sk)), md5(concat('k', sk))), 2, {LENGTH - 2}), '0', -1) AS gaps, concat(md5(concat('t', sk)), md5(concat('u', sk))) AS turn)), r ->
            transform(
                sort_array(transform(
                    aggregate(slice(r.gaps, 1, size(r.gaps) - 1), cast(array() AS array<int>), (all, gap) -> array_append(all, coalesce(try_element_at(all, -1), 1) + length(gap) + 1)),
                    p -> struct(md5(concat(r.sk, '-', p)) AS h, p AS pos,
                        substr('acgtacgt', instr('acgt', substr(r.gs, p, 1)) + 1 + (instr('{HEX}', substr(r.turn, p, 1)) - 1) % 3, 1) AS target))),
                x -> struct(x.pos AS pos, x.target AS target)))[0]""")
    ended = F.expr("aggregate(mutations, gs, (s, x) -> overlay(s PLACING x.target FROM x.pos FOR 1))")
    return joined.select("sk", "gk", "family", "gs", found.alias("mutations")).withColumn("es", ended)


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sk, gk, es) of seqs(), which doesn't depend on the mutations' order."""
    orders = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sk"), F.col("o_custkey").alias("gk")), "sk")
    joined = orders.join(genes(spark, sf_dir).select("gk", "gs"), "gk")
    digests = lambda a, b: F.concat(F.md5(F.concat(F.lit(a), F.col("sk"))), F.md5(F.concat(F.lit(b), F.col("sk"))))
    letters, digits = (np.frombuffer(x.encode(), np.uint8) for x in (BASES, HEX))
    base, number = np.zeros((2, 256), np.uint8)
    base[letters], number[digits] = np.arange(4), np.arange(16)

    def work(stream):
        for batch in stream:
            found, mask, turn = (padded(batch.column(c)) for c in ("gs", "mask", "turn"))
            if mask.size:
                hit = mask == ord("0")
                hit[:, [0, LENGTH - 1]] = False
                found[hit] = letters[(base[found[hit]] + 1 + number[turn[hit]] % 3) % 4]
            es = pc.if_else(batch.column("mask").is_null(), pa.scalar(None, pa.string()), texts_of(found))
            yield pa.RecordBatch.from_arrays([batch.column("sk"), batch.column("gk"), es], names=["sk", "gk", "es"])

    return joined.select("sk", "gk", "gs", digests("m", "k").alias("mask"), digests("t", "u").alias("turn")).mapInArrow(work, "sk long, gk long, es string")
