"""Running statistics over a stream of files are those of all rows so far."""

from __future__ import annotations

from motifspark.streaming import family_statistics

SCHEMA = "family string, gs string, es string"


def test_family_statistics_of_files_that_come_in_turn(spark, tmp_path):
    source, rows = str(tmp_path / "in"), [("a", "acgt", "acgg"), ("a", "acgt", "acgt"), ("b", "aaaa", "cccc"), ("b", "ac", "ac"), ("c", "g", "t")]
    spark.createDataFrame(rows[:3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query = family_statistics(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("memory").queryName("families").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        got = lambda: {r["family"]: (r["n_seqs"], r["n_mutations"]) for r in spark.table("families").collect()}
        assert got() == {"a": (2, 1), "b": (1, 4)}
        spark.createDataFrame(rows[3:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
        assert got() == {"a": (2, 1), "b": (2, 4), "c": (1, 1)}
    finally:
        query.stop()
