"""Repeated operations in a stream."""

from tessera.streaming import feed


def test_repeats_within_the_delay_go(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 5, 2), ("b", 1, 3), (None, 2, 4), (None, 3, 5)], "op string, s int, n int").selectExpr("op", "timestamp_seconds(s) AS at", "n")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = feed.deduplicated(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["op"], "at", "10 minutes")
    kept.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = [r["op"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == 3 and set(got) == {"a", "b", None}  # equal keys, null ones too, once each
