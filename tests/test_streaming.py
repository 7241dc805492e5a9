from pyspark.sql import functions as F

from ashlar.streaming.profile import windowed_profile


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(200).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("x"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_profile(stream, "ts", "x").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    plain = lambda t: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect())
    got = plain(spark.table("windows"))
    assert got == plain(windowed_profile(df, "ts", "x")) and len(got) == 4
