"""Streams give what the same rows give in a batch."""

from pyspark.sql import functions as F

from canopy.streaming import windows

SCHEMA = "event_id bigint, ts timestamp, user_id bigint"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for n, f in enumerate((lambda d: windows.counts(d, "user_id", "ts"), lambda d: windows.sessions(d, "user_id", "ts", "12 hours"))):
        stream = f(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(f"out{n}").outputMode("complete").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got, want = ({tuple(r) for r in d.collect()} for d in (spark.table(f"out{n}"), f(batch)))
        assert got == want and got
