from pyspark.sql import functions as F

from terralith.streaming.monitor import residual_windows


def test_stream_equals_table(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    table.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = residual_windows(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("residuals").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): (r.n, round(r.rms, 6)) for r in spark.sql("select * from residuals").collect()}
    want = {(r.start, r.event_type): (r.n, round(r.rms, 6)) for r in residual_windows(table).collect()}
    assert got == want and len(got) > 10
