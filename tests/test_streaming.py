from keelson.streaming import lifecycle


def test_stream_equals_batch(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    query = lifecycle.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = lifecycle.windowed_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    key = lambda rows: sorted((r.starts_at, r.event_type, r.n, round(r.total, 6)) for r in rows)
    assert key(spark.table("windowed").collect()) == key(batch.collect())


def test_lifecycle_state(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    query = lifecycle.lifecycles(stream).writeStream.format("memory").queryName("lives").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("lives").collect()
    assert rows and {r.outcome for r in rows} <= {"completed", "expired"}
