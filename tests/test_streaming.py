from pyspark.sql import functions as F

from tidewheel.sources.store import EventLog
from tidewheel.streaming import log as stream


def test_each_event_is_appended_once(spark, tmp_path):
    rows = [(f"s{i % 7}", f"m{i % 3}", "registered" if i % 2 else "validated", i) for i in range(20)]
    df = spark.createDataFrame(rows, "snapshot_hash string, model_hash string, event_type string, i int").withColumn("timestamp", F.timestamp_seconds(F.col("i") * 7200)).drop("i")
    df.limit(12).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    source = lambda: spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    log = EventLog(spark, f"{tmp_path}/log")
    stream.ingest(source(), log, f"{tmp_path}/cp").awaitTermination()
    df.write.parquet(f"{tmp_path}/in/b")
    stream.ingest(source(), log, f"{tmp_path}/cp").awaitTermination()
    want = {(f"s{i % 7}", "registered" if i % 2 else "validated") for i in range(20)}
    got = [(r.snapshot_hash, r.event_type) for r in log.read().collect()]
    assert sorted(got) == sorted(want)


def test_activity_by_window(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", "registered", i) for i in range(30)], "snapshot_hash string, event_type string, i int").withColumn("timestamp", F.timestamp_seconds(F.col("i") * 7200 + 864000)).drop("i")
    df.write.parquet(f"{tmp_path}/in")
    q = stream.activity(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("activity").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("activity").collect()) == [6, 12, 12]
