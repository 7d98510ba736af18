from pyspark.sql import functions as F

from tidewheel.sources.store import EventLog

SCHEMA = "snapshot_hash string, model_hash string, t long, event_type string, payload string"


def events(spark, days, per_day=40, kind="registered"):
    rows = [(f"s{d}-{i}", f"m{i % 7}", d * 86400 + i * 60, kind, "x" * 50) for d in days for i in range(per_day)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")


def files_read(df):
    """How many files the scan of the log opened."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    text, found = [plan], []
    while text:
        node = text.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            text.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            text.append(node.plan())
            continue
        if name == "FileSourceScanExec" and node.relation().partitionSchema().length():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        text += [children.apply(i) for i in range(children.length())]
    return sum(found)


def test_an_append_reads_only_its_days(spark, tmp_path):
    read = {}
    for n in (1, 60):
        log = EventLog(spark, f"{tmp_path}/log{n}")
        log.append(events(spark, range(n)).coalesce(1))
        batch = events(spark, [0]).withColumn("day", F.lit("1970-01-01"))
        read[n] = files_read(log.known(batch))
        assert log.known(batch).count() == 40
    assert read[1] == read[60] == 1


def test_late_events_are_added_once(spark, tmp_path):
    log = EventLog(spark, f"{tmp_path}/log")
    log.append(events(spark, [5, 9]))
    late = events(spark, [2, 5])
    for _ in range(2):
        log.append(late.unionAll(late))
    log.append(events(spark, [2], kind="validated"))  # another type is another event
    got = sorted((r.snapshot_hash, r.event_type) for r in log.read().collect())
    assert got == sorted([(f"s{d}-{i}", "registered") for d in (2, 5, 9) for i in range(40)] + [(f"s2-{i}", "validated") for i in range(40)])
    assert sorted(log.read().columns) == ["event_type", "model_hash", "payload", "snapshot_hash", "timestamp"]


def test_the_first_of_equal_keys_stays(spark, tmp_path):
    log = EventLog(spark, f"{tmp_path}/log")
    rows = events(spark, [1], 1)
    log.append(rows.withColumn("payload", F.lit("b")).unionAll(rows.withColumn("payload", F.lit("a"))).repartition(3))
    assert [r.payload for r in log.read().collect()] == ["a"]


def test_bounds_prune_days(spark, tmp_path):
    log = EventLog(spark, f"{tmp_path}/log")
    log.append(events(spark, range(10)).coalesce(1))
    found = log.between(F.lit("1970-01-04 00:00:00").cast("timestamp_ntz"), F.lit("1970-01-05 00:10:00").cast("timestamp_ntz"))
    assert files_read(found) == 2
    assert found.count() == 51


def test_a_table_is_stored_once_for_each_state_of_its_files(spark, tmp_path):
    from tidewheel.sources.store import materialized

    path, made = f"{tmp_path}/in.parquet", []

    def make():
        made.append(1)
        return spark.read.parquet(path)

    get = lambda: materialized(spark, "some", [path], make, "k", ["k"])
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(path)
    assert sorted(tuple(r) for r in get().collect()) == sorted(tuple(r) for r in get().collect()) == [(1, "a"), (2, "b")]
    assert len(made) == 1
    spark.createDataFrame([(3, "c")], "k long, v string").write.mode("overwrite").parquet(path)
    assert [tuple(r) for r in get().collect()] == [(3, "c")] and len(made) == 2


def test_plans_over_the_stored_log(spark):
    """No shuffle of the log for summaries and latest events; filters reach its files."""
    from tidewheel.plans import catalog

    sf = "/root/testdata/sf0.001"
    plan = lambda name: catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for name in ("composite_summary", "latest_snapshot", "current_membership"):
        assert "Exchange hashpartitioning" not in plan(name), name
    found = plan("composite_summary")
    assert "PartitionFilters: [event_type" in found and "SelectedBucketsCount" in found
    assert "EqualTo(model_hash,m7)" in plan("history")
    assert "Exchange hashpartitioning" not in plan("latest_snapshot")
