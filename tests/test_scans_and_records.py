import json

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import lookup, records, scanner
from tidewheel.sources import nodes


def frames(spark):
    m = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h3", "c")], "model_hash string, name string")
    s = spark.createDataFrame([("h1", "discovered", "p", 1), ("h2", "scan_confirmed", "p", 2), ("h3", "discovered", "q", 3)], "model_hash string, event_type string, source string, t long").withColumn("timestamp", F.timestamp_seconds("t"))
    return m, s


def test_a_scan_with_code(spark):
    m, s = frames(spark)
    asked = []

    def more(row):
        if row["name"] == "bad":
            raise ValueError("no")
        return {"size": row["size"]} if row["size"] else None

    found = spark.createDataFrame([("a", 1), ("n1", 2), ("n2", 0), ("bad", 4), ("out", 9)], "name string, size int")
    done = scanner.scan(m, s, {"p": scanner.Source(found, lambda last: asked.append(last) or True, lambda row: row["size"] < 9, more)}, "r7")
    got = sorted((r.name, r.event_type) for r in done.events.collect())
    assert got == sorted([("a", "scan_confirmed"), ("a", "enriched"), ("n1", "discovered"), ("n1", "enriched"), ("n2", "discovered"), ("bad", "discovered"), ("b", "not_found")])
    assert [json.loads(r.payload) for r in done.events.where("name = 'n1' AND event_type = 'enriched'").collect()] == [{"size": 2, "scan_run_id": "r7"}]
    assert [tuple(r) for r in done.reports.collect()] == [("p", 4, 3, 1, 1)]
    assert [tuple(r) for r in done.errors.collect()] == [("p", "bad", "ValueError: no")]
    assert [x.timestamp() for x in asked] == [2.0]


def test_a_scan_asks_for_each_candidate_once(spark, tmp_path):
    m, s = frames(spark)
    kept, more = f"{tmp_path}/kept", f"{tmp_path}/more"

    def note(path, row, answer):
        with open(path, "a") as f:
            f.write(f"{row['name']}:{','.join(sorted(row))}\n")
        return answer

    found = spark.createDataFrame([(x,) for x in ["a", *(f"n{i}" for i in range(2500))]], "name string").coalesce(1)
    source = scanner.Source(found, None, lambda row: note(kept, row, row["name"] != "n7"), lambda row: note(more, row, {"x": 1}), new_only=True)
    done = scanner.scan(m, s, {"p": source}, "r")
    assert [tuple(r) for r in done.reports.collect()] == [("p", 2500, 2499, 1, 1)]
    assert done.events.where("event_type = 'enriched'").count() == 2499 and done.errors.collect() == []
    for df in (done.events, done.reports, done.errors):  # what is read of a scan runs no Python again
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    lines = lambda path: sorted(open(path).read().split())
    assert lines(kept) == sorted(f"{x}:name" for x in ["a", *(f"n{i}" for i in range(2500))])
    assert lines(more) == sorted(f"n{i}:name" for i in range(2500) if i != 7)


def test_gates_and_platforms(spark):
    m, s = frames(spark)
    found = spark.createDataFrame([("z",)], "name string")
    sources = {"p": scanner.Source(found, lambda last: False), "r": scanner.Source(found, lambda last: False), "q": scanner.Source(found, keep=F.col("name") == "y")}
    done = scanner.scan(m, s, sources, "r")
    assert sorted(tuple(r) for r in done.reports.collect()) == [("p", 0, 0, 0, 0), ("q", 0, 0, 0, 1), ("r", 1, 1, 0, 0)]  # r was never scanned
    assert [tuple(r) for r in scanner.scan(m, s, sources, "r", "r").reports.collect()] == [("r", 1, 1, 0, 0)]
    with pytest.raises(ValueError, match="unknown platform"):
        scanner.scan(m, s, sources, "r", "w")


def test_files_to_nodes(spark):
    files = spark.createDataFrame([("p", "bmFtZTp4"), ("q", "Yg=="), ("r", "YmFk"), ("s", "?")], "project string, content string")

    def parse(project, content):
        if content == "bad":
            raise ValueError(project)
        return {"name": f"{project}/{content[5:]}", "platform": "git", "outputs": [project]} if content.startswith("name:") else None

    found = scanner.parsed(nodes.config_files(files), parse)
    assert sorted((r.project, r.error) for r in found.collect()) == [("p", None), ("r", "ValueError: r")]
    made = nodes.inline_nodes(found.where("item IS NOT NULL")).collect()
    assert [(r.name, r.platform, r.outputs[0].identifier) for r in made] == [("p/x", "git", "p")]


def test_names_before_hashes(spark):
    m = spark.createDataFrame([("h1", "a"), ("h2", "h1"), ("h3", "c")], "model_hash string, name string")
    assert lookup.hash_of(m, "h1") == "h2" and lookup.hash_of(m, "h3") == "h3" and lookup.hash_of(m, "x") is None
    s = spark.createDataFrame([("s1", "h2", 1)], "snapshot_hash string, model_hash string, timestamp long")
    assert [r.snapshot_hash for r in lookup.history(s, m, "h1").collect()] == ["s1"]
    with pytest.raises(ValueError, match="no model x"):
        lookup.history(s, m, "x")


def test_trace_has_platforms_and_labels(spark):
    edges = spark.createDataFrame([("raw", "feat"), ("feat", "score"), ("score", "alert"), ("raw", "score")], "src string, dst string")
    platforms = spark.createDataFrame([("raw", "database"), ("alert", "alerting")], "name string, platform string")
    got = sorted(tuple(r) for r in lookup.trace(edges, "score", platforms).collect())
    assert got == [("alert", "downstream", "feeds_into", 1, 1, "alerting"), ("feat", "upstream", "depends_on", 1, 1, None), ("raw", "upstream", "depends_on", 2, 1, "database")]
    assert [r.name for r in lookup.trace(edges, "feat", platforms, 1, "downstream").collect()] == ["score"]
    assert lookup.trace(edges, "raw", platforms, direction="upstream").collect() == []


def test_trace_copies_no_stored_edges(spark, monkeypatch):
    labels, real = [], lookup.G.stored
    for module in (lookup, lookup.G):
        monkeypatch.setattr(module, "stored", lambda df, label: labels.append(label) or real(df, label))
    edges = spark.createDataFrame([("raw", "feat"), ("raw", "feat"), ("feat", "score"), ("raw", "score"), ("x", "y")], "src string, dst string")
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct().withColumn("platform", F.upper("name"))
    found = lookup.trace(edges, "feat", names, at_hand=True)
    assert sorted((r.name, r.position, r.platform) for r in found.collect()) == [("raw", 1, "RAW"), ("score", 1, "SCORE")]
    assert "edges" not in labels
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Aggregate") < plan.index("LeftSemi")  # platforms of other nodes aren't grouped


def test_record_stores(spark, tmp_path):
    tables = records.stores(spark, f"{tmp_path}")
    for k in (1, 2):
        tables["observations"].put(spark.createDataFrame([("o1", "m:v1", k), (f"o{k + 1}", "m:v2", k)], "observation_id string, model_version_ref string, timestamp long"))
        tables["audit"].put(spark.createDataFrame([("e1", "m", "v1", 1), (f"f{k}", "m", "v2", k)], "event_id string, model_name string, version string, timestamp long"))
    assert sorted((r.observation_id, r.timestamp) for r in records.matching(tables["observations"].read(), model_version_ref=None).collect()) == [("o1", 2), ("o2", 1), ("o3", 2)]
    assert [r.event_id for r in records.audit_log(tables["audit"].read(), "m").collect()] == ["e1", "f1", "f2"]
    assert [r.event_id for r in records.audit_log(tables["audit"].read(), "m", "v1").collect()] == ["e1"]
