import json
import re

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import discover as D
from tidewheel.operators import graph as G
from tidewheel.operators import ingest as I
from tidewheel.operators import membership as B
from tidewheel.operators import timeline as L
from tidewheel.sources import nodes as N
from tidewheel.sources.store import EventLog, LatestTable

MODEL = "model_hash string, name string, owner string, model_type string, tier string, purpose string, model_origin string, status string, created_at timestamp_ntz, last_seen timestamp_ntz"
EVENT = "snapshot_hash string, model_hash string, timestamp timestamp_ntz, event_type string, actor string, source string, payload string"
GRAPH = [("raw_data", "database", [], ["customers"]), ("feature_pipeline", "etl", ["customers"], ["features"]), ("scoring_model", "ml", ["features"], ["scores"]), ("alert_engine", "alerting", ["scores"], [])]


def nodes(spark, at, rows=GRAPH, **metadata):
    made = [(json.dumps({"name": n, "platform": p, "inputs": i, "outputs": o, **metadata}),) for n, p, i, o in rows]
    return N.inline_nodes(spark.createDataFrame(made, "item string")).withColumn("seen_at", F.lit(at).cast("timestamp_ntz"))


def tables(spark, path):
    return EventLog(spark, f"{path}/log"), LatestTable(spark, f"{path}/models", ["model_hash"], "last_seen")


def kinds(events):
    return {r.event_type: r.n for r in events.groupBy("event_type").agg(F.count("*").alias("n")).collect()}


ALL = {"registered": 4, "discovered": 4, "has_dependent": 3, "depends_on": 3}


def test_an_import_and_its_rerun(spark, tmp_path):
    log, models = tables(spark, tmp_path)
    first = D.ingest(nodes(spark, "2026-04-01 00:00:00", owner="me", status="Deprecated"), spark.createDataFrame([], MODEL), spark.createDataFrame([], EVENT))
    D.write(first, log, models, f"{tmp_path}/stage1")
    assert tuple(first.counts.first()) == (4, 0, 3, 0)
    assert sorted(map(tuple, first.summaries.collect()))[0] == ("alert_engine", "me", "unknown", "alerting", "deprecated")
    assert kinds(log.read()) == ALL
    # The same batch from its stage, and the same nodes as a new batch, add nothing; another content does.
    D.write(first, log, models, f"{tmp_path}/stage1")
    again = D.ingest(nodes(spark, "2026-04-02 00:00:00", owner="me", status="Deprecated"), models.read(), log.read())
    assert tuple(again.counts.first()) == (0, 4, 0, 0) and again.events.collect() == []
    D.write(again, log, models, f"{tmp_path}/stage2")
    assert kinds(log.read()) == ALL
    assert {(r.status, str(r.last_seen), str(r.created_at)) for r in models.read().collect()} == {("deprecated", "2026-04-02 00:00:00", "2026-04-01 00:00:00")}
    more = D.ingest(nodes(spark, "2026-04-03 00:00:00", [("scoring_model", "ml", ["features", "customers"], ["scores"])], owner="me"), models.read(), log.read())
    assert tuple(more.counts.first()) == (1, 0, 1, 3) and kinds(more.events) == {"discovered": 1, "has_dependent": 1, "depends_on": 1}


def test_a_batch_that_failed_halfway(spark, tmp_path):
    want = None
    for k, share in enumerate(("false", "event_type IN ('registered', 'depends_on')", "xxhash64(snapshot_hash) % 2 = 0")):
        log, models = tables(spark, f"{tmp_path}/{k}")
        batch = D.ingest(nodes(spark, "2026-04-01 00:00:00"), spark.createDataFrame([], MODEL), spark.createDataFrame([], EVENT))
        batch.models.write.parquet(f"{tmp_path}/{k}/stage/models")
        batch.events.write.parquet(f"{tmp_path}/{k}/stage/events")
        log.append(batch.events.where(share))  # so far it came
        late = D.ingest(nodes(spark, "2026-04-01 00:00:00"), spark.createDataFrame([], MODEL), log.read() if share != "false" else spark.createDataFrame([], EVENT))
        D.write(late, log, models, f"{tmp_path}/{k}/stage")
        assert kinds(log.read()) == ALL and models.read().count() == 4
        rows = sorted((r.snapshot_hash, r.event_type) for r in log.read().collect())
        want = want or rows
        assert rows == want


def test_nodes_of_one_name_follow_each_other(spark):
    row = [("m", "p", [], [])]
    batch = nodes(spark, "2026-04-01 00:00:00", row, v=1).unionByName(nodes(spark, "2026-04-01 01:00:00", row, v=1, status="retired")).unionByName(nodes(spark, "2026-04-01 02:00:00", row, v=2, status="odd"))
    found = D.ingest(batch, spark.createDataFrame([], MODEL), spark.createDataFrame([], EVENT))
    assert tuple(found.counts.first())[:2] == (3, 0)  # a stated status is part of the content
    (m,) = found.models.collect()
    assert (m.status, str(m.created_at), str(m.last_seen)) == ("retired", "2026-04-01 00:00:00", "2026-04-01 02:00:00")
    payload = json.loads(found.events.where("event_type = 'discovered'").orderBy("timestamp").first().payload)
    assert payload["v"] == "1" and payload["inputs"] == [] and len(payload["_content_hash"]) == 64 and payload["change_detected"].startswith("2026-04-01")


def test_no_nodes(spark):
    found = D.ingest(nodes(spark, "2026-04-01 00:00:00").where("false"), spark.createDataFrame([], MODEL), spark.createDataFrame([], EVENT))
    assert found.events.collect() == [] and tuple(found.counts.first()) == (0, 0, 0, 0)


def test_sources_by_platform(spark):
    sources = {"a": nodes(spark, "2026-04-01 00:00:00", GRAPH[:1]), "b": nodes(spark, "2026-04-01 00:00:00", GRAPH[1:])}
    assert D.nodes_of(sources).count() == 4 and D.nodes_of(sources, "b").count() == 3
    with pytest.raises(ValueError, match="unknown platform"):
        D.nodes_of(sources, "c")


def test_record_registers_and_propagates(spark):
    m = spark.createDataFrame([("h1", "a")], "model_hash string, name string")
    s = spark.createDataFrame([("s1", "g", "2026-01-01 00:00:00", "member_added", "x", None, '{"member_hash":"h1","member_name":"a"}')], EVENT.replace("timestamp_ntz", "string")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    rows = [("a", "retrained", "{}", 1, None), ("a", "validated", "{}", 2, None), ("n", "registered", "{}", 3, "me"), ("n", "registered", '{"x":1}', 4, "you"), ("n", "deployed", "{}", 5, None), ("n", "deployed", "{}", 2, None), ("z", "deployed", "{}", 1, None)]
    asked = spark.createDataFrame([(n, e, p, t, o) for n, e, p, t, o in rows], "model_name string, event string, payload string, t long, owner string")
    asked = asked.withColumns({"timestamp": F.timestamp_seconds("t").cast("timestamp_ntz"), "actor": F.lit("x"), "model_type": F.lit(None).cast("string"), "purpose": F.lit(None).cast("string")})
    found = D.record(asked, m, s)
    assert sorted((r.model_name, r.timestamp.second, r.is_new_model) for r in found.told.collect()) == [("a", 1, False), ("a", 2, False), ("n", 3, True), ("n", 4, False), ("n", 5, False)]
    assert sorted(r.model_name for r in found.errors.collect()) == ["n", "z"]  # before it was born, and never
    assert [(r.name, r.owner) for r in found.models.collect()] == [("n", "me")]
    events = found.events.collect()
    assert sorted(r.event_type for r in events) == ["deployed", "member_changed", "registered", "registered", "retrained", "validated"]
    (changed,) = [r for r in events if r.event_type == "member_changed"]
    assert changed.model_hash == "g" and json.loads(changed.payload)["original_event_type"] == "retrained"


def demo(name, platform, inputs, outputs, owner):
    return json.dumps({"name": name, "platform": platform, "inputs": inputs, "outputs": outputs, "owner": owner, "model_type": "m"})


# A demo graph of seven nodes.
DEMO = [
    demo("customer_features", "database", [], ["customer_data"], "data-team"), demo("transaction_pipeline", "etl", ["raw_transactions"], ["processed_transactions", "customer_data"], "data-team"),
    demo("fraud_scoring", "ml", ["customer_data", "processed_transactions"], ["fraud_scores"], "risk-team"), demo("churn_predictor", "ml", ["customer_data"], ["churn_probabilities"], "growth-team"),
    demo("alert_engine", "alerting", ["fraud_scores"], [], "ops-team"), demo("credit_risk", "ml", ["customer_data", "processed_transactions"], ["credit_scores"], "risk-team"), demo("pricing_rules", "rules", ["credit_scores", "churn_probabilities"], [], "pricing-team"),
]


def test_the_demo_from_nodes_to_a_page(spark, tmp_path):
    log, models = tables(spark, tmp_path)
    made = N.inline_nodes(spark.createDataFrame([(x,) for x in DEMO], "item string")).withColumn("seen_at", F.lit("2026-03-01 00:00:00").cast("timestamp_ntz"))
    first = D.ingest(made, spark.createDataFrame([], MODEL), spark.createDataFrame([], EVENT))
    assert tuple(first.counts.first()) == (7, 0, 9, 0)
    D.write(first, log, models, f"{tmp_path}/stage1")
    rows = [("fraud_scoring", "retrained", '{"accuracy":0.94}', 1), ("fraud_scoring", "deployed", '{"environment":"production","version":"v3.2"}', 2), ("churn_predictor", "retrained", '{"accuracy":0.87}', 3)]
    asked = spark.createDataFrame(rows, "model_name string, event string, payload string, t long").select("*", F.timestamp_seconds(F.col("t") + 1772400000).cast("timestamp_ntz").alias("timestamp"), F.lit("ml").alias("actor"), *[F.lit(None).cast("string").alias(c) for c in ("owner", "model_type", "purpose")])
    group = spark.createDataFrame([("Fraud", "risk-team", "composite", "high", "", ["fraud_scoring", "alert_engine", "nobody"], "x")], "name string, owner string, model_type string, tier string, purpose string, members array<string>, actor string").withColumn("timestamp", F.lit("2026-03-01 01:00:00").cast("timestamp_ntz"))
    new, events = D.register_groups(group, models.read())
    log.append(events)
    models.put(new)
    D.write(D.record(asked, models.read(), log.read()), log, models, f"{tmp_path}/stage2")
    assert kinds(log.read()) == {"registered": 8, "discovered": 7, "depends_on": 11, "has_dependent": 11, "retrained": 2, "deployed": 1, "member_changed": 2}
    s, m = log.read(), models.read().drop("metadata")
    named = {r.name: r for r in L.model_summaries(m, s).collect()}
    assert named["fraud_scoring"].platform == "ml" and named["fraud_scoring"].owner == "risk-team" and named["Fraud"].event_count == 5
    edges = G.dependencies(s, m, B.names(m)).where("direction = 'upstream'").join(m.select("model_hash", "name"), "model_hash").select(F.col("other_name").alias("src"), F.col("name").alias("dst"))
    order = [r.node for r in G.trace_order(edges, "pricing_rules").orderBy("position").collect()]
    assert order == ["customer_features", "transaction_pipeline", "churn_predictor", "credit_risk", "pricing_rules"]
    (page,) = L.investigate(m.withColumn("metadata", F.lit("{}")), s, B.membership(s, m), B.facts(s, m), G.dependencies(s, m, B.names(m)), F.lit("2026-04-01 00:00:00").cast("timestamp_ntz")).where("name = 'fraud_scoring'").collect()
    assert (page.upstream, page.downstream, page.groups) == (["customer_features", "transaction_pipeline"], ["Fraud", "alert_engine"], ["Fraud"])
    assert page.metadata["version"] == "v3.2" and "owner" not in page.metadata


def test_members_with_roles(spark):
    m = spark.createDataFrame([("h1", "g"), ("h2", "a")], "model_hash string, name string")
    asked = spark.createDataFrame([("g", "a", False, "input", "x", 1), ("h1", "h2", True, None, "x", 2), ("g", "z", False, None, "x", 3), ("y", "a", True, "r", "x", 4)], "composite string, member string, removed boolean, note string, actor string, t long").withColumn("timestamp", F.timestamp_seconds("t").cast("timestamp_ntz"))
    events, errors = D.change_members(asked.drop("t"), m)
    got = sorted((r.model_hash, r.event_type, r.timestamp.second, r.payload) for r in events.collect())
    assert got == [
        ("h1", "depends_on", 1, '{"upstream":"a","upstream_hash":"h2","relationship":"member_of"}'), ("h1", "member_added", 1, '{"member_name":"a","member_hash":"h2","role":"input"}'),
        ("h1", "member_removed", 2, '{"member_name":"a","member_hash":"h2"}'), ("h2", "has_dependent", 1, '{"downstream":"g","downstream_hash":"h1","relationship":"member_of"}'),
    ]
    assert sorted((r.composite, r.member) for r in errors.collect()) == [("g", "z"), ("y", "a")]


def test_models_of_an_import_need_no_log(spark):
    def log():
        raise AssertionError("the log was read")

    found = D.ingest(nodes(spark, "2026-04-01 00:00:00"), spark.createDataFrame([], MODEL), log)
    assert found.models.count() == found.summaries.count() == 4
    with pytest.raises(AssertionError, match="the log was read"):
        _ = found.counts


def test_events_at_hand_have_the_hash_of_their_payload(spark):
    odd = ['a"b', "c\\d", "e/f", "é \U0001f600", "\t\n\x01\x7f", "1.0", "{}"]
    m = spark.createDataFrame([(f"h{k}", n) for k, n in enumerate(odd)], "model_hash string, name string")
    pairs = spark.createDataFrame([(x, y, x + y) for x in odd for y in odd], "upstream string, downstream string, via string")
    rows = B.link_rows(pairs, m, "data_flow", "via")
    assert rows.count() == 2 * len(odd) ** 2
    assert rows.where(I.canonical_json(F.col("payload")) != F.col("canonical")).collect() == []
    raised = m.select(F.lit("g").alias("group_hash"), F.col("model_hash").alias("member_hash"), F.col("name").alias("member_name"), F.col("name").alias("cause"), F.lit("s").alias("cause_hash"), F.lit("2026-04-01").cast("timestamp_ntz").alias("timestamp"), F.lit("x").alias("actor"))
    changed = B.change_rows(raised)
    assert changed.where(I.snapshot_hash(F.col("model_hash"), F.col("timestamp"), F.col("payload")) == F.col("snapshot_hash")).count() == len(odd)


def test_texts_of_changes_are_made_once_an_event(spark):
    m = spark.createDataFrame([("h1", "a"), ("h2", "b")], "model_hash string, name string")
    s = spark.createDataFrame([("s1", "h1", "deployed", "x"), ("s2", "h2", "deployed", "x"), ("s3", "h1", "validated", "x")], "snapshot_hash string, model_hash string, event_type string, actor string").withColumn("timestamp", F.lit("2026-04-01").cast("timestamp_ntz"))
    member = spark.createDataFrame([(f"g{k}", "h1") for k in range(9)], "group_hash string, member_hash string")
    found = B.change_events(s, member, m)
    over = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "sha2" in over and "to_json" not in over
    got = found.withColumn("own", I.snapshot_hash(F.col("model_hash"), F.col("timestamp"), F.col("payload"))).collect()
    assert sorted(r.model_hash for r in got) == [f"g{k}" for k in range(9)]
    assert all(r.snapshot_hash == r.own and json.loads(r.payload)["original_snapshot_hash"] == "s1" for r in got)


def test_what_an_import_shuffles(spark):
    """Matches are dealt once, and few upstream ends are not dealt at all; contents go through one shuffle, for their order."""
    found = D.ingest(nodes(spark, "2026-04-01 00:00:00"), spark.createDataFrame([], MODEL), spark.createDataFrame([], EVENT))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "downstream" in " ".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan(found.events)))
    assert not re.findall(r"hashpartitioning\([^)]*upstream[^)]*\)", plan(found.events))
    assert found.discovered.inputFiles() == found.judged.inputFiles()  # they aren't stored once more


def test_many_upstream_ends_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(G, "WIDE", 2)
    found = D.ingest(nodes(spark, "2026-04-01 00:00:00"), spark.createDataFrame([], MODEL), spark.createDataFrame([], EVENT))
    assert found.sources is None and kinds(found.events) == ALL


def test_contents_are_canonical_as_they_are_made(spark):
    odd = ['a"b', "c\\d", "\t\n\x7f", "é \U0001f600", "1.0", ""]
    rows = [(f"n{k}", [("T", {"zeta": x, "alpha": x})], {"updated_at": x, "Z": x, "inputs": x} if k % 2 else {x: x, "_content_hash": x}) for k, x in enumerate(odd)]
    port = "array<struct<identifier:string,schema:map<string,string>>>"
    made = spark.createDataFrame(rows, f"name string, outputs {port}, metadata map<string,string>").select("name", F.lit("p").alias("platform"), F.col("outputs").alias("inputs"), "outputs", "metadata", F.lit("2026-04-01").cast("timestamp_ntz").alias("seen_at"))
    found = D.ingest(made, spark.createDataFrame([], MODEL), spark.createDataFrame([], EVENT))
    p = F.col("payload")
    got = found.discovered.select(p, I.canonical_json(p).alias("canonical"), I.content_hash(p).alias("content"), "snapshot_hash", I.snapshot_hash(F.col("model_hash"), F.col("timestamp"), p).alias("own")).collect()
    assert len(got) == len(odd)
    for r in got:
        assert r.payload == r.canonical and r.snapshot_hash == r.own and json.loads(r.payload)["_content_hash"] == r.content
    again = D.ingest(made.withColumn("seen_at", F.lit("2026-04-02").cast("timestamp_ntz")), found.models, found.events)
    assert tuple(again.counts.first())[:2] == (0, len(odd))


def test_names_of_links_are_those_of_dependencies(spark):
    m = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h3", "h1"), ("h4", "b"), ("h5", None)], "model_hash string, name string")
    refs = [("h1", "b"), ("zz", "b"), (None, "b"), ("", "h1"), ("h3", None), ("zz", "zz"), (None, None), ("h5", "a"), ("zz", "a")]
    said = [(own, kind, json.dumps({k: v for k, v in (("upstream_hash", h), ("upstream", n)) if v is not None})) for h, n in refs for own in ("h1", "h2", "gone") for kind in ("depends_on", "has_dependent")]
    s = spark.createDataFrame([*said, ("h1", "depends_on", "odd")], "model_hash string, event_type string, payload string")
    want = G.dependencies(s, m, B.names(m)).where("direction = 'upstream'").join(m, "model_hash").select("other_name", "name")
    got = G.linked_names(s, m, B.named(m))
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(got) == key(want) and got.count() == 14


def test_events_that_an_import_does_not_read(spark):
    empty = spark.createDataFrame([], EVENT)
    first = D.ingest(nodes(spark, "2026-04-01 00:00:00"), spark.createDataFrame([], MODEL), empty)
    more = nodes(spark, "2026-04-03 00:00:00", [("scoring_model", "ml", ["features", "customers"], ["scores"])])
    sure = lambda log: sorted(map(tuple, D.ingest(more, first.models, log).events.collect()))
    whole = sure(first.events)
    assert len(whole) == 3 and whole == sure(first.events.where(F.col("event_type").isin(*D.READ)))
