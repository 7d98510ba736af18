import http.server
import json
import random
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.functions import text as T
from tidewheel.operators import graph, ingest, membership
from tidewheel.plans import rules
from tidewheel.sources import nodes
from tidewheel.sources.store import EventLog, LatestTable

EVENT = "snapshot_hash string, model_hash string, event_type string, payload string, timestamp long"
MODELS = [("m1", "one"), ("m2", "two"), ("m3", "m2x"), ("m4", "four")]


def replay(events):
    """The definition: links of relationship member_of, overlaid by additions and removals in order; references are names
    first, then hashes."""
    by_name, hashes = {n: h for h, n in MODELS}, {h for h, _ in MODELS}
    get = lambda ref: by_name.get(ref) or (ref if ref in hashes else None)
    members = set()
    for _, group, kind, payload, _ in events:
        p = json.loads(payload)
        if kind == "depends_on" and p.get("relationship", "depends_on") == "member_of" and get(p["ref"]):
            members.add((group, get(p["ref"])))
    for _, group, kind, payload, _ in sorted(events, key=lambda e: (e[4], e[0])):
        p = json.loads(payload)
        if kind == "member_added" and (get(p["ref"]) or get(p["name"])):
            members.add((group, p["ref"]))
        elif kind == "member_removed":
            members.discard((group, p["ref"]))
    return members


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2"]), st.sampled_from(["depends_on", "member_added", "member_removed"]), st.sampled_from(["m1", "m2", "one", "zzz"]), st.sampled_from(["two", "nobody"]), st.sampled_from(["member_of", "feeds", None]), st.integers(0, 5)), min_size=1, max_size=25))
def test_membership_is_the_replay_of_the_log(spark, found):
    events = []
    for i, (g, t, ref, name, rel, ts) in enumerate(found):
        plain = {"ref": ref, "name": name} | ({"relationship": rel} if rel else {})
        events.append((f"s{i}", g, t, json.dumps(plain), ts))
    given_ = [(s, g, t, json.dumps({**json.loads(p), "upstream_hash": json.loads(p)["ref"], "member_hash": json.loads(p)["ref"], "member_name": json.loads(p)["name"]}), ts) for s, g, t, p, ts in events]
    m = spark.createDataFrame(MODELS, "model_hash string, name string")
    got = {tuple(r) for r in membership.membership(spark.createDataFrame(given_, EVENT), m).collect()}
    assert got == replay(events)


def test_a_known_composite(spark):
    """Three members, one of them removed; two observations, one resolved; one validation."""
    link = lambda n: json.dumps({"upstream": n, "upstream_hash": "h" + n, "relationship": "member_of"})
    of = lambda n: json.dumps({"member_hash": "h" + n, "member_name": n})
    events = [("depends_on", link("feature_pipeline")), ("member_added", of("scoring_model")), ("member_added", of("alert_queue")), ("member_removed", of("alert_queue")),
              ("observation_issued", '{"observation_id": "OBS-1"}'), ("observation_issued", '{"observation_id": "OBS-2"}'), ("observation_resolved", '{"observation_id": "OBS-1"}'), ("validated", "{}"), ("depends_on", '{"upstream_hash": "hother", "relationship": "feeds"}')]
    s = spark.createDataFrame([(f"s{i}", "hgroup", t, p, i) for i, (t, p) in enumerate(events)], EVENT)
    m = spark.createDataFrame([("h" + n, n, "o", "composite" if n in ("group", "empty") else "x", "high", "active", "{}") for n in ("group", "empty", "feature_pipeline", "scoring_model", "alert_queue", "other")], "model_hash string, name string, owner string, model_type string, tier string, status string, metadata string")
    got = {r.name: (r.member_count, r.open_observation_count, r.last_validated) for r in membership.composite_summary(m, s).collect()}
    assert got == {"group": (2, 1, 7), "empty": (0, 0, None)}


def test_closure_with_cycles(spark):
    rng = random.Random(1)
    links = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(30)})
    want = set()
    for root in {a for a, _ in links}:
        seen, todo, hops = {root: 0}, [root], 0
        while todo:
            hops += 1
            todo = sorted({b for a, b in links if a in todo} - seen.keys())
            seen |= dict.fromkeys(todo, hops)
        want |= {(root, n, h) for n, h in seen.items() if n != root}
    e = spark.createDataFrame(links, "src string, dst string")
    got = {tuple(r) for r in graph.closure(e, e.select(F.col("src").alias("root"))).collect()}
    assert got == want


@pytest.mark.parametrize("wide", [0, 6, 13, 40])
def test_wide_frontiers_reach_the_same(spark, monkeypatch, wide):
    rng = random.Random(2)
    links = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(40)]
    e = spark.createDataFrame(links, "src string, dst string")
    reach = lambda: sorted(tuple(r) for r in graph.closure(e, e.select(F.col("src").alias("root"))).collect())
    want = reach()
    monkeypatch.setattr(graph, "WIDE", wide)
    assert reach() == want


def test_wide_frontiers_are_not_shuffled(spark, monkeypatch):
    def moved():
        jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
        found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    links = [(f"p{i}", f"u{(i * 7 + j) % 20}") for i in range(300) for j in range(9)] + [(f"u{i}", f"n{i % 3}") for i in range(20)] + [(f"n{i}", "r") for i in range(3)]
    e = spark.createDataFrame(links, "src string, dst string")
    monkeypatch.setattr(graph, "WIDE", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        assert graph.closure(e, e.where("src LIKE 'p%'").select(F.col("src").alias("root"))).count() == 300 * (9 + 3 + 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved() - before < 20_000


def test_closure_has_no_end_but_the_graph_s(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(75)], "src string, dst string")
    got = {r.node: r.hops for r in graph.closure(e, spark.createDataFrame([("n0",)], "root string")).collect()}
    assert got == {f"n{i}": i for i in range(1, 76)}


def test_trace_puts_sources_first(spark):
    trace = lambda links, root: [(r.node, r.level) for r in graph.trace_order(spark.createDataFrame(links, "src string, dst string"), root).orderBy("position").collect()]
    assert trace([("A", "root"), ("B", "A"), ("B", "root"), ("root", "later")], "root") == [("B", 0), ("A", 1), ("root", 2)]
    cycle = trace([("a", "b"), ("b", "c"), ("c", "b"), ("c", "root"), ("z", "root")], "root")
    assert cycle == [("a", 0), ("z", 0), ("b", 1), ("c", 1), ("root", 2)]
    assert trace([("a", "b"), ("b", "a"), ("b", "root"), ("root", "a"), ("z", "a"), ("root", "root")], "root") == [("z", 0), ("a", 1), ("b", 1), ("root", 1)]


def test_components_of_cycles(spark):
    rng = random.Random(3)
    links = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)} | {("x", "x"), ("y0", "y1")} | {(f"y{i}", f"y{(i + 1) % 9}") for i in range(1, 9)}
    reach = {a: {b for x, b in links if x == a} for a, _ in links}
    for _ in range(70):
        reach = {a: to.union(*(reach.get(b, set()) for b in to)) for a, to in reach.items()}
    want = {a: min(b for b in to if a in reach.get(b, ())) for a, to in reach.items() if len({b for b in to if a in reach.get(b, ())} | {a}) > 1}
    df = spark.createDataFrame(sorted(links) * 2 + [(None, "n1"), ("n2", None)], "src string, dst string")
    assert {r.node: r.component for r in graph.strong_components(df).collect()} == want and len(set(want.values())) > 1
    assert graph.strong_components(df.limit(0)).collect() == []


def test_ports(spark):
    schema = "node string, identifier string, schema map<string,string>"
    out = spark.createDataFrame([("a", "X", {"model_name": "tm-%"}), ("b", "x", {}), ("c", "x", {"model_name": "tm_m2o"}), ("d", "y", {"p": "q"})], schema)
    into = spark.createDataFrame([("e", "x", {"model_name": "TM-m2o"}), ("f", "x", {}), ("g", "x", {"model_name": "uup"}), ("b", "X", {}), ("h", "y", {"p": "Q"}), ("i", "y", {"p": "q", "r": "s"}), ("j", "x", {"model_name": "tm%m2o"})], schema)
    got = sorted(tuple(r)[:2] for r in graph.port_matches(out, into).collect())
    assert got == [("a", "e"), ("b", "f"), ("c", "j"), ("d", "h")]


def test_event_log_keeps_each_event_once(spark, tmp_path):
    log = EventLog(spark, f"{tmp_path}/log")
    events = spark.createDataFrame([("s1", "m1", 1, "registered"), ("s1", "m1", 1, "registered"), ("s1", "m1", 1, "validated"), ("s2", "m1", 2, "registered")], "snapshot_hash string, model_hash string, timestamp long, event_type string")
    log.append(events)
    log.append(events.unionAll(spark.createDataFrame([("s3", "m2", 3, "registered")], events.schema)))
    assert sorted((r.snapshot_hash, r.event_type) for r in log.read().collect()) == [("s1", "registered"), ("s1", "validated"), ("s2", "registered"), ("s3", "registered")]
    tags = LatestTable(spark, f"{tmp_path}/tags", ["model_hash", "name"], "updated_at")
    for k in (1, 2):
        tags.put(spark.createDataFrame([("m1", "prod", f"s{k}", k), (f"m{k}", "dev", "s9", 0)], "model_hash string, name string, snapshot_hash string, updated_at long"))
    assert sorted(tuple(r)[:3] for r in tags.read().collect()) == [("m1", "dev", "s9"), ("m1", "prod", "s2"), ("m2", "dev", "s9")]


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "x", "t": "In"}, {"name": "y", "t": None}], indent=1))
    made = nodes.rows_to_nodes(nodes.json_array(spark, f"{tmp_path}/a.json"), "name", "files", "p:", inputs=("t",)).orderBy("name").collect()
    assert [(r.name, [p.identifier for p in r.inputs]) for r in made] == [("p:x", ["in"]), ("p:y", [])]
    pages = {"": {"data": {"models": [{"name": "a"}, {"name": "b"}]}, "next": "t2"}, "t2": {"data": {"models": [{"name": "c"}]}}}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps(pages[self.path.partition("token=")[2]]).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(nodes.PagedJson)
    df = spark.read.format("paged_json").options(url=f"http://127.0.0.1:{server.server_port}/m", items="data.models", token="next", param="token").load()
    assert [r.n for r in df.select(F.get_json_object("item", "$.name").alias("n")).collect()] == ["a", "b", "c"]
    server.shutdown()


def test_texts(spark):
    sql = "select 1 from a.b join A.B on 1 join x\nINSERT INTO c.d.e CREATE OR REPLACE TABLE f.g MERGE INTO c.D.e {{ x }} model_name LIKE 'tm-%' 'z' AS model_name lookback = 14"
    df = spark.createDataFrame([(sql,), (None,), ("",)], "q string")
    got = df.select(T.read_tables(F.col("q")), T.write_tables(F.col("q")), T.model_filters(F.col("q")), T.lookback(F.col("q"))).collect()
    assert [list(r) for r in got] == [[["a.b"], ["c.d.e", "f.g"], ["tm-%", "z"], "14 days"], [[], [], [], None], [[], [], [], None]]


def test_content_hash_keeps_types_nulls_quotes_and_nesting(spark):
    same = [('{"a": "1", "b": [1, {"d": 1, "c": 2}]}', '{"b":[1,{"c":2,"d":1}],"a":"1","updated_at":"x"}'), ('{"a": 1.0}', '{"a":1}'), ("[1, 2]", "[1,2]"), ('{"\\u00e9": "\\n"}', '{"é":"\\u000a"}')]
    apart = ['{"a":1}', '{"a":"1"}', '{"a":null,"b":"1"}', '{"b":"1"}', '{"a":"x\\",\\"b\\":\\"y"}', '{"a":"x","b":"y"}', "{}", "[]", "bad", '{"a":true}', '{"a":"true"}', '{"a":{"b":1}}', '{"a":{"b":"1"}}', '{"a":[1,2]}', '{"a":[2,1]}']
    df = spark.createDataFrame([(x,) for pair in same for x in pair] + [(x,) for x in apart] + [(None,)], "p string")
    h = [r[0] for r in df.select(ingest.content_hash(F.col("p"))).collect()]
    assert all(h[2 * i] == h[2 * i + 1] for i in range(len(same))) and len(set(h[2 * len(same) : -1])) == len(apart) and h[-1] is None


def test_upsert_takes_the_last_of_equal_keys(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "k string, v string, created_at long")
    new = spark.createDataFrame([("a", "y", 5, 2), ("a", "z", 6, 1), ("c", "w", 7, 1)], "k string, v string, created_at long, at long")
    assert sorted(map(tuple, ingest.upsert(old, new, "k", order="at").collect())) == [("a", "y", 1), ("b", "x", 1), ("c", "w", 7)]


def test_comment_tags_and_templates(spark):
    sql = "-- @owner:\n-- @tier: high\n  -- @Owner : b: c \n-- @tier: low\n--@no: x\n-- @bare\nselect {{a}}.{{ b }}"
    df = spark.createDataFrame([(sql,), (None,), ("",)], "q string")
    got = [(r[0], r[1]) for r in df.select(T.comment_tags(F.col("q")), T.strip_templates(F.col("q"))).collect()]
    assert got[0] == ({"owner": "", "tier": "low", "Owner": "b: c"}, sql.replace("{{a}}", "a")) and got[1:] == [({}, ""), ({}, "")]
    assert df.select(T.tag_pairs(F.array(F.lit("a:b:c"), F.lit("d"), F.lit("a:e")))).first()[0] == {"d": "", "a": "e"}


def test_versions_of_equal_age_have_one_winner(spark, tmp_path):
    tags = LatestTable(spark, f"{tmp_path}/t", ["k"], "v")
    tags.put(spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z")], "k string, v long, s string"))
    assert [tuple(r) for r in tags.read().collect()] == [("a", 1, "y")]


def test_an_unknown_profile(spark):
    with pytest.raises(ValueError, match="unknown profile"):
        rules.violations(spark.range(1), "none")


def test_inline_nodes_deployments_and_files(spark):
    items = spark.createDataFrame([('{"name": "a", "inputs": ["X"], "owner": "o", "n": 1}',), ('{"name": "b", "platform": "p", "outputs": ["x", "Y"]}',)], "item string")
    got = {r.name: (r.platform, [p.identifier for p in r.inputs], [p.identifier for p in r.outputs], r.metadata) for r in nodes.inline_nodes(items).collect()}
    assert got == {"a": ("", ["x"], [], {"owner": "o", "n": "1"}), "b": ("p", [], ["x", "y"], {})}
    schema = "name string, tags array<string>, cron string, entrypoint string, version string, updated timestamp_ntz"
    rows = [("d", ["author:ann", "repo:r:1", "main"], "0 1 * * *", "f", "1", None), ("d", ["main"], None, None, None, None), ("e", ["x"], None, "g", None, None)]
    made = {r.name: r.metadata for r in nodes.deployment_nodes(spark.createDataFrame(rows, schema), "flow", ("main",)).collect()}
    assert made == {"d": {"node_type": "deployment", "owner": "ann", "repo": "r:1", "schedule": "0 1 * * *", "has_schedule": "true", "entrypoint": "f", "version": "1"}}
    files = spark.createDataFrame([("p", "w6k="), ("q", "?"), ("r", None)], "project string, content string")
    assert [tuple(r) for r in nodes.config_files(files).collect()] == [("p", "é")]


def test_connectors_by_name(spark):
    items = spark.createDataFrame([('{"name": "a"}',)], "item string")
    made, errors = nodes.discovered("rest", items, {"platform": "api", "name": "name"})
    assert errors == [] and [r.name for r in made.collect()] == ["a"]
    for name, config, said in ((None, {}, "required"), ("sql", {}, "needs"), ("odd", {}, "unknown"), ("rest", {"x": 1}, "failed")):
        none, (error,) = nodes.discovered(name, items, config)
        assert none is None and said in error


def test_canonical_json_takes_the_last_of_equal_keys_and_one_form_of_numbers(spark):
    alike = [['{"a":1,"a":2}', '{"a":2}', '{"a":2.0}', '{"a":2e0}', '{"a":20e-1}'], ['{"b":{"z":1,"y":2,"z":3}}', '{"b":{"y":2,"z":3}}', '{"b":{"y":2.00,"z":3,"y":2}}'], ['{"s":"x:1.0,","t":[1.0,-5e0,2.50]}', '{"t":[1,-5,2.5],"s":"x:1.0,"}'], ['{"s":"q\\"1.0"}']]
    df = spark.createDataFrame([(k, x) for k, group in enumerate(alike) for x in group], "k int, p string")
    got = df.select("k", ingest.canonical_json(F.col("p")).alias("c")).distinct().collect()
    assert len(got) == len(alike)
    assert {r.k: r.c for r in got} == {0: '{"a":2}', 1: '{"b":{"y":2,"z":3}}', 2: '{"s":"x:1.0,","t":[1,-5,2.5]}', 3: '{"s":"q\\"1.0"}'}


def test_feeds_meet_by_equal_keys(spark):
    from tidewheel.plans import details
    from tidewheel.tables import models

    m = models(spark, "/root/testdata/sf0.001")
    want = spark.sql(details.FEEDS.format(m="{m}"), m=m).select("un", "dh")
    got = details.feeds(m)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    m.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "NestedLoop" not in (plan := details.feeds(m)._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    finally:
        m.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cycles_behind_a_walk_that_lies_on_none(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "g"), ("g", "h")]
    found = graph.strong_components(spark.createDataFrame(edges, "src string, dst string"))
    assert sorted(map(tuple, found.collect())) == [("d", "d"), ("e", "d")]
