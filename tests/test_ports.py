import random
import re
import time

from tidewheel.operators import graph as G

SCHEMA = "node string, identifier string, schema map<string,string>"


def matches(a, b):
    like = lambda value, pattern: re.fullmatch(".*".join(map(re.escape, pattern.lower().split("%"))), value.lower(), re.S) is not None
    return like(b, a) if "%" in a else like(a, b) if "%" in b else a.lower() == b.lower()


def brute(outputs, inputs):
    found = {}
    for u, x, s in outputs:
        for d, y, t in inputs:
            if u != d and x.lower() == y.lower() and s.keys() == t.keys() and all(matches(s[k], t[k]) for k in s):
                found[u, d] = min(found.get((u, d), x.lower()), x.lower())
    return sorted((*k, v) for k, v in found.items())


def test_patterns_on_both_sides(spark):
    rng = random.Random(6)
    value = lambda: "".join(rng.choice(["a", "B", "b", "_", "%", "!", "c"]) for _ in range(rng.randrange(0, 7)))
    schema = lambda: {k: value() for k in rng.sample(["model", "kind"], rng.randrange(0, 3))}
    ports = lambda p, n: [(f"{p}{i % 60}", rng.choice(["T", "t", "u"]), schema()) for i in range(n)]
    outputs, inputs = ports("n", 250), ports("n", 250)
    got = G.port_matches(spark.createDataFrame(outputs, SCHEMA), spark.createDataFrame(inputs, SCHEMA)).collect()
    want = brute(outputs, inputs)
    assert sorted(tuple(r) for r in got) == want and len(want) > 500


def test_anchors(spark):
    values = ["tm-%", "%-x", "a%bcd", "%", "%ab%", "a%b%cde", "ab%%c"]
    got = [tuple(r.a) for r in spark.createDataFrame([(v,) for v in values], "v string").select(G.anchored(G.F.col("v")).alias("a")).collect()]
    assert got == [("p", 3, "tm-"), ("s", 2, "-x"), ("s", 3, "bcd"), ("p", 0, ""), ("p", 0, ""), ("s", 3, "cde"), ("p", 2, "ab")]


def test_a_hundred_thousand_ports_of_one_shared_table(spark):
    n = 100_000
    made = spark.range(n)
    out = made.selectExpr("concat('o', id) AS node", "'Scores' AS identifier", "map('model_name', concat('model-', lpad(id, 6, '0'), '%')) AS schema")
    into = made.selectExpr("concat('i', id) AS node", "'scores' AS identifier", "map('model_name', concat('MODEL-', lpad(id, 6, '0'), '-eu')) AS schema")
    start = time.time()
    found = G.port_matches(out, into)
    assert found.where("substr(upstream, 2) = substr(downstream, 2)").count() == found.count() == n
    assert time.time() - start < 60  # all pairs would be ten thousand million


def test_tasks_are_as_many_as_ports_need(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_PORTS", 10)
    made = spark.range(100)
    out = made.selectExpr("concat('o', id) AS node", "concat('T', id) AS identifier", "map('kind', 'k%') AS schema")
    into = made.selectExpr("concat('i', id) AS node", "concat('t', id) AS identifier", "map('kind', 'K1') AS schema")
    found = G.port_matches(out, into)
    assert found.count() == 100 and found.rdd.getNumPartitions() == 20
    assert "ilike" not in found._jdf.queryExecution().toString().lower()  # one wildcard at an end: equal tags are the match
