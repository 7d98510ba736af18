import json
import random

from pyspark.sql import functions as F

from tidewheel.operators import intervals as V
from tidewheel.operators import membership as B

EVENT = "snapshot_hash string, model_hash string, t int, event_type string, payload string"


def test_intervals_are_the_replay_at_any_time(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        n, kind = rng.choice(["a", "b", "c", "nobody"]), rng.choice(["depends_on", "member_added", "member_removed"])
        payload = {"upstream_hash": rng.choice([n, f"h:{n}"]), "relationship": "member_of"} if kind == "depends_on" else {"member_hash": f"h:{n}", "member_name": n}
        rows.append((f"s{rng.random()}", f"g{rng.randrange(12)}", rng.randrange(30) * 5000, kind, json.dumps(payload)))
    s = spark.createDataFrame(rows, EVENT).withColumn("timestamp", F.timestamp_seconds("t").cast("timestamp_ntz"))
    m = spark.createDataFrame([(f"h:{n}", n) for n in "abc"], "model_hash string, name string")
    spans = V.membership_intervals(s, m).persist()
    asked = spark.createDataFrame([(f"g{g}", k * 2500) for g in range(12) for k in range(-1, 62)], "group_hash string, t int").withColumn("at", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {(r.t, r.group_hash, r.member_hash) for r in V.holding(asked, spans, "group_hash").collect()}
    for k in range(-1, 62, 3):
        want = {(k * 2500, r.group_hash, r.member_hash) for r in B.membership(s, m, F.timestamp_seconds(F.lit(k * 2500)).cast("timestamp_ntz")).collect()}
        assert {x for x in got if x[0] == k * 2500} == want
    assert {(r.group_hash, r.member_hash) for r in spans.where("until IS NULL").collect()} == {tuple(r) for r in B.membership(s, m).collect()}
    spans.unpersist()


def test_holding_equals_all_pairs(spark):
    rng = random.Random(3)
    spans = [(k := rng.choice("xy"), a := rng.randrange(10**6), None if rng.random() < 0.1 else a + int(10 ** rng.uniform(0, 6.5)), i) for i in range(400)]
    points = [(rng.choice("xyz"), rng.randrange(2 * 10**6), i) for i in range(300)] + [(k, a, 1000 + i) for i, (k, a, _, _) in enumerate(spans[:50])] + [(None, 5, -1), ("x", None, -2)]
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    left = spark.createDataFrame(points, "key string, p long, i int").withColumn("at", at("p"))
    right = spark.createDataFrame(spans, "key string, a long, b long, j int").withColumns({"since": at("a"), "until": at("b")})
    want = sorted((i, j) for k, p, i in points for q, a, b, j in spans if k == q and p is not None and a <= p and (b is None or p < b))
    assert sorted((r.i, r.j) for r in V.holding(left, right, "key").collect()) == want
    assert V.holding(left.where("false"), right, "key").collect() == [] and V.holding(left, right.where("false"), "key").collect() == []
