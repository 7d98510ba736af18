import json
import random

from pyspark.sql import functions as F

from tidewheel.operators import membership as B
from tidewheel.sources.store import EventLog
from tidewheel.streaming import groups as G

EVENT = "snapshot_hash string, model_hash string, timestamp timestamp, event_type string, actor string, payload string"


def governed(spark, rows):
    made = [(h, g, t, json.dumps(p), a) for h, g, t, a, p in rows]
    return spark.createDataFrame(made, "snapshot_hash string, model_hash string, t int, payload string, event_type string").withColumn("timestamp", F.timestamp_seconds(F.col("t"))).withColumn("actor", F.lit("x")).selectExpr("snapshot_hash", "model_hash", "timestamp", "event_type", "actor", "payload")


def models(spark, names):
    return spark.createDataFrame([(f"h:{n}", n) for n in names], "model_hash string, name string")


def source(spark, path):
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


MEMBERS = ["feature_pipeline", "scoring_model", "alert_queue"]
COMPOSITE = [
    ("s1", "g", 1, "depends_on", {"upstream": "feature_pipeline", "upstream_hash": "h:feature_pipeline", "relationship": "member_of"}),
    ("s2", "g", 2, "member_added", {"member_name": "scoring_model", "member_hash": "h:scoring_model"}),
    ("s3", "g", 3, "member_added", {"member_name": "alert_queue", "member_hash": "h:alert_queue"}),
    ("s4", "g", 4, "member_removed", {"member_name": "alert_queue", "member_hash": "h:alert_queue"}),
    ("s5", "g", 5, "observation_issued", {"observation_id": "OBS-1"}), ("s6", "g", 6, "observation_resolved", {"observation_id": "OBS-1"}),
    ("s7", "g", 7, "observation_issued", {"observation_id": "OBS-2"}), ("s8", "g", 8, "validated", {}), ("s9", "g", 9, "validated", {}),
    ("s10", "g", 10, "observation_issued", {"observation_id": ""}), ("s11", "g", 11, "member_added", {"member_name": "nobody", "member_hash": "h:nobody"}),
]


def test_composite_in_shuffled_batches(spark, tmp_path):
    m = models(spark, MEMBERS)
    for seed in range(2):
        rows = COMPOSITE[:]
        random.Random(seed).shuffle(rows)
        for k in range(3):  # a run for each batch: every one starts again from the checkpoint
            governed(spark, rows[k::3]).coalesce(1).write.parquet(f"{tmp_path}/in{seed}/{k}")
            G.follow(source(spark, f"{tmp_path}/in{seed}"), m, f"{tmp_path}/facts{seed}", f"{tmp_path}/cp{seed}").awaitTermination()
        (r,) = G.standing(spark, f"{tmp_path}/facts{seed}").collect()
        assert (r.group_hash, r.member_count, r.open_observation_count, r.last_validated.timestamp()) == ("g", 2, 1, 9)


def test_random_log_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(8)]
    rows = []
    for i in range(150):
        n = rng.choice([*names, "nobody"])
        kind = rng.choice(["depends_on", "member_added", "member_added", "member_removed", "member_removed", "observation_issued", "observation_resolved"])
        payload = {"observation_id": f"O{rng.randrange(9)}"} if kind.startswith("obs") else {"upstream_hash": rng.choice([n, f"h:{n}"]), "relationship": rng.choice(["member_of", "feeds"])} if kind == "depends_on" else {"member_hash": f"h:{n}", "member_name": n}
        rows.append((f"s{i}", f"g{rng.randrange(3)}", rng.randrange(40), kind, payload))
    rng.shuffle(rows)
    for k in range(3):
        governed(spark, rows[k::3]).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    m = models(spark, names)
    G.follow(source(spark, f"{tmp_path}/in"), m, f"{tmp_path}/facts", f"{tmp_path}/cp").awaitTermination()
    got = {(r.group_hash, r.kind, r.key) for r in G.current(spark, f"{tmp_path}/facts").collect()}
    s = spark.read.schema(EVENT).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    want = {(r.group_hash, "member", r.member_hash) for r in B.membership(s, m).collect()} | {(r.group_hash, "observation", r.observation_id) for r in B.open_observations(s).collect()}
    assert got == want


def test_a_member_added_on_the_way_is_heard_of(spark, tmp_path):
    m = models(spark, ["a", "b"])
    log = EventLog(spark, f"{tmp_path}/log")
    add = lambda h, t, n, kind="member_added": (h, "g", t, kind, {"member_name": n, "member_hash": f"h:{n}"})
    own = lambda h, n, t, kind="retrained": (h, f"h:{n}", t, kind, {})
    batches = [
        [add("s1", 1, "a"), own("e1", "a", 2), own("e2", "b", 2)], [own("e3", "b", 3), add("s2", 3, "b"), own("e4", "a", 4, "registered")],
        [own("e5", "b", 5, "deployed"), add("s3", 6, "a", "member_removed"), own("e6", "a", 7)],
    ]
    for k, rows in enumerate(batches):
        governed(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        G.propagate(source(spark, f"{tmp_path}/in"), m, log, f"{tmp_path}/cp").awaitTermination()
    found = log.read().collect()
    assert sorted((json.loads(r.payload)["original_snapshot_hash"], r.model_hash, json.loads(r.payload)["member_name"]) for r in found) == [("e1", "g", "a"), ("e3", "g", "b"), ("e5", "g", "b")]
    assert all(r.event_type == "member_changed" and r.actor == "x" and len(r.snapshot_hash) == 32 for r in found)
    # From the start, with a checkpoint of its own: what the last state lets through is in the log already.
    before = {r.snapshot_hash for r in found}
    member = spark.createDataFrame([("g", "h:b")], "group_hash string, member_hash string")
    events = governed(spark, [own("e3", "b", 3), own("e5", "b", 5, "deployed")])
    assert {r.snapshot_hash for r in B.change_events(events, member, m).collect()} <= before


def test_facts_are_kept_by_the_engine(spark, tmp_path):
    """No Python for each fact: an aggregation over the stream holds them."""
    governed(spark, COMPOSITE).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    q = G.follow(source(spark, f"{tmp_path}/in"), models(spark, MEMBERS), f"{tmp_path}/facts", f"{tmp_path}/cp")
    q.awaitTermination()
    assert [o["operatorName"] for p in q.recentProgress[-1:] for o in p["stateOperators"]] == ["stateStoreSave"]
    kept = {(r.kind, r.key) for r in G.current(spark, f"{tmp_path}/facts").collect()}
    assert kept == {("member", "h:feature_pipeline"), ("member", "h:scoring_model"), ("observation", "OBS-2"), ("validated", "")}
