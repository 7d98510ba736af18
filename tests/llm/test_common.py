import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import common as C


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_of_hot_cold_and_missing_keys(spark, monkeypatch, how):
    monkeypatch.setattr(C, "HOT_LEAST", 3)
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot", "hot", "hot", "warm", None, f"k{k}", "lost"]), [k]) for k in range(400)]
    left = spark.createDataFrame(rows, "id long, key string, more array<long>")
    known = {k: f"v{k}" for k in {r[1] for r in rows} - {None, "lost"}}
    right = spark.createDataFrame([(k, sum(r[1] == k for r in rows), v) for k, v in known.items()], "key string, n long, value string")
    got = C.lookup(left, right, "key", "n", 40, how)
    assert right.where("n > 5").count() == 2 and got.columns == ["id", "key", "more"] + ["value"] * (how != "left_semi")
    want = [(*r[:2], *[known.get(r[1])] * (how != "left_semi")) for r in rows if how == "left" or r[1] in known]
    assert sorted(map(str, want)) == sorted(str(tuple(x for c, x in zip(got.columns, r) if c != "more")) for r in got.collect())


def test_components_of_paths_stars_and_repeated_edges(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (5, 300), (300, 5), (5, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(40)]
    label = {x: x for e in edges for x in e}
    for a, b in edges * len(edges):
        if label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    found = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(found) == [g for g in groups(label) if len(g) > 1]
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="share"):
        C.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_only_ones_own_scratch_tables_are_deleted(spark):
    paths: list[str] = []
    other = C.written(spark.range(5), "other")
    with C.collecting(paths):
        own = C.written(spark.range(7), "own", 7)
    assert own.count() == 7 and own.rdd.getNumPartitions() >= 1 and len(paths) == 1
    C.release(spark, paths)
    assert paths == [] and other.count() == 5
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(own.inputFiles()[0]).count()
    assert C.fresh(spark.range(1).withColumn("__KEY", F.lit(1)), "key") == "__key_"
