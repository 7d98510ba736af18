import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from tests.llm import test_decontamination, test_packing, test_simhash_dedup
from tidewheel.llm import cotraining, secret_ledger, simhash_dedup

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r[c] for c in P.COLUMNS) for r in df.collect()), key=str)


def clean(text):
    spans = []
    for rule in secret_ledger.RULES:
        pattern = re.compile(rule.pattern, re.ASCII)
        spans += [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f.__name__ for _, f in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "harmonic_packing"]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        given = docs.collect()
        if k < 4:
            assert out.columns == P.COLUMNS and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        if k == 0:
            keep = {r.doc_id for r in cotraining.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
            assert rows(out) == rows(docs.where(F.col("doc_id").isin(list(keep)))) and 0.6 * len(given) < len(keep) < len(given)
        elif k == 1:
            least = {}
            for d, group in zip(given, test_simhash_dedup.jaccard_groups([d.text for d in given])):
                least[group] = min(d.doc_id, least.get(group, d.doc_id))
            assert rows(out) == rows(docs.where(F.col("doc_id").isin(list(least.values())))) and len(least) < len(given)
        elif k == 2:
            bad = {int(h[0]) for h in test_decontamination.slow(given, spark.read.parquet(f"{SF}/benchmark.parquet").collect())}
            assert bad and rows(out) == rows(docs.where(~F.col("doc_id").isin(list(bad))))
        elif k == 3:
            want = sorted(((d.doc_id, clean(d.text), d.lang, d.source, len(clean(d.text))) for d in given), key=str)
            assert rows(out) == want and any("[SECRET]" in w[1] for w in want)
        else:
            pieces = out.collect()
            test_packing.check(given, pieces)
        docs = out


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs.select(*P.COLUMNS)), ("none", no_docs)):
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (docs.count() > 0) == (name == "odd")


def test_run_is_the_stages_in_turn_and_leaves_others_results(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = simhash_dedup.near_duplicates(docs)
    got = P.run(spark, sf)
    assert other.count() == docs.count()  # its scratch tables are still there
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    tokens = lambda df: sorted((r.doc_id, r.start_tokens) for r in df.groupBy("doc_id").agg(F.sum("length").alias("start_tokens")).collect())
    assert tokens(got) == tokens(docs) and got.columns == docs.columns


def test_odd_rows_stage_by_stage(spark, odd_docs):
    """Which rows each stage leaves, with columns whose names clash."""
    kept = lambda k: sorted((str(r.doc_id), (r.text or "")[:9]) for r in P.STAGES[k][1](spark, odd_docs, SF).collect())
    every = sorted((str(r.doc_id), (r.text or "")[:9]) for r in odd_docs.collect())
    assert kept(2) == every and kept(3) == every
    ids = [x for x, _ in kept(1)]
    assert len(ids) == len(set(ids)) and "1" in ids and "2" not in ids and "3" not in ids and "5" not in ids and {"-3", "4", "6", "8", "9", "None"} <= set(ids)
    assert P.simhash_near_dedup(spark, odd_docs, SF).columns == odd_docs.columns
