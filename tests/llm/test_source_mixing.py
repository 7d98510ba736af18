import itertools
import random
from fractions import Fraction

import pytest

from tidewheel.llm import source_mixing as X

SCHEMA = "doc_id long, text string, sources array<string>"


def most(sizes, members, quotas, copies):
    """The greatest flow, by all cuts between sources."""
    cuts = itertools.product([0, 1], repeat=len(quotas))
    return min(sum(q for q, c in zip(quotas, cut) if not c) + sum(copies * s for s, m in zip(sizes, members) if any(cut[q] for q in m)) for cut in cuts)


def test_flow_meets_most_with_fewest_repeats():
    rng = random.Random(4)
    for _ in range(400):
        n, k, copies = rng.randrange(1, 7), rng.randrange(1, 5), rng.randrange(1, 4)
        sizes = [rng.randrange(0, 30) for _ in range(n)]
        members = [sorted(rng.sample(range(k), rng.randrange(0, k + 1))) for _ in range(n)]
        quotas = [rng.randrange(0, 60) for _ in range(k)]
        routed = X.route(sizes, members, quotas, copies)
        out = [sum(r.values()) for r in routed]
        assert all(set(r) <= set(m) for r, m in zip(routed, members)) and all(x <= copies * s for x, s in zip(out, sizes))
        assert all(sum(r.get(q, 0) for r in routed) <= quota for q, quota in enumerate(quotas))
        assert sum(out) == most(sizes, members, quotas, copies)
        for c in range(1, copies):  # as much as can be is met with c copies, so that costs are least
            assert sum(min(x, c * s) for x, s in zip(out, sizes)) == most(sizes, members, quotas, c)


def test_targets_stop_and_share_the_excess():
    assert [q.target for q in X.shares()({"b": 100, "a": 1000, None: 10}, 1110)] == [1445.0, 200.0, 20.0]
    assert X.shares()({"a": 0}, 0) == [X.Quota("a", 0, 0.0)]
    rng = random.Random(9)
    for _ in range(200):
        sizes = {f"s{i}": rng.randrange(0, 10 ** rng.randrange(1, 6)) for i in range(rng.randrange(1, 30))}
        total = sum(sizes.values())
        found = X.shares()(sizes, total)
        assert abs(sum(Fraction(q.target) for q in found) - Fraction(3 * total, 2)) <= Fraction(max(total, 1), 10**9)
        assert all(q.target <= 2 * q.size for q in found)
        level = [q.target / (5, 2, 1)[i % 3] for i, q in enumerate(found) if q.target < 2 * q.size]
        assert not level or max(level) - min(level) <= 1e-9 * max(level)


def check(rows, found, report, copies=2):
    sizes = {}
    for _, text, sources in rows:
        for s in set(sources or []):
            sizes[s] = sizes.get(s, 0) + len((text or "").encode().split())
    report = {r.source: r for r in report}
    assert {s: r.source_size for s, r in report.items()} == sizes
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.size) for r in found), key=key) == sorted(((i, len((t or "").encode().split())) for i, t, _ in rows), key=key)
    assert all(0 <= r.taken <= copies * r.size and (r.sources or not r.taken) for r in found)
    assert sum(r.taken for r in found) == sum(r.taken for r in report.values())
    return report


def test_overlapping_sources(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_ROWS", 20)  # so that buckets are used
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(0, 40)), rng.choice([["a"], ["a", "b"], ["b", "c", "a"], ["c"], [None], ["c", None, "c"], [], None])) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, report = X.mix(df, X.shares())
    got = found.collect()
    of = check(rows, got, report.collect())
    assert all(r.taken <= r.target + 0.5 for r in of.values())
    names, sets = list(of), {}
    for _, text, sources in rows:
        key = tuple(sorted({names.index(s) for s in sources or []}))
        sets[key] = sets.get(key, 0) + len(text.split())
    assert sum(r.taken for r in of.values()) == most(list(sets.values()), list(sets), [int(of[s].target + 0.5) for s in names], 2)
    by_set = {}
    for r in got:
        by_set.setdefault(tuple(r.sources), []).append(r)
    for same in by_set.values():  # whole copies but for one document, and no second copy while a first one is left
        parts = [r for r in same if r.size and r.taken % r.size]
        assert len(parts) <= 1
        copies = {r.taken // r.size for r in same if r.size and r not in parts}
        assert max(copies, default=0) - min(copies, default=0) <= 1
    again = X.mix(df.repartition(3), X.shares())[0].collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    other = X.mix(df, X.shares(), seed=14)[0].collect()
    assert sorted((r.doc_id, r.taken) for r in other) != sorted((r.doc_id, r.taken) for r in got)


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    from pyspark.sql import functions as F

    df = odd_docs.withColumn("sources", F.array("source"))
    for rows in (20_000, 1):
        monkeypatch.setattr(X, "BUCKET_ROWS", rows)
        found, report = X.mix(df, X.shares())
        of = check([(r.doc_id, r.text, r.sources) for r in df.collect()], found.collect(), report.collect())
        assert all(abs(r.taken - r.target) <= 0.5 for r in of.values())
    found, report = X.mix(no_docs.withColumn("sources", F.array("source")), X.shares())
    assert found.collect() == [] and report.collect() == []
    monkeypatch.setattr(X, "MOST_SETS", 1)
    with pytest.raises(ValueError):
        X.mix(df, X.shares())


def test_quotas_that_cannot_be_met(spark):
    rows = [(1, "a b c", ["x"]), (2, "a b", ["x", "y"]), (3, "q", ["z"])]
    quotas = lambda sizes, total: [X.Quota("x", sizes["x"], 100.0), X.Quota("y", sizes["y"], 3.0)]
    found, report = X.mix(spark.createDataFrame(rows, SCHEMA), quotas)
    assert sorted((r.doc_id, r.taken) for r in found.collect()) == [(1, 6), (2, 4), (3, 0)]
    assert sum(r.taken for r in report.collect()) == 10
