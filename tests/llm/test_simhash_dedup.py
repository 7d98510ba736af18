import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import simhash_dedup as S

SF = "/root/testdata/sf0.01"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps, radius=3):
    fps = sorted(set(fps))
    arr = np.array(fps, np.uint64)
    seen, label = set(), {}
    for f in fps:
        if f in seen:
            continue
        todo = [f]
        seen.add(f)
        while todo:
            x = todo.pop()
            label[x] = f
            for y in arr[np.bitwise_count(arr ^ np.uint64(x)) <= radius]:
                if int(y) not in seen:
                    seen.add(int(y))
                    todo.append(int(y))
    return label


def check(docs, rows):
    prints = [(d.doc_id, slow_print(d.text)) for d in docs]
    label = slow_groups([p for _, p in prints])
    least = {}
    for key, p in prints:
        if key is not None:
            least[label[p]] = min(key, least.get(label[p], key))
    want = sorted((str(k), f"{p:016x}", str(least.get(label[p]))) for k, p in prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").collect(), S.op5_simhash_gray_dedup(spark, SF).collect())


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs.collect(), S.near_duplicates(odd_docs).collect())
    assert S.near_duplicates(no_docs).collect() == []


def jaccard_groups(texts, feature=S.FEATURE, radius=S.WIDE, size=5, similarity=0.8):
    """Groups of texts by links that are similar, among texts of one component of fingerprints."""
    prints = [S.fingerprint((t or "").encode(), feature) for t in texts]
    label = slow_groups(prints, radius)
    texts = [t or "" for t in texts]
    near = lambda i, j: label[prints[i]] == label[prints[j]]
    split = [tuple(re.findall(r"[^\x20\x09-\x0D]+", low(t))) for t in texts]
    sets = [{w[i : i + size] for i in range(max(1, len(w) - size + 1))} if w else set() for w in split]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and (split[i] == split[j] or near(i, j) and both >= similarity * (len(sets[i]) + len(sets[j]) - both)):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def same_groups(a, b):
    by = lambda g: sorted(sorted(i for i, x in enumerate(g) if x == v) for v in set(g))
    return by(a) == by(b)


@pytest.mark.parametrize("unit", [S.UNIT_SHINGLES, 150])
def test_near_copies_lose_no_link(spark, monkeypatch, unit):
    monkeypatch.setattr(S, "UNIT_SHINGLES", unit)
    rng, texts = random.Random(4), ["", None, " ", "one", "One"]
    for k in range(40):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([30, 60, 150]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(900)}"
            texts.append(" ".join(copy).replace("w1", rng.choice(["w1", "W1"])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = jaccard_groups(texts)
    got = {r.doc_id: r.group for r in S.near_copies(df).collect()}
    assert same_groups([got[i] for i in range(len(texts))], want) and len(set(want)) < 0.7 * len(texts)


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    rows = S.near_copies(odd_docs.dropDuplicates(["doc_id"])).collect()
    assert len(rows) == odd_docs.select("doc_id").distinct().count()
    group = {r.doc_id: r.group for r in rows}
    assert group[1] == group[2] == group[3] and group[4] == group[5] == group[7] != group[9]
    assert S.near_copies(no_docs).collect() == []


def test_a_bucket_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 2000)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = np.unique(np.array([base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 6))) for _ in range(3000)], np.uint64))
    df = spark.createDataFrame([(int(x),) * 2 for x in fps.view(np.int64)], "fp long, node long")
    roots = {r.node: r.root for r in S.components(S.links(df, len(fps))).collect()}
    want = slow_groups([int(x) for x in fps])
    nodes = [int(x) for x in fps.view(np.int64)]
    assert same_groups([roots.get(x, x) for x in nodes], [want[int(x)] for x in fps])


def test_chain_longer_than_a_range(spark):
    rng = np.random.default_rng(1)
    at, fps = rng.integers(0, 2**63, dtype=np.uint64), []
    for _ in range(3000):  # one long chain of links: its ends differ in many bits
        at = at ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64))
        fps.append(at)
    fps = np.unique(np.concatenate([np.array(fps), rng.integers(0, 2**64, 2000, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) * 2 for x in fps.view(np.int64)], "fp long, node long")
    roots = {r.node: r.root for r in S.components(S.links(df, len(fps))).collect()}
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    want = {int(np.uint64(k).view(np.int64)): v for k, v in slow_groups([int(x) for x in fps]).items()}
    got = {k: roots.get(k, k) for k in want}
    assert groups(got) == groups(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 63), max_size=5), max_size=60), st.integers(0, 6))
def test_search_finds_all_pairs(base, flips, radius):
    for k, bits in enumerate(flips):
        x = base[k % len(base)]
        for b in bits:
            x ^= 1 << b
        base.append(x)
    fps = np.unique(np.array(base, np.uint64))
    bucket = (fps % np.uint64(3)).astype(np.int64)
    index = S.GrayIndex(bucket, fps, 3)
    got = {(int(fps[i]), int(index.values[0][j])) for q, leaf in index.search(bucket, fps, radius, False) for i, j in zip(q, leaf)}
    assert got == {(int(x), int(y)) for x in fps for y in fps if (int(x) ^ int(y)).bit_count() <= radius and int(x) % 3 == int(y) % 3}
    rows = S.Rows({"bucket": np.zeros(len(fps), np.int64), "fp": fps.view(np.int64), "node": np.arange(len(fps))})
    a, b = rows.found(None, radius)
    group = {int(x): {int(x)} for x in fps}
    for x, y in zip(fps[a].tolist(), fps[b].tolist()):
        both = group[x] | group[y]
        group |= dict.fromkeys(both, both)
    label = slow_groups([int(x) for x in fps], radius)
    assert all((group[int(x)] is group[int(y)]) == (label[int(x)] == label[int(y)]) for x in fps for y in fps)
    assert len(a) < len(fps)
