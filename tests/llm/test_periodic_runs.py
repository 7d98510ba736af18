import hashlib
import random
import re
import zlib

import pytest

from tidewheel.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute(w):
    """Runs by their definition: for each period, the stretches of places that agree with the place a period on."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def check(docs, found):
    want = sorted((str(d.doc_id), len(w := words(d.text)), r := brute(w), kept(w, r)) for d in docs)
    assert sorted((str(r.doc_id), r.n_words, sorted((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in found) == want


def test_words_of_few_letters():
    rng = random.Random(5)
    n_runs = 0
    for k in range(1500):
        w = []
        while len(w) < rng.randrange(1, 120):
            p = [rng.choice("abc"[: 1 + k % 3]) for _ in range(rng.randrange(1, 12))]
            w += (p * rng.randrange(1, 9))[: rng.randrange(1, 80)]
        got = P.runs_of([x.encode() for x in w])
        assert sorted(got) == brute(w), w
        assert P.main_lorentz([ord(x) for x in w]) == brute(w)
        n_runs += len(got)
    assert n_runs > 1000


def test_mask_covers_every_run():
    assert P.least_overlap(6, 4) == 5
    import numpy as np

    ids = np.array([7, 1, 2, 1, 2, 1, 2, 1, 2, 9, 8])
    assert P.repeated(ids, 5).tolist() == [False] + [True] * 8 + [False] * 2


def test_long_runs_take_little_time():
    assert P.runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 100_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert P.runs_of(fibonacci[1]) == []  # no fourth power in it


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs.collect(), P.periodic_runs(odd_docs).collect())
    assert P.periodic_runs(no_docs).collect() == []
    rows = [(1, "x " * 50), (2, " a b\ta b\na b a b c a b a b a b a b "), (3, "a a a a a"), (4, "a a a a a a"), (None, "a b " * 9), (1, "x " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs.collect(), P.periodic_runs(docs).collect())
    with pytest.raises(ValueError):
        P.periodic_runs(docs, times=3)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in P.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    repeats = 0
    for d in docs:
        w, h = words(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = brute(w)
        repeats += len(runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[d.doc_id]
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(w, runs).encode()).hexdigest()
    assert repeats > 5
