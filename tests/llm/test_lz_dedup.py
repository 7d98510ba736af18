import hashlib
import random
import re
from collections import Counter

from tidewheel.llm import lz_dedup as L

SF = "/root/testdata/sf0.01"


def check(docs, rows, window=35):
    split = [(d.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    want = []
    for key, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        want.append((str(key), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [(str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.removed), r.kept_text) for r in rows]
    assert sorted(got) == sorted(want)
    return want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = check(docs.collect(), L.dedup(docs).collect())
    got = L.op8_relative_lz_dedup(spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs.collect(), L.dedup(odd_docs).collect())
    assert L.dedup(no_docs).collect() == []


def test_small_alphabet_and_overlaps(spark):
    rng = random.Random(3)
    rows = []
    passages = [[rng.choice("abc") for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    for k in range(150):
        words = []
        while len(words) < rng.randrange(0, 200):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randrange(1, 50)] if rng.random() < 0.7 else [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 20))]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (9, 12, 35):
        check(df.collect(), L.dedup(df, window=window).collect(), window)


def test_copies_that_begin_in_a_slice_with_a_cut_of_its_own(spark):
    """Pairs end alike, a few words before a passage that other documents hold too."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(200):
        same, passage = some(rng.randrange(1, 12)), some(60)
        rows += [some(50) + same + passage for _ in range(2)] + [some(50) + passage for _ in range(4)]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string")
    check(df.collect(), L.dedup(df).collect())


def plain_parse(docs, window):
    """Slices of each document, a dictionary of their words, and a walk from left to right."""
    where, parsed = {}, {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        w = (d.text or "").encode().split()
        if len(w) >= window:
            s = L.Sliced(w, window)
            parsed[d.doc_id] = [(int(a), tuple(w[a : b + window])) for a, b, real in zip(s.lo, s.hi, s.real) if real]
            for k, (a, x) in enumerate(parsed[d.doc_id]):
                where.setdefault(x, []).append((d.doc_id, k, a))
    out = {}
    for key, slices in parsed.items():
        found, last = [], None
        for a, x in slices:
            here = min(where[x])
            if len(where[x]) == 1:
                last = None
            elif last and here[0] == last[0] and here[1] == last[1] + 1:
                found[-1][1] = a + len(x) - found[-1][0]
                last = here
            else:
                found.append([a, len(x), here[0], here[2]])
                last = here
        out[key] = [tuple(f) for f in found]
    return out


def test_factors_are_those_of_a_plain_parse(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    rows, given = L.dedup(docs).collect(), docs.collect()
    want, words = plain_parse(given, 35), {d.doc_id: (d.text or "").encode().split() for d in given}
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in rows}
    assert got == {k: want.get(k, []) for k in got} and sum(map(len, got.values())) > 100
    assert max(f[1] for x in got.values() for f in x) > 100
    for key, found in got.items():
        for start, length, source, at in found:
            assert length >= 35 and words[key][start : start + length] == words[source][at : at + length]


def test_a_forced_clash_of_hashes_removes_nothing(spark, monkeypatch):
    """The first hash is the same for all slices and windows of one length: the second tells them apart."""
    rolled = L.Sliced.rolled
    monkeypatch.setattr(L.Sliced, "tiles", lambda self, which: rolled(self, *[x for x in (L.np.where(self.real, self.lo, 0), L.np.where(self.real, self.hi - self.lo + self.window, 0))], 1) % L.np.uint64(1 if which == 0 else 2**63))
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(10**9)}" for _ in range(80))) for k in range(20)]
    rows += [(100 + k, rows[k][1]) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df.collect(), L.dedup(df).collect())
