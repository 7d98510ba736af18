import random
from collections import Counter

import regex

from tidewheel.llm import decontamination as D

SF = "/root/testdata/sf0.01"


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def slow(docs, items, similarity=0.8):
    """Every window of every document against every item that shares a word shingle with the document."""
    out = []
    prepared = []
    for i in items:
        w = words(i.text)
        if w:
            k = min(5, len(w))
            prepared.append((i.item_id, len(w), k, Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))))
    for d in docs:
        w, best = words(d.text), {}
        grams = {k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for k in range(1, 6)}
        for key, n, k, shingles in prepared:
            if not grams[k] & shingles.keys():
                continue
            size = min(n, len(w))
            for s in range(len(w) - size + 1):
                mine = Counter(tuple(w[s + j : s + j + k]) for j in range(size - k + 1))
                both = sum((mine & shingles).values())
                sim = both / (sum(mine.values()) + sum(shingles.values()) - both)
                if sim >= similarity - 1e-12 and (sim, -s) > best.get(key, (0, 0))[:2]:
                    best[key] = (sim, -s, size)
        out += [(str(d.doc_id), str(i), round(b[0], 9), -b[1], b[2]) for i, b in best.items()]
    return sorted(out)


def got(rows):
    return sorted((str(r.doc_id), str(r.item_id), round(r.similarity, 9), r.start_word, r.n_words) for r in rows)


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    want = slow(docs, items)
    assert len(want) > 10 and got(D.op2_simhash_decontamination(spark, SF).collect()) == want


def test_altered_passages_and_short_items(spark, odd_docs, no_docs):
    rng = random.Random(5)
    items = [(k, " ".join(f"x{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 20, 40, 60])))) for k in range(60)] + [(100, "a b a b a b a b a b"), (101, None), (102, ""), (None, "y1 y2 y3 y4 y5 y6 y7"), (5, "second text of item five here"), (100, "a b a b a b a b a b")]
    docs = []
    for k in range(300):
        w = [f"z{rng.randrange(5000)}" for _ in range(rng.randrange(0, 80))]
        i = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(0, 4)):
            if i:
                j = rng.randrange(len(i))
                i = [*i[:j], *([["q"], [], [i[j], "q"]][rng.randrange(3)]), *i[j + 1 :]]
        j = rng.randrange(len(w) + 1)
        docs.append((k, " ".join(w[:j] + i + w[j:]).replace(" x", rng.choice([" x", ", X", "\n x"]))))
    docs += [(900, "a b a b a b a b a b"), (901, "a b a b a b a b"), (901, "a b a b a b a b"), (None, "Y1-y2 y3 y4 y5 y6 y7!"), (902, None)]
    df, of = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = slow(df.collect(), of.collect())
    assert len(want) > 50 and got(D.contaminated(df, of).collect()) == want
    assert D.contaminated(odd_docs, of).collect() is not None
    assert D.contaminated(no_docs, of).collect() == [] and D.contaminated(df, of.limit(0)).collect() == []
    D.BROADCAST_ROWS, before = 1, D.BROADCAST_ROWS
    assert got(D.contaminated(df, of).collect()) == want
    D.BROADCAST_ROWS = before


def test_fingerprints_of_windows_of_millions_of_shingles(spark):
    """More of them than 21 bits can count, all bits set; and as many with none."""
    rows = spark.range(2_200_000).selectExpr("id % 2 AS k", "CASE WHEN id % 2 = 0 THEN -1L ELSE 0L END AS h").unionAll(spark.range(2_200_000).selectExpr("0L AS k", "-1L AS h"))
    assert sorted((r.k, r.fp) for r in D.simhash(rows, ["k"]).collect()) == [(0, -1), (1, 0)]


def test_windows_of_a_template_follow_the_texts_and_not_the_items(spark, monkeypatch):
    """Items and texts that all hold one template, none of them contaminated."""
    template = " ".join(f"t{i}" for i in range(14))
    asked, near = [], D.windows_near
    monkeypatch.setattr(D, "windows_near", lambda *a: asked.append(near(*a)) or asked[-1])
    for n in (10, 20, 40):
        items = [(k, f"{template} " + " ".join(f"i{k}x{j}" for j in range(16))) for k in range(n)]
        docs = [(k, " ".join(f"d{k}a{j}" for j in range(20)) + f" {template} " + " ".join(f"d{k}b{j}" for j in range(20))) for k in range(n)]
        assert D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    counts = [df.count() for df in asked]
    assert counts[1] == 2 * counts[0] and counts[2] == 4 * counts[0]


def test_a_passage_in_most_texts(spark, monkeypatch):
    """Its fingerprint is that of most windows: each of them still gets its item."""
    monkeypatch.setattr("tidewheel.llm.common.HOT_LEAST", 2)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(k, f"a{k} b{k} {passage} c{k}" if k % 5 else f"e{k}") for k in range(200)]
    df, of = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage), (2, passage + " q"), (3, "r " * 30)], "item_id long, text string")
    want = slow(df.collect(), of.collect())
    assert len(want) == 320 and got(D.contaminated(df, of).collect()) == want
