import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidewheel.llm import context_tree as C

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_ctw(train, texts, depth):
    """Straight from the definition, with dictionaries."""
    nodes = defaultdict(lambda: [0, 0])
    bits = lambda data: ((tuple(data[i - d : i] for d in range(depth + 1)), (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1) for i in range(depth, len(data)) for j in range(8))
    pad = lambda t: b"\xff" * depth + t + b"\xff"
    children = defaultdict(set)
    for t in train:
        for contexts, start, bit in bits(pad(t)):
            for d, c in enumerate(contexts):
                nodes[c, start][bit] += 1
                if d:
                    children[contexts[d - 1], start].add((c, start))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}
    for c, start in sorted(nodes, key=lambda k: -len(k[0])):
        own = kt(*nodes[c, start])
        weighted[c, start] = own if len(c) == depth else np.logaddexp(own, sum(weighted[x] for x in children[c, start])) - math.log(2)
    out = []
    for t in texts:
        total = 0.0
        for contexts, start, bit in bits(pad(t)):
            p, left = 0.0, 1.0
            path = [c for c in contexts if (c, start) in nodes]
            if not path:
                p = 0.5
            for c in path:
                a, b = nodes[c, start]
                one = ((b if bit else a) + 0.5) / (a + b + 1)
                share = 1.0 if c is path[-1] else math.exp(kt(a, b) - math.log(2) - weighted[c, start])
                p, left = p + left * share * one, left * (1 - share)
            total += math.log10(p)
        out.append(total)
    return out


def check(docs, rows, depth=C.DEPTH):
    held = [d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 5 == 1 for d in docs]
    texts = [low(d.text) for d in docs]
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", t), None] for t in texts]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    train = [t.encode() for t, h in zip(texts, held) if not h]
    some = range(len(docs)) if len(docs) < 60 else range(0, len(docs), 9)
    scores = slow_ctw(train, [texts[i].encode() for i in some], depth)
    found = sorted(rows, key=lambda r: (str(r.doc_id), r.score))
    want = [(docs[i].doc_id, held[i], len(tokens[i]), sum(w in counts for w in tokens[i]), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]), s) for i, s in zip(some, scores)]
    want.sort(key=lambda w: (str(w[0]), w[6]))
    assert len(found) == len(docs)
    ids = {w[0] for w in want}
    found = [r for r in found if r.doc_id in ids]
    for r, w in zip(found, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, w[6], rel_tol=1e-6, abs_tol=1e-6)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs.collect(), C.score(odd_docs).collect())
    assert C.score(no_docs).collect() == []


def test_against_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1200")
    check(docs.collect(), C.score(docs, depth=3).collect(), 3)


def test_beats_the_base_on_held_out_text(spark):
    rows = [r for r in C.op7_context_tree_scores(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_counts_past_32_bits_are_kept():
    few, many = np.array([0, 5, 2**31 - 1]), np.array([1, 3_000_000_000])
    assert C.unpacked(C.packed(few), 3).tolist() == few.tolist() and len(C.packed(few)) == 12
    assert C.unpacked(C.packed(many), 2).tolist() == many.tolist()
    keys, counts = C.merged([np.array([1, 2], np.uint64)] * 2, [C.unpacked(C.packed(many), 2)] * 2)
    assert counts.tolist() == [2, 6_000_000_000] and len(C.unpacked(C.packed(np.zeros(0, np.int64)), 0)) == 0


def test_many_groups_and_buckets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1200")
    one = {r.doc_id: r.score for r in C.score(docs, depth=4).collect()}
    for name, value in (("GROUP_BYTES", 5000), ("LEAST_BUCKETS", 7)):
        monkeypatch.setattr(C, name, value)
    many = {r.doc_id: r.score for r in C.score(docs, depth=4).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-6) for k in one)


def test_rows_of_counts_grow_with_the_groups(spark, monkeypatch):
    """With more buckets than strings, a group has a row a filled bucket, so groups of equal size add equal numbers of rows."""
    monkeypatch.setattr(C, "LEAST_BUCKETS", 500)
    monkeypatch.setattr(C, "GROUP_BYTES", 200)
    seen, kept = [], C.written
    monkeypatch.setattr(C, "written", lambda df, label, *rows: seen.append((label, kept(df, label, *rows))) or seen[-1][1])
    found = {}
    for n in (20, 40, 80):
        docs = spark.createDataFrame([(i, f"w{i} " * 12) for i in range(n)], "doc_id long, text string")
        seen.clear()
        assert C.score(docs).count() == n
        counts = next(df for label, df in seen if label == "counts")
        assert counts.where("octet_length(keys) = 0").count() == 0
        found[n] = counts.count()
    assert found[40] < 2.6 * found[20] and found[80] < 2.6 * found[40]
