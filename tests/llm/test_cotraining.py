import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import cotraining as Q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    fit = labels.where("doc_id % 3 > 0")
    rest = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in labels.where("doc_id % 3 = 0").collect()}
    rows = {r.doc_id: r for r in Q.classify(docs, fit).collect()}
    assert len(rows) == docs.count()
    wrong_kept = sum(bad and rows[k].keep for k, bad in rest.items())
    wrong_gone = sum(not bad and not rows[k].keep for k, bad in rest.items())
    print("held-out", len(rest), "bad", sum(rest.values()), "kept bad", wrong_kept, "rejected good", wrong_gone)
    assert wrong_kept <= 0.08 * sum(rest.values()) and wrong_gone <= 0.01 * len(rest)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (3, None, 1), (4, None, None), (None, 0, 1), (6, 1, 0), (7, 0, 0), (8, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = Q.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r.p_bad is not None and r.keep == (r.p_bad < Q.Settings().threshold) for r in rows)
    assert Q.classify(no_docs, labels).collect() == []
    rows = Q.classify(odd_docs, labels.limit(0)).collect()
    assert len(rows) == odd_docs.count() and all(r.keep and r.p_bad is None for r in rows)


def test_repeated_held_back_ids_count_once(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(1000)) < int(1000 * Q.Settings().held_back)
    one = docs.join(labels.where(held).where("quality = 0").select("doc_id").limit(1), "doc_id").select(*docs.columns)
    many = docs.unionByName(one.crossJoin(spark.range(300)).select(*docs.columns))
    score = lambda df: {r.doc_id: r.p_bad for r in Q.classify(df, labels).collect()}
    want, got = score(docs), score(many)
    assert one.count() == 1 and want.keys() == got.keys() and max(abs(want[k] - got[k]) for k in want) < 1e-6


class PlainView:
    """Naive Bayes in dictionaries."""

    def __init__(self, docs, features, smooth):
        self.n = [sum(a for _, c, a in docs if c == k) for k in (0, 1)]
        self.seen = [Counter(), Counter()]
        for found, c, a in docs:
            for f in found:
                self.seen[c][f] += a
        self.features, self.smooth, self.slope, self.shift = features, smooth, 1.0, 0.0
        rate = lambda k, x: math.log((x + smooth) / (self.n[k] + 2 * smooth))
        self.on = {f: rate(1, self.seen[1][f]) - rate(0, self.seen[0][f]) for f in features}
        self.off = {f: rate(1, self.n[1] - self.seen[1][f]) - rate(0, self.n[0] - self.seen[0][f]) for f in features}
        self.base = sum(self.off.values()) + math.log((self.n[1] + smooth) / (self.n[0] + smooth))

    def odds(self, found):
        return self.slope * (self.base + sum(self.on[f] - self.off[f] for f in found)) + self.shift


def plain(docs, labels, train, s):
    """p_text, p_meta, p_bad by doc_id, and how many pseudo-labels each round gave to each view."""
    chance = lambda x: 1 / (1 + math.exp(-min(40, max(-40, x))))
    found = {d.doc_id: Q.TOKEN.findall((d.text or "").encode().lower()) for d in docs}
    n = [sum(b == k for i, b in labels.items() if train[i]) for k in (0, 1)]
    seen = [Counter(), Counter()]
    for i, t in found.items():
        if i in labels and train[i]:
            seen[labels[i]].update(Q.tokens(t))
    g = {}
    for w in seen[0] | seen[1]:
        both = seen[0][w] + seen[1][w]
        if both >= s.least:
            share = both / sum(n)
            cells = [(seen[k][w], n[k] * share) for k in (0, 1)] + [(n[k] - seen[k][w], n[k] * (1 - share)) for k in (0, 1)]
            g[w] = 2 * sum(x * math.log(x / e) for x, e in cells if x > 0)
    words = sorted((w for w in g if g[w] >= s.telling), key=lambda w: (-g[w], w))[: s.words]
    views = [{d.doc_id: Q.tokens(found[d.doc_id]) & set(words) for d in docs}, {d.doc_id: set(Q.metadata((d.text or "").encode(), found[d.doc_id], d.lang, d.source, d.n_chars)) for d in docs}]
    features = [words, range(Q.SLOTS)]
    held = [i for i in found if i in labels and not train[i]]
    y = np.array([labels[i] for i in held], float)

    def fitted(now):
        made, taught = [], []
        for k in (0, 1):
            rows = [(views[k][i], labels[i], 1.0) for i in found if i in labels and train[i]]
            taught.append(0)
            for i in found:
                if now and i not in labels:
                    p = chance(now[1 - k].odds(views[1 - k][i]))
                    if p >= s.sure_bad or p <= s.sure_good:
                        rows.append((views[k][i], int(p >= 0.5), s.weight))
                        taught[-1] += 1
            view = PlainView(rows, features[k], s.smooth)
            view.slope, view.shift = Q.logistic(np.array([[view.odds(views[k][i]) / 10] for i in held]), y) / np.array([10, 1])
            made.append(view)
        return made, taught

    now, rounds = fitted(None)[0], []
    for _ in range(s.rounds):
        now, taught = fitted(now)
        rounds.append(taught)
    odds = lambda i: (lambda a, b: (a, b, max(a, b)))(*(now[k].odds(views[k][i]) for k in (0, 1)))
    mix = Q.logistic(np.array([odds(i) for i in held]), y)
    return {i: (chance(odds(i)[0]), chance(odds(i)[1]), chance(float(np.dot(odds(i), mix[:-1]) + mix[-1]))) for i in found}, rounds


@pytest.mark.parametrize("rounds", [0, 3])
def test_against_a_plain_version(spark, rounds):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    s = Q.Settings(rounds=rounds, sure_bad=0.9, sure_good=0.05)
    train = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(1000)) >= int(1000 * s.held_back)
    known = {r.doc_id: (int(r.quality == 0 or r.toxic == 1), r.train) for r in labels.withColumn("train", train).collect()}
    want, taught = plain(docs.collect(), {i: b for i, (b, _) in known.items()}, {i: t for i, (_, t) in known.items()}, s)
    got = {r.doc_id: (r.p_text, r.p_meta, r.p_bad) for r in Q.classify(docs, labels, s).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)
    assert len(taught) == rounds and all(min(t) > 0 for t in taught)
