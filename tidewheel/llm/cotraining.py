"""A quality classifier by co-training of two views of a document.

The text view sees which words, beginnings of words and runs of symbols a text has; the metadata view sees its language,
source, size and layout, and how much its words repeat, but no words. Both are Bernoulli naive Bayes models, so that a round of training is one pass over the documents'
features that adds up counts. After each round both views are calibrated on labelled documents that they were not trained
on; documents without a label for which one view is confident then become training documents of the other view. At the
end the calibrated views are combined, by a logistic model on the same held-back documents, and score every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table, written

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?!")
#: Lengths in bytes of the word beginnings that count as words too: inflected and joined words share them.
BEGINNINGS = (4, 5, 6, 7)
#: Slots of the metadata view.
SLOTS = 1024


class Settings(NamedTuple):
    #: Labelled documents to fit on, taken by hash of doc_id; every document is scored, and may be pseudo-labelled.
    labelled: int = 20_000
    #: Words of the text view: the most telling ones, each in at least `least` labelled documents, by the G statistic.
    words: int = 2_000
    least: int = 4
    telling: float = 20.0
    rounds: int = 3
    #: Of the labelled documents, those kept for calibration.
    held_back: float = 0.3
    #: Calibrated probabilities from which on a view is confident.
    sure_bad: float = 0.97
    sure_good: float = 0.01
    #: How much a pseudo-labelled document counts.
    weight: float = 0.5
    smooth: float = 0.5
    #: A document goes from this probability of being bad on: clean documents are dearer than bad ones.
    threshold: float = 0.65


def tokens(found: list[bytes]) -> set[bytes]:
    words = set(found)
    return words.union(*({w[:n] for w in words} for n in BEGINNINGS))


def metadata(text: bytes, found: list[bytes], lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Slots of the metadata view: each property by range. found: the text's tokens."""
    size, lines = len(text) or 1, text.count(b"\n") + 1
    words = text.count(b" ") + lines
    share = lambda chars: int(np.log2((size - len(text.translate(None, chars))) / size * 1024 + 1) * 2)
    found = {
        "lang": lang, "source": source, "chars": n_chars and int(np.log2(max(n_chars, 1)) * 2), "upper": share(UPPER), "digits": share(DIGITS), "symbols": share(SYMBOLS),
        "line": int(np.log2(size / lines) * 2), "lines": int(np.log2(lines) * 2), "word": int(size / words * 2), "stops": share(b"."), "marks": share(b"!?"), "bars": share(b"|"),
        "again": int(np.log2(sum(map(eq, found, found[1:])) / (len(found) or 1) * 256 + 1)), "variety": (int(len(set(found)) / (len(found) or 1) * 20), int(np.log2(len(found) + 1))),
    }
    return sorted({zlib.crc32(f"{k}={v}".encode()) % SLOTS for k, v in found.items()})


class View:
    """A Bernoulli naive Bayes model: the log odds of bad, from counts of each feature among bad and good documents."""

    def __init__(self, bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float, smooth: float):
        there = np.log((bad + smooth) / (n_bad + 2 * smooth)) - np.log((good + smooth) / (n_good + 2 * smooth))
        away = np.log((n_bad - bad + smooth) / (n_bad + 2 * smooth)) - np.log((n_good - good + smooth) / (n_good + 2 * smooth))
        self.weights, self.base = there - away, float(away.sum() + np.log((n_bad + smooth) / (n_good + smooth)))
        self.slope, self.shift = 1.0, 0.0

    def log_odds(self, lists: pa.ListArray) -> np.ndarray:
        """Calibrated."""
        ends = np.asarray(lists.offsets)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[np.asarray(lists.values)])])
        return self.slope * (self.base + sums[ends[1:]] - sums[ends[:-1]]) + self.shift


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model with a constant, last; Newton's method, targets smoothed as by Platt."""
    x = np.column_stack([x, np.ones(len(x))])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - target) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def chance(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars", key: str | None = None) -> DataFrame:
    """doc_id, p_text, p_meta, p_bad and keep, for every row of docs.

    labels(doc_id, quality, toxic): a document is bad if its quality is 0 or its toxic is 1; of several rows for one
    document the worst counts, and a row with both null counts for none. A null text is empty, other nulls are a value of
    their own; a row with a null doc_id has no label. Repeated rows are scored alike. Without labels of both kinds there
    is nothing to learn: all rows are kept and p_* are null. Equal scores are decided alike: below the threshold a row is
    kept. A very long text is read whole. An empty table gives no rows. Other columns are ignored.
    key: a column of docs to carry along in place of doc_id.
    """
    s, spark = settings, docs.sparkSession
    rows = columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.coalesce(F.col(text), F.lit("")).cast("binary"), lang=F.col(lang).cast("string"), source=F.col(source).cast("string"), n_chars=F.col(n_chars).cast("long"), key=F.col(key or doc_id))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad")).where("bad IS NOT NULL")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.labelled)
    train = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(1000)) >= int(1000 * s.held_back)
    sample = written(sample.withColumn("train", train), "sample")
    kinds = {r.bad: r.n for r in sample.where("train").groupBy("bad").agg(F.count("*").alias("n")).collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for value, bad in zip(batch.column(0), batch.column(1).to_pylist()):
                found[bad].update(tokens(TOKEN.findall(value.as_py().lower())))
        words = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in found]], ["word", "good", "bad"])

    words: list[bytes] = []
    if len(kinds) == 2:
        few = rows.join(F.broadcast(sample.where("train").select("doc_id", "bad")), "doc_id").select("text", "bad").mapInArrow(counted, "word binary, good long, bad long")
        few = few.groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where(F.col("good") + F.col("bad") >= s.least)
        n_good, n_bad = float(kinds[0]), float(kinds[1])
        cell = lambda seen, n: F.when(seen > 0, seen * F.log(seen / n)).otherwise(0.0)
        both = F.col("good") + F.col("bad")
        rate = both / (n_good + n_bad)
        g = cell(F.col("good"), n_good * rate) + cell(F.col("bad"), n_bad * rate) + cell(n_good - F.col("good"), n_good * (1 - rate)) + cell(n_bad - F.col("bad"), n_bad * (1 - rate))
        words = [bytes(r.word) for r in few.withColumn("g", 2 * g).where(F.col("g") >= s.telling).orderBy(F.desc("g"), "word").limit(s.words).collect()]
    place = {w: k for k, w in enumerate(words)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = place.keys()
        for batch in batches:
            seen, meta = [], []
            for value, *about in zip(batch.column(2), *(batch.column(k).to_pylist() for k in (3, 4, 5))):
                data = value.as_py()
                found = TOKEN.findall(data.lower())
                seen.append(sorted(place[w] for w in tokens(found) & vocabulary))
                meta.append(metadata(data, found, *about))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (seen, meta)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["key", "doc_id", "seen", "meta"])

    kind = rows.schema["key"].dataType.simpleString()
    features = rows.select("key", "doc_id", "text", "lang", "source", "n_chars").mapInArrow(featured, f"key {kind}, doc_id long, seen array<int>, meta array<int>")
    features = written(features.join(F.broadcast(sample), "doc_id", "left"), "features")
    if len(kinds) < 2:
        none = F.lit(None).cast("double")
        return features.select(F.col("key").alias(key or "doc_id"), none.alias("p_text"), none.alias("p_meta"), none.alias("p_bad"), F.lit(True).alias("keep"))
    # One row for each held-back id, the least: the sample bounds ids, and an id may have any number of rows.
    fold = features.where("train = false").groupBy("doc_id").agg(F.min(F.struct("seen", "meta", "bad")).alias("of")).select("of.*").toArrow().combine_chunks()
    list_of = lambda name: fold.column(name).combine_chunks() if fold.num_rows else pa.array([], pa.list_(pa.int32()))
    y = fold.column("bad").to_numpy().astype(float)

    def fitted(views: tuple[View, View] | None) -> tuple[View, View]:
        """New views, from the labels and from what the given views are sure of."""

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((2, len(words) + 1)), np.zeros((2, SLOTS + 1))]
            for batch in batches:
                lists, label, train = (batch.column(0), batch.column(1)), batch.column(2), batch.column(3)
                y, train = np.asarray(label.fill_null(-1)), np.asarray(train.fill_null(False))
                for k in (0, 1):
                    amount = np.where(train, 1.0, 0.0)
                    target = y.copy()
                    if views:  # the other view teaches this one
                        p = chance(views[1 - k].log_odds(lists[1 - k]))
                        free = (y < 0) & ((p >= s.sure_bad) | (p <= s.sure_good))
                        target[free] = p[free] >= 0.5
                        amount[free] = s.weight
                    ends = np.diff(np.asarray(lists[k].offsets))
                    for c in (0, 1):
                        mine = amount * (target == c)
                        sums[k][c][:-1] += np.bincount(np.asarray(lists[k].values), np.repeat(mine, ends), sums[k].shape[1] - 1)
                        sums[k][c][-1] += mine.sum()
            out = [(k, c, i, float(x)) for k in (0, 1) for c in (0, 1) for i, x in enumerate(sums[k][c]) if x]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, [pa.int32(), pa.int32(), pa.int32(), pa.float64()])], ["view", "bad", "place", "n"])

        summed = features.select("seen", "meta", "bad", "train").mapInArrow(counts, "view int, bad int, place int, n double").groupBy("view", "bad", "place").agg(F.sum("n").alias("n"))
        full = [np.zeros((2, len(words) + 1)), np.zeros((2, SLOTS + 1))]
        for r in summed.collect():  # as many as the views have features
            full[r.view][r.bad][r.place] = r.n
        out = tuple(View(x[1][:-1], x[0][:-1], x[1][-1], x[0][-1], s.smooth) for x in full)
        for view, name in zip(out, ("seen", "meta")):
            if 0 < y.sum() < len(y):
                view.slope, view.shift = logistic(view.log_odds(list_of(name))[:, None] / 10, y) / np.array([10, 1])
        return out

    views = fitted(None)
    for _ in range(s.rounds):
        views = fitted(views)
    both = lambda odds: np.column_stack([*odds, np.maximum(*odds)])  # noqa: E731  either view alone may know
    odds = both([v.log_odds(list_of(n)) for v, n in zip(views, ("seen", "meta"))])
    mix = logistic(odds, y) if 0 < y.sum() < len(y) else np.array([0.5, 0.5, 0.0, 0.0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [v.log_odds(batch.column(1 + k)) for k, v in enumerate(views)]
            p = chance(both(odds) @ mix[:-1] + mix[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in (chance(odds[0]), chance(odds[1]), p, p < s.threshold)]], [name, "p_text", "p_meta", "p_bad", "keep"])

    name = key or "doc_id"
    return features.select(F.col("key").alias(name), "seen", "meta").mapInArrow(scored, f"{name} {kind}, p_text double, p_meta double, p_bad double, keep boolean")


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; see classify for nulls, ties, repeated rows and empty tables."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
