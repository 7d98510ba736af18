"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference. Every document is cut into slices at content-defined places (the least hashes of short
word shingles, so that two copies of a passage are cut alike), and every slice, together with the WINDOW - 1 words that
its last window needs, is indexed by hash; of equal slices the least in the corpus is the reference. Each document is then
parsed from left to right: at a slice that the index holds elsewhere too a factor (source, place in it, length) begins at
its reference, and is extended slice by slice as long as the source goes on in the same way. A factor, of WINDOW words at
least, is a duplicate span; so is one whose source is the document's own place, if the index holds it elsewhere.

Copies also begin and end within slices. There, at the boundaries of factors, single windows are counted by hash: those
that start in slices outside factors, and of one copy of each indexed slice. A window always holds the least shingle hash of
its own words, which is a cut in each document that has this window; so windows whose least hash is a cut only once in the
corpus are unique, and are never looked at again.

Slices, windows and documents are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, lookup, table, written
from .iblt_fingerprints import mixed

WINDOW, SHINGLE = 35, 8
#: Odd numbers, for rolling hashes from running sums.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SPAN = "array<struct<start:long,end:long>>"
FACTOR = "array<struct<start:long,length:long,source:long,source_start:long>>"

_powers: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    if len(_powers.get(of, ())) < n:
        p = np.full(2 * n, of, np.uint64)
        p[0] = 1
        _powers[of] = np.multiply.accumulate(p)
    return _powers[of][:n]


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    size, out = 1, x
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(x) - width + 1], out[width - size : width - size + len(x) - width + 1])


class Sliced:
    """A document of at least `window` words: rolling hashes, cuts and slices. Slice k starts windows lo[k] .. hi[k]."""

    def __init__(self, words: list[bytes], window: int):
        h = xxhash.xxh64_intdigest
        n, shingle = len(words), min(SHINGLE, window)
        own = np.array([h(w) for w in words], np.uint64)
        self.own, self.sums = own, {}
        self.window, self.n, self.starts = window, n, n - window + 1
        short, span = self.rolled(np.arange(n - shingle + 1), shingle), window - shingle + 1
        self.least = sliding(short, span, np.minimum)
        edge = np.zeros(span - 1, np.uint64)
        cut = np.flatnonzero(short == sliding(np.concatenate([edge, self.least, edge]), span, np.maximum))
        lo = np.concatenate([[0], cut[:-1] + 1])
        self.lo, self.hi, self.anchors = lo, np.minimum(cut, self.starts - 1), short[cut]
        self.real = lo < self.starts  # cuts in the last words of a document end no slice
        self.slice = np.repeat(np.arange(len(lo)), np.maximum(self.hi - lo + 1, 0))

    def rolled(self, at: np.ndarray, size: np.ndarray | int, which: int = 0) -> np.ndarray:
        """One of two hashes of the `size` words from each place."""
        base = BASES[which]
        if which not in self.sums:
            own = mixed(self.own, 11) if which else self.own
            self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers(pow(base, -1, 2**64), self.n), dtype=np.uint64)])
        sums = self.sums[which]
        return mixed((sums[at + size] - sums[at]) * powers(base, self.n)[at] + np.uint64(base) * np.asarray(size, np.uint64), 3)

    def tiles(self, which: int) -> np.ndarray:
        return self.rolled(np.where(self.real, self.lo, 0), np.where(self.real, self.hi - self.lo + self.window, 0), which)


def batches_of(run, schema: str):
    """A mapInArrow function from one that yields rows' columns for each batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in run(batch)], names)

    return mapped


def factors(numbers: np.ndarray, source: list, at: np.ndarray, start: np.ndarray) -> list[tuple[int, int, object, int]]:
    """The greedy parse: (first slice, last slice, source, its start) from the slices that have a reference, in order;
    source, at and start: the document of each one's reference, the slice there and its first word."""
    out: list[list] = []
    for i, k in enumerate(numbers.tolist()):
        if out and out[-1][1] == k - 1 and source[i] == source[i - 1] and at[i] == at[i - 1] + 1:
            out[-1][1] = k
        else:
            out.append([k, k, source[i], int(start[i])])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, kept_text (the kept words, joined by one space), removed, an array of spans of words, and
    factors, an array of (start, length, source, source_start), in words; source is the doc_id of the reference.

    A word goes if it is in a window of `window` words of its document that also starts anywhere else, be it in the same
    document or in a copy of it; all windows are judged on the input. One row for each row of docs; repeated rows are
    copies of each other. A null text has no words. A null doc_id is kept. Texts of fewer words than the window are kept
    whole. Of equal slices the one with the least doc_id is the reference (null ids first, then by hash and place). A very
    long text is parsed whole, by one task. An empty table gives no rows; other columns are ignored.
    """
    rows = columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.coalesce(F.col(text), F.lit("")).cast("binary"))
    # p and q stand for a row: rows alike in them are alike.
    rows = rows.withColumns({"p": F.xxhash64("doc_id", "text"), "q": F.xxhash64(F.lit("q"), "text", "doc_id")})
    place = ["p", "q"]

    def sliced(batch: pa.RecordBatch) -> list:
        out: list = [[] for _ in range(8)]
        for i, value in enumerate(batch.column(3)):
            words = value.as_py().split()
            if len(words) >= window:
                d = Sliced(words, window)
                for x, y in zip(out, (np.full(len(d.lo), i), np.arange(len(d.lo)), d.lo, d.tiles(0), d.tiles(1), d.anchors, ~d.real, np.full(len(d.lo), d.real.sum()))):
                    x.append(y)
        row, number, start, tile, tile2, anchor, none, real = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out)
        row, none = pa.array(row.astype(np.int32)), none.astype(bool)
        return [*(batch.column(k).take(row) for k in range(3)), number.astype(np.int32), start.astype(np.int32), pa.array(tile.view(np.int64), mask=none), tile2.view(np.int64), anchor.view(np.int64), real.astype(np.int32)]

    schema = "p long, q long, doc_id long, slice int, start int, tile long, tile2 long, anchor long, real int"
    index = written(rows.select("p", "q", "doc_id", "text").mapInArrow(batches_of(sliced, schema), schema), "slices")
    total = index.count()
    again = written(index.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "cuts")
    index = written(lookup(index, again, "anchor", "n", total, "left_semi").drop("anchor"), "candidates")
    # A hash of a slice's both hashes would be no better than one of them: they are compared after the look-up.
    one = F.struct("doc_id", "p", "q", "slice", "start")
    copied = index.where("tile IS NOT NULL").groupBy("tile", "tile2").agg(F.count("*").alias("n"), F.min(one).alias("one")).where("n > 1")
    copied = copied.select("tile", "n", "tile2", "one").groupBy("tile").agg(F.sum("n").alias("n"), F.collect_list(F.struct("tile2", "one")).alias("same"))
    copied = written(copied, "references")
    own = F.get(F.filter("same", lambda s: s["tile2"] == F.col("tile2")), 0)["one"]
    found = lookup(index, copied, "tile", "n", total).withColumn("one", own)
    state = F.when(F.col("one").isNull(), 0).when(F.col("one") == F.struct("doc_id", "p", "q", "slice", "start"), 3).otherwise(2)
    flag = F.struct("slice", state.cast("int").alias("state"), F.col("one.doc_id").alias("source"), F.xxhash64("one.p", "one.q").alias("of"), F.col("one.slice").alias("at"), F.col("one.start").alias("start"))
    flags = found.groupBy(*place).agg(F.sort_array(F.collect_set(flag)).alias("flags"), F.max("real").alias("real"))
    # A document needs no single windows only if all its windows start in copies: a window that starts in a slice with a
    # cut of its own may have its least hash in a later slice.
    flags = flags.withColumn("open", F.size(F.filter("flags", lambda f: f["state"] == 2)) < F.col("real")).drop("real")
    flags = written(flags, "flags")

    def numbers(marks: pa.ListScalar, field: str) -> np.ndarray:
        return marks.values.field(field).fill_null(0).to_numpy()

    def windows(batch: pa.RecordBatch) -> list:
        """Windows at the boundaries of factors, and those of one copy of each indexed slice (sure)."""
        out: list = [[] for _ in range(5)]
        for i, (value, marks) in enumerate(zip(batch.column(2), batch.column(3))):
            d = Sliced(value.as_py().split(), window)
            state = np.full(len(d.lo), -1)
            state[numbers(marks, "slice")] = numbers(marks, "state")
            known = np.unique(d.anchors[state >= 0])
            at = np.flatnonzero((state[d.slice] != 2) & (known[np.minimum(np.searchsorted(known, d.least), len(known) - 1)] == d.least))
            for x, y in zip(out, (np.full(len(at), i), at, d.rolled(at, window), d.rolled(at, window, 1), state[d.slice[at]] == 3)):
                x.append(y)
        row, at, h, h2, sure = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out)
        row = pa.array(row.astype(np.int32))
        return [batch.column(0).take(row), batch.column(1).take(row), at.astype(np.int32), h.view(np.int64), h2.view(np.int64), sure.astype(bool)]

    schema = "p long, q long, start int, hash long, hash2 long, sure boolean"
    edges = rows.select(*place, "text").join(flags.where("open").select(*place, "flags"), place)
    edges = written(edges.mapInArrow(batches_of(windows, schema), schema), "boundaries")
    twice = edges.groupBy("hash", "hash2").agg(F.count("*").alias("n")).where("n > 1").groupBy("hash").agg(F.sum("n").alias("n"), F.collect_list("hash2").alias("same"))
    single = lookup(edges.where("NOT sure").select(*place, "start", "hash", "hash2"), written(twice, "repeated"), "hash", "n", total).where(F.array_contains("same", F.col("hash2")))
    single = single.groupBy(*place).agg(F.collect_list("start").alias("starts"))
    marked = written(flags.drop("open").join(single, place, "full"), "marks")

    def cleaned(batch: pa.RecordBatch) -> list:
        ids, counts, kept, spans, parsed = [], [], [], [], []
        for key, value, marks, starts in zip(*(batch.column(k) for k in range(4))):
            words = value.as_py().split()
            n, gone, parse = len(words), [], []
            if marks.is_valid or starts.is_valid:
                d, hit = Sliced(words, window), np.zeros(len(words) - window + 1, bool)
                if marks.is_valid:
                    mine = numbers(marks, "state") >= 2
                    source = list(zip(marks.values.field("source").filter(pa.array(mine)).to_pylist(), numbers(marks, "of")[mine].tolist()))
                    for a, b, (name, _), start in factors(numbers(marks, "slice")[mine], source, numbers(marks, "at")[mine], numbers(marks, "start")[mine]):
                        hit[d.lo[a] : d.hi[b] + 1] = True
                        parse.append({"start": int(d.lo[a]), "length": int(d.hi[b] - d.lo[a]) + window, "source": name, "source_start": start})
                if starts.is_valid:
                    hit[np.asarray(starts.values)] = True
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, np.flatnonzero(hit), 1)
                np.add.at(step, np.flatnonzero(hit) + window, -1)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(step)[:n] > 0, [0]]).astype(np.int8)))
                gone = edge.reshape(-1, 2).tolist()
                at = 0
                left: list[bytes] = []
                for a, b in gone:
                    left += words[at:a]
                    at = b
                words = left + words[at:]
            ids.append(key.as_py())
            counts.append(n)
            kept.append(b" ".join(words).decode())
            spans.append([{"start": a, "end": b} for a, b in gone])
            parsed.append(parse)
        of = lambda *names: pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        return [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, of("start", "end")), pa.array(parsed, of("start", "length", "source", "source_start"))]

    schema = f"doc_id long, n_words long, kept_text string, removed {SPAN}, factors {FACTOR}"
    names = ["doc_id", "n_words", "kept_text", "removed", "factors"]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(cleaned(batch), names)

    return rows.join(marked, place, "left").select("doc_id", "text", "flags", "starts").mapInArrow(last, schema)


def op8_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeat elsewhere; see dedup for nulls, ties, repeated rows and empty tables."""
    found = dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j, len(w) AS n FROM d),
s AS (SELECT doc_id, j, word, CASE WHEN j <= n - {WINDOW - 1} THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) END AS h FROM t),
r AS (SELECT h FROM s WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, j, word, coalesce(max(CASE WHEN r.h IS NOT NULL THEN j END) OVER (PARTITION BY doc_id ORDER BY j) >= j - {WINDOW - 1}, false) AS gone FROM s LEFT JOIN r ON s.h = r.h)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id, len(w)
"""
