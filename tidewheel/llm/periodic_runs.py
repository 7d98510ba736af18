"""Periodic runs of words: stretches that repeat with one period four times or more, found and collapsed.

A document's k-grams that occur twice or more cover every word of every such run, as a run overlaps its own shift by one
period; k is the least such overlap. Words outside are masked. In the segments that are left, runs are found by Main and
Lorentz: halve a segment, find the runs that cross its middle from Z values of both halves, go on in the halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def least_overlap(least: int, times: int) -> int:
    """Of all allowed runs, the least overlap with their own shift by one period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated(ids: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs at least twice. Grams are named exactly, by doubling their width."""
    if len(ids) <= k:
        return np.zeros(len(ids), bool)
    names, width = ids, 1
    while width < k:
        wider = min(2 * width, k)
        shift = wider - width
        _, names = np.unique(names[:-shift] * np.int64(len(ids)) + names[shift:], return_inverse=True)
        width = wider
    again = np.bincount(names)[names] > 1
    steps = np.zeros(len(ids) + 1, np.int64)
    steps[: len(again)] += again
    steps[k : k + len(again)] -= again
    return np.cumsum(steps[:-1]) > 0


def z_values(w: list[int], most: int) -> list[int]:
    """For each shift up to most, how far w agrees with itself from there on."""
    z, lo, hi, n = [0] * (most + 1), 0, 0, len(w)
    for q in range(1, most + 1):
        k = min(hi - q, z[q - lo]) if q < hi else 0
        if q + k >= hi:
            while q + k < n and w[k] == w[q + k]:
                k += 1
            lo, hi = q, q + k
        z[q] = k
    return z


def squares(w: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(q, agreement) for each primitive word of length q that stands twice at the beginning of w."""
    z = z_values(w, min(most, len(w) - 1))
    kept: list[int] = []
    for q in range(1, len(z)):
        if z[q] >= q and not any(q % p == 0 and z[p] + p >= 2 * q for p in kept):
            kept.append(q)
            yield q, z[q]


def main_lorentz(w: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of w, in that order. A run that crosses the middle of a block has two
    periods or more on one side of it, as times is at least four; so a square stands there, and only squares are extended."""
    found, blocks, n = set(), [(0, len(w))], len(w)
    while blocks:
        lo, hi = blocks.pop()
        if hi - lo < least:
            continue
        mid, most = (lo + hi) // 2, (hi - lo) // times
        blocks += [(lo, mid), (mid, hi)]
        crossing = []
        for q, more in squares(w[mid:hi], most):
            start = mid
            while start > lo and w[start - 1] == w[start - 1 + q]:
                start -= 1
            crossing.append((start, mid + q + more, q))
        for q, more in squares(w[lo:mid][::-1], most):
            end = mid
            while end < hi and w[end] == w[end - q]:
                end += 1
            crossing.append((mid - q - more, end, q))
        for start, end, q in crossing:
            maximal = (start == 0 or w[start - 1] != w[start - 1 + q]) and (end == n or w[end] != w[end - q])
            if start < mid < end and maximal and end - start >= max(least, times * q):
                found.add((start, end - start, q))
    return sorted(found)


def runs_of(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs of a document, in order of start, then period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return []
    steps = np.flatnonzero(np.diff(np.concatenate([[0], repeated(ids, least_overlap(least, times)).astype(np.int8), [0]])))
    runs = []
    for lo, hi in zip(steps[::2].tolist(), steps[1::2].tolist()):
        runs += [(lo + start, length, q) for start, length, q in main_lorentz(ids[lo:hi].tolist(), least, times)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        steps[start + q] += 1
        steps[start + length] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if runs else b" ".join(words)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed (the text without the words
    that repeat a run's first period, joined by one space), one row for each row of docs. No shuffle.

    Words are separated by ASCII white space and numbered from 0. times must be at least 4. A null or empty text has no
    words; a null doc_id stays null; repeated rows are each treated alike. A stretch with several periods counts by its
    smallest; runs that overlap all count. A very long text is read whole, in time n log n. An empty table gives no rows;
    other columns are ignored.
    """
    if times < 4:
        raise ValueError("times must be at least 4")
    rows = columns(docs, doc_id=doc_id, text=F.coalesce(F.col(text), F.lit("")).cast("binary"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for value in batch.column(1):
                words = value.as_py().split()  # bytes: at ASCII white space
                of = runs_of(words, least, times)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in of])
                texts.append(collapse(words, of).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(found, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: documents whose crc32(doc_id) ends with the digit 0 repeat a part of theirs from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    part = lambda of, start, length: F.slice(of, start.cast("int"), length.cast("int"))
    left = F.col("n") - F.col("a")
    block = F.array_repeat(part("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))
    words = F.concat(part("w", F.lit(1), F.col("a")), part(F.flatten(block), F.lit(1), left))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs; see periodic_runs for nulls, ties, repeated rows and empty tables."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    steeper = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(b.isNull() | steeper(r, b), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: A run of period q is an island of places whose words stand again q words on. crc32 is no function of DuckDB, so it is spelled out
#: bit by bit over the digits of doc_id.
SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS w,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS c FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, coalesce(xor(c, 4294967295), 1) AS h FROM d),
g AS (SELECT *, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
u AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM t),
k AS (SELECT *, CASE WHEN i <= n - 5 THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) END AS gram FROM u),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, max(i) + 5 + q - min(i) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) z GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
f AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY doc_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS rn FROM r) z WHERE rn = 1),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
o AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i WHERE c.i IS NULL GROUP BY u.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN f ON f.doc_id = t.doc_id LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN o ON o.doc_id = t.doc_id
"""
