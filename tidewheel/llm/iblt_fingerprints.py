"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A document is cut into paragraphs; each is hashed, with its number among equal ones, to a 64-bit digest, and the digest is
put into one cell of each of three parts of the sketch. A cell holds a count, the sum of its digests and the sum of their
check sums. Two versions' sketches subtract cell by cell: what both have cancels, and peeling recovers the digests that
differ. When peeling gets stuck, because more differ than the cells can hold, both versions are sketched anew with twice
the cells (from a quarter of their paragraphs on), TRIES times at most. Likeness is common digests over all digests.

Sketches, subtraction and peeling run on flat arrays for many documents at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, partitions, table

#: Cells of each of the three parts in the fingerprint that is given out.
CELLS = 4
#: A paragraph ends with a line or a clause; one of more words than LONG is cut after every LONG words.
CUT, LONG = r"[^\n.,;:!?|]*[\n.,;:!?|]+|[^\n.,;:!?|]+", 20
#: Documents, paragraphs, and cells of larger sketches that are worked on together.
TOGETHER, MANY, MOST_CELLS = 256, 50_000, 100_000
#: Sketches that a pair gets at most; after the last its digests are compared one by one.
TRIES = 6
#: Ranges of ids for each shuffle partition.
RANGES = 4

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, edited_paragraphs long"


def digests(text: str, cut: re.Pattern) -> np.ndarray:
    """One distinct digest a paragraph, repeats included."""
    found, h = [], xxhash.xxh64_intdigest
    for p in cut.findall(text):
        if p.count(" ") <= LONG:
            found.append(p)
        else:
            words = p.split(" ")
            found += [" ".join(words[i : i + LONG]) for i in range(0, len(words), LONG)]
    if len(set(found)) == len(found):
        return np.array([h(p) for p in found], np.uint64)
    return np.array([h(p, k) for p, n in Counter(found).items() for k in range(n)], np.uint64)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketches:
    """The sketches of many documents in flat arrays; parts[i] is the number of cells of each of the three parts of i."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(3 * self.parts)])
        size = self.starts[-1]
        self.counts, self.keys, self.checks = np.zeros(size, np.int32), np.zeros(size, np.uint64), np.zeros(size, np.uint32)

    def places(self, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The three cells of each key, as rows."""
        part = self.parts[owner].astype(np.uint64)
        return np.stack([self.starts[owner] + k * self.parts[owner] + (mixed(keys, k + 1) % part).astype(np.int64) for k in range(3)])

    def put(self, owner: np.ndarray, keys: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Add each digest `by` (1 or -1) times."""
        places, checks = self.places(owner, keys), mixed(keys, 9).astype(np.uint32)
        off = by < 0
        keys, checks = np.where(off, -keys, keys), np.where(off, -checks, checks)
        for row in places:
            np.add.at(self.counts, row, by)
            np.add.at(self.keys, row, keys)
            np.add.at(self.checks, row, checks)
        return places

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.parts)
        out.counts, out.keys, out.checks = self.counts - other.counts, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """How many digests each sketch gave, and whether nothing was left in it. Empties the sketches."""
        given = np.zeros(len(self.parts), np.int64)
        at = np.arange(len(self.counts))
        owners = np.repeat(np.arange(len(self.parts)), 3 * self.parts)
        while len(at):
            at = at[np.abs(self.counts[at]) == 1]
            signs = self.counts[at]
            keys = np.where(signs < 0, -self.keys[at], self.keys[at])
            pure = np.where(signs < 0, -self.checks[at], self.checks[at]) == mixed(keys, 9).astype(np.uint32)
            at, keys, signs = at[pure], keys[pure], signs[pure]
            first = self.places(owners[at], keys)[0]
            once = np.unique(first, return_index=True)[1]  # each digest once; two with one first cell: the other later
            owner, keys, signs = owners[at[once]], keys[once], signs[once]
            given += np.bincount(owner, minlength=len(given))
            at = np.unique(self.put(owner, keys, -signs))
        left = (self.counts != 0) | (self.keys != 0) | (self.checks != 0)
        return given, np.add.reduceat(left, self.starts[:-1]) == 0

    def strings(self) -> list[str]:
        """Each sketch as text: counts, digests and check sums of its cells."""
        out = []
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            raw = self.counts[a:b].astype("<i4").tobytes() + self.keys[a:b].astype("<u8").tobytes() + self.checks[a:b].astype("<u4").tobytes()
            out.append(base64.b64encode(raw).decode())
        return out


def sketched(sets: list[np.ndarray], parts: np.ndarray) -> Sketches:
    out = Sketches(parts)
    if sets:
        keys = np.concatenate(sets)
        out.put(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), keys, np.ones(len(keys), np.int32))
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], first: Sketches | None = None, second: Sketches | None = None) -> np.ndarray:
    """Common digests over all, for each pair; by subtracting and peeling, larger sketches for those that fail."""
    both = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    parts, todo = np.full(len(a), CELLS), np.arange(len(a))
    differ = np.zeros(len(a), np.int64)
    tries = 0
    while len(todo):
        if (tries := tries + 1) > TRIES:  # equal digests within one text never peel, whatever the size
            for i in todo:
                x, y = np.unique(a[i]), np.unique(b[i])
                both[i], differ[i] = len(x) + len(y), len(np.setxor1d(x, y, assume_unique=True))
            break
        failed = []
        for some in np.split(todo, np.flatnonzero(np.diff(np.cumsum(3 * parts[todo]) // MOST_CELLS)) + 1):
            if first is None:
                first, second = sketched([a[i] for i in some], parts[some]), sketched([b[i] for i in some], parts[some])
            given, ok = first.minus(second).peel()
            differ[some[ok]] = given[ok]
            failed.append(some[~ok])
            first = None
        todo = np.concatenate(failed)
        parts[todo] = np.maximum(2 * parts[todo], -(-both[todo] // 4))
    return np.where(both + differ > 0, (both - differ) / np.maximum(both + differ, 1), 1.0)


def rows_of(pairs: list[tuple[int | None, str, np.ndarray, str, np.ndarray]], cut: re.Pattern) -> list[tuple]:
    """pairs: doc_id, text, its digests, the next document's text, and that one's digests."""
    edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for _, text, _, after, _ in pairs]
    own, new, follow = [p[2] for p in pairs], [digests(x, cut) for x in edited], [p[4] for p in pairs]
    base = np.full(len(pairs), CELLS)
    s_own, s_new, s_next = sketched(own, base), sketched(new, base), sketched(follow, base)
    near, far = likeness(own, new, s_own, s_new), likeness(own, follow, s_own, s_next)
    return [
        (p[0], len(p[1]), hashlib.sha256(e.encode()).hexdigest(), f, g, float(x), float(y), len(o), len(w))
        for p, e, f, g, x, y, o, w in zip(pairs, edited, s_own.strings(), s_new.strings(), near, far, own, new)
    ]


def next_in_line(docs: DataFrame, ranges: int) -> DataFrame:
    """part, look, rev, doc_id, text: rows in ranges of ids, and for each range one row more (look) that follows its last.

    The order is descending doc_id, null ids last, equal ids by text. The driver sees one id a range.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("rev", F.bitwise_not(F.coalesce("doc_id", F.lit(-(2**63)))))
    cuts = docs.select(F.percentile_approx("rev", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("x")).first().x or []
    cuts = sorted(set(cuts))

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        edges = np.array(cuts, np.int64)
        for batch in batches:
            yield pd.Series(np.searchsorted(edges, batch.to_numpy(), side="right").astype(np.int32))

    part = F.pandas_udf(place, "int")("rev")
    heads = sorted((r.part, r.rev) for r in docs.select("rev", part.alias("part")).groupBy("part").agg(F.min("rev").alias("rev")).collect())
    follow = [(heads[(i + 1) % len(heads)][1], p) for i, (p, _) in enumerate(heads)]
    ahead = docs.join(F.broadcast(spark.createDataFrame(follow, "rev long, part int")), "rev").groupBy("part").agg(F.min("text").alias("text"))
    ahead = ahead.select("part", F.lit(True).alias("look"), F.lit(2**63 - 1).alias("rev"), F.lit(None).cast("long").alias("doc_id"), "text")
    return docs.select(part.alias("part"), F.lit(False).alias("look"), "rev", "doc_id", "text").unionByName(ahead)


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: str = CUT) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (SCHEMA).

    The edited text has its last half of code points replaced by the first as many (or all) of the next document in
    descending doc_id; after the last comes the first. Null ids come last, equal ids follow each other in order of text,
    repeated rows are documents of their own. A null text is empty; two texts without paragraphs have likeness 1. Equal
    texts have equal fingerprints. A very long text is sketched whole, by one task. An empty table gives no rows; other columns are ignored.
    """
    slim = columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.coalesce(F.col(text), F.lit("")))
    n = partitions(docs.sparkSession)
    if slim.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(cut)
        last, pairs, held = None, [], 0
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()])], names)
        for batch in batches:
            for part, look, key, value in zip(*(batch.column(k) for k in range(4))):
                part, look, key, value = part.as_py(), look.as_py(), key.as_py(), value.as_py()
                now = (part, key, value, digests(value, pattern))
                if last and last[0] == part:
                    pairs.append((*last[1:], value, now[3]))
                    held += len(now[3])
                last = None if look else now
                if len(pairs) >= TOGETHER or held > MANY:
                    yield out(rows_of(pairs, pattern))
                    pairs, held = [], 0
        if pairs:
            yield out(rows_of(pairs, pattern))

    dealt = next_in_line(slim, RANGES * n).repartition(n, "part").sortWithinPartitions("part", "look", "rev", "text")
    return dealt.select("part", "look", "doc_id", "text").mapInArrow(run, SCHEMA)


def op3_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprints; see fingerprint_edits for nulls, ties, repeated rows and empty tables."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
