"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions. Each of the 255 possible beginnings of a byte has its own context tree, whose
nodes are the last 0, 1, .. DEPTH bytes; a node holds how often 0 and 1 followed, the Krichevsky-Trofimov estimate of
that, and the weighted probability: the mean of its own estimate and the product of its children's. A decision's
probability mixes the estimates of all depths on its path by the weights that these give; where the training text never
had a longer context, the deepest node that it had takes the rest.

All of it follows from the counts of byte strings of DEPTH + 1 bytes. Documents are dealt to groups by hash. Each group
counts its own strings and words once, as sorted arrays cut into buckets; buckets merge the counts of all groups, build
the trees below the last three bytes, and send each group the values of just the strings and words that it has. Nothing
that grows with the corpus is broadcast: the three upper levels, which are, have 2**24 nodes at most, however large the
corpus; of text they have some hundred thousand. The numbers of groups and buckets follow the bytes of text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table, written
from .iblt_fingerprints import mixed

DEPTH = 5
#: Text ends with this byte, which UTF-8 never has; it also stands before the text's first byte.
EDGE = b"\xff"
#: Bytes of text in a group of documents, about; groups and buckets at least.
GROUP_BYTES, LEAST_GROUPS, LEAST_BUCKETS = 32 << 20, 6, 64
#: A group's counts are merged when so many strings wait.
WAITING = 1_000_000
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, brought down again."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def strings(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """Each byte of the text and its end, with the `depth` bytes before it, as one number."""
    data = np.frombuffer(EDGE * depth + text + EDGE, np.uint8).astype(np.uint64)
    code = np.zeros(len(data) - depth, np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | data[k : len(data) - depth + k]
    return code


def word_hashes(text: bytes) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in text.split()], np.uint64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts in 32 bits each where all fit, else in 64."""
    return counts.astype(np.int32 if not len(counts) or counts.max() < 2**31 else np.int64).tobytes()


def unpacked(counts: bytes, n: int) -> np.ndarray:
    """The n counts that packed() gave."""
    return np.frombuffer(counts, np.int64 if len(counts) > 4 * n else np.int32)


class Counts:
    """Sorted keys with how often training documents have them; 0 for keys that only other documents have."""

    def __init__(self):
        self.wait: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size, self.keys, self.counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, train: bool) -> None:
        self.wait[train].append(keys)
        self.size += len(keys)
        if self.size > WAITING:
            self.settle()

    def settle(self) -> None:
        for train, some in self.wait.items():
            if some:
                keys, counts = np.unique(np.concatenate(some), return_counts=True)
                self.keys, self.counts = merged([self.keys, keys], [self.counts, counts * train])
        self.wait, self.size = {True: [], False: []}, 0


class Level:
    """The nodes of one depth: node = context << 8 | beginning of the byte (a leading 1, then the bits so far)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        nodes, bits, n = [], [], []
        for j in range(8):
            node, bit = self.at(keys, depth, j)
            nodes.append(node)
            bits.append(bit)
            n.append(counts)
        self.depth = depth
        self.nodes, place = np.unique(np.concatenate(nodes), return_inverse=True)
        bits, n = np.concatenate(bits), np.concatenate(n)
        self.ones = np.bincount(place, n * bits, len(self.nodes))
        self.zeros = np.bincount(place, n * (1 - bits), len(self.nodes))
        self.own = log_kt(self.zeros, self.ones)
        self.weighted, self.share = self.own, np.ones(len(self.nodes))

    @staticmethod
    def at(keys: np.ndarray, depth: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The node of each string's j-th bit, and the bit."""
        byte = keys & np.uint64(255)
        start = (byte >> np.uint64(8 - j)) | np.uint64(1 << j)
        context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
        return context << np.uint64(8) | start, ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)

    def above(self, other: Level) -> Level:
        """Weigh by the children in `other`, the next depth."""
        up = np.searchsorted(self.nodes, other.nodes & np.uint64((1 << 8 * (self.depth + 1)) - 1))
        below = np.bincount(up, other.weighted, len(self.nodes))
        self.weighted = np.logaddexp(self.own, below) - np.log(2)
        self.share = np.exp(self.own - np.log(2) - self.weighted)
        return self


class Top:
    """Depths 0 to 2: mass of a 1 so far, what is left to deeper nodes, and the probability of a 1 if nothing deeper is
    known. Depth 1 as arrays over all its nodes, depth 2 for the nodes that training has, in order."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        order = np.argsort(node)
        self.nodes, zeros, ones, below = node[order].astype(np.uint64), zeros[order], ones[order], below[order]
        own2 = log_kt(zeros, ones)
        weighted2 = np.logaddexp(own2, below) - np.log(2)
        up = (self.nodes & np.uint64(0xFFFF)).astype(np.int64)
        a, b, deep = (np.bincount(up, x, 65536) for x in (zeros, ones, weighted2))
        seen = np.bincount(up, minlength=65536) > 0
        own = log_kt(a, b)
        weighted = np.where(seen, np.logaddexp(own, deep) - np.log(2), 0.0)
        share = np.exp(own - np.log(2) - np.where(seen, weighted, 0.0))
        a0, b0 = a.reshape(256, 256).sum(0), b.reshape(256, 256).sum(0)
        own0 = log_kt(a0, b0)
        share0 = np.exp(own0 - np.logaddexp(own0, weighted.reshape(256, 256).sum(0)))
        kt, kt0 = (b + 0.5) / (a + b + 1), (b0 + 0.5) / (a0 + b0 + 1)
        mass0, left0 = np.tile(share0 * kt0, 256), np.tile(1 - share0, 256)
        mass, left = mass0 + left0 * share * kt, left0 * (1 - share)
        self.stop1 = np.where(seen, mass0 + left0 * kt, np.tile(kt0, 256))
        share2, kt2 = np.exp(own2 - np.log(2) - weighted2), (ones + 0.5) / (zeros + ones + 1)
        self.mass, self.left, self.stop = mass[up] + left[up] * share2 * kt2, left[up] * (1 - share2), mass[up] + left[up] * kt2


def trees(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """Levels 3 .. depth over the strings that training has."""
    keys, counts = keys[counts > 0], counts[counts > 0]
    levels = [Level(keys, counts, d) for d in range(3, depth + 1)]
    for up, low in zip(levels[-2::-1], levels[:0:-1]):
        up.above(low)
    return levels


def log10_probabilities(keys: np.ndarray, levels: list[Level], top: Top) -> np.ndarray:
    """Of each string's last byte, given the others."""
    above, so_far, left = top.nodes, top.mass, top.left
    known = [(2, top.nodes, top.stop)]
    for level in levels:
        kt = (level.ones + 0.5) / (level.zeros + level.ones + 1)
        up = np.searchsorted(above, level.nodes & np.uint64((1 << 8 * level.depth) - 1))
        known.append((level.depth, level.nodes, so_far[up] + left[up] * kt))
        above, so_far, left = level.nodes, so_far[up] + left[up] * level.share * kt, left[up] * (1 - level.share)
    total = np.zeros(len(keys))
    for j in range(8):
        node, bit = Level.at(keys, 1, j)
        one = top.stop1[node.astype(np.int64)]
        for depth, nodes, stop in known:
            if not len(nodes):
                break
            node, _ = Level.at(keys, depth, j)
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            one = np.where(nodes[at] == node, stop[at], one)
        total += np.log10(np.where(bit == 1, one, 1 - one))
    return total


class Values:
    """Values by key for many look-ups: a table by hash, and a search for the keys that lost their place in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        size = 1 << 64 - int(self.shift)
        self.row = np.zeros(size, np.int32)
        self.row[self.slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        row = self.row[self.slot(keys)]
        lost = np.flatnonzero(self.keys[row] != keys)
        row[lost] = np.searchsorted(self.keys, keys[lost])
        return self.values[row]


def lowered(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1, depth: int = DEPTH) -> DataFrame:
    """Score every whole text (SCHEMA), learning from the rows whose crc32(doc_id as text) mod `folds` is not `fold`.

    score is log10 of the model's probability of the text (A-Z lower-cased) and its end; bits_per_byte is the code length
    that follows. base_score is that of a unigram model over words and an end token. A null text is empty: just its
    end. A row with a null doc_id is a training row. Repeated rows count, and are scored, as often as they occur. With no
    training rows every byte costs eight bits. An empty table gives no rows; other columns are ignored. A very long text
    is scored whole, by one task; every row is scored on its own, so ties don't matter. Words are counted by 64-bit hashes, and all counts are 64 bits wide. depth: 3 or more.
    """
    if depth < 3:
        raise ValueError("a depth of 3 bytes or more is needed")
    rows = columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.coalesce(F.col(text), F.lit("")).cast("binary"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    n_groups = max(LEAST_GROUPS, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))
    n_buckets = max(LEAST_BUCKETS, n_groups)
    rows = rows.select("doc_id", "text", held.alias("held"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int").alias("gid"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[Counts, Counts]] = defaultdict(lambda: (Counts(), Counts()))
        end = np.array([xxhash.xxh64_intdigest(b"")], np.uint64)
        for batch in batches:
            for gid, held, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = lowered(value.as_py())
                found[gid][0].add(strings(data, depth), not held)
                found[gid][1].add(np.concatenate([word_hashes(data), end]), not held)
        for gid, both in found.items():
            for kind, c in enumerate(both):
                c.settle()
                # Strings by their last three context bytes, so that a bucket has whole trees; words by hash.
                bucket = (mixed((c.keys >> np.uint64(8)) & np.uint64(0xFFFFFF), 5) if kind == 0 else c.keys) % np.uint64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
                filled = np.flatnonzero(np.diff(ends))  # so rows are as many as strings at most, however many groups and buckets
                parts = [order[ends[k] : ends[k + 1]] for k in filled]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gid] * len(parts), pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array(filled, pa.int32()),
                     pa.array([c.keys[p].tobytes() for p in parts]), pa.array([packed(c.counts[p]) for p in parts])],
                    ["gid", "kind", "bucket", "keys", "counts"],
                )

    counted = rows.select("gid", "held", "text").repartitionById(n_groups, F.col("gid")).mapInArrow(count, "gid int, kind int, bucket int, keys binary, counts binary")
    counted = written(counted, "counts")

    def read(part: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
        keys = [np.frombuffer(b, np.uint64) for b in part["keys"]]
        return keys, [unpacked(b, len(k)) for b, k in zip(part["counts"], keys)]

    def subtrees(part: pd.DataFrame) -> pd.DataFrame:
        low = trees(*merged(*read(part)), depth)[0]
        node, place = np.unique(low.nodes & np.uint64(0xFFFFFF), return_inverse=True)
        total = lambda x: np.bincount(place, x, len(node)) if len(node) else np.zeros(0)
        return pd.DataFrame({"node": node.astype(np.int64), "zeros": total(low.zeros), "ones": total(low.ones), "below": total(low.weighted)})

    below = counted.where("kind = 0").groupBy("bucket").applyInPandas(subtrees, "node long, zeros double, ones double, below double")
    upper = below.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toPandas()  # 2**24 at most
    top = Top(*(upper[c].to_numpy() for c in ("node", "zeros", "ones", "below")))

    def valued(part: pd.DataFrame) -> pd.DataFrame:
        own, counts = read(part)
        keys, counts = merged(own, counts)
        vocabulary, tokens = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        if part["kind"].iloc[0] == 0:
            values = log10_probabilities(keys, trees(keys, counts, depth), top)
        else:
            values = counts
            vocabulary[:1], tokens[:1] = (counts > 0).sum(), counts.sum()
        coded = (lambda x: x.astype(np.float32).tobytes()) if part["kind"].iloc[0] == 0 else packed
        out = [coded(values[np.searchsorted(keys, k)]) for k in own]
        return pd.DataFrame({"gid": part["gid"], "kind": part["kind"], "keys": part["keys"], "values": out, "vocabulary": vocabulary, "tokens": tokens})

    values = counted.groupBy("kind", "bucket").applyInPandas(valued, "gid int, kind int, keys binary, values binary, vocabulary long, tokens long")
    values = written(values, "values")
    size = values.agg(F.sum("vocabulary").alias("v"), F.sum("tokens").alias("n")).first()
    v, n = size.v or 0, size.n or 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tables = None, ([], [], [], []), []
        end = np.array([xxhash.xxh64_intdigest(b"")], np.uint64)
        for batch in batches:
            out = []
            for gid, kind, key, held, text, keys, found in zip(*(batch.column(k) for k in range(7))):
                gid, kind = gid.as_py(), kind.as_py()
                if gid != now:
                    now, parts, tables = gid, ([], [], [], []), []
                if kind < 2:
                    parts[2 * kind].append(np.frombuffer(keys.as_py(), np.uint64))
                    parts[2 * kind + 1].append(np.frombuffer(found.as_py(), np.float32) if kind == 0 else unpacked(found.as_py(), len(parts[2][-1])))
                    continue
                if not tables:
                    tables = [Values(np.concatenate(parts[k]), np.concatenate(parts[k + 1])) for k in (0, 2)]
                    parts = ([], [], [], [])
                data = lowered(text.as_py())
                total = float(tables[0].of(strings(data, depth)).sum(dtype=np.float64))
                known = tables[1].of(np.concatenate([word_hashes(data), end]))
                base = float(np.log10((known + 0.5) / (n + 0.5 * (v + 1))).sum())
                out.append((key.as_py(), held.as_py(), len(known), int((known > 0).sum()), n, base, total, len(data), -total / np.log10(2) / (len(data) + 1)))
            if out:
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in SCHEMA.split(", ")])

    none = lambda kind: F.lit(None).cast(kind)
    given = values.select("gid", "kind", none("long").alias("doc_id"), none("boolean").alias("held"), none("binary").alias("text"), "keys", "values")
    asked = rows.select("gid", F.lit(2).alias("kind"), "doc_id", "held", "text", none("binary").alias("keys"), none("binary").alias("values"))
    return given.unionByName(asked).repartitionById(n_groups, F.col("gid")).sortWithinPartitions("gid", "kind").mapInArrow(scored, SCHEMA)


def op7_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; see score for nulls, ties, repeated rows and empty tables."""
    return score(table(spark, sf_dir, "documents"))
