"""SimHash near-duplicates by a Gray-order hierarchical index.

Two fingerprints within the radius agree on EQUAL of any radius + EQUAL parts that they are cut into. So each fingerprint
goes into one bucket for every choice of EQUAL parts, by what these parts hold: links are found within buckets, and the
number of copies depends on the radius alone. Rows are dealt in order of bucket and Gray rank, so that neighbours share
long bit patterns and a large bucket fills several partitions of usual size.

Inside a partition every FANOUT neighbours form a node, every FANOUT nodes a node above, and so on to a root; a node holds
the bits on which all its fingerprints agree (its mask), their value, and its range of buckets. A search goes down from
the root and adds, at each node, the differences in the bits that this node fixes and its parents did not; once the sum
exceeds the radius, or the bucket is another, the whole group below is left out. A group that lies within the radius as a
whole is taken as a whole. For buckets that several partitions share, pairs of partitions are searched whose shared
patterns don't differ too much.

Links found are not listed pair by pair: groups are joined on the spot and given out as chains of at most as many edges as
there are fingerprints. Connected components of the chains are then found by Spark joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, components, lookup, partitions, table, written

SHINGLE, SEED, RADIUS, FANOUT = 3, 42, 3, 8
#: Parts of a fingerprint that are equal in a bucket.
EQUAL = 2
#: Rows of buckets in a partition, about.
PART_ROWS = 500_000
#: Queries that go down the index together, and pairs of query and node, which bound the memory of a search.
TOGETHER, FRONTIER = 16_384, 500_000
#: near_copies: words of a shingle and the least similarity; words of the features that are hashed, and the radius.
SIMILAR_SHINGLE, SIMILARITY, FEATURE, WIDE = 5, 0.8, 2, 8
#: Shingles of a part of a component of near copies, about.
UNIT_SHINGLES = 2_000_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the ASCII white space only
    if not words:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= size:
        return h(join(words), SEED)
    hashes = np.array([h(join(x), SEED) for x in zip(*(words[i:] for i in range(size)))], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row; a null text has none of its words set: fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    slim = columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The rank of a code word in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The levels of the index, leaves first: patterns, the bits new at that level, bits left open, ranges of buckets."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray, fanout: int = FANOUT):
        self.fanout, self.order = fanout, np.lexsort((gray_rank(fp), bucket))
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        values, masks = [fp[self.order]], [np.full(len(fp), every)]
        self.first, self.last = [bucket[self.order]], [bucket[self.order]]
        while len(values[-1]) > 1:
            starts = np.arange(0, len(values[-1]), fanout)
            both = np.bitwise_and.reduceat(values[-1], starts)
            any_ = np.bitwise_or.reduceat(values[-1] & masks[-1], starts)
            mask = np.bitwise_and.reduceat(masks[-1], starts) & ~(both ^ any_)
            values.append(both & mask)
            masks.append(mask)
            self.first.append(self.first[-1][starts])
            self.last.append(self.last[-1][np.append(starts[1:], len(self.last[-1])) - 1])
        self.values = values
        self.new = [m & ~np.repeat(up, fanout)[: len(m)] for m, up in zip(masks, masks[1:])] + [masks[-1]]
        self.open = [np.bitwise_count(~m) for m in masks]

    def search(self, bucket: np.ndarray, fp: np.ndarray, radius: int, whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in fp, among the leaves) of all pairs of one bucket within the radius. whole: of a group that lies
        within it as a whole just the first leaf, with which the group's own members are linked in turn."""
        top = len(self.values) - 1
        todo = [(top, q, np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8)) for q in np.array_split(np.arange(len(fp)), -(-len(fp) // TOGETHER) or 1)]
        while todo:
            level, query, node, spent = todo.pop()
            spent = spent + np.bitwise_count((fp[query] ^ self.values[level][node]) & self.new[level][node])
            mine = bucket[query]
            near = (spent <= radius) & (self.first[level][node] <= mine) & (mine <= self.last[level][node])
            query, node, spent = query[near], node[near], spent[near]
            if not level:
                yield query, node
                continue
            if whole:
                done = (spent + self.open[level][node] <= radius) & (self.first[level][node] == self.last[level][node])
                yield query[done], node[done] * self.fanout**level
                query, node, spent = query[~done], node[~done], spent[~done]
            query, spent = np.repeat(query, self.fanout), np.repeat(spent, self.fanout)
            node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            real = node < len(self.values[level - 1])
            query, node, spent = query[real], node[real], spent[real]
            for some in np.array_split(np.arange(len(query)), -(-len(query) // FRONTIER) or 1):
                todo.append((level - 1, query[some], node[some], spent[some]))


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the position of a member) after joining the groups of a[i] and b[i]."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            over = labels[labels]
            if (over == labels).all():
                break
            labels = over


class Rows:
    """Rows of buckets: bucket, fp, node."""

    def __init__(self, part: pd.DataFrame | dict):
        self.bucket, self.node = np.asarray(part["bucket"]), np.asarray(part["node"])
        self.fp = np.asarray(part["fp"]).view(np.uint64)

    def found(self, others: Rows | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes a, b of chains that join just what the links within these rows, or with others, join."""
        index = GrayIndex(self.bucket, self.fp)
        asked, order = (self, index.order) if others is None else (others, np.arange(len(others.fp)))
        leaves = self.node[index.order]
        nodes = leaves if others is None else np.concatenate([leaves, others.node])
        base, labels = 0 if others is None else len(leaves), np.arange(len(nodes))
        for query, leaf in index.search(asked.bucket[order], asked.fp[order], radius):
            labels = joined(labels, query + base, leaf)
        order = np.argsort(labels, kind="stable")
        same = labels[order][1:] == labels[order][:-1]
        return nodes[order][:-1][same], nodes[order][1:][same]


def bucketed(items: DataFrame, radius: int) -> DataFrame:
    """items(fp, node) in all their buckets, with the Gray rank as a signed long in unsigned order."""
    n = radius + EQUAL
    cuts = [64 * k // n for k in range(n + 1)]
    masks = [sum((1 << hi) - (1 << lo) for lo, hi in some) for some in combinations(zip(cuts, cuts[1:]), EQUAL)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    each = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)])
    rows = items.select("fp", "node", rank.bitwiseXOR(F.lit(-(2**63))).alias("rank"))
    return rows.select(F.explode(each).alias("bucket"), "rank", "fp", "node")


def links(items: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """Edges a, b between nodes of items(fp, node): chains whose components are those of all links within the radius.
    rows: how many items there are."""
    copies = (radius + EQUAL) * (radius + EQUAL - 1) // 2
    n = max(partitions(items.sparkSession), -(-rows * copies // PART_ROWS))
    names = ["bucket", "fp", "node"]
    given = pa.schema([(c, pa.int64()) for c in names])
    made = pa.schema([(c, pa.int64()) for c in ("a", "b", *names)])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of a partition, and the rows of its first and last buckets, which others may share."""
        part = pa.Table.from_batches([x.cast(given) for x in batches], given)
        if not part.num_rows:
            return
        rows = Rows({c: part[c].to_numpy() for c in names})
        a, b = rows.found(None, radius)
        border = np.flatnonzero((rows.bucket == rows.bucket.min()) | (rows.bucket == rows.bucket.max()))
        none = lambda k: pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[none(len(a)) for _ in names]], schema=made)
        yield pa.RecordBatch.from_arrays([none(len(border)), none(len(border)), *[part[c].combine_chunks().take(pa.array(border)) for c in names]], schema=made)

    dealt = bucketed(items, radius).repartitionByRange(n, "bucket", "rank").select(*names)
    found = dealt.mapInArrow(inside, ", ".join(f"{f.name} long" for f in made)).withColumn("part", F.spark_partition_id())
    found = written(found, "links")
    border = found.where("bucket IS NOT NULL").select(*names, "part")
    shared = border.groupBy("bucket", "part").agg(F.expr("bit_and(fp)").alias("v"), F.expr("bit_or(fp)").alias("o"))
    shared = shared.groupBy("bucket").agg(F.collect_list(F.struct("part", "v", F.bitwise_not(F.col("v").bitwiseXOR(F.col("o"))).alias("mask"))).alias("parts")).where(F.size("parts") > 1)
    own = F.element_at(F.filter("parts", lambda p: p["part"] == F.col("part")), 1)
    near = lambda p: F.bit_count(p["v"].bitwiseXOR(own["v"]).bitwiseAND(p["mask"]).bitwiseAND(own["mask"])) <= radius
    other = F.transform(F.filter("parts", lambda p: (p["part"] != F.col("part")) & near(p)), lambda p: p["part"])
    units = border.join(shared, "bucket").select(*names, "part", F.explode(other).alias("other"))
    units = units.select(*names, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") < F.col("other")).alias("indexed"))

    def across(part: pd.DataFrame) -> pd.DataFrame:
        a, b = Rows(part[part["indexed"]]).found(Rows(part[~part["indexed"]]), radius)
        return pd.DataFrame({"a": a, "b": b})

    crossed = units.groupBy("bucket", "lo", "hi").applyInPandas(across, "a long, b long")
    crossed = written(crossed, "crossed", border.count())
    edges = found.where("a IS NOT NULL").select("a", "b").unionByName(crossed)
    return written(edges.distinct(), "edges", edges.count())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over links of at most `radius` bits.

    One row for each row of docs. Null texts, empty ones and those without words have fingerprint 0 and are linked like
    any other. A null doc_id is kept; it counts as no id, so that a component of such rows alone has a null
    component_id. Repeated rows come out repeated; equal fingerprints are one node. A very long text is hashed whole, its
    shingles some thousands at a time. An empty table gives no rows; other columns are ignored.
    """
    docs = written(fingerprints(docs, doc_id, text, size), "fingerprints")
    known = written(docs.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    edges = links(known.select("fp", F.col("fp").alias("node")), known.count(), radius)
    roots = components(edges).withColumnRenamed("node", "fp")
    member = known.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = written(member, "members", known.count())
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(member.join(least, "root").select("fp", "n", "component_id"), "labels", known.count())
    return lookup(docs, found, "fp", "n", docs.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def prints(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, digest (of the words in lower case, 128 bits) and fp for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            digests = [hashlib.md5(b" ".join(x.lower().split()), usedforsecurity=False).digest() for x in texts]
            fps = np.array([fingerprint(x, size) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(fps)], ["key", "digest", "fp"])

    slim = columns(docs, key=key, text=F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, digest binary, fp long")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(node, text binary) to node and the sorted distinct hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, join = xxhash.xxh64_intdigest, b" ".join
        for batch in batches:
            sets = []
            for x in batch.column(1):
                words = x.as_py().lower().split()
                sets.append(np.unique(np.array([h(join(g)) for g in zip(*(words[i:] for i in range(min(size, len(words) or 1))))] if words else [], np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def similar(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join just what the pairs of sets with that Jaccard similarity or more join.

    Two such sets share one of the least common shingles of both, as many as may be missing and one. Sets that are known
    to be joined are not compared.
    """
    sizes = np.array([len(x) for x in sets])
    known, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare = np.lexsort((known, often)).argsort()[place]  # each shingle's rank, the rarest first
    starts = np.concatenate([[0], np.cumsum(sizes)])
    labels = np.arange(len(sets))
    holders: dict[int, list[int]] = {}
    a, b = [], []
    for i in np.argsort(sizes, kind="stable").tolist():
        mine = np.sort(rare[starts[i] : starts[i + 1]])
        first = mine[: sizes[i] - int(np.ceil(similarity * sizes[i] - 1e-9)) + 1].tolist()
        met = [holders.setdefault(x, []) for x in first]
        others = np.unique(np.array([j for x in met for j in x], np.int64))
        others = others[sizes[others] >= similarity * sizes[i] - 1e-9]
        while len(others := others[labels[others] != labels[i]]):
            j, others = int(others[-1]), others[:-1]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= (similarity - 1e-12) * (sizes[i] + sizes[j] - both):
                labels[labels == labels[i]] = labels[j]
                a.append(j)
                b.append(i)
        for x in met:
            x.append(i)
    return nodes[a], nodes[b]


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, feature: int = FEATURE, radius: int = WIDE) -> DataFrame:
    """key and group for every row: rows of one group are linked by texts whose sets of word shingles have that Jaccard
    similarity or more, among texts whose fingerprints are linked by `radius` bits or fewer, at once or by way of others.

    The fingerprint, over shingles of `feature` words, only finds the components; within them every link is checked
    exactly. A component of more than UNIT_SHINGLES shingles is cut by hash into parts, and each pair of parts is a unit
    of its own: so no task holds more than two parts, and no link is lost. Texts with equal words in lower case are one
    node; texts without words are alike. A text of fewer words than a shingle is one shingle. A null text is empty. Rows
    with one key must have one text; null keys are a key. A very long text is hashed whole. An empty table gives no rows;
    other columns are ignored.
    """
    rows = written(prints(docs, key, text, feature), "prints")
    nodes = rows.groupBy("digest").agg(F.min("fp").alias("fp"), F.min("key").alias("key"), F.count("*").alias("n"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
    edges = links(nodes.select("fp", "node"), nodes.count(), radius)
    roots = components(edges, "candidates")
    slim = columns(docs, key=key, text=F.coalesce(F.col(text), F.lit("")).cast("binary"))
    ours = nodes.join(roots, "node").select("key", "node")
    texts = slim.join(ours, slim["key"].eqNullSafe(ours["key"])).select("node", "text")
    sets = written(shingle_sets(texts, size).dropDuplicates(["node"]).join(roots, "node"), "shingles")
    whole = sets.groupBy("root").agg((F.floor(F.sum(F.size("shingles")) / UNIT_SHINGLES) + 1).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    units = sets.join(whole, "root").withColumn("own", mine).select("root", "node", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "shingles")

    def checked(part: pa.Table) -> pa.Table:
        lists = part["shingles"].combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        a, b = similar(part["node"].to_numpy(), [flat[x:y] for x, y in zip(at, at[1:])], similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = written(units.groupBy("root", "lo", "hi").applyInArrow(checked, "a long, b long"), "similar")
    group = nodes.join(components(found, "copies"), "node", "left").select("digest", "n", F.coalesce("root", "node").alias("group"))
    return lookup(rows.select("key", "digest"), written(group, "groups", nodes.count()), "digest", "n", rows.count()).select(F.col("key").alias(key), "group")


def op5_simhash_gray_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component; see near_duplicates for nulls, ties, repeated rows and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))
