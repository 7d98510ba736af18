"""Mixing documents of overlapping sources to target sizes.

Documents are aggregated by the set of sources that they belong to. A min-cost flow routes each set's words to the quotas of
its sources: the first copy of a word is free, each further copy costs more than the one before. What a set has to give is
then taken from its documents in a seeded order; the one at the end is cut, so that quotas are met to the word.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, table, written

#: Sets of sources that the driver solves for, at most; more raise an error. Each is one row, whatever the number of documents.
MOST_SETS = 200_000
#: Documents of a bucket of the seeded order, about, and the hex digits that buckets can be told apart by.
BUCKET_ROWS, BUCKET_DIGITS = 20_000, 4
SEED = 13
WORD = r"[^\x20\x09-\x0D]+"


class Quota(NamedTuple):
    source: str | None
    size: int
    target: float


def shares(weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, stop: int = 2) -> Callable[[dict[str | None, int], int], list[Quota]]:
    """Targets of sources by code point, null last: the weights repeat, and share `percent` of all sizes. A target stops at `stop`
    times its source's size; the excess is shared again by weight until none is above."""

    def of(sizes: dict[str | None, int], total: int) -> list[Quota]:
        names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
        stopped: set[str | None] = set()
        while True:
            free = [s for s in names if s not in stopped]
            room = percent * total - 100 * sum(stop * sizes[s] for s in stopped)  # hundredths of words
            whole = 100 * sum(weight[s] for s in free)
            over = [s for s in free if room * weight[s] > stop * sizes[s] * whole]
            if not over:
                return [Quota(s, sizes[s], float(stop * sizes[s]) if s in stopped else room * weight[s] / whole) for s in names]
            stopped.update(over)

    return of


class Flow:
    """Maximum flow by shortest augmenting levels; capacity may be added between runs, and flow stays."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        self.out[a].append(len(self.head))
        self.out[b].append(len(self.head) + 1)
        self.head += [b, a]
        self.room += [room, 0]
        return len(self.head) - 2

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] and level[self.head[e]] < 0:
                    level[self.head[e]] = level[a] + 1
                    queue.append(self.head[e])
        return level

    def run(self, source: int, sink: int) -> int:
        total = 0
        while (level := self.levels(source))[sink] >= 0:
            place, path, node = [0] * len(self.out), [], source
            while True:
                if node == sink:
                    more = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= more
                        self.room[e ^ 1] += more
                    total += more
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    node = self.head[path[full] ^ 1]
                    del path[full:]
                    continue
                arcs = self.out[node]
                while place[node] < len(arcs) and not (self.room[e := arcs[place[node]]] and level[self.head[e]] == level[node] + 1):
                    place[node] += 1
                if place[node] < len(arcs):
                    path.append(arcs[place[node]])
                    node = self.head[path[-1]]
                elif path:  # a dead end: step back and leave this arc out
                    node = self.head[path.pop() ^ 1]
                    place[node] += 1
                else:
                    break
        return total


def route(sizes: list[int], members: list[list[int]], quotas: list[int], copies: int = 2) -> list[dict[int, int]]:
    """For each set of sources, how many words go to which source: a flow of least cost among those that meet most of the quotas.

    Costs rise with every copy and arise on the way into a set alone, so every augmenting path costs as much as its copy. Taking
    all paths of one copy before the next is therefore the successive-shortest-path method, and least in cost for any convex
    costs."""
    n = len(sizes)
    flow = Flow(2 + n + len(quotas))
    source, sink = 0, 1
    into = [flow.arc(source, 2 + p, 0) for p in range(n)]
    between = [{q: flow.arc(2 + p, 2 + n + q, copies * sizes[p]) for q in of} for p, of in enumerate(members)]
    for q, quota in enumerate(quotas):
        flow.arc(2 + n + q, sink, quota)
    for _ in range(copies):
        for p in range(n):
            flow.room[into[p]] += sizes[p]
        flow.run(source, sink)
    return [{q: flow.room[e ^ 1] for q, e in of.items() if flow.room[e ^ 1]} for of in between]


def mix(docs: DataFrame, quotas: Callable[[dict[str | None, int], int], list[Quota]], doc_id: str = "doc_id", text: str = "text", sources: str = "sources", copies: int = 2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, sources and taken of every row of docs; source, source_size, target, taken of every source).

    sources: an array of the names that a document belongs to; null and empty arrays belong to none and are never taken, a null
    name is a name of its own. size: words between ASCII white space; a null or empty text has none. quotas gives targets from
    the sizes of the sources (a word counts in each of its own) and of all documents. taken: words that the mix takes, each
    repeat counted: at most `copies` times the size. Targets are rounded to words, and met if the documents suffice. In the
    seeded order of each set one document is taken in part. A row without an id is ordered by its text; rows that are alike in
    id and text lie together, in order of size, and repeated ones may trade places. Without rows there are none. Other columns
    are ignored. The driver gets one row a set of sources and solves the flow; more than MOST_SETS raise a ValueError.
    """
    spark = docs.sparkSession
    rows = columns(docs, doc_id=doc_id, text=F.coalesce(F.col(text), F.lit("")), sources=F.array_sort(F.array_distinct(F.coalesce(F.col(sources).cast("array<string>"), F.expr("CAST(array() AS ARRAY<STRING>)")))))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))), 256)
    slim = rows.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), "sources", F.to_json(F.struct("sources")).alias("of"), F.substr(key, F.lit(1), F.lit(16)).alias("key"))
    slim = written(slim, "mix")
    sets = slim.groupBy("of").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SETS + 1).collect()
    if len(sets) > MOST_SETS:
        raise ValueError(f"documents have more than {MOST_SETS} different sets of sources")
    sets.sort(key=lambda r: r["of"])
    sizes: dict[str | None, int] = {}
    for r in sets:
        for s in r.sources:
            sizes[s] = sizes.get(s, 0) + r["size"]
    wanted = quotas(sizes, sum(r["size"] for r in sets)) if sizes else []
    place = {q.source: i for i, q in enumerate(wanted)}
    routed = route([r["size"] for r in sets], [[place[s] for s in r.sources if s in place] for r in sets], [math.floor(q.target + 0.5) for q in wanted], copies)
    got = [sum(f.get(i, 0) for f in routed) for i in range(len(wanted))]
    report = spark.createDataFrame([(*q, n) for q, n in zip(wanted, got)], "source string, source_size long, target double, taken long")

    # A set takes every document `whole` times, and those first in the seeded order once more, up to `rest` words.
    whole = [divmod(sum(f.values()), r["size"]) if r["size"] else (0, 0) for f, r in zip(routed, sets)]
    digits = min(BUCKET_DIGITS, max(0, math.ceil(math.log(max(sum(r["n"] for r in sets), 1) / BUCKET_ROWS, 16))))
    slim = slim.withColumn("bucket", F.substr("key", F.lit(1), F.lit(digits)))
    plan = spark.createDataFrame([(r["of"], *w) for r, w in zip(sets, whole)], "of string, whole long, rest long")
    sums = slim.groupBy("of", "bucket").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
    ends = sums.withColumn("before", running - F.col("words")).join(F.broadcast(plan), "of").where("before <= rest AND rest < before + words")  # one a set at most
    plan = plan.join(ends.select("of", F.col("bucket").alias("end"), "before"), "of", "left")
    both = slim.join(F.broadcast(plan), "of")
    base = F.col("size") * F.col("whole")
    clear = both.where("end IS NULL OR bucket <> end").select("doc_id", "size", "sources", (base + F.when(F.col("bucket") < F.col("end"), F.col("size")).otherwise(0)).alias("taken"))
    order = Window.partitionBy("of").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = both.where("bucket = end").withColumn("left", F.col("rest") - F.col("before") - F.sum("size").over(order) + F.col("size"))
    cut = close.select("doc_id", "size", "sources", (base + F.greatest(F.lit(0).cast("long"), F.least("size", "left"))).alias("taken"))
    return clear.unionByName(cut), report


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it; see mix for nulls, ties, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("sources"))
    found, report = mix(docs, shares())
    own = found.withColumn("source", F.get("sources", F.lit(0)))
    each = report.select(F.col("source").alias("s"), "source_size", "target")
    return own.join(F.broadcast(each), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size, substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 16) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY size::DOUBLE / w, source NULLS LAST) AS r FROM s),
b AS (SELECT *, CAST(sum(2 * size) OVER (ORDER BY r) - 2 * size AS BIGINT) AS stopped, CAST(sum(w) OVER () - sum(w) OVER (ORDER BY r) + w AS BIGINT) AS free, CAST(sum(size) OVER () AS BIGINT) AS total FROM o),
f AS (SELECT * FROM b WHERE (150 * total - 100 * stopped) * w <= 2 * size * 100 * free ORDER BY r LIMIT 1),
t AS (SELECT b.source, b.size, CASE WHEN b.r < f.r THEN CAST(2 * b.size AS DOUBLE) ELSE CAST((150 * f.total - 100 * f.stopped) * b.w AS DOUBLE) / CAST(100 * f.free AS DOUBLE) END AS target FROM b, f),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
p AS (SELECT d.doc_id, d.size, q.size AS source_size, target, CASE WHEN q.size > 0 THEN quota // q.size ELSE 0 END AS whole, CASE WHEN q.size > 0 THEN quota % q.size ELSE 0 END AS rest,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, size * whole + greatest(0, least(size, rest - before)) AS taken FROM p
"""
