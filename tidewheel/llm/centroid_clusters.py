"""Centroid clustering of integer vectors, exact to the last unit.

Each batch of vectors meets all centroids in one float32 matrix product. A bound on its rounding errors gives an interval
for every distance; centroids whose interval reaches below the least upper end are a vector's shortlist, and only these
are compared once more in exact integers, ties going to the lowest number. Centroids move to exact floors of means.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table

#: Components up to this size have distances that fit 64 bits; larger ones are compared in Python's own integers.
SMALL = 1 << 27


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if x.size and max(np.abs(x).max(), np.abs(c).max()) > SMALL:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=1)


class Centroids:
    """Numbered integer centroids and what is needed to screen for the nearest one."""

    def __init__(self, rows: list[list[int]]):
        self.rows = np.array(rows, np.int64)
        self.single = self.rows.astype(np.float32)
        self.wide = self.rows.astype(np.float64)
        self.squares = (self.wide**2).sum(axis=1)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the squared distances to all centroids, less the squared length of the vector.

        A sum of d float32 products, in any order, is off by at most g = n u / (1 - n u) times the product of the lengths,
        with u = 2^-24 and n = d + 2, as both factors were rounded to float32. What float64 adds to that (squares,
        lengths, differences) is far below 2^-40 of the terms.
        """
        n = (x.shape[1] + 2) * 2.0**-24
        products = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(self.squares)
        middle = self.squares - 2 * products
        off = 2 * n / (1 - n) * lengths * (1 + 2.0**-30) + 2.0**-40 * (self.squares + 2 * np.abs(products)) + 2.0**-30
        return middle - off, middle + off

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, how many distances were computed exactly) for each row of x."""
        low, high = self.intervals(x)
        vector, number = np.nonzero(low <= high.min(axis=1)[:, None])
        exact = squared(x[vector], self.rows[number])
        starts = np.flatnonzero(np.diff(vector, prepend=-1))  # a row's shortlist is never empty
        least = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == np.repeat(least, np.diff(starts, append=len(vector))))
        first = hits[np.flatnonzero(np.diff(vector[hits], prepend=-1))]
        return number[first], least, len(vector)


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, size: int, scale: int) -> DataFrame:
    """vec_id, x: vectors of exactly `size` components, none null or non-finite, as floor(scale * component)."""
    rows = columns(vectors, vec_id=vec_id, x=F.col(embedding).cast("array<double>"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(F.size("x") == size).where(F.forall("x", finite)).withColumn("x", F.transform("x", lambda c: F.floor(c * scale)))


def matrix(batch: pa.RecordBatch, place: int, size: int) -> np.ndarray:
    return np.asarray(batch.column(place).flatten()).reshape(-1, size)


def moved(rows: DataFrame, centroids: Centroids, size: int) -> list[tuple[int, int, list[int]]]:
    """(number, count, sums) of the vectors nearest to each centroid that has any: sums within the tasks, one row a centroid from
    each, added up exactly. The driver gets as many rows as there are centroids."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids.rows), size), object)
        count = np.zeros(len(centroids.rows), np.int64)
        for batch in batches:
            x = matrix(batch, 0, size)
            if not len(x):
                continue
            own = centroids.nearest(x)[0]
            part = np.zeros(total.shape, np.int64 if np.abs(x).max() <= SMALL else object)
            np.add.at(part, own, x)
            total += part
            count += np.bincount(own, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(count[used], pa.int64()), pa.array([[Decimal(int(v)) for v in total[k]] for k in used], pa.list_(pa.decimal128(38, 0)))],
            ["number", "n", "sums"],
        )

    parts = rows.select("x").mapInArrow(sums, "number long, n long, sums array<decimal(38,0)>")
    each = [F.sum(F.get("sums", F.lit(i))).cast("decimal(38,0)") for i in range(size)]
    return [(r.number, r.n, [int(v) for v in r.sums]) for r in parts.groupBy("number").agg(F.sum("n").alias("n"), F.array(*each).alias("sums")).collect()]


def fit(rows: DataFrame, start: list[list[int]], rounds: int, size: int) -> Centroids:
    """Lloyd's rounds from the given centroids: each with vectors moves to their componentwise floor(sum / count)."""
    centroids = Centroids(start)
    for _ in range(rounds):
        now = centroids.rows.tolist()
        for number, n, sums in moved(rows, centroids, size):
            now[number] = [v // n for v in sums]
        centroids = Centroids(now)
    return centroids


def assigned(rows: DataFrame, centroids: Centroids, size: int, more: dict[str, tuple[str, list]] | None = None) -> DataFrame:
    """vec_id, cluster, distance, and for each of `more` (name: type, a value a centroid) the value of the vector's centroid."""
    more = more or {}
    kinds = {"long": pa.int64(), "string": pa.string()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, 1, size)
            own, distance, _ = centroids.nearest(x) if len(x) else (np.zeros(0, np.int64),) * 3
            extra = [pa.array(values, kinds[kind]).take(pa.array(own, pa.int64())) for kind, values in more.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(distance.tolist(), pa.int64()), *extra], ["vec_id", "cluster", "distance", *more])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(found, ", ".join([f"vec_id {kind}", "cluster int", "distance long", *(f"{c} {t}" for c, (t, _) in more.items())]))


def cluster(vectors: DataFrame, k: int, rounds: int, vec_id: str = "vec_id", embedding: str = "embedding", size: int = 64, scale: int = 256, order: Column | None = None) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector; the centroids).

    Vectors that have not exactly `size` components, or null or non-finite ones, are left out; the others become integers,
    floor(scale * component). The k with the least `order` (of equals, those with the least vec_id, then components; null
    last) are the first centroids, as many as there are if there are fewer. A null vec_id stays null; repeated rows are
    vectors of their own; equal distances go to the lowest number; a centroid without vectors stays. A distance or sum of
    distances beyond 64 bits raises an error. Without vectors there are no rows. Other columns are ignored.
    The table is read once a round, once for the sums and once for the result; nothing is shuffled but sums of centroids.
    """
    rows = integer_vectors(vectors, vec_id, embedding, size, scale)
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256) if order is None else order
    start = [r.x for r in rows.orderBy(F.asc_nulls_last(key), F.asc_nulls_last("vec_id"), "x").limit(k).select("x").collect()]
    if not start:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return rows.select("vec_id", *none), Centroids(np.zeros((0, size), np.int64))
    centroids = fit(rows, start, rounds, size)
    inertia = [0] * len(start)
    for r in assigned(rows, centroids, size).groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect():  # a row a centroid
        inertia[r.cluster] = int(r.d)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.rows.tolist()]
    more = {"cluster_inertia": ("long", inertia), "inertia": ("long", [sum(inertia)] * len(start)), "centroid_sha256": ("string", digest)}
    return assigned(rows, centroids, size, more), centroids


#: Production parameters of the query.
K, ROUNDS = 40, 5


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster; see cluster for nulls, ties, repeated rows and empty tables."""
    return cluster(table(spark, sf_dir, "embeddings"), K, ROUNDS)[0]


def rounds_sql() -> str:
    """One assignment and one update a round, spelled out over vectors and centroids as lists."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"n{r} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, c.k, CAST({dist} AS BIGINT) AS d FROM v, c{r} c) GROUP BY r)")
        if r < ROUNDS:
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            mean = f"(SELECT k, list({floor} ORDER BY i) AS x FROM (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, unnest(range(1, 65)) AS i FROM n{r} JOIN v USING (r)) GROUP BY k, i) GROUP BY k)"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN {mean} m ON m.k = c.k)")
    return ",\n".join(steps)


SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS k, x FROM (SELECT *, sha256('2:' || vec_id) AS h FROM v ORDER BY h, vec_id LIMIT {K})),
{rounds_sql()},
t AS (SELECT k, sum(d) AS cluster_inertia FROM n{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(n.k AS INTEGER) AS cluster, d AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM n{ROUNDS}) AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM n{ROUNDS} n JOIN v USING (r) JOIN c{ROUNDS} c ON c.k = n.k JOIN t ON t.k = n.k
"""
