"""Helpers that the training-data operators share: table access, scratch tables in the cluster's shared folder,
joins that survive hot keys, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than half of the rows of a mean partition, and more than this many.
HOT_LEAST = 1000

#: Rows of a file of a scratch table, about, where their number is known.
FILE_ROWS = 50_000

#: Where the paths of scratch tables are noted down, if anybody wants to delete them; see collecting().
_noted: ContextVar[list[str] | None] = ContextVar("_noted", default=None)


def shipped(spark: SparkSession) -> SparkSession:
    """spark, with this package sent to the executors, once a session, for the Python functions that run there."""
    if getattr(spark.sparkContext, "_tidewheel", None) is None:
        folder = tempfile.mkdtemp(prefix="tidewheel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package = Path(__file__).parent.parent
        with zipfile.ZipFile(f"{folder}/tidewheel.zip", "w") as z:
            for path in package.rglob("*.py"):
                z.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(f"{folder}/tidewheel.zip")
        spark.sparkContext._tidewheel = folder
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset and all runs on one machine, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not (now := context.getCheckpointDir()):
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            made = tempfile.mkdtemp(prefix="tidewheel-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            context.setCheckpointDir(f"file://{made}")
            now = context.getCheckpointDir()
        found = now
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidewheel/{label}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return path


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later stages no longer depend on its lineage, and
    lost executors cost nothing that was finished. rows: how many there are at most, for as many files, and tasks, as they
    need; not for what has much to do or to read for each row."""
    path = scratch_path(df.sparkSession, label)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Scratch tables that are written meanwhile are noted in paths, for release()."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables, for a caller that has stored what was made of them; others' tables are left alone."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name = f"__{stem}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def columns(df: DataFrame, **of: Column | str) -> DataFrame:
    """Just the named columns: columns that happen to bear the names an operator uses inside cannot clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in of.items()])


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """left joined to right, where right has one row a key and in `count` how many rows of left have that key.

    Keys with more rows than half a mean partition (at most two a partition) are looked up in a broadcast table, and
    their rows, like those without a key, are dealt by all their columns in the join by shuffle that serves the other
    keys: so a key with a third of all rows never comes to one task. how: left, inner or left_semi.
    """
    limit = max(HOT_LEAST, total // (2 * partitions(left.sparkSession)))
    own = [c for c in right.columns if c not in (key, count)]
    hot = right.where(F.col(count) > limit).select(key, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in own])
    cold = right.where(F.col(count) <= limit).select(key, F.lit(0).cast("long").alias("__salt"), F.lit(True).alias("__cold"), *[F.col(c).alias(f"__cold_{c}") for c in own])
    plain = [c for c, t in left.dtypes if t not in ("binary", "variant") and not t.startswith(("map", "array", "struct"))]
    salt = F.when(F.col("__hot") | F.col(key).isNull(), F.xxhash64(*plain).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    both = left.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).join(cold, [key, "__salt"], "left")
    if how != "left":
        both = both.where(F.coalesce("__hot", "__cold"))
    return both.select(*left.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in own if how != "left_semi"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of the undirected graph edges(a long, b long): node, root, for nodes that have an edge.

    Contracts the graph round by round: every node points to its least neighbour, pointers are followed to their
    end, and the edges are rewritten between the ends until none is left. Each round at least halves the nodes that
    still have edges, and is written to the shared folder. Nothing but two counts a round comes to the driver. root
    is the least node by signed order among those that became a root: an arbitrary but fixed member of the component.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = edges.count()
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges", n)
    nodes = None
    while not edges.isEmpty():
        up = both(edges).groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("up"))
        up = written(up, f"{label}-up", 2 * n)
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(up.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), f"{label}-jump", 2 * n)
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        to = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))
        left = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = written(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges", n)
        if nodes is None:
            nodes = up.select("node", F.col("up").alias("root"))
        else:
            over = up.select(F.col("node").alias("root"), "up")
            nodes = written(nodes.join(over, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{label}-nodes", 2 * n)
    if nodes is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes

