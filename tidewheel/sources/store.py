"""Parquet tables of the engine: an append-only event log, and append logs of mutable rows read as latest by key."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one for this session, if all of it runs on one machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidewheel-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/tidewheel/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the sources that go to one bucket, about.
BUCKET_BYTES = 32 << 20
#: Tables that materialized() made in this process, by application, label and state of the sources.
_made: dict[tuple[str, str, str], str] = {}


def materialized(spark: SparkSession, label: str, sources: list[str], make: Callable[[], DataFrame], bucket: str, sort: list[str], parts: list[str] | None = None) -> DataFrame:
    """The rows of make(), stored once as long as the files of `sources` stay as they are: bucketed by a column and sorted, so that
    groupings and joins by it need no shuffle, and in partitions. Buckets are as many as the cluster's cores, or as the sources have
    pieces of BUCKET_BYTES, but not more than the session's shuffle partitions."""
    found = [listing(spark, x) for x in sources]
    state = hashlib.sha256(repr(found).encode()).hexdigest()[:16]
    key = (spark.sparkContext.applicationId, label, state)
    if key not in _made:
        pieces = -(-sum(size for files in found for _, size, _ in files) // BUCKET_BYTES)
        n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, pieces)))
        name = f"tidewheel_{label}_{uuid.uuid4().hex}"
        out = make().repartition(n, bucket).write.bucketBy(n, bucket).sortBy(*sort).option("path", f"{shared_dir(spark)}/tidewheel/{name}")
        (out.partitionBy(*parts) if parts else out).saveAsTable(name)
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
        _made[key] = name
    return spark.table(_made[key])


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of each file under a path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its row numbers in that order, from 1: numbers within the ranges of a distributed sort, after the counts of
    the ranges before (one row a partition)."""
    rows = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.withColumn(name, within).join(F.broadcast(before), "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__before")


class EventLog:
    """Events as Parquet, by event_type and day, so that queries about a few types or days read just these.

    snapshot_hash identifies an event with its time, so a repeated one has the day of the first: an append looks for the keys of its
    batch in the days of its batch alone, however long the log is, and finds late events too. Within a day, files have Bloom
    filters on snapshot_hash and model_hash, and rows are sorted by model.
    """

    KEYS = ("snapshot_hash", "event_type")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("day")

    def between(self, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """Events within closed bounds of time: only their days are read."""
        rows = self.spark.read.parquet(self.path)
        for bound, test in ((since, lambda c, x: c >= x), (until, lambda c, x: c <= x)):
            if bound is not None:
                rows = rows.where(test(F.col("timestamp"), bound)).where(test(F.col("day"), day(bound)))
        return rows.drop("day")

    def known(self, batch: DataFrame) -> DataFrame:
        """The keys that the log has in the types and days of batch(snapshot_hash, event_type, day)."""
        parts = batch.select("event_type", "day").distinct()
        rows = self.spark.read.parquet(self.path)
        return rows.join(F.broadcast(parts), ["event_type", "day"], "left_semi").select(*self.KEYS)  # days of a batch: pruned at run time

    def append(self, events: DataFrame) -> None:
        """Events whose (snapshot_hash, event_type) the log has are left out; of several in the batch the first in order of all their
        columns stays. One writer at a time: two that append at once may both add an event that is new to both."""
        rest = [c for c in events.columns if c not in self.KEYS]
        one = events.groupBy(*self.KEYS).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("of")).select(*self.KEYS, "of.*")
        new = stored(one.withColumn("day", day(F.col("timestamp"))), "batch")
        if self.exists():
            new = stored(new.join(self.known(new), list(self.KEYS), "left_anti"), "append")
        if new.isEmpty():  # a folder without files has no schema
            return
        rows = new.sortWithinPartitions("event_type", "day", "model_hash", "timestamp").write.mode("append").partitionBy("event_type", "day")
        for column in ("snapshot_hash", "model_hash"):
            rows = rows.option(f"parquet.bloom.filter.enabled#{column}", "true")
        rows.parquet(self.path)


def day(at: Column) -> Column:
    """The partition of a time: its day, in UTC."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd")


class LatestTable:
    """Mutable rows as an append log: the current row of a key is the one with the greatest `version`; of equal versions
    the one with the greatest other columns, in their order."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str):
        self.spark, self.path, self.keys, self.version = spark, path, keys, version

    def put(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        rest = [c for c, kind in rows.dtypes if c not in (*self.keys, self.version) and not kind.startswith(("map", "variant"))]
        w = Window.partitionBy(*self.keys).orderBy(F.desc(self.version), *[F.desc(c) for c in rest])
        return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
