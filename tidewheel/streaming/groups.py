"""Groups followed as their events arrive: state for members, observations and validations, and for who hears of whom.

Facts of groups are an aggregation over the stream, with a key for each single fact, so that a group with very many members is
spread like any other; who hears of whom is keyed state with Python's code. Both queries give
what a batch over the whole log gives, in whatever order and batches events arrive, and go on from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.membership import KEYS, MEMBER, MEMBERS, OBSERVATIONS, OPEN, change_rows, facts, names
from ..sources.store import EventLog
from ..tables import INTERNAL_EVENTS

#: Times in keyed state are microseconds.
TURN = "group_hash string, kind string, key string, active boolean, at long"
HEARS = "linked boolean, op_at long, op_hash string, added boolean"
RAISED = "group_hash string, member_hash string, cause string, cause_hash string, at long, actor string"


def ready(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def micros() -> Column:
    return F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at")


def governance(events: DataFrame, m: DataFrame) -> DataFrame:
    """group_hash, kind, key, op, at (microseconds), snapshot_hash: the governance events of groups with their references looked up in the
    models m; what batch membership leaves out is left out. events: snapshot_hash, model_hash, timestamp, event_type, payload."""
    p = F.from_json("payload", KEYS)
    kind = F.col("event_type")
    own = events.where(kind.isin(*MEMBERS, *OBSERVATIONS, "validated")).select("snapshot_hash", F.col("model_hash").alias("group_hash"), "timestamp", kind.alias("op"), p.alias("p"))
    op = F.col("op")
    own = own.where((op != "depends_on") | (F.col("p.relationship") == "member_of"))
    refs = F.when(op == "depends_on", F.array("p.upstream_hash")).when(op == "member_added", F.array("p.member_hash", "p.member_name")).otherwise(F.array(F.lit(None).cast("string")))
    each = own.select("*", F.explode(refs).alias("ref")).withColumn("ref", F.coalesce("ref", F.concat(F.lit("\0"), "snapshot_hash")))
    found = each.join(names(m).withColumnRenamed("key", "ref"), "ref", "left").where(~op.isin("depends_on", "member_added") | F.col("found").isNotNull())
    observed = op.isin(*OBSERVATIONS)
    key = F.when(op == "depends_on", F.col("found")).when(observed, F.col("p.observation_id")).when(op == "validated", "").otherwise(F.coalesce("p.member_hash", F.lit("")))
    rows = found.select("group_hash", F.when(observed, "observation").when(op == "validated", "validated").otherwise("member").alias("kind"), key.alias("key"), "op", micros(), "snapshot_hash")
    return rows.where("kind <> 'observation' OR coalesce(key, '') <> ''")


def later(state: list, op: Row) -> list:
    """Membership (linked, op_at, op_hash, added) after one more operation: the latest counts, a link before all others."""
    linked, at, tie, added = state
    if op.op == "depends_on":
        return [True, at, tie, added]
    if at is None or (op.at, op.snapshot_hash) > (at, tie):
        return [linked, op.at, op.snapshot_hash, op.op == "member_added"]
    return state


def belongs(state: list) -> bool:
    linked, at, _, added = state
    return bool(linked if at is None else added)


def follow(events: DataFrame, m: DataFrame, path: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Keep the facts of groups current at `path`: each batch adds the facts that it touched, as a folder of its own that a batch run
    again replaces. Read them with current(). The facts are the batch's own (membership.facts): Spark's aggregation over the stream
    keeps them. known: names(m), if it is at hand."""
    ready(events.sparkSession)
    active = F.when(F.col("kind") == "member", F.expr(MEMBER)).when(F.col("kind") == "observation", F.expr(OPEN)).otherwise(True)
    at = F.unix_micros(F.col("at").cast("timestamp"))
    touched = facts(events, m, known=known).select("group_hash", "kind", "key", F.coalesce(active, F.lit(False)).alias("active"), at.alias("at"))

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return touched.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(keep).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """group_hash, kind, key, at of the facts that hold: members, open observations, and the last validation (key "")."""
    rows = spark.read.schema(f"{TURN}, batch long").parquet(path)
    last = F.row_number().over(Window.partitionBy("group_hash", "kind", "key").orderBy(F.desc("batch")))
    return rows.withColumn("__rn", last).where("__rn = 1 AND active").select("group_hash", "kind", "key", F.timestamp_micros("at").alias("at"))


def standing(spark: SparkSession, path: str) -> DataFrame:
    """group_hash, member_count, open_observation_count, last_validated of every group with a fact that holds."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return current(spark, path).groupBy("group_hash").agg(count("member").alias("member_count"), count("observation").alias("open_observation_count"), F.max(F.when(F.col("kind") == "validated", F.col("at"))).alias("last_validated"))


class Hearers(StatefulProcessor):
    """Which groups hear of a model. Within a batch its membership is settled first; then its own events reach the groups."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.groups = handle.getMapState("groups", "group_hash string", HEARS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        own: list[tuple[str, str, int, str]] = []
        for r in rows:
            if r.group_hash is None:
                own.append((r.op, r.snapshot_hash, r.at, r.actor))
                continue
            group = (r.group_hash,)
            state = list(self.groups.getValue(group)) if self.groups.containsKey(group) else [False, None, None, None]
            self.groups.updateValue(group, tuple(later(state, r)))
        if own:
            hear = [g[0] for g, state in self.groups.iterator() if belongs(list(state))]
            for cause, cause_hash, at, actor in own:
                for group in hear:
                    yield Row(group_hash=group, member_hash=key[0], cause=cause, cause_hash=cause_hash, at=at, actor=actor)

    def close(self) -> None:
        pass


def propagate(events: DataFrame, m: DataFrame, log: EventLog, checkpoint: str) -> StreamingQuery:
    """Append the member_changed events that models' own events raise in the groups that they are in when they arrive. Membership
    follows the same stream, so a member added on the way is heard of from then on; a batch run again adds nothing twice.

    events: snapshot_hash, model_hash, timestamp, event_type, actor, payload. A model's own events of one batch are held in memory
    while its membership is settled: bound them by the source's limits on a batch.
    """
    ready(events.sparkSession)
    none = F.lit(None).cast("string")
    moves = governance(events, m).where("kind = 'member'").select(F.col("key").alias("model_hash"), "group_hash", "op", "snapshot_hash", "at", none.alias("actor"))
    own = events.where(~F.col("event_type").isin(*INTERNAL_EVENTS)).select("model_hash", none.alias("group_hash"), F.col("event_type").alias("op"), "snapshot_hash", micros(), "actor")
    raised = moves.unionByName(own).groupBy("model_hash").transformWithState(Hearers(), RAISED, "Append", "None")
    named = raised.withColumn("timestamp", F.timestamp_micros("at")).join(m.select(F.col("model_hash").alias("member_hash"), F.col("name").alias("member_name")), "member_hash")
    return change_rows(named).writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).foreachBatch(lambda df, _: log.append(df)).start()
