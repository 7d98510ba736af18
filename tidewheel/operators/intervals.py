"""Validity intervals of membership, and the join that finds which of them hold at given times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .membership import KEYS, names

#: Seconds of the finest blocks of time; each level's blocks are twice as long as those of the one before.
FINEST = 3600


def membership_intervals(s: DataFrame, m: DataFrame) -> DataFrame:
    """group_hash, member_hash, since, until: when each member was one, until excluded, null for now. At any time it gives what
    membership gives: the latest operation of a pair decides, and before the first one a link.

    s: snapshot_hash, model_hash, timestamp, event_type, payload. One sort a pair of group and member.
    """
    at = F.col("event_type")
    e = s.where(at.isin("depends_on", "member_added", "member_removed")).select("snapshot_hash", F.col("model_hash").alias("group_hash"), "timestamp", "event_type", F.from_json("payload", KEYS).alias("p"))
    e = e.where((at != "depends_on") | (F.col("p.relationship") == "member_of"))
    link = at == "depends_on"
    refs = F.when(link, F.array("p.upstream_hash")).when(at == "member_added", F.array("p.member_hash", "p.member_name")).otherwise(F.array(F.lit(None).cast("string")))
    each = e.withColumn("ref", F.explode(refs)).withColumn("ref", F.coalesce("ref", F.concat(F.lit("\0"), "snapshot_hash")))  # none is hot
    known = each.join(names(m).withColumnRenamed("key", "ref"), "ref", "left").where((at == "member_removed") | F.col("found").isNotNull())
    member = F.when(link, F.col("found")).otherwise(F.coalesce("p.member_hash", F.lit("")))
    ops = known.select("group_hash", member.alias("member_hash"), "timestamp", "snapshot_hash", link.alias("link"), (at != "member_removed").alias("isin")).distinct()
    pair = Window.partitionBy("group_hash", "member_hash")
    order = pair.orderBy("timestamp", "snapshot_hash")
    # Of links, the first counts, and only while no operation has come before it or with it.
    first_op = F.min(F.when(~F.col("link"), F.col("timestamp"))).over(pair)
    first_link = F.min(F.when(F.col("link"), F.struct("timestamp", "snapshot_hash"))).over(pair)
    marked = ops.withColumns({"first_op": first_op, "first_link": first_link})
    kept = marked.where(~F.col("link") | ((F.struct("timestamp", "snapshot_hash") == F.col("first_link")) & (F.col("first_op").isNull() | (F.col("timestamp") < F.col("first_op")))))
    spans = kept.withColumn("until", F.lead("timestamp").over(order)).where("isin AND (until IS NULL OR until > timestamp)")
    return spans.select("group_hash", "member_hash", F.col("timestamp").alias("since"), "until")


def holding(points: DataFrame, spans: DataFrame, key: str, at: str = "at", since: str = "since", until: str = "until") -> DataFrame:
    """points joined to the spans of their key that hold at their time: since <= at < until, where a null until never ends.

    A range join by equality. A span lies in at most two blocks of the level whose blocks are as long as itself, or longer by less
    than twice; a point looks into its block of each level that has spans. So a key with very many points and spans meets
    in many small groups, and what meets holds with a fair chance. Spans without an end are looked up by key, in order of their
    beginning. No null key or time meets anything. The levels in use are few (the logarithm of the longest span).
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    unit = FINEST * 1_000_000
    closed = spans.where(F.col(until).isNotNull())
    length = seconds(until) - seconds(since)
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / unit))).cast("int")
    block = lambda micros, lv: F.floor(micros / (F.lit(unit) * F.pow(F.lit(2), lv))).cast("long")
    placed = closed.withColumn("__level", level)
    placed = placed.withColumn("__block", F.explode(F.array_distinct(F.array(block(seconds(since), F.col("__level")), block(seconds(until) - 1, F.col("__level"))))))
    levels = sorted(r[0] for r in closed.select(level.alias("l")).distinct().collect() if r[0] is not None)  # as many as doublings of an hour
    holds = (F.col(since) <= F.col(at)) & (F.col(until).isNull() | (F.col(at) < F.col(until)))
    asked = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.expr("CAST(array() AS ARRAY<INT>)")))
    asked = asked.withColumn("__block", block(seconds(at), F.col("__level")))
    ended = asked.join(placed, [key, "__level", "__block"]).where(holds).drop("__level", "__block")
    return ended.unionByName(points.join(spans.where(F.col(until).isNull()), key).where(holds))


def page_as_of(m: DataFrame, s: DataFrame, members: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of asked(model_hash, at) with what the model's page showed then: total_events, last_event, groups, members, upstream,
    downstream (names, sorted), up to and including `at`; a model created later has none of it and `existed` false.

    s: model_hash, timestamp; members: as membership_intervals gives it; links: model_hash, direction, other_hash, timestamp.
    """
    asked, members = stored(asked.distinct(), "asked"), stored(members, "spans")
    named = m.select(F.col("model_hash").alias("other"), F.col("name").alias("other_name"))
    by = ["model_hash", "at"]

    def listed(found: DataFrame, other: str, name: str) -> DataFrame:
        return found.select(*by, F.col(other).alias("other")).join(named, "other").groupBy(*by).agg(F.sort_array(F.collect_set("other_name")).alias(name))

    groups = holding(asked, members.withColumnRenamed("member_hash", "model_hash"), "model_hash")
    inside = holding(asked, members.withColumnRenamed("group_hash", "model_hash"), "model_hash")
    first = links.groupBy("model_hash", "direction", "other_hash").agg(F.min("timestamp").alias("since")).withColumn("until", F.lit(None).cast("timestamp_ntz"))
    first = stored(first, "links")
    linked = holding(asked, first, "model_hash")
    # Requests run along in the model's log: what came before them is counted on the way.
    along = s.select("model_hash", F.col("timestamp").alias("at"), F.lit(0).alias("asks")).unionByName(asked.withColumn("asks", F.lit(1)))
    before = Window.partitionBy("model_hash").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.when(F.col("asks") == 0, F.col("at"))
    counts = along.select(*by, "asks", F.count(event).over(before).alias("total_events"), F.max(event).over(before).alias("last_event")).where("asks = 1").drop("asks")
    out = asked.join(m.select("model_hash", "name", "created_at"), "model_hash").join(counts, by)
    parts = [listed(groups, "group_hash", "groups"), listed(inside, "member_hash", "members"), *(listed(linked.where(F.col("direction") == d), "other_hash", d) for d in ("upstream", "downstream"))]
    for part in parts:
        out = out.join(part, by, "left")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return out.select(*by, "name", (F.col("created_at") <= F.col("at")).alias("existed"), "total_events", "last_event", *[F.coalesce(c, none).alias(c) for c in ("groups", "members", "upstream", "downstream")])
