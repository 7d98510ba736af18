"""Writes as one unit: from raw nodes, or recorded events, to all rows that models and log get.

A batch is staged whole before anything is written, and every row of it has an identity that follows from its content. So a run that
failed anywhere is run again from the stage: what was written is left out, what was not is added, and nothing comes twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.nodes import logged_nodes
from ..sources.store import EventLog, LatestTable, stored
from . import graph as G
from . import ingest as I
from . import membership as B

#: The types of events that an import reads of a log: contents, links, and who is in which group.
READ = ("discovered", *B.MEMBERS)
EVENT = ("snapshot_hash", "model_hash", "timestamp", "event_type", "actor", "source", "payload")
# Metadata that becomes columns of the model, and not part of a discovered event's payload.
OF_MODEL = ("owner", "node_type", "tier", "purpose", "model_origin", "source_updated_at")


def json_object(entries: Column) -> Column:
    """A JSON object of a map from keys to JSON texts, in order of keys."""
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def node_content(platform: Column, inputs: Column, outputs: Column, metadata: Column) -> Column:
    """What a node's discovered event says, as a map from keys to canonical JSON texts: platform, ports, and the metadata that isn't
    part of the model; a metadata key that is spelled like one of these takes its place."""
    quoted = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
    port = lambda p: F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.create_map(F.lit("identifier"), p["identifier"]), F.map_filter(p["schema"], lambda k, v: k != "identifier")))))
    ports = lambda side: F.coalesce(F.to_json(F.transform(side, port)), F.lit("[]"))
    own = F.create_map(F.lit("platform"), F.coalesce(quoted(platform), F.lit("null")), F.lit("inputs"), ports(inputs), F.lit("outputs"), ports(outputs))
    more = F.transform_values(F.map_filter(metadata, lambda k, v: ~k.isin(*OF_MODEL)), lambda k, v: F.coalesce(quoted(v), F.lit("null")))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k)), more)


def log_rows(of: DataFrame, *more: str) -> DataFrame:
    """Rows of the log with their identity. of: model_hash, timestamp, event_type, payload, and actor, source and canonical (the
    payload as canonical JSON) if it has them. more: columns of it to carry along."""
    missing = {c: F.lit(None).cast("string") for c in ("actor", "source") if c not in of.columns}
    canonical = F.col("canonical") if "canonical" in of.columns else None
    return of.withColumns({**missing, "snapshot_hash": I.snapshot_hash(F.col("model_hash"), F.col("timestamp"), F.col("payload"), canonical)}).select(*EVENT, *more)


def registered(new: DataFrame) -> DataFrame:
    """The registered events of new models."""
    keys = ("name", "owner", "tier", "purpose", "model_origin")
    canonical = I.text_json(**{k: F.col(k) for k in keys})
    return log_rows(new.select("model_hash", F.col("created_at").alias("timestamp"), F.lit("registered").alias("event_type"), F.to_json(F.struct(*keys)).alias("payload"), "actor", canonical.alias("canonical")))


MODEL = ("model_hash", "name", "owner", "model_type", "tier", "purpose", "model_origin", "status", "created_at", "last_seen")


def ingest(nodes: DataFrame, m: DataFrame, s: DataFrame | Callable[[], DataFrame], connect: bool = True) -> Staged:
    """What a scan's nodes change, as one staged batch.

    nodes: name, platform, inputs, outputs (arrays of identifier and schema), metadata (map), seen_at; several of one name follow
    each other by time. m: MODEL; s: EVENT. A name that m lacks is registered, with owner, type, tier, purpose and origin from its
    first node's metadata; a valid status is taken, the last one stated; last_seen is that of the last node. A node whose
    content is what its model's latest discovered event has adds no event. If any was added, all nodes of the log are
    connected, and links that it lacks get their two events. Own events reach the groups that the models are in. Of s only events
    of the types READ count.
    s may be a function that gives the log: it is read when events or counts are.
    """
    meta = lambda *keys, default: F.coalesce(*[F.nullif(F.element_at("metadata", k), F.lit("")) for k in keys], F.lit(default))
    rows = nodes.select(
        "name", "platform", F.col("seen_at").alias("timestamp"), F.when(F.coalesce("platform", F.lit("")) != "", F.concat(F.lit("connector:"), "platform")).otherwise("system").alias("actor"), node_content(F.col("platform"), F.col("inputs"), F.col("outputs"), F.col("metadata")).alias("content"),
        I.normal_status(F.element_at("metadata", "status")).alias("stated"), meta("owner", default="unknown").alias("owner"), meta("model_type", "node_type", "type", default="unknown").alias("model_type"),
        meta("tier", default="unclassified").alias("tier"), meta("purpose", default="").alias("purpose"), meta("model_origin", default="internal").alias("model_origin"),
        F.element_at("metadata", "source_updated_at").alias("occurred"),
    )
    # Nodes of one name and time follow each other by a hash of all that they say: so what finds the first and last carries no content.
    told = F.xxhash64(json_object(F.col("content")), *[c for c in rows.columns if c not in ("name", "timestamp", "content")])
    rows = stored(rows.withColumn("told", told), "nodes")
    order = F.struct("timestamp", "told")
    about = ("owner", "model_type", "tier", "purpose", "model_origin", "actor")
    each = rows.groupBy("name").agg(
        F.min_by(F.struct(*about, F.col("timestamp").alias("created_at")), order).alias("of"), F.max("timestamp").alias("seen"), F.max_by("stated", F.when(F.col("stated").isNotNull(), order)).alias("stated"), F.max_by("platform", order).alias("platform")
    )
    old = m.select("name", F.struct(*[c for c in MODEL if c != "name"]).alias("old"))
    both = each.join(old, "name", "left")
    value = lambda c: F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"of.{c}")).alias(c)
    fresh_hash = I.model_hash(F.col("name"), F.col("of.owner"), F.col("of.created_at"))
    models = both.select(
        F.coalesce("old.model_hash", fresh_hash).alias("model_hash"), "name", *[value(c) for c in ("owner", "model_type", "tier", "purpose", "model_origin")], F.coalesce("stated", "old.status", F.lit("active")).alias("status"),
        value("created_at"), F.col("seen").alias("last_seen"), F.col("old").isNull().alias("is_new"), F.col("of.actor").alias("actor"), "platform",
    )
    models = stored(models, "models")

    return Staged(rows, models, m, s, connect)


class Staged:
    """models: the rows of all models that the batch touches; summaries: name, owner, model_type, platform, status, a row a model of
    the batch; events: rows for the log; counts: models_added, models_skipped, links_created, links_skipped (one row). Nodes and
    models are stored at once, what follows from the log when it is first asked for: who wants models only reads no log."""

    def __init__(self, rows: DataFrame, touched: DataFrame, m: DataFrame, s: DataFrame | Callable[[], DataFrame], connect: bool):
        self.rows, self.touched, self.m, self.s, self.connect = rows, touched, m, s, connect
        self.models = touched.select(*MODEL)
        self.summaries = touched.select("name", "owner", "model_type", "platform", "status")

    @cached_property
    def log(self) -> DataFrame:
        return self.s() if callable(self.s) else self.s

    @cached_property
    def names(self) -> DataFrame:
        return self.m.select("model_hash", "name").unionByName(self.touched.where("is_new").select("model_hash", "name"))

    @cached_property
    def judged(self) -> DataFrame:
        """A row a node: is_new, and its discovered event, which just new ones have a payload for. Contents go through one shuffle."""
        before = I.latest_content(self.log.where("event_type = 'discovered'").join(self.touched.where("NOT is_new").select("model_hash"), "model_hash", "left_semi"))
        found = self.rows.join(self.touched.select("name", "model_hash").join(before, "model_hash", "left"), "name")
        found = found.withColumn("content_hash", F.sha2(json_object(F.map_filter("content", lambda k, v: ~k.isin(*I.VOLATILE))), 256))
        previous = F.coalesce(F.lag("content_hash").over(Window.partitionBy("name", "model_hash").orderBy("timestamp", "told")), "before")
        extra = {"_content_hash": F.col("content_hash"), "change_detected": I.iso(F.col("timestamp")), "change_occurred": F.col("occurred")}
        more = F.map_filter(F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1))]), lambda k, v: v != "null")
        full = json_object(F.map_concat(F.map_filter("content", lambda k, v: ~F.map_contains_key(more, k)), more))
        rows = found.withColumn("is_new", ~F.col("content_hash").eqNullSafe(previous)).withColumn("payload", F.when(F.col("is_new"), full))
        events = log_rows(rows.select("model_hash", "timestamp", F.lit("discovered").alias("event_type"), "payload", "actor", F.col("platform").alias("source"), F.col("payload").alias("canonical"), "is_new"), "is_new")
        return stored(events, "judged")

    @cached_property
    def discovered(self) -> DataFrame:
        return self.judged.where("is_new").select(*EVENT)

    @cached_property
    def known(self) -> DataFrame:
        return stored(B.named(self.names), "known")

    @cached_property
    def links(self) -> tuple[DataFrame, DataFrame] | None:
        """What connecting gives, if any content was added."""
        if not self.connect or self.discovered.isEmpty():
            return None
        return G.connect(self.nodes, G.linked_names(self.log, self.names, self.known), at_hand=True)

    @cached_property
    def nodes(self) -> DataFrame:
        """The nodes of the log and the batch."""
        return stored(logged_nodes(self.log.select(*EVENT).unionByName(self.discovered), self.names).select("name", "inputs", "outputs"), "nodes")

    @cached_property
    def sources(self) -> DataFrame | None:
        """What is known of the nodes with outputs, if these are few."""
        mine = stored(self.nodes.where("size(outputs) > 0").select(F.col("name").alias("key")).distinct(), "sources")
        return self.known.join(mine, "key", "left_semi") if mine.count() <= G.WIDE else None

    @cached_property
    def events(self) -> DataFrame:
        new = registered(self.touched.where("is_new")).unionByName(self.discovered)
        if self.links:
            at = self.rows.agg(F.max("timestamp").alias("timestamp"))
            new = new.unionByName(log_rows(B.link_rows(self.links[0], self.names, "data_flow", "identifier", self.known, self.sources).crossJoin(F.broadcast(at)).withColumn("actor", F.lit("graph_builder"))))
        # Of a batch's own events only discovered ones reach groups: registrations and links are internal.
        changed = B.change_events(self.discovered, B.membership(self.log, self.m), self.names)
        return new.unionByName(changed.withColumn("source", F.lit(None).cast("string")).select(*EVENT))

    @cached_property
    def counts(self) -> DataFrame:
        linked = self.links[1] if self.links else self.m.sparkSession.range(1).select(F.lit(0).cast("long").alias("links_created"), F.lit(0).cast("long").alias("links_skipped"))
        return self.judged.agg(F.count_if("is_new").alias("models_added"), F.count_if(~F.col("is_new")).alias("models_skipped")).crossJoin(F.broadcast(linked))


class Recorded(NamedTuple):
    """models: new ones; events: rows for the log; told: model_name, model_hash, event_id, timestamp, is_new_model, a row an
    event; errors: model_name, of events whose model doesn't exist."""

    models: DataFrame
    events: DataFrame
    told: DataFrame
    errors: DataFrame


def record(asked: DataFrame, m: DataFrame, s: DataFrame) -> Recorded:
    """What recording events changes. asked: model_name, event, payload (JSON), actor, timestamp, owner, model_type, purpose.

    An event "registered" registers a name that m lacks (of several the first; the log gets one registered event with it, and
    the payload of a model that exists is appended as it is). Other events belong to models that exist or that the batch
    registers by then; without one they are errors. They reach the groups that their models are in."""
    first = F.row_number().over(Window.partitionBy("model_name").orderBy("timestamp", "payload"))
    news = asked.where("event = 'registered'").withColumn("rn", first).where("rn = 1").join(m.select(F.col("name").alias("model_name")), "model_name", "left_anti")
    made = news.select(
        F.col("model_name").alias("name"), F.coalesce("owner", F.lit("unknown")).alias("owner"), F.coalesce("model_type", F.lit("unknown")).alias("model_type"), F.lit("unclassified").alias("tier"), F.coalesce("purpose", F.lit("")).alias("purpose"),
        F.lit("internal").alias("model_origin"), F.lit("active").alias("status"), F.col("timestamp").alias("created_at"), F.col("timestamp").alias("last_seen"), "actor",
    )
    made = stored(made.withColumn("model_hash", I.model_hash(F.col("name"), F.col("owner"), F.col("created_at"))), "made")
    known = m.select("name", "model_hash", F.lit(None).cast("timestamp_ntz").alias("born")).unionByName(made.select("name", "model_hash", F.col("created_at").alias("born")))
    joined = asked.join(known.withColumnRenamed("name", "model_name"), "model_name", "left").withColumn("new", (F.col("event") == "registered") & F.col("born").isNotNull())
    fits = F.col("model_hash").isNotNull() & (F.col("born").isNull() | (F.col("born") <= F.col("timestamp")))
    # Of the rows that register a new name only the first is an event; the registered event has its model's own payload.
    mine = joined.where(fits).withColumn("rn", F.when(F.col("new"), F.row_number().over(Window.partitionBy("model_name", "new").orderBy("timestamp", "payload"))))
    mine = mine.withColumn("is_new_model", F.coalesce(F.col("rn") == 1, F.lit(False)))
    own = registered(made)
    rest = mine.where("NOT is_new_model").select("model_hash", "timestamp", F.col("event").alias("event_type"), "payload", "actor", "model_name", "is_new_model")
    rest = rest.withColumn("snapshot_hash", I.snapshot_hash(F.col("model_hash"), F.col("timestamp"), F.col("payload"))).withColumn("source", F.lit(None).cast("string"))
    new = stored(own.unionByName(rest.select(*EVENT)), "events")
    names = m.select("model_hash", "name").unionByName(made.select("model_hash", "name"))
    changed = B.change_events(new, B.membership(s, m), names).withColumn("source", F.lit(None).cast("string")).select(*EVENT)
    told = rest.select("model_name", "model_hash", F.col("snapshot_hash").alias("event_id"), "timestamp", "is_new_model").unionByName(
        own.join(made.select("model_hash", F.col("name").alias("model_name")), "model_hash").select("model_name", "model_hash", F.col("snapshot_hash").alias("event_id"), "timestamp", F.lit(True).alias("is_new_model")))
    return Recorded(made.select(*MODEL), new.unionByName(changed), told, joined.where(~fits).select("model_name"))


def register_groups(asked: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new models, events) of groups and their members: get or create each group by name, then link its members to it.

    asked: name, owner, model_type, tier, purpose, members (names or hashes, of models or of groups of the batch), actor, timestamp;
    of several of one name the first registers, all link. Members that don't exist give no link."""
    order = F.struct("timestamp", "owner", "actor")
    first = asked.groupBy("name").agg(F.min_by(F.struct("owner", "model_type", "tier", "purpose", "actor", F.col("timestamp").alias("created_at")), order).alias("of")).select("name", "of.*")
    new = first.join(m.select("name"), "name", "left_anti").withColumns({"model_origin": F.lit("internal"), "status": F.lit("active"), "last_seen": F.col("created_at")})
    new = stored(new.withColumn("model_hash", I.model_hash(F.col("name"), F.col("owner"), F.col("created_at"))), "groups")
    known = m.select("model_hash", "name").unionByName(new.select("model_hash", "name"))
    pairs = asked.select("name", F.explode("members").alias("member"), "actor", "timestamp")
    links = linked(pairs.withColumnsRenamed({"name": "downstream", "member": "upstream"}), known)
    return new.select(*MODEL), registered(new).unionByName(links)


def linked(pairs: DataFrame, m: DataFrame) -> DataFrame:
    """Both events of member_of links: pairs of upstream, downstream, actor, timestamp."""
    events = B.link_events(pairs.withColumn("said", F.concat_ws("\0", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "actor")), m, "member_of", "said")
    said = F.from_json("payload", "via string")["via"]
    rows = events.withColumns({"timestamp": F.split_part(said, F.lit("\0"), F.lit(1)).cast("timestamp_ntz"), "actor": F.split_part(said, F.lit("\0"), F.lit(2))})
    return log_rows(rows.withColumn("payload", F.concat(F.regexp_replace("payload", r',"via":"(?:[^"\\]|\\.)*"\}$', ""), F.lit("}"))))


def change_members(asked: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of additions and removals: asked: composite, member (names or hashes), removed (boolean), note (role of an
    addition, reason of a removal, or null), actor, timestamp. An addition also links the member; a removal leaves links as they
    are. Rows whose composite or member doesn't exist are errors."""
    known = B.names(m).join(m.select(F.col("model_hash").alias("found"), "name"), "found")
    end = lambda c: known.select(F.col("key").alias(c), F.struct(F.col("found").alias("hash"), "name").alias(f"__{c}"))
    both = stored(asked.join(end("composite"), "composite", "left").join(end("member"), "member", "left"), "asked")
    fits = F.col("__composite").isNotNull() & F.col("__member").isNotNull()
    good = both.where(fits)
    gone = F.col("removed")
    payload = F.to_json(F.struct(F.col("__member.name").alias("member_name"), F.col("__member.hash").alias("member_hash"), F.when(~gone, F.col("note")).alias("role"), F.when(gone, F.col("note")).alias("reason")))
    own = log_rows(good.select(F.col("__composite.hash").alias("model_hash"), "timestamp", F.when(gone, "member_removed").otherwise("member_added").alias("event_type"), payload.alias("payload"), "actor"))
    links = linked(good.where(~gone).select(F.col("__member.hash").alias("upstream"), F.col("__composite.hash").alias("downstream"), "actor", "timestamp"), m)
    return own.unionByName(links), both.where(~fits).select(*asked.columns)


def register_audited(asked: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new models, audit events) of models by name: those that m has are left as they are; of several of one name the first counts.
    asked: name, tier, actor, timestamp and any other columns, which the model keeps. Audit: event_id, timestamp, actor, action,
    model_name, details (JSON)."""
    rest = [c for c in asked.columns if c not in ("name", "timestamp")]
    new = asked.groupBy("name").agg(F.min(F.struct("timestamp", *rest)).alias("of")).select("name", "of.*").join(m.select("name"), "name", "left_anti")
    details = F.to_json(F.struct("tier"))
    event = new.select("timestamp", "actor", F.lit("registered_model").alias("action"), F.col("name").alias("model_name"), details.alias("details"))
    return new.drop("actor"), event.withColumn("event_id", F.sha2(F.concat_ws(":", "action", "model_name", I.iso(F.col("timestamp"))), 256))


def write(staged: Staged | Recorded, log: EventLog, models: LatestTable, stage: str) -> tuple[DataFrame, DataFrame]:
    """Write a batch, events first: (models, events) as they were staged in the folder `stage`, which names the batch. A batch
    that is staged already is written from there, whatever the tables hold by now; the log leaves out what it has, and rows of
    models that come twice are one by version."""
    spark = log.spark
    for name, df in (("models", staged.models), ("events", staged.events)):
        if not there(spark, f"{stage}/{name}/_SUCCESS"):
            df.write.mode("overwrite").parquet(f"{stage}/{name}")
    rows = {name: spark.read.schema(df.schema).parquet(f"{stage}/{name}") for name, df in (("models", staged.models), ("events", staged.events))}
    log.append(rows["events"])
    models.put(rows["models"])
    return rows["models"], rows["events"]


def there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def nodes_of(sources: dict[str, DataFrame], platform: str | None = None) -> DataFrame:
    """The nodes of all sources, or of one platform's; an unknown platform raises a ValueError."""
    if platform is not None and platform not in sources:
        raise ValueError(f"unknown platform {platform}; there are {', '.join(sorted(sources))}")
    first, *rest = [sources[platform]] if platform is not None else sources.values()
    for other in rest:
        first = first.unionByName(other)
    return first
