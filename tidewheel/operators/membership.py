"""Groups and their members, replayed from the log as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from ..tables import INTERNAL_EVENTS
from .ingest import snapshot_text, text_hash, text_json

MEMBERS = ("depends_on", "member_added", "member_removed")
OBSERVATIONS = ("observation_issued", "observation_resolved")
#: The keys of payloads that governance reads.
KEYS = "relationship string, upstream_hash string, downstream_hash string, member_hash string, member_name string, observation_id string"


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key, ties by snapshot_hash. Spark keeps one row a key before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc("snapshot_hash"))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def names(m: DataFrame) -> DataFrame:
    """key, found: the model that a reference means, by hash if one has it, else by name."""
    return m.sparkSession.sql("""SELECT key, min(struct(order, model_hash)).model_hash AS found FROM (
      SELECT model_hash AS key, 0 AS order, model_hash FROM {m} UNION ALL SELECT name, 1, model_hash FROM {m}) WHERE key IS NOT NULL GROUP BY key""", m=m)


def named(m: DataFrame) -> DataFrame:
    """key, found, name: names(m), and what the model found is called."""
    return m.sparkSession.sql("""SELECT key, of.model_hash AS found, of.name AS name FROM (SELECT key, min(struct(order, model_hash, name)) AS of FROM (
      SELECT model_hash AS key, 0 AS order, model_hash, name FROM {m} UNION ALL SELECT name, 1, model_hash, name FROM {m}) WHERE key IS NOT NULL GROUP BY key)""", m=m)


def payloads(s: DataFrame, schema: str = KEYS) -> DataFrame:
    """s with a struct p of the payload's keys: from columns of their names where s has them, else parsed."""
    wanted = [k.split()[0] for k in schema.split(", ")]
    ready = all(k in s.columns for k in wanted)
    return s.withColumn("p", F.struct(*wanted) if ready else F.from_json("payload", schema))


def facts(s: DataFrame, m: DataFrame, until: Column | None = None, types: tuple[str, ...] = (*MEMBERS, *OBSERVATIONS, "validated"), known: DataFrame | None = None) -> DataFrame:
    """One row for each group and member, observation, or (key "") its validations: group_hash, kind, key, linked, added
    (null without such events, else whether the last one added), issued, resolved, at. One pass over the log.

    s: snapshot_hash, model_hash, timestamp, event_type, payload. A link counts if its relationship is member_of and a model
    has its upstream_hash as hash or name; an addition if a model has its member_hash or member_name as hash or name; a
    removal always. Observations without an id don't count. known: names(m), if it is at hand.
    """
    if until is not None:
        s = s.where(F.col("timestamp") <= until)
    rows = payloads(s.where(F.col("event_type").isin(*types)))
    return s.sparkSession.sql(FACTS, s=rows.select("snapshot_hash", "model_hash", "event_type", "timestamp", "p"), n=names(m) if known is None else known)


#: References are looked up; other rows get a key that no model has, all of them different, so that none is hot.
FACTS = """
WITH e AS (SELECT snapshot_hash, model_hash AS group_hash, event_type, timestamp, p FROM {s}),
  r AS (SELECT *, explode(CASE event_type WHEN 'depends_on' THEN array(p.upstream_hash) WHEN 'member_added' THEN array(p.member_hash, p.member_name) ELSE array(CAST(NULL AS STRING)) END) AS ref
    FROM e WHERE event_type <> 'depends_on' OR p.relationship = 'member_of'),
  f AS (SELECT group_hash, event_type, timestamp, snapshot_hash,
      CASE WHEN event_type LIKE 'observation%' THEN 'observation' WHEN event_type = 'validated' THEN 'validated' ELSE 'member' END AS kind,
      CASE WHEN event_type = 'depends_on' THEN found WHEN event_type LIKE 'observation%' THEN p.observation_id WHEN event_type = 'validated' THEN '' ELSE coalesce(p.member_hash, '') END AS key
    FROM r LEFT JOIN {n} n ON n.key = coalesce(ref, concat(chr(0), snapshot_hash))
    WHERE (event_type NOT IN ('depends_on', 'member_added') OR found IS NOT NULL) AND (event_type NOT LIKE 'observation%' OR coalesce(p.observation_id, '') <> ''))
SELECT group_hash, kind, key, max(event_type = 'depends_on') AS linked,
  max(CASE WHEN event_type IN ('member_added', 'member_removed') THEN struct(timestamp, snapshot_hash, event_type = 'member_added' AS added) END).added AS added,
  max(event_type = 'observation_issued') AS issued, max(event_type = 'observation_resolved') AS resolved, max(timestamp) AS at
FROM f GROUP BY group_hash, kind, key"""
MEMBER = "kind = 'member' AND coalesce(added, linked)"
OPEN = "kind = 'observation' AND issued AND NOT resolved"


def membership(s: DataFrame, m: DataFrame, until: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """group_hash, member_hash: who is a member now, or was at `until` (inclusive). known: names(m), if it is at hand."""
    return facts(s, m, until, MEMBERS, known).where(MEMBER).select("group_hash", F.col("key").alias("member_hash"))


def open_observations(s: DataFrame) -> DataFrame:
    """group_hash, observation_id: issued and never resolved; blank ids don't count."""
    of = s.where(F.col("event_type").isin(*OBSERVATIONS)).select("model_hash", "event_type", F.get_json_object("payload", "$.observation_id").alias("id"))
    by = of.where("id <> ''").groupBy(F.col("model_hash").alias("group_hash"), F.col("id").alias("observation_id"))
    count = lambda t: F.count_if(F.col("event_type") == t)
    return by.agg(count("observation_issued").alias("i"), count("observation_resolved").alias("r")).where("i > 0 AND r = 0").select("group_hash", "observation_id")


def last_validated(s: DataFrame) -> DataFrame:
    return s.where("event_type = 'validated'").groupBy(F.col("model_hash").alias("group_hash")).agg(F.max("timestamp").alias("last_validated"))


def composite_summary(m: DataFrame, s: DataFrame, model_types: tuple[str, ...] = ("composite",), known: DataFrame | None = None) -> DataFrame:
    """One row for each group: identity, member count, last validation, open observations, metadata."""
    groups = m.where(F.col("model_type").isin(*model_types))
    mine = s.join(groups.select("model_hash"), "model_hash", "left_semi")
    return m.sparkSession.sql(f"""
        SELECT model_hash, name, owner, model_type, tier, status, coalesce(members, 0L) AS member_count, last_validated, coalesce(opened, 0L) AS open_observation_count, metadata
        FROM {{g}} LEFT JOIN (SELECT group_hash, count_if({MEMBER}) AS members, count_if({OPEN}) AS opened, max(CASE WHEN kind = 'validated' THEN at END) AS last_validated
          FROM {{f}} GROUP BY group_hash) ON group_hash = model_hash""", g=groups, f=facts(mine, m, known=known))  # fmt: skip


def group_events(of: DataFrame, m: DataFrame, event_type: str) -> DataFrame:
    """The member_added or member_removed events for of(group_hash, member): model_hash, event_type, payload. member is a
    name or a hash; unknown members give no event."""
    found = of.join(names(m).withColumnRenamed("key", "member"), "member").join(m.select(F.col("model_hash").alias("found"), "name"), "found")
    payload = F.to_json(F.struct(F.col("name").alias("member_name"), F.col("found").alias("member_hash")))
    return found.select(F.col("group_hash").alias("model_hash"), F.lit(event_type).alias("event_type"), payload.alias("payload"))


def link_events(pairs: DataFrame, m: DataFrame, relationship: str = "depends_on", via: str | None = None) -> DataFrame:
    """Both events of each link in pairs(upstream, downstream), names or hashes: has_dependent on the upstream model and
    depends_on on the downstream one, with the other's name and hash. A link to an unknown model gives none. A group's
    members are its upstreams, by the relationship member_of. via: a column of pairs that both payloads keep."""
    return link_rows(pairs, m, relationship, via).drop("canonical")


def link_rows(pairs: DataFrame, m: DataFrame, relationship: str = "depends_on", via: str | None = None, known: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """link_events, and their payloads as canonical JSON. known: named(m), if it is at hand; sources: its rows for upstream ends, if
    they are few enough to be broadcast. Downstream ends are looked up first, so pairs that are dealt by them stay where they are."""
    known = named(m) if known is None else known
    of = {"downstream": known, "upstream": known if sources is None else F.broadcast(sources)}
    end = lambda side: of[side].select(F.col("key").alias(side), F.struct(F.col("found").alias("hash"), "name").alias(side[0]))
    both = pairs.select("upstream", "downstream", *([F.col(via).alias("via")] if via else [])).join(end("downstream"), "downstream").join(end("upstream"), "upstream")
    kind = [F.lit(relationship).alias("relationship"), *([F.col("via")] if via else [])]
    same = {"relationship": F.lit(relationship)} | ({"via": F.col("via")} if via else {})

    def event(own: str, name: str, **other: str) -> Column:
        others = {k: F.col(v) for k, v in other.items()}
        payload = F.to_json(F.struct(*[v.alias(k) for k, v in others.items()], *kind))
        return F.struct(F.col(f"{own}.hash").alias("model_hash"), F.lit(name).alias("event_type"), payload.alias("payload"), text_json(**others, **same).alias("canonical"))

    up, down = event("u", "has_dependent", downstream="d.name", downstream_hash="d.hash"), event("d", "depends_on", upstream="u.name", upstream_hash="u.hash")
    return both.select(F.explode(F.array(up, down)).alias("e")).select("e.*")


def change_events(s: DataFrame, member: DataFrame, m: DataFrame) -> DataFrame:
    """The rows of the log that models' own events raise in their groups: snapshot_hash, model_hash (the group), timestamp and
    actor (those of the cause), event_type, payload. s: snapshot_hash, model_hash, timestamp, event_type, actor; internal
    events raise none."""
    own = s.where(~F.col("event_type").isin(*INTERNAL_EVENTS)).select(F.col("model_hash").alias("member_hash"), F.col("snapshot_hash").alias("cause_hash"), F.col("event_type").alias("cause"), "timestamp", "actor")
    member = stored(member.select("group_hash", "member_hash"), "members")
    heard = own.join(member.select("member_hash").distinct(), "member_hash", "left_semi").join(m.select(F.col("model_hash").alias("member_hash"), F.col("name").alias("member_name")), "member_hash")
    # Texts are made once an event, before it meets its groups; dealt by event in a fixed number, as rows here are many rows there.
    tasks = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return told_rows(with_texts(heard).repartition(tasks, "member_hash", "cause_hash").join(member, "member_hash"))


def change_rows(raised: DataFrame) -> DataFrame:
    """Log rows of raised(group_hash, member_hash, member_name, cause, cause_hash, timestamp, actor)."""
    return told_rows(with_texts(raised))


def with_texts(raised: DataFrame) -> DataFrame:
    """raised(member_hash, member_name, cause, cause_hash, timestamp) with what is the same in all groups: payload, and `identity`, what
    follows the group's hash in the text that an event's hash is taken of."""
    payload = F.to_json(F.struct("member_name", "member_hash", F.col("cause").alias("original_event_type"), F.col("cause_hash").alias("original_snapshot_hash")))
    canonical = text_json(member_name=F.col("member_name"), member_hash=F.col("member_hash"), original_event_type=F.col("cause"), original_snapshot_hash=F.col("cause_hash"))
    return raised.withColumns({"payload": payload, "identity": snapshot_text(F.col("timestamp"), canonical)})


def told_rows(rows: DataFrame) -> DataFrame:
    """The log rows of rows(group_hash, timestamp, actor, payload, identity)."""
    return rows.select(text_hash(F.col("group_hash"), F.col("identity")).alias("snapshot_hash"), F.col("group_hash").alias("model_hash"), "timestamp", "actor", F.lit("member_changed").alias("event_type"), "payload")


def member_changed(s: DataFrame, member: DataFrame) -> DataFrame:
    """The member_changed events that a model's own (not internal) events raise in each group it is in: one level up."""
    return s.join(member.withColumnRenamed("member_hash", "model_hash"), "model_hash").select(
        "group_hash", F.col("model_hash").alias("member_hash"), F.lit("member_changed").alias("event_type"), F.col("event_type").alias("cause"), F.col("snapshot_hash").alias("cause_hash"), "timestamp"
    )
