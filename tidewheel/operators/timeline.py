"""Reads along the time axis of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .membership import latest


def history(s: DataFrame, model_hash: str) -> DataFrame:
    return s.where(F.col("model_hash") == model_hash).orderBy(F.desc("timestamp"), F.desc("snapshot_hash"))


def between(s: DataFrame, since: Column | None = None, until: Column | None = None, event_type: str | None = None, model_hash: str | None = None) -> DataFrame:
    """Events within closed bounds; without any bound those of the last seven days."""
    if since is None and until is None:
        since = F.current_timestamp() - F.make_interval(days=F.lit(7))
    for given, test in ((since, lambda x: F.col("timestamp") >= x), (until, lambda x: F.col("timestamp") <= x)):
        if given is not None:
            s = s.where(test(given))
    if event_type:
        s = s.where(F.col("event_type") == event_type)
    return s.where(F.col("model_hash") == model_hash) if model_hash else s


def changelog(s: DataFrame, m: DataFrame, offset: int, limit: int, since: Column | None = None, until: Column | None = None, event_type: str | None = None, model_hash: str | None = None) -> DataFrame:
    """A page of the events within closed bounds, newest first, with their model's name (unknown models show their hash)
    and the payload's summary. The page is cut before the join, so that only its rows are looked up."""
    found = page(between(s, since, until, event_type, model_hash), offset, limit, F.desc("timestamp"), F.desc("snapshot_hash"))
    named = found.join(m.select("model_hash", "name"), "model_hash", "left")
    return named.select("snapshot_hash", "timestamp", "event_type", "actor", F.coalesce("name", "model_hash").alias("model_name"), F.get_json_object("payload", "$.summary").alias("summary"))


def changelog_report(s: DataFrame, offset: int, limit: int, since: Column | None = None, until: Column | None = None, event_type: str | None = None, model_hash: str | None = None) -> DataFrame:
    """One row that goes with a page of the changelog: total, has_more, period."""
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    if since is not None and until is not None:
        period = F.concat(day(since), F.lit(" to "), day(until))
    elif until is None:
        days = F.lit(7) if since is None else F.greatest(F.floor((F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(since)) / 86400), F.lit(0))
        period = F.concat(F.lit("last "), days.cast("string"), F.lit(" days"))
    else:
        period = F.lit("all time")
    total = between(s, since, until, event_type, model_hash).agg(F.count("*").alias("total"))
    return total.select("total", (F.col("total") > offset + limit).alias("has_more"), period.alias("period"))


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """A stated page of a report, in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def inventory_at(m: DataFrame, s: DataFrame, at: Column, source: str | None = None) -> DataFrame:
    """Models created by `at` whose latest event before it is not not_found."""
    before = s.where(F.col("timestamp") < at)
    if source:
        before = before.where(F.col("source") == source)
    state = before.groupBy("model_hash").agg(F.max_by("event_type", F.struct("timestamp", "snapshot_hash")).alias("last_type"))
    return m.where(F.col("created_at") <= at).join(state.where("last_type <> 'not_found'"), "model_hash")


def platforms(s: DataFrame) -> DataFrame:
    """model_hash, platform: the payload's platform of the latest discovery, else the latest source, else null."""
    named = F.get_json_object("payload", "$.platform")
    found = F.when((F.col("event_type") == "discovered") & named.isNotNull(), named)
    when = F.struct("timestamp", "snapshot_hash")
    by = s.groupBy("model_hash").agg(F.max_by(found, F.when(found.isNotNull(), when)).alias("a"), F.max_by("source", F.when(F.col("source").isNotNull(), when)).alias("b"))
    return by.select("model_hash", F.coalesce("a", "b").alias("platform"))


def models_in(m: DataFrame, wanted: DataFrame) -> DataFrame:
    """The models whose hash is in wanted(model_hash), each once; blanks and unknown hashes are left out."""
    return m.join(wanted.where("model_hash <> ''").select("model_hash").distinct(), "model_hash", "left_semi")


def tags_of(tags: DataFrame, s: DataFrame, model_hash: str) -> DataFrame:
    """A model's current tags in order of name, each with the event that it points to. tags: model_hash, name,
    snapshot_hash, updated_at, where of equal names the latest counts."""
    own = tags.where(F.col("model_hash") == model_hash)
    last = own.groupBy("name").agg(F.max(F.struct("updated_at", "snapshot_hash")).alias("t")).select("name", "t.*")
    return last.join(s.select("snapshot_hash", "event_type", "timestamp"), "snapshot_hash").orderBy("name").select("name", "snapshot_hash", "updated_at", "event_type", "timestamp")


def model_summaries(m: DataFrame, s: DataFrame) -> DataFrame:
    """Every model with its last event, event count and platform; models without events have null and 0. One pass over
    the log."""
    out = m.join(activity(s), "model_hash", "left")
    return out.select("name", "owner", "model_type", "status", "platform", "last_event", F.coalesce("n", F.lit(0)).cast("long").alias("event_count"))


def activity(s: DataFrame) -> DataFrame:
    """model_hash, last_event, n, platform: the payload's platform of the latest discovery, else the latest source."""
    named = F.get_json_object("payload", "$.platform")
    found = F.when((F.col("event_type") == "discovered") & named.isNotNull(), named)
    when = F.struct("timestamp", "snapshot_hash")
    by = s.groupBy("model_hash").agg(
        F.max("timestamp").alias("last_event"), F.count("*").alias("n"),
        F.max_by(found, F.when(found.isNotNull(), when)).alias("a"), F.max_by("source", F.when(F.col("source").isNotNull(), when)).alias("b"),
    )
    return by.select("model_hash", "last_event", "n", F.coalesce("a", "b").alias("platform"))


def query(m: DataFrame, s: DataFrame, offset: int, limit: int, text: str | None = None, **equal: str) -> DataFrame:
    """A page of the models that match, in order of name, each with its summary, and with total and has_more of the whole
    search. The page is cut first; only its models' events are summed up."""
    for column, value in equal.items():
        m = m.where(F.col(column) == value)
    if text:
        m = text_search(m, text)
    rows = page(m, offset, limit, F.col("name"), F.col("model_hash"))
    found = model_summaries(rows, s.join(F.broadcast(rows.select("model_hash")), "model_hash", "left_semi"))
    return found.withColumn("total", m.agg(F.count("*")).scalar()).withColumn("has_more", F.col("total") > offset + limit)


# Events and keys that a model's merged metadata leaves out.
PLAIN_EVENTS = ("depends_on", "has_dependent", "registered")
PLAIN_KEYS = ("_content_hash", "upstream", "downstream", "upstream_hash", "downstream_hash", "relationship", "via", "via_schema", "name", "owner", "tier", "purpose", "model_origin")


def investigate(m: DataFrame, s: DataFrame, members: DataFrame, facts: DataFrame, links: DataFrame, as_of: Column, recent: int | None = 10) -> DataFrame:
    """Every model of m with all that its page shows, as of a time (inclusive): merged metadata (a map of JSON texts, the
    newest value of each key), the `recent` latest events (None: all), total_events, days_since_last_event (by as_of), names of
    upstream, downstream, groups and members (as of now, sorted), last_validated and open observations of composites.

    s: snapshot_hash, model_hash, timestamp, event_type, payload, source; members: group_hash, member_hash; facts: as
    membership.facts gives it for as_of; links: as graph.dependencies gives it.
    """
    seen = s.where(F.col("timestamp") <= as_of)
    event = F.struct("timestamp", "snapshot_hash", "event_type")
    by = seen.groupBy("model_hash").agg(F.max("timestamp").alias("last_event"), F.count("*").alias("total_events"))
    newest = Window.partitionBy("model_hash").orderBy(F.desc("timestamp"), F.desc("snapshot_hash"))
    few = seen if recent is None else seen.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= recent)
    few = few.groupBy("model_hash").agg(F.reverse(F.sort_array(F.collect_list(event))).alias("recent_events"))
    pairs = merged_metadata(seen.where(~F.col("event_type").isin(*PLAIN_EVENTS))).where(~F.col("key").isin(*PLAIN_KEYS))
    metadata = pairs.groupBy("model_hash").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    named = m.select(F.col("model_hash").alias("__other"), F.col("name").alias("__name"))

    def listed(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        return df.select(F.col(own).alias("model_hash"), F.col(other).alias("__other")).join(named, "__other").groupBy("model_hash").agg(F.sort_array(F.collect_set("__name")).alias(name))

    state = facts.groupBy(F.col("group_hash").alias("model_hash")).agg(
        F.max(F.when(F.col("kind") == "validated", F.col("at"))).alias("last_validated"), F.count_if(F.expr("kind = 'observation' AND issued AND NOT resolved")).alias("opened")
    )
    out = m.drop("metadata")
    parts = [by, few, metadata, state, *(listed(links.where(F.col("direction") == d), "model_hash", "other_hash", d) for d in ("upstream", "downstream"))]
    parts += [listed(members, "member_hash", "group_hash", "groups"), listed(members, "group_hash", "member_hash", "members")]
    for part in parts:
        out = out.join(part, "model_hash", "left")
    composite = F.col("model_type") == "composite"
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    days = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("last_event").cast("timestamp"))) / 86400)
    return out.select(
        "model_hash", "name", "owner", "model_type", "purpose", "status", "created_at", F.coalesce("total_events", F.lit(0)).cast("long").alias("total_events"), days.alias("days_since_last_event"),
        "metadata", "recent_events", *[F.coalesce(c, none).alias(c) for c in ("upstream", "downstream", "groups", "members")],
        F.when(composite, F.col("last_validated")).alias("last_validated"), F.when(composite, F.coalesce("opened", F.lit(0)).cast("long")).alias("open_observation_count"),
    )


def text_search(m: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of name or purpose."""
    t = text.lower()
    return m.where(F.contains(F.lower("name"), F.lit(t)) | F.contains(F.lower("purpose"), F.lit(t)))


def merged_metadata(s: DataFrame) -> DataFrame:
    """model_hash, key, value: payload objects folded oldest to newest, the last value of each key wins. Values are text,
    or JSON text where they are nested."""
    each = s.select("model_hash", "timestamp", "snapshot_hash", F.explode(F.from_json("payload", "map<string,string>")).alias("key", "value"))
    return latest(each, "model_hash", "key").select("model_hash", "key", "value")
