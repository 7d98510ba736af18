"""The write side: what a batch of discovered nodes adds to the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Payload keys that change without the model changing; the statuses a node may state.
VOLATILE = ("created_at", "updated_at", "source_updated_at", "_content_hash", "change_detected", "change_occurred")
STATUSES = ("development", "review", "active", "deprecated", "retired")


def normal_status(raw: Column) -> Column:
    """One of STATUSES whatever its case, else null: no opinion."""
    return F.when(F.lower(raw).isin(*STATUSES), F.lower(raw))


def canonical_json(payload: Column, without: tuple[str, ...] = ()) -> Column:
    """JSON with its keys sorted at every depth, compact, types kept; at the top without the given keys. Of equal keys the last
    counts. Numbers of equal value are written alike (1.0 and 1e0 as 1), but for whole ones from 10^7 on that have an
    exponent. Text that isn't an object is given in canonical form, or as it is if it isn't JSON."""
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # else such text can't be parsed
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  what a lambda names is computed once, not once for each use
    quoted = lambda k: F.btrim(F.to_json(F.array(k)), F.lit("[]"))
    keys = lambda found: F.filter(F.array_sort(F.map_keys(found)), lambda k: ~k.isin(*without) if without else F.lit(True))
    pairs = lambda found: F.transform(keys(found), lambda k: F.concat(quoted(k), F.lit(":"), F.to_json(F.element_at(found, k))))
    object_ = lambda v: once(F.try_variant_get(v, "$", "map<string,variant>"), lambda found: F.concat(F.lit("{"), F.array_join(pairs(found), ","), F.lit("}")))
    text = once(F.try_parse_json(payload), lambda v: F.coalesce(object_(v), F.to_json(v)))
    whole = F.regexp_replace(text, r'(?s)("(?:[^"\\]|\\.)*+")|(-?\d++)\.0(?![\d.eE])', "$1$2")  # strings stay as they are
    return F.coalesce(whole, payload)


def content_hash(payload: Column) -> Column:
    """SHA-256 of the payload as canonical JSON, without volatile keys."""
    return F.sha2(canonical_json(payload, VOLATILE), 256)


def iso(at: Column) -> Column:
    """A time in UTC as ISO text, with microseconds where it has any."""
    at = at.cast("timestamp_ntz")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") != "000000", F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def model_hash(name: Column, owner: Column, created_at: Column) -> Column:
    """The identity of a model: the first 32 hex digits of SHA-256 over name, owner and time of creation."""
    return F.substr(F.sha2(F.concat_ws(":", name, owner, iso(created_at)), 256), F.lit(1), F.lit(32))


def snapshot_hash(model: Column, timestamp: Column, payload: Column, canonical: Column | None = None) -> Column:
    """The identity of an event: likewise, over its model, time and payload as canonical JSON, which may be at hand."""
    return text_hash(model, snapshot_text(timestamp, canonical_json(payload) if canonical is None else canonical))


def snapshot_text(timestamp: Column, canonical: Column) -> Column:
    """What follows the model in the text that the identity of an event is taken of."""
    return F.concat_ws(":", iso(timestamp), canonical)


def text_hash(model: Column, text: Column) -> Column:
    """The identity of a model's event, from its snapshot_text."""
    return F.substr(F.sha2(F.concat_ws(":", model, text), 256), F.lit(1), F.lit(32))


def text_json(**values: Column) -> Column:
    """Canonical JSON of texts by key; null ones are left out, as to_json leaves them out."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def latest_content(log: DataFrame) -> DataFrame:
    """model_hash, before: the hash of the content that a model had last. log: (model_hash, snapshot_hash, timestamp, payload)."""
    h = content_hash(F.col("payload"))
    return log.groupBy("model_hash").agg(F.max_by(h, F.struct("timestamp", "snapshot_hash")).alias("before"))


def add(log: DataFrame, batch: DataFrame) -> DataFrame:
    """batch with `is_new`: whether its content differs from what the model had before, in the log or in the batch.

    log and batch: (model_hash, snapshot_hash, timestamp, payload). Rows of the batch follow each other by time.
    """
    h = content_hash(F.col("payload"))
    old = latest_content(log)
    w = Window.partitionBy("model_hash").orderBy("timestamp", "snapshot_hash")
    rows = batch.withColumn("content_hash", h).join(old, "model_hash", "left")
    previous = F.coalesce(F.lag("content_hash").over(w), "before")
    return rows.withColumn("is_new", ~F.col("content_hash").eqNullSafe(previous)).drop("before")


def last_status(s: DataFrame, raw: Column) -> DataFrame:
    """model_hash, status: the last valid status that an event stated."""
    status = normal_status(raw)
    return s.where(status.isNotNull()).groupBy("model_hash").agg(F.max_by(status, F.struct("timestamp", "snapshot_hash")).alias("status"))


def append_new(log: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("snapshot_hash", "event_type")) -> DataFrame:
    """The rows of new, each key once, that the log does not have."""
    return new.dropDuplicates(list(keys)).join(log.select(*keys), list(keys), "left_anti")


def reconcile(before: DataFrame, now: DataFrame) -> DataFrame:
    """model_hash, outcome for a scan: discovered, scan_confirmed, or not_found for what was there before."""
    old = before.select("model_hash", F.lit(True).alias("was")).distinct()
    new = now.select("model_hash", F.lit(True).alias("is")).distinct()
    outcome = F.when(F.col("was").isNull(), "discovered").when(F.col("is").isNull(), "not_found").otherwise("scan_confirmed")
    return old.join(new, "model_hash", "full").select("model_hash", outcome.alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",), order: str | None = None) -> DataFrame:
    """old with the rows of new merged in by key; the columns in `keep` stay as they were.

    Of several new rows with one key the last wins: that with the greatest `order` (a column of new that old lacks), and
    of equals, or without it, that with the greatest other columns in their order.
    """
    other = [c for c in old.columns if c != key]
    last = F.max(F.struct(*[order] * bool(order), *other))
    n = new.groupBy(key).agg(last.alias("__new"))
    value = lambda c: F.coalesce(c, f"__new.{c}") if c in keep else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c))
    return old.join(n, key, "full").select(key, *[value(c).alias(c) for c in other])


def register(m: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models, events) that registering new(name, owner, model_type, tier, purpose, created_at) adds to the models m.

    Get or create by name: names that m has add nothing, and of several new rows with one name the first by created_at
    counts. Each new model has one registered event.
    """
    first = new.groupBy("name").agg(F.min(F.struct("created_at", *[c for c in new.columns if c not in ("name", "created_at")])).alias("of"))
    made = first.select("name", "of.*").join(m.select("name"), "name", "left_anti")
    made = made.withColumns({"model_hash": model_hash(F.col("name"), F.col("owner"), F.col("created_at")), "status": F.lit("active")})
    payload = F.to_json(F.struct("name", "owner", "tier", "purpose", F.lit("internal").alias("model_origin")))
    events = made.select("model_hash", F.lit("registered").alias("event_type"), F.col("created_at").alias("timestamp"), payload.alias("payload"))
    return made, events


def add_nodes(m: DataFrame, log: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, discovered, counts): what a scan's nodes change.

    m: model_hash, name, status; log: model_hash, timestamp, snapshot_hash, content_hash of discovered events; nodes: name,
    platform, status, payload, seen_at, each name once. models: model_hash, name, status, last_seen of every node's model,
    new ones included; a valid status that a node states is taken even if its content is as before. discovered: events of
    the nodes whose content differs from their model's latest. counts: one row of added, skipped.
    """
    known = nodes.join(m.select("name", F.col("model_hash").alias("old_hash"), F.col("status").alias("old_status")), "name", "left")
    own = F.coalesce("old_hash", model_hash(F.col("name"), F.col("platform"), F.col("seen_at")))
    rows = known.withColumns({"model_hash": own, "content_hash": content_hash(F.col("payload")), "new_status": normal_status(F.col("status"))})
    before = log.groupBy("model_hash").agg(F.max_by("content_hash", F.struct("timestamp", "snapshot_hash")).alias("before"))
    rows = rows.join(before, "model_hash", "left").withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("before")))
    models = rows.select("model_hash", "name", F.coalesce("new_status", "old_status", F.lit("active")).alias("status"), F.col("seen_at").alias("last_seen"))
    events = rows.where("changed").select("model_hash", F.lit("discovered").alias("event_type"), F.concat(F.lit("connector:"), "platform").alias("actor"), "payload", "content_hash", F.col("seen_at").alias("timestamp"))
    counts = rows.agg(F.count_if("changed").alias("added"), F.count_if(~F.col("changed")).alias("skipped"))
    return models, events, counts


def mirrored(edges: DataFrame) -> DataFrame:
    """Both events that record a link: has_dependent on the upstream, depends_on on the downstream."""
    pair = F.array(
        F.struct(F.col("src").alias("model_hash"), F.lit("has_dependent").alias("event_type"), F.col("dst").alias("other_hash")),
        F.struct(F.col("dst").alias("model_hash"), F.lit("depends_on").alias("event_type"), F.col("src").alias("other_hash")),
    )
    return edges.select(F.explode(pair).alias("x")).select("x.*")


def last_scan(s: DataFrame, platform: str) -> DataFrame:
    """One row, `at`: when the platform's scanner last wrote to the log (null if never). A scan whose source hasn't changed
    since then can be left out."""
    return s.where(F.col("source") == platform).agg(F.max("timestamp").alias("at"))


def scan(m: DataFrame, s: DataFrame, candidates: DataFrame, platform: str) -> tuple[DataFrame, DataFrame]:
    """(events, report) of a platform's scan. m: model_hash, name; s: model_hash, event_type, source; candidates: name,
    and enrichment, a JSON text or null, each name once.

    events: name, event_type: discovered for new names, scan_confirmed for known ones, enriched where a candidate has an
    enrichment, not_found for models that this platform discovered or confirmed before and that are no candidates now.
    report: total_found, new_models, updated_models, not_found_models.
    """
    seen = s.where((F.col("source") == platform) & F.col("event_type").isin("discovered", "scan_confirmed")).select("model_hash").distinct()
    known = m.select("model_hash", "name").join(seen.withColumn("ours", F.lit(True)), "model_hash", "left").select("name", F.coalesce("ours", F.lit(False)).alias("ours"))
    now = candidates.select("name", "enrichment", F.lit(True).alias("now"))
    both = known.join(now, "name", "full")
    kind = F.when(F.col("ours").isNull(), "discovered").when(F.col("now"), "scan_confirmed").when(F.col("ours"), "not_found")
    rows = both.select("name", kind.alias("event_type"), "enrichment").where("event_type IS NOT NULL")
    more = F.when(F.coalesce("enrichment", F.lit("{}")) != "{}", F.array("event_type", F.lit("enriched"))).otherwise(F.array("event_type"))
    events = rows.select("name", F.explode(more).alias("event_type"))
    count = lambda t: F.count_if(F.col("event_type") == t)
    report = rows.agg((count("discovered") + count("scan_confirmed")).alias("total_found"), count("discovered").alias("new_models"), count("scan_confirmed").alias("updated_models"), count("not_found").alias("not_found_models"))
    return events, report
