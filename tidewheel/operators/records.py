"""Feedback, audit events, observations and versions: filters, counts and saves over their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import LatestTable


def matching(df: DataFrame, **equal: str | None) -> DataFrame:
    """The rows that have all the given values; None doesn't filter."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """facet, value, n: how many events there are in total, by verdict, by reason code and by stage, in one pass."""
    facets = ["verdict", "reason_code", "stage"]
    by = feedback.groupingSets([*([f] for f in facets), []], *facets)
    facet = F.lit("total")
    for f in reversed(facets):
        facet = F.when(F.grouping(f) == 0, f).otherwise(facet)
    return by.agg(facet.alias("facet"), F.count("*").alias("n")).select("facet", F.coalesce(*facets).alias("value"), "n")


def save_versions(old: DataFrame, new: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(versions, refused) for versions keyed by model_name, version, with frozen and other columns: a version that is
    frozen isn't replaced unless forced; others are. Each key of new once."""
    key = ["model_name", "version"]
    refused = new.join(old.where("frozen").select(*key), key, "left_semi") if not force else new.limit(0)
    taken = new.join(refused.select(*key), key, "left_anti")
    return old.join(taken.select(*key), key, "left_anti").unionByName(taken), refused


def audit_log(events: DataFrame, model_name: str | None = None, version: str | None = None) -> DataFrame:
    """Audit events of a model and version, if given, in the order in which they came: by time, then id."""
    return matching(events, model_name=model_name, version=version).orderBy("timestamp", "event_id")


def stores(spark: SparkSession, path: str) -> dict[str, LatestTable]:
    """The tables of the records, by name. Observations, validation runs, reports and versions are replaced by key; audit and
    feedback events are only added, so that one written again, with the same id, is there once."""
    keys = {"observations": ["observation_id"], "validation_runs": ["run_id"], "validation_reports": ["report_id"], "versions": ["model_name", "version"], "audit": ["event_id"], "feedback": ["event_id"]}
    return {name: LatestTable(spark, f"{path}/{name}", key, "timestamp") for name, key in keys.items()}


def governance_events(of: DataFrame, event_type: str, *keys: str, metadata: str | None = None) -> DataFrame:
    """model_hash, timestamp, actor, event_type, payload of observations, resolutions or validations of groups: the payload has the
    columns `keys` where they aren't null, and the entries of the map `metadata`, which take the place of equal keys."""
    own = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]), lambda k, v: v.isNotNull())
    more = F.coalesce(metadata, F.expr("CAST(map() AS MAP<STRING,STRING>)")) if metadata else F.expr("CAST(map() AS MAP<STRING,STRING>)")
    payload = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k)), more)))))
    return of.select("model_hash", "timestamp", "actor", F.lit(event_type).alias("event_type"), payload.alias("payload"))


#: What a payload of each kind has.
PAYLOADS = {"observation_issued": ("observation_id", "observation", "status", "severity"), "observation_resolved": ("observation_id", "resolution"), "validated": ("result",)}


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows of models or events as tables give them, with the defaults of what is missing or null: model_origin internal, status
    active, an empty purpose, an empty metadata or payload. Other columns stay."""
    defaults = {"model_origin": "internal", "status": "active", "purpose": "", "metadata": "{}", "payload": "{}"}
    empty = ("metadata", "payload")
    given = {c: F.coalesce(F.nullif(F.col(c), F.lit("")) if c in empty else F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()}
    wanted = ("payload",) if "event_type" in rows.columns else ("model_origin", "status", "purpose", "metadata")
    return rows.withColumns({c: given[c] for c in wanted})


def audit_pack(model: DataFrame, versions: DataFrame, audit: DataFrame, observations: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """model_name, section, item, detail (JSON): the rows of a model's audit pack, in sections inventory, version, audit,
    observation, and validation if findings (model_name, rule_id, ...) are given."""
    def part(df: DataFrame, section: str, item: str) -> DataFrame:
        return df.select("model_name", F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.to_json(F.struct(*[c for c in df.columns if c != "model_name"])).alias("detail"))

    out = part(model, "inventory", "model_name").unionByName(part(versions, "version", "version")).unionByName(part(audit, "audit", "event_id")).unionByName(part(observations, "observation", "observation_id"))
    return out if findings is None else out.unionByName(part(findings, "validation", "rule_id"))
