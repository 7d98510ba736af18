"""The three logical tables of the engine, and their projections from star-schema files.

models: one row a model. snapshots: the append-only event log. edges: upstream and downstream, one row a link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.store import materialized

# Events that describe the log itself and never propagate to groups.
INTERNAL_EVENTS = ("registered", "has_dependent", "depends_on", "member_added", "member_removed", "member_changed", "observation_issued", "observation_resolved", "validated")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(value: Column, cases: dict[object, str], other: str | None = None) -> Column:
    first, *rest = cases.items()
    out = F.when(value == first[0], first[1])
    for k, v in rest:
        out = out.when(value == k, v)
    return out if other is None else out.otherwise(other)


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_hash, name, owner, model_type, tier, purpose, status, created_at, metadata (JSON); stored by model_hash."""
    return materialized(spark, "models", [f"{sf_dir}/{x}.parquet" for x in ("customer", "nation")], lambda: inventory(spark, sf_dir), "model_hash", ["model_hash"])


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    segment = F.lower("c_mktsegment")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("model_hash"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("owner"),
        F.when(F.col("c_custkey") % 10 == 0, "composite").otherwise(segment).alias("model_type"),
        F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_acctbal") < 5000, "medium").otherwise("high").alias("tier"),
        F.concat(F.lit("serves "), segment, F.lit(" in "), "n_name").alias("purpose"),
        case(F.col("c_custkey") % 5, {0: "retired", 1: "deprecated"}, "active").alias("status"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=F.col("c_custkey").cast("int"))).alias("created_at"),
        F.concat(F.lit('{"segment":"'), segment, F.lit('"}')).alias("metadata"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_hash, model_hash, composite_hash, timestamp, actor, event_type, gov_type, source, payload, k; stored by model_hash."""
    return materialized(spark, "snapshots", [f"{sf_dir}/events.parquet"], lambda: events(spark, sf_dir), "model_hash", ["model_hash", "timestamp"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    key = lambda c: F.concat(F.lit("m"), c.cast("string"))
    even = F.col("event_id") % 2 == 0
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("snapshot_hash"),
        key(F.col("user_id")).alias("model_hash"),
        key(F.col("user_id") - F.col("user_id") % 10).alias("composite_hash"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("actor"), (F.col("event_id") % 7).cast("string")).alias("actor"),
        case(kind, {"signup": "discovered", "view": "scan_confirmed", "error": "not_found", "click": "retrained"}, "deployed").alias("event_type"),
        F.when((kind == "signup") & even, "depends_on").when(kind == "click", "member_added").when(kind == "error", "member_removed")
        .when((kind == "view") & even, "observation_issued").when(kind == "view", "validated").when(kind == "purchase", "observation_resolved").otherwise("registered").alias("gov_type"),
        case(F.col("event_id") % 3, {0: "etl", 1: "ml"}).alias("source"),
        F.col("props").alias("payload"),
        F.get_json_object("props", "$.k").alias("k"),
    )


#: Keys of payloads that queries read, as columns of the stored ledger.
HOT = ("relationship", "upstream", "upstream_hash", "downstream", "downstream_hash", "member_hash", "member_name", "observation_id")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The governance events of groups: snapshot_hash, model_hash (the group), timestamp, actor, payload (JSON), its HOT keys as
    columns, event_type; stored by model_hash in partitions by type."""

    def made() -> DataFrame:
        s = events(spark, sf_dir).withColumn("i", F.substr("snapshot_hash", F.lit(2)).cast("long"))
        named = s.withColumns({"mh": F.expr(MEMBER_HASH), "nm": F.expr(MEMBER_NAME)})
        rows = named.select("snapshot_hash", F.col("composite_hash").alias("model_hash"), "timestamp", "actor", F.col("gov_type").alias("event_type"), F.expr(PAYLOAD).alias("payload"))
        return rows.select("snapshot_hash", "model_hash", "timestamp", "actor", "payload", "event_type", F.from_json("payload", ", ".join(f"{k} string" for k in HOT)).alias("p")).select("snapshot_hash", "model_hash", "timestamp", "actor", "payload", "p.*", "event_type")

    return materialized(spark, "ledger", [f"{sf_dir}/events.parquet"], made, "model_hash", ["model_hash", "timestamp"], ["event_type"])


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, found: what membership.names gives for the models, stored by key."""
    from .operators.membership import names

    return materialized(spark, "names", [f"{sf_dir}/{x}.parquet" for x in ("customer", "nation")], lambda: names(models(spark, sf_dir)), "key", ["key"])


# What the ledger's payloads are made of, in SQL for both engines: members known by hash, by name, by both or by neither;
# links of several relationships; observations with, without and with blank ids.
MEMBER_HASH = "CASE WHEN i % 7 = 0 THEN 'm9999999' || k ELSE 'm' || k END"
MEMBER_NAME = "CASE WHEN i % 5 = 0 THEN 'nobody' ELSE 'Customer#' || lpad(k, 9, '0') END"
OBSERVATION = """CASE WHEN i % 10 < 1 THEN '{}' WHEN i % 10 < 2 THEN '{"observation_id":""}' ELSE '{"observation_id":"OBS-' || k || '"}' END"""
PAYLOAD = f"""CASE WHEN gov_type = 'depends_on' THEN '{{"upstream":"' || nm || '","upstream_hash":"' || CASE WHEN i % 3 = 0 THEN nm ELSE mh END || '"' || CASE WHEN i % 8 < 4 THEN ',"relationship":"member_of"' WHEN i % 8 = 4 THEN ',"relationship":"feeds"' ELSE '' END || '}}'
  WHEN gov_type IN ('member_added', 'member_removed') THEN '{{"member_hash":"' || mh || '","member_name":"' || nm || '"}}'
  WHEN gov_type IN ('observation_issued', 'observation_resolved') THEN {OBSERVATION} ELSE '{{}}' END"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a graph of three hops, region to nation to supplier to part; stored by src."""
    return materialized(spark, "edges", [f"{sf_dir}/{x}.parquet" for x in ("region", "nation", "supplier", "lineitem")], lambda: links(spark, sf_dir), "src", ["src"])


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s, li = (read(spark, sf_dir, x) for x in ("region", "nation", "supplier", "lineitem"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(name("r", "r_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
        .unionAll(n.join(s, F.col("n_nationkey") == F.col("s_nationkey")).select(name("n", "n_nationkey"), name("u", "s_suppkey")))
        .unionAll(li.select(name("u", "l_suppkey"), name("p", "l_partkey")).distinct())
    )


# The same projections for the SQL that results are compared with.
M = """m AS (SELECT 'm' || c_custkey AS model_hash, c_name AS name, n_name AS owner,
  CASE WHEN c_custkey % 10 = 0 THEN 'composite' ELSE lower(c_mktsegment) END AS model_type,
  CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'medium' ELSE 'high' END AS tier,
  'serves ' || lower(c_mktsegment) || ' in ' || n_name AS purpose,
  CASE c_custkey % 5 WHEN 0 THEN 'retired' WHEN 1 THEN 'deprecated' ELSE 'active' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' HOUR AS created_at,
  '{"segment":"' || lower(c_mktsegment) || '"}' AS metadata
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
S = """s AS (SELECT 's' || event_id AS snapshot_hash, 'm' || user_id AS model_hash, 'm' || (user_id - user_id % 10) AS composite_hash,
  ts AS "timestamp", 'actor' || (event_id % 7) AS actor,
  CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'view' THEN 'scan_confirmed' WHEN 'error' THEN 'not_found' WHEN 'click' THEN 'retrained' ELSE 'deployed' END AS event_type,
  CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'depends_on' WHEN event_type = 'click' THEN 'member_added' WHEN event_type = 'error' THEN 'member_removed'
    WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'observation_issued' WHEN event_type = 'view' THEN 'validated' WHEN event_type = 'purchase' THEN 'observation_resolved' ELSE 'registered' END AS gov_type,
  CASE event_id % 3 WHEN 0 THEN 'etl' WHEN 1 THEN 'ml' END AS source, props AS payload, json_extract_string(props, '$.k') AS k
  FROM events)"""
V = f"""g AS (SELECT snapshot_hash, composite_hash AS model_hash, "timestamp", actor, gov_type AS event_type, {PAYLOAD} AS payload
  FROM (SELECT *, {MEMBER_HASH} AS mh, {MEMBER_NAME} AS nm FROM (SELECT *, CAST(substr(snapshot_hash, 2) AS BIGINT) AS i FROM s) a) b)"""
E = """e AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey
  UNION ALL SELECT 'n' || n_nationkey, 'u' || s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey
  UNION ALL SELECT DISTINCT 'u' || l_suppkey, 'p' || l_partkey FROM lineitem)"""
