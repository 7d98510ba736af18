"""Queries by name, platform and relationship, scans with a user's code, and records in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookup as U
from ..operators import records as K
from ..operators import scanner as C
from ..sources.store import stored
from ..tables import E, M, S, edges, models, read, snapshots
from . import rules as R
from .catalog import CONDITIONS, DIAMONDS, PLATFORMS, SINCE, UNTIL, WHEN, ntz, query, shortcuts


@query(f"""WITH {M}, {S}, {PLATFORMS}, f AS (SELECT * FROM m JOIN pf USING (model_hash) JOIN (SELECT model_hash, max("timestamp") AS last_event, count(*) AS n FROM s GROUP BY 1) USING (model_hash) WHERE platform = 'ml')
  SELECT name, owner, model_type, status, platform, last_event, n AS event_count, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 45 AS has_more FROM f ORDER BY name, model_hash LIMIT 40 OFFSET 5""")
def query_by_platform(spark, d):
    return U.search(models(spark, d), snapshots(spark, d), 5, 40, platform="ml")


#: Models, some of which are named like the hash of another one.
CLASH = "SELECT model_hash, CASE WHEN CAST(substr(model_hash, 2) AS BIGINT) % 9 = 4 THEN 'm' || (CAST(substr(model_hash, 2) AS BIGINT) + 1) ELSE name END AS name FROM "


def clashing(spark, d) -> DataFrame:
    return spark.sql(CLASH + "{m}", m=models(spark, d))


@query(f"""WITH {M}, c AS ({CLASH}m), w AS (SELECT name AS ref FROM m UNION ALL SELECT model_hash FROM m UNION ALL SELECT 'nobody')
  SELECT ref, coalesce(a.model_hash, b.model_hash) AS model_hash, coalesce(a.name, b.name) AS name FROM w LEFT JOIN c a ON a.name = ref LEFT JOIN c b ON b.model_hash = ref""")
def get_by_name_or_hash(spark, d):
    m = models(spark, d)
    wanted = m.select(F.col("name").alias("ref")).unionByName(m.select(F.col("model_hash").alias("ref"))).unionByName(spark.range(1).select(F.lit("nobody").alias("ref")))
    return U.resolve(clashing(spark, d), wanted)


@query(f"""WITH {S} SELECT snapshot_hash, event_type, "timestamp", row_number() OVER (ORDER BY "timestamp" DESC, snapshot_hash DESC) AS position FROM s WHERE model_hash = 'm7'""")
def history_by_name(spark, d):
    """The history of a model by its name, in its order."""
    found = U.history(snapshots(spark, d), models(spark, d), "Customer#000000007").withColumn("position", F.monotonically_increasing_id())
    return found.select("snapshot_hash", "event_type", "timestamp", F.expr("row_number() OVER (ORDER BY position)").cast("long").alias("position"))


@query(f"""WITH {M}, {S} SELECT snapshot_hash, "timestamp", event_type, actor, name AS model_name, json_extract_string(payload, '$.summary') AS summary FROM s JOIN m USING (model_hash)
  WHERE name = 'Customer#000000003' AND "timestamp" BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}' AND event_type = 'deployed' ORDER BY "timestamp" DESC, snapshot_hash DESC LIMIT 10""")
def changelog_by_name(spark, d):
    return U.changelog(snapshots(spark, d), models(spark, d), 0, 10, ntz(SINCE), ntz(UNTIL), "deployed", "Customer#000000003")


#: Platforms of the nodes of the graph; parts with keys divisible by 5 have none.
NODE_PLATFORMS = """SELECT DISTINCT node AS name, CASE substr(node, 1, 1) WHEN 'r' THEN 'region' WHEN 'n' THEN 'nation' WHEN 'u' THEN 'etl' ELSE 'ml' END AS platform FROM (SELECT src AS node FROM {e} UNION ALL SELECT dst FROM {e}) x
  WHERE NOT (node LIKE 'p%' AND CAST(substr(node, 2) AS BIGINT) % 5 = 0)"""


@query(f"""WITH RECURSIVE {E}, {DIAMONDS}, up AS (SELECT 'p17' AS node, 0 AS hops UNION SELECT src, hops + 1 FROM up JOIN d ON dst = node), dn AS (SELECT 'p17' AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM dn JOIN d ON src = node),
  lv AS (SELECT node, 0 AS level FROM (SELECT DISTINCT node FROM up) u WHERE node NOT IN (SELECT dst FROM d) UNION SELECT dst, level + 1 FROM lv JOIN d ON src = node WHERE dst IN (SELECT node FROM up)),
  l AS (SELECT node, max(level) AS level FROM lv GROUP BY 1), h AS (SELECT node, min(hops) AS hops FROM up GROUP BY 1), g AS (SELECT node, min(hops) AS hops FROM dn WHERE node <> 'p17' GROUP BY 1), pl AS ({NODE_PLATFORMS.format(e="d")}),
  r AS (SELECT node AS name, 'upstream' AS direction, 'depends_on' AS relationship, row_number() OVER (ORDER BY level DESC, node DESC) AS position, hops FROM l JOIN h USING (node) WHERE node <> 'p17'
    UNION ALL SELECT node, 'downstream', 'feeds_into', row_number() OVER (ORDER BY hops, node), hops FROM g)
  SELECT name, direction, relationship, position, CAST(hops AS INTEGER) AS hops, platform FROM r LEFT JOIN pl USING (name) WHERE hops <= 2""")
def trace_tool(spark, d):
    """What a part depends on and what depends on it, within two hops, with platform and relationship."""
    e = edges(spark, d).unionByName(stored(shortcuts(spark, d), "shortcuts"))  # edges are stored already
    return U.trace(e, "p17", spark.sql(NODE_PLATFORMS.format(e="{e}"), e=e), 2, at_hand=True)


#: A scan by each of two platforms: odd and even models of its own events, and names that no model has.
SCANS = f"""src AS (SELECT DISTINCT model_hash, source FROM s WHERE "timestamp" >= TIMESTAMP '{WHEN}' AND source IS NOT NULL),
  c AS (SELECT source AS platform, name, CAST(substr(model_hash, 2) AS BIGINT) AS i FROM src JOIN m USING (model_hash) UNION ALL SELECT p, 'new-' || p || '-' || n_nationkey, n_nationkey FROM nation, (SELECT unnest(['etl', 'ml']) AS p)),
  k AS (SELECT * FROM c WHERE platform = 'etl' OR i % 3 <> 1), z AS (SELECT *, name NOT IN (SELECT name FROM m) AS new FROM k),
  ours AS (SELECT DISTINCT model_hash, source FROM s WHERE event_type IN ('discovered', 'scan_confirmed')),
  gone AS (SELECT source AS platform, name FROM ours JOIN m USING (model_hash) WHERE source IS NOT NULL AND name NOT IN (SELECT name FROM z WHERE platform = source))"""


def scans(spark, d) -> C.Scanned:
    m, s = models(spark, d), snapshots(spark, d)
    seen = s.where((F.col("timestamp") >= ntz(WHEN)) & F.col("source").isNotNull()).select("model_hash", "source").distinct().join(m.select("model_hash", "name"), "model_hash").select("source", "name", F.substr("model_hash", F.lit(2)).cast("long").alias("i"))
    new = lambda p: read(spark, d, "nation").select(F.lit(p).alias("source"), F.concat(F.lit(f"new-{p}-"), "n_nationkey").alias("name"), F.col("n_nationkey").cast("long").alias("i"))
    of = lambda p: seen.where(F.col("source") == p).unionByName(new(p)).select("name", "i")

    def more(row: dict) -> dict | None:
        if row["i"] % 5 == 4:
            raise KeyError(row["i"])
        return {"team": f"t{row['i'] % 4}"} if row["i"] % 5 else None

    one = s.agg(F.min_by(F.struct(*s.columns), "snapshot_hash").alias("r")).select("r.*").withColumn("source", F.lit("idle"))  # that platform's last event
    sources = {"etl": C.Source(of("etl"), enrich=more), "ml": C.Source(of("ml"), changed=lambda last: True, keep=lambda row: row["i"] % 3 != 1, enrich=more, new_only=True), "idle": C.Source(of("idle"), changed=lambda last: False)}
    return C.scan(m, s.unionByName(one), sources, "run1")


@query(f"""WITH {M}, {S}, {SCANS} SELECT name, CASE WHEN new THEN 'discovered' ELSE 'scan_confirmed' END AS event_type, platform AS source, '{{"scan_run_id":"run1"}}' AS payload FROM z UNION ALL SELECT name, 'not_found', platform, '{{"scan_run_id":"run1"}}' FROM gone
  UNION ALL SELECT name, 'enriched', platform, '{{"team": "t' || (i % 4) || '", "scan_run_id": "run1"}}' FROM z WHERE i % 5 BETWEEN 1 AND 3 AND (platform = 'etl' OR new)""")
def scan_events(spark, d):
    """The events of two platforms' scans, one with a filter in Python and enrichment of new names only."""
    return scans(spark, d).events.select("name", "event_type", "source", "payload")


@query(f"""WITH {M}, {S}, {SCANS} SELECT platform, count(*) AS total_found, count(*) FILTER (new) AS new_models, count(*) FILTER (NOT new) AS updated_models, (SELECT count(*) FROM gone WHERE gone.platform = z.platform) AS not_found_models FROM z GROUP BY 1
  UNION ALL SELECT 'idle', 0, 0, 0, 0""")
def scan_reports(spark, d):
    return scans(spark, d).reports


@query(f"WITH {M}, {S}, {SCANS} SELECT platform, name, 'KeyError: ' || i AS error FROM z WHERE i % 5 = 4 AND (platform = 'etl' OR new)")
def scan_errors(spark, d):
    return scans(spark, d).errors


@query("""SELECT o_orderkey AS model_hash, o_orderdate AS "timestamp", 'a' AS actor, 'observation_issued' AS event_type, '{"observation":"' || o_orderpriority || '","observation_id":"' || CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE 'OBS-' || o_orderkey END || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"severity":"high"' ELSE '' END || ',"status":"' || o_orderstatus || '"}' AS payload FROM orders""")
def observation_events(spark, d):
    """Observations as events; some have metadata that takes the id's place."""
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    of = o.select(key.alias("model_hash"), F.col("o_orderdate").alias("timestamp"), F.lit("a").alias("actor"), F.concat(F.lit("OBS-"), key.cast("string")).alias("observation_id"), F.col("o_orderpriority").alias("observation"), F.col("o_orderstatus").alias("status"),
        F.when(key % 2 == 0, "high").alias("severity"), F.when(key % 7 == 0, F.create_map(F.lit("observation_id"), F.lit("X"))).alias("more"))
    return K.governance_events(of, "observation_issued", *K.PAYLOADS["observation_issued"], metadata="more")


@query("""SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'view' AND user_id % 3 = 1""")
def audit_log_in_order(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("model_name"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("version"))
    found = K.audit_log(e, "view", "v1").withColumn("place", F.monotonically_increasing_id())
    return found.select("event_id", F.expr("row_number() OVER (ORDER BY place)").cast("long").alias("position"))


@query("""SELECT c_custkey AS model_hash, CASE WHEN c_custkey % 2 = 0 THEN 'vendor' ELSE 'internal' END AS model_origin, CASE WHEN c_custkey % 3 = 0 THEN 'retired' ELSE 'active' END AS status, '' AS purpose, CASE WHEN c_custkey % 5 > 1 THEN '{"a":1}' ELSE '{}' END AS metadata FROM customer""")
def rows_with_defaults(spark, d):
    key = F.col("c_custkey")
    rows = read(spark, d, "customer").select(key.alias("model_hash"), F.when(key % 2 == 0, "vendor").alias("model_origin"), F.when(key % 3 == 0, "retired").alias("status"), F.when(key % 5 > 1, '{"a":1}').when(key % 5 > 0, "").alias("metadata"))
    return K.with_defaults(rows)


_RULES = " UNION ALL ".join(f"SELECT model_hash, '{rule}' AS rule_id, {severity} AS severity FROM f WHERE {test}" for rule, test, severity in CONDITIONS["sr_11_7"])


@query(f"""WITH {M}, f AS ({R.FIELDS}), v AS ({_RULES}) SELECT 'inventory' AS section, name AS model_name, name AS item, '{{"owner":"' || owner || '","tier":"' || tier || '"}}' AS detail FROM m UNION ALL SELECT 'version', name, tier, '{{"version":"' || tier || '"}}' FROM m
  UNION ALL SELECT 'audit', m.name, CAST(event_id AS VARCHAR), '{{"event_id":' || event_id || '}}' FROM events JOIN m ON m.model_hash = 'm' || user_id WHERE event_type = 'error'
  UNION ALL SELECT 'observation', m.name, 'OBS-' || event_id, '{{"observation_id":"OBS-' || event_id || '"}}' FROM events JOIN m ON m.model_hash = 'm' || user_id WHERE event_type = 'view'
  UNION ALL SELECT 'validation', name, rule_id, '{{"rule_id":"' || rule_id || '","severity":"' || severity || '"}}' FROM v JOIN m USING (model_hash)""")
def audit_packs_whole(spark, d):
    """The audit packs of all models with all details and the findings of a profile."""
    m = models(spark, d).withColumnRenamed("name", "model_name")
    e = read(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model_hash")).join(m.select("model_hash", "model_name"), "model_hash")
    audit = K.matching(e, event_type="error").select("model_name", "event_id")
    seen = K.matching(e, event_type="view").select("model_name", F.concat(F.lit("OBS-"), F.col("event_id").cast("string")).alias("observation_id"))
    findings = R.violations(R.governed(models(spark, d)), "sr_11_7").join(m.select("model_hash", "model_name"), "model_hash").select("model_name", "rule_id", "severity")
    return K.audit_pack(m.select("model_name", "owner", "tier"), m.select("model_name", F.col("tier").alias("version")), audit, seen, findings)
