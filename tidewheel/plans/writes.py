"""Queries over the write side: an import from raw nodes to all rows that it adds, and recorded events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discover as D
from ..operators import membership as B
from ..sources import nodes as N
from ..sources.store import stored
from ..tables import INTERNAL_EVENTS, M, ledger, models, read
from .catalog import G_, ISO, membership_sql, ntz, query

PORT = "STRUCT<identifier:STRING,schema:MAP<STRING,STRING>>"


def raw_nodes(spark, d, at: str) -> DataFrame:
    """A node a supplier that sells, with its parts as outputs, and one a part that is sold, with itself as input."""
    li = read(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    port = lambda c: N.one_port(F.concat(F.lit("T"), text(c)), F.create_map(F.lit("kind"), F.lit("k")))
    none, plain = F.expr(f"CAST(array() AS ARRAY<{PORT}>)"), F.expr("CAST(map() AS MAP<STRING,STRING>)")
    status = F.get(F.array(F.lit("Deprecated"), F.lit("odd"), F.lit(None).cast("string")), (F.col("l_suppkey") % 3).cast("int"))
    meta = F.map_filter(F.create_map(F.lit("owner"), F.concat(F.lit("o"), (F.col("l_suppkey") % 7).cast("string")), F.lit("node_type"), F.lit("etl"), F.lit("team"), F.concat(F.lit("t"), text("l_suppkey")), F.lit("status"), status), lambda k, v: v.isNotNull())
    up = li.groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("keys"))  # keys, not texts: they are small in the shuffle
    ids = F.sort_array(F.transform("keys", lambda k: F.concat(F.lit("t"), k.cast("string"))))
    outputs = F.transform(ids, lambda x: N.one_port(x, F.create_map(F.lit("kind"), F.lit("k"))))
    up = up.select(F.concat(F.lit("u"), text("l_suppkey")).alias("name"), F.lit("db").alias("platform"), none.alias("inputs"), outputs.alias("outputs"), meta.alias("metadata"))
    down = li.select("l_partkey").distinct().select(F.concat(F.lit("n"), text("l_partkey")).alias("name"), F.lit("").alias("platform"), F.array(port("l_partkey")).alias("inputs"), none.alias("outputs"), plain.alias("metadata"))
    return up.unionByName(down).withColumn("seen_at", ntz(at))


def imports(spark, d) -> tuple[DataFrame, D.Staged]:
    """(models before, the second of two imports). The first has the suppliers with even keys, those not divisible by 4 with other
    metadata, and the parts divisible by 4; then the even suppliers join groups; the second has all nodes."""
    key = F.substr("name", F.lit(2)).cast("long")
    sold = stored(raw_nodes(spark, d, "2024-06-01 00:00:00"), "raw")
    early = sold.where(F.when(F.col("name").startswith("u"), key % 2 == 0).otherwise(key % 4 == 0)).withColumn("seen_at", ntz("2024-01-01 00:00:00"))
    early = early.withColumn("metadata", F.when(F.col("name").startswith("u") & (key % 4 > 0), F.create_map(F.lit("owner"), F.lit("old"), F.lit("node_type"), F.lit("etl"))).otherwise(F.col("metadata")))
    none = spark.createDataFrame([], "model_hash string, name string, owner string, model_type string, tier string, purpose string, model_origin string, status string, created_at timestamp_ntz, last_seen timestamp_ntz")
    empty = spark.createDataFrame([], "snapshot_hash string, model_hash string, timestamp timestamp_ntz, event_type string, actor string, source string, payload string")
    first = D.ingest(early, none, empty)
    m = first.models
    joins = m.where("name LIKE 'u%'").select(F.concat(F.lit("g"), (key % 5).cast("string")).alias("group_hash"), F.col("name").alias("member"))
    added = D.log_rows(B.group_events(joins, m, "member_added").withColumn("timestamp", ntz("2024-02-01 00:00:00")))
    return m, D.ingest(sold, m, lambda: stored(first.events.unionByName(added).where(F.col("event_type").isin(*D.READ)), "log"))


NODES = """sold AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS p FROM lineitem), up AS (SELECT DISTINCT u FROM sold), dn AS (SELECT DISTINCT p FROM sold),
  nodes AS (SELECT 'u' || u AS name, u AS k, true AS supplier, 'o' || (u % 7) AS owner, 'etl' AS model_type, CASE WHEN u % 3 = 0 THEN 'deprecated' ELSE 'active' END AS status FROM up
    UNION ALL SELECT 'n' || p, p, false, 'unknown', 'unknown', 'active' FROM dn),
  n AS (SELECT *, CASE WHEN supplier THEN k % 2 = 0 ELSE k % 4 = 0 END AS was, supplier AND k % 4 = 2 AS differs FROM nodes),
  h AS (SELECT *, CASE WHEN differs THEN 'old' ELSE owner END AS first_owner, CASE WHEN was THEN '2024-01-01' ELSE '2024-06-01' END AS born FROM n),
  e AS (SELECT *, substr(sha256(name || ':' || first_owner || ':' || born || 'T00:00:00+00:00'), 1, 32) AS model_hash, NOT was OR differs AS added FROM h)"""


@query(f"WITH {NODES} SELECT model_hash, name, first_owner AS owner, model_type, status, CAST(born AS TIMESTAMP) AS created_at, TIMESTAMP '2024-06-01' AS last_seen FROM e")
def import_models(spark, d):
    """The rows of models after an import from raw nodes."""
    return imports(spark, d)[1].models.select("model_hash", "name", "owner", "model_type", "status", "created_at", "last_seen")


@query(f"""WITH {NODES}, l AS (SELECT a.model_hash AS uh, b.model_hash AS dh, a.name AS un, b.name AS dn FROM sold JOIN e a ON a.name = 'u' || sold.u JOIN e b ON b.name = 'n' || sold.p WHERE NOT (sold.u % 2 = 0 AND sold.p % 4 = 0))
  SELECT event_type, model_hash, other, count(*) AS n FROM (SELECT 'registered' AS event_type, model_hash, owner AS other FROM e WHERE NOT was UNION ALL SELECT 'discovered', model_hash, CASE WHEN supplier THEN 't' || k END FROM e WHERE added
    UNION ALL SELECT 'has_dependent', uh, dn FROM l UNION ALL SELECT 'depends_on', dh, un FROM l UNION ALL SELECT 'member_changed', 'g' || (k % 5), name FROM e WHERE differs) GROUP BY ALL""")
def import_events(spark, d):
    """The events that an import adds: registrations, discoveries, links and changes of groups, each with whom it is about."""
    p = F.from_json("payload", "owner string, team string, upstream string, downstream string, member_name string")
    other = F.when(F.col("event_type") == "registered", p["owner"]).otherwise(F.coalesce(p["team"], p["upstream"], p["downstream"], p["member_name"]))
    # Dealt by model: an event's neighbours often are of the same one, so hashes are small in the shuffle.
    return imports(spark, d)[1].events.select("event_type", "model_hash", other.alias("other")).repartition("model_hash").groupBy("event_type", "model_hash", "other").agg(F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT count(*) FILTER (added) AS models_added, count(*) FILTER (NOT added) AS models_skipped, (SELECT count(*) FROM sold WHERE NOT (u % 2 = 0 AND p % 4 = 0)) AS links_created, (SELECT count(*) FROM sold WHERE u % 2 = 0 AND p % 4 = 0) AS links_skipped FROM e")
def import_counts(spark, d):
    return imports(spark, d)[1].counts


@query(f"WITH {NODES} SELECT name, first_owner AS owner, model_type, CASE WHEN supplier THEN 'db' ELSE '' END AS platform, status FROM e")
def import_summaries(spark, d):
    return imports(spark, d)[1].summaries


#: Every event of the log once more, as a user would record it by the model's name: errors for users that no model has, registrations
#: of new names, and of old ones.
ASKED = """SELECT event_id AS i, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'Ghost#' || user_id WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'New#' || user_id ELSE 'Customer#' || lpad(CAST(user_id AS STRING), 9, '0') END AS model_name,
  CASE event_type WHEN 'signup' THEN 'registered' WHEN 'click' THEN 'retrained' WHEN 'error' THEN 'not_found' WHEN 'view' THEN 'validated' ELSE 'deployed' END AS event, '{"i":' || event_id || '}' AS payload, 'actor' || (event_id % 7) AS actor, ts AS {ts}, 'o' || (event_id % 5) AS owner FROM {events}"""


def recorded(spark, d) -> D.Recorded:
    asked = spark.sql(ASKED.replace('{"i"', '{{"i"').replace("'}'", "'}}'").replace("{ts}", "timestamp").replace("{events}", "{e}"), e=read(spark, d, "events")).withColumns({"model_type": F.lit(None).cast("string"), "purpose": F.lit(None).cast("string")})
    return D.record(stored(asked, "asked"), models(spark, d).select("model_hash", "name"), ledger(spark, d))


RECORDED = f"""{M}, {G_}, {membership_sql()}, q AS ({ASKED.replace("{events}", "events").replace("{ts}", '"timestamp"').replace("AS STRING", "AS VARCHAR")}),
  f AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY "timestamp", payload) AS rn FROM q WHERE event = 'registered' AND model_name NOT IN (SELECT name FROM m)),
  born AS (SELECT model_name, owner, "timestamp" AS created, i, actor, substr(sha256(model_name || ':' || owner || ':' || {ISO}), 1, 32) AS model_hash FROM f WHERE rn = 1),
  rows AS (SELECT q.i, model_name, q.event, q.actor, q."timestamp", coalesce(m.model_hash, born.model_hash) AS model_hash, coalesce(born.i = q.i, false) AS is_new_model,
    CASE WHEN born.i = q.i THEN '{{"model_origin":"internal","name":"' || model_name || '","owner":"' || q.owner || '","purpose":"","tier":"unclassified"}}' ELSE q.payload END AS payload
    FROM q LEFT JOIN m ON m.name = model_name LEFT JOIN born USING (model_name)),
  answered AS (SELECT *, substr(sha256(model_hash || ':' || {ISO} || ':' || payload), 1, 32) AS event_id FROM rows WHERE model_hash IS NOT NULL)"""


@query(f"""WITH {RECORDED} SELECT model_name, model_hash, event_id, "timestamp", is_new_model FROM answered""")
def record_events(spark, d):
    """What recording every event of the log by name answers."""
    return recorded(spark, d).told


@query(f"""WITH {RECORDED} SELECT event_type, model_hash, "timestamp", actor, count(*) AS n FROM (SELECT event AS event_type, model_hash, "timestamp", actor FROM answered
  UNION ALL SELECT 'member_changed', group_hash, "timestamp", actor FROM answered JOIN member ON member_hash = model_hash WHERE event NOT IN {INTERNAL_EVENTS}) GROUP BY ALL""")
def record_log(spark, d):
    """The rows that the log gets for it, change events of groups among them."""
    return recorded(spark, d).events.groupBy("event_type", "model_hash", "timestamp", "actor").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDED} SELECT model_name, count(*) AS n FROM rows WHERE model_hash IS NULL GROUP BY 1")
def record_errors(spark, d):
    return recorded(spark, d).errors.groupBy("model_name").agg(F.count("*").alias("n"))


#: A group for each ten models by their names, and one name that nobody has; every third group has the name of a model.
GROUPS = """g AS (SELECT CAST(substr(model_hash, 2) AS BIGINT) AS i, model_hash AS mh, name AS mn FROM m), gr AS (SELECT i // 10 AS k, CASE WHEN i // 10 % 3 = 0 THEN 'Customer#' || lpad(CAST(i // 10 AS VARCHAR), 9, '0') ELSE 'Group ' || (i // 10) END AS name, mh, mn FROM g),
  gh AS (SELECT DISTINCT k, name, CASE WHEN k % 3 = 0 THEN 'm' || k ELSE substr(sha256(name || ':o' || (k % 4) || ':2024-07-01T00:00:00+00:00'), 1, 32) END AS hash FROM gr)"""


@query(f"""WITH {M}, {GROUPS} SELECT hash AS model_hash, 'registered' AS event_type, 'a' AS actor, '{{"name":"' || name || '","owner":"o' || (k % 4) || '","tier":"high","purpose":"p","model_origin":"internal"}}' AS payload FROM gh WHERE k % 3 > 0
  UNION ALL SELECT hash, 'depends_on', 'a', '{{"upstream":"' || mn || '","upstream_hash":"' || mh || '","relationship":"member_of"}}' FROM gr JOIN gh USING (k) UNION ALL SELECT mh, 'has_dependent', 'a', '{{"downstream":"' || gh.name || '","downstream_hash":"' || hash || '","relationship":"member_of"}}' FROM gr JOIN gh USING (k)""")
def register_whole_groups(spark, d):
    """Groups and their members in one step."""
    m = models(spark, d)
    k = F.floor(F.substr("model_hash", F.lit(2)).cast("long") / 10)
    of = m.groupBy(k.alias("k")).agg(F.concat(F.collect_list("name"), F.array(F.lit("nobody"))).alias("members"))
    text = F.col("k").cast("string")
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(text, 9, "0"))).otherwise(F.concat(F.lit("Group "), text))
    asked = of.select(name.alias("name"), F.concat(F.lit("o"), (F.col("k") % 4).cast("string")).alias("owner"), F.lit("composite").alias("model_type"), F.lit("high").alias("tier"), F.lit("p").alias("purpose"), "members", F.lit("a").alias("actor"), ntz("2024-07-01 00:00:00").alias("timestamp"))
    return D.register_groups(asked, m)[1].select("model_hash", "event_type", "actor", "payload")


CHANGES = """SELECT event_id AS i, 'm' || (user_id - user_id % 10) AS composite, CASE event_id % 3 WHEN 0 THEN 'm' || user_id WHEN 1 THEN 'Customer#' || lpad(CAST(user_id AS {t}), 9, '0') ELSE 'Ghost ' || user_id END AS member, user_id, event_type = 'error' AS removed, CASE WHEN event_id % 5 > 1 THEN 'n' || (event_id % 5) END AS note, 'a' || (event_id % 4) AS actor, ts AS at_time FROM {e}"""


@query(f"""WITH {M}, q AS ({CHANGES.format(t="VARCHAR", e="events")}), k AS (SELECT q.*, c.name AS cn, x.name AS mn, x.model_hash AS mh FROM q JOIN m c ON c.model_hash = composite JOIN m x ON x.model_hash = 'm' || user_id WHERE i % 3 < 2)
  SELECT composite AS model_hash, CASE WHEN removed THEN 'member_removed' ELSE 'member_added' END AS event_type, at_time AS "timestamp", actor, '{{"member_name":"' || mn || '","member_hash":"' || mh || '"' || CASE WHEN note IS NULL THEN '' WHEN removed THEN ',"reason":"' || note || '"' ELSE ',"role":"' || note || '"' END || '}}' AS payload FROM k
  UNION ALL SELECT composite, 'depends_on', at_time, actor, '{{"upstream":"' || mn || '","upstream_hash":"' || mh || '","relationship":"member_of"}}' FROM k WHERE NOT removed UNION ALL SELECT mh, 'has_dependent', at_time, actor, '{{"downstream":"' || cn || '","downstream_hash":"' || composite || '","relationship":"member_of"}}' FROM k WHERE NOT removed""")
def member_events(spark, d):
    """Additions with roles and removals with reasons, by name and by hash; an addition links too."""
    asked = spark.sql(CHANGES.format(t="STRING", e="{e}"), e=read(spark, d, "events")).withColumnRenamed("at_time", "timestamp")
    return D.change_members(asked, models(spark, d))[0].select("model_hash", "event_type", "timestamp", "actor", "payload")


@query(f"""WITH {M}, x AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'New ' || (c_custkey // 4) END AS name, min(c_custkey) AS k FROM customer GROUP BY 1) SELECT 'registered_model' AS action, name AS model_name, '{{"tier":"t' || (k % 3) || '"}}' AS details, 'a' || (k % 5) AS actor FROM x WHERE name NOT IN (SELECT name FROM m)""")
def register_audit(spark, d):
    """The audit events of registering models of which some exist, and some come twice."""
    key = F.col("c_custkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    name = F.when(key % 2 == 0, F.col("c_name")).otherwise(text("New ", F.floor(key / 4)))
    asked = read(spark, d, "customer").select(name.alias("name"), text("t", key % 3).alias("tier"), text("a", key % 5).alias("actor"), F.timestamp_seconds(key).cast("timestamp_ntz").alias("timestamp"))
    return D.register_audited(asked, models(spark, d))[1].select("action", "model_name", "details", "actor")
