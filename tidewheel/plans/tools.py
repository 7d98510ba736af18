"""The tools' queries: search, model pages, registration, scans' nodes, connections, and job tables as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import membership as B
from ..operators import records as K
from ..operators import timeline as L
from ..sources import nodes as N
from ..tables import M, S, known, ledger, models, read, snapshots
from .catalog import DEPENDENCIES, G_, OPENED, PLATFORMS, VALIDATED, WHEN, membership_sql, ntz, query


def joined(column: str) -> object:
    return F.array_join(column, "|").alias(column)


@query(f"""WITH {M}, {S}, {PLATFORMS}, f AS (SELECT * FROM m WHERE status = 'active' AND (contains(lower(name), 'build') OR contains(lower(purpose), 'build'))),
  p AS (SELECT * FROM f ORDER BY name, model_hash LIMIT 25 OFFSET 5)
  SELECT name, owner, model_type, status, platform, last_event, coalesce(n, 0) AS event_count, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 30 AS has_more FROM p
  LEFT JOIN (SELECT model_hash, max("timestamp") AS last_event, count(*) AS n FROM s GROUP BY 1) USING (model_hash) LEFT JOIN pf USING (model_hash)""")
def query_tool(spark, d):
    return L.query(models(spark, d), snapshots(spark, d), 5, 25, "BUILD", status="active")


PAGE = f"""WITH {M}, {G_}, {membership_sql()}, {OPENED.replace("FROM g WHERE", f'''FROM g WHERE "timestamp" <= TIMESTAMP '{WHEN}' AND''')}, {VALIDATED.replace("FROM g WHERE", f'''FROM g WHERE "timestamp" <= TIMESTAMP '{WHEN}' AND''')}, {DEPENDENCIES},
  seen AS (SELECT * FROM s WHERE "timestamp" <= TIMESTAMP '{WHEN}'),
  kv AS (SELECT model_hash, arg_max(k, ("timestamp", snapshot_hash)) AS k FROM seen GROUP BY 1),
  rec AS (SELECT model_hash, string_agg(snapshot_hash, '|' ORDER BY "timestamp" DESC, snapshot_hash DESC) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY model_hash ORDER BY "timestamp" DESC, snapshot_hash DESC) AS rn FROM seen) WHERE rn <= 10 GROUP BY 1),
  ct AS (SELECT model_hash, count(*) AS total_events, date_diff('second', max("timestamp"), TIMESTAMP '{WHEN}') // 86400 AS days_since_last_event FROM seen GROUP BY 1),
  up AS (SELECT d.model_hash, string_agg(DISTINCT d.other_name, '|' ORDER BY d.other_name) AS upstream FROM deps d GROUP BY 1),
  gr AS (SELECT member_hash AS model_hash, string_agg(DISTINCT m.name, '|' ORDER BY m.name) AS groups FROM member JOIN m ON m.model_hash = group_hash GROUP BY 1),
  me AS (SELECT group_hash AS model_hash, string_agg(DISTINCT m.name, '|' ORDER BY m.name) AS members FROM member JOIN m ON m.model_hash = member_hash GROUP BY 1),
  oo AS (SELECT group_hash AS model_hash, count(*) AS opened FROM opened GROUP BY 1)
  SELECT model_hash, name, owner, status, coalesce(total_events, 0) AS total_events, days_since_last_event, k, recent, coalesce(upstream, '') AS upstream, coalesce(groups, '') AS groups, coalesce(members, '') AS members,
    CASE WHEN model_type = 'composite' THEN last_validated END AS last_validated, CASE WHEN model_type = 'composite' THEN coalesce(opened, 0) END AS open_observation_count
  FROM m LEFT JOIN ct USING (model_hash) LEFT JOIN kv USING (model_hash) LEFT JOIN rec USING (model_hash) LEFT JOIN up USING (model_hash) LEFT JOIN gr USING (model_hash) LEFT JOIN me USING (model_hash)
  LEFT JOIN validated v ON v.group_hash = m.model_hash LEFT JOIN oo USING (model_hash)"""


@query(PAGE)
def investigate(spark, d):
    """Every model's page as of WHEN."""
    m, s, g = models(spark, d), snapshots(spark, d), ledger(spark, d)
    named = known(spark, d)
    links = G.dependencies(g, m, named)
    found = L.investigate(m, s, B.membership(g, m, known=named), B.facts(g, m, ntz(WHEN), (*B.OBSERVATIONS, "validated"), named), links, ntz(WHEN))
    return found.select(
        "model_hash", "name", "owner", "status", "total_events", "days_since_last_event", F.col("metadata")["k"].alias("k"), F.array_join("recent_events.snapshot_hash", "|").alias("recent"),
        joined("upstream"), joined("groups"), joined("members"), "last_validated", "open_observation_count",
    )


@query(f"WITH {M}, n AS (SELECT c_custkey % 40 AS r, * FROM customer), x AS (SELECT CASE WHEN r < 20 THEN 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE 'New#' || (c_custkey // 3) END AS name, 'o' || (c_custkey % 9) AS owner, TIMESTAMP '2024-05-01' + c_custkey * INTERVAL '1' SECOND AS created_at FROM n), "
       "f AS (SELECT name, arg_min(owner, created_at) AS owner, min(created_at) AS created_at FROM x GROUP BY 1) "
       "SELECT name, owner, created_at, substr(sha256(name || ':' || owner || ':' || strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 32) AS model_hash FROM f WHERE name NOT IN (SELECT name FROM m)")  # fmt: skip
def register_models(spark, d):
    key = F.col("c_custkey")
    c = read(spark, d, "customer")
    name = F.when(key % 40 < 20, F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))).otherwise(F.concat(F.lit("New#"), F.floor(key / 3).cast("string")))
    at = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=key.cast("decimal(18,6)"))
    new = c.select(name.alias("name"), F.concat(F.lit("o"), (key % 9).cast("string")).alias("owner"), F.lit("ml_model").alias("model_type"), F.lit("high").alias("tier"), F.lit("p").alias("purpose"), at.alias("created_at"))
    return I.register(models(spark, d), new)[0].select("name", "owner", "created_at", "model_hash")


@query(f"""WITH {S} SELECT snapshot_hash, substr(sha256(model_hash || ':' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime("timestamp", '%f') = '000000' THEN '' ELSE strftime("timestamp", '.%f') END || '+00:00:{{"k":' || k || '}}'), 1, 32) AS content_address FROM s""")
def event_hashes(spark, d):
    return snapshots(spark, d).select("snapshot_hash", I.snapshot_hash(F.col("model_hash"), F.col("timestamp"), F.col("payload")).alias("content_address"))


def nodes_of(spark, d) -> DataFrame:
    """Nodes that a scan found: one a model, with contents that some models had before, and statuses."""
    i = F.substr("model_hash", F.lit(2)).cast("long")
    status = F.get(F.array(F.lit("ACTIVE"), F.lit("Retired"), F.lit(""), F.lit("odd")), (i % 4).cast("int"))
    return models(spark, d).select("name", F.lit("etl").alias("platform"), status.alias("status"), F.concat(F.lit('{"v": '), (i % 5).cast("string"), F.lit("}")).alias("payload"), ntz("2024-06-01 00:00:00").alias("seen_at"))


ADDED = f"""WITH {M}, n AS (SELECT *, CAST(substr(model_hash, 2) AS BIGINT) AS i FROM m),
  r AS (SELECT model_hash, name, status, i, NOT (i % 2 = 0 AND i % 5 = 2) AS changed FROM n)"""


def added(spark, d):
    m = models(spark, d)
    i = F.substr("model_hash", F.lit(2)).cast("long")
    event = lambda v, at: m.where(i % 2 == 0).select("model_hash", ntz(at).alias("timestamp"), F.lit("s").alias("snapshot_hash"), F.sha2(F.lit(f'{{"v":{v}}}'), 256).alias("content_hash"))
    return I.add_nodes(m.select("model_hash", "name", "status"), event(9, "2024-01-01 00:00:00").unionByName(event(2, "2024-02-01 00:00:00")), nodes_of(spark, d))


@query(ADDED + " SELECT model_hash, name, CASE i % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'retired' ELSE status END AS status FROM r")
def add_models(spark, d):
    return added(spark, d)[0].select("model_hash", "name", "status")


@query(ADDED + """ SELECT model_hash, sha256('{"v":' || (i % 5) || '}') AS content_hash FROM r WHERE changed""")
def add_events(spark, d):
    return added(spark, d)[1].select("model_hash", "content_hash")


@query(ADDED + " SELECT count(*) FILTER (changed) AS added, count(*) FILTER (NOT changed) AS skipped FROM r")
def add_counts(spark, d):
    return added(spark, d)[2]


@query(f"""WITH {M}, {G_}, {membership_sql()}, w AS (SELECT group_hash, member_hash AS ref FROM member UNION ALL SELECT group_hash, 'nobody' FROM member)
  SELECT group_hash AS model_hash, 'member_removed' AS event_type, '{{"member_name":"' || name || '","member_hash":"' || m.model_hash || '"}}' AS payload FROM w JOIN m ON m.model_hash = ref""")
def remove_members(spark, d):
    """Events that remove all members from their groups; a name that no model has gives none."""
    m = models(spark, d)
    pairs = B.membership(ledger(spark, d), m, known=known(spark, d)).select("group_hash", F.col("member_hash").alias("member"))
    return B.group_events(pairs.unionByName(pairs.withColumn("member", F.lit("nobody"))), m, "member_removed")


#: Job rows with every feature that a connector maps.
JOBS = """SELECT o_orderkey AS id, 'job' || o_orderkey AS job, CASE WHEN o_orderkey % 2 = 0 THEN 'Raw.T' || (o_orderkey % 5) END AS src, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'Out.T' || o_custkey END AS dst,
  CASE o_orderkey % 4 WHEN 0 THEN replace('SELECT 1 FROM mart.Scores JOIN mart.plain WHERE model_name = ~a~ OR model_name = ~b~', '~', chr(39)) WHEN 1 THEN 'INSERT INTO mart.alerts SELECT 1 FROM {{db}}.t' WHEN 2 THEN NULL ELSE '' END AS body,
  CASE WHEN o_orderkey % 5 > 0 THEN '0 9 * * *' END AS cron, CASE WHEN o_orderkey % 7 > 0 THEN 'Q' || (o_orderkey % 7) END AS queue, 'slug' || (o_orderkey % 3) AS slug, o_orderpriority AS team FROM orders"""


@query(f"""WITH j AS ({JOBS})
  SELECT 'etl:' || job AS name,
    concat_ws('|', lower(src), CASE id % 4 WHEN 0 THEN 'mart.scores/a|mart.scores/b|mart.plain/' WHEN 1 THEN 'db.t/' END, lower(coalesce(queue, slug)) || '/q') AS inputs,
    concat_ws('|', CASE WHEN dst <> '' THEN lower(dst) END, CASE id % 4 WHEN 1 THEN 'mart.alerts/' || id END) AS outputs,
    concat_ws('|', CASE WHEN cron IS NOT NULL THEN 'cron=0 9 * * *' END, 'node_type=etl', CASE WHEN cron IS NOT NULL THEN 'run_frequency=Daily at 9:00 AM UTC' END, 'team=' || team) AS metadata
  FROM j""")
def sql_nodes(spark, d):
    jobs = spark.sql(JOBS.replace("{{db}}", "{{{{db}}}}").replace("FROM orders", "FROM {orders}"), orders=read(spark, d, "orders")).drop("id")
    n = N.sql_nodes(jobs, "etl", "job", "etl:", ("src",), ("dst",), "body", fallback="job", strip_prefix="job", cron="cron", input_port={"column": "queue", "fallback": "slug", "kind": "q"})
    key = lambda p: F.coalesce(p["schema"]["model_name"], p["schema"]["kind"])
    ports = lambda c, bare: F.array_join(F.transform(c, lambda p: F.concat(p["identifier"], F.when(key(p).isNotNull(), F.concat(F.lit("/"), key(p))).when(F.contains(p["identifier"], F.lit("mart.")) | (p["identifier"] == "db.t"), "/").otherwise(""))), "|").alias(c)
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return n.select("name", ports("inputs", True), ports("outputs", True), meta.alias("metadata"))


#: Items as an API gives them: nested names, an empty port, a null, and numbers.
ITEMS = """'{"info":{"name":"S' || s_suppkey || '","feed":"In.' || s_nationkey || '"},"out":' || CASE s_suppkey % 3 WHEN 0 THEN '""' WHEN 1 THEN 'null' ELSE '"T' || s_suppkey || '"' END || ',"nation":' || s_nationkey || ',"none":null}'"""
ITEM_SQL = "SELECT 'S' || s_suppkey AS name, 'in.' || s_nationkey AS inputs, CASE WHEN s_suppkey % 3 = 2 THEN 't' || s_suppkey ELSE '' END AS outputs, {} AS metadata FROM supplier"


def item_nodes(spark, d, metadata) -> DataFrame:
    items = read(spark, d, "supplier").select(F.expr(ITEMS).alias("item"))
    n = N.json_nodes(items, "api", "info.name", ("info.feed",), ("out",), metadata)
    ids = lambda c: F.array_join(F.transform(c, lambda p: p["identifier"]), "|").alias(c)
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("metadata", lambda k, v: k != "info"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return n.select("name", ids("inputs"), ids("outputs"), meta.alias("metadata"))


@query(ITEM_SQL.format("'nation=' || s_nationkey || '|node_type=api'"))
def json_nodes(spark, d):
    return item_nodes(spark, d, None)


@query(ITEM_SQL.format("'feed=In.' || s_nationkey || '|node_type=' || s_nationkey"))
def json_nodes_mapped(spark, d):
    return item_nodes(spark, d, {"feed": "info.feed", "node_type": "nation", "gone": "none"})


@query(f"WITH {M}, w AS (SELECT DISTINCT 'm' || (user_id * 3) AS model_hash FROM events UNION ALL SELECT '') SELECT m.model_hash, name FROM m WHERE model_hash IN (SELECT model_hash FROM w)")
def models_in_list(spark, d):
    wanted = read(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") * 3).cast("string")).alias("model_hash"))
    return L.models_in(models(spark, d), wanted.unionByName(spark.createDataFrame([("",), (None,)], "model_hash string"))).select("model_hash", "name")


@query(f"""WITH {S}, t AS (SELECT 'tag' || (CAST(k AS INTEGER) % 5) AS name, "timestamp" AS updated_at, snapshot_hash FROM s WHERE model_hash = 'm7'),
  l AS (SELECT name, arg_max(snapshot_hash, (updated_at, snapshot_hash)) AS snapshot_hash, max(updated_at) AS updated_at FROM t GROUP BY 1) SELECT name, snapshot_hash, updated_at, event_type, "timestamp" FROM l JOIN s USING (snapshot_hash)""")
def list_tags(spark, d):
    s = snapshots(spark, d)
    tags = s.select("model_hash", F.concat(F.lit("tag"), (F.col("k").cast("int") % 5).cast("string")).alias("name"), F.col("timestamp").alias("updated_at"), "snapshot_hash")
    return L.tags_of(tags, s, "m7")


@query("SELECT o_orderkey, replace(replace('a/b ' || o_clerk, '/', '_'), ' ', '_') AS file, '1.' || (o_orderkey % 12 + 1) || '.0' AS version FROM (SELECT o_orderkey, o_orderpriority AS o_clerk FROM orders)")
def file_names_and_versions(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", T.file_name(F.concat(F.lit("a/b "), "o_orderpriority")).alias("file"), T.next_version(F.concat(F.lit("1."), (F.col("o_orderkey") % 12).cast("string"), F.lit(".7"))).alias("version"))


def graph_nodes(spark, d) -> DataFrame:
    """A node a supplier, whose outputs are its parts, and one a part; their discovered events, read back from the log."""
    li = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    out = li.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.concat(F.lit('{"identifier":"T'), F.col("l_partkey").cast("string"), F.lit('","kind":"K"}')))).alias("o"))
    up = out.select(F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("name"), F.concat(F.lit('{"platform":"db","outputs":['), F.array_join("o", ","), F.lit("]}")).alias("payload"))
    part = F.col("l_partkey").cast("string")
    down = li.select("l_partkey").distinct().select(F.concat(F.lit("n"), part).alias("name"), F.concat(F.lit('{"platform":"db","inputs":[{"identifier":"t'), part, F.lit('","kind":"k%"}]}')).alias("payload"))
    both = up.unionByName(down).withColumns({"model_hash": F.concat(F.lit("h:"), "name"), "event_type": F.lit("discovered"), "timestamp": ntz("2024-01-01 00:00:00"), "snapshot_hash": F.lit("s")})
    return N.logged_nodes(both, both.select("model_hash", "name"))


CONNECTED = "WITH l AS (SELECT DISTINCT 'u' || l_suppkey AS upstream, 'n' || l_partkey AS downstream, 't' || l_partkey AS identifier, l_partkey % 4 = 0 AS known FROM lineitem)"


def connected(spark, d):
    li = read(spark, d, "lineitem").where("l_partkey % 4 = 0").select(F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("dst"))
    return G.connect(graph_nodes(spark, d), li)


@query(CONNECTED + " SELECT upstream, downstream, identifier FROM l WHERE NOT known")
def connect_logged_nodes(spark, d):
    return connected(spark, d)[0]


@query(CONNECTED + " SELECT count(*) FILTER (NOT known) AS links_created, count(*) FILTER (known) AS links_skipped FROM l")
def connect_counts(spark, d):
    return connected(spark, d)[1]


@query(CONNECTED + f", {M}, n AS (SELECT CAST(substr(model_hash, 2) AS BIGINT) AS i FROM m), a AS (SELECT count(*) FILTER (NOT (i % 2 = 0 AND i % 5 = 2)) AS models_added, count(*) FILTER (i % 2 = 0 AND i % 5 = 2) AS models_skipped FROM n) "
       "SELECT models_added, models_skipped, CASE WHEN models_added > 0 THEN (SELECT count(*) FROM l WHERE NOT known) ELSE 0 END AS links_created FROM a")  # fmt: skip
def discover_report(spark, d):
    """What an import reports: models added and skipped, and the links that connecting creates if any was added."""
    links = connected(spark, d)[1].select("links_created").scalar()
    return added(spark, d)[2].select(F.col("added").alias("models_added"), F.col("skipped").alias("models_skipped"), F.when(F.col("added") > 0, links).otherwise(F.lit(0).cast("long")).alias("links_created"))


GROUPED = "p AS (SELECT m.name AS upstream, 'm' || (CAST(substr(model_hash, 2) AS BIGINT) // 10 * 10) AS downstream, model_hash AS uh FROM m)"


@query(f"""WITH {M}, {GROUPED}, b AS (SELECT p.*, d.name AS dn FROM p JOIN m d ON d.model_hash = downstream)
  SELECT uh AS model_hash, 'has_dependent' AS event_type, '{{"downstream":"' || dn || '","downstream_hash":"' || downstream || '","relationship":"member_of"}}' AS payload FROM b
  UNION ALL SELECT downstream, 'depends_on', '{{"upstream":"' || upstream || '","upstream_hash":"' || uh || '","relationship":"member_of"}}' FROM b""")
def register_group_events(spark, d):
    """The events that put every model into the group of its ten, by name; and links to nobody, which give none."""
    m = models(spark, d)
    group = F.concat(F.lit("m"), (F.floor(F.substr("model_hash", F.lit(2)).cast("long") / 10) * 10).cast("string"))
    pairs = m.select(F.col("name").alias("upstream"), group.alias("downstream"))
    return B.link_events(pairs.unionByName(pairs.withColumn("upstream", F.lit("nobody"))), m, "member_of")


VERSIONS = "SELECT 'm' || (c_custkey // 3) AS model_name, 'v' || (c_custkey % 3) AS version, c_custkey % 4 = 0 AS frozen, 'old' AS note FROM customer"


def saved(spark, d, force: bool) -> DataFrame:
    key = F.col("c_custkey")
    old = read(spark, d, "customer").select(F.concat(F.lit("m"), F.floor(key / 3).cast("string")).alias("model_name"), F.concat(F.lit("v"), (key % 3).cast("string")).alias("version"), (key % 4 == 0).alias("frozen"), F.lit("old").alias("note"))
    new = old.where("version = 'v1'").withColumns({"frozen": F.lit(False), "note": F.lit("new")})
    return K.save_versions(old, new.unionByName(new.withColumn("version", F.lit("v9"))), force)[0]


@query(f"""WITH o AS ({VERSIONS}) SELECT model_name, version, CASE WHEN version = 'v1' AND NOT frozen THEN 'new' ELSE note END AS note FROM o UNION ALL SELECT model_name, 'v9', 'new' FROM o WHERE version = 'v1'""")
def save_versions(spark, d):
    return saved(spark, d, False).drop("frozen")


@query(f"""WITH o AS ({VERSIONS}) SELECT model_name, version, CASE WHEN version = 'v1' THEN 'new' ELSE note END AS note FROM o UNION ALL SELECT model_name, 'v9', 'new' FROM o WHERE version = 'v1'""")
def force_save_versions(spark, d):
    return saved(spark, d, True).drop("frozen")


@query(f"""WITH {M} SELECT 'inventory' AS section, name AS model_name, name AS item FROM m UNION ALL SELECT 'audit', m.name, CAST(event_id AS VARCHAR) FROM events JOIN m ON m.model_hash = 'm' || user_id WHERE event_type = 'error'
  UNION ALL SELECT 'observation', m.name, 'OBS-' || event_id FROM events JOIN m ON m.model_hash = 'm' || user_id WHERE event_type = 'view' UNION ALL SELECT 'version', name, tier FROM m""")
def audit_packs(spark, d):
    m = models(spark, d).withColumnRenamed("name", "model_name")
    e = read(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model_hash")).join(m.select("model_hash", "model_name"), "model_hash")
    audit = K.matching(e, event_type="error").select("model_name", "event_id")
    seen = K.matching(e, event_type="view").select("model_name", F.concat(F.lit("OBS-"), F.col("event_id").cast("string")).alias("observation_id"))
    return K.audit_pack(m.select("model_name", "owner", "tier"), m.select("model_name", F.col("tier").alias("version")), audit, seen).drop("detail")
