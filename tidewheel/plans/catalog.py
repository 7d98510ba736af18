"""Every query of the engine by name: a function of (spark, sf_dir), and SQL over the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import membership as B
from ..operators import records as K
from ..operators import timeline as L
from ..sources import nodes as N
from ..tables import INTERNAL_EVENTS, E, M, S, V, edges, known, ledger, models, read, snapshots
from . import rules as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def membership_sql(until: str = "", name: str = "member") -> str:
    """CTEs over g and m that give group_hash, member_hash: of each pair the latest operation, where a link counts as an addition
    before all others."""
    when = f"""WHERE "timestamp" <= TIMESTAMP '{until}'""" if until else ""
    return f"""ops AS (SELECT model_hash AS group_hash, event_type, "timestamp", snapshot_hash, json_extract_string(payload, ['$.upstream_hash', '$.relationship', '$.member_hash', '$.member_name']) AS f FROM g {when}),
    known AS (SELECT model_hash AS ref, model_hash, 0 AS rank FROM m UNION ALL SELECT name, model_hash, 1 FROM m),
    told AS (SELECT group_hash, arg_min(known.model_hash, rank) AS member_hash, NULL::TIMESTAMP AS since, '' AS tie, true AS isin FROM ops JOIN known ON ref = f[1] WHERE event_type = 'depends_on' AND f[2] = 'member_of' GROUP BY snapshot_hash, group_hash
      UNION ALL SELECT group_hash, coalesce(f[3], ''), "timestamp", snapshot_hash, event_type = 'member_added' FROM ops WHERE event_type = 'member_removed' OR event_type = 'member_added' AND EXISTS (SELECT 1 FROM known WHERE ref IN (f[3], f[4]))),
    {name} AS (SELECT group_hash, member_hash FROM told GROUP BY group_hash, member_hash HAVING arg_max(isin, (coalesce(since, TIMESTAMP '0001-01-01'), tie)))"""


OPENED = """opened AS (SELECT model_hash AS group_hash, json_extract_string(payload, '$.observation_id') AS observation_id FROM g WHERE event_type IN ('observation_issued', 'observation_resolved') AND coalesce(json_extract_string(payload, '$.observation_id'), '') <> ''
  GROUP BY ALL HAVING count(*) FILTER (event_type = 'observation_issued') > 0 AND count(*) FILTER (event_type = 'observation_resolved') = 0)"""
VALIDATED = """validated AS (SELECT model_hash AS group_hash, max("timestamp") AS last_validated FROM g WHERE event_type = 'validated' GROUP BY 1)"""
G_ = f"{S}, {V}"


def summary_sql(types: str) -> str:
    return f"""WITH {M}, {G_}, {membership_sql()}, {OPENED}, {VALIDATED}
    SELECT m.model_hash, name, owner, model_type, tier, status, coalesce(c.n, 0) AS member_count, coalesce(o.n, 0) AS open_observation_count, last_validated, metadata
    FROM m LEFT JOIN (SELECT group_hash, count(*) AS n FROM member GROUP BY 1) c ON c.group_hash = model_hash
    LEFT JOIN (SELECT group_hash, count(*) AS n FROM opened GROUP BY 1) o ON o.group_hash = model_hash
    LEFT JOIN validated v ON v.group_hash = model_hash WHERE model_type IN ({types})"""


@query(summary_sql("'composite'"))
def composite_summary(spark, d):
    return B.composite_summary(models(spark, d), ledger(spark, d), known=known(spark, d))


@query(summary_sql("'composite', 'building'"))
def composite_summary_custom_types(spark, d):
    return B.composite_summary(models(spark, d), ledger(spark, d), ("composite", "building"), known(spark, d))


@query(f"WITH {M}, {G_}, {membership_sql()} SELECT * FROM member")
def current_membership(spark, d):
    return B.membership(ledger(spark, d), models(spark, d), known=known(spark, d))


WHEN = "2024-01-12 00:00:00"


@query(f"WITH {M}, {G_}, {membership_sql(WHEN)} SELECT * FROM member")
def membership_at(spark, d):
    return B.membership(ledger(spark, d), models(spark, d), ntz(WHEN), known(spark, d))


@query(f"WITH {M}, {G_}, {membership_sql()} SELECT member_hash, count(*) AS n_groups, min(group_hash) AS first_group FROM member GROUP BY 1")
def groups_of_model(spark, d):
    return B.membership(ledger(spark, d), models(spark, d), known=known(spark, d)).groupBy("member_hash").agg(F.count("*").alias("n_groups"), F.min("group_hash").alias("first_group"))


@query(f"WITH {G_}, {OPENED} SELECT * FROM opened")
def open_observations(spark, d):
    return B.open_observations(ledger(spark, d))


@query(f"WITH {G_}, {VALIDATED} SELECT * FROM validated")
def last_validated(spark, d):
    return B.last_validated(ledger(spark, d))


def inventory_sql(extra: str = "") -> str:
    return f"""WITH {M}, {S}, st AS (SELECT model_hash, arg_max(event_type, ("timestamp", snapshot_hash)) AS last_type FROM s WHERE "timestamp" < TIMESTAMP '{WHEN}' {extra} GROUP BY 1)
    SELECT m.*, last_type FROM m JOIN st USING (model_hash) WHERE created_at <= TIMESTAMP '{WHEN}' AND last_type <> 'not_found'"""


@query(inventory_sql())
def inventory_at(spark, d):
    return L.inventory_at(models(spark, d), snapshots(spark, d), ntz(WHEN))


@query(inventory_sql("AND source = 'etl'"))
def inventory_at_platform(spark, d):
    return L.inventory_at(models(spark, d), snapshots(spark, d), ntz(WHEN), "etl")


@query(f"""WITH {S} SELECT * FROM s WHERE model_hash = 'm7'""")
def history(spark, d):
    return L.history(snapshots(spark, d), "m7")


LATEST = """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY model_hash ORDER BY "timestamp" DESC, snapshot_hash DESC) AS rn FROM s) WHERE rn = 1"""


@query(f"WITH {S} {LATEST}")
def latest_snapshot(spark, d):
    return B.latest(snapshots(spark, d), "model_hash")


SINCE, UNTIL = "2024-01-05 00:00:00", "2024-02-20 00:00:00"


@query(f"""WITH {M}, {S} SELECT snapshot_hash, "timestamp", event_type, actor, coalesce(name, s.model_hash) AS model_name, json_extract_string(payload, '$.summary') AS summary FROM s LEFT JOIN m USING (model_hash)
  WHERE "timestamp" >= TIMESTAMP '{SINCE}' AND "timestamp" <= TIMESTAMP '{UNTIL}' ORDER BY "timestamp" DESC, snapshot_hash DESC LIMIT 50 OFFSET 20""")
def changelog_page(spark, d):
    return L.changelog(snapshots(spark, d), models(spark, d), 20, 50, ntz(SINCE), ntz(UNTIL))


@query(f"""WITH {M}, {S} SELECT snapshot_hash, "timestamp", event_type, actor, name AS model_name, json_extract_string(payload, '$.summary') AS summary FROM s JOIN m USING (model_hash)
  WHERE name = 'Customer#000000007' AND "timestamp" <= TIMESTAMP '{UNTIL}' ORDER BY "timestamp" DESC, snapshot_hash DESC LIMIT 20""")
def changelog_of_model(spark, d):
    return L.changelog(snapshots(spark, d), models(spark, d), 0, 20, None, ntz(UNTIL), None, "m7")


@query(f"""WITH {S} SELECT count(*) AS total, count(*) > 70 AS has_more, '2024-01-05 to 2024-02-20' AS period FROM s WHERE "timestamp" BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'""")
def changelog_report(spark, d):
    return L.changelog_report(snapshots(spark, d), 20, 50, ntz(SINCE), ntz(UNTIL))


@query(f"""WITH {S} SELECT event_type, count(*) AS total FROM s WHERE "timestamp" >= TIMESTAMP '{SINCE}' AND "timestamp" <= TIMESTAMP '{UNTIL}' GROUP BY 1""")
def changelog_total(spark, d):
    return L.between(snapshots(spark, d), ntz(SINCE), ntz(UNTIL)).groupBy("event_type").agg(F.count("*").alias("total"))


@query(f"WITH {M} SELECT * FROM m WHERE contains(lower(name), 'mach') OR contains(lower(purpose), 'mach')")
def query_text_search(spark, d):
    return L.text_search(models(spark, d), "MACH")


@query(f"WITH {M} SELECT name, owner, model_type, status FROM m WHERE status = 'active' AND tier = 'high' ORDER BY name, model_hash LIMIT 30 OFFSET 10")
def query_filtered_page(spark, d):
    return L.page(models(spark, d).where("status = 'active' AND tier = 'high'"), 10, 30, F.col("name"), F.col("model_hash")).select("name", "owner", "model_type", "status")


@query(f"WITH {M} SELECT status, tier, count(*) AS n FROM m GROUP BY ALL")
def count_models(spark, d):
    return models(spark, d).groupBy("status", "tier").agg(F.count("*").alias("n"))


PLATFORMS = """pf AS (SELECT model_hash, coalesce(arg_max(p, ("timestamp", snapshot_hash)) FILTER (event_type = 'discovered' AND p IS NOT NULL), arg_max(source, ("timestamp", snapshot_hash)) FILTER (source IS NOT NULL)) AS platform
  FROM (SELECT *, json_extract_string(payload, '$.platform') AS p FROM s) GROUP BY 1)"""


@query(f"""WITH {M}, {S}, {PLATFORMS} SELECT name, owner, model_type, status, platform, last_event, coalesce(n, 0) AS event_count FROM m
  LEFT JOIN (SELECT model_hash, max("timestamp") AS last_event, count(*) AS n FROM s GROUP BY 1) USING (model_hash) LEFT JOIN pf USING (model_hash)""")
def model_summaries(spark, d):
    return L.model_summaries(models(spark, d), snapshots(spark, d))


@query(f"WITH {S}, {PLATFORMS} SELECT * FROM pf")
def platform_resolution(spark, d):
    return L.platforms(snapshots(spark, d))


#: Payloads of mixed types with keys in any order, and the canonical form that each must have: written apart.
MIXED = """CASE CAST(k AS INTEGER) % 6 WHEN 0 THEN '{"b":' || k || ',"a":"' || k || '","updated_at":"' || snapshot_hash || '"}' WHEN 1 THEN '{"a":' || k || ', "b" : "' || k || '"}' WHEN 2 THEN '{"a":null,"b":[3,{"z":true,"y":null}]}'
  WHEN 3 THEN '{"z":{"d":"x","c":' || k || '},"_content_hash":"q","a":"say ' || chr(92) || '"hi' || chr(92) || '"' || chr(92) || 'n"}' WHEN 4 THEN '{"b":"x"}' ELSE '{"change_detected":' || substr(snapshot_hash, 2) || ',"b":"x"}' END"""
CANONICAL = """CASE CAST(k AS INTEGER) % 6 WHEN 0 THEN '{"a":"' || k || '","b":' || k || '}' WHEN 1 THEN '{"a":' || k || ',"b":"' || k || '"}' WHEN 2 THEN '{"a":null,"b":[3,{"y":null,"z":true}]}'
  WHEN 3 THEN '{"a":"say ' || chr(92) || '"hi' || chr(92) || '"' || chr(92) || 'n","z":{"c":' || k || ',"d":"x"}}' ELSE '{"b":"x"}' END"""
HASHED = f"h AS (SELECT *, sha256({CANONICAL}) AS h FROM s)"


def mixed(spark, d) -> DataFrame:
    return snapshots(spark, d).withColumn("payload", F.expr(MIXED))


@query(f"""WITH {S}, {HASHED} SELECT model_hash, arg_max(h, ("timestamp", snapshot_hash)) AS content_hash FROM h GROUP BY 1""")
def content_hash_latest(spark, d):
    s = mixed(spark, d).withColumn("h", I.content_hash(F.col("payload")))
    return s.groupBy("model_hash").agg(F.max_by("h", F.struct("timestamp", "snapshot_hash")).alias("content_hash"))


@query(f"""WITH {S}, {HASHED}, old AS (SELECT model_hash, arg_max(h, ("timestamp", snapshot_hash)) AS before FROM h WHERE "timestamp" < TIMESTAMP '{WHEN}' GROUP BY 1),
  b AS (SELECT h.model_hash, h, coalesce(lag(h) OVER (PARTITION BY h.model_hash ORDER BY "timestamp", snapshot_hash), before) AS previous FROM h LEFT JOIN old USING (model_hash) WHERE "timestamp" >= TIMESTAMP '{WHEN}')
  SELECT model_hash, count(*) FILTER (h IS DISTINCT FROM previous) AS added, count(*) FILTER (h IS NOT DISTINCT FROM previous) AS skipped FROM b GROUP BY 1""")
def add_dedup(spark, d):
    s = mixed(spark, d).select("model_hash", "snapshot_hash", "timestamp", "payload")
    found = I.add(s.where(F.col("timestamp") < ntz(WHEN)), s.where(F.col("timestamp") >= ntz(WHEN)))
    return found.groupBy("model_hash").agg(F.count_if("is_new").alias("added"), F.count_if(~F.col("is_new")).alias("skipped"))


@query(f"""WITH {S}, r AS (SELECT *, CASE CAST(k AS INTEGER) % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'Retired' WHEN 2 THEN '' ELSE 'unknown' END AS raw FROM s),
  n AS (SELECT *, CASE WHEN lower(raw) IN ('development', 'review', 'active', 'deprecated', 'retired') THEN lower(raw) END AS st FROM r)
  SELECT model_hash, arg_max(st, ("timestamp", snapshot_hash)) AS status FROM n WHERE st IS NOT NULL GROUP BY 1""")
def status_propagation(spark, d):
    k = F.col("k").cast("int") % 4
    raw = F.when(k == 0, "ACTIVE").when(k == 1, "Retired").when(k == 2, "").otherwise("unknown")
    return I.last_status(snapshots(spark, d), raw)


def ports(spark, d, schema: bool):
    """Outputs of every supplier and inputs of a node a part, each part a table of its own; schemas tell parts apart too."""
    e = edges(spark, d).where("src LIKE 'u%'")
    part = F.substr("dst", F.lit(2)).cast("int")
    of = F.create_map(F.lit("part"), F.concat(F.lit("P"), part.cast("string"))) if schema else F.expr("CAST(map() AS MAP<STRING,STRING>)")
    wild = F.create_map(F.lit("part"), F.concat(F.lit("p"), (part - part % 2).cast("string"), F.lit("%"))) if schema else of
    port = F.concat(F.lit("Items:"), part.cast("string"))
    out = e.select(F.col("src").alias("node"), port.alias("identifier"), wild.alias("schema"))
    return out, e.select(F.concat(F.lit("n"), "dst").alias("node"), F.upper(port).alias("identifier"), of.alias("schema")).dropDuplicates(["node", "identifier"])


PORTS = f"""WITH {E}, p AS (SELECT *, CAST(substr(dst, 2) AS INTEGER) AS part FROM e WHERE src LIKE 'u%'),
  o AS (SELECT src AS upstream, 'items:' || part AS identifier, 'p' || (part - part % 2) AS prefix FROM p),
  i AS (SELECT DISTINCT 'n' || dst AS downstream, 'items:' || part AS identifier, 'p' || part AS v FROM p)
  SELECT upstream, downstream, min(identifier) AS identifier FROM o JOIN i USING (identifier)"""


@query(PORTS + " GROUP BY 1, 2")
def port_connect(spark, d):
    return G.port_matches(*ports(spark, d, False))


@query(PORTS + " WHERE starts_with(v, prefix) GROUP BY 1, 2")
def port_connect_discriminated(spark, d):
    return G.port_matches(*ports(spark, d, True))


@query(PORTS + " WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = upstream AND e.dst = substr(downstream, 2) AND CAST(substr(e.dst, 2) AS INTEGER) % 3 = 0) GROUP BY 1, 2")
def connect_new_edges(spark, d):
    old = edges(spark, d).where("src LIKE 'u%'").where(F.substr("dst", F.lit(2)).cast("int") % 3 == 0).select(F.col("src").alias("upstream"), F.concat(F.lit("n"), "dst").alias("downstream"))
    return G.port_matches(*ports(spark, d, False)).join(old, ["upstream", "downstream"], "left_anti")


def all_ports(spark, d, schema: bool):
    """Output ports of every supplier; an identifier is shared by four parts, so none is hot whatever the table's size."""
    e = edges(spark, d).where("src LIKE 'u%'")
    part = F.substr("dst", F.lit(2)).cast("int")
    of = F.create_map(F.lit("part"), F.concat(F.lit("P"), part.cast("string"))) if schema else F.expr("CAST(map() AS MAP<STRING,STRING>)")
    wild = F.create_map(F.lit("part"), F.concat(F.lit("p"), (F.floor(part / 10)).cast("string"), F.lit("%"))) if schema else of
    port = F.concat(F.lit("Items:"), F.floor(part / 4).cast("string"))
    out = e.select(F.col("src").alias("node"), port.alias("identifier"), wild.alias("schema"))
    return out, e.select(F.concat(F.lit("n"), "dst").alias("node"), F.upper(port).alias("identifier"), of.alias("schema")).dropDuplicates(["node", "identifier"])


ALL_PORTS = f"""WITH {E}, p AS (SELECT *, CAST(substr(dst, 2) AS INTEGER) AS part FROM e WHERE src LIKE 'u%'),
  o AS (SELECT src AS upstream, 'items:' || (part // 4) AS identifier, 'p' || (part // 10) AS prefix FROM p),
  i AS (SELECT DISTINCT 'n' || dst AS downstream, 'items:' || (part // 4) AS identifier, 'p' || part AS v FROM p)
  SELECT upstream, downstream, min(identifier) AS identifier FROM o JOIN i USING (identifier)"""


@query(ALL_PORTS + " GROUP BY 1, 2")
def port_connect_all(spark, d):
    return G.port_matches(*all_ports(spark, d, False))


@query(ALL_PORTS + " WHERE starts_with(v, prefix) GROUP BY 1, 2")
def port_connect_discriminated_all(spark, d):
    return G.port_matches(*all_ports(spark, d, True))


@query(ALL_PORTS + " WHERE starts_with(v, prefix) AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = upstream AND e.dst = substr(downstream, 2)) GROUP BY 1, 2")
def connect_new_edges_all(spark, d):
    old = edges(spark, d).select(F.col("src").alias("upstream"), F.concat(F.lit("n"), "dst").alias("downstream"))
    return G.port_matches(*all_ports(spark, d, True)).join(old, ["upstream", "downstream"], "left_anti")


DEPENDENCIES = """deps AS (SELECT l.model_hash, 'upstream' AS direction, relationship, coalesce(b.model_hash, a.model_hash, c.model_hash) AS other_hash, coalesce(b.name, a.name, c.name) AS other_name FROM
  (SELECT model_hash, json_extract_string(payload, '$.upstream_hash') AS ref, json_extract_string(payload, '$.upstream') AS told, coalesce(json_extract_string(payload, '$.relationship'), 'depends_on') AS relationship FROM g WHERE event_type = 'depends_on') l
  LEFT JOIN m b ON b.model_hash = ref LEFT JOIN m a ON a.name = ref LEFT JOIN m c ON c.name = told WHERE coalesce(b.model_hash, a.model_hash, c.model_hash) IS NOT NULL)"""


@query(f"WITH {M}, {G_}, {DEPENDENCIES} SELECT * FROM deps")
def dependencies_direct(spark, d):
    m = models(spark, d)
    return G.dependencies(ledger(spark, d), m, known(spark, d))


@query(f"WITH {E} SELECT dst AS model_hash, src AS upstream FROM e")
def dependencies_all(spark, d):
    return edges(spark, d).select(F.col("dst").alias("model_hash"), F.col("src").alias("upstream"))


@query(f"""WITH {M}, {S}, t AS (SELECT snapshot_hash, model_hash, CASE WHEN CAST(k AS INTEGER) % 2 = 0 THEN 'm' || k ELSE 'm9999999' || k END AS up_hash, 'Customer#' || lpad(k, 9, '0') AS up_name FROM s WHERE gov_type = 'depends_on')
  SELECT t.snapshot_hash, t.model_hash, coalesce(a.model_hash, b.model_hash) AS upstream_hash FROM t LEFT JOIN m a ON a.model_hash = up_hash LEFT JOIN m b ON b.name = up_name WHERE coalesce(a.model_hash, b.model_hash) IS NOT NULL""")
def dependencies_name_fallback(spark, d):
    m, s = models(spark, d), snapshots(spark, d).where("gov_type = 'depends_on'")
    by_hash = F.when(F.col("k").cast("int") % 2 == 0, F.concat(F.lit("m"), "k")).otherwise(F.concat(F.lit("m9999999"), "k"))
    t = s.select("snapshot_hash", "model_hash", by_hash.alias("up_hash"), F.concat(F.lit("Customer#"), F.lpad("k", 9, "0")).alias("up_name"))
    a, b = m.select(F.col("model_hash").alias("up_hash"), F.col("model_hash").alias("a")), m.select(F.col("name").alias("up_name"), F.col("model_hash").alias("b"))
    out = t.join(a, "up_hash", "left").join(b, "up_name", "left").select("snapshot_hash", "model_hash", F.coalesce("a", "b").alias("upstream_hash"))
    return out.where("upstream_hash IS NOT NULL")


def closure_sql(roots: str, src: str = "src", dst: str = "dst") -> str:
    return f"""WITH RECURSIVE {E}, walk AS (SELECT DISTINCT {src} AS root, {src} AS node, 0 AS hops FROM e WHERE {roots} UNION SELECT root, {dst}, hops + 1 FROM walk JOIN e ON e.{src} = node),
    reach AS (SELECT root, node, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE node <> root GROUP BY 1, 2)"""


def reach(spark, d, roots: str, up: bool = False) -> DataFrame:
    e = edges(spark, d)
    if up:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.closure(e, e.where(roots.replace("dst", "src") if up else roots).select(F.col("src").alias("root")), at_hand=True)


@query(closure_sql("dst LIKE 'u%'", "dst", "src") + " SELECT root, node FROM reach")
def upstream_closure(spark, d):
    return reach(spark, d, "dst LIKE 'u%'", True).select("root", "node")


@query(closure_sql("src LIKE 'u%'") + " SELECT root, node FROM reach")
def downstream_closure(spark, d):
    return reach(spark, d, "src LIKE 'u%'").select("root", "node")


@query(closure_sql("dst LIKE 'p%'", "dst", "src") + " SELECT root, node FROM reach")
def upstream_closure_all(spark, d):
    return reach(spark, d, "dst LIKE 'p%'", True).select("root", "node")


@query(closure_sql("src LIKE 'n%'") + " SELECT root, node FROM reach")
def downstream_closure_all(spark, d):
    return reach(spark, d, "src LIKE 'n%'").select("root", "node")


@query(closure_sql("src LIKE 'r%'") + " SELECT * FROM reach WHERE hops <= 2")
def trace_hops(spark, d):
    return reach(spark, d, "src LIKE 'r%'").where("hops <= 2")


@query(closure_sql("src LIKE 'r%'") + " SELECT root, hops, count(*) AS n FROM reach GROUP BY 1, 2")
def impact_counts(spark, d):
    return reach(spark, d, "src LIKE 'r%'").groupBy("root", "hops").agg(F.count("*").alias("n"))


#: A graph with diamonds and shortcuts: the edges, a link from each part to the next two of its ten, and one past them.
DIAMONDS = """d AS (SELECT * FROM e UNION ALL SELECT DISTINCT 'p' || p_partkey, 'p' || (p_partkey + j) FROM part, (SELECT unnest([1, 2, 5]) AS j) WHERE p_partkey % 10 + j < 10)"""


def diamonds(spark, d) -> DataFrame:
    return edges(spark, d).unionByName(shortcuts(spark, d))


def shortcuts(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    more = read(spark, d, "part").select(key, F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("j")).where(key % 10 + F.col("j") < 10)
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return more.select(name(key).alias("src"), name(key + F.col("j")).alias("dst")).distinct()


@query(f"""WITH RECURSIVE {E}, {DIAMONDS}, up AS (SELECT 'p17' AS node, 0 AS hops UNION SELECT src, hops + 1 FROM up JOIN d ON dst = node),
  down AS (SELECT node, 0 AS level FROM (SELECT DISTINCT node FROM up) u WHERE node NOT IN (SELECT dst FROM d) UNION SELECT dst, level + 1 FROM down JOIN d ON src = node WHERE dst IN (SELECT node FROM up)),
  l AS (SELECT node, max(level) AS level FROM down GROUP BY 1)
  SELECT node, CAST(level AS INTEGER) AS level, CAST(min(hops) AS INTEGER) AS hops, row_number() OVER (ORDER BY level, node) AS position FROM l JOIN up USING (node) GROUP BY node, level""")
def trace_order(spark, d):
    return G.trace_order(diamonds(spark, d), "p17")


#: The same graph with a link back to the third part before, from two of each ten, so that parts lie on cycles.
LOOPS = f"""{DIAMONDS}, c AS (SELECT * FROM d UNION ALL SELECT DISTINCT 'p' || p_partkey, 'p' || (p_partkey - 3) FROM part WHERE p_partkey % 10 IN (4, 9)),
  reach AS (SELECT DISTINCT src AS a, dst AS b FROM c WHERE src IN (SELECT dst FROM c) UNION SELECT a, dst FROM reach JOIN c ON src = b),
  cyc AS (SELECT x.a AS node, min(x.b) AS component, count(DISTINCT x.b) AS members FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)"""


def loops(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    back = read(spark, d, "part").where((key % 10).isin(4, 9)).select(name(key).alias("src"), name(key - 3).alias("dst")).distinct()
    return diamonds(spark, d).unionByName(back)


@query(f"WITH RECURSIVE {E}, {LOOPS} SELECT * FROM cyc")
def cycle_components(spark, d):
    found = G.strong_components(loops(spark, d))
    return found.join(found.groupBy("component").agg(F.count("*").alias("members")), "component").select("node", "component", "members")


@query(f"""WITH RECURSIVE {E}, {LOOPS}, up AS (SELECT 'p17' AS node, 0 AS hops UNION SELECT src, hops + 1 FROM up JOIN c ON dst = node WHERE hops < 30),
  u AS (SELECT node, coalesce(any_value(component), node) AS unit, min(hops) AS hops FROM up LEFT JOIN cyc USING (node) GROUP BY node),
  l AS (SELECT DISTINCT a.unit AS src, b.unit AS dst FROM c JOIN u a ON c.src = a.node JOIN u b ON c.dst = b.node WHERE a.unit <> b.unit),
  down AS (SELECT DISTINCT unit, 0 AS level FROM u WHERE unit NOT IN (SELECT dst FROM l) UNION SELECT dst, level + 1 FROM down JOIN l ON src = unit)
  SELECT node, CAST(level AS INTEGER) AS level, CAST(hops AS INTEGER) AS hops, row_number() OVER (ORDER BY level, unit, hops DESC, node) AS position
  FROM u JOIN (SELECT unit, max(level) AS level FROM down GROUP BY 1) USING (unit)""")
def trace_order_on_cycles(spark, d):
    return G.trace_order(loops(spark, d), "p17")


@query(f"""WITH {M}, {G_}, {membership_sql()} SELECT group_hash, s.model_hash AS member_hash, 'member_changed' AS event_type, event_type AS cause, snapshot_hash AS cause_hash, "timestamp"
  FROM s JOIN member ON member_hash = s.model_hash WHERE event_type NOT IN {INTERNAL_EVENTS}""")
def member_changed_fanout(spark, d):
    s = snapshots(spark, d)
    own = s.where(~F.col("event_type").isin(*INTERNAL_EVENTS))
    return B.member_changed(own, B.membership(ledger(spark, d), models(spark, d), known=known(spark, d)))


ISO = """strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime("timestamp", '%f') = '000000' THEN '' ELSE strftime("timestamp", '.%f') END || '+00:00'"""


@query(f"""WITH {M}, {G_}, {membership_sql()}, r AS (SELECT group_hash, "timestamp", actor, '{{"member_hash":"' || s.model_hash || '","member_name":"' || name || '","original_event_type":"' || event_type || '","original_snapshot_hash":"' || snapshot_hash || '"}}' AS sorted,
    '{{"member_name":"' || name || '","member_hash":"' || s.model_hash || '","original_event_type":"' || event_type || '","original_snapshot_hash":"' || snapshot_hash || '"}}' AS payload FROM s JOIN member ON member_hash = s.model_hash JOIN m ON m.model_hash = s.model_hash WHERE event_type NOT IN {INTERNAL_EVENTS})
  SELECT substr(sha256(group_hash || ':' || {ISO} || ':' || sorted), 1, 32) AS snapshot_hash, group_hash AS model_hash, "timestamp", actor, 'member_changed' AS event_type, payload FROM r""")
def member_changed_events(spark, d):
    m = models(spark, d)
    return B.change_events(snapshots(spark, d), B.membership(ledger(spark, d), m, known=known(spark, d)), m)


@query(f"WITH {E} SELECT src AS model_hash, 'has_dependent' AS event_type, dst AS other_hash FROM e UNION ALL SELECT dst, 'depends_on', src FROM e")
def mirrored_edges(spark, d):
    return I.mirrored(edges(spark, d))


@query(f"""WITH {S}, kv AS (SELECT model_hash, unnest(['k', 'actor']) AS key, unnest([k, actor]) AS value, "timestamp", snapshot_hash FROM s)
  SELECT model_hash, key, arg_max(value, ("timestamp", snapshot_hash)) AS value FROM kv GROUP BY 1, 2""")
def metadata_merge(spark, d):
    s = snapshots(spark, d)
    return L.merged_metadata(s.withColumn("payload", F.to_json(F.create_map(F.lit("k"), F.col("k"), F.lit("actor"), F.col("actor")))))


@query("SELECT event_type AS name, min(ts) AS first_output, max(ts) AS last_output, count(*) AS total_rows FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def pipelines_from_table(spark, d):
    return N.pipelines(read(spark, d, "events"), "event_type", "ts")


#: A scan by etl: what has an event after WHEN, and as many names that no model has, some with an enrichment.
SCAN = f"""c AS (SELECT name, CASE WHEN length(name) > 5 AND CAST(substr(model_hash, 2) AS BIGINT) % 4 = 0 THEN 'x' END AS more FROM m WHERE model_hash IN (SELECT model_hash FROM s WHERE "timestamp" >= TIMESTAMP '{WHEN}' AND source = 'etl')
    UNION ALL SELECT 'new' || n_nationkey, NULL FROM nation),
  ours AS (SELECT DISTINCT model_hash FROM s WHERE source = 'etl' AND event_type IN ('discovered', 'scan_confirmed')),
  ev AS (SELECT name, CASE WHEN name IN (SELECT name FROM m) THEN 'scan_confirmed' ELSE 'discovered' END AS event_type FROM c UNION ALL SELECT name, 'enriched' FROM c WHERE more IS NOT NULL
    UNION ALL SELECT name, 'not_found' FROM m JOIN ours USING (model_hash) WHERE name NOT IN (SELECT name FROM c))"""


def scanned(spark, d):
    m, s = models(spark, d), snapshots(spark, d)
    now = s.where((F.col("timestamp") >= ntz(WHEN)) & (F.col("source") == "etl")).select("model_hash").distinct()
    more = F.when(F.substr("model_hash", F.lit(2)).cast("long") % 4 == 0, '{"team":"x"}')
    found = m.join(now, "model_hash").select("name", more.alias("enrichment"))
    new = read(spark, d, "nation").select(F.concat(F.lit("new"), "n_nationkey").alias("name"), F.lit("{}").alias("enrichment"))
    return I.scan(m, s, found.unionByName(new), "etl")


@query(f"WITH {M}, {S}, {SCAN} SELECT * FROM ev")
def scan_reconcile(spark, d):
    return scanned(spark, d)[0]


@query(f"""WITH {M}, {S}, {SCAN} SELECT count(*) FILTER (event_type IN ('discovered', 'scan_confirmed')) AS total_found, count(*) FILTER (event_type = 'discovered') AS new_models,
  count(*) FILTER (event_type = 'scan_confirmed') AS updated_models, count(*) FILTER (event_type = 'not_found') AS not_found_models FROM ev""")
def scan_report(spark, d):
    return scanned(spark, d)[1]


@query(f"""WITH {S} SELECT max("timestamp") AS at FROM s WHERE source = 'ml'""")
def last_scan(spark, d):
    return I.last_scan(snapshots(spark, d), "ml")


@query(f"""WITH {S}, a AS (SELECT DISTINCT model_hash FROM s WHERE "timestamp" < TIMESTAMP '{WHEN}'), b AS (SELECT DISTINCT model_hash FROM s WHERE "timestamp" >= TIMESTAMP '{WHEN}')
  SELECT coalesce(a.model_hash, b.model_hash) AS model_hash, CASE WHEN a.model_hash IS NULL THEN 'discovered' WHEN b.model_hash IS NULL THEN 'not_found' ELSE 'scan_confirmed' END AS outcome FROM a FULL JOIN b USING (model_hash)""")
def scan_reconcile_all(spark, d):
    s = snapshots(spark, d)
    return I.reconcile(s.where(F.col("timestamp") < ntz(WHEN)), s.where(F.col("timestamp") >= ntz(WHEN)))


#: A text with every feature, made from columns; ~ stands for a quotation mark.
TEXT_SQL = """replace('-- @owner: ' || o_orderpriority || chr(10) || '  -- @note:' || chr(10) || '-- @tier: a:b ' || chr(10) || '--@x: no' || chr(10) || 'INSERT INTO out.t' || o_custkey || ' SELECT * FROM raw.a.t' || (o_orderkey % 7) || ' x JOIN Raw.A.T' || (o_orderkey % 5)
  || ' y WHERE model_name = ~m' || o_custkey || '~ AND model_name IN (~a~, ~b' || (o_orderkey % 3) || '~) AND d > INTERVAL ~' || (o_orderkey % 30) || ' days~ {{run_' || o_orderstatus || '}}.{{ t }}', '~', chr(39))"""


def sql_texts(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.expr(TEXT_SQL).alias("sql"))


O = f"WITH q AS (SELECT o_orderkey, {TEXT_SQL} AS sql FROM orders)"


def listed(column) -> object:
    return F.array_join(column, "|")


@query(f"{O} SELECT o_orderkey, a || CASE WHEN lower(a) = lower(b) THEN '' ELSE '|' || b END AS tables FROM (SELECT o_orderkey, regexp_extract(sql, 'FROM (\\S+)', 1) AS a, regexp_extract(sql, 'JOIN (\\S+)', 1) AS b FROM q)")
def sql_read_tables(spark, d):
    return sql_texts(spark, d).select("o_orderkey", listed(T.read_tables(F.col("sql"))).alias("tables"))


@query(f"{O} SELECT o_orderkey, regexp_extract(sql, 'INTO (\\S+)', 1) AS tables FROM q")
def sql_write_tables(spark, d):
    return sql_texts(spark, d).select("o_orderkey", listed(T.write_tables(F.col("sql"))).alias("tables"))


@query("SELECT o_orderkey, 'm' || o_custkey || '|a|b' || (o_orderkey % 3) AS models FROM orders")
def sql_model_filters(spark, d):
    return sql_texts(spark, d).select("o_orderkey", listed(T.model_filters(F.col("sql"))).alias("models"))


@query("SELECT o_orderkey, (o_orderkey % 30) || ' days' AS lookback, 'note=|owner=' || o_orderpriority || '|tier=a:b' AS tags, 'run_' || o_orderstatus || '.{{ t }}' AS template FROM orders")
def sql_lookback_tags_templates(spark, d):
    q = sql_texts(spark, d)
    tags = F.array_join(F.transform(F.array_sort(F.map_entries(T.comment_tags(F.col("sql")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return q.select("o_orderkey", T.lookback(F.col("sql")).alias("lookback"), tags.alias("tags"), F.regexp_extract(T.strip_templates(F.col("sql")), r"(\S+ \{\{ t \}\}|\S+\.\{\{ t \}\})$", 1).alias("template"))


CRON = "CASE o_orderkey % 7 WHEN 0 THEN (o_orderkey % 60) || ' ' || (o_custkey % 24) || ' * * *' WHEN 1 THEN '0 */' || (1 + o_custkey % 12) || ' * * *' WHEN 2 THEN '5 ' || (o_custkey % 24) || ' ' || (1 + o_orderkey % 31) || ' * *' WHEN 3 THEN '0 9 * * ' || (o_custkey % 7) WHEN 4 THEN 'x y' WHEN 5 THEN '' ELSE '30 0 1,' || (2 + o_orderkey % 29) || ' * *' END"


@query(f"""WITH c AS (SELECT o_orderkey, o_custkey, {CRON} AS cron, o_custkey % 24 AS h, o_orderkey % 60 AS mi, CASE WHEN o_orderkey % 7 = 6 THEN 2 + o_orderkey % 29 ELSE 1 + o_orderkey % 31 END AS dom FROM orders),
  t AS (SELECT *, CAST(CASE WHEN h = 0 THEN 12 WHEN h <= 12 THEN h ELSE h - 12 END AS VARCHAR) AS h12, CASE WHEN h < 12 THEN ' AM UTC' ELSE ' PM UTC' END AS ap,
    dom || CASE WHEN dom BETWEEN 10 AND 20 THEN 'th' WHEN dom % 10 = 1 THEN 'st' WHEN dom % 10 = 2 THEN 'nd' WHEN dom % 10 = 3 THEN 'rd' ELSE 'th' END AS nth FROM c)
  SELECT o_orderkey, cron, CASE o_orderkey % 7 WHEN 0 THEN 'Daily at ' || h12 || ':' || lpad(CAST(mi AS VARCHAR), 2, '0') || ap WHEN 1 THEN 'Every ' || (1 + o_custkey % 12) || ' hours'
    WHEN 2 THEN nth || ' of each month at ' || h12 || ':05' || ap
    WHEN 3 THEN 'Every ' || ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][1 + o_custkey % 7] || ' at 9:00 AM UTC' WHEN 4 THEN 'Custom schedule: x y (UTC)'
    WHEN 5 THEN 'Not scheduled' ELSE '1st, ' || nth || ' of each month at 12:30 AM UTC' END AS english FROM t""")
def cron_english(spark, d):
    c = read(spark, d, "orders").select("o_orderkey", F.expr(CRON).alias("cron"))
    return c.select("o_orderkey", "cron", T.cron_in_english(F.col("cron")).alias("english"))


@query(f"""WITH {S}, t AS (SELECT model_hash, 'tag' || (CAST(k AS INTEGER) % 3) AS tag, "timestamp", snapshot_hash FROM s)
  SELECT model_hash, tag, arg_max(snapshot_hash, ("timestamp", snapshot_hash)) AS snapshot_hash, max("timestamp") AS updated_at FROM t GROUP BY 1, 2""")
def tags_current(spark, d):
    t = snapshots(spark, d).select("model_hash", F.concat(F.lit("tag"), (F.col("k").cast("int") % 3).cast("string")).alias("tag"), "timestamp", "snapshot_hash")
    return B.latest(t, "model_hash", "tag").select("model_hash", "tag", "snapshot_hash", F.col("timestamp").alias("updated_at"))


@query(f"WITH {M} SELECT coalesce(nullif(model_type, ''), 'unknown') AS model_type, count(*) AS n FROM m GROUP BY 1")
def type_histogram(spark, d):
    return models(spark, d).groupBy(F.coalesce(F.nullif("model_type", F.lit("")), F.lit("unknown")).alias("model_type")).agg(F.count("*").alias("n"))


FEEDBACK = "f AS (SELECT event_type AS verdict, 'r' || (user_id % 4) AS reason_code, 'stage' || (event_id % 3) AS stage FROM events)"


def feedback(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    code = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    return e.select("event_id", F.col("event_type").alias("verdict"), code("r", "user_id", 4).alias("reason_code"), code("stage", "event_id", 3).alias("stage"))


@query(f"""WITH {FEEDBACK} SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM f UNION ALL SELECT 'verdict', verdict, count(*) FROM f GROUP BY 2
  UNION ALL SELECT 'reason_code', reason_code, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'stage', stage, count(*) FROM f GROUP BY 2""")
def feedback_stats(spark, d):
    return K.feedback_stats(feedback(spark, d))


@query("SELECT event_id, 'stage' || (event_id % 3) AS stage FROM events WHERE event_type = 'click' AND user_id % 4 = 2")
def feedback_query(spark, d):
    return K.matching(feedback(spark, d), verdict="click", reason_code="r2", stage=None).select("event_id", "stage")


#: The rules once more, over the fields as texts: no text is shared with the rules of the profiles.
CONDITIONS = {
    "sr_11_7": [
        ("has_developers", "developers = ''", "'error'"), ("has_validator", "validator = ''", "'error'"),
        ("validator_independence", "validator <> '' AND ',' || developers || ',' LIKE '%,' || validator || ',%'", "'error'"),
        ("has_ipo_structure", "NOT list_has_all(string_split(sections, ','), ['Processing', 'Inputs', 'Outputs'])", "'error'"),
        ("has_governance_document", "documents = ''", "'error'"), ("has_validation_schedule", "next_validation_due IS NULL", "CASE tier WHEN 'high' THEN 'error' ELSE 'warning' END"),
    ],
    "eu_ai_act": [
        ("eu_intended_purpose", "coalesce(strlen(intended_purpose), 0) < 20", "'error'"), ("eu_risk_assessment", "risk_rating IS NULL", "'error'"),
        ("eu_affected_populations", "populations = ''", "CASE tier WHEN 'high' THEN 'error' ELSE 'warning' END"), ("eu_data_governance", "nullif(training_data, '') IS NULL", "'error'"),
        ("eu_transparency_docs", "documents = ''", "'error'"), ("eu_transparency_description", "description IS NULL", "'warning'"), ("eu_human_oversight", "stakeholders = ''", "'warning'"),
        ("eu_accuracy_metrics", "leaf = 'dataset' AND evidence NOT LIKE '%performance_report%'", "'warning'"), ("eu_limitations", "limitations = ''", "'warning'"), ("eu_operating_boundaries", "boundaries IS NULL", "'warning'"),
    ],
    "nist_ai_rmf": [
        ("nist_govern_accountability", "owner IS NULL", "'error'"), ("nist_govern_developers", "developers = ''", "'error'"), ("nist_govern_documentation", "documents = ''", "'error'"),
        ("nist_map_intended_use", "nullif(intended_purpose, '') IS NULL", "'error'"), ("nist_map_restrictions", "restrictions = ''", "'warning'"), ("nist_map_risk_id", "risk_rating IS NULL AND tier = 'high'", "'error'"),
        ("nist_map_harms", "harms = ''", "'warning'"), ("nist_map_stakeholders", "populations = ''", "'warning'"), ("nist_measure_performance", "evidence = '' AND leaf = 'dataset'", "'error'"),
        ("nist_measure_bias", "tier = 'high' AND NOT regexp_matches(lower(evidence), 'bias|fairness') AND NOT regexp_matches(lower(documents), ':[^,]*(bias|fairness)|fair_lending')", "'warning'"),
        ("nist_manage_monitoring", "monitoring_frequency IS NULL AND coalesce(monitoring_status, '') = ''", "'warning'"), ("nist_manage_validation_schedule", "next_validation_due IS NULL", "'warning'"),
        ("nist_manage_incident_response", "tier = 'high' AND documents NOT LIKE '%runbook:%' AND documents NOT LIKE '%escalation_plan:%'", "'warning'"),
    ],
}


for _profile in CONDITIONS:

    def _violations(spark, d, profile=_profile):
        return R.violations(R.governed(models(spark, d)), profile)

    def _verdicts(spark, d, profile=_profile):
        return R.verdicts(R.governed(models(spark, d)), profile)

    QUERIES[f"validate_{_profile}"], QUERIES[f"verdict_{_profile}"] = _violations, _verdicts
    _each = " UNION ALL ".join(f"SELECT model_hash, '{rule}' AS rule_id, {severity} AS severity FROM f WHERE {test}" for rule, test, severity in CONDITIONS[_profile])
    _governed = f"WITH {M}, f AS ({R.FIELDS}), v AS ({_each})"
    SQL[f"validate_{_profile}"] = f"{_governed} SELECT * FROM v"
    SQL[f"verdict_{_profile}"] = f"""{_governed} SELECT f.model_hash, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS passed
      FROM f LEFT JOIN v USING (model_hash) GROUP BY 1"""


@query(f"""WITH {M}, x AS (SELECT model_hash, CAST(substr(model_hash, 2) AS BIGINT) AS i FROM m), y AS (SELECT model_hash, (i % 3 + 1) + (i % 2 + 1) AS a, (i // 3 % 3 + 1) + (i // 5 % 3 + 1) AS b FROM x)
  SELECT model_hash, a + b AS score, CASE WHEN a >= 5 THEN 'high' WHEN a >= 3 THEN 'medium' ELSE 'low' END AS impact, CASE WHEN b >= 5 THEN 'high' WHEN b >= 3 THEN 'medium' ELSE 'low' END AS likelihood,
    CASE WHEN a + b >= 10 THEN 'high' WHEN a + b >= 6 THEN 'medium' ELSE 'low' END AS overall FROM y""")
def risk_rating(spark, d):
    i = F.substr("model_hash", F.lit(2)).cast("long")
    level = lambda k: F.get(F.array(F.lit("low"), F.lit("Medium"), F.lit("HIGH")), k.cast("int"))
    return R.rating(models(spark, d).select("model_hash"), level(i % 3), level(i % 2), level(F.floor(i / 3) % 3), level(F.floor(i / 5) % 3))


@query(f"""WITH {S} SELECT snapshot_hash, event_type FROM s WHERE CAST(k AS INTEGER) >= 90""")
def snapshot_dedup_append(spark, d):
    s = snapshots(spark, d).select("snapshot_hash", "event_type", "k")
    new = s.where("k >= 50")
    return I.append_new(s.where("k < 90"), new.unionAll(new)).select("snapshot_hash", "event_type")


@query(f"""WITH {M} SELECT model_hash, CASE WHEN i % 2 = 0 THEN 'moved' ELSE owner END AS owner, CASE WHEN i % 2 = 0 THEN 'new' ELSE status END AS status, created_at FROM (SELECT *, CAST(substr(model_hash, 2) AS BIGINT) AS i FROM m)
  UNION ALL SELECT 'm_new', 'moved', 'new', TIMESTAMP '2025-01-01'""")
def model_upsert(spark, d):
    old = models(spark, d).select("model_hash", "owner", "status", "created_at")
    row = lambda df: df.select("model_hash", F.lit("moved").alias("owner"), F.lit("new").alias("status"), ntz("2025-01-01 00:00:00").alias("created_at"))
    new = row(old.where(F.substr("model_hash", F.lit(2)).cast("long") % 2 == 0)).unionAll(row(spark.range(1).select(F.lit("m_new").alias("model_hash"))))
    again = new.withColumns({"owner": F.lit("first"), "status": F.lit("new")})  # of two rows with one key the greater wins
    return I.upsert(old, new.unionByName(again), "model_hash")


from . import details, lookups, nested, tools, writes  # noqa: E402, F401  they add their queries
