"""Queries whose data reach the rarer cases: pages in full detail, summaries, open periods, and links whose references clash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import membership as B
from ..operators import timeline as L
from ..sources.store import stored
from ..tables import M, S, known, ledger, models, snapshots
from .catalog import SINCE, UNTIL, WHEN, ntz, query
from .lookups import CLASH, clashing

#: Payloads with keys that a page keeps and keys that it drops; every third event has only k.
RICH = """CASE WHEN i % 3 = 0 THEN '{"k":' || k || '}' ELSE '{"note":"n' || (i % 7) || '","name":"dropped","via":"x","deep":{"a":' || (i % 5) || '},"k":' || k || ',"none":null}' END"""
RICH_S = f"x AS (SELECT * EXCLUDE payload, {RICH} AS payload FROM (SELECT *, CAST(substr(snapshot_hash, 2) AS BIGINT) AS i FROM s) y WHERE \"timestamp\" <= TIMESTAMP '{WHEN}')"
#: Every model feeds the next one of its ten, and the one after it.
FEEDS = "SELECT a.model_hash AS uh, a.name AS un, b.model_hash AS dh, b.name AS dn FROM {m} a JOIN {m} b ON CAST(substr(b.model_hash, 2) AS BIGINT) - CAST(substr(a.model_hash, 2) AS BIGINT) IN (1, 2) AND CAST(substr(a.model_hash, 2) AS BIGINT) % 10 < 7"


def feeds(m: DataFrame) -> DataFrame:
    """upstream (a name), downstream (a hash): FEEDS as a join by equal keys."""
    key = F.substr("model_hash", F.lit(2)).cast("long")
    own = m.where(key % 10 < 7).select(F.col("name").alias("upstream"), F.explode(F.array(key + 1, key + 2)).alias("key"))
    return own.join(m.select(key.alias("key"), F.col("model_hash").alias("downstream")), "key").select("upstream", "downstream")


@query(f"""WITH {M}, {S}, {RICH_S}, fd AS ({FEEDS.format(m="m")}),
  last AS (SELECT model_hash, arg_max(k, ("timestamp", snapshot_hash)) AS k, arg_max(i % 7, ("timestamp", snapshot_hash)) FILTER (i % 3 <> 0) AS note, arg_max(i % 5, ("timestamp", snapshot_hash)) FILTER (i % 3 <> 0) AS deep, count(*) AS n,
    md5(string_agg(snapshot_hash, '|' ORDER BY "timestamp" DESC, snapshot_hash DESC)) AS events FROM x GROUP BY 1),
  up AS (SELECT dh AS model_hash, string_agg(un, '|' ORDER BY un) AS upstream FROM fd GROUP BY 1), dn AS (SELECT uh AS model_hash, string_agg(dn, '|' ORDER BY dn) AS downstream FROM fd GROUP BY 1)
  SELECT model_hash, coalesce(n, 0) AS total_events, coalesce(events, md5('')) AS events, CASE WHEN n IS NULL THEN NULL WHEN note IS NULL THEN 'k=' || k ELSE 'deep={{"a":' || deep || '}}|k=' || k || '|none=~|note=n' || note END AS metadata, coalesce(upstream, '') AS upstream, coalesce(downstream, '') AS downstream
  FROM m LEFT JOIN last USING (model_hash) LEFT JOIN up USING (model_hash) LEFT JOIN dn USING (model_hash)""")
def investigate_full(spark, d):
    """Every model's page in full detail: all events, all metadata, both sides of its links."""
    m = models(spark, d)
    s = snapshots(spark, d).withColumn("i", F.substr("snapshot_hash", F.lit(2)).cast("long")).withColumn("payload", F.expr(RICH)).drop("i")
    links = G.dependencies(stored(B.link_events(feeds(m), m), "feeds"), m, known(spark, d))
    none = B.facts(ledger(spark, d), m, ntz(WHEN), ("validated",), known(spark, d))
    page = L.investigate(m, s, B.membership(ledger(spark, d), m, known=known(spark, d)), none, links, ntz(WHEN), None)
    entries = F.array_sort(F.map_entries("metadata"))
    text = lambda c: F.array_join(c, "|").alias(c)
    meta = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~")))), "|")
    return page.select("model_hash", "total_events", F.md5(F.coalesce(F.array_join("recent_events.snapshot_hash", "|"), F.lit(""))).alias("events"), meta.alias("metadata"), text("upstream"), text("downstream"))


@query(f"""WITH {M}, {S} SELECT snapshot_hash, "timestamp", event_type, actor, coalesce(name, s.model_hash) AS model_name, CASE WHEN CAST(k AS BIGINT) % 2 = 0 THEN 'changed ' || k END AS summary FROM s LEFT JOIN m USING (model_hash)
  WHERE "timestamp" >= TIMESTAMP '{SINCE}' AND event_type = 'retrained' ORDER BY "timestamp" DESC, snapshot_hash DESC LIMIT 60 OFFSET 10""")
def changelog_summaries(spark, d):
    """A page of the changelog whose events have summaries, or none."""
    s = snapshots(spark, d).withColumn("payload", F.when(F.col("k").cast("long") % 2 == 0, F.concat(F.lit('{"summary":"changed '), "k", F.lit('","k":1}'))).otherwise('{"k":1}'))
    return L.changelog(s, models(spark, d), 10, 60, ntz(SINCE), None, "retrained")


@query(f"""WITH {S} SELECT 'since' AS bounds, count(*) AS total, count(*) > 70 AS has_more, 'last ' || (date_diff('second', TIMESTAMP '{SINCE}', CAST(now() AT TIME ZONE 'UTC' AS TIMESTAMP)) // 86400) || ' days' AS period FROM s WHERE "timestamp" >= TIMESTAMP '{SINCE}'
  UNION ALL SELECT 'until', count(*), count(*) > 70, 'all time' FROM s WHERE "timestamp" <= TIMESTAMP '{UNTIL}' UNION ALL SELECT 'none', count(*), count(*) > 70, 'last 7 days' FROM s WHERE "timestamp" >= CAST(now() AT TIME ZONE 'UTC' AS TIMESTAMP) - INTERVAL '7' DAY""")
def changelog_report_open(spark, d):
    """What goes with pages that have one bound, or none."""
    s = snapshots(spark, d)
    report = lambda name, *bounds: L.changelog_report(s, 20, 50, *bounds).withColumn("bounds", F.lit(name))
    return report("since", ntz(SINCE)).unionByName(report("until", None, ntz(UNTIL))).unionByName(report("none"))


#: Links on either side, by hash, by a hash that no model has, or by none, with a name that a model has, or another's hash, or nobody's.
LINKS = """SELECT snapshot_hash, model_hash, CASE WHEN i % 2 = 0 THEN 'depends_on' ELSE 'has_dependent' END AS event_type,
  CASE i % 4 WHEN 0 THEN 'm' || k WHEN 1 THEN 'm' || (CAST(k AS BIGINT) + 1) WHEN 2 THEN 'm9999999' || k END AS ref, CASE i % 5 WHEN 0 THEN 'nobody' WHEN 1 THEN 'm' || (CAST(k AS BIGINT) + 1) ELSE 'Customer#' || lpad(k, 9, '0') END AS told, CASE WHEN i % 3 = 0 THEN 'feeds' END AS relationship
  FROM (SELECT *, CAST(substr(snapshot_hash, 2) AS BIGINT) AS i FROM {s}) y"""


@query(f"""WITH {M}, {S}, c AS ({CLASH}m), l AS ({LINKS.format(s="s")})
  SELECT l.model_hash, CASE event_type WHEN 'depends_on' THEN 'upstream' ELSE 'downstream' END AS direction, coalesce(relationship, 'depends_on') AS relationship, coalesce(a.model_hash, b.model_hash, d.model_hash, e.model_hash) AS other_hash, coalesce(a.name, b.name, d.name, e.name) AS other_name
  FROM l LEFT JOIN c a ON a.model_hash = ref LEFT JOIN c b ON b.name = ref LEFT JOIN c d ON d.model_hash = told LEFT JOIN c e ON e.name = told WHERE coalesce(a.model_hash, b.model_hash, d.model_hash, e.model_hash) IS NOT NULL""")
def dependencies_both_ways(spark, d):
    """Links of both kinds over models some of which are named like another's hash."""
    m = clashing(spark, d)
    return G.dependencies(link_log(spark, d), m, B.names(m))


def link_log(spark, d) -> DataFrame:
    rows = spark.sql(LINKS.format(s="{s}"), s=snapshots(spark, d))
    up = F.col("event_type") == "depends_on"
    field = lambda side, c, v: F.when(up if side == "upstream" else ~up, F.col(v)).alias(c)
    payload = F.to_json(F.struct(*[field(x, f"{x}{end}", v) for x in ("upstream", "downstream") for end, v in (("_hash", "ref"), ("", "told"))], "relationship"))
    return rows.select("snapshot_hash", "model_hash", "event_type", payload.alias("payload"))
