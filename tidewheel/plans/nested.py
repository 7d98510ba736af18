"""Queries over nested component trees, groups that are followed as a stream, and pages as of a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import intervals as V_
from ..operators import membership as B
from ..operators import trees as W
from ..sources.store import shared_dir
from ..streaming import groups as Y
from ..tables import M, known, ledger, models, snapshots
from . import rules as R
from .catalog import DEPENDENCIES, G_, OPENED, SQL, VALIDATED, membership_sql, ntz, query

#: A tree of 10 to 12 levels a model: the sections under the root, and in the last of many levels the leaf; siblings on both sides,
#: some with an empty list, or no list, of children.
TREE = """concat('{"name":"root","node_type":"root","children":[', array_join(concat(transform(filter(split(sections, ','), x -> x <> ''), x -> concat('{"name":"', x, '","node_type":"section"}')),
  array(aggregate(sequence(9 + i % 3, 1, -1), concat('{"name":"leaf","node_type":"', leaf, '"}'), (below, j) -> concat('{"children":[{"name":"z', j, '","children":[]},', below, ',{"name":"a', j, '","children":7,"node_type":"x"}],"name":"n', j, '"}')))), ','), ']}')"""
TREES = f"""f AS ({R.FIELDS}), t AS (SELECT model_hash, '{{"name":"root","node_type":"root","children":[' || array_to_string(list_append(list_transform(list_filter(string_split(sections, ','), lambda x: x <> ''), lambda x: '{{"name":"' || x || '","node_type":"section"}}'),
  list_reduce(list_prepend('{{"name":"leaf","node_type":"' || leaf || '"}}', list_transform(range(9 + CAST(substr(model_hash, 2) AS BIGINT) % 3, 0, -1), lambda j: CAST(j AS VARCHAR))),
    lambda below, j: '{{"children":[{{"name":"z' || j || '","children":[]}},' || below || ',{{"name":"a' || j || '","children":7,"node_type":"x"}}],"name":"n' || j || '"}}')), ',') || ']}}' AS tree FROM f)"""


def nested(spark, d) -> DataFrame:
    m = models(spark, d)
    rows = spark.sql(R.FIELDS.replace("FROM m)", "FROM {m})"), m=m).withColumn("i", F.substr("model_hash", F.lit(2)).cast("int"))
    return rows.select("model_hash", F.expr(TREE).alias("tree"))


@query(f"""WITH RECURSIVE {M}, {TREES}, w AS (SELECT model_hash, '' AS path, 0 AS depth, CAST(tree AS JSON) AS node FROM t
    UNION ALL SELECT model_hash, path || lpad(CAST(c.place AS VARCHAR), 4, '0') || '/', depth + 1, json_extract(node, '$.children[' || c.place || ']') FROM w, LATERAL (SELECT unnest(range(0, CAST(coalesce(json_array_length(node, '$.children'), 0) AS BIGINT))) AS place) c)
  SELECT model_hash, path, depth, json_extract_string(node, '$.name') AS name, json_extract_string(node, '$.node_type') AS node_type, row_number() OVER (PARTITION BY model_hash ORDER BY path) AS position FROM w""")
def tree_rows(spark, d):
    """Every node of every model's tree with its path, and its place in pre-order."""
    n = W.flatten(nested(spark, d), "model_hash", "tree").withColumn("path", F.array_join(F.transform("path", lambda p: F.concat(F.lpad(p.cast("string"), 4, "0"), F.lit("/"))), ""))
    return n.selectExpr("*", "CAST(row_number() OVER (PARTITION BY model_hash ORDER BY path) AS BIGINT) AS position")


@query(SQL["validate_sr_11_7"])
def validate_nested_sr_11_7(spark, d):
    return R.violations(W.with_trees(R.governed(models(spark, d)), nested(spark, d)), "sr_11_7")


@query(SQL["validate_eu_ai_act"])
def validate_nested_eu_ai_act(spark, d):
    return R.violations(W.with_trees(R.governed(models(spark, d)), nested(spark, d)), "eu_ai_act")


@query(SQL["validate_nist_ai_rmf"])
def validate_nested_nist_ai_rmf(spark, d):
    return R.violations(W.with_trees(R.governed(models(spark, d)), nested(spark, d)), "nist_ai_rmf")


@query(f"""WITH {M}, {G_}, {membership_sql()}, {OPENED}, {VALIDATED}, k AS (SELECT group_hash FROM member UNION SELECT group_hash FROM opened UNION SELECT group_hash FROM validated)
  SELECT group_hash, coalesce(a.n, 0) AS member_count, coalesce(b.n, 0) AS open_observation_count, last_validated FROM k LEFT JOIN (SELECT group_hash, count(*) AS n FROM member GROUP BY 1) a USING (group_hash)
  LEFT JOIN (SELECT group_hash, count(*) AS n FROM opened GROUP BY 1) b USING (group_hash) LEFT JOIN validated USING (group_hash)""")
def streamed_groups(spark, d):
    """Where every group stands after the whole log has arrived as a stream, some files a batch, in no order."""
    log = ledger(spark, d).select("snapshot_hash", "model_hash", "timestamp", "event_type", "actor", "payload")
    path = f"{shared_dir(spark)}/tidewheel/stream-{uuid.uuid4().hex}"
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    log.repartition(files, "snapshot_hash").write.parquet(f"{path}/in")
    events = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{path}/in")
    Y.follow(events, models(spark, d), f"{path}/facts", f"{path}/checkpoint", known(spark, d)).awaitTermination()
    return Y.standing(spark, f"{path}/facts").withColumn("last_validated", F.col("last_validated").cast("timestamp_ntz"))


#: Every model, as of a time of its own and of one for all.
ASKED = "SELECT model_hash, created_at + INTERVAL '9' DAY AS as_of FROM m UNION SELECT model_hash, TIMESTAMP '2024-01-12 00:00:00' FROM m"


@query(f"""WITH {M}, {G_}, {membership_sql()}, a AS ({ASKED}), ot AS (SELECT DISTINCT as_of FROM a),
  o AS (SELECT as_of, t.* FROM (SELECT group_hash, member_hash, coalesce(since, lt) AS ts, since, tie, isin FROM (SELECT told.*, NULL::TIMESTAMP AS lt FROM told WHERE since IS NOT NULL
      UNION ALL SELECT group_hash, known.model_hash, NULL, '', true, "timestamp" FROM ops JOIN known ON ref = f[1] WHERE event_type = 'depends_on' AND f[2] = 'member_of')) t JOIN ot ON ts <= as_of),
  h AS (SELECT as_of, group_hash, member_hash FROM o GROUP BY ALL HAVING arg_max(isin, (coalesce(since, TIMESTAMP '0001-01-01'), tie))),
  gr AS (SELECT a.model_hash, a.as_of, string_agg(DISTINCT m.name, '|' ORDER BY m.name) AS groups FROM a JOIN h ON h.member_hash = a.model_hash AND h.as_of = a.as_of JOIN m ON m.model_hash = h.group_hash GROUP BY 1, 2),
  me AS (SELECT a.model_hash, a.as_of, string_agg(DISTINCT m.name, '|' ORDER BY m.name) AS members FROM a JOIN h ON h.group_hash = a.model_hash AND h.as_of = a.as_of JOIN m ON m.model_hash = h.member_hash GROUP BY 1, 2),
  {DEPENDENCIES.replace("SELECT l.model_hash,", "SELECT l.model_hash, l.ts,").replace("(SELECT model_hash, json", '(SELECT model_hash, "timestamp" AS ts, json')},
  up AS (SELECT a.model_hash, a.as_of, string_agg(DISTINCT other_name, '|' ORDER BY other_name) AS upstream FROM a JOIN deps ON deps.model_hash = a.model_hash AND ts <= as_of GROUP BY 1, 2),
  ev AS (SELECT a.model_hash, a.as_of, count(*) AS n, max("timestamp") AS last_event FROM a JOIN s ON s.model_hash = a.model_hash AND "timestamp" <= as_of GROUP BY 1, 2)
  SELECT model_hash, as_of, name, created_at <= as_of AS existed, coalesce(n, 0) AS total_events, last_event, coalesce(groups, '') AS groups, coalesce(members, '') AS members, coalesce(upstream, '') AS upstream
  FROM a JOIN m USING (model_hash) LEFT JOIN gr USING (model_hash, as_of) LEFT JOIN me USING (model_hash, as_of) LEFT JOIN up USING (model_hash, as_of) LEFT JOIN ev USING (model_hash, as_of)""")
def investigate_as_of(spark, d):
    """Every model's page where links, groups and members are those of the date too."""
    m, g = models(spark, d), ledger(spark, d)
    asked = m.select("model_hash", (F.col("created_at") + F.expr("INTERVAL '9' DAY")).alias("at")).unionByName(m.select("model_hash", ntz("2024-01-12 00:00:00").alias("at")))
    links = G.dependencies(g, m, B.names(m), ("timestamp",))
    found = V_.page_as_of(m, snapshots(spark, d), V_.membership_intervals(g, m), links, asked)
    return found.select("model_hash", F.col("at").alias("as_of"), "name", "existed", "total_events", "last_event", *[F.array_join(c, "|").alias(c) for c in ("groups", "members", "upstream")])


@query(f"""WITH {M}, {G_}, {membership_sql()}, w AS (SELECT DISTINCT "timestamp" AS ts FROM g), o AS (SELECT ts, t.* FROM (SELECT group_hash, member_hash, since, tie, isin, since AS as_of FROM told WHERE since IS NOT NULL
    UNION ALL SELECT group_hash, known.model_hash, NULL, '', true, "timestamp" FROM ops JOIN known ON ref = f[1] WHERE event_type = 'depends_on' AND f[2] = 'member_of') t JOIN w ON as_of <= ts),
  h AS (SELECT ts, group_hash, member_hash, arg_max(isin, (coalesce(since, TIMESTAMP '0001-01-01'), tie)) AS isin FROM o GROUP BY ALL),
  c AS (SELECT *, coalesce(lag(isin) OVER (PARTITION BY group_hash, member_hash ORDER BY ts), false) AS was FROM h),
  x AS (SELECT *, sum(CAST(isin <> was AS INTEGER)) OVER (PARTITION BY group_hash, member_hash ORDER BY ts) AS island FROM c)
  SELECT group_hash, member_hash, count(*) AS stays, min(since) AS first_since FROM (SELECT group_hash, member_hash, island, min(ts) AS since FROM x WHERE isin GROUP BY ALL) GROUP BY ALL""")
def membership_stays(spark, d):
    """How often each member came into its group, and when first; two spans that touch are one stay."""
    spans = V_.membership_intervals(ledger(spark, d), models(spark, d)).selectExpr("*", "lag(until) OVER (PARTITION BY group_hash, member_hash ORDER BY since) AS before")
    return spans.groupBy("group_hash", "member_hash").agg(F.count_if(~F.col("before").eqNullSafe(F.col("since"))).alias("stays"), F.min("since").alias("first_since"))
