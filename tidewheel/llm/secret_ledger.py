"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed. The ledger records which (blob, rule, rule version) were scanned and
what they gave; a run scans only the pairs that the ledger does not have, each distinct blob once however many paths or
versions hold it, and then joins the findings back to all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, lookup, table, written


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: The group whose length is checked, and the least length; shorter matches are dropped after matching.
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
)
#: What the ledger's rules add: private keys, signed web tokens and prefixed service tokens.
RULES = (
    *BASE_RULES,
    Rule("keyblock", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("webtoken", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", 1, r"(?:ghp|gho|glpat|xoxb|sk_live)[_-][A-Za-z0-9_-]{16,}"),
)
#: Matches that are folded together: a text with very many has a list of such lists, so that no list is copied too often.
FOLDED = 256
LEDGER = "digest string, kind string, version int, spans array<struct<start:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches as (start, end) in code points, end exclusive.

    What lies between the matches and the matches themselves alternate, so running sums of their lengths give the places.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), lambda x: F.length(x))
    checked = lengths(rule.group) if rule.group else F.expr("CAST(NULL AS ARRAY<INT>)")
    steps = F.arrays_zip(between.alias("gap"), lengths(0).alias("size"), checked.alias("checked")) if rule.group else F.arrays_zip(between.alias("gap"), lengths(0).alias("size"), lengths(0).alias("checked"))
    steps = F.filter(steps, lambda x: x["size"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start:INT,end:INT>>)").alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        more = F.concat(state["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["checked"] >= rule.least, more).otherwise(state["found"]).alias("found"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / FOLDED).cast("int")), lambda k: F.slice(steps, k * FOLDED + 1, FOLDED))
    last = lambda states: F.element_at(states, -1)
    folded = F.aggregate(parts, F.array(zero), lambda states, part: F.concat(states, F.array(F.aggregate(part, F.struct(last(states)["at"].alias("at"), zero["found"].alias("found")), step))))
    found = F.flatten(F.transform(folded, lambda s: s["found"]))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<start:INT,end:INT>>)"))


def scan(versions: DataFrame, path: str = "path", version: str | None = None, content: str = "content", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan versions of paths, and return (findings, additions to the ledger).

    findings: path, version, digest and spans, an array of (start, kind_no, kind, end) in order of start, then of the
    rules; one row for each row of versions, with an empty array where nothing is found. additions has the columns of
    LEDGER, one row for each pair of blob and rule version that was not in the ledger, found or not, to be appended.
    A null or empty content is a blob like any other: the empty one. Repeated rows and equal contents share one scan. A
    null path is kept. A very long text is scanned whole. Matches that begin at one place follow in order of the rules.
    An empty table gives empty results. Other columns are ignored.
    """
    rows = columns(versions, path=path, version=F.lit(None).cast("long") if version is None else version, content=F.coalesce(F.col(content), F.lit("")))
    if dict(rows.dtypes)["path"] == "void":
        rows = rows.withColumn("path", F.col("path").cast("string"))
    order = {r.kind: k for k, r in enumerate(rules)}
    # A row's place is 128 bits of its path, version and content; rows alike in it hold the same blob.
    place = F.concat_ws(":", F.hex(F.xxhash64("path", "version", "content")), F.hex(F.xxhash64(F.lit("place"), "content", "version", "path")))
    known = written(rows.select("path", "version", F.sha2("content", 256).alias("digest"), place.alias("place")), "versions")
    blobs = written(known.groupBy("digest").agg(F.min("place").alias("place"), F.count("*").alias("n")), "blobs")
    pairs = blobs.select("digest", "place", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r")).select("digest", "place", "r.*")
    if ledger is not None:
        pairs = pairs.join(ledger.select("digest", "kind", "version"), ["digest", "kind", "version"], "left_anti")
    unseen = pairs.groupBy("digest", "place").agg(F.collect_set("kind").alias("kinds"))
    text = rows.select(place.alias("place"), "content")
    # Rows with equal contents but other places drop out here; repeated rows have one place and are scanned alike.
    found = text.join(unseen, "place").select("digest", F.explode(F.array(*[
        F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("content"), r).alias("spans"))) for r in rules
    ])).alias("x")).where("x IS NOT NULL").select("digest", "x.*")
    added = written(found.dropDuplicates(["digest", "kind"]), "ledger")
    now = added
    if ledger is not None:
        kept = ledger.select("digest", "kind", "version", "spans").where(F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules]))
        now = added.unionByName(kept.join(blobs.select("digest"), "digest", "left_semi")).dropDuplicates(["digest", "kind"])
    number = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number[F.col("kind")].alias("kind_no"), F.col("kind").alias("kind"), s["end"].alias("end")))
    hits = now.where(F.size("spans") > 0).groupBy("digest").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("spans"))
    hits = written(hits.join(blobs.select("digest", "n"), "digest"), "findings")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start:INT,kind_no:INT,kind:STRING,end:INT>>)")
    back = lookup(known.drop("place"), hits, "digest", "n", known.count())
    return back.select("path", "version", "digest", F.coalesce("spans", none).alias("spans")), added


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones merged, replaced by the mark. spans: by start. Spans are taken together in parts,
    each over its own piece of the text, so that a text dense with them is copied and counted through once a part."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("out"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / FOLDED).cast("int")), lambda k: F.slice(spans, k * FOLDED + 1, FOLDED))

    def part(state: Column, some: Column) -> Column:
        end = F.greatest(state["at"], F.array_max(F.transform(some, lambda s: s["end"])))
        piece = F.struct(state["at"].alias("base"), F.substring(text, state["at"] + 1, end - state["at"]).alias("text"))

        def within(p: Column) -> Column:
            def step(now: Column, s: Column) -> Column:
                gap = F.substring(p["text"], now["at"] - p["base"] + 1, s["start"] - now["at"])
                out = F.when(s["start"] >= now["at"], F.concat(now["out"], gap, F.lit(mark))).otherwise(now["out"])
                return F.struct(F.greatest(now["at"], s["end"]).alias("at"), out.alias("out"))

            return F.aggregate(some, F.struct(p["base"].alias("at"), F.lit("").alias("out")), step)

        return bound(bound(piece, within), lambda done: F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

    rest = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(parts, zero, part, rest)).otherwise(text)


def op10_secret_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets; see scan for nulls, ties, repeated rows and empty tables."""
    found, _ = scan(table(spark, sf_dir, "documents"), "doc_id", None, "text")
    base = [r.kind for r in BASE_RULES]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    kinds = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        kinds.append(f"""
        SELECT doc_id, {k} AS kind_no, '{r.kind}' AS kind, gaps, hits, {f"regexp_extract_all(text, '{p}', {r.group})" if r.group else "hits"} AS checked, {r.least} AS least
        FROM (SELECT doc_id, text, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM d)""")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({" UNION ALL ".join(kinds)}),
    s AS (SELECT doc_id, kind_no, kind, checked, least, i,
            list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s0, length(hits[i]) AS size
          FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
    f AS (SELECT doc_id, kind_no, kind, CAST(s0 AS BIGINT) AS a, CAST(s0 + size AS BIGINT) AS b FROM s WHERE length(checked[i]) >= least),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, kind_no) FILTER (kind_no < 3), '') AS base,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, kind_no) AS spans FROM f GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


SQL = _sql()
