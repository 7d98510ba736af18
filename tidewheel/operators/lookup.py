"""Models by what a user calls them, and what the tools show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from . import graph as G
from . import timeline as L


def resolve(m: DataFrame, wanted: DataFrame) -> DataFrame:
    """ref, model_hash, name for each row of wanted(ref): the model of that name, else that of that hash; null where there is
    none. Of several models of one name that with the least hash counts."""
    by_name = m.groupBy(F.col("name").alias("ref")).agg(F.min("model_hash").alias("by_name"))
    by_hash = m.select(F.col("model_hash").alias("ref"), F.col("model_hash").alias("by_hash"))
    found = wanted.select("ref").join(by_name, "ref", "left").join(by_hash, "ref", "left").select("ref", F.coalesce("by_name", "by_hash").alias("model_hash"))
    return found.join(m.select("model_hash", "name"), "model_hash", "left").select("ref", "model_hash", "name")


def hash_of(m: DataFrame, ref: str) -> str | None:
    """The hash that one reference means."""
    found = m.where((F.col("name") == ref) | (F.col("model_hash") == ref)).agg(F.min(F.when(F.col("name") == ref, F.col("model_hash"))).alias("n"), F.min(F.when(F.col("model_hash") == ref, F.col("model_hash"))).alias("h")).first()
    return found.n or found.h


def history(s: DataFrame, m: DataFrame, ref: str) -> DataFrame:
    """The events of a model by name or hash, newest first; a model that doesn't exist raises a ValueError."""
    return L.history(s, known(m, ref))


def changelog(s: DataFrame, m: DataFrame, offset: int, limit: int, since: Column | None = None, until: Column | None = None, event_type: str | None = None, model: str | None = None) -> DataFrame:
    """A page of the changelog, of one model by name or hash if given."""
    return L.changelog(s, m, offset, limit, since, until, event_type, known(m, model) if model else None)


def known(m: DataFrame, ref: str) -> str:
    if (found := hash_of(m, ref)) is None:
        raise ValueError(f"no model {ref}")
    return found


def search(m: DataFrame, s: DataFrame, offset: int, limit: int, text: str | None = None, platform: str | None = None, **equal: str) -> DataFrame:
    """A page of the models that match, as timeline.query gives it, also by platform: that which the model's events resolve to. With
    a platform all events of matching models are summed up, and the page is cut afterwards."""
    if platform is None:
        return L.query(m, s, offset, limit, text, **equal)
    for column, value in equal.items():
        m = m.where(F.col(column) == value)
    if text:
        m = L.text_search(m, text)
    found = m.join(L.activity(s).where(F.col("platform") == platform), "model_hash")
    rows = L.page(found, offset, limit, F.col("name"), F.col("model_hash"))
    out = rows.select("name", "owner", "model_type", "status", "platform", "last_event", F.col("n").alias("event_count"))
    return out.withColumn("total", found.agg(F.count("*")).scalar()).withColumn("has_more", F.col("total") > offset + limit)


def trace(edges: DataFrame, root: str, platforms: DataFrame, depth: int | None = None, direction: str = "both", at_hand: bool = False) -> DataFrame:
    """name, direction, relationship, position, hops, platform of what a node depends on and of what depends on it, within `depth`
    hops. Upstream positions count back from the root in dependency order, downstream ones go by hops and name.

    edges: src, dst; platforms: name, platform, null or missing where there is none. at_hand: edges are stored already."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst") if at_hand else stored(edges.select("src", "dst"), "edges")
    parts = []
    if direction in ("upstream", "both"):
        up = G.trace_order(edges, root, at_hand=True).where(F.col("node") != root)
        total = up.agg(F.count("*")).scalar()
        parts.append(up.select(F.col("node").alias("name"), F.lit("upstream").alias("direction"), F.lit("depends_on").alias("relationship"), (total - F.col("position") + 1).alias("position"), "hops"))
    if direction in ("downstream", "both"):
        down = G.closure(edges, spark.createDataFrame([(root,)], "root string"), at_hand=True).where(F.col("node") != root)
        ranked = G.numbered(down.select("node", "hops"), "position", "hops", "node")
        parts.append(ranked.select(F.col("node").alias("name"), F.lit("downstream").alias("direction"), F.lit("feeds_into").alias("relationship"), "position", "hops"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if depth is not None:
        found = found.where(F.col("hops") <= depth)
    found = stored(found, "trace")
    # Only the platforms of what was found: the semi join goes below a user's own grouping of names.
    own = platforms.select("name", "platform").join(found.select("name"), "name", "left_semi")
    return found.join(own, "name", "left").select("name", "direction", "relationship", "position", "hops", "platform")
