"""The dependency graph: port matching, direct links and closures by iterative joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import numbered, shared_dir, stored
from .membership import payloads


#: Rows of a frontier from which on a round of closure() looks its nodes up once each, and nodes up to which they are broadcast for that,
#: and for looking up the ends of links.
WIDE = 1_000_000


def closure(edges: DataFrame, roots: DataFrame, at_hand: bool = False) -> DataFrame:
    """root, node, hops: all that roots(root) reach along edges(src, dst), with the fewest hops; a root isn't in its own.

    A frontier joins the edges, which are stored once; what was reached before drops out, and each round is written to the
    shared folder. It ends when nothing new is reached, however long the paths. at_hand: edges are a stored table already, best
    one that is bucketed by src.

    Where many rows of a frontier share few nodes, the links that leave these are found first. Then neither frontier nor edges
    are shuffled, and of what was reached before just the rows of nodes that can be reached now.
    """
    edges = edges.select("src", "dst") if at_hand else stored(edges.select("src", "dst"), "edges")
    found = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct(), "reach")
    frontier, hops = found, 0
    while True:
        hops += 1
        near, before = edges, found
        if hops > 1 and rows > WIDE:  # roots are different nodes
            starts = stored(frontier.select(F.col("node").alias("src")).distinct(), "starts")
            if starts.count() <= WIDE:
                near = stored(edges.join(F.broadcast(starts), "src", "left_semi").select("src", "dst").distinct(), "near")
                ends = stored(near.select(F.col("dst").alias("node")).distinct(), "ends")
                if not (n := ends.count()):
                    return found.where("hops > 0")
                if n <= WIDE:
                    before = found.join(F.broadcast(ends), "node", "left_semi")
        step = frontier.join(near, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(before, ["root", "node"], "left_anti").withColumn("hops", F.lit(hops)), "reach")
        if not (rows := frontier.count()):
            return found.where("hops > 0")
        found = found.unionByName(frontier)
        if hops % 8 == 0:  # else a long walk reads ever more tables
            found = stored(found, "reach")


def value_matches(a: str, b: str) -> str:
    """SQL: % in a is a wildcard for b, else % in b for a, else they are equal whatever their case."""
    esc = lambda x: f"replace(replace({x}, '!', '!!'), '_', '!_')"
    return f"CASE WHEN contains({a}, '%') THEN {b} ILIKE {esc(a)} ESCAPE '!' WHEN contains({b}, '%') THEN {a} ILIKE {esc(b)} ESCAPE '!' ELSE lower({a}) = lower({b}) END"


def anchored(value: Column) -> Column:
    """The longer end of a pattern that has no wildcard: ("p" or "s", its length, its text)."""
    first, last = F.instr(value, "%") - 1, F.length(value) - F.length(F.substring_index(value, "%", -1))
    end = F.length(value) - last
    return F.when(first >= end, F.struct(F.lit("p").alias("side"), first.alias("n"), F.substring(value, F.lit(1), first).alias("text"))).otherwise(
        F.struct(F.lit("s").alias("side"), end.alias("n"), F.substring(value, last + 1, end).alias("text")))


#: Ports that go to one task, about.
TASK_PORTS = 200_000


def port_matches(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """upstream, downstream, identifier for each output port that feeds an input port; one row a pair of nodes."""
    met, tasks = port_meetings(outputs, inputs)
    # Dealt by pairs first: so rows are sorted once, after their shuffle, and not before it too.
    return met.repartition(tasks, "upstream", "downstream").groupBy("upstream", "downstream").agg(F.min("identifier").alias("identifier"))


def port_meetings(outputs: DataFrame, inputs: DataFrame) -> tuple[DataFrame, int]:
    """upstream, downstream, identifier for each output port that feeds an input port, and how many tasks the ports need.

    outputs and inputs: (node, identifier, schema map). Identifiers must be equal whatever their case, the schemas must
    have the same keys, and every value must match, % being a wildcard. Ports of one shared identifier don't meet there, but by
    the value of their first key: plain values by equality; a pattern by the longer of its ends that have no wildcard, which
    a value offers in each length that patterns have. So a pattern meets the values that share that end, and the rest filters.
    Patterns without such an end meet all values of their identifier. The driver gets the lengths in use, and how many ports
    have them; tasks are as many as the ports need.
    """
    keys = F.sort_array(F.map_keys("schema"))
    value = lambda c: F.lower(F.element_at(c, F.element_at(F.sort_array(F.map_keys(c)), F.lit(1))))
    wild, wilds = F.contains("v", F.lit("%")), F.length("v") - F.length(F.translate("v", "%", ""))
    # Where a value of a single key has no wildcard, or just one at an end, equal tags are a match already.
    plain = F.coalesce((F.size("schema") == 1) & ((wilds == 0) | (wilds == 1) & (F.col("v").startswith("%") | F.col("v").endswith("%"))), F.size("schema") == 0)
    side = lambda df, node: df.withColumn("v", F.when(F.size("schema") > 0, value("schema"))).select(F.col("node").alias(node), F.lower("identifier").alias("identifier"), F.array_join(keys, "\0").alias("keys"), "schema", "v", plain.alias("plain"))
    o, i = side(outputs, "upstream"), side(inputs, "downstream")
    end = F.when(wild, anchored(F.col("v")))
    use = lambda df, who: df.groupBy(F.lit(who).alias("who"), end["side"].alias("side"), end["n"].alias("n"), "plain").agg(F.count("*").alias("ports"))
    used = use(o, "out").unionByName(use(i, "in")).collect()
    lengths = lambda who: sorted({(r.side, r.n) for r in used if r.who == who and r.side})
    loose = any(not r.plain for r in used)
    tasks = max(int(o.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.ports for r in used) // TASK_PORTS))
    lit = lambda text: F.concat(F.lit(text), "v")
    own = lambda who: F.concat_ws(":", F.lit(who), (a := anchored(F.col("v")))["side"], a["n"].cast("string"), a["text"])

    def offered(who: str) -> list[Column]:
        cut = lambda end, n: F.substring(F.col("v"), F.lit(1), F.lit(n)) if end == "p" else F.substring(F.col("v"), F.length("v") - n + 1, F.lit(n))
        return [F.when(F.length("v") >= n, F.concat(F.lit(f"{who}:{end}:{n}:"), cut(end, n))) for end, n in lengths(who)]

    bare = F.when(F.size("schema") == 0, F.lit("bare"))

    def tagged(df: DataFrame, node: str, schema: str, *tags: Column) -> DataFrame:
        rows = df.withColumn("tag", F.explode(F.array(bare, *tags))).where("tag IS NOT NULL")
        more = [F.col("schema").alias(schema), F.col("plain").alias(f"{schema}_plain")] if loose else []
        return rows.select(node, "identifier", "keys", "tag", *more).repartition(tasks, "identifier", "keys", "tag")

    # Output patterns meet all input values; input patterns meet plain output values.
    o = tagged(o, "upstream", "o", F.when(wild, own("out")).otherwise(lit("=")), *[F.when(~wild, c) for c in offered("in")])
    i = tagged(i, "downstream", "i", F.when(wild, own("in")).otherwise(lit("=")), *offered("out"))
    met = o.join(i, ["identifier", "keys", "tag"]).where("upstream <> downstream")
    if loose:
        met = met.where("CASE WHEN tag LIKE 'in:%' THEN i_plain ELSE o_plain END OR forall(map_keys(o), k -> " + value_matches("o[k]", "i[k]") + ")")
    return met.select("upstream", "downstream", "identifier"), tasks


def connect(nodes: DataFrame, edges: DataFrame, at_hand: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new, counts) from nodes(name, inputs, outputs) and the edges(src, dst) that are known: the links to write, as
    upstream, downstream, identifier, and one row of links_created, links_skipped. Matches and edges meet in one shuffle, by the
    downstream node, whose matches lie together already. at_hand: nodes are stored already."""
    nodes = nodes if at_hand else stored(nodes.select("name", "inputs", "outputs"), "nodes")  # they are read for each side, and for the patterns in use
    ports = lambda side: nodes.select(F.col("name").alias("node"), F.explode(side).alias("p")).select("node", "p.identifier", "p.schema")
    found, tasks = port_meetings(ports("outputs"), ports("inputs"))
    old = edges.select(F.col("src").alias("upstream"), F.col("dst").alias("downstream"), F.lit(None).cast("string").alias("identifier"), F.lit(True).alias("known"))
    both = found.withColumn("known", F.lit(None).cast("boolean")).unionByName(old).repartition(tasks, "downstream")
    # Identifiers of ports are not null where they met, so pairs without one are edges that nothing matches now.
    met = both.groupBy("upstream", "downstream").agg(F.min("identifier").alias("identifier"), F.max("known").alias("known")).where("identifier IS NOT NULL")
    counts = met.agg(F.count_if(F.col("known").isNull()).alias("links_created"), F.count_if(F.col("known")).alias("links_skipped"))
    return met.where("known IS NULL").drop("known"), counts


def dependencies(s: DataFrame, m: DataFrame, known: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """model_hash, direction, relationship, other_hash, other_name for each link event whose target a model is: that with the
    payload's hash, else that with its name. s: model_hash, event_type, payload; known: names(m); more: columns of s to carry along."""
    up = F.col("event_type") == "depends_on"
    links = payloads(s.where(F.col("event_type").isin("depends_on", "has_dependent")), "relationship string, upstream string, upstream_hash string, downstream string, downstream_hash string")
    of = links.select("model_hash", "event_type", *more, "p", F.concat(F.lit("\0"), F.xxhash64("model_hash", "payload").cast("string")).alias("none"))
    of = of.select("model_hash", *more, F.when(up, "upstream").otherwise("downstream").alias("direction"), F.coalesce("p.relationship", F.lit("depends_on")).alias("relationship"), "none",
        F.when(up, F.col("p.upstream_hash")).otherwise(F.col("p.downstream_hash")).alias("hash"), F.when(up, F.col("p.upstream")).otherwise(F.col("p.downstream")).alias("name"))
    look = lambda ref, name: known.select(F.col("key").alias(ref), F.col("found").alias(name))
    # What isn't asked for gets a key that no model has, all of them different, so that none is hot.
    first = of.withColumn("a", F.coalesce(F.nullif("hash", F.lit("")), "none")).join(look("a", "by_hash"), "a", "left")
    both = first.withColumn("b", F.when(F.col("by_hash").isNull(), F.nullif("name", F.lit("")))).withColumn("b", F.coalesce("b", "none")).join(look("b", "by_name"), "b", "left")
    found = both.withColumn("other_hash", F.coalesce("by_hash", "by_name")).where("other_hash IS NOT NULL")
    return found.join(m.select(F.col("model_hash").alias("other_hash"), F.col("name").alias("other_name")), "other_hash").select("model_hash", "direction", "relationship", "other_hash", "other_name", *more)


def linked_names(s: DataFrame, m: DataFrame, known: DataFrame) -> DataFrame:
    """src, dst: the names of both ends of each depends_on event, as dependencies() finds them. known: named(m). Events refer to few
    upstream models, so each reference is looked up once, not once for each event. s: model_hash, event_type, payload."""
    links = payloads(s.where("event_type = 'depends_on'"), "upstream string, upstream_hash string")
    of = links.select("model_hash", F.coalesce("p.upstream_hash", F.lit("")).alias("hash"), F.coalesce("p.upstream", F.lit("")).alias("name"))
    keys = F.array(*[F.struct(F.lit(k).alias("order"), F.col(c).alias("key")) for k, c in enumerate(("hash", "name"))])
    refs = of.select("hash", "name").distinct().select("hash", "name", F.explode(keys).alias("by")).select("hash", "name", "by.*").where("key <> ''")
    found = refs.join(known.select("key", F.col("name").alias("src")), "key").groupBy("hash", "name").agg(F.min_by("src", "order").alias("src"))
    return of.join(found, ["hash", "name"]).select("model_hash", "src").join(m.select("model_hash", F.col("name").alias("dst")), "model_hash").select("src", "dst")


#: How often a turn of strong_components may leave out what lies on no cycle.
TRIMS = 8


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component for the nodes of edges(src, dst) that lie on cycles: nodes that reach each other have one component, named
    after the least of them. Links from a node to itself, and without an end, don't count.

    Each turn gives every node the greatest mark among those that reach it. Nodes that reach a mark's own node backwards, by
    links between nodes of that mark, are its component; it drops out, and so do links between different marks. Marks are
    hashes that differ from turn to turn, so turns are few also along long paths.
    """
    at = lambda end, c="node": F.col(c).alias(end)
    rest, found, turn = stored(edges.where("src <> dst").select("src", "dst").distinct(), "cycles"), None, 0
    while True:
        # Nodes that no link enters, or none leaves, lie on no cycle. Without them others are such nodes, so marks walk what is left.
        n = rest.count()
        for _ in range(TRIMS):
            before, rest = n, stored(rest.join(rest.select(at("src", "dst")).distinct(), "src", "left_semi").join(rest.select(at("dst", "src")).distinct(), "dst", "left_semi").select("src", "dst"), "cycles")
            if (n := rest.count()) == before:
                break
        mark = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), at("root")).alias("c")
        marks = new = stored(rest.select(at("node", "src")).union(rest.select("dst")).distinct().select("node", mark), "marks")
        while not new.isEmpty():
            offers = new.join(rest, F.col("node") == F.col("src")).groupBy("dst").agg(F.max("c").alias("offer"))
            new = stored(marks.join(offers.withColumnRenamed("dst", "node"), "node").where("offer > c").select("node", "offer"), "marks")
            marks = stored(marks.join(new, "node", "left").select("node", F.coalesce("offer", "c").alias("c")), "marks")
            new = new.withColumnRenamed("offer", "c")
        of = lambda end: marks.select(at(end), F.col("c.root").alias(f"{end}_mark"))
        same = stored(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_mark = dst_mark").select("src", "dst"), "cycles")
        roots = marks.where("c.root = node").select(at("root"))
        back = closure(same.select(at("src", "dst"), at("dst", "src")), roots, at_hand=True).select("root", "node")
        group = stored(back.unionByName(back.select("root", at("node", "root")).distinct()), "components")
        named = group.join(group.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
        found = named if found is None else found.unionByName(named)
        done = stored(group.select("node").union(roots).distinct(), "done")
        rest = stored(same.join(done.select(at("src")), "src", "left_anti").join(done.select(at("dst")), "dst", "left_anti").select("src", "dst"), "cycles")
        turn += 1
        if rest.isEmpty():
            return found


def trace_order(edges: DataFrame, root: str, at_hand: bool = False) -> DataFrame:
    """node, position, level, hops: what `root` depends on, each after all that it depends on itself, root last. at_hand: edges are
    stored already.

    Nodes on common cycles are one unit (strong_components); level is the most units on a path that leads to a node's own,
    and within a level nodes are in order of name. Nodes of a unit stand together, those farthest from the root (by fewest
    hops) first, in the place of the least name of them.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst") if at_hand else stored(edges.select("src", "dst"), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one = spark.createDataFrame([(root,)], "root string")
    hops = stored(closure(back, one, at_hand=True).select("node", "hops").unionByName(one.select(F.col("root").alias("node"), F.lit(0).alias("hops"))), "hops")
    inside = edges.where("src <> dst").join(hops.select(F.col("node").alias("src")), "src", "left_semi").join(hops.select(F.col("node").alias("dst")), "dst", "left_semi")
    links = stored(inside.select("src", "dst").distinct(), "links")
    folder = f"{shared_dir(spark)}/tidewheel/levels-{uuid.uuid4().hex}"
    place = lambda df, level: df.select("node").write.parquet(f"{folder}/level={level}")
    targets = lambda of: of.select(F.col("dst").alias("node")).distinct()
    units = None
    waits = stored(targets(links), "waits")
    place(hops.join(waits, "node", "left_anti"), 0)
    level, n = 0, waits.count()
    while n:
        # A link counts as long as its source waits, so each round reads just what the one before has left.
        rest = stored(links.join(waits.select(F.col("node").alias("src")), "src", "left_semi"), "links")
        still = stored(waits.join(targets(rest), "node", "left_semi"), "waits")
        if (m := still.count()) == n:  # all that is left lies on or behind cycles: go on with units, which have none
            units = stored(strong_components(rest), "units")
            unit = lambda df, end: df.join(units.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
            links = stored(unit(unit(rest, "src"), "dst").where("src <> dst").distinct(), "links")
            waits = stored(unit(waits, "node").distinct(), "waits")
            rest, still = links, stored(waits.join(targets(links), "node", "left_semi"), "waits")
            m = still.count()
        level += 1
        place(waits.join(still, "node", "left_anti"), level)
        links, waits, n = rest, still, m
    placed = spark.read.schema("node string, level int").parquet(folder).withColumnRenamed("node", "unit")
    own = hops.withColumn("unit", F.col("node")) if units is None else hops.join(units, "node", "left").withColumn("unit", F.coalesce("component", "node"))
    out = own.select("node", "hops", "unit", (-F.col("hops")).alias("near")).join(placed, "unit")
    return numbered(out, "position", "level", "unit", "near", "node").select("node", "position", "level", "hops")
