"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

A document is contaminated by a benchmark item if one of its windows of as many words as the item has is similar enough
to it: the weighted Jaccard similarity of their word shingles, weighed by how often each occurs, is `similarity` or more.

1. Windows that share no shingle with any item have similarity 0. A similar window shares so many that one lies at a
   sampled place (every stride-th word of the document, the stride following from the items' sizes), so only windows
   around sampled shingles that an item has are fingerprinted: none that matters is lost. This is a filter of places: it
   says of how many words windows are to be, and not which items they may hold.
2. Each such window gets the SimHash of its weighted shingles. Different fingerprints of one size, each once however many
   texts have it, look up the items of that size in a multi-index of eight parts of eight bits: two that differ in at
   most 8 * PROBE + 7 bits differ in at most PROBE bits of one part, so entering each item under all values of a part
   within PROBE bits finds all of them. The candidates are what this index gives.
3. Pairs within that radius are verified by their exact similarity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, lookup, table, written

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a part that may differ; the radius is 23 of 64 bits. At similarity 0.8 fingerprints differ in 9.7 bits on
#: average, with a standard deviation of 2.9.
PROBE, PARTS = 2, 8
RADIUS = PARTS * PROBE + PARTS - 1
#: Item shingles, at most, that are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Two 32-bit counters in a long: no text has 2**31 shingles.
LANE = (1 << 32) | 1


def place_of(doc_id: str, text: str) -> Column:
    """128 bits that rows with equal id and text share; a null text counts as empty."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def words_of(text: Column) -> Column:
    """Letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, first: Column, last: Column, size: Column, step: int = 1) -> Column:
    """(place, hash) of the shingles that begin at first .. last (from 0), each step-th."""
    places = F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, size)).alias("h")))


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp, from rows of keys and h: bit b is set if it is in over half of the h."""
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANE))).alias(f"s{j}") for j in range(32)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_h"), *lanes)
    fp = F.lit(0).cast("long")
    for b in range(64):
        count = F.shiftrightunsigned(f"s{b % 32}", 32 * (b // 32)).bitwiseAND(F.lit((1 << 32) - 1))
        fp = fp.bitwiseOR(F.when(count * 2 > F.col("n_h"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def part(fp: Column, j: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * j).bitwiseAND(F.lit(255)).cast("int")


def stride_for(sizes: list[int], similarity: float) -> int:
    """The largest stride such that each window as similar as asked has a shared shingle at a sampled place."""
    for s in range(8, 1, -1):
        if all(m // s > m - math.ceil(2 * similarity * m / (1 + similarity) - 1e-9) for n in sizes for m in range(max(1, math.ceil(similarity * n - 1e-9)), n + 1)):
            return s
    return 1


def windows_near(docs: DataFrame, in_items: DataFrame, sizes: dict[int, list[int]], similarity: float, small: bool) -> DataFrame:
    """place, n, k, length, start: the windows of docs(place, text) of as many words as some item, n, around sampled shingles
    that an item of n words has; each once, however many items share it. in_items: n, k, h; sizes: by k, how many shingles
    items have; small: in_items may be broadcast."""
    known = in_items.select("h", "k", "n").distinct()
    if small:
        known = F.broadcast(known)
    anchors = docs.select("place", F.lit(0).alias("n_words"), F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).alias("n")).limit(0)
    for k, of in sorted(sizes.items()):
        words = docs.select("place", words_of(F.col("text")).alias("words"))
        at = words.select("place", F.size("words").alias("n_words"), F.explode(shingles(F.col("words"), F.lit(0), F.size("words") - k, F.lit(k), stride_for(of, similarity))).alias("s"))
        found = at.select("place", "n_words", F.col("s.at").alias("at"), F.col("s.h").alias("h")).join(known.where(F.col("k") == k), "h")
        anchors = anchors.unionByName(found.drop("h"))
    least, most = F.greatest(F.col("at") - F.col("n") + F.col("k"), F.lit(0)), F.least(F.col("at"), F.col("n_words") - F.col("n"))
    starts = F.when(F.col("n_words") <= F.col("n"), F.array(F.lit(0))).otherwise(F.sequence(least, F.greatest(most, least)))
    # A passage's anchors ask for many windows in common.
    anchors = written(anchors.distinct(), "anchors")
    return anchors.select("place", "n", "k", F.least("n", "n_words").alias("length"), F.explode(starts).alias("start")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, keep_place: bool = False) -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_words of the most similar window (the first of several), for each
    pair of a row of docs and an item that contaminates it.

    Words are runs of letters and digits in lower case. An item of fewer words than a shingle is one shingle; a document
    of fewer words than the item is one window. Null, empty and wordless texts and items match nothing. Repeated items
    count once; of items with one id the most similar counts. Repeated rows come out repeated; null ids are kept. Empty
    tables give no rows; other columns are ignored. A very long text is looked up by single sampled shingles, and its
    windows come one a row. keep_place: add place, as place_of gives it.
    """
    items = columns(items, item_id=item_id, words=words_of(F.col(item_text))).where(F.size("words") > 0).distinct()
    items = items.select(F.unhex(F.md5(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit(":"), F.array_join("words", " ")))).alias("item"), "item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(size)).alias("k"))
    items = written(items, "items")
    in_items = items.select("item", "n", "k", "words", F.explode(shingles(F.col("words"), F.lit(0), F.col("n") - F.col("k"), F.col("k"))).alias("s")).select("item", "n", "k", F.col("s.h").alias("h"))
    in_items = written(in_items, "item-shingles")
    small = in_items.count() <= BROADCAST_ROWS
    docs = columns(docs, doc_id=doc_id, text=F.coalesce(F.col(text), F.lit(""))).withColumn("place", place_of("doc_id", "text"))
    sizes: dict[int, list[int]] = {}
    for r in items.select("n", "k").distinct().collect():  # the sizes of items
        sizes.setdefault(r.k, []).append(r.n - r.k + 1)
    windows = written(windows_near(docs, in_items, sizes, similarity, small), "windows")
    n = windows.count()

    one = docs.join(windows.select("place").hint("merge"), "place", "left_semi").withColumn("row", F.row_number().over(Window.partitionBy("place").orderBy("place"))).where("row = 1")
    one = one.select("place", words_of(F.col("text")).alias("words"))
    every = lambda k: F.transform(shingles(F.col("words"), F.lit(0), F.size("words") - k, F.lit(k)), lambda s: s["h"])
    one = one.select("place", *[every(k).alias(f"h{k}") for k in sizes] or [F.expr("CAST(NULL AS ARRAY<BIGINT>)").alias("h0")])
    # A document's shingles are hashed once, before it meets its windows; each window, a row of its own, takes its part.
    own = F.slice(F.coalesce(*[F.when(F.col("k") == k, F.col(f"h{k}")) for k in sizes] or [F.col("h0")]), F.col("start") + 1, F.col("length") - F.col("k") + 1)
    hashed = written(windows.join(one.hint("merge"), "place").select("place", "n", "length", "start", own.alias("hashes")), "window-shingles")
    prints = simhash(hashed.select("place", "n", "start", F.explode("hashes").alias("h")), ["place", "n", "start"])
    prints = written(prints.select("place", "n", "start", F.concat_ws(":", "n", "fp").alias("print"), "fp", F.xxhash64("place").alias("spread")), "window-fingerprints", n)
    targets = written(simhash(in_items, ["item", "n"]), "item-fingerprints")

    probes = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda v: F.bit_count(v.bitwiseXOR(F.col("b.value"))) <= PROBE)
    parts = lambda df: df.withColumn("b", F.explode(F.array(*[F.struct(F.lit(j).alias("no"), part(F.col("fp"), j).alias("value")) for j in range(PARTS)])))
    index = parts(targets).select("item", "n", F.col("fp").alias("item_fp"), F.col("b.no").alias("no"), F.explode(probes).alias("value"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.lit(True)  # a pair that meets in several parts counts in the first
    for j in range(PARTS):
        first = first & ((F.col("no") <= j) | (F.bit_count(part(differ, j)) > PROBE))
    different = prints.groupBy("print", "n", "fp").agg(F.count("*").alias("rows"))
    met = parts(different).select("print", "n", "fp", "rows", F.col("b.no").alias("no"), F.col("b.value").alias("value")).join(index, ["n", "no", "value"])
    met = met.where(first & (F.bit_count(differ) <= RADIUS)).groupBy("print").agg(F.max("rows").alias("rows"), F.collect_list("item").alias("items"))
    met = written(met, "matches", n)
    # A passage's fingerprint may be that of a third of all windows.
    pairs = lookup(prints.drop("fp"), met, "print", "rows", n, "inner").select("place", "n", "start", F.explode("items").alias("item"))
    pairs = written(pairs, "pairs", n)

    mine = pairs.join(hashed, ["place", "n", "start"]).select("place", "n", "length", "start", "item", F.size("hashes").alias("own"), F.explode("hashes").alias("h"))
    mine = mine.groupBy("place", "n", "length", "start", "item", "own", "h").agg(F.count("*").alias("c"))
    theirs = in_items.groupBy("item", "h").agg(F.count("*").alias("c2"))
    shared = mine.join(theirs, ["item", "h"]).groupBy("place", "item", "n", "length", "start", "own").agg(F.sum(F.least("c", "c2")).alias("both"))
    total = items.select("item", "item_id", (F.col("n") - F.col("k") + 1).alias("size"))
    verified = shared.join(total, "item").withColumn("similarity", F.col("both") / (F.col("own") + F.col("size") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "length")).alias("best")
    hits = written(verified.groupBy("place", "item_id").agg(best), "hits", n)
    out = docs.select("doc_id", "place").join(hits, "place")
    return out.select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).cast("long").alias("start_word"), F.col("best.length").cast("long").alias("n_words"), *["place"] * keep_place)


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with their best window; see contaminated for nulls, ties and empty tables."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = f"""
WITH i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT row_number() OVER () AS item, item_id, w, len(w) AS n, least(len(w), {SHINGLE}) AS k FROM i WHERE len(w) > 0),
si AS (SELECT item, item_id, n, k, sh, count(*) AS c FROM (SELECT item, item_id, n, k, array_to_string(w[j:j + k - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, n - k + 2)) AS j FROM items)) GROUP BY ALL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS nw, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
sd AS (SELECT doc_id, nw, p, k, string_agg(word, ' ') OVER (PARTITION BY doc_id, k ORDER BY p ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) AS sh FROM t, (SELECT DISTINCT k FROM items)),
hits AS (SELECT doc_id, item, item_id, n, si.k, p, sh, c, nw, least(n, nw) AS size FROM sd JOIN si USING (sh, k) WHERE p <= nw - k),
win AS (SELECT *, unnest(range(greatest(p - size + k, 0), least(p, nw - size) + 1)) AS s FROM hits),
cut AS (SELECT doc_id, item, item_id, n, k, size, s, sh, least(count(*), c) AS met FROM win GROUP BY doc_id, item, item_id, n, k, size, s, sh, c),
sim AS (SELECT doc_id, item_id, s, size, sum(met) / (size - k + 1 + n - k + 1 - sum(met)) AS similarity FROM cut GROUP BY doc_id, item, item_id, n, k, size, s)
SELECT doc_id, item_id, similarity, CAST(s AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s, size DESC) AS rn FROM sim WHERE similarity >= {SIMILARITY} - 1e-12) WHERE rn = 1
"""
