"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns is rendered once, as the prompt. What follows in either conversation is its completion,
with the spans that a model is to be trained on: what the assistant says there, and the mark that ends its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table

OPEN, CLOSE, TRAINED = "<|{}|>\n", "<|end|>\n", "assistant"
_TURN = "struct<role:string,text:string>"


def turns_of(turns: DataFrame, pair_id: str, turn: str, role: str, text: str) -> DataFrame:
    """pair_id and its turns in order: of turn, then of role and text. Null roles and texts are empty."""
    slim = columns(turns, pair_id=pair_id, turn=turn, role=F.coalesce(F.col(role), F.lit("")), text=F.coalesce(F.col(text), F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")))
    return slim.groupBy("pair_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def opened(t: Column) -> Column:
    start, end = OPEN.split("{}")
    return F.concat(F.lit(start), t["role"], F.lit(end))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(opened(t), t["text"], F.lit(CLOSE))), "")


def trained(turns: Column) -> Column:
    """The spans, in code points of rendered(turns), of the assistant's texts and end marks."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start:INT,end:INT>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(opened(t))
        end = start + F.length(t["text"]) + len(CLOSE)
        more = F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, more).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair_id: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected and their masks (arrays of spans of code points).

    One row for each pair_id that either side has; a side without turns has an empty completion. Null roles and texts
    count as empty, turns with a null number come last, turns of one number follow in order of role and text; repeated
    rows are turns of their own. A null pair_id is a pair like any other. If one conversation begins with all of the
    other, the shorter has an empty completion. Very long texts are kept whole. Empty tables give no rows; other columns
    are ignored.
    """
    a = turns_of(chosen, pair_id, turn, role, text).select(F.col("pair_id"), F.col("turns").alias("a"))
    b = turns_of(rejected, pair_id, turn, role, text).select(F.col("pair_id").alias("other"), F.col("turns").alias("b"))
    none = F.expr(f"CAST(array() AS ARRAY<{_TURN}>)")
    both = a.join(b, F.col("pair_id").eqNullSafe(F.col("other")), "full").select(F.coalesce("pair_id", "other").alias("pair_id"), F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return formatted(both)


def formatted(both: DataFrame) -> DataFrame:
    """As format_pairs, from pair_id and the two conversations a and b as arrays of turns (role, text) in order."""
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.get("a", i) != F.get("b", i)))
    both = both.withColumn("n", F.element_at(differs, 1))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    both = both.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return both.select("pair_id", F.col("n").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"), trained(F.col("a")).alias("chosen_mask"), trained(F.col("b")).alias("rejected_mask"))


def stale_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, a, b: pairs from plain conversations, as arrays of turns (turn, role, text). a, the chosen one, is the
    conversation up to its last assistant turn; b, the rejected one, has there the assistant turn before (a stale reply),
    or the turn before if there is none. One shuffle: a conversation is one row.

    Conversations that the assistant never spoke in give no pair. Turns with a null number are left out: they have no
    place before or after the last one, so a conversation of only such turns gives no pair. Null roles and texts are
    empty; turns of one number follow in order of role and text; repeated rows are turns of their own; rows without a
    conv_id are one conversation. An empty table gives no rows; other columns are ignored.
    """
    turns = columns(conversations, pair_id="conv_id", turn="turn", role=F.coalesce(F.col("role"), F.lit("")), text=F.coalesce(F.col("text"), F.lit(""))).where("turn IS NOT NULL")
    rows = turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    spoken = lambda x: x["role"] == TRAINED
    rows = rows.withColumn("last", F.array_max(F.transform(F.filter("t", spoken), lambda x: x["turn"]))).where("last IS NOT NULL")
    rows = rows.withColumn("a", F.filter("t", lambda x: x["turn"] <= F.col("last")))
    earlier = F.transform(F.filter("a", lambda x: x["turn"] < F.col("last")), lambda x: F.struct(spoken(x).alias("own"), x["turn"].alias("turn"), x["text"].alias("text")))
    rows = rows.withColumn("stale", F.coalesce(F.array_max(earlier)["text"], F.lit("")))
    swap = lambda x: F.when((x["turn"] == F.col("last")) & spoken(x), F.col("stale")).otherwise(x["text"])
    return rows.select("pair_id", "a", F.sort_array(F.transform("a", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), swap(x).alias("text")))).alias("b"))


def stale_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides of stale_pairs as tables of turns: chosen and rejected, each pair_id, turn, role, text."""
    pairs = stale_pairs(conversations)
    side = lambda c: pairs.select("pair_id", F.explode(c).alias("t")).select("pair_id", "t.*")
    return side("a"), side("b")


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a reply as a pair; see stale_pairs for nulls, ties, repeated rows and empty tables."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    said = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(c)
    found = formatted(stale_pairs(table(spark, sf_dir, "conversations")).select("pair_id", said("a"), said("b")))
    return found.select(F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", "rejected", listed("chosen_mask"), listed("rejected_mask"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE turn IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = '{TRAINED}' GROUP BY conv_id),
chosen AS (SELECT t.*, last FROM t JOIN last ON t.conv_id IS NOT DISTINCT FROM last.conv_id WHERE turn <= last),
stale AS (SELECT conv_id, text AS stale FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = '{TRAINED}') DESC, turn DESC, text DESC) AS rn FROM chosen WHERE turn < last) WHERE rn = 1),
sides AS (
  SELECT conv_id, turn, role, text AS a, CASE WHEN turn = last AND role = '{TRAINED}' THEN coalesce(stale, '') ELSE text END AS b
  FROM chosen LEFT JOIN stale USING (conv_id)),
sa AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, a) AS i, role, a AS text FROM sides),
sb AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, b) AS i, role, b AS text FROM sides),
n AS (SELECT sa.conv_id, coalesce(min(sa.i) FILTER (sa.text <> sb.text OR sa.role <> sb.role) - 1, count(*)) AS n FROM sa JOIN sb ON sa.conv_id = sb.conv_id AND sa.i = sb.i GROUP BY sa.conv_id),
r AS (SELECT x.conv_id, side, i, x.role, '<|' || x.role || '|>' || chr(10) AS head, x.text || '<|end|>' || chr(10) AS body, n, i <= n AS common
      FROM (SELECT 'a' AS side, * FROM sa UNION ALL SELECT 'b', * FROM sb) x JOIN n USING (conv_id)),
p AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side, common ORDER BY i) AS stop FROM r)
SELECT conv_id, CAST(any_value(n) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (common AND side = 'a'), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (NOT common AND side = 'a'), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (NOT common AND side = 'b'), '') AS rejected,
  coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY i) FILTER (NOT common AND side = 'a' AND role = '{TRAINED}'), '') AS chosen_mask,
  coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY i) FILTER (NOT common AND side = 'b' AND role = '{TRAINED}'), '') AS rejected_mask
FROM p GROUP BY conv_id
"""
