"""What SQL texts, cron expressions and tags say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the results.
NAME = r"([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*){1,2})"
READS = r"(?i)(?:FROM|JOIN)\s+" + NAME
WRITES = (
    r"(?i)INSERT\s+(?:INTO\s+)?" + NAME,
    r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?" + NAME,
    r"(?i)MERGE\s+INTO\s+" + NAME,
)
FILTERS = (r"(?i)model_name\s*=\s*'([^']+)'", r"(?i)model_name\s+LIKE\s+'([^']+)'", r"(?i)'([^']+)'\s+AS\s+model_name")
IN_LIST = r"(?i)model_name\s+IN\s*\(([^)]+)\)"
LOOKBACK = (r"(?i)lookback\s*=\s*(\d+)", r"(?i)DATEADD\s*\(\s*day\s*,\s*-(\d+)", r"(?i)INTERVAL\s+'?(\d+)\s*(?:days?)'?")
TEMPLATE = r"\{\{(\w+)\}\}"
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def first_spellings(names: Column) -> Column:
    """names without those that repeat an earlier one in another case."""
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return F.aggregate(names, none, lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x))))


def read_tables(sql: Column) -> Column:
    return first_spellings(found(sql, READS))


def write_tables(sql: Column) -> Column:
    return first_spellings(F.concat(*[found(sql, p) for p in WRITES]))


def model_filters(sql: Column) -> Column:
    listed = F.flatten(F.transform(found(sql, IN_LIST), lambda x: F.regexp_extract_all(x, F.lit(r"'([^']+)'"), F.lit(1))))
    return F.array_distinct(F.concat(*[found(sql, p) for p in FILTERS], listed))


def lookback(sql: Column) -> Column:
    days = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(sql, F.lit("")), p, 1), F.lit("")) for p in LOOKBACK])
    return F.concat(days, F.lit(" days"))


def strip_templates(sql: Column) -> Column:
    """{{name}} becomes name; blanks inside the braces are left as they are, and null is an empty text."""
    return F.regexp_replace(F.coalesce(sql, F.lit("")), TEMPLATE, "$1")


def comment_tags(sql: Column, prefix: str = "@") -> Column:
    """The map of the `-- @tag: value` lines, by tag; of equal tags the last line wins, and an empty value counts."""
    start = f"-- {prefix}"
    lines = F.transform(F.split(F.coalesce(sql, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: F.startswith(x, F.lit(start)) & F.contains(F.substr(x, F.lit(len(start) + 1)), F.lit(":")))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    pair = lambda x: F.split(F.substr(x, F.lit(len(start) + 1)), ":", 2)
    each = F.transform(lines, lambda x: F.struct(trim(F.get(pair(x), 0)).alias("key"), trim(F.get(pair(x), 1)).alias("value")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<key:STRING,value:STRING>>)")
    last = F.aggregate(each, none, lambda kept, e: F.concat(F.filter(kept, lambda k: k["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def tag_pairs(tags: Column) -> Column:
    """The map of k:v tags; a tag without a colon has an empty value, and the last of equal keys wins."""
    each = F.transform(tags, lambda x: F.struct(F.regexp_extract(x, r"(?s)^([^:]*)", 1).alias("key"), F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1).alias("value")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<key:STRING,value:STRING>>)")
    last = F.aggregate(each, none, lambda kept, e: F.concat(F.filter(kept, lambda k: k["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def file_name(name: Column) -> Column:
    """A name that is safe for files: slashes, backslashes and white space become underscores."""
    return F.regexp_replace(name, r"[/\\\s]", "_")


def next_version(version: Column) -> Column:
    """The next minor version: 1.2.3 becomes 1.3.0; null for what isn't a version of three numbers or more parts."""
    parts = F.split(version, r"\.")
    minor = F.get(parts, 1).try_cast("int") + 1
    return F.when((F.size(parts) >= 3) & minor.isNotNull(), F.array_join(F.concat(F.array(F.get(parts, 0), minor.cast("string"), F.lit("0")), F.slice(parts, 4, F.size(parts) + 1)), "."))


def ordinal(day: Column) -> Column:
    """A day of the month with its ending; text that isn't a number gets th."""
    n = day.try_cast("int")
    tail = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(day, tail)


def cron_in_english(cron: Column) -> Column:
    """Daily, every N hours, days of the month and weekday schedules in words, on a 12-hour clock."""
    part = lambda i: F.try_element_at(F.split(F.trim(cron), r"\s+"), F.lit(i))
    minute, hour, day, month, week = (part(i) for i in range(1, 6))
    h, m = hour.try_cast("int"), minute.try_cast("int")
    half = F.when(h == 0, 12).when(h <= 12, h).otherwise(h - 12).cast("string")
    clock = F.coalesce(F.concat(half, F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.when(h < 12, " AM").otherwise(" PM")), F.concat(hour, F.lit(":"), minute))
    at = lambda said: F.concat(said, F.lit(" at "), clock, F.lit(" UTC"))
    any_day, any_month, any_week = (x == "*" for x in (day, month, week))
    days = F.array_join(F.transform(F.split(day, ","), lambda d: ordinal(F.trim(d))), ", ")
    of_month = F.concat(days, F.lit(" of each month"))
    weekday = F.get(F.array(*[F.lit(x) for x in WEEKDAYS]), week.try_cast("int"))
    return (
        F.when(F.coalesce(cron, F.lit("")) == "", "Not scheduled")
        .when((F.size(F.split(F.trim(cron), r"\s+")) == 5) & any_day & any_month & any_week, F.when(F.startswith(hour, F.lit("*/")), F.concat(F.lit("Every "), F.substr(hour, F.lit(3)), F.lit(" hours"))).otherwise(at(F.lit("Daily"))))
        .when((F.size(F.split(F.trim(cron), r"\s+")) == 5) & any_month & any_week & (F.contains(day, F.lit(",")) | day.rlike(r"^\d+$")), at(of_month))
        .when((F.size(F.split(F.trim(cron), r"\s+")) == 5) & any_day & any_month & weekday.isNotNull() & week.rlike(r"^\d+$"), at(F.concat(F.lit("Every "), weekday)))
        .otherwise(F.concat(F.lit("Custom schedule: "), cron, F.lit(" (UTC)")))
    )
