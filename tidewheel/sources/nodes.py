"""Nodes from files, tables and APIs: name, platform, ports and metadata."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one JSON array of objects."""
    return spark.read.option("multiLine", True).json(path)


def json_directory(spark: SparkSession, path: str) -> DataFrame:
    """A directory with one indented JSON object a file."""
    return spark.read.option("multiLine", True).json(f"{path}/*.json")


def pipelines(df: DataFrame, name: str, timestamp: str) -> DataFrame:
    """One row a pipeline that wrote to a table: first and last output and number of rows, the latest first; null names don't
    count."""
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(timestamp).alias("first_output"), F.max(timestamp).alias("last_output"), F.count("*").alias("total_rows")).orderBy(F.desc("last_output"), "name")


def port(identifier: Column, **schema: Column) -> Column:
    """A port with a lower-case identifier; null without one."""
    pairs = [x for k, v in schema.items() for x in (F.lit(k), v)]
    keys = F.create_map(*pairs) if pairs else F.expr("CAST(map() AS MAP<STRING,STRING>)")
    return F.when(F.coalesce(identifier, F.lit("")) != "", F.struct(F.lower(identifier).alias("identifier"), F.map_filter(keys, lambda k, v: v.isNotNull()).alias("schema")))


def rows_to_nodes(df: DataFrame, name: str, platform: str, prefix: str = "", inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = (), metadata: tuple[str, ...] | None = None) -> DataFrame:
    """One node a row: columns become ports and metadata; without a list of metadata columns, all other columns do."""
    rest = metadata if metadata is not None else tuple(c for c in df.columns if c not in (name, *inputs, *outputs))
    ports = lambda cols: F.array_compact(F.array(*[port(F.col(c)) for c in cols])) if cols else F.expr("CAST(array() AS ARRAY<STRUCT<identifier:STRING,schema:MAP<STRING,STRING>>>)")
    meta = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if rest else F.expr("CAST(map() AS MAP<STRING,STRING>)")
    return df.select(F.concat(F.lit(prefix), F.col(name)).alias("name"), F.lit(platform).alias("platform"), ports(inputs).alias("inputs"), ports(outputs).alias("outputs"), meta.alias("metadata"))


NO_SCHEMA = "CAST(map() AS MAP<STRING,STRING>)"
NO_PORTS = "CAST(array() AS ARRAY<STRUCT<identifier:STRING,schema:MAP<STRING,STRING>>>)"
#: Parts of names of tables that many models write to; there, ports are told apart by model name.
SHARED = ("scores", "alert")


def one_port(identifier: Column, schema: Column) -> Column:
    return F.struct(F.lower(identifier).alias("identifier"), schema.alias("schema"))


def sql_nodes(
    df: DataFrame, platform: str, name: str, prefix: str = "", inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = (), sql: str | None = None,
    preprocess: Callable[[Column], Column] | None = T.strip_templates, shared: tuple[str, ...] = SHARED, fallback: str | None = None, strip_prefix: str = "",
    cron: str | None = None, input_port: dict[str, str] | None = None, output_port: dict[str, str] | None = None, metadata: dict[str, str] | None = None,
) -> DataFrame:
    """name, platform, inputs, outputs, metadata: one node a row of a job table.

    inputs and outputs: columns that name ports; empty and null ones give none. sql: a column of SQL text, whose tables
    become ports; on shared tables (names that contain one of `shared`) with the models that the text filters by, or, for
    written ones, the column `fallback` without strip_prefix (a pattern). input_port, output_port: {"column", "fallback",
    and constant schema entries}. cron: a column that is put into words. metadata: {key: column}; without it all columns
    that serve nothing else. Null values are left out; node_type is the platform unless given.
    """
    plain = lambda cols: F.filter(F.array(*[F.when(F.col(c).cast("string") != "", one_port(F.col(c).cast("string"), F.expr(NO_SCHEMA))) for c in cols]), lambda p: p.isNotNull()) if cols else F.expr(NO_PORTS)
    into, out = [plain(inputs)], [plain(outputs)]
    if sql:
        text = F.coalesce(F.col(sql), F.lit(""))
        text = preprocess(text) if preprocess else text
        df = df.withColumns({"__reads": T.read_tables(text), "__writes": T.write_tables(text), "__models": T.model_filters(text)})
        is_shared = lambda t: F.exists(F.array(*[F.lit(x) for x in shared]), lambda x: F.contains(F.lower(t), x)) if shared else F.lit(False)
        by_model = lambda v: F.create_map(F.lit("model_name"), v)
        filtered = F.size("__models") > 0
        into.append(F.flatten(F.transform("__reads", lambda t: F.when(filtered & is_shared(t), F.transform("__models", lambda v: one_port(t, by_model(v)))).otherwise(F.array(one_port(t, F.expr(NO_SCHEMA)))))))
        schema = lambda t: F.when(filtered, by_model(F.get("__models", F.lit(0))))
        if fallback:
            own = F.regexp_replace(F.coalesce(F.col(fallback).cast("string"), F.lit("")), f"^(?:{strip_prefix})", "") if strip_prefix else F.coalesce(F.col(fallback).cast("string"), F.lit(""))
            out.append(F.transform("__writes", lambda t: one_port(t, F.coalesce(schema(t), F.when(is_shared(t), by_model(own)), F.expr(NO_SCHEMA)))))
        else:
            out.append(F.transform("__writes", lambda t: one_port(t, F.coalesce(schema(t), F.expr(NO_SCHEMA)))))
    used = {name, *inputs, *outputs, *[c for c in (sql, cron) if c], "__reads", "__writes", "__models"}
    for config, ports in ((input_port, into), (output_port, out)):
        if config:
            columns = [config[k] for k in ("column", "fallback") if k in config]
            used.update(columns)
            value = F.coalesce(*[F.col(c).cast("string") for c in columns])
            constant = [F.lit(x) for k, v in config.items() if k not in ("column", "fallback") for x in (k, v)]
            schema = F.create_map(*constant) if constant else F.expr(NO_SCHEMA)
            ports.append(F.when(value.isNotNull(), F.array(one_port(value, schema))).otherwise(F.expr(NO_PORTS)))
    given = metadata if metadata is not None else {c: c for c in df.columns if c not in used}
    meta = {k: F.col(c).cast("string") for k, c in given.items()}
    if cron:
        has = F.coalesce(cron, F.lit("")) != ""
        meta |= {"cron": F.when(has, F.col(cron)), "run_frequency": F.when(has, T.cron_in_english(F.col(cron)))}
    meta["node_type"] = F.coalesce(meta.get("node_type", F.lit(None)), F.lit(platform))
    entries = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)])
    return df.select(F.concat(F.lit(prefix), F.col(name).cast("string")).alias("name"), F.lit(platform).alias("platform"), F.concat(*into).alias("inputs"), F.concat(*out).alias("outputs"), F.map_filter(entries, lambda k, v: v.isNotNull()).alias("metadata"))


def logged_nodes(s: DataFrame, m: DataFrame) -> DataFrame:
    """name, platform, inputs, outputs: the nodes that the latest discovered event of each model describes."""
    of = s.where("event_type = 'discovered'").groupBy("model_hash").agg(F.max_by("payload", F.struct("timestamp", "snapshot_hash")).alias("payload"))
    rows = of.join(m.select("model_hash", "name"), "model_hash").withColumn("p", F.from_json("payload", "platform string, inputs array<map<string,string>>, outputs array<map<string,string>>"))
    ports = lambda side: F.transform(F.coalesce(f"p.{side}", F.expr("CAST(array() AS ARRAY<MAP<STRING,STRING>>)")), lambda x: one_port(x["identifier"], F.map_filter(x, lambda k, v: k != "identifier")))
    return rows.select("name", "p.platform", ports("inputs").alias("inputs"), ports("outputs").alias("outputs"))


def json_nodes(items: DataFrame, platform: str, name: str, inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = (), metadata: dict[str, str] | None = None) -> DataFrame:
    """name, platform, inputs, outputs, metadata: one node a row of items(item), JSON objects.

    name, inputs, outputs and the values of metadata are dotted paths. Missing and empty values give no port; without a
    list of metadata, all top-level keys that serve nothing else and aren't null do. node_type is the platform unless
    given. An item without a name has an empty one.
    """
    at = lambda path: F.get_json_object("item", f"$.{path}")
    ports = lambda paths: F.filter(F.array(*[F.when(at(x) != "", one_port(at(x), F.expr(NO_SCHEMA))) for x in paths]), lambda p: p.isNotNull()) if paths else F.expr(NO_PORTS)
    if metadata is None:
        used = (name, *inputs, *outputs)
        entries = F.map_filter(F.from_json("item", "map<string,string>"), lambda k, v: v.isNotNull() & ~k.isin(*used))
    else:
        entries = F.map_filter(F.create_map(*[x for k, path in metadata.items() for x in (F.lit(k), at(path))]), lambda k, v: v.isNotNull())
    typed = F.when(F.map_contains_key(entries, "node_type"), entries).otherwise(F.map_concat(entries, F.create_map(F.lit("node_type"), F.lit(platform))))
    return items.select(F.coalesce(at(name), F.lit("")).alias("name"), F.lit(platform).alias("platform"), ports(inputs).alias("inputs"), ports(outputs).alias("outputs"), typed.alias("metadata"))


def inline_nodes(items: DataFrame) -> DataFrame:
    """The nodes that items(item) spell out as JSON objects: name, platform, inputs and outputs (lists of identifiers); all
    other keys are metadata. Of a file of such objects, json_array gives the rows."""
    own = ("name", "platform", "inputs", "outputs")
    ports = lambda side: F.transform(F.coalesce(F.from_json(F.get_json_object("item", f"$.{side}"), "array<string>"), F.expr("CAST(array() AS ARRAY<STRING>)")), lambda x: one_port(x, F.expr(NO_SCHEMA)))
    meta = F.map_filter(F.from_json("item", "map<string,string>"), lambda k, v: ~k.isin(*own))
    return items.select(F.get_json_object("item", "$.name").alias("name"), F.coalesce(F.get_json_object("item", "$.platform"), F.lit("")).alias("platform"), ports("inputs").alias("inputs"), ports("outputs").alias("outputs"), meta.alias("metadata"))


def deployment_nodes(df: DataFrame, platform: str, tags: tuple[str, ...] = ()) -> DataFrame:
    """name, platform, metadata of deployments(name, tags, cron, entrypoint, version, updated), those with all of `tags`;
    each name once, that updated last. Tags of the form k:v give application, repo and owner (from author)."""
    rows = df.where(F.forall(F.array(*[F.lit(t) for t in tags]), lambda t: F.array_contains("tags", t))) if tags else df
    rows = rows.groupBy("name").agg(F.max(F.struct("updated", "cron", "entrypoint", "version", "tags")).alias("d")).select("name", "d.*")
    of = T.tag_pairs(F.filter(F.coalesce("tags", F.expr("CAST(array() AS ARRAY<STRING>)")), lambda t: F.contains(t, F.lit(":"))))
    meta = {"node_type": F.lit("deployment"), "application": of["application"], "repo": of["repo"], "owner": of["author"], "schedule": F.col("cron"), "has_schedule": F.col("cron").isNotNull().cast("string"), "entrypoint": F.col("entrypoint"), "version": F.col("version"), "source_updated_at": F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss")}
    return rows.select("name", F.lit(platform).alias("platform"), F.map_filter(F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()).alias("metadata"))


def config_files(df: DataFrame) -> DataFrame:
    """project, content: files that an API gives in base64, as text; what can't be decoded is left out."""
    return df.select("project", F.try_to_binary("content", F.lit("base64")).cast("string").alias("content")).where("content IS NOT NULL")


#: Connectors that a configuration alone can drive, and those that need more than that.
CONNECTORS: dict[str, Callable[..., DataFrame]] = {"rest": json_nodes, "deployments": deployment_nodes}
NEED_CODE = {"sql": "a connection", "files": "a parser"}


def discovered(connector: str | None, rows: DataFrame, config: dict) -> tuple[DataFrame | None, list[str]]:
    """(nodes, errors) of a connector by name over its rows. What can't be done is said in errors and never raised."""
    if not connector:
        return None, ["a connector's name is required"]
    if connector in NEED_CODE:
        return None, [f"the connector {connector} needs {NEED_CODE[connector]}, which a configuration can't give"]
    if connector not in CONNECTORS:
        return None, [f"unknown connector {connector}; there are {', '.join(sorted(CONNECTORS))}"]
    try:
        return CONNECTORS[connector](rows, **config), []
    except Exception as failed:  # a wrong configuration, whatever it hits
        return None, [f"the connector {connector} failed: {failed}"]


class PagedJson(DataSource):
    """spark.read.format("paged_json"): JSON pages linked by a token. Options: url, items (dotted path), token (dotted
    path to the next page's token), param (query parameter), headers (a JSON object). One row an item, as JSON text. Pages follow each other, so
    one URL is one partition; several URLs, separated by blanks, are read side by side."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedJsonReader(self.options)


def at(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


class PagedJsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(url) for url in self.options["url"].split()]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        token = None
        while True:
            url = partition.value
            if token:
                url += f"{'&' if '?' in url else '?'}{self.options.get('param', 'page_token')}={token}"
            asked = urllib.request.Request(url, headers=json.loads(self.options.get("headers", "{}")))
            with urllib.request.urlopen(asked, timeout=30) as answer:
                page = json.load(answer)
            for item in at(page, self.options.get("items", "items")) or []:
                yield (json.dumps(item),)
            token = at(page, self.options["token"]) if "token" in self.options else None
            if not token:
                return


def rest_nodes(
    spark: SparkSession, url: str, platform: str, name: str, items: str = "items", inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = (), metadata: dict[str, str] | None = None, headers: dict[str, str] | None = None,
    token: str | None = None, param: str = "page_token",
) -> DataFrame:
    """The nodes of an API's items, page after page (see PagedJson) and mapped as json_nodes says."""
    spark.dataSource.register(PagedJson)
    options = {"url": url, "items": items, "headers": json.dumps(headers or {}), "param": param} | ({"token": token} if token else {})
    return json_nodes(spark.read.format("paged_json").options(**options).load(), platform, name, inputs, outputs, metadata)
