"""Scans of platforms: gated by change, filtered and enriched by a user's code, reconciled with the inventory."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..sources.store import stored
from . import ingest as I

Row = dict[str, Any]
FOUND = "platform string, total_found long, new_models long, updated_models long, not_found_models long"


class Source(NamedTuple):
    """A platform's scanner. candidates: name and any other columns, each name once. changed: whether the source has changed since
    a time; without it a scan always runs. keep: a condition, or a function of a candidate. enrich: a function of a candidate that
    gives more about it, or nothing; new_only: just for names that the inventory lacks."""

    candidates: DataFrame
    changed: Callable[[datetime], bool] | None = None
    keep: Column | Callable[[Row], bool] | None = None
    enrich: Callable[[Row], Row | None] | None = None
    new_only: bool = False


#: Candidates that a worker holds as Python objects at a time.
ROWS = 1_000


def asked(candidates: DataFrame, source: Source) -> DataFrame:
    """name, enrichment (JSON, null for nothing), error (null, or what a candidate's enrichment failed with: the others go on) of the
    candidates(..., __new) that pass. A user's functions run in one pass over Arrow batches; a filter that fails stops the job, as
    it has no second way. With new_only just candidates that are __new are enriched."""
    keep, enrich, new_only = source.keep, source.enrich, source.new_only
    if isinstance(keep, Column):
        candidates, keep = candidates.where(keep), None
    if keep is None and enrich is None:
        return candidates.select("name", F.lit(None).cast("string").alias("enrichment"), F.lit(None).cast("string").alias("error"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                own = batch.drop_columns(["__new"])
                if keep:
                    passed = pa.array([bool(keep(row)) for row in own.to_pylist()], pa.bool_())
                    batch, own = batch.filter(passed), own.filter(passed)
                names, more, errors = batch.column("name").to_pylist(), [], []
                for row, new in zip(own.to_pylist() if enrich else [], batch.column("__new").to_pylist()):
                    text = error = None
                    if new or not new_only:
                        try:
                            found = enrich(row)
                            text = json.dumps(found, sort_keys=True, default=str) if found else None
                        except Exception as failed:  # a user's code, whatever it hits
                            error = f"{type(failed).__name__}: {failed}"
                    more.append(text)
                    errors.append(error)
                nothing = [] if enrich else [None] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (names, more + nothing, errors + nothing)], ["name", "enrichment", "error"])

    return candidates.mapInArrow(told, "name string, enrichment string, error string")


class Scanned(NamedTuple):
    """events: name, event_type, payload, source, actor; reports: FOUND, a row a platform; errors: platform, name, error."""

    events: DataFrame
    reports: DataFrame
    errors: DataFrame


def scan(m: DataFrame, s: DataFrame, sources: dict[str, Source], run_id: str, only: str | None = None) -> Scanned:
    """Scan all platforms, or one; an unknown one raises a ValueError. m: model_hash, name; s: model_hash, event_type, source,
    timestamp. A source that hasn't changed since its platform's last event reports zeros. Payloads hold the run's id."""
    if only is not None and only not in sources:
        raise ValueError(f"unknown platform {only}; there are {', '.join(sorted(sources))}")
    spark = m.sparkSession
    events = spark.createDataFrame([], "name string, event_type string, payload string, source string, actor string")
    reports, errors = spark.createDataFrame([], FOUND), spark.createDataFrame([], "platform string, name string, error string")
    for platform, source in sources.items() if only is None else [(only, sources[only])]:
        last = I.last_scan(s, platform).first().at if source.changed else None
        if last is not None and not source.changed(last):
            reports = reports.unionByName(spark.createDataFrame([(platform, 0, 0, 0, 0)], FOUND))
            continue
        # Stored, so that a user's code runs once for each candidate, whatever of the scan is read.
        known = m.select("name", F.lit(False).alias("__new")).distinct()
        flagged = source.candidates.join(known, "name", "left").withColumn("__new", F.col("__new").isNull()) if source.new_only else source.candidates.withColumn("__new", F.lit(True))
        more = stored(asked(flagged.select(*source.candidates.columns, "__new"), source), "asked")
        found, report = I.scan(m, s, more.select("name", "enrichment"), platform)
        texts = more.select("name", F.when(F.coalesce("enrichment", F.lit("{}")) != "{}", F.concat(F.substring("enrichment", F.lit(1), F.length("enrichment") - 1), F.lit(', "scan_run_id": '), F.to_json(F.array(F.lit(run_id))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(run_id)))) - 2), F.lit("}"))).alias("text"))
        plain = F.to_json(F.struct(F.lit(run_id).alias("scan_run_id")))
        rows = found.join(texts, "name", "left").select("name", "event_type", F.when(F.col("event_type") == "enriched", F.col("text")).otherwise(plain).alias("payload"), F.lit(platform).alias("source"), F.lit(f"scanner:{platform}").alias("actor"))
        events = events.unionByName(rows)
        reports = reports.unionByName(report.withColumn("platform", F.lit(platform)))
        errors = errors.unionByName(more.where("error IS NOT NULL").select(F.lit(platform).alias("platform"), "name", "error"))
    return Scanned(events, reports, errors)


def parsed(files: DataFrame, parser: Callable[[str, str], Row | None]) -> DataFrame:
    """project, item (JSON), error: what a parser makes of files(project, content): one object each, or none. A file that it fails
    on gives its error. The items are nodes as inline_nodes reads them."""

    class Parse:
        def eval(self, project: str, content: str) -> Iterator[tuple]:
            try:
                found = parser(project, content)
            except Exception as failed:
                yield None, f"{type(failed).__name__}: {failed}"
                return
            if found is not None:
                yield json.dumps(found), None

    spark: SparkSession = files.sparkSession
    spark.udtf.register("tidewheel_parse", udtf(Parse, returnType="item string, error string"))
    return spark.sql("SELECT f.project, p.item, p.error FROM {files} f, LATERAL tidewheel_parse(f.project, f.content) p", files=files)
