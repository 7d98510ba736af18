"""A corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, packing. Each stage calls one operator.

Every stage takes (spark, docs, sf_dir), with the columns of documents, and returns a DataFrame; its result is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import collecting, fresh, release, shared_dir, shipped, table
from tidewheel.llm.cotraining import classify
from tidewheel.llm.decontamination import contaminated, place_of
from tidewheel.llm.packing import pack
from tidewheel.llm.secret_ledger import redacted, scan
from tidewheel.llm.simhash_dedup import near_copies

#: documents(doc_id, text, lang, source, n_chars)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Scratch tables of the stage that ran last. They go when the next one begins, as its result is stored by then; so one
#: pipeline runs at a time in a process.
_scratch: list[str] = []


def stage(made: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(made)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(shipped(spark), _scratch)
        with collecting(_scratch):
            return made(spark, docs, sf_dir)

    return run_stage


def _row_key() -> Column:
    """Rows that are alike in id and text share it; so decisions join back to rows with null or repeated ids too."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.hex(F.xxhash64("text")))


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Null texts are empty, other nulls a value of their own; rows alike
    in id and text share a decision, as do rows of equal score. Without labels of both kinds, and without rows, all stay."""
    key = fresh(docs, "key")
    rows = docs.withColumn(key, _row_key())
    kept = classify(rows, table(spark, sf_dir, "labels"), key=key).where("NOT keep").select(key).distinct()
    return rows.join(kept, key, "left_anti").select(*docs.columns)


@stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or more) the document with the least
    id stays: one row. Rows without an id stay if their group has no row with one; of those, and of rows that repeat the
    least id, the first in order of their keys. Null, empty and wordless texts are copies of each other. No rows give none."""
    key = fresh(docs, "key")
    rows = docs.withColumn(key, _row_key())
    found = near_copies(rows, key, "text")
    known = F.split_part(key, F.lit(":"), F.lit(1)).try_cast("long")
    order = F.struct(known.isNull().alias("none"), known.alias("doc_id"), F.col(key).alias("key"))
    stay = found.groupBy("group").agg(F.min(order)["key"].alias(key)).select(key)
    return rows.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, all rows alike in id and text together. Null, empty and wordless texts
    hold none; ties between windows don't matter here. Without items, and without rows, all stay."""
    key = fresh(docs, "key")
    hits = contaminated(docs, table(spark, sf_dir, "benchmark"), keep_place=True).select(F.col("place").alias(key)).distinct()
    return docs.withColumn(key, place_of("doc_id", "text")).join(hits, key, "left_anti").select(*docs.columns)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in every document; n_chars is that of the new text. Null and empty texts have none and
    stay as they are; of overlapping finds the union is replaced; repeated rows are treated alike. No rows give none."""
    key = fresh(docs, "key")
    rows = docs.withColumn(key, _row_key())
    found, _ = scan(rows, key, None, "text")
    hits = found.where(F.size("spans") > 0).select(F.col("path").alias(key), "spans").dropDuplicates([key])
    spans = fresh(docs, "spans")
    both = rows.join(hits.withColumnRenamed("spans", spans), key, "left")
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(spans)))
    size = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(clean))
    out = both.withColumn("n_chars", size.cast("long")).withColumn("text", clean)
    return out.select(*docs.columns)


@stage
def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens, one row a piece. A null or empty text is its end mark alone; repeated rows
    are packed once each. No rows give none."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("packing", harmonic_packing),
]

#: Classifier and tokenizer can't be written in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir through all stages, each stored and read again."""
    docs = table(shipped(spark), sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tidewheel/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}"
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
