"""Operators for large-scale training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroid_clusters, decontamination, lz_dedup, periodic_runs, preferences, secret_ledger, source_mixing, warc
from .centroid_clusters import op12_centroid_clusters
from .common import shipped
from .context_tree import op7_context_tree_scores
from .cotraining import op1_cotraining_quality
from .decontamination import op2_simhash_decontamination
from .iblt_fingerprints import op3_iblt_fingerprints
from .lz_dedup import op8_relative_lz_dedup
from .packing import op9_harmonic_packing
from .periodic_runs import op11_periodic_runs
from .preferences import op6_preference_pairs
from .secret_ledger import op10_secret_blob_ledger
from .simhash_dedup import op5_simhash_gray_dedup
from .source_mixing import op13_source_mixing
from .warc import op4_warc_round_trip

_QUERIES = (
    op1_cotraining_quality,
    op2_simhash_decontamination,
    op3_iblt_fingerprints,
    op4_warc_round_trip,
    op5_simhash_gray_dedup,
    op6_preference_pairs,
    op7_context_tree_scores,
    op8_relative_lz_dedup,
    op9_harmonic_packing,
    op10_secret_blob_ledger,
    op11_periodic_runs,
    op12_centroid_clusters,
    op13_source_mixing,
)
_SQL = {
    "op2_simhash_decontamination": decontamination.SQL,
    "op4_warc_round_trip": warc.SQL,
    "op6_preference_pairs": preferences.SQL,
    "op8_relative_lz_dedup": lz_dedup.SQL,
    "op10_secret_blob_ledger": secret_ledger.SQL,
    "op11_periodic_runs": periodic_runs.SQL,
    "op12_centroid_clusters": centroid_clusters.SQL,
    "op13_source_mixing": source_mixing.SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: functools.wraps(f)(lambda spark, sf_dir, f=f: f(shipped(spark), sf_dir)) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
