"""A corpus pipeline of five stages, each one of the operators of ``driftplane.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread before the next.  All but the last return the columns of ``documents``; the last
adds ``copy``, the number of the document's copy in the mix (from 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftplane.llm import decontaminate, jaccard, langid, mixing, pii, store

STAGES = [
    ("language_id", langid.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("source_mixing", mixing.stage),
]

#: No stage but the third is expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus made from ``documents``."""
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return docs
