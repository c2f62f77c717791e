"""From raw documents to packed training sequences: quality rules, line deduplication, near
duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. Stages are written to the shared folder and read again, so
a lost executor costs the current stage only. The quality rules take rejected documents away; line
deduplication shortens texts (n_chars follows); of each group of near duplicates (five-word
shingles, similarity 0.8) the least id stays; contaminated documents go, others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainalerts.llm import circulant_minhash, fm_index, host_rules, line_runs, packing
from chainalerts.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_runs.line_dedup(docs, min_docs=10)
    shortened = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("n_chars", F.coalesce(shortened, "n_chars")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return circulant_minhash.deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_index.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, *packing.tokenizer_files()))


STAGES = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("packing", pack),
]
# Token ids are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
