"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage works on all rows that the one before kept, and what it decides takes
effect: rejected languages, duplicates and leaks go, later repeated runs of lines
are cut out of the texts. All stages but the last return the columns of
``documents``; their results are written to the shared folder and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts of which no language has half the letters."""
    from pit_engine.llm.langid import keep_identified, learn

    return keep_identified(docs, learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeated runs of lines out of the texts."""
    from pit_engine.llm.linededup import dedup_lines

    done = dedup_lines(docs)
    cut = F.col(done.columns[-1]).isNotNull()
    n_chars = F.when(cut, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    from pit_engine.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    from pit_engine.llm.decontam import drop_leaks

    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left: one row for each piece."""
    from pit_engine.llm.packing import pack_documents

    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Language models, edit distances and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    from pit_engine.llm.store import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
