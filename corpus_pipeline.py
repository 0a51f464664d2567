"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and source mixing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but
the last return the columns of documents. Null texts, empty tables, repeated rows and extra columns
are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm import decontaminate, line_dedup, near_dedup, queries, source_mix, toxicity
from linkspan.llm.common import materialise, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    scored = toxicity.score_toxicity(docs, queries.toxicity_model(spark, docs, sf_dir))
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with repeated lines removed; n_chars follows the text. Documents that lose all
    their lines stay with an empty text; as exact copies, the next stage keeps one of them."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return near_dedup.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mix of sources."""
    return source_mix.mix_sources(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_copies),
    ("decontaminate", remove_contaminated),
    ("source_mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs)
    return docs


#: SQL can't express the first, third and last stage; tests hold each stage against brute force.
ORACLE_SQL = None
