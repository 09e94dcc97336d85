"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

toxicity: documents predicted toxic go. line_dedup: lines that an earlier document holds go; a document
that loses all of them stays, empty. near_dedup: one document of each near-duplicate group stays.
decontaminate: documents that hold a benchmark window go. pack: the rest becomes fixed-length sequences.
All but the last return the columns of documents; from line_dedup on n_chars is the length of the text.

Defined results, for every stage: an empty table gives an empty table, extra columns of documents pass
unchanged, and each row is judged by its own text, also where ids are null or repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from helixframe.llm.common import fresh_name, table, written

#: The most rows that a stage names to every task; beyond it they are joined by shuffle.
MAX_IDS = 2_000_000


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among the distinct keys of gone."""
    name = fresh_name(docs, "__key")
    gone = gone.withColumnRenamed("key", name)
    return docs.withColumn(name, key).join(F.broadcast(gone) if gone.count() <= MAX_IDS else gone, name, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text is not toxic and stays."""
    gone = toxicity.text_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("key")
    return without(docs, toxicity.text_key(F.col("text")), gone)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text becomes empty; rows that repeat an id are one document, so lines that they share stay in them."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go by id and text: of a repeated id only those go whose text has a copy in a smaller id. Empty texts and null ids without a copy stay."""
    gone = written(near_dedup.with_keys(docs).where("NOT kept").select("key").distinct(), "near-duplicates")
    return without(docs, near_dedup.row_key("doc_id", "text"), gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text holds no benchmark window and stays."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document; a null text is one separator."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pack", pack)]

#: The first stage is learned and the third and last are searches; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
