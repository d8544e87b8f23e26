"""The corpus pipeline: quality, repeated lines, near copies, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with their columns; the last adds how
often a document is taken. Stages are separated by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecorpus.llm import decontamination, jaccard, line_dedup, mixing, quality
from rolecorpus.llm.common import settle, spare, spare_prefix


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on labels outside the held-out fold.

    Null and empty texts are scored as texts without words, very long ones whole; repeated rows have one score and stay or go
    together; without labels every score is 0.5 and all stay; an empty table stays empty. Columns of any name come back as they were.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out(F.col("doc_id"), 5, 0))
    score = quality.quality_score(quality.fit_quality(docs, labels))
    return docs.filter(score(F.col("text")) >= quality.THRESHOLD)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has in a repeated unit; their length is counted anew.

    Every row stays. Null and empty texts stay as they are, very long ones are cut whole; of rows that tie by id the content decides
    which is earlier, and rows repeated with one id and text keep the same; an empty table stays empty. A text that lost all lines
    is empty. Columns of any name come back as they were.
    """
    removed = spare(docs, "lines_removed"), spare(docs, "chunks_removed")
    done = line_dedup.dedup_lines(docs, names=removed)
    return done.select(*[F.when(F.col(removed[1]) > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, null ids last, ties to the smaller row key.

    Null, empty and blank texts are nobody's copies and all stay; rows repeated with one id and text leave one; very long texts are
    compared whole; an empty table stays empty. Columns of any name come back as they were.
    """
    return jaccard.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay; very long ones are searched whole; repeated rows stay or go together; without items
    all stay; an empty table stays empty. Columns of any name come back as they were.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``, how often, and ``taken``, their words in all.

    A null source is a source of its own, last in order. Null and empty texts have no words and are taken as often as their hash
    says; rows that share an id are taken alike; very long texts count whole; an empty table stays empty. Columns of any name
    come back as they were; where docs has ``copies`` or ``taken``, the new ones are called so with underscores behind.
    """
    prefix = spare_prefix(docs, "mix_")
    mixed = mixing.mix_sources(docs, prefix=prefix).filter(F.col(f"{prefix}copies") > 0)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{prefix}copies").alias(spare(docs, "copies")), F.col(f"{prefix}taken").alias(spare(docs, "taken")))


STAGES = [("quality", keep_good), ("lines", cut_repeated_lines), ("near_copies", keep_one_of_copies), ("leaks", drop_leaks), ("mix", mix)]

#: The classifier's scores have no SQL; a test holds run() against a plain version of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"pipeline-{name}")
    return docs
