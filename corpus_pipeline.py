"""A training corpus from raw documents: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, line_dedup, near_copies, packing, toxicity
from tablewright.llm.common import checkpoint_dir, remove, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity model, fitted on their labelled ones, gives 0.7 or more."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, machine)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with later copies of repeated runs of lines cut from text; every document stays."""
    return line_dedup.dedup_lines(docs, count=None).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near copies (SimHash, then MinHash bands; links have a five-word Jaccard similarity of 0.8 or more); of rows that repeat a doc_id and its text one stays."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of docs with their places in sequences of 1024 tokens."""
    pieces = packing.pieces(docs)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash_near_dedup", keep_one_of_near_copies), ("benchmark_decontamination", drop_contaminated), ("best_fit_packing", pack)]

#: A fitted model, SimHash and MinHash bands and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = posixpath.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)  # no later stage reads it
        last = path
    return docs
