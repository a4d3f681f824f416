"""What several operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut as checkpoint
from ..plans.lineage import release
from ..plans.lineage import shared as checkpoint_dir
from ..plans.lineage import shuffled

__all__ = ["checkpoint", "checkpoint_dir", "fresh", "kept_rows", "partitions", "release", "remove", "shuffled", "sliced", "table", "text_or_empty"]

#: Texts that a task holds as Python values at a time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def kept_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df with the rows that run leaves, all columns as they were; run sees names that aren't plain words, which mapInArrow can't take, as others."""
    plain = df.toDF(*[c if re.fullmatch(r"\w+", c) else f"_column_{k}" for k, c in enumerate(df.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """batches in slices, so that a task holds few texts as Python values; at the end unused memory is given back, as workers stay for later stages."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
