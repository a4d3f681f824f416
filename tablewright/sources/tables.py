"""CSV and Parquet tables with row numbers, null tokens and types."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .delimited import Dialect, find_dialect, quoted_line_ends, records, samples

ROW = "_row_number"
NULLS = ("NA", "N/A", "", "NULL", "null")


class MissingInput(FileNotFoundError):
    """An input that isn't there, told with the name it has in the configuration."""


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def check_inputs(spark: SparkSession, inputs: dict[str, str]) -> None:
    lost = [f"{name}: {path}" for name, path in inputs.items() if not exists(spark, path)]
    if lost:
        raise MissingInput("inputs not found: " + "; ".join(lost))


def numbered(df: DataFrame, name: str = ROW) -> DataFrame:
    """df with dense row numbers from 1 in file order. df is a scan or a checkpoint: its rows must lie in the same partitions each time.

    Spark's increasing ids are dense within a partition; the rows of earlier
    partitions are added from a table of one row a partition, so the rows are
    neither sorted nor shuffled.
    """
    own = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).cast("int")
    sizes = own.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # one row a partition
    total, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["_n"]
    before = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    low = F.col("_id").bitwiseAND((1 << 33) - 1)
    joined = own.withColumn("_part", part).join(F.broadcast(before), "_part", "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.coalesce("_before", F.lit(0)) + low + 1).alias(name))


FOOTERS = 1_000


def parquet_offsets(spark: SparkSession, files: Sequence[str]) -> dict[str, int]:
    """For each file, in the order of names, the rows of those before it. Footers tell them: the driver reads up to FOOTERS of them, more are read by tasks."""
    files, same = sorted(files), lambda f: re.sub("^file:/+", "file:/", f)
    if len(files) <= FOOTERS:
        hadoop, parquet = spark._jvm.org.apache.hadoop, spark._jvm.org.apache.parquet.hadoop
        counts = {}
        for f in files[:-1]:
            path = hadoop.fs.Path(spark._jvm.java.net.URI(f))
            reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
            counts[same(f)] = reader.getRecordCount()
            reader.close()
    else:
        counts = {same(r["f"]): r["n"] for r in spark.read.parquet(*files).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out, total = {}, 0
    for f in files:
        out[f] = total
        total += counts.get(same(f), 0)
    return out


def numbered_parquet(spark: SparkSession, path: str, name: str = ROW) -> DataFrame:
    """A Parquet table with dense row numbers from 1 in the order of its files' names: a row's place in its file, which the reader knows, and the rows of the files before it.

    Nothing is counted by a job, and as numbers don't depend on how the table
    is read, filters on its columns reach the scan.
    """
    df = spark.read.parquet(path)
    files = df.inputFiles()
    if not files or "_metadata" in {c.lower() for c in df.columns}:
        return numbered(df, name)
    place = F.col("_metadata.row_index") + 1
    if len(files) == 1:
        return df.select("*", place.alias(name))
    same = lambda f: F.regexp_replace(f, "^file:/+", "file:/")
    before = spark.createDataFrame(list(parquet_offsets(spark, files).items()), "_file string, _before long").withColumn("_file", same("_file"))  # one row a file
    own = df.select("*", same(F.col("_metadata.file_path")).alias("_own_file"), place.alias(name))
    joined = own.join(F.broadcast(before), F.col("_own_file") == F.col("_file"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col(name)).alias(name))


def read_csv(spark: SparkSession, path: str, nulls: Sequence[str] = NULLS, multiline: bool | None = None, delimiter: str | None = None, rejected: str | None = None, dialect: Dialect | None = None) -> DataFrame:
    """All columns as text, null tokens as nulls, with row numbers.

    dialect: None finds it on samples, its delimiter as given. multiline: quoted
    line ends inside values; None: where any line holds an odd number of quotes,
    which one pass over the lines tells. Then records are cut by blocks.

    rejected names a column for the whole text of rows that have fewer or more
    values than the file has columns, or a quoted value that doesn't end; null
    for all others. Such rows keep the values that there are. Spark wants the
    result written before that column is read without the others. An empty file
    has no columns.
    """
    d = dialect or dialect_of(spark, path, nulls, delimiter)
    if not d.names:
        return spark.createDataFrame([], f"{ROW} long" + (f", `{rejected}` string" if rejected else ""))
    whole = rejected or "_rejected"
    fields = [*d.names, whole]
    options = {**d.options(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": whole}
    if multiline is None:
        multiline = quoted_line_ends(spark.read.text(path), d)
    if multiline and d.quote:
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in fields)
        rows = records(spark, path, d).select(F.from_csv("record", schema, {k: str(v) for k, v in {**options, "multiLine": True}.items()}).alias("r"), "record", "place", "unclosed")
        told = F.coalesce(F.col(f"r.`{whole}`"), F.when(F.col("unclosed"), F.col("record")))
        df = rows.select(*[F.col("r").getField(c).alias(c) for c in d.names], told.alias(whole), F.col("place").alias(ROW))
    else:
        df = spark.read.csv(path, schema=StructType([StructField(c, StringType()) for c in fields]), header=d.header, **options)
    if nulls:
        df = df.select(*[F.when(F.col(f"`{c}`").isin(*nulls), None).otherwise(F.col(f"`{c}`")).alias(c) if c in d.names else F.col(f"`{c}`") for c in df.columns])
    out = df if multiline and d.quote else numbered(df)
    return out if rejected else out.drop(whole)


def dialect_of(spark: SparkSession, path: str, nulls: Sequence[str] = NULLS, delimiter: str | None = None, quote: str | None = None, escape: str | None = None, header: bool | None = None) -> Dialect:
    """The dialect of a file, searched on samples of it but for what is given."""
    return find_dialect(samples(spark, path), nulls, delimiter, quote, escape, header)


def delimiter_of(lines: Sequence[str]) -> str:
    """The delimiter of CSV lines, the first being the start of their file."""
    return find_dialect(["\n".join(lines)] if lines else []).delimiter


def is_parquet(path: str) -> bool:
    return path.lower().endswith(".parquet")


def read_table(spark: SparkSession, path: str, nulls: Sequence[str] = NULLS, multiline: bool | None = None, delimiter: str | None = None, rejected: str | None = None, dialect: Dialect | None = None) -> DataFrame:
    """Parquet by its suffix, else CSV."""
    return numbered_parquet(spark, path) if is_parquet(path) else read_csv(spark, path, nulls, multiline, delimiter, rejected, dialect)


def _shapes(text: Column) -> dict[str, Column]:
    whole = text.rlike(r"^-?(0|[1-9][0-9]*)$")
    return {
        "bigint": whole & text.try_cast("bigint").isNotNull(),
        "double": text.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & ~text.rlike(r"^-?0[0-9]"),
        "date": text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(),
        "timestamp": text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}$") & text.try_cast("timestamp").isNotNull(),
        "boolean": F.lower(text).isin("true", "false"),
    }


def typed(df: DataFrame, keep: Sequence[str] = (ROW,)) -> DataFrame:
    """df with each text column cast to the first type that all its values have; all columns are judged in one pass. Numbers with leading zeros stay text."""
    texts = [c for c, t in df.dtypes if t == "string" and c not in keep]
    if not texts:
        return df
    verdicts = [F.coalesce(F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), ok)), F.lit(False)).alias(f"{k}:{kind}") for k, c in enumerate(texts) for kind, ok in _shapes(F.col(f"`{c}`")).items()]
    found = df.agg(*verdicts).first().asDict()
    kinds = {c: next((kind for kind in _shapes(F.lit("")) if found[f"{k}:{kind}"]), "string") for k, c in enumerate(texts)}
    return df.select(*[F.col(f"`{c}`").cast(kinds.get(c, t)).alias(c) for c, t in df.dtypes])


def table_name(name: str) -> str:
    """name as a SQL name: letters, digits and underscores."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name)
