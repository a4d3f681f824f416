"""Vocabularies as tables, and the nearest of their words.

A vocabulary of any size is a table (word, ordinal). Values are told apart by a
join with it: broadcast while its measured size is small beside a driver's
memory, otherwise one that Spark can split where many rows hold the same value.

The nearest word within two edits is found by an index of what is left of words
after deletions: two texts are that near only if some text can be made of both
by up to two deletions. Long words are cut in three instead: two edits leave at
least one part as it was, at most two places from where it stood. Only 64-bit
hashes of keys and texts are sent and met; each pair of candidates is joined with
its texts once, so that hashes which collide lose nothing, and verified by its
edit distance. Of equally near words the first counts. Words within one edit are
looked for first, among far fewer keys; only values that have none go on to two.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import lineage
from ..plans.lineage import cut, shuffled

EDITS = 2
SHORT = 32  # the longest words whose deletions are indexed
SENT = 4 << 20  # bytes of words that are sent to all tasks; the driver holds them several times over


def words_table(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """(word, ordinal), written, so that no plan holds the words; of repeated words the first."""
    first = list(dict.fromkeys(words))
    return cut(spark.createDataFrame(pa.table({"word": pa.array(first, pa.string()), "ordinal": pa.array(range(len(first)), pa.int64())})))


def sized(words: DataFrame) -> DataFrame:
    """The different words, marked to be broadcast if they are small, and not to be if they aren't, as Spark may take a compressed file for the size of its words."""
    words = words.select("word").distinct()
    size = words.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0
    return F.broadcast(words) if size <= SENT else shuffled(words)


def _deletions(text: Column, edits: int) -> Column:
    """text and all that up to so many deletions, 1 or 2, leave of it."""
    none = F.array().cast("array<string>")
    once = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda k: F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.length(s))))).otherwise(none)
    first = F.array_distinct(once(text))
    return F.array_distinct(F.concat(F.array(text), first, *([F.flatten(F.transform(first, once))] if edits > 1 else [])))


def _parts(text: Column, length: Column, moves: Sequence[int]) -> list[Column]:
    """Keys (length of the word, part, its text) of the three parts of a word of that length, as they stand in text moved by so many places."""
    third = F.floor(length / 3).cast("int")
    starts, sizes = [F.lit(0), third, third * 2], [third, third, length - third * 2]
    return [F.concat_ws(":", length, F.lit(k), F.substring(text, starts[k] + 1 + m, sizes[k])) for k in range(3) for m in moves if k or m >= 0]


def _within(own: DataFrame, words: DataFrame, edits: int) -> DataFrame:
    """(value, nearest) of own (value, asks) that have words (word, ordinal, has) within so many edits. Nothing is broadcast, as a text has some hundred keys that Spark sizes as one."""
    hashed = lambda keys: F.explode(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))).alias("key")
    short = words.filter(F.length("word") <= SHORT).select("has", hashed(_deletions(F.col("word"), edits)))
    asked = own.filter(F.length("value") <= SHORT + edits).select("asks", hashed(_deletions(F.col("value"), edits)))
    long = words.filter(F.length("word") > SHORT).select("has", hashed(F.array(*_parts(F.col("word"), F.length("word"), [0]))))
    around = range(-edits, edits + 1)
    keys = F.array(*[k for d in around for k in _parts(F.col("value"), F.length("value") + d, list(around))])
    asked_long = own.filter(F.length("value") > SHORT - edits).select("asks", hashed(keys))
    met = [shuffled(asked).join(short, "key").select("asks", "has"), shuffled(asked_long).join(long, "key").select("asks", "has")]
    pairs = shuffled(met[0].unionByName(met[1]).distinct()).join(own, "asks").join(shuffled(words), "has")
    near = pairs.select("value", F.struct(F.levenshtein("value", "word", edits).alias("edits"), "ordinal", "word").alias("own")).filter("own.edits >= 0")
    return near.groupBy("value").agg(F.min("own").alias("own")).select("value", F.col("own.word").alias("nearest"))


def nearest_words(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, nearest) of the different values that have a word within EDITS edits, the nearest one, and of equally near ones the first. values: a column value; words: (word, ordinal). Nulls have none."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else the few bytes of all words meet in a task that writes some hundred rows for each
    own = cut(values.filter("value is not null").select("value").distinct().withColumn("asks", F.xxhash64("value")).repartition(tasks, "asks"))
    words = cut(words.groupBy("word").agg(F.min("ordinal").alias("ordinal")).withColumn("has", F.xxhash64("word")).repartition(tasks, "has"))
    close = lineage.cut(_within(own, words, 1))
    rest = own.join(close.select("value"), "value", "left_anti").repartition(tasks, "asks")
    return close.unionByName(_within(lineage.cut(rest), words, EDITS))
