"""Repeated runs of lines, found in a suffix array over line ids, later copies deleted.

Lines get ids; a line that occurs once ends any repeated run, so only stretches
of repeated lines with enough words go on, equal stretches as one. Over their
suffixes a suffix array is built by prefix doubling: the rank of a suffix by
its first 2^(k+1) lines is the place of the pair (its rank by 2^k lines, the
rank 2^k lines further on) in the sorted list of distinct pairs. Ranks of two
overlapping powers of two tell whether two suffixes share their first L lines,
that is whether they lie in one longest-common-prefix interval of depth L.

A run counts if it has ``min_words`` words or more. Its first place in the
order of (doc_id, line) is kept; each later one is deleted. It is enough to
look at the shortest counting run from each line onward and up to each line:
every longer one is covered by such runs inside it, and where the longer run
has an earlier copy, they have too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, shuffled, text_or_empty

MIN_WORDS = 50
SENT_BYTES = 32 << 20  # of the places to delete; up to so much is sent to the tasks
_OTHER = 0x5BD1E995  # a second seed, for ids of 128 bits


def _lines(docs: DataFrame) -> DataFrame:
    text = docs.select("doc_id", text_or_empty().alias("text"))
    each = text.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("line", "own"))
    return each.select("doc_id", "version", "line", F.xxhash64("own").alias("h"), F.xxhash64(F.lit(_OTHER), "own").alias("g"), F.regexp_count("own", F.lit(r"\S+")).alias("words"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Maximal stretches of repeated lines: doc_id, version, start, ids (array of (h, g)), words (array), s and t (hashes of ids)."""
    # Written first: a join with the aggregate itself would share its exchange, whose hot lines Spark can't split.
    repeated = checkpoint(lines.groupBy("h", "g").agg(F.count("line").alias("n")).filter("n > 1").select("h", "g"))
    kept = lines.join(repeated, ["h", "g"], "left_semi")
    by_doc = Window.partitionBy("doc_id", "version").orderBy("line")
    islands = kept.withColumn("island", F.col("line") - F.dense_rank().over(by_doc))
    grouped = islands.groupBy("doc_id", "version", "island").agg(F.sort_array(F.collect_set(F.struct("line", "h", "g", "words"))).alias("own"))
    whole = grouped.select("doc_id", "version", F.col("own")[0]["line"].alias("start"), F.transform("own", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))).alias("ids"), F.col("own.words").alias("words"))
    counting = whole.filter(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x) >= min_words)
    return counting.withColumns({"s": F.xxhash64("ids"), "t": F.xxhash64(F.lit(_OTHER), "ids")})


def shortest_runs(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Distinct (first, length) of the shortest runs with min_words words from each line onward and up to each line."""
    before = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    first = np.arange(n)
    end = np.searchsorted(before, before[:n] + min_words, "left")
    onward = [(int(i), int(e - i)) for i, e in zip(first, end) if e <= n]
    begin = np.searchsorted(before, before[1:] - min_words, "right") - 1
    upto = [(int(b), int(j + 1 - b)) for j, b in zip(first, begin) if b >= 0]
    return sorted({*onward, *upto})


def _runs(segments: DataFrame, min_words: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, i, n) for s, w in zip(batch.column("seg").to_pylist(), batch.column("words").to_pylist()) for i, n in shortest_runs(np.array(w, dtype=np.int64), min_words)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["seg", "i", "n"])

    return segments.select("seg", "words").mapInArrow(find, "seg long, i int, n int")


def _ranked(keys: DataFrame) -> DataFrame:
    """Distinct keys with rank: increasing in the order of the keys, not dense."""
    return checkpoint(keys.distinct().orderBy(*keys.columns).withColumn("rank", F.monotonically_increasing_id()))


def intervals(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (seg, i, n) with depth n and ranks a and b that name the interval of suffixes which share their first n lines.

    No suffixes are broadcast: one plan joins them twice for each level, and the driver would hold all of these at once.
    """
    lines = segments.select("seg", F.posexplode("ids").alias("i", "id")).select("seg", "i", "id.h", "id.g")
    suffixes = checkpoint(shuffled(lines).join(_ranked(lines.select("h", "g")), ["h", "g"]).select("seg", "i", "rank"))
    longest = runs.agg(F.max("n")).first()[0] or 0
    reach, out = 1, None
    while reach <= longest:
        own = runs.filter((F.col("n") >= reach) & (F.col("n") < 2 * reach))
        here = own.join(shuffled(suffixes.withColumnRenamed("rank", "a")), ["seg", "i"])
        there = suffixes.select("seg", F.col("i").alias("last"), F.col("rank").alias("b"))
        level = here.withColumn("last", F.col("i") + F.col("n") - reach).join(shuffled(there), ["seg", "last"]).select("seg", "i", "n", "a", "b")
        out = level if out is None else out.unionByName(level)
        if 2 * reach <= longest:
            onward = Window.partitionBy("seg").orderBy("i")
            pairs = suffixes.withColumn("after", F.coalesce(F.lead("rank", reach).over(onward), F.lit(-1)))
            ranked = _ranked(pairs.select("rank", "after").withColumnRenamed("rank", "first"))
            suffixes = checkpoint(shuffled(pairs.withColumnRenamed("rank", "first")).join(ranked, ["first", "after"]).select("seg", "i", "rank"))
        reach *= 2
    return out if out is not None else runs.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The places to delete: doc_id, version (hash of the text), first, last (line numbers from 0, runs may overlap)."""
    stretches = checkpoint(_stretches(checkpoint(_lines(docs)), min_words))
    place = F.struct("doc_id", "version", "start")
    distinct = stretches.groupBy("s", "t").agg(F.min(F.struct("doc_id", "version", "start", "ids", "words")).alias("own"))
    segments = checkpoint(distinct.select("s", "t", "own.*").withColumn("seg", F.monotonically_increasing_id()))
    firsts = segments.select("s", "t", place.alias("first"))
    copies = stretches.join(firsts, ["s", "t"]).filter(place > F.col("first"))
    whole = copies.select("doc_id", "version", F.col("start").alias("first"), (F.col("start") + F.size("ids") - 1).alias("last"))
    runs = checkpoint(_runs(segments, min_words))
    named = intervals(segments, runs)
    at = segments.select("seg", "doc_id", "version", "start")
    placed = checkpoint(named.join(at, "seg").withColumn("place", F.struct("doc_id", "version", (F.col("start") + F.col("i")).alias("line"))).select("n", "a", "b", "place"))
    least = placed.groupBy("n", "a", "b").agg(F.min("place").alias("least"), F.count("place").alias("count")).filter("count > 1").drop("count")
    later = placed.join(least, ["n", "a", "b"]).filter(F.col("place") > F.col("least"))
    inside = later.select("place.doc_id", "place.version", F.col("place.line").alias("first"), (F.col("place.line") + F.col("n") - 1).alias("last"))
    return whole.unionByName(inside)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, count: str | None = "deleted_lines") -> DataFrame:
    """docs with text less the later copies of repeated runs of lines, and their number (int) in the column that count names, unless that is None.

    Every row stays, wholly deleted texts as ''. A null text stays null. Rows
    with equal doc_id and text count as one document and get the same text.
    Ties: of equal runs the one with the least (doc_id, text hash, line) stays;
    a null doc_id is least. Other columns are kept as they are; a column that
    has the count's name is replaced. No rows: no rows.
    """
    docs = docs.drop(count) if count else docs
    per = repeated_runs(docs, min_words).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "last")).alias("cut"))
    id_, version, cut = (fresh(docs, x) for x in ("cut_id", "cut_version", "cut_lines"))
    per = checkpoint(per.select(F.col("doc_id").alias(id_), F.col("version").alias(version), F.array_distinct(F.flatten(F.transform("cut", lambda r: F.sequence(r["first"], r["last"])))).alias(cut)))
    size = per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(cut)), F.lit(0)).alias("lines")).first()
    if 64 * size["n"] + 4 * size["lines"] <= SENT_BYTES:
        per = F.broadcast(per)  # else the texts are shuffled
    joined = docs.join(per, docs["doc_id"].eqNullSafe(per[id_]) & (F.xxhash64(text_or_empty()) == per[version]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(left)
    deleted = [F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).alias(count)] if count else []
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *deleted)
