"""Near-duplicates by SimHash fingerprints that differ in few bits.

Ball hashing, met in the middle. Two 64-bit fingerprints at distance 3 or less
agree in one 32-bit half up to one bit (half the radius, rounded down), so each
fingerprint emits, for either half, the half and its 32 variants of one flipped
bit: 66 short rows, shuffled on the variant. Of those that meet in a variant,
up to ``LIST`` are compared at once. Fuller buckets are split by the same step
on the other half, in pieces of 16 bits; what is still fuller is resolved by
balls of the whole word about the variant: A, all within one bit, and B, those
that flip two bits of the other half. A and B of two fingerprints meet in a
word exactly when their distance is 3 or less (of the differing bits A takes
one, B the rest), and by the triangle inequality all members of a word are
within 3 bits of an A member, so linking all of them to the least A member is
exact and linear in the bucket. No bucket is capped and no step lists the pairs
of a group; every link is verified by bit_count(xor).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, shuffled, sliced, text_or_empty
from .components import components

DISTANCE = 3
LIST = 64
WORDS = 3


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64 bits; 0 for a text without words. bytes.lower() changes A-Z only, bytes.split() splits on ASCII blanks only."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    count = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=">u8", count=count)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    slim = docs.select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def _flips(first: int, bits: int = 32) -> list[int]:
    return [_signed(1 << (first + k)) for k in range(bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _each(masks: list[int], make: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(*[F.lit(x) for x in masks]), make)


def _variant(half: int, mask: int) -> Callable[[Column], Column]:
    return lambda f: F.struct(F.lit(half).alias("half"), F.col("fp").bitwiseXOR(f).bitwiseAND(mask).alias("key"), F.lit(1).alias("near"))


def _moved(flips: int) -> Callable[[Column], Column]:
    return lambda f: F.struct(F.col("word").bitwiseXOR(f).alias("word"), F.lit(flips).alias("flips"))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct values fp of prints that join all pairs at most three bits apart."""
    once = prints.select("fp").distinct().repartition(partitions(prints.sparkSession), F.xxhash64("fp"))  # else the few bytes of all fingerprints meet in a few tasks that write 66 rows for each
    rows = []
    for half, first in enumerate((32, 0)):  # half 0 is the upper one
        mask = _signed(0xFFFFFFFF << first)
        none = F.struct(F.lit(half).alias("half"), (F.col("fp").bitwiseAND(mask)).alias("key"), F.lit(0).alias("near"))
        near = _each(_flips(first), _variant(half, mask))
        rows.append(F.concat(F.array(none), near))
    halves = once.select("fp", F.explode(F.concat(*rows)).alias("v")).select("fp", "v.*")
    kept = checkpoint(_met(halves, ["half", "key"], "near"))
    # Buckets that are too full to compare at once: the same step on pieces of the other half.
    full = kept.filter(F.col("n") > LIST).drop("n")
    pieces = []
    for half in (0, 1):
        for piece, first in enumerate((_other(half), _other(half) + 16)):
            mask = _signed(0xFFFF << first)
            none = F.struct(F.lit(piece).alias("piece"), F.col("fp").bitwiseAND(mask).alias("part"), F.lit(0).alias("turned"))
            near = _each(_flips(first, 16), _part(piece, mask))
            pieces.append(full.filter(F.col("half") == half).select("half", "key", "near", "fp", F.explode(F.concat(F.array(none), near)).alias("v")).select("half", "key", "near", "fp", "v.*"))
    split = pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).unionByName(pieces[3])
    split = checkpoint(_met(split, ["half", "key", "piece", "part"], "turned"))
    dense = split.filter(F.col("n") > LIST).select("half", "key", "near", "fp").distinct()
    listed = _listed(kept.filter(F.col("n") <= LIST), ["half", "key"], F.col("near") == 0)
    listed = listed.unionByName(_listed(split.filter(F.col("n") <= LIST), ["half", "key", "piece", "part"], (F.col("near") == 0) & (F.col("turned") == 0)))
    pairs = listed.unionByName(_balls(dense)).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)


def _other(half: int) -> int:
    """The first bit of the half that isn't half."""
    return 0 if half == 0 else 32


def _part(piece: int, mask: int) -> Callable[[Column], Column]:
    return lambda f: F.struct(F.lit(piece).alias("piece"), F.col("fp").bitwiseXOR(f).bitwiseAND(mask).alias("part"), F.lit(1).alias("turned"))


def _met(rows: DataFrame, bucket: list[str], flips: str) -> DataFrame:
    """rows of buckets that are the own value of one fingerprint and met by another, with n. Two that meet by flips of both alone are two bits apart here and meet elsewhere."""
    met = rows.groupBy(*bucket).agg(F.count("fp").alias("n"), F.min(flips).alias("own")).filter("n > 1 and own = 0").drop("own")
    return shuffled(rows).join(met, bucket)  # rows are 66 for each fingerprint, sized as one


def _listed(rows: DataFrame, bucket: list[str], own: Column) -> DataFrame:
    """Links (a, b) within buckets of at most LIST fingerprints; own: the row's bucket is its own value. A link shows in the bucket of its smaller end, so it is made only there."""
    lists = rows.groupBy(*bucket).agg(F.collect_set(F.when(own, F.col("fp"))).alias("owners"), F.collect_set("fp").alias("fps"))
    close = F.flatten(F.transform("owners", lambda a: F.transform(F.filter("fps", lambda b: (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(close).alias("v")).select("v.*")


def _balls(rows: DataFrame) -> DataFrame:
    """Links (a, b) of rows (half, key, near, fp) to the least A member of each word that their balls meet in."""
    balls = []
    for half in (0, 1):
        first = _other(half)
        ones, twos = _flips(first), [_signed((1 << (first + i)) | (1 << (first + j))) for i in range(32) for j in range(i)]
        word = F.col("key").bitwiseOR(F.col("fp").bitwiseAND(_signed(0xFFFFFFFF << first)))
        at = rows.filter(F.col("half") == half).select("fp", "near", word.alias("word"))
        balls.append(at.select("fp", "word", F.col("near").alias("flips")))
        balls.append(at.filter("near = 0").select("fp", F.explode(F.concat(_each(ones, _moved(1)), _each(twos, _moved(2)))).alias("v")).select("fp", "v.*"))
    ball = balls[0].unionByName(balls[1]).unionByName(balls[2]).unionByName(balls[3])
    least = ball.groupBy("word").agg(F.min(F.when(F.col("flips") <= 1, F.col("fp"))).alias("a"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    least = least.filter("a is not null and low <> high").select("word", "a")
    return shuffled(ball.select("word", F.col("fp").alias("b"))).join(least, "word").filter("a <> b").select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id reachable over links of at most three
    bits. Null and empty texts have fingerprint zero and link like any other.
    Rows repeated under one doc_id each keep a row. A null doc_id never is a
    component's name unless the component has no other. No rows: no rows.
    Other columns of docs are not carried.
    """
    prints = checkpoint(fingerprints(docs, words))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints))
    named = checkpoint(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(names, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
