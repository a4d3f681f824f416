"""Repeated values of several columns, found behind a sketch.

A first pass hashes every value of every column into one sketch of two bits a
place: seen, and seen again. Tasks' sketches are merged in a tree, in segments.
A second pass lets through only values whose place was seen again: all that are
repeated and few others, so that what is shuffled to tell them apart exactly
grows with repeats, not with rows. Both passes are over all columns at once.

The sketch has some 16 places a value, up to ``MOST`` bits: a larger table
lets more values through, and stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .checks import LIMIT, ROW, _params, _text
from .constraints import Unique

MOST, LEAST = 1 << 28, 1 << 16
SEGMENT = 1 << 21  # bits of a part that is merged on its own
FAN = 64  # sketches merged at once


class Sketch:
    """Two bits for each of a power of two of places."""

    def __init__(self, bits: int) -> None:
        self.bits, self.seen, self.again = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & (self.bits - 1)

    def add(self, hashes: np.ndarray) -> None:
        places, counts = np.unique(self.places(hashes), return_counts=True)
        byte, bit = places >> 3, np.left_shift(1, places & 7).astype(np.uint8)
        twice = (counts > 1) | (self.seen[byte] & bit > 0)
        np.bitwise_or.at(self.again, byte[twice], bit[twice])
        np.bitwise_or.at(self.seen, byte, bit)


def _merged(group: pa.Table) -> pa.Table:
    seen, again = None, None
    for s, a in zip(group.column("seen"), group.column("again")):
        own, twice = np.frombuffer(s.as_py(), np.uint8), np.frombuffer(a.as_py(), np.uint8)
        again = twice if seen is None else again | twice | seen & own
        seen = own if seen is None else seen | own
    first = group.slice(0, 1)
    return pa.table({"segment": first.column("segment"), "part": first.column("part"), "seen": pa.array([seen.tobytes()], pa.binary()), "again": pa.array([again.tobytes()], pa.binary())})


def places_seen_again(hashes: DataFrame, bits: int) -> dict[int, bytes]:
    """The segments of the second bits of the sketch of hashes (h array<long>)."""
    step = min(bits, SEGMENT) // 8
    schema = "segment int, part int, seen binary, again binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(bits)
        for batch in batches:
            own = batch.column("h").flatten().to_numpy()
            if len(own):
                sketch.add(own)
        part = TaskContext.get().partitionId()
        for k in range(bits // 8 // step):
            seen, again = (x[k * step : (k + 1) * step] for x in (sketch.seen, sketch.again))
            if seen.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([again.tobytes()], pa.binary())], ["segment", "part", "seen", "again"])

    found, parts = hashes.mapInArrow(run, schema), hashes.rdd.getNumPartitions()
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("segment", "part").applyInArrow(_merged, schema)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    return {r["segment"]: bytes(r["again"]) for r in found.select("segment", "again").collect()}  # at most MOST bits


def suspects(df: DataFrame, texts: Sequence[Column], row: str = ROW) -> DataFrame:
    """(field, value, row_number) of the values of the columns, by their place, whose place in the sketch was seen more than once: all repeated ones, few others."""
    spark = df.sparkSession
    hashed = lambda k, t: F.xxhash64(F.lit(k), t)
    wanted = 16 * max(df.count(), 1) * len(texts)
    bits = min(MOST, max(LEAST, 1 << (wanted - 1).bit_length()))
    hashes = df.select(F.array_compact(F.array(*[F.when(t.isNotNull(), hashed(k, t)) for k, t in enumerate(texts)])).alias("h"))
    segments = spark.sparkContext.broadcast(places_seen_again(hashes, bits))
    size = min(bits, SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v")
            own = values.flatten()
            place = own.field("h").to_numpy() & (bits - 1)
            keep = np.zeros(len(place), bool)
            for k, bitmap in segments.value.items():
                here = np.flatnonzero(place // size == k)
                at = place[here] % size
                keep[here] = np.frombuffer(bitmap, np.uint8)[at >> 3] >> (at & 7) & 1 > 0
            at = pa.array(np.flatnonzero(keep))
            numbers = np.repeat(batch.column("row_number").to_numpy(), np.diff(values.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([own.field("field").take(at), own.field("value").take(at), pa.array(numbers[keep])], ["field", "value", "row_number"])

    each = [F.when(t.isNotNull(), F.struct(F.lit(k).alias("field"), hashed(k, t).alias("h"), t.alias("value"))) for k, t in enumerate(texts)]
    listed = df.select(F.col(f"`{row}`").cast("bigint").alias("row_number"), F.array_compact(F.array(*each)).alias("v"))
    return listed.mapInArrow(run, "field int, value string, row_number long")


def repeated_values(df: DataFrame, fields: Sequence[tuple[str, str, Unique]], limit: int | None = LIMIT, row: str = ROW) -> DataFrame:
    """Uniqueness violations of all fields (column, target, constraint) in two passes; of each field the most frequent limit values, ties by value. Nulls are never repeated.

    A value that a third of all rows hold is a join with the table of repeated
    values, which Spark can broadcast or split, not one group.
    """
    found = cut(suspects(df, [_text(df, c) for c, _, _ in fields], row))
    counted = found.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
        counted = counted.withColumn("place", place).filter(F.col("place") <= limit)
    member = found.join(cut(counted.select("field", "value")), ["field", "value"])
    told = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("field") + 1)
    message = F.coalesce(told([u.message for _, _, u in fields]).cast("string"), F.concat(F.lit('Duplicate value: "'), F.col("value"), F.lit('"')))
    return member.select(F.lit(Unique.tag).alias("tag"), F.lit("error").alias("severity"), told([c for c, _, _ in fields]).alias("field_name"), told([t for _, t, _ in fields]).alias("target_name"), "row_number", "value", message.alias("error_message"), _params({}).alias("params"))
