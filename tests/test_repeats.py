import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import repeats
from tablewright.operators.checks import unique_violations
from tablewright.operators.constraints import Unique


def told(df):
    return sorted(map(str, df.select("tag", "field_name", "target_name", "row_number", "value", "error_message").collect()))


@pytest.mark.parametrize("most", [repeats.MOST, 1 << 16])
@pytest.mark.parametrize("limit", [None, 3])
def test_all_fields_at_once_equal_each_on_its_own(spark, monkeypatch, most, limit):
    """Also where the sketch is too small for the table, and cut into segments."""
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 13)
    monkeypatch.setattr(repeats, "FAN", 2)
    rng = random.Random(3)
    rows = [(k, f"id{k}", "hot" if k % 3 == 0 else f"v{rng.randrange(5000)}", rng.randrange(40_000), None if k % 7 else "rare") for k in range(1, 6001)]
    df = spark.createDataFrame(rows, "_row_number long, id string, v string, n int, r string").repartition(9)
    fields = [("id", "a", Unique()), ("v", "b", Unique("own text")), ("n", "c", Unique()), ("r", "d", Unique())]
    want = [x for c, t, u in fields for x in told(unique_violations(df, c, t, u, limit))]
    assert told(repeats.repeated_values(df, fields, limit)) == sorted(want)


def test_only_repeats_pass_the_sketch_and_each_pass_is_one_scan(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("_row_number"), (F.col("id") * 7).cast("string").alias("a"), F.when(F.col("id") < 4, 1).otherwise(F.col("id")).alias("b"), F.lit("x").alias("unread")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = repeats.suspects(df, [F.col("a"), F.col("b").cast("string")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "unread" not in plan and "Exchange" not in plan
    assert {(1, "1")} <= {(r["field"], r["value"]) for r in found.collect()} and found.count() < 40_000  # of 400,000


def test_a_sketch_tells_what_was_seen_again():
    rng = np.random.default_rng(1)
    sketch = repeats.Sketch(1 << 16)
    once = rng.permutation(1 << 16)[:1000]
    for part in np.array_split(np.r_[once, once[:50]], 7):
        sketch.add(part)
    bits = np.unpackbits(sketch.again, bitorder="little")
    assert set(np.flatnonzero(bits)) == set(once[:50]) and np.unpackbits(sketch.seen).sum() == 1000


def test_no_rows_and_no_values(spark):
    df = spark.createDataFrame([(1, None)], "_row_number long, a string")
    assert repeats.repeated_values(df, [("a", "a", Unique())]).count() == 0
    assert repeats.repeated_values(df.limit(0), [("a", "a", Unique())]).count() == 0
