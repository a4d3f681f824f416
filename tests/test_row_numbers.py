from pyspark.sql import functions as F

from tablewright.operators.checks import field_violations
from tablewright.operators.constraints import Range
from tablewright.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_several_files_follow_their_names_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "a table")
    spark.range(1000).select("id", (F.col("id") * 2).alias("x"), F.lit(1).alias("unread")).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    df = tables.numbered_parquet(spark, path)
    assert [(r["id"], r["_row_number"]) for r in df.orderBy("id").collect()] == [(k, k + 1) for k in range(1000)]
    few = df.filter("x > 1990").select("x", "_row_number")
    assert sorted(map(tuple, few.collect())) == [(1992, 997), (1994, 998), (1996, 999), (1998, 1000)]
    assert "PushedFilters: [IsNotNull(x), GreaterThan(x,1990)]" in plan(few) and "unread" not in plan(few)
    found = field_violations(tables.read_table(spark, path + "/part-*.parquet"), {"x": ("x", [Range(max=1990)])})
    assert "PushedFilters: []" not in plan(found) and found.count() == 4


def test_numbers_of_one_file_need_no_job(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(50).coalesce(1).write.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plain", "")
    spark.read.parquet(path)  # Spark reads the schema in a job
    spark.sparkContext.setJobGroup("numbers", "")
    df = tables.read_table(spark, path)
    assert len(tracker.getJobIdsForGroup("numbers")) == len(tracker.getJobIdsForGroup("plain"))
    spark.sparkContext._jsc.clearJobGroup()
    assert [r["_row_number"] for r in df.orderBy("id").collect()] == list(range(1, 51))


def test_many_files_and_names_that_clash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FOOTERS", 2)
    path = str(tmp_path / "t")
    spark.range(30).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    assert [r["_row_number"] for r in tables.numbered_parquet(spark, path).orderBy("id").collect()] == list(range(1, 31))
    spark.range(3).select("id", F.col("id").alias("_metadata")).coalesce(1).write.parquet(path + "2")
    assert [r["_row_number"] for r in tables.numbered_parquet(spark, path + "2").orderBy("id").collect()] == [1, 2, 3]
    spark.range(0).write.parquet(path + "3")
    assert tables.numbered_parquet(spark, path + "3").count() == 0
