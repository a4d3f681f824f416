import json

import pytest
from pyspark.sql import functions as F

from tablewright.plans import config, report, transform, validate
from tablewright.plans.validate import DatasetResult, Results
from tablewright.sources import sinks


def tree(top):
    return {str(p.relative_to(top)): p.read_bytes() for p in top.rglob("*") if p.is_file() and not p.name.startswith(".") and p.suffix != ".crc"}


def test_one_file_is_joined_from_parts_in_order(spark, tmp_path):
    df = spark.range(1000).repartitionByRange(6, "id").sortWithinPartitions("id").select("id", F.when(F.col("id") % 3 == 0, 'a "b", c').when(F.col("id") % 3 == 1, "").alias("odd, name"))
    assert df.rdd.getNumPartitions() == 6
    sinks.write_csv(df, str(tmp_path / "t.csv"))
    lines = (tmp_path / "t.csv").read_text().splitlines()
    assert lines[:4] == ['id,"odd, name"', '0,"a ""b"", c"', '1,""', "2,"] and [x.split(",")[0] for x in lines[1:]] == [str(k) for k in range(1000)]
    sinks.write_csv(df.limit(0), str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_text() == 'id,"odd, name"\n' and set(tree(tmp_path)) == {"t.csv"}


@pytest.mark.parametrize("fails", [1, 2, 3, 4])
def test_a_failed_switch_leaves_the_old_results(spark, tmp_path, monkeypatch, fails):
    def write(n):
        with sinks.Output(spark) as out:
            for name in ("a", "b"):
                sinks.stage_csv(spark.createDataFrame([(n,)], "v int"), str(tmp_path / f"{name}.csv"), out)

    write(1)
    before, own, calls = tree(tmp_path), sinks.Output.rename, []

    def rename(self, old, new):
        calls.append(new)
        if len(calls) == fails:
            raise sinks.SinkError("lost")
        own(self, old, new)

    monkeypatch.setattr(sinks.Output, "rename", rename)
    with pytest.raises(sinks.SinkError):
        write(2)
    assert tree(tmp_path) == before
    monkeypatch.setattr(sinks.Output, "rename", own)
    write(3)
    assert tree(tmp_path) == {"a.csv": b"v\n3\n", "b.csv": b"v\n3\n"}


def test_a_failed_write_leaves_the_old_result_and_new_files_go(spark, tmp_path):
    sinks.write_csv(spark.range(1), str(tmp_path / "t.csv"))
    before = tree(tmp_path)
    with pytest.raises(Exception, match="oops"):
        sinks.write_csv(spark.range(1).select(F.raise_error(F.lit("oops")).cast("string").alias("x")), str(tmp_path / "t.csv"))
    with pytest.raises(Exception, match="oops"), sinks.Output(spark) as out:
        sinks.stage_csv(spark.range(5), str(tmp_path / "new.csv"), out)
        raise ValueError("oops")
    assert tree(tmp_path) == before and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.csv"]


def test_a_database_holds_the_tables_of_its_run_only(spark, tmp_path):
    sinks.write_database({"a": spark.range(1), "b": spark.range(2)}, str(tmp_path / "db"))
    sinks.write_database({"a": spark.range(3)}, str(tmp_path / "db"))
    assert [p.name for p in sorted((tmp_path / "db").iterdir())] == ["a"] and spark.read.parquet(str(tmp_path / "db" / "a")).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["db"]


def test_a_transform_that_fails_late_changes_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1,2\n2,x\n")
    part = {"class": "Event", "source": {"t": "t"}, "fields": {"eventID": "k"}}
    raw = {"transform": {"inputs": {"t": "t.csv"}, "datasets": [part], "output": {"outputDir": "out", "outputFilesWithTimestamp": False, "exportDB": True, "exportDBFileName": "db"}}}
    transform.transform(spark, config.decode(raw).transform, str(tmp_path), str(tmp_path))
    before = tree(tmp_path / "out")
    raw["transform"]["datasets"] = [part, {"class": "Occurrence", "source": {"t": "t"}, "fields": {"occurrenceID": "raise_error(v)"}}]
    with pytest.raises(Exception):
        transform.transform(spark, config.decode(raw).transform, str(tmp_path), str(tmp_path), check=False)
    assert tree(tmp_path / "out") == before


def results(spark, n):
    rows = spark.range(n).select(F.lit("d").alias("dataset"), F.lit("RangeViolation").alias("tag"), F.when(F.col("id") % 2 == 0, "error").otherwise("warning").alias("severity"), F.lit("f").alias("field_name"), F.lit("f").alias("target_name"), (F.col("id") % (n - 1)).alias("row_number"), F.lit("v").alias("value"), F.concat(F.lit("m"), F.col("id") % (n - 1)).alias("error_message"), F.expr("cast(map() as map<string,string>)").alias("params"))
    return Results([DatasetResult("d", "Event", n, rows, [])], [], {})


def test_examples_are_limited_before_and_after_the_exchange(spark):
    own = results(spark, 5001)
    lines = report.as_markdown(own).splitlines()
    at = lines.index("- error: `f` RangeViolation (2501)")
    assert lines[at + 1 : at + 4] == ["  - row 0: m0", "  - row 2: m2", "  - row 4: m4"] and lines[at + 4].startswith("- warning")
    plan = report.examples(own.datasets[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_a_debug_table_is_made_in_parts(spark):
    parts = report.table_parts(results(spark, 300), debug=True)
    assert next(parts).startswith("Dataset") and sum("(row " in p for p in parts) == 300


def test_fail_fast_leaves_other_datasets_unread(spark, tmp_path, monkeypatch):
    (tmp_path / "e.csv").write_text("eventID,year\ne1,1\n")
    (tmp_path / "o.csv").write_text("occurrenceID,eventID\no1,e1\n")
    (tmp_path / "t.csv").write_text("taxonID\nt1\n")
    sets = [{"name": n, "class": c, "path": f"{n}.csv", "fieldMappings": [{"originName": k, "targetName": k} for k in m]} for n, c, m in [("o", "Occurrence", ["occurrenceID", "eventID"]), ("t", "Taxon", ["taxonID"]), ("e", "Event", ["eventID", "year"])]]
    sets[0]["fieldMappings"].append({"originName": "gone", "targetName": "basisOfRecord"})
    read, own = [], validate.read_table
    monkeypatch.setattr(validate, "read_table", lambda spark, path, *a, **b: read.append(path.rsplit("/", 1)[-1]) or own(spark, path, *a, **b))
    found = validate.validate(spark, config.decode({"validation": {"failFast": True, "datasets": sets}}), str(tmp_path))
    assert [d.name for d in found.datasets] == ["o"] and found.status == "fail" and read == ["e.csv", "o.csv"]
    read.clear()
    found = validate.validate(spark, config.decode({"validation": {"datasets": sets}}), str(tmp_path))
    assert [d.name for d in found.datasets] == ["o", "t", "e"] and sorted(read) == ["e.csv", "o.csv", "t.csv"]
    assert json.loads(report.as_json(found))["status"] == "fail"
