import json
from dataclasses import replace

import pytest

from tablewright import cli
from tablewright.functions.dialect import adapt
from tablewright.operators.constraints import Range, Required, strictest
from tablewright.operators.dependency import Dependency
from tablewright.plans import config as cfg
from tablewright.plans import catalogue, dictionary, lineage, profiles, report, schema_import
from tablewright.plans.relations import AmbiguousRelation, ForeignKey, Shape, infer, targets_first
from tablewright.plans.resolution import Diagnostic, Mapping, active_variant, added, overlaid, resolve_fields
from tablewright.plans.transform import TransformError, after_import, project, transform
from tablewright.plans.validate import InvalidDataset, validate
from tablewright.sources import sinks
from tablewright.sources.tables import MissingInput, numbered, read_csv, read_table, typed
from tablewright.streaming.checks import stream_violations, violations_per_window

EVENTS = "eventID,country,countryCode,eventDate,decimalLatitude,decimalLongitude\nE1,Canada,CA,2022-09-15,48.5,-125.1\nE2,Canada,CA,2022-09-16,48.6,-125.2\n"
OCCURRENCES = "eventID,occurrenceID,basisOfRecord,scientificName\nE1,O1,HumanObservation,Gadus\nE1,O2,HumanObservation,Gadus\nE2,O3,HumanObservation,Gadus\n"


def workspace(tmp_path, rules=(), mappings=None, **files):
    kinds = {"events": "Event", "occurrences": "Occurrence", "facts": "ExtendedMeasurementOrFact"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return cfg.decode({"standard": {"base": "darwin-core", "variant": "obis"}, "datasetRules": list(rules), "validation": {"datasets": [{"name": n, "class": kinds[n], "path": f"{n}.csv", "fieldMappings": (mappings or {}).get(n, [])} for n in files]}})


def found(results, dataset, tag):
    d = next(d for d in results.datasets if d.name == dataset)
    return sorted((r["row_number"], r["field_name"], r["value"]) for r in d.violations.filter(f"tag = '{tag}'").collect())


def test_references_and_keys(spark, tmp_path):
    config = workspace(tmp_path, occurrences=OCCURRENCES.replace("E2,O3", "E9,O3"), events=EVENTS + "E1,Canada,CA,2022-09-15,1,1\n")
    results = validate(spark, config, str(tmp_path))
    assert found(results, "occurrences", "ForeignKeyViolation") == [(3, "eventID", "E9")]
    assert found(results, "events", "PrimaryKeyViolation") == [(1, "eventID", "E1"), (3, "eventID", "E1")]
    assert results.status == "fail" and report.exit_code(results) == 1
    assert [d.name for d in results.datasets] == ["occurrences", "events"]


def test_rejected_parents_reject_their_children(spark, tmp_path):
    config = workspace(tmp_path, events=EVENTS.replace("E2,Canada", ",Canada"), occurrences=OCCURRENCES)
    assert found(validate(spark, config, str(tmp_path)), "occurrences", "ForeignKeyViolation") == [(3, "eventID", "E2")]


def test_ranges_formats_and_vocabularies(spark, tmp_path):
    config = workspace(tmp_path, events=EVENTS.replace("48.5", "95").replace("2022-09-16", "soon"), occurrences=OCCURRENCES.replace("O2,HumanObservation", "O2,HumanObservatio"))
    results = validate(spark, config, str(tmp_path))
    assert {r[0] for r in found(results, "events", "RangeViolation")} == {1}
    assert {r[0] for r in found(results, "events", "FormatViolation")} == {2}
    assert found(results, "occurrences", "EnumViolation") == [(2, "basisOfRecord", "HumanObservatio")]
    row = results.datasets[1].violations.filter("tag = 'EnumViolation'").first()
    assert row["params"]["suggestedValue"] == "HumanObservation"
    quiet = replace(config, validation=replace(config.validation, suggestions=False, fail_fast=True))
    results = validate(spark, quiet, str(tmp_path))
    assert [d.name for d in results.datasets] == ["events"]
    one = validate(spark, quiet, str(tmp_path), fail_fast=False)
    assert one.datasets[1].violations.filter("tag = 'EnumViolation'").first()["params"]["suggestedValue"] is None


def test_renamed_references(spark, tmp_path):
    config = workspace(tmp_path, mappings={"occurrences": [{"originName": "event_ref", "targetName": "eventID"}]}, events=EVENTS, occurrences=OCCURRENCES.replace("eventID", "event_ref").replace("E2", "E7"))
    assert found(validate(spark, config, str(tmp_path)), "occurrences", "ForeignKeyViolation") == [(3, "event_ref", "E7")]


def test_profile_rule_needs_one_of_two_ids(spark, tmp_path):
    text = "measurementID,eventID,occurrenceID,measurementType,measurementValue\nM1,E1,,size,1\nM2,,,size,2\nM3,,O1,size,3\n"
    assert found(validate(spark, workspace(tmp_path, facts=text), str(tmp_path)), "facts", "DependencyViolation") == [(2, "eventID, occurrenceID", "")]


def test_schema_violations(spark, tmp_path):
    config = workspace(tmp_path, mappings={"events": [{"originName": "eventIDs", "targetName": "eventID"}, {"originName": "country", "targetName": "country", "preset": "latidude"}]}, events=EVENTS.replace("countryCode", "extra"))
    own = validate(spark, config, str(tmp_path)).datasets[0].schema
    tags = [(v.tag, v.field_name) for v in own]
    assert ("MissingMapping", "eventIDs") in tags and ("MissingField", "eventID") in tags and ("UnmappedColumn", "extra") in tags
    assert any('Did you mean "latitude"?' in v.error_message for v in own)


def test_csv_and_parquet_agree(spark, tmp_path):
    config = workspace(tmp_path, events=EVENTS.replace("48.5", "95"))
    spark.read.csv(str(tmp_path / "events.csv"), header=True).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    other = cfg.decode({"standard": {"variant": "obis"}, "validation": {"datasets": [{"name": "events", "class": "Event", "path": "events.parquet"}]}})
    one, two = validate(spark, config, str(tmp_path)), validate(spark, other, str(tmp_path))
    assert one.datasets[0].counts == two.datasets[0].counts and found(one, "events", "RangeViolation") == found(two, "events", "RangeViolation")


def test_errors_of_a_run(spark, tmp_path):
    with pytest.raises(MissingInput):
        config = workspace(tmp_path, events=EVENTS)
        (tmp_path / "events.csv").unlink()
        validate(spark, config, str(tmp_path))
    (tmp_path / "d.csv").write_text("a\n1\n")
    with pytest.raises(InvalidDataset, match="Did you mean 'Event'"):
        validate(spark, cfg.decode({"validation": {"datasets": [{"name": "d", "class": "Evnt", "path": "d.csv"}]}}), str(tmp_path))


def test_reports_and_exit_codes(spark, tmp_path):
    results = validate(spark, workspace(tmp_path, events=EVENTS), str(tmp_path))
    own = json.loads(report.as_json(results))
    assert own["datasets"][0]["rows"] == 2 and own["status"] == results.status
    assert "# Validation results" in report.as_markdown(results) and "events" in report.as_table(results)
    results.datasets[0]._counts = {"error": 0, "warning": 1, "info": 0}
    assert (report.exit_code(results), report.exit_code(results, True)) == (0, 2)
    assert results.summary()["passed"] == results.summary()["warned"] == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "events.csv").write_text(EVENTS)
    (tmp_path / "tablewright.json").write_text(json.dumps({"validation": {"datasets": [{"name": "events", "class": "Event", "path": "events.csv"}]}}))
    code = cli.main(["validate", str(tmp_path), "--format", "json"], spark)
    out = capsys.readouterr()
    assert code in (0, 1) and json.loads(out.out)["datasets"][0]["name"] == "events"
    assert cli.main(["validate", str(tmp_path / "nowhere.yaml")], spark) == 3
    assert cli.main(["validate", str(tmp_path), "--format", "markdown", "--output-dir", str(tmp_path / "out")], spark) == code
    assert list((tmp_path / "out").glob("*.md"))


def test_config_problems_are_told_by_path():
    with pytest.raises(cfg.ConfigError) as e:
        cfg.decode({"validation": {"datasets": [{"name": "a", "path": "b"}, {"name": "a", "class": "c", "path": "b", "fieldMappings": [{"originName": "x", "targetName": "y", "constraints": [{"type": "range", "min": 2, "max": 1}, {"type": "pattern", "pattern": "("}]}]}]}, "datasetRules": [{"ruleType": "dependency", "require": []}]})
    told = "\n".join(e.value.problems)
    assert "validation.datasets.0.class" in told and "fieldMappings.0.constraints.0" in told and "constraints.1" in told and "datasetRules.0.require" in told
    with pytest.raises(cfg.ConfigError):
        cfg.decode({"name": "x"})
    own = cfg.decode({"transform": {"inputs": {"a": "a.csv", "b": 3}, "datasets": []}, "surplus": 1})
    assert own.transform.inputs == {"a": "a.csv"} and own.transform.timestamped and own.version == "1.0.0"
    assert cfg.json_schema()["$schema"].endswith("2020-12/schema")


def test_config_is_found_upward(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "tablewright.yaml").write_text("validation: {datasets: []}\n")
    assert cfg.discover(tmp_path / "a" / "b") == (tmp_path / "tablewright.yaml").resolve()
    assert cfg.load(tmp_path / "tablewright.yaml").validation.limit == 100


def test_resolution_layers():
    spec = profiles.resolve("Event", "obis")
    notes: list[Diagnostic] = []
    fields = resolve_fields(spec, "obis", [Mapping("d", "eventDate", "optional"), Mapping("n", "maximumDepthInMeters", "required", preset="depth")], notes)
    assert fields["eventDate"].level == "required" and fields["eventDate"].origin == "d"
    assert fields["maximumDepthInMeters"].level == "required" and sum(isinstance(c, Range) for c in fields["maximumDepthInMeters"].constraints) == 2
    assert "Config 'optional' requirement ignored" in notes[0].dropped[0] and "range" in notes[1].overlapping
    assert strictest(overlaid([Required()], [Required("optional")])).level == "required"
    assert strictest(added([Required("optional")], [Required()])).level == "required"
    emof = resolve_fields(profiles.resolve("ExtendedMeasurementOrFact", "obis"), "obis", [])
    assert emof["eventID"].level == "recommended"
    assert active_variant("x")[0] == "obis" and active_variant("gbif") == ("gbif", None)
    with pytest.raises(ValueError):
        profiles.chain("a", {"a": profiles.Profile("a", "a", "b"), "b": profiles.Profile("b", "b", "a")})


def test_relations():
    shapes = [Shape("o", "Occurrence", ("occurrenceID", "eventID")), Shape("e", "Event", ("eventID", "parentEventID"))]
    assert infer(shapes) == [ForeignKey("o", "eventID", "e", "eventID"), ForeignKey("e", "parentEventID", "e", "eventID")]
    assert targets_first(["o", "e"], infer(shapes)) == ["e", "o"]
    assert targets_first(["a", "b"], [ForeignKey("a", "x", "b", "x"), ForeignKey("b", "x", "a", "x")]) == ["b", "a"]
    more = [*shapes, Shape("e2", "Event", ("eventID",))]
    with pytest.raises(AmbiguousRelation):
        infer(more)
    assert infer(more, [ForeignKey("o", "eventID", "e2", "eventID")]) == [ForeignKey("e", "parentEventID", "e", "eventID")]


def test_dialect():
    assert adapt('SELECT "order", s[0:2], row_number() OVER (), string_agg(c), \'s[0:2] "x"\' FROM t') == "SELECT `order`, substring(s, 1, 2), row_number() OVER (ORDER BY _row_number), string_agg(c, ','), 's[0:2] \"x\"' FROM t"


def test_projection(spark):
    t = spark.createDataFrame([("a,b", "2024-03-01"), ("c", None)], "s string, d string")
    rows = project(spark, {"t": t}, {"x": "(SELECT * FROM t)"}, {"first": "split_part(s, ',', 1)", "day": "strftime(CAST(d AS DATE), '%d/%m/%Y')", "nothing": None, "five": 5, "again": "concat(first, '!')"}).orderBy("first").collect()
    assert [tuple(r) for r in rows] == [("a", "01/03/2024", None, 5, "a!"), ("c", None, None, 5, "c!")]


def test_statements_after_import(spark):
    t = spark.createDataFrame([(1, " a "), (2, "b")], "id int, s string")
    own = after_import(spark, {"t": t}, ["ALTER TABLE t ADD COLUMN note VARCHAR", "UPDATE t SET note = TRIM(REPLACE(s, 'a', 'x,y')), s = upper(s) WHERE id = 1"])["t"]
    assert [tuple(r) for r in own.orderBy("id").collect()] == [(1, " A ", "x,y"), (2, "b", None)]
    with pytest.raises(TransformError):
        after_import(spark, {"t": t}, ["VACUUM THE ROOM"])


def test_transform_to_files(spark, tmp_path):
    (tmp_path / "src.csv").write_text("event_id,event_year,occ_id\nevt01,2024,occ01\n")
    raw = {
        "transform": {
            "inputs": {"src": "src.csv"},
            "datasets": [
                {"class": "Event", "source": {"s": "src"}, "fields": {"eventID": "event_id", "year": "event_year", "locality": None}},
                {"class": "Event", "source": {"s": "(SELECT * FROM src WHERE event_year = 2024)"}, "fields": {"eventID": "'evt02'", "country": "'CA'"}},
                {"class": "Occurrence", "source": {"s": "src"}, "fields": {"occurrenceID": "occ_id", "eventID": "event_id", "basisOfRecord": "'HumanObservation'", "scientificName": "'Gadus'"}},
            ],
            "output": {"outputDir": "out", "outputFilesWithTimestamp": False, "dropNullColumns": True, "exportDB": True, "exportDBFileName": "all.db"},
        }
    }
    done = transform(spark, cfg.decode(raw).transform, str(tmp_path), str(tmp_path))
    assert (tmp_path / "out" / "event.csv").read_text() == "eventID,year,country\nevt01,2024,\nevt02,,CA\n"
    assert (tmp_path / "out" / "occurrence.csv").read_text() == "basisOfRecord,occurrenceID,eventID,scientificName\nHumanObservation,occ01,evt01,Gadus\n"
    assert spark.read.parquet(f"{done.database}/event").count() == 2
    raw["transform"]["datasets"][1]["fields"]["eventID"] = "'evt01'"
    with pytest.raises(TransformError, match="Duplicate primary key"):
        transform(spark, cfg.decode(raw).transform, str(tmp_path), str(tmp_path))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("", None, ' "q", x'), ("a", "007", "é")], "a string, b string, c string")
    path = sinks.write_csv(df, str(tmp_path / "t.csv"))
    assert open(path, encoding="utf-8").read() == 'a,b,c\n"",,\" ""q"", x\"\na,007,é\n'
    back = read_csv(spark, path, nulls=())
    assert [tuple(r)[1:3] for r in back.orderBy("_row_number").collect()][1] == ("007", "é")


def test_row_numbers_and_types(spark, tmp_path):
    spark.range(0, 1000, 1, 7).write.parquet(str(tmp_path / "n.parquet"))
    rows = read_table(spark, str(tmp_path / "n.parquet")).collect()
    assert sorted(r["_row_number"] for r in rows) == list(range(1, 1001))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["_row_number"])[:3]] == [0, 1, 2] or len(rows) == 1000
    (tmp_path / "t.csv").write_text("i,z,d,t,b,s\n1,007,2024-01-02,1.5,true,x\nNA,8,2024-01-03,2,FALSE,\n")
    own = typed(read_csv(spark, str(tmp_path / "t.csv")))
    assert dict(own.dtypes) == {"i": "bigint", "z": "string", "d": "date", "t": "double", "b": "boolean", "s": "string", "_row_number": "bigint"}
    assert own.filter("i IS NULL AND s IS NULL").count() == 1
    assert numbered(spark.range(0)).count() == 0


def test_dictionary_import(tmp_path):
    (tmp_path / "event.xml").write_text('<extension xmlns="http://x/" xmlns:dc="http://y/" name="Event" rowType="r"><property name="eventID" type="string" required="true"/><property name="year" type="integer"/><property name="decimalLatitude" type="decimal"/><property name="kind" thesaurus="k"/></extension>')
    (tmp_path / "k.xml").write_text('<thesaurus xmlns="http://x/" xmlns:dc="http://y/"><concept dc:identifier="one"/><concept dc:identifier="two"/></thesaurus>')
    (tmp_path / "list.csv").write_text("Term ,OBIS required\neventID, Required\nyear, strongly recommended “x”\n")
    raw = schema_import.build([tmp_path / "event.xml"], tmp_path / "list.csv", {"k": schema_import.vocabulary(tmp_path / "k.xml")})
    assert raw["Event"]["fields"]["eventID"]["obligations"] == {"obis": "required"} and raw["Event"]["fields"]["kind"]["values"] == ["one", "two"]
    schema_import.write(raw, tmp_path / "c.json")
    own = dictionary.loads((tmp_path / "c.json").read_text())["Event"]
    assert own.is_key("eventID") and own.fields["decimalLatitude"].constraints == (Range(-90, 90),) and own.fields["eventID"].level("obis") == "required"
    assert schema_import.label("eventDate") == "Event Date"
    assert dictionary.loads('{"A": {"fields": {"x": {"validators": ["latitude"]}}}}')["A"].warnings


def test_built_in_classes():
    own = dictionary.built_in()
    assert list(own) == ["Event", "Occurrence", "Taxon", "ExtendedMeasurementOrFact", "dnaDerivedData", "ResourceRelationship"]
    names = list(own["Occurrence"].fields)
    assert names.index("basisOfRecord") < names.index("occurrenceID") < names.index("eventID")
    assert own["Event"].key == "eventID" and own["Event"].fields["eventDate"].column_type == "string" and own["Event"].fields["year"].column_type == "int"
    assert own["Occurrence"].fields["taxonRank"].enforced and not own["Occurrence"].fields["sex"].enforced


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:01", 9.0), (2, "2024-01-01 00:00:02", 1.0), (3, "2024-01-01 00:10:00", 8.0)], "id long, ts string, v double").selectExpr("id", "timestamp(ts) AS ts", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, v double").parquet(str(tmp_path / "in"))
    found = stream_violations(stream, {"v": ("v", [Range(max=5)])}, "id")
    q = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["row_number"] for r in spark.sql("SELECT * FROM found").collect()) == [1, 3]
    timed = stream.filter("v > 5").selectExpr("ts", "'RangeViolation' AS tag", "'error' AS severity")
    q = violations_per_window(timed, "ts", "5 minutes", "1 minute").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["n"] for r in spark.sql("SELECT n FROM counts").collect()] == [1, 1]
    assert Dependency(("a",)).fields == ["a"]


def test_null_cap_returns_all_violations(spark, tmp_path):
    spark.range(1, 251).selectExpr("cast(id as string) AS eventID", "1000.0 + id AS lat").write.parquet(str(tmp_path / "e.parquet"))
    dataset = {"name": "events", "class": "Event", "path": "e.parquet", "fieldMappings": [{"originName": "lat", "targetName": "decimalLatitude"}]}
    found = {}
    for cap in ({}, {"maxViolationsPerField": 7}, {"maxViolationsPerField": None}):
        results = validate(spark, cfg.decode({"standard": {"base": "darwin-core"}, "validation": {"datasets": [dataset], **cap}}), str(tmp_path))
        found[str(cap)] = results.datasets[0].violations.filter("tag = 'RangeViolation'").count()
    assert list(found.values()) == [100, 7, 250]
    assert cfg.decode(catalogue._WORKSPACE).validation.limit is None


def test_csv_dialects(spark, tmp_path):
    from tablewright.sources.tables import delimiter_of, read_csv

    for k, (text, want) in enumerate([("a;b\n1,5;x\n", [("1,5", "x")]), ("a\tb\n1\t2\n", [("1", "2")]), ('a,b\n"x\ny",2\n3,4\n', [("x\ny", "2"), ("3", "4")]), ("a|b\n1|NA\n", [("1", None)]), ("a\n1\n", [("1",)])]):
        (tmp_path / f"{k}.csv").write_text(text)
        df = read_csv(spark, str(tmp_path / f"{k}.csv"))
        assert [tuple(r)[:-1] for r in df.orderBy("_row_number").collect()] == want
    assert delimiter_of([]) == "," and delimiter_of(['"a;b;c",d']) == ","


def test_csv_options_of_a_configuration(spark, tmp_path):
    (tmp_path / "e.csv").write_text('eventID~note\ne1~"a\nb"\ne2~c\n')
    own = {"csvDelimiter": "~", "csvMultiline": True}
    dataset = {"name": "events", "class": "Event", "path": "e.csv", "fieldMappings": [{"originName": "eventID", "targetName": "eventID"}]}
    part = {"class": "Event", "source": "e", "fields": {"eventID": "eventID"}}
    raw = {"validation": {"datasets": [dataset], **own}, "transform": {"inputs": {"e": "e.csv"}, "datasets": [part], "output": {"outputDir": "out", "outputFilesWithTimestamp": False, "singleFiles": False}, **own}}
    config = cfg.decode(raw)
    assert validate(spark, config, str(tmp_path)).datasets[0].rows == 2
    done = transform(spark, config.transform, str(tmp_path), str(tmp_path))
    assert (tmp_path / "out" / "event.csv").is_dir() and read_csv(spark, done.files[0]).count() == 2
    with pytest.raises(cfg.ConfigError, match="csvMultiline"):
        cfg.decode({"transform": {"csvMultiline": "yes"}})


def test_reports_tell_every_kind_and_violation(spark):
    from pyspark.sql import functions as F
    from tablewright.operators.checks import VIOLATION
    from tablewright.plans import report
    from tablewright.plans.validate import DatasetResult, Results

    rows = spark.range(12_000).selectExpr("'d' AS dataset", "if(id < 10500, 'A', 'B') AS tag", "'error' AS severity", "'f' AS field_name", "'f' AS target_name", "id AS row_number", "'v' AS value", "concat('m', id) AS error_message", "cast(map() as map<string,string>) AS params")
    none = spark.createDataFrame([], VIOLATION).select(F.lit("e").alias("dataset"), "*")
    results = Results([DatasetResult("d", "Event", 12_000, rows, []), DatasetResult("e", "Event", 0, none, [])], [], {})
    own = json.loads(report.as_json(results))
    assert len(own["datasets"][0]["violations"]) == 12_000 and own["datasets"][1]["violations"] == [] and own["status"] == "fail"
    text = report.as_table(results)
    assert "m0 (row 0) and 10499 more" in text and "m10500 (row 10500) and 1499 more" in text and report.as_table(results, debug=True).count("(row ") == 12_000


def test_keys_are_checked_over_shuffled_results(spark):
    """Row numbers of a joined result are distinct whatever adaptive execution makes of its partitions."""
    from tablewright.plans.lineage import cut
    from tablewright.sources.tables import numbered

    own = spark.range(60_000).selectExpr("id", "id % 977 AS k", "repeat('x', 20) AS t")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        joined = own.join(own.select("id", "t").withColumnRenamed("t", "u").hint("merge"), "id")
        assert numbered(cut(joined)).select("_row_number").distinct().count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_row_numbers_of_one_source_need_no_window_over_all_rows(spark):
    tables = {"t": spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "_row_number long, v string")}
    made = project(spark, tables, {"t": "t"}, {"id": "concat('n', row_number() OVER ())", "said": "'row_number() over ()'", "v": "t.v"})
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in made.collect()) == [(f"n{k}", "row_number() over ()", v) for k, v in enumerate("abc", 1)]


def test_a_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared(Session())


def test_columns_named_like_verdicts(spark, tmp_path):
    """A table may have columns named kind, at and value, of which one has a vocabulary's values and one holds keys."""
    (tmp_path / "o.csv").write_text("at,kind,value\no1,HumanObservation,x\no1,nothing,y\no1,HumanObservation,z\n")
    dataset = {"name": "o", "class": "Occurrence", "path": "o.csv", "fieldMappings": [{"originName": "at", "targetName": "occurrenceID"}, {"originName": "kind", "targetName": "basisOfRecord"}]}
    results = validate(spark, cfg.decode({"validation": {"datasets": [dataset]}}), str(tmp_path))
    found = sorted((r["tag"], r["row_number"], r["field_name"]) for r in results.datasets[0].violations.collect() if r["tag"] in ("EnumViolation", "PrimaryKeyViolation"))
    assert found == [("EnumViolation", 2, "kind"), ("PrimaryKeyViolation", 1, "at"), ("PrimaryKeyViolation", 2, "at"), ("PrimaryKeyViolation", 3, "at")]
