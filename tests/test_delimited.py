import csv
import io
import random

import duckdb
import pytest

from tablewright.plans import config, transform, validate
from tablewright.sources.delimited import Dialect, ends_inside, find_dialect, has_header, kind_of
from tablewright.sources.tables import dialect_of, read_csv


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few dozen bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(rows, end="\n", **how):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, **how).writerows(rows)
    return out.getvalue()


def random_rows(rng, n, columns=4):
    pieces = ["a", "bc", " ", '"', ",", "\n", "\n\n", "'", "1", "", "x" * 60, '""', "é"]
    return [[str(k), *("".join(rng.choice(pieces) for _ in range(rng.randrange(4))) for _ in range(columns - 1))] for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_ends_are_cut_in_many_blocks(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 60)
    path = tmp_path / "t.csv"
    path.write_text(written([["id", "a\nb", "c", "d"], *rows], "\r\n" if seed == 1 else "\n", quoting=csv.QUOTE_ALL if seed == 2 else csv.QUOTE_MINIMAL), encoding="utf-8", newline="")
    df = read_csv(spark, str(path), (), rejected="bad")
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 8
    assert df.columns == ["id", "a\nb", "c", "d", "bad", "_row_number"]
    got = sorted(df.collect(), key=lambda r: r["_row_number"])
    assert [r["_row_number"] for r in got] == list(range(1, 61))
    plain = [[v or None for v in r] for r in rows]  # a value that isn't there is null
    assert [[v or None for v in list(r)[:4]] for r in got] == plain and all(r["bad"] is None for r in got)
    if seed == 1:
        return  # DuckDB refuses files with both kinds of line ends
    con = duckdb.connect()
    found = con.execute(f"SELECT * FROM read_csv('{path}', all_varchar=true, header=true, delim=',', quote='\"', escape='\"')").fetchall()
    assert [[v or None for v in r] for r in found] == plain


def test_a_value_over_many_blocks_several_files_and_an_open_quote(spark, tmp_path, small_blocks):
    long = "line\n" * 200
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text(written([["k", "t"], ["1", long], ["2", "x"]]))
    (tmp_path / "f" / "b.csv").write_text(written([["k", "t" + "\n" * 120], ["3", "p\nq"], ["4", "y"]]).replace("t" + "\n" * 120, "t" + "\n" * 120))
    (tmp_path / "f" / "c.csv").write_text("")
    (tmp_path / "f" / "d.csv").write_text("k,t\n5,z\n\n6,\"open\nto the end\n" + "more\n" * 40)
    got = read_csv(spark, str(tmp_path / "f"), (), rejected="bad").orderBy("_row_number").collect()
    assert [(r["_row_number"], r["k"], r["t"]) for r in got[:5]] == [(1, "1", long), (2, "2", "x"), (3, "3", "p\nq"), (4, "4", "y"), (5, "5", "z")]
    assert len(got) == 6 and got[5]["bad"].startswith('6,"open\nto the end') and [r["bad"] for r in got[:5]] == [None] * 5


def test_states_at_line_ends():
    d, back = Dialect(), Dialect(escape="\\")
    for line, before, after in [('a,"b', False, True), ('b",c', True, False), ('a,b"c', False, False), ('"a""b', False, True), ('a""', True, True), ('"",""', False, False), ("", True, True), ('","', True, True), ('a",', True, False)]:
        assert ends_inside(line, before, d) == after, line
    assert ends_inside(r'"a\"b', False, back) and not ends_inside(r'"a\"b"', False, back) and not ends_inside(r'"a\\"', False, back)


@pytest.mark.parametrize(
    "text, want",
    [
        ("a,b\n1,2\n3,4\n", Dialect(",", names=("a", "b"))),
        ("1,x\n2,y\n", Dialect(",", header=False, names=("column0", "column1"))),
        ("id;note\n1;'x; y'\n2;'z'\n", Dialect(";", "'", "'", names=("id", "note"))),
        ('id|n|m\n1|"a\\"b|c"|2\n2|"d"|3\n', Dialect("|", '"', "\\", names=("id", "n", "m"))),
        ("name\tcity\nann\tparis\n", Dialect("\t", names=("name", "city"))),
        ("id,id,,x\n1,2,3,4\n", Dialect(",", names=("id", "id_1", "column2", "x"), renamed=("id", ""))),
        ("one\n1\n2\n", Dialect(",", names=("one",))),
        ("2024-01-02,5\n2024-01-03,6\n", Dialect(",", header=False, names=("column0", "column1"))),
        ("it's,5 o'clock\nlet's,go\n", Dialect(",", names=("it's", "5 o'clock"))),
        ("", Dialect()),
    ],
)
def test_dialects(text, want):
    assert find_dialect([text] if text else []) == want


def test_headers_and_kinds():
    assert [kind_of(v) for v in ("12", "007", "1.50", "2024-01-02", "2024-01-02 10:11", "TRUE", "", "1e5")] == ["bigint", "string", "double", "date", "timestamp", "boolean", "string", "double"]
    assert has_header([["a", "b"], ["1", "x"]]) and not has_header([["1", "x"], ["2", "y"]]) and has_header([["a", "b"], ["c", "d"]]) and has_header([["1", "2"]])
    assert not has_header([["", "1"], ["x", "2"]]) and not has_header([["1", "5"], ["2", "NA"]], ("NA",))


def test_samples_come_from_several_places(spark, tmp_path):
    """The first half looks like one column of a delimiter, the second tells."""
    path = tmp_path / "s.csv"
    path.write_text("k;v\n" + "".join(f"{k};{k}\n" for k in range(200_000)))
    assert dialect_of(spark, str(path)) == Dialect(";", names=("k", "v"))
    assert dialect_of(spark, str(path), header=False).names == ("column0", "column1")


def test_rejected_rows_are_violations_and_end_a_transform(spark, tmp_path):
    (tmp_path / "t.csv").write_text("eventID,locality,x\n1,a,b\n2,b,c,EXTRA\n3\n4,d,e\n")
    raw = {"validation": {"datasets": [{"name": "t", "class": "Event", "path": "t.csv", "fieldMappings": [{"originName": "eventID", "targetName": "eventID"}]}]}}
    results = validate.validate(spark, config.decode(raw), str(tmp_path))
    found = results.datasets[0].violations.filter("tag = 'RowShapeViolation'").orderBy("row_number").collect()
    assert [(r["row_number"], r["value"], r["severity"]) for r in found] == [(2, "2,b,c,EXTRA", "error"), (3, "3", "error")]
    assert results.datasets[0].rows == 4 and results.datasets[0].status == "fail"
    raw = {"transform": {"inputs": {"t": "t.csv"}, "datasets": [{"class": "Event", "source": {"t": "t"}, "fields": {"eventID": "eventID"}}]}}
    with pytest.raises(transform.TransformError, match="t: row 2 does not fit"):
        transform.transform(spark, config.decode(raw).transform, str(tmp_path))


def test_names_that_stand_twice_are_told(spark, tmp_path):
    (tmp_path / "t.csv").write_text("eventID,x,x\n1,a,b\n")
    raw = {"validation": {"datasets": [{"name": "t", "class": "Event", "path": "t.csv"}]}}
    results = validate.validate(spark, config.decode(raw), str(tmp_path))
    assert results.warnings == ["t: column names that stand twice or are empty were changed: 'x'"]
    assert [v.field_name for v in results.datasets[0].schema if v.tag == "UnmappedColumn"] == ["x", "x_1"]


def test_staged_inputs_are_removed(spark, tmp_path):
    from pathlib import Path

    from tablewright.plans.lineage import shared

    top = Path(shared(spark).removeprefix("file:"))
    before = {p.name for p in top.iterdir()}
    (tmp_path / "t.csv").write_text("eventID,x\n1,a\n")
    raw = {"validation": {"datasets": [{"name": "t", "class": "Event", "path": "t.csv"}]}}
    assert validate.validate(spark, config.decode(raw), str(tmp_path)).datasets[0].violations.count() >= 0
    assert not [p.name for p in top.iterdir() if p.name not in before and p.name.startswith(("input", "judged"))]
