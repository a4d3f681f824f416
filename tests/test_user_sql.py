import random

import duckdb
import pytest

from tablewright.functions.dialect import DialectError, adapt, add_functions, date_format, statements, tokens
from tablewright.plans.transform import TransformError, after_import, project, with_numbers

ROWS = [(k, f"name {k}", ["red", "it's", "b\\c", None, ""][k % 5], f"2024-{k % 12 + 1:02d}-{k % 28 + 1:02d} 0{k % 10}:05:{k % 60:02d}", k * 1.5) for k in range(1, 41)]
OTHER = [(k, f"o{k}", k % 3) for k in range(1, 61, 2)]


@pytest.fixture(scope="module")
def engines(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INTEGER, name VARCHAR, kind VARCHAR, seen TIMESTAMP, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", ROWS)
    con.execute("CREATE TABLE o (id INTEGER, label VARCHAR, g INTEGER)")
    con.executemany("INSERT INTO o VALUES (?, ?, ?)", OTHER)
    add_functions(spark)
    t = spark.createDataFrame(ROWS, "id int, name string, kind string, seen string, x double").selectExpr("id", "name", "kind", "CAST(seen AS TIMESTAMP) AS seen", "x")
    return con, {"t": t.coalesce(3), "o": spark.createDataFrame(OTHER, "id int, label string, g int")}


def rows(found):
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize(
    "expression",
    [
        "upper(name)[0:2]", "name[2:3]", "name[-3:]", "name[:2]", "name[2:-2]", "name[-3:-2]", "name[5:2]", "name[-99:2]", "t.name[3:99]", "concat(name, 'x')[id % 3:id % 5 + 1]", "(name || 'y')[2:4]", "'abc'[1:2]", "upper(name[2:5])[1:2]", '"name"[1:2]', "name[length(name) - 1:]",
        "strftime(seen, '%-d/%-m/%Y')", "strftime(seen, '%A, %-d %B %Y at %I:%M %p T')", "strftime(CAST(seen AS DATE), 'year %Y''s day %j %%')", "strftime(seen, '%Y-%m-%dT%H:%M:%S')", "strftime('%d.%m.%y', seen)", "strftime(seen, '%x %X %c %a %b %-H %-I %-j [it]')",
        "'it''s'", r"'a\b' || kind", "kind = 'it''s'", r"kind LIKE 'b\c'", "x::VARCHAR", "CAST(id AS TEXT)", "TRY_CAST(name AS INTEGER)", "id::VARCHAR || '-' || name -- note 's[0:2]'", "/* x[1:2] */ CASE WHEN kind IS NULL THEN 'none' ELSE kind END", "coalesce(kind, 'a')[1:1]",
    ],
)
def test_expressions_equal_duckdb(spark, engines, expression):
    con, tables = engines
    got = project(spark, tables, {"t": "t"}, {"id": "id", "value": expression + "\n"})
    assert rows(got.collect()) == rows(con.execute(f"SELECT id, {expression}\n AS value FROM t").fetchall())


STATEMENTS = [
    ["DELETE FROM t WHERE id > 20 OR kind = 'it''s'"],
    ["DELETE FROM T"],
    ["DELETE FROM t WHERE kind <> 'red'; DELETE FROM t WHERE x > 30"],
    ["INSERT INTO t SELECT id + 100, label, NULL, NULL, g FROM o WHERE g < 2"],
    ["INSERT INTO t (name, id) VALUES ('new; one', 900), ('it''s', 901)"],
    ["INSERT INTO t BY NAME SELECT label AS name, id + 500 AS id FROM o"],
    ["UPDATE t SET name = o.label, x = o.g FROM o WHERE o.id = t.id AND o.g > 0"],
    ["UPDATE t AS a SET kind = upper(b.label)[1:2] FROM o AS b WHERE a.id = b.id"],
    ["UPDATE t SET x = s.total FROM (SELECT g, sum(id) AS total FROM o GROUP BY g) s WHERE s.g = t.id % 3"],
    ["UPDATE t SET x = x * 2, name = concat(name, ', and = ', id) WHERE id BETWEEN 3 AND 9"],
    ["UPDATE t SET id = id + 1, x = id"],
    ["ALTER TABLE t ADD COLUMN note VARCHAR", "UPDATE t SET note = kind[1:1] WHERE kind IS NOT NULL", "ALTER TABLE t RENAME COLUMN note TO remark", "ALTER TABLE t DROP COLUMN kind", "ALTER TABLE t ALTER COLUMN x TYPE VARCHAR"],
    ["CREATE OR REPLACE TABLE t AS SELECT id, name, kind, seen, x FROM t WHERE id < 5", "CREATE TABLE u AS SELECT * FROM o", "DROP TABLE u", "DROP TABLE IF EXISTS nothing", "DELETE FROM t WHERE id = 2"],
    ["ALTER TABLE o RENAME TO p", "DELETE FROM t WHERE id IN (SELECT id FROM p)", "ALTER TABLE p RENAME TO o"],
]


@pytest.mark.parametrize("own", STATEMENTS, ids=range(len(STATEMENTS)))
def test_statements_equal_duckdb(spark, engines, own):
    con, tables = engines
    con.execute("BEGIN")
    for s in own:
        con.execute(s)
    want = con.execute("SELECT * FROM t")
    names, want = [d[0] for d in want.description], want.fetchall()
    con.execute("ROLLBACK")
    made = after_import(spark, tables, own)
    assert sorted(made) == ["o", "t"] and made["t"].columns == names
    assert rows(made["t"].collect()) == rows(want)


def test_an_update_with_several_matches_takes_one_and_numbers_go_on(spark, engines):
    _, tables = engines
    made = after_import(spark, tables, ["UPDATE t SET name = o.label FROM o WHERE o.g = t.id % 3"])["t"]
    assert made.count() == 40 and {r["name"] for r in made.collect()} == {"o1", "o11", "o15"}
    numbered = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "_row_number long, v string")}
    assert rows(after_import(spark, numbered, ["INSERT INTO t VALUES ('c'), ('d')"])["t"].select("_row_number", "v").collect())[2:] == [(3, "c"), (4, "d")]


@pytest.mark.parametrize(
    "statement", ["SELECT 1", "DELETE FROM gone", "DELETE FROM t USING o WHERE t.id = o.id", "INSERT INTO t VALUES (1)", "UPDATE t SET nothing = 1", "ALTER TABLE t ADD COLUMN name VARCHAR", "DROP TABLE gone", "SET x = 1", "TRUNCATE t", "UPDATE t SET name = strftime(seen, '%Q')", "DELETE FROM t WHERE (id = 1"]
)
def test_nothing_is_passed_through_unread(spark, engines, statement):
    with pytest.raises(TransformError):
        after_import(spark, engines[1], [statement])


def test_formats_and_tokens():
    assert date_format("%-d/%-m/%Y") == "d'/'M'/'yyyy" and date_format("o'clock %H") == "'o''clock 'HH" and date_format("%%%d") == "'%'dd"
    for bad in ("%Q", "%", "%-Y", "%U"):
        with pytest.raises(DialectError):
            date_format(bad)
    with pytest.raises(DialectError):
        adapt("strftime(d, f)")
    assert statements("a; 'b;c' ; ;-- d;\n e") == ["a", "'b;c'", "e"]
    assert "".join(t.text for t in tokens("a'b''c'\"d\"[1:2]")) == "a'b''c'\"d\"[1:2]"


def plain_window(df):
    return "Window [row_number" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "sources, fields, order",
    [
        ({"t": "t"}, {"n": "concat('c', row_number() OVER ())", "id": "id"}, "id"),
        ({"t": "t", "e": "(SELECT max(x) AS most FROM t)"}, {"n": "row_number( ) over ( )", "id": "t.id", "most": "e.most"}, "id"),
        ({"s": "(SELECT *, row_number() OVER () AS n FROM t WHERE id > 7)"}, {"n": "n", "id": "s.id"}, "id"),
        ({"s": "(SELECT a.id, b.label, row_number() OVER () * 10 AS n FROM t a JOIN o AS b ON a.id = b.id WHERE label <> 'o3')"}, {"n": "n", "id": "id", "label": "label"}, "id"),
        ({"s": "(SELECT a.id, b.label, row_number() OVER () AS n FROM t a LEFT JOIN o b ON a.id = b.id)"}, {"n": "n", "id": "id", "label": "label"}, "id"),
        ({"s": "(SELECT g, count(*) AS c, row_number() OVER () AS n FROM o GROUP BY g HAVING count(*) > 1)"}, {"n": "n", "g": "g", "c": "c"}, "g"),
        ({"s": "(SELECT id, row_number() OVER () AS n FROM t ORDER BY id DESC LIMIT 5)"}, {"n": "row_number() OVER () + n * 0", "id": "id"}, "id"),
    ],
)
def test_unordered_row_numbers_are_dense_and_need_no_window(spark, engines, sources, fields, order):
    """Numbers may be dealt in any order, the rows may not differ."""
    con, tables = engines
    got = project(spark, tables, sources, fields)
    assert not plain_window(got)
    own = got.toPandas()
    froms = ", ".join(f"{s} AS {a}" for a, s in sources.items())
    want = con.execute(f"SELECT {', '.join(f'{e} AS {n}' for n, e in fields.items())} FROM {froms}").fetchdf()
    assert sorted(own["n"].astype(str)) == sorted(want["n"].astype(str))
    rest = [c for c in own.columns if c != "n"]
    text = lambda df: sorted(map(str, df[rest].astype(object).where(df[rest].notna(), None).values.tolist()))
    assert text(own) == text(want)


def test_numbers_follow_the_sources_own(spark):
    rng = random.Random(1)
    own = [(n, f"v{n}") for n in range(1, 300)]
    rng.shuffle(own)
    tables = {"t": spark.createDataFrame(own, "_row_number long, v string").repartition(7)}
    got = project(spark, tables, {"s": "(SELECT v, row_number() OVER () AS n FROM t WHERE _row_number > 100)"}, {"v": "v", "n": "n"}).collect()
    assert all(int(r["v"][1:]) == r["n"] + 100 for r in got) and len(got) == 199
    with pytest.raises(DialectError):
        with_numbers(spark, "SELECT v, row_number() OVER () FROM t UNION ALL SELECT 1, 2")
