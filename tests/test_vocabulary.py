import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.functions.suggest import nearest_name
from tablewright.operators import integrity, vocabulary
from tablewright.operators.checks import field_violations
from tablewright.operators.constraints import Pattern
from tablewright.operators.integrity import Rules, Vocabulary, integrity_violations, judge


def changed(rng, word, edits, letters):
    out = list(word)
    for _ in range(edits):
        k, how = rng.randrange(len(out) + 1), rng.randrange(3)
        if how == 0:
            out.insert(k, rng.choice(letters))
        elif out:
            k = min(k, len(out) - 1)
            out[k : k + 1] = [rng.choice(letters)] if how == 1 else []
    return "".join(out)


@pytest.mark.parametrize("letters, most", [("ab", 6), ("abcdefgh", 14), ("abé🙂", 80)])
def test_nearest_words_equal_brute_force(spark, letters, most):
    rng = random.Random(most)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(300)]
    values = [changed(rng, rng.choice(words), rng.randrange(5), letters) for _ in range(400)] + ["", "zzzzzzzz", *words[:5]]
    table = vocabulary.words_table(spark, words)
    got = vocabulary.nearest_words(spark.createDataFrame([(v,) for v in [*values, None]], "value string"), table)
    assert {r["value"]: r["nearest"] for r in got.collect()} == {v: n for v in values if (n := nearest_name(v, words)) is not None}


@pytest.mark.parametrize("sent", [0, vocabulary.SENT])
def test_a_vocabulary_as_a_table_gives_the_same_violations(spark, monkeypatch, sent):
    rng = random.Random(5)
    words = tuple(f"word{k}" for k in range(300))
    rows = [(k, "hot" if k % 3 == 0 else None if k % 7 == 0 else changed(rng, rng.choice(words), rng.randrange(3), "0w"), f"k{k % 90}") for k in range(1, 600)]
    df = spark.createDataFrame(rows, "_row_number long, v string, id string")
    found = []
    for few in (500, 10):
        monkeypatch.setattr(integrity, "FEW", few)
        monkeypatch.setattr(vocabulary, "SENT", sent)
        rules = Rules("t", ("id", "id"), vocabularies=(Vocabulary("id", "id", tuple(f"k{k}" for k in range(95))), Vocabulary("v", "v", words)))
        told = integrity_violations(judge(df, rules), rules)
        found.append(sorted(map(str, told.select("tag", "row_number", "value", "error_message", F.col("params")["suggestedValue"]).collect())))
    assert found[0] == found[1] and len(found[0]) > 300


def test_plans_do_not_grow_with_a_large_vocabulary(spark):
    df = spark.createDataFrame([(1, "w5"), (2, "w77777777")], "_row_number long, v string")
    sizes = []
    for n in (2_000, 200_000):
        rules = Rules("t", vocabularies=(Vocabulary("v", "v", tuple(f"w{k}" for k in range(n))),))
        judged = judge(df, rules)
        assert [r["kind"] for r in judged.orderBy("_row_number").collect()] == ["ok", "enum"]
        sizes.append(len(judged._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 500
    assert integrity_violations(judged, rules, suggest=False).first()["params"]["allowedValues"] == "200000 words"


def test_patterns_that_repeat_groups_are_linear(spark):
    assert [Pattern(p).repeats_groups for p in ("^(a|b)*$", "(ab)+", "(a+)+b", "a*b+", r"\)+", "[)]*", "(a){2}", "(a){2,}", "(ab)?")] == [True, True, True, False, False, False, False, True, False]
    assert Pattern("^(a|b)*$").usable and not Pattern("(a|(?=b))*").usable and not Pattern("(a|b)*(a{2000})").usable
    df = spark.createDataFrame([(1, "ab" * 5_000_000), (2, "ab" * 50_000 + "c"), (3, None), (4, "b")], "_row_number long, v string")
    found = field_violations(df, {"v": ("v", [Pattern("^(a|b)*$"), Pattern("^(a+)+$")])}).select("row_number", F.col("params")["pattern"].alias("p")).collect()
    assert sorted(map(tuple, found)) == [(1, "^(a+)+$"), (2, "^(a+)+$"), (2, "^(a|b)*$"), (4, "^(a+)+$")]


def test_patterns_equal_duckdb(spark):
    rng, con = random.Random(8), duckdb.connect()
    texts = ["".join(rng.choice("abc1 ") for _ in range(rng.randrange(12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "_row_number long, v string")
    patterns = ["^(" + "|".join("".join(rng.choice("abc1") for _ in range(rng.randrange(1, 3))) for _ in range(3)) + rng.choice([")*$", ")+", "){2,}"]) for _ in range(6)]
    for p in patterns:
        got = {r["row_number"] for r in field_violations(df, {"v": ("v", [Pattern(p)])}, None).collect()}
        assert got == {k for k, t in enumerate(texts) if t.strip() and not con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0]}


def test_repeated_words_of_a_table_count_once(spark):
    words = spark.createDataFrame([("able", 3), ("able", 1), ("cable", 2), ("cable", 4)] * 5, "word string, ordinal long")
    df = spark.createDataFrame([(1, "able"), (2, "cable"), (3, "bable")], "_row_number long, v string")
    rules = Rules("t", vocabularies=(Vocabulary("v", "v", (), table=words),))
    judged = judge(df, rules)
    assert sorted((r["_row_number"], r["kind"]) for r in judged.collect()) == [(1, "ok"), (2, "ok"), (3, "enum")]
    assert [r["params"]["suggestedValue"] for r in integrity_violations(judged, rules).collect()] == ["able"]


def test_a_small_table_of_words_is_indexed_by_many_tasks(spark):
    """The index has a hundred rows and more for a word, so a file of a few bytes must not be one task's."""
    words = spark.range(2_000).coalesce(1).selectExpr("concat('word', id) AS word", "id AS ordinal")
    values = spark.range(2_000).coalesce(1).selectExpr("concat('wrd', id) AS value")
    seen = []
    own = vocabulary.cut
    try:
        vocabulary.cut = lambda df: seen.append(own(df)) or seen[-1]
        assert vocabulary.nearest_words(values, words).count() == 2_000
    finally:
        vocabulary.cut = own
    assert [x.rdd.getNumPartitions() for x in seen] == [8, 8]


def test_neither_keys_nor_many_words_are_broadcast(spark, monkeypatch):
    """Spark sizes an explode as what goes into it, so it would send the keys of some 50,000 words, millions of rows, to the driver."""
    words = spark.range(300).selectExpr("concat('word', id) AS word", "id AS ordinal")
    values = spark.range(300).selectExpr("IF(id % 2 = 0, concat('wrd', id), concat('wxrxd', id)) AS value")
    near = vocabulary.nearest_words(values, words)
    assert {r["nearest"] for r in near.filter("value like 'wrd%'").collect()} == {f"word{k}" for k in range(0, 300, 2)}
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    monkeypatch.setattr(vocabulary, "SENT", 0)
    rules = Rules("t", vocabularies=(Vocabulary("v", "v", (), table=words),))
    judged = judge(values.selectExpr("1L AS _row_number", "value AS v"), rules)
    assert judged.filter("kind = 'enum'").count() == 300
    judged.collect()
    assert "BroadcastHashJoin" not in judged._jdf.queryExecution().executedPlan().toString()
