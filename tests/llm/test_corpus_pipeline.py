import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tablewright.llm import near_copies

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_every_query_is_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA)).checkpoint()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        counts.append(out.count())
        docs = out
    assert counts[1] == counts[2] and counts[-1] > 0.5 * counts[0] and counts == sorted(counts, reverse=True)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert {r["doc_id"] for r in placed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_take_odd_rows(spark):
    line = " ".join(f"w{k}" for k in range(70))
    rows = [(1, line, None, "s", 3), (1, line, None, "s", 3), (2, line, "en", None, None), (None, line, None, None, None), (3, None, None, None, 0), (4, "", None, None, 0), (5, "all else here", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(DATA)).count() <= len(rows), name
    docs = docs.union(spark.createDataFrame([(1, "quite another text of its own, no copy", "xx", None, None), (2, "quite another text of its own, no copy", "xx", None, None)], docs.schema))
    near = [r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, str(DATA)).collect()]
    assert sorted(near, key=str) == [1, 1, 3, 5, None]
    clash = docs.withColumns({c: F.lit(c) for c in ("deleted_lines", "near_id", "Version", "root", "fingerprint", "cut_lines", "a.b")})
    clash = clash.union(clash.limit(1).withColumn("text", F.lit("one very long line " * 60_000)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, str(DATA))
        assert out.columns == clash.columns and out.filter("deleted_lines <> 'deleted_lines' or `a.b` <> 'a.b'").isEmpty() and out.count() > 3, name
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(DATA)).count() == 0, name


def test_pipeline_takes_effect(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert left and not any(i in texts[d] for d in left for i in items)


@pytest.mark.parametrize("name", ["op4_url_filters", "op7_embedding_near_dedup", "op9_line_dedup"])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    own = entry.queries()[name](spark, str(DATA))
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(own.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, own.select(*want.columns).collect())) == sorted(map(key, want.fetchall()))


@pytest.mark.parametrize("name", ["op1_best_fit_packing", "op2_lm_scoring", "op3_simhash_near_dedup", "op6_pii", "op7_embedding_near_dedup", "op8_license_scans", "op9_line_dedup", "op10_toxicity"])
def test_query_returns_all_rows(spark, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op7") else ("documents", "doc_id")
    ids = [r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()]
    found = [r[key] for r in entry.queries()[name](spark, str(DATA)).collect()]
    assert set(found) == set(ids) and (name.startswith("op1_") or len(found) == len(ids))


@pytest.mark.parametrize("at_once", [64, 3])
def test_near_dedup_links_all_of_similarity_four_fifths(spark, monkeypatch, at_once):
    monkeypatch.setattr(near_copies, "LIST", at_once)
    monkeypatch.setattr(near_copies, "BLOCK", at_once // 2)
    monkeypatch.setattr(near_copies, "STARS", 1)
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for edits in (0, 1, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == dict(enumerate(root))
    left = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert left == set(root) and len(left) < len(texts) / 2


def test_near_dedup_runs_simhash_and_verifies_its_links(spark, monkeypatch):
    """Without the bands, fingerprints at most three bits apart alone link copies with an edited word; nothing less similar."""
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(800)) for _ in range(6)]
    texts = [t for b in base for t in (b, b + " more", "else " + b, b + " " + b)]
    prints = [near_copies.simhash.fingerprint(t, 5) for t in texts]
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for i, j in pairs:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    assert len(set(root)) < len(texts)
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "_stars", lambda members: none)
    monkeypatch.setattr(near_copies, "_compared", lambda rows, sets: none)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == dict(enumerate(root))


def test_near_dedup_gives_back_the_disk_of_its_steps(spark, monkeypatch):
    """After each step, few of the shuffles that it wrote are left."""
    import re
    import time

    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {int(m[1]) for d in folders for f in Path(d).rglob("shuffle_*") if (m := re.match(r"shuffle_(\d+)_", f.name))}
    spark.range(8).groupBy("id").count().collect()
    before, left, give_back = max(shuffles(), default=-1), [], near_copies.release

    def release(session):
        give_back(session)
        for _ in range(20):  # the cleaner has a thread of its own
            own = sum(k > before for k in shuffles())
            if own < 20:
                break
            time.sleep(0.5)
        left.append(own)

    monkeypatch.setattr(near_copies, "release", release)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[: 7 * k], f"x{k}", *base[7 * k :]]) for k in range(20)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["component_id"] for r in near_copies.near_copies(docs).collect()} == {0}
    assert len(left) > 5 and max(left) < 20
