"""Spark takes the size of what goes into an explode for that of what comes out, so it would broadcast tables that the driver can't hold."""

import random

from tablewright.llm import line_dedup, near_copies, simhash


def plans(monkeypatch, module):
    """The frames that module writes from now on; their plans are the ones that ran."""
    seen, own = [], module.checkpoint
    monkeypatch.setattr(module, "checkpoint", lambda df: (seen.append(df), own(df))[1])
    return lambda: [df._jdf.queryExecution().executedPlan().toString() for df in seen]


def test_variants_of_fingerprints_are_never_broadcast(spark, monkeypatch):
    ran, rng = plans(monkeypatch, simhash), random.Random(4)
    low = rng.getrandbits(32)
    dense = [k << 40 | low for k in range(100)]  # in one bucket, so that it is split by the other half
    prints = [rng.getrandbits(63) for _ in range(2_000)] + dense
    near = [x ^ 1 << rng.randrange(63) for x in prints[:50]]
    found = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(x,) for x in prints + near], "fp long")).collect()}
    assert {tuple(sorted(x)) for x in zip(prints, near)} <= found
    kept, split = ran()
    assert "SortMergeJoin" in kept and "BroadcastHashJoin" not in kept
    assert "SortMergeJoin" in split and "BroadcastHashJoin" not in split


def test_near_copies_never_broadcast_sets_or_rows_of_bands(spark, monkeypatch):
    ran = plans(monkeypatch, near_copies)
    texts = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + [f"{t} more" for t in texts])), "doc_id long, text string")
    prints = near_copies.checkpoint(near_copies._prints(docs))
    members = near_copies._members(prints)
    sets = near_copies._sets(docs, prints, members.select("node").distinct())
    stars = near_copies.checkpoint(near_copies._stars(members))
    assert near_copies._similar(stars, sets).count() >= 20
    _, _, _, met, *_, similar = ran()
    assert [("SortMergeJoin" in x, "BroadcastHashJoin" in x) for x in (met, similar)] == [(True, False)] * 2


def test_suffixes_are_never_broadcast(spark):
    runs = spark.createDataFrame([(0, 0, 3), (0, 1, 2), (1, 0, 2), (1, 1, 1)], "seg long, i int, n int")
    ids = [(0, [(7, 7), (8, 8), (9, 9)]), (1, [(8, 8), (9, 9)])]
    named = line_dedup.intervals(spark.createDataFrame(ids, "seg long, ids array<struct<h:long,g:long>>"), runs)
    rows = {(r["seg"], r["i"], r["n"]): (r["a"], r["b"]) for r in named.collect()}
    assert rows[0, 1, 2] == rows[1, 0, 2] and len(set(rows.values())) == 3
    assert "BroadcastHashJoin" not in named._jdf.queryExecution().executedPlan().toString()
