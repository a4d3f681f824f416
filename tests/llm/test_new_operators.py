import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import byte_bpe, hard_negatives, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, score int, code string, block int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """With columns that operators must not trip over."""
    return spark.createDataFrame([(i, v, l, 1, "x", 7) for i, v, l in rows], VECTORS)


def clean(vector, most=1e9):
    return vector is not None and all(x is not None and math.isfinite(x) and abs(x) <= most for x in vector)


def random_rows(rng, n, size=6, spread=1.0, labels=3):
    return [(k, [float(np.float32(rng.gauss(0, spread))) for _ in range(size)], rng.randrange(labels)) for k in range(n)]


ODD_ROWS = [(5000, None, 1), (5050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5051, [NAN] * 6, 1), (5052, [INF, 0.0, 0.0, 0.0, 0.0, 0.0], 2), (None, [1.0] * 6, 1), (5053, [1.0] * 6, None), (5100, [], 1), (5101, [], 2), (5150, [1.0, 2.0], 1), (5151, [1.0, 2.0], 1), (5152, [0.9, 1.5], 2), (5153, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0], 1)]


# 11 Hard negatives


def mined(rows, every=50, positives=5, negatives=3):
    kept = [(i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows if i is not None and l is not None and clean(v, 4096)]
    out = []
    for i, q, l in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, o)), j, m) for j, o, m in kept if len(o) == len(q))
        for s, j, _ in [x for x in scored if x[2] == l and x[1] != i][:positives]:
            fits = [x for x in scored if x[2] != l and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_equal_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "LEAST_ANCHORS", 2)
    rows = random_rows(rng, 400, labels=2 + 2 * seed)
    rows += [(i + 1000, v, l) for i, v, l in rows[:120]]  # ties of every score
    rows += rows[100:103] + [(50, rows[7][1], 0), (50, rows[8][1], 1)]  # repeated rows and repeated vec_ids
    rows += ODD_ROWS
    got = hard_negatives.mine(vectors(spark, rows), every=10 if seed else 50)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, 10 if seed else 50)


def test_hard_negatives_of_one_label_of_few_rows_and_of_none(spark):
    rng = random.Random(5)
    one = [(i, v, 3) for i, v, _ in random_rows(rng, 60) if i % 7 or i == 0]
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, one)).collect())) == mined(one)
    assert hard_negatives.mine(vectors(spark, [])).count() == 0
    assert hard_negatives.mine(vectors(spark, ODD_ROWS[:3])).count() == 0
    few = [(50, [1.0, 1.0], 1), (51, [1.0, 0.9], 1), (52, [0.9, 0.9], 2), (100, [-1.0, -1.0], 1), (53, [0.0, 0.0], 1), (54, [0.0, 0.0], 2)]
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, few)).collect())) == mined(few) != []


def test_planes_add_up_to_the_products():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (50, 11))
    planes = hard_negatives.Planes.of(x)
    total = sum(planes.weight(p) * planes.bits(p, slice(None)).astype(np.int64) for p in range(len(planes.planes)))
    assert (total == x).all()
    assert (hard_negatives.Planes.of(np.zeros((2, 3), np.int64)).bits(0, slice(None)) == 0).all()


def test_a_sweep_drops_most_pairs_before_the_last_plane(monkeypatch):
    """Pairs that can't qualify are left before all planes are read."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(0, 0.125, (3000, 64))).astype(np.int64)
    goal = hard_negatives.Positives(20, 5)
    read = []
    dense = goal.dense
    monkeypatch.setattr(goal, "dense", lambda tile, low, high, alive: read.append(np.count_nonzero(alive)) or dense(tile, low, high, alive))
    hard_negatives.sweep(x[:20], hard_negatives.Planes.of(x[1000:]), np.arange(2000), lambda t, p: np.ones((t.stop - t.start, p.stop - p.start), bool), goal)
    hard_negatives.sweep(x[:20], hard_negatives.Planes.of(x[:1000]), np.arange(1000), lambda t, p: np.ones((t.stop - t.start, p.stop - p.start), bool), goal)
    assert read[-1] < read[len(read) // 2 + 1]
    scores = x[:20] @ np.r_[x[1000:], x[:1000]].T
    assert (np.sort(goal.best.score.reshape(20, 5), axis=1) == np.sort(scores, axis=1)[:, -5:]).all()


# 12 Vector codes


def lloyd(rows, parts=4, entries=256, rounds=4, scale=1024):
    """As the contract says, without bounds."""
    kept = [r for r in rows if clean(r[1], 1e6)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    q = np.array([[math.floor(scale * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), parts, width // parts)
    if not kept:
        return [], np.zeros((parts, 0, 0), np.int64)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, q[k].ravel().tolist()))
    books = q[order[:entries]].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = np.stack([((q[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)], axis=1)
        own = far.argmin(axis=2)
        if turn < rounds:
            for p in range(parts):
                for j in range(books.shape[1]):
                    if (own[:, p] == j).any():
                        books[p, j] = q[own[:, p] == j, p].sum(axis=0) // (own[:, p] == j).sum()
    error = far.min(axis=2).sum(axis=1)
    return sorted(((i, l, own[k].tolist(), int(error[k])) for k, (i, _, l) in enumerate(kept)), key=str), books


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_plain_rounds(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(vector_codes, "LEAST_BLOCK", 64)
    rows = random_rows(rng, 700, size=10, spread=[1.0, 0.01, 0.002][seed])  # small spreads: many ties
    rows += rows[20:40] + [(900, rows[1][1], None), (None, rows[2][1], 1), (None, rows[3][1], None)] + [(1000 + k, rows[5][1], 2) for k in range(200)]
    rows += [(2000, None, 1), (2001, [None] * 10, 1), (2002, [INF] * 10, 1), (2003, [NAN] + [0.0] * 9, 1), (2004, [], 1), (2005, [0.5] * 3, 1)]
    codes, books = vector_codes.compress(vectors(spark, rows), entries=16 if seed else 256)
    want, own = lloyd(rows, entries=16 if seed else 256)
    assert (books == own).all()
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in codes.collect()), key=str) == want
    per = defaultdict(int)
    for _, label, _, error in want:
        per[label] += error
    told = vector_codes.label_errors(codes).collect()
    assert len(told) == len(want) and all(r["label_error"] == per[r["label"]] for r in told)
    decoded = vector_codes.decode(codes, books).filter("vec_id = 3").first()
    assert decoded["decoded"] == np.concatenate([books[p][c] for p, c in enumerate(decoded["code"])]).tolist()


def test_codes_of_few_rows_and_of_none(spark):
    for rows in ([], [(1, None, 2)], [(1, [], 2), (2, [], None)], [(1, [0.1, 0.2, 0.3, 0.4], 2)], [(2, [0.1] * 4, 1), (1, [0.1] * 4, 1)]):
        codes, books = vector_codes.compress(vectors(spark, rows))
        want, own = lloyd(rows)
        assert books.tolist() == own.tolist() or not books.size
        assert [(r["vec_id"], r["error"]) for r in codes.orderBy("vec_id").collect()] == [(i, e) for i, _, _, e in want]
        assert vector_codes.label_errors(codes).count() == len(want)
    assert vector_codes.fingerprint(np.array([[[1, -2]], [[3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()


def test_a_round_rescans_only_points_whose_bounds_are_violated():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(0, 100, (20, 8))[rng.integers(0, 20, 3000)] + rng.normal(0, 5, (3000, 8)))
    entries = points[:40].copy()
    lost = np.zeros((1, 40))
    heaps = vector_codes.Heaps.fill(points, entries, lost[0])
    scanned = []
    for _ in range(6):
        sums = vector_codes._sums(points.astype(np.int64), heaps.own, 40)
        new = np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), entries)
        moved = np.sqrt(((new - entries) ** 2).sum(axis=1))[None]
        lost, entries = lost + moved + vector_codes._fastest_other(moved), new.astype(float)
        heaps = vector_codes.Heaps.unpack(*heaps.pack())
        scanned.append(len(heaps.settle(points, entries, lost[0])))
        assert (heaps.own == vector_codes.nearest(points, entries)[0]).all()
        assert sorted(np.concatenate([p for _, p in heaps.heaps]).tolist()) == list(range(3000))
    assert scanned[-1] < 1500 and sum(scanned) < 6 * 3000


# 13 Byte-level pairs


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.RANKS), special_tokens={})


def odd_texts():
    rng = random.Random(13)
    letters = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", "'", "'s", "'re", "1", "23", "ß", "é", "日本", "🙂", " ", " ", "-", "...", "<|endoftext|>", "\x00", "́", "İ", "²", "٣"]
    texts = [None, "", " ", "a", "x" * 300, "ab" * 5000, " " * 4000 + "z", "=" * 70, "A" * 20_000, "lorem ipsum " * 3000, "it's 12 o'clock\n\n\tnow", "  \x85"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return texts + ["".join(chr(rng.randrange(97, 123)) for _ in range(rng.choice([5, 30, 64, 65, 200, 3000]))) for _ in range(60)]


@pytest.mark.parametrize("known", [byte_bpe.KNOWN, 3, 0])
def test_ids_equal_the_library(spark, library, known):
    texts = odd_texts()
    rows = [(k, t, 1, "w") for k, t in enumerate(texts)] + [(0, "twice", 1, "w"), (0, "twice", 1, "w"), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, `words parts` string").withColumnRenamed("ids", "words_text")
    done = byte_bpe.encode(docs.withColumn("ids", F.lit("clash")), known)
    assert done.columns == ["doc_id", "text", "words_text", "words parts", "ids"]
    got = done.select("*", byte_bpe.decode(F.col("ids")).alias("decoded")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in byte_bpe.digest(done).collect():
        if r["doc_id"]:
            ids = library.encode_ordinary(texts[r["doc_id"]] or "")
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_no_documents_and_ids_without_a_piece(spark):
    assert byte_bpe.digest(byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    rows = spark.createDataFrame([([72, None],), ([60_000],), ([],), (None,), ([39, 72],)], "ids array<int>")
    assert [r["d"] and bytes(r["d"]) for r in rows.select(byte_bpe.decode(F.col("ids")).alias("d")).collect()] == [None, None, b"", None, b"Hi"]


def test_the_heap_merges_as_the_fold(library):
    ranks, rng = byte_bpe.ranks_of(byte_bpe.RANKS), random.Random(2)
    for _ in range(500):
        word = bytes(rng.choice(b"abcdefghij etaoinshr\xc3\xa9") for _ in range(rng.randrange(1, 80)))
        assert byte_bpe.merge(word, ranks) == library._core_bpe.encode_single_piece(word)


def ids_of(words, ranks):
    return {w: np.array(byte_bpe.merge(w.encode(), ranks), "<i4").tobytes() for w in words}


def test_words_joined_from_parts_equal_the_library(library):
    """Most rare words need no fold of their own, and none that is joined differs."""
    rng, ranks = random.Random(5), byte_bpe.ranks_of(byte_bpe.RANKS)
    syllables = ["the", "tion", "ing", "é", "ón", "ü", "that", "er", "en", "ß", "que", "and", "ly", "ou", "eux", "日本"]
    words = {" " * rng.randrange(2) + "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(30_000)}
    words = sorted(words)
    rng.shuffle(words)
    parts = byte_bpe.cuts(ids_of(words[:3000], ranks), ranks)
    rare = [w.encode() for w in words[3000:] if w.encode() not in ranks]
    found = {w: byte_bpe.joined(w, *parts) for w in rare}
    assert sum(ids is not None for ids in found.values()) > 0.7 * len(rare)
    for w, ids in found.items():
        assert ids is None or np.frombuffer(ids, "<i4").tolist() == library._core_bpe.encode_single_piece(w)


def test_joined_words_are_exact_with_ranks_in_any_order():
    """Ranks that no training gives: ids that no merges reach, longer pieces before their parts, equal neighbours."""
    rng, joined = random.Random(8), 0
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(rng.randrange(2, 40))}
        pieces = [b"a", b"b", b"c", *pieces]
        rng.shuffle(pieces)
        ranks = {p: k for k, p in enumerate(pieces)}
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(400)}
        words = sorted(words)
        parts = byte_bpe.cuts(ids_of(rng.sample(words, 80), ranks), ranks)
        for w in map(str.encode, words):
            if w not in ranks and (ids := byte_bpe.joined(w, *parts)) is not None:
                joined += 1
                assert np.frombuffer(ids, "<i4").tolist() == byte_bpe.merge(w, ranks)
    assert joined > 1000
    assert byte_bpe.joined(b"ab", {}, {}, set()) is None and byte_bpe.joined(b"", *parts) is None


def test_parts_of_long_words_stay_few():
    rng, ranks = random.Random(9), byte_bpe.ranks_of(byte_bpe.RANKS)
    known = ids_of({"".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(21)) for _ in range(200)}, ranks)
    heads, tails, seams = byte_bpe.cuts(known, ranks, 500)
    assert 500 <= len(heads) + len(tails) < 500 + 2 * byte_bpe.FOLDED and len(seams) <= 500
    assert sum(map(len, byte_bpe.cuts(known, ranks)[:2])) > 5000
