import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, embedding_dedup, licenses, line_dedup, lm_score, packing, pii, simhash, toxicity, url_rules
from tablewright.llm.bilstm_crf import Tagger
from tablewright.llm.components import components

ODD = [None, "", " ", "a", "\n\n", "x " * 30_000, "\udc80".encode("utf-8", "replace").decode(), "äöü ß 日本 🙂", "tab\there", "A" * 5_000]


def documents(spark, texts, start=0):
    """With columns that operators must not trip over."""
    rows = [(None if k == 1 else start + k, t, None, 5, "s") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, fp string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# Components


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, k) for k in range(401, 460)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 Packing


def test_pieces_equal_the_tokenizer(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = [*ODD, "a<|endoftext|>b", "it's 12 o'clock\n\n\tnow", "word " * 1022, "word " * 1023, "word " * 3000]
    rows = packing.pieces(documents(spark, texts)).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for k, t in enumerate(texts):
        parts = sorted(by_doc[None if k == 1 else k], key=lambda r: r["piece"])
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        assert [i for p in parts for i in np.frombuffer(p["ids"], "<u4").tolist()] == ids
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts[:-1])]).tolist()
        assert all(p["length"] == 1024 for p in parts[1:]) and all(p["length"] <= 1024 for p in parts)
        assert [p["piece"] for p in parts] == list(range(len(parts)))


def test_best_fit_fills_sequences():
    rng = np.random.default_rng(2)
    lengths = np.r_[rng.integers(1, 1025, 4000), [600] * 500]
    bins, offsets = packing.best_fit(lengths, (1024.0, 1024.0, 1024.0**2))
    check_places(lengths, bins, offsets)
    assert bins.max() + 1 <= max(math.ceil(lengths.sum() / 1024), (lengths > 512).sum()) * 1.01
    bins, _ = packing.best_fit(lengths[lengths < 700], (1024.0, 1024.0, 1024.0**2))
    assert bins.max() + 1 <= lengths[lengths < 700].sum() / 1024 * 1.03 + 1


def check_places(lengths, bins, offsets):
    spans = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets):
        spans[b].append((o, n))
    for own in spans.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024


def test_best_fit_keeps_every_capacity():
    lengths = np.random.default_rng(3).integers(1, 400, 500)
    for by in ("norm", "dot"):
        bins, _ = packing.best_fit(lengths, (1024.0, 3.0, 200_000.0), (1.0, 0.5, 0.5), by)
        for b in set(bins.tolist()):
            own = lengths[bins == b]
            assert own.sum() <= 1024 and len(own) <= 3 and (own**2).sum() <= 200_000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]), (1024.0, 10.0, 1e9))


def test_pack_whole_tables(spark):
    lengths = spark.range(3000).select(F.col("id").alias("doc_id"), (F.xxhash64("id") % 512 + 512).alias("length"), F.lit("x").alias("shard"), F.lit(None).cast("string").alias("nothing"))
    rows = packing.pack(lengths, shard=500).collect()
    assert len(rows) == 3000 and {r["shard"] for r in rows} == {"x"}
    check_places([r["length"] for r in rows], [r["sequence_id"] for r in rows], [r["offset"] for r in rows])
    assert packing.pack(lengths.limit(0)).count() == 0
    one = packing.pack(spark.createDataFrame([(1, 10), (1, 10)], "doc_id long, length long"))
    assert sorted(r["offset"] for r in one.collect()) == [0, 10]


def test_sequences_hold_the_ids(spark):
    placed = packing.pack(packing.pieces(documents(spark, ["one two", "x", "three " * 2000])))
    rows = packing.sequences(placed).collect()
    assert sum(len(r["ids"]) for r in rows) == placed.agg(F.sum("length")).first()[0]
    assert all(r["ids"].count(2) <= len(r["documents"]) for r in rows)


# 2 Language models


def brute_losses(docs, target_of, index):
    words = [lm_score.numbers(t, lm_score.Vocabulary()) for t in docs]
    own = words[index]
    out = []
    for m in (True, False):
        unigrams, pairs, starts = Counter(), Counter(), 0
        for k, w in enumerate(words):
            if target_of[k] == m and k != index and len(w):
                unigrams.update(w.tolist())
                pairs.update(lm_score.pairs(lm_score._before(w), w).tolist())
                starts += 1
        total, loss, before = sum(unigrams.values()), 0.0, 0
        for w, p in zip(own.tolist(), lm_score.pairs(lm_score._before(own), own).tolist()):
            q = (unigrams[w] + lm_score.ADD) / (total + lm_score.ADD * 2**lm_score.WORD_BITS)
            n = starts if before == 0 else unigrams[before]
            loss -= math.log((min(pairs[p], n) + lm_score.PRIOR * q) / (n + lm_score.PRIOR))
            before = w
        out.append(loss / len(own) if len(own) else 0.0)
    return out


def test_losses_equal_counting_by_hand(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("red green blue dog cat runs sleeps".split()) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", "red red red"]
    docs = spark.createDataFrame([(k, t, k % 3 == 0) for k, t in enumerate(texts)], "doc_id long, text string, target boolean").repartition(5)
    rows = {r["doc_id"]: r for r in lm_score.score(docs, lm_score.count(docs)).collect()}
    for k in range(len(texts)):
        want = brute_losses(texts, [i % 3 == 0 for i in range(len(texts))], k)
        assert rows[k]["target_loss"] == pytest.approx(want[0], rel=1e-5) and rows[k]["background_loss"] == pytest.approx(want[1], rel=1e-5)
        assert rows[k]["difference"] == pytest.approx(want[0] - want[1], abs=1e-5) and rows[k]["tokens"] == len(texts[k].split())


def test_counts_merge_in_a_tree(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" v")).alias("text"), (F.col("id") % 2 == 0).alias("target"))
    one = lm_score.count(docs.repartition(1))
    monkeypatch.setattr(lm_score, "FAN", 3)
    many = lm_score.count(docs.repartition(29))
    assert (one.words == many.words).all() and (one.pairs == many.pairs).all() and one.words[:, 1:].sum() == 400


def test_counts_are_of_the_words_themselves(spark, monkeypatch):
    """More words than 2^18: counted by hand on the words, in one chunk and in many."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(600_000)}" for _ in range(20_000)) for _ in range(30)] + ["w1 w2 w1 w3", "w5 w1 w2"]
    target = [k % 3 == 0 for k in range(len(texts))]
    split = [t.split() for t in texts]
    singles, doubles = ([Counter(w for k, own in enumerate(split) if target[k] == m for w in own) for m in (False, True)], [Counter(p for k, own in enumerate(split) if target[k] == m for p in zip([None, *own], own)) for m in (False, True)])
    vocabulary = len({w for own in split for w in own})
    assert vocabulary > 1 << lm_score.WORD_BITS
    docs = spark.createDataFrame([(k, t, target[k]) for k, t in enumerate(texts)], "doc_id long, text string, target boolean").repartition(4)
    for size in (lm_score.CHUNK, 500_000):
        monkeypatch.setattr(lm_score, "CHUNK", size)
        rows = {r["doc_id"]: r for r in lm_score.score(docs, lm_score.count(docs)).collect()}
        for k in (0, 1, 30, 31):
            for m, name in ((True, "target_loss"), (False, "background_loss")):
                own, own_pairs = (Counter(split[k]), Counter(zip([None, *split[k]], split[k]))) if target[k] == m else (Counter(), Counter())
                total, starts, loss = sum(singles[m].values()) - sum(own.values()), target.count(m) - (target[k] == m), 0.0
                for before, w in zip([None, *split[k]], split[k]):
                    q = (singles[m][w] - own[w] + lm_score.ADD) / (total + lm_score.ADD * vocabulary)
                    n = starts if before is None else singles[m][before] - own[before]
                    loss -= math.log((min(doubles[m][before, w] - own_pairs[before, w], n) + lm_score.PRIOR * q) / (n + lm_score.PRIOR))
                assert rows[k][name] == pytest.approx(loss / len(split[k]), rel=1e-9)


def test_odd_texts_and_targets(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    docs = lm_score.with_target(documents(spark, ODD), labels)
    rows = lm_score.score(docs, lm_score.count(docs)).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r["difference"]) for r in rows)
    assert {r["doc_id"] for r in docs.filter("target").collect()} == {0, 3}
    none = lm_score.with_target(empty(spark), labels)
    assert lm_score.score(none, lm_score.count(none)).count() == 0


# 3 SimHash


def test_fingerprints_equal_spark_hashes(spark):
    docs = documents(spark, [*ODD, "The quick brown fox jumps", "the QUICK brown\tfox\njumps", "one two", "one"])
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.filter("length(text) < 10000 OR text IS NULL").select("doc_id", words.alias("w")).collect()
    own = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    for r in rows:
        w = r["w"]
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hashes = [x["h"] & (2**64 - 1) for x in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert own[r["doc_id"]] == want


@pytest.mark.parametrize("at_once, centers", [(64, 12), (3, 2)])
def test_links_join_what_is_within_three_bits(spark, monkeypatch, at_once, centers):
    monkeypatch.setattr(simhash, "LIST", at_once)
    rng = np.random.default_rng(5)
    prints = set()
    for c in rng.integers(0, 2**63, centers, dtype=np.uint64).tolist():
        for _ in range(160 // centers):
            x = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    f = np.array(sorted(prints | {0, 7}), dtype=np.uint64)
    near = np.array([np.bitwise_count(f ^ x) for x in f]) <= 3
    v = f.view(np.int64)
    want = v.copy()
    while not (new := np.array([want[n].min() for n in near])).tolist() == want.tolist():
        want = new
    roots = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(int(x),) for x in v], "fp long"))).collect()}
    assert [roots.get(int(x), int(x)) for x in v] == want.tolist()


def test_near_duplicates_of_odd_tables(spark):
    long = " ".join(f"w{k}" for k in range(400))
    docs = documents(spark, ["", None, long, long, long.replace("w7 ", "w8 "), "other text entirely here"]).union(documents(spark, [long]))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 7
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert by_id[2][0]["component_id"] == by_id[3][0]["component_id"] == 0 or by_id[3][0]["component_id"] == 0
    assert by_id[None][0]["fingerprint"] == "0" * 16 and by_id[5][0]["component_id"] == 5
    assert simhash.near_duplicates(empty(spark)).count() == 0


# 4 Urls


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_rules_equal_brute_force(spark):
    rng = random.Random(6)
    names, tops, paths = ["a", "b", "aa", "example"], ["net", "org", "com"], ["/", "/en/", "/en/x", "/e", "", "/de/"]
    rules = {(".".join(rng.choices(names, k=rng.randrange(3)) + [rng.choice(tops)]), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"{rng.choice(['http', 'https'])}://{'.'.join(rng.choices(names, k=rng.randrange(4)) + [rng.choice(tops)])}{rng.choice(paths)}{rng.choice(['', 'x/y', '?q=/en/', '#f'])}" for _ in range(600)]
    urls += ["http://HOT.Example.NET/en/1"] * 400 + [None, "", "no scheme", "://", "http://", "a://b.net://c", "http://a.net"]
    pages = spark.createDataFrame([(k if k else None, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    for ranges in (1, 13):
        rows = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=ranges).collect()
        assert len(rows) == len(urls)
        for r in rows:
            m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"] or 0] or "")
            host, path = (m[1].lower(), m[2]) if m else ("", "")
            assert (r["host"], r["path"]) == (host, path) and (r["rule"], r["verdict"]) == brute_rule(host, path, rules)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(2**60 + 1, "http://a.net/"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    rows = url_rules.judge(pages, none).collect()
    assert {(r["page_id"], r["verdict"]) for r in rows} == {(2**60 + 1, "allow"), (None, "allow")}
    assert url_rules.judge(pages.limit(0), none).count() == 0
    assert url_rules.nested(["/", "/en", "/en/x", "/fr"]) == [-1, 0, 1, 0]


# 5 Decontamination


def edit(text, n, rng):
    own = list(text)
    for _ in range(n):
        at = rng.randrange(len(own))
        match rng.randrange(3):
            case 0:
                own[at] = rng.choice("xyz")
            case 1:
                del own[at]
            case 2:
                own.insert(at, rng.choice("xyz"))
    return "".join(own)


def best_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_passages_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 8, 20, 30, 40)] + ["tiny", None, "  "]
    texts = [*ODD[:5], *(" ".join(word() for _ in range(60)) for _ in range(4))]
    for k in range(40):
        item = items[k % 5]
        n = rng.randrange(decontaminate.edit_budget(len(item)) + 2)
        cut = rng.choice([" ", "\n\t "])
        texts.append(f"{' '.join(word() for _ in range(rng.randrange(20)))}{cut}{edit(item, n, rng).upper()}{cut}{' '.join(word() for _ in range(20))}")
    texts.append("it is a tiny one")
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs, bench).collect()}
    for k, t in enumerate(texts):
        for i, item in enumerate(items):
            own = decontaminate.normalize(item)
            if own:
                d = best_distance(own, decontaminate.normalize(t))
                budget = decontaminate.edit_budget(len(own)) if len(own) >= decontaminate.Q else 0
                assert found.get((None if k == 1 else k, i)) == (d if d <= budget else None), (k, i)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None if k == 1 else k for k in range(len(texts))} - {d for d, _ in found}
    assert decontaminate.matches(docs, bench.limit(0)).count() == decontaminate.matches(empty(spark), bench).count() == 0


def listed(values, at, items, half):
    """The same counts by listing all pairs."""
    out = Counter()
    for v, d in zip(values.tolist(), at.tolist()):
        for k in np.flatnonzero(items.keys == v).tolist():
            out[int(items.item[k]), (d - int(items.place[k])) // int(half[items.item[k]])] += 1
    return out


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_counts_in_steps_equal_listing(monkeypatch, most):
    monkeypatch.setattr(decontaminate, "LISTED", most)
    import pyarrow as pa

    items = decontaminate.index(pa.array([1, 2, 3]), ["ab" * 40, "a" * 50, "abcab" * 12])
    values = decontaminate.grams(decontaminate._codes("ab" * 70 + "a" * 90 + "abcab" * 9))
    at = np.arange(len(values))
    item, step, number = decontaminate._counted(values, at, items, np.array([3, 2, 4]))
    assert dict(zip(zip(item.tolist(), step.tolist()), number.tolist())) == listed(values, at, items, np.array([3, 2, 4]))


def test_repetitive_texts_take_little_time_and_memory():
    import resource
    import time

    import pyarrow as pa

    items = decontaminate.index(pa.array([1, 2]), ["a" * 2_000, "ab" * 1_000])
    began, used = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [f[0] for f in decontaminate.find("a" * 200_000, items)] == [0]
    assert [f[:2] for f in decontaminate.find("ab" * 50_000, items)] == [(1, 0)]
    assert time.time() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - used < 1_000_000  # kilobytes


def test_ids_of_any_type(spark):
    passage = "a passage of the benchmark that is long enough to count"
    for kind in ("decimal(20,0)", "smallint", "date", "string", "int"):
        bench = spark.createDataFrame([("1" if kind != "date" else "2020-01-01", passage)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
        found = decontaminate.matches(spark.createDataFrame([(1, f"x {passage} y")], "doc_id long, text string"), bench)
        assert found.schema["item_id"].dataType == bench.schema["item_id"].dataType and found.count() == 1


def test_benchmark_in_parts(spark):
    bench = spark.createDataFrame([(k, f"passage number {k} of the benchmark, long enough to count") for k in range(30)], "item_id long, text string")
    assert sum(len(p.ids) for p in decontaminate.parts(bench, 300)) == 30 and len(list(decontaminate.parts(bench, 300))) > 3


# 6 Personal data


def test_patterns_equal_plain_regular_expressions():
    rng = random.Random(8)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(4000):
        text = "".join(rng.choices("a1@.-+ (%2)3é\n", k=rng.randrange(60)))
        want = []
        for kind, p in plain.items():
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                    want.append((kind, *m.span()))
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "." * 10 + "1.2.3.4" + "9" * 300_000) == []


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = Tagger.fresh(6, 5, hidden=4)
    tagger.params = {k: v.astype(np.float64) for k, v in tagger.params.items()}
    x, y, mask = rng.integers(0, 6, (3, 7)), rng.integers(0, 5, (3, 7)), np.ones((3, 7), bool)
    mask[1, 5:] = mask[2, 3:] = False
    grad = tagger.loss(x, y, mask)[1]
    for name, p in tagger.params.items():
        at = tuple(int(rng.integers(n)) for n in p.shape)
        old, values = p[at], []
        for step in (1e-4, -1e-4):
            p[at] = old + step
            values.append(tagger.loss(x, y, mask)[0])
        p[at] = old
        assert (values[0] - values[1]) / 2e-4 == pytest.approx(grad[name][at], abs=5e-4)


@pytest.fixture(scope="module")
def tagger():
    return pii.train([])


def test_tagger_on_held_out_spans(tagger):
    held = pii.made_up(400, seed=99)
    found = pii.tagged([t for t, _ in held], tagger)
    spans = [s in f for f, (_, own) in zip(found, held) for s in own]
    secrets = [s in f for f, (_, own) in zip(found, held) for s in own if s[0] == "secret"]
    assert np.mean(spans) > 0.9 and np.mean(secrets) > 0.9 and sum(bool(f) for f, (_, own) in zip(found, held) if not own) <= 4


def test_added_spans(spark, tagger):
    texts = ["call (988) 555-2485 now", "mail me: ab.12@mail8.example.com or +1 (988) 555-2485", *ODD, "7" * 500]
    rows = {r["doc_id"]: r for r in pii.find(documents(spark, ["", *texts]), tagger).collect()}
    assert [tuple(s) for s in rows[None]["added"]] == [("phone", 5, 19)] and rows[None]["base"] == []
    assert [s["kind"] for s in rows[2]["base"]] == ["email", "phone"] and rows[2]["added"] == []
    assert len(rows) == len(texts) + 1 and pii.find(empty(spark), tagger).count() == 0
    assert pii.sample(documents(spark, texts), 5) == pii.sample(documents(spark, texts).repartition(3), 5)


def test_windows_cover_and_agree(tagger):
    assert all(set().union(*(range(w, w + pii.WINDOW) for w in pii.windows(n))) >= set(range(n)) for n in range(1, 300))
    padded = "word " * 40
    one = pii.tagged(["tel. (988) 555-2485, fine"], tagger)[0]
    for shift in range(0, 60, 7):
        text = "1" + "x" * shift + " 5 " + padded[: 20 + shift] + "tel. (988) 555-2485, fine"
        assert (one[0][0], one[0][1] + len(text) - 25) in [(k, s) for k, s, _ in pii.tagged([text], tagger)[0]]


# 7 Embeddings


def brute_links(rows):
    unit = [embedding_dedup.units(np.array([v]))[0] if embedding_dedup.usable(v) else None for _, v, _ in rows]
    linked = [[False] * len(rows) for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            a, b = unit[i], unit[j]
            linked[i][j] = i != j and a is not None and b is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and float(a @ b) >= embedding_dedup.COSINE
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, row in enumerate(linked):
            least = min([label[i], *(label[j] for j, on in enumerate(row) if on)])
            changed |= least != label[i]
            label[i] = least
    return [(r[0], sum(linked[k]), label[k], r[0] == label[k]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("small", [{"PER_LIST": 30, "BLOCK": 16}, {"PER_LIST": 30, "BLOCK": 16, "ASKING": 2, "STEP": 7, "MAX_LISTS": 4, "SAMPLE": 120, "MAX_SENT": 0}])
def test_vectors_equal_brute_force(spark, monkeypatch, small):
    for name, value in small.items():  # the second has two levels of centroids, a drawn sample and several steps a block
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(9)
    rows, centers = [], rng.normal(size=(30, 16))
    for k in range(330):
        c = centers[rng.integers(30)] if k % 3 else rng.normal(size=16)
        v = (c + rng.normal(scale=0.12, size=16)) * rng.choice([1e-20, 1, 1e8])
        rows.append((k, v.tolist(), int(rng.integers(3))))
    rows += [(k, rows[5][1], rows[5][2]) for k in range(330, 380)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None] + [0.0] * 14, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] + [0.0] * 15, 1), (405, [1.0] * 16, None), (406, [], 1), (407, [1.0] * 8, 1), (408, [2.0] * 8, 1), (409, rows[0][1], None)]
    own = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cls string, n int"))
    found = sorted(tuple(r) for r in own.collect())
    want = sorted(brute_links(rows))
    assert [f[0] for f in found] == [w[0] for w in want] and all(f[1] <= w[1] for f, w in zip(found, want))
    assert sum(f[1] for f in found) >= 0.99 * sum(w[1] for w in want) and np.mean([f == w for f, w in zip(found, want)]) > 0.97
    assert found[-9:] == want[-9:]


def test_two_levels_of_lists():
    rng = np.random.default_rng(21)
    unit = embedding_dedup.units(rng.normal(size=(400, 8)))
    quantizer = embedding_dedup.fit(unit, 300)
    assert len(quantizer.centroids) == 50 and len(quantizer.finer) == 6
    far = ((unit[:, None, :] - quantizer.centre(np.arange(300))[None]) ** 2).sum(axis=2)
    assert (quantizer.lists(unit, 300)[:, :6] == np.argsort(far, axis=1)[:, :6]).all()  # with all probes the order is that of all centres
    own = quantizer.lists(unit, 6)[:, 0]
    codes, error = quantizer.encode(unit, own)
    for k in range(0, 400, 40):
        off = np.abs(quantizer.approximate(unit, int(own[k]), codes[[k]])[:, 0] - unit @ unit[k])
        assert (off <= error[k] + 1e-9).all()


def test_repeated_and_missing_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (None, None, None)], kind)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


# 8 Licences


def test_scan_equals_brute_force():
    rng = random.Random(10)
    scanner = licenses.Scanner()
    words = "cc by all rights reserved general public license gnu mit x cc0".split()
    for _ in range(500):
        text = "".join(rng.choice(words) + rng.choice([" ", "-", "\n", ". ", "é"]) for _ in range(rng.randrange(30))).title()
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(licenses._UPPER))
        want = sorted((i, len(p.split()), label) for p, label in licenses.BASE.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split())
        found = scanner(text)
        assert found.words == len(own) and sorted(found.hits) == want


def test_expressions():
    parse = licenses.parse
    own = parse("MIT OR Apache-2.0 WITH LLVM-exception AND (BSD-3-Clause or GPL-2.0+) trailing")
    assert own.postfix == ("mit", "apache-2.0", "llvm-exception", "with", "bsd-3-clause", "gpl-2.0+", "or", "and", "or")
    assert own.holds({"mit"}) and own.holds({"apache-2.0", "gpl-2.0+"}) and not own.holds({"apache-2.0"})
    assert [parse(x) and parse(x).postfix for x in ("(MIT", "or mit", "", "()", "a and", "a b", "((a))")] == [None, None, None, None, ("a",), ("a",), ("a",)]
    rng = random.Random(11)
    for _ in range(300):
        text = build(rng, 3)
        accepted = {x for x in "pqrs" if rng.random() < 0.5}
        assert parse(text).holds(accepted) == eval(re.sub(r"\b[pqrs]\b", lambda m: str(m[0] in accepted), text))  # noqa: S307


def build(rng, depth):
    if not depth or rng.random() < 0.3:
        return rng.choice("pqrs")
    own = f"{build(rng, depth - 1)} {rng.choice(['and', 'or'])} {build(rng, depth - 1)}"
    return f"({own})" if rng.random() < 0.5 else own


def test_labels_of_texts(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, ["SPDX-License-Identifier: MIT OR (ISC and 0BSD)\ncode", None, "Licensed under CC BY-NC 4.0. All rights reserved", *ODD])).collect()}
    assert rows[0]["labels"] == "0bsd,isc,mit" and rows[0]["n_base"] == 0 and rows[0]["first_word"] is None and 0 < rows[0]["score"] < 1
    assert (rows[2]["base_labels"], rows[2]["labels"], rows[2]["first_word"], rows[2]["last_word"]) == ("cc-by,reserved", "cc-by,cc-by-nc,reserved", 2, 7)
    assert rows[None]["n_words"] == 0 and rows[None]["score"] == 0 and licenses.scan(empty(spark)).count() == 0


def test_tags_that_name_no_licence(spark):
    texts = ["SPDX-License-Identifier: see the LICENSE file", None, "SPDX-License-Identifier:\nthis is code", "SPDX-License-Identifier: MIT and Secret-1.0", "a SPDX-License-Identifier: (MIT OR GPL-3.0-only) b SPDX-License-Identifier: isc", "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note"]
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert [rows[k]["labels"] for k in (0, 2, 3, 4, 5)] == ["", "", "mit", "gpl-3.0-only,isc,mit", "gpl-2.0-only"]
    assert [rows[k]["permitted"] for k in (0, 2, 3, 4, 5)] == [None, None, False, True, False] and rows[0]["score"] == 0
    assert licenses.scan(documents(spark, texts), frozenset({"gpl-2.0-only"})).filter("permitted").count() == 1


def test_many_tags_that_do_not_parse():
    import time

    began = time.time()
    assert licenses.Scanner()("SPDX-License-Identifier: ((" * 20_000).expressions == []
    assert time.time() - began < 10


def told(text, accepted=licenses.ACCEPTED):
    found = licenses.Scanner()(text)
    return "; ".join(" ".join(e.postfix) for e in found.expressions), found.permitted(accepted)


def test_exceptions_and_unknown_names():
    assert told("SPDX-License-Identifier: MIT WITH gpl-3.0") == ("mit gpl-3.0 with", False)
    assert told("SPDX-License-Identifier: MIT WITH LLVM-exception") == ("mit llvm-exception with", True)
    assert told("SPDX-License-Identifier: BSD-3-Clause-Clear") == ("bsd-3-clause-clear", False)
    assert told("SPDX-License-Identifier: MIT OR CC-BY-NC-4.0, the ISC License") == ("mit cc-by-nc-4.0 or; isc", True)
    assert told("SPDX-License-Identifier: LLVM-exception") == ("llvm-exception", False)
    own = licenses.Scanner()("SPDX-License-Identifier: (MIT OR LicenseRef-Own) AND ISC WITH none-1.0")
    assert own.labels == {"mit", "isc"} and own.unknown == {"licenseref-own", "none-1.0"} and not own.permitted(licenses.ACCEPTED)
    assert licenses.Scanner()("SPDX-License-Identifier: MIT WITH GPL-3.0").labels == {"mit"}
    assert licenses.Scanner()("BSD 3-Clause Clear, BSD 3-Clause").labels == {"bsd-3-clause", "bsd-3-clause-clear"} and licenses.Scanner()("BSD 3-Clause Clear").labels == {"bsd-3-clause-clear"}


def test_notices_in_prose():
    assert told("Licensed under the Apache License, Version 2.0 or the MIT License.") == ("apache-2.0 mit or", True)
    assert told("under either the MIT License or (the ISC License and the GNU General Public License, version 3)") == ("mit isc gpl-3.0 and or", True)
    assert told("(MIT License and Mozilla Public License 2.0) or ISC License") == ("mit mpl-2.0 and isc or", True)
    gpl = "GNU General Public License v2 or (at your option) any later version, with the Classpath exception"
    assert told(gpl) == ("gpl-2.0-or-later classpath-exception-2.0 with", False) and told(gpl, frozenset({"gpl-2.0-or-later"}))[1]
    assert told("General Public License version 2 only, Lesser: GNU Lesser General Public License 2.1+")[0] == "gpl-2.0-only; lgpl-2.1-or-later"
    assert told("CC BY-NC-ND 4.0 and/or CC0") == ("cc-by-nc-nd-4.0 cc0-1.0 or", True)
    assert told("MIT License. And the ISC License") == ("mit; isc", True) == told("MIT License\n\nor ISC License")
    assert told("MIT License or a pony or ISC License")[0] == "mit; isc" and told("MIT License with the Apache License")[0] == "mit; apache-2.0"
    assert told("the linking exception, all rights reserved, public domain") == ("", None)
    assert told("((MIT License or ISC License")[0] == "mit isc or" and told("or MIT License) and")[0] == "mit"
    assert told("MIT License. " * 3) == ("mit", True)


def test_notices_equal_their_tags():
    """Random expressions, once as identifiers and once in words, are the same expression."""
    rng = random.Random(12)
    words = {"MIT": "the MIT License", "ISC": "the ISC license", "Apache-2.0": "the Apache License, Version 2.0", "MPL-2.0": "the terms of the Mozilla Public License 2.0", "GPL-3.0-only": "the GNU General Public License version 3 only"}
    for _ in range(200):
        tag = re.sub(r"\b[pqrs]\b", lambda m: rng.choice(list(words)), build(rng, 3))
        prose = re.sub(r"[A-Z][A-Za-z0-9.-]+", lambda m: words[m[0]], tag)
        assert licenses.Scanner()(f"Released under {prose}.").noticed == licenses.Scanner()(f"SPDX-License-Identifier: {tag}").tagged != []


def test_very_long_notices():
    import time

    began = time.time()
    for text in ("MIT License and " * 20_000, "MIT License or (" * 20_000, "(MIT License " * 20_000, "(" * 100_000 + "MIT License"):
        assert licenses.Scanner()(text).labels == {"mit"}
    assert len(licenses.parse("MIT and " * 20_000 + "ISC").postfix) == 40_001
    assert time.time() - began < 30


# 9 Lines


def brute_deleted(docs, min_words):
    """Per document (in order) the lines that lie in a run of min_words or more that begins earlier, too."""
    lines = [t.split("\n") for t in docs]
    starts = [(d, i) for d in range(len(lines)) for i in range(len(lines[d]))]
    out = [set() for _ in docs]
    for n, (d, i) in enumerate(starts):
        best = 0
        for e, j in starts[:n]:
            k = 0
            while i + k < len(lines[d]) and j + k < len(lines[e]) and lines[d][i + k] == lines[e][j + k]:
                k += 1
            best = max(best, k)
        if sum(len(x.split()) for x in lines[d][i : i + best]) >= min_words:
            out[d] |= set(range(i, i + best))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["a b c", "d e", "", "f g h i j k", "l", "m n o p"]
    docs = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(25)]
    docs += [docs[3], docs[4], "a b c\n" * 12, "unique line here\n" + docs[5] + "\nanother", "f g h i j k\n" * 40]
    want = brute_deleted(docs, 6)
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame([(k, t, 3) for k, t in enumerate(docs)], "doc_id long, text string, deleted_lines int"), 6).collect()}
    for k, t in enumerate(docs):
        kept = [x for i, x in enumerate(t.split("\n")) if i not in want[k]]
        assert rows[k]["text"] == "\n".join(kept) and rows[k]["deleted_lines"] == len(want[k])


def test_lines_of_odd_tables(spark):
    line = " ".join(f"w{k}" for k in range(60))
    docs = documents(spark, [line, None, f"x\n{line}", *ODD, f"{line}\n{line}"])
    out = line_dedup.dedup_lines(docs.union(docs.filter("doc_id = 0")))
    rows = out.collect()
    assert out.columns == [*docs.columns, "deleted_lines"] and len(rows) == docs.count() + 1
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["text"] == line and by_id[2]["text"] == "x" and by_id[None]["text"] is None and by_id[len(ODD) + 3]["text"] == ""
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    assert line_dedup.shortest_runs(np.array([3, 0, 4, 2]), 5) == [(0, 3), (1, 3), (2, 2)]


# 10 Toxicity


def test_machine_learns_what_no_sum_of_weights_can():
    """Label 1 if exactly both or neither of two words are present: a sum of weights can't, a pair can."""
    rng = random.Random(12)
    rows = []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join([f"n{rng.randrange(40)}" for _ in range(4)] + ["insult"] * a + ["group"] * b)
        rows.append((text, int(a and b)))
    machine = toxicity.fit([(np.unique(np.array([h for w in toxicity.words_of(t) for h in toxicity.word_terms(w)], np.uint32)).tobytes(), y) for t, y in rows], epochs=300)
    scores = toxicity.Scorer(machine)(["insult", "group", "insult group", ""])
    assert scores[2] > 0.8 and max(scores[0], scores[1], scores[3]) < 0.5
    single = toxicity.Machine(machine.terms, machine.bias, machine.weights, machine.vectors * 0)
    assert toxicity.Scorer(single)(["insult group"])[0] < scores[2]


def brute_score(machine, text):
    """Bias, weights of the present terms and the products of the vectors of all pairs of them."""
    place = {int(h): k for k, h in enumerate(machine.terms)}
    own = sorted({place[h] for w in toxicity.words_of(text) for h in toxicity.word_terms(w) if h in place})
    raw = machine.bias + sum(machine.weights[k] for k in own) + sum(float(machine.vectors[a] @ machine.vectors[b]) for i, a in enumerate(own) for b in own[:i])
    return 1 / (1 + math.exp(-raw))


def test_scores_equal_all_pairs():
    rng = np.random.default_rng(14)
    words = [f"word{k}x" for k in range(60)]
    terms = np.unique(np.array([h for w in words for h in toxicity.word_terms(w)], np.uint32))
    machine = toxicity.Machine(terms, -0.3, rng.normal(0, 0.3, len(terms)), rng.normal(0, 0.2, (len(terms), 4)))
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(50)] + ["", "unseen words only"]
    assert toxicity.Scorer(machine)(texts) == pytest.approx([brute_score(machine, t) for t in texts])


def test_all_terms_of_long_texts_are_counted(spark):
    """Telling words anywhere in texts of 30,000 words, against all counts on the driver."""
    rng = random.Random(13)
    texts, marks = [], []
    for k in range(60):
        words = [f"{'r' if rng.random() < 0.5 else 'q'}{rng.randrange(60_000)}" for _ in range(30_000 if k < 6 else 40)]
        marks.append(k % 2)
        words.insert(rng.randrange(len(words)), "shouting" if k % 2 else "talking")
        texts.append(" ".join(words))
    docs, labels = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(k, 1, y) for k, y in enumerate(marks)], "doc_id long, quality int, toxic int")
    sets = [{h for w in toxicity.words_of(t) for h in toxicity.word_terms(w)} for t in texts]
    assert max(map(len, sets)) > 20_000
    n, a = Counter(h for t in sets for h in t), Counter(h for t, y in zip(sets, marks) if y for h in t)
    chosen = {h for h in n if n[h] >= 3 and (a[h] - n[h] / 2) ** 2 / (n[h] / 4) > toxicity.CHI}
    rows = toxicity.labelled_terms(docs, labels, F.lit(True), 100)
    assert {h for w in ("shouting", "talking") for h in toxicity.word_terms(w)} <= chosen
    assert {h for t, _ in rows for h in np.frombuffer(t, np.uint32).tolist()} == chosen
    assert sorted(rows) == sorted((np.array(sorted(s & chosen), np.uint32).tobytes(), y) for s, y in zip(sets, marks))



def test_training_takes_one_text_of_each_id(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text")).unionAll(spark.createDataFrame([(2, " ".join(f"w{k}" for k in range(40_000))), (3, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 0), (3, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.labelled_terms(docs, labels, F.lit(True), 10)
    assert sorted(y for _, y in rows) == [0, 0, 1]
    assert rows == toxicity.labelled_terms(docs.repartition(7), labels, F.lit(True), 10)
    one = toxicity.fit([(t, 1) for t, _ in rows])
    assert toxicity.Scorer(one)(["x", ""])[0] > 0.9


def test_scores_of_whole_tables(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choice("the of and in sun moon tree".split()) for _ in range(20)) + (" scumword" if k % 4 == 0 else "") for k in range(200)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)] + [(None, 1, 1), (5, 1, None), (900, 0, 1)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    machine = toxicity.train(docs, labels, ~held)
    rows = toxicity.score(documents(spark, texts + ODD), machine).collect()
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 200 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in test]) > 0.95
    kept = toxicity.drop_toxic(docs, machine)
    assert kept.columns == docs.columns and all(r["doc_id"] is None or r["doc_id"] % 4 for r in kept.collect()) and kept.count() == 150
    assert toxicity.score(empty(spark), machine).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.Scorer(none)(["x"])[0] == pytest.approx(0.5)
