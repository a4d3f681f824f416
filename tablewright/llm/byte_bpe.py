"""Byte-level byte-pair encoding and decoding by a ranked fold over words.

A word's bytes are an array of one-character pieces (a byte is the character of
its number, so that pieces can be joined and looked up as strings). Spark's
higher-order functions fold over it: each step joins the neighbours whose joint
piece has the least rank, the first of equals, until none has one. Ranks are a
literal of the plan: an array of small maps, dealt by the piece's checksum, so
that a look-up reads one short map. A word that has a rank itself is that id.

The fold runs once for each of the ``KNOWN`` most frequent distinct words of
the corpus (all are counted), whose ids are sent to the tasks. A word that isn't
among them is put together from the beginning of one and the end of another
(``joined``) where it is known from yet another that the fold leaves the seam;
the other words are folded where they stand, so nothing is shuffled but words
and their counts, whatever the size of the vocabulary that a corpus has. The
fold is quadratic in a word's length: words of more than ``FOLDED`` bytes are
merged in the same order by a heap of ranks instead.

Decoding looks the ids' pieces up in a literal array and joins them.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, sliced, text_or_empty

RANKS = "byte_bpe_50k.tiktoken"
BUCKETS = 65_536
KNOWN = 262_144
FOLDED = 64
CUTS = 2 * KNOWN
NONE = 2**31 - 1


@lru_cache(maxsize=2)
def ranks_of(name: str) -> dict[bytes, int]:
    """name: a file of public_tokenizers, or a path."""
    import public_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _rank_literal(name: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks_of(name).items():
        text = piece.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return json.dumps(buckets, separators=(",", ":"))


def with_ranks(use: Callable[[Column], Column], ranks: str = RANKS) -> Column:
    """What use makes of the literal rank map, which so stands in the plan once however often use looks into it."""
    literal = F.from_json(F.lit(_rank_literal(ranks)), "array<map<string,int>>")
    return F.get(F.transform(F.array(literal), use), 0)


def rank(piece: Column, table: Column) -> Column:
    """The rank of a piece of one character a byte, or null."""
    return F.try_element_at(F.get(table, F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int")), piece)


def fold(word: Column, table: Column) -> Column:
    """The ids of a word, by ranked merges; a null or empty word has none."""
    piece = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    none = F.array().cast("array<int>")
    known = lambda x: F.coalesce(rank(x, table), F.lit(NONE))

    def join(state: Column) -> Column:
        """state after the neighbours whose joint piece has the least rank are one piece."""
        pieces, joint = state["pieces"], state["joint"]
        at, n = F.array_position(joint, F.array_min(joint)).cast("int"), F.size(pieces)

        def around(at: Column) -> Column:
            merged = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
            left = F.when(at > 1, F.array(known(F.concat(F.get(pieces, at - 2), merged)))).otherwise(none)
            right = F.when(at < n - 1, F.array(known(F.concat(merged, F.get(pieces, at + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(pieces, 1, at - 1), F.array(merged), F.slice(pieces, at + 2, n)).alias("pieces"),
                F.concat(F.slice(joint, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(joint, at + 2, n)).alias("joint"),
            )

        return F.get(F.transform(F.array(at), around), 0)

    def of_pieces(chars: Column) -> Column:
        places = F.when(F.size(chars) > 1, F.sequence(F.lit(1), F.size(chars) - 1)).otherwise(none)
        joint = F.transform(places, lambda i: known(F.concat(F.get(chars, i - 1), F.get(chars, i))))
        start = F.struct(chars.alias("pieces"), joint.alias("joint"))
        done = lambda s: F.coalesce(F.array_min(s["joint"]), F.lit(NONE)) == NONE
        return F.aggregate(places, start, lambda s, _: F.when(done(s), s).otherwise(join(s)), lambda s: F.transform(s["pieces"], lambda p: rank(p, table)))

    merged = F.get(F.transform(F.array(F.split(piece, "")), of_pieces), 0)
    whole = F.transform(F.array(rank(piece, table)), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(merged))
    return F.when(word.isNull() | (word == ""), none).otherwise(F.get(whole, 0))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length: the least rank first, of equals the leftmost, by a heap over a linked list of pieces."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, after, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        other = after[k] if live[k] else n
        if other >= n or end[other] != stop:
            continue  # one of the two has been merged since
        live[other] = False
        end[k], after[k] = stop, after[other]
        if after[k] < n:
            before[after[k]] = k
            if (r := ranks.get(word[k : end[after[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
        if (b := before[k]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    return [ranks[word[k : end[k]]] for k in range(n) if live[k]]


def frequent_words(docs: DataFrame, known: int = KNOWN, ranks: str = RANKS) -> dict[str, bytes]:
    """The most frequent words of docs, at most known of them, with their folded ids as little-endian 32-bit integers.

    Words are counted over all documents. Those from the least number of
    occurrences on that leaves at most known of them are taken, so nothing is
    sorted; occurrences are told apart by eighths of their logarithm.
    """
    spark = docs.sparkSession
    words = docs.select(F.explode(F.regexp_extract_all(text_or_empty(), F.lit("(?U)" + pattern()), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.octet_length("word") <= FOLDED))
    counted = checkpoint(counted.select("word", F.floor(F.log2("n") * 8).cast("int").alias("level")))
    least, total = NONE, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most eight a bit of a long
        total += r["count"]
        if total > known:
            break
        least = r["level"]
    top = counted.filter(F.col("level") >= least).repartition(2 * spark.sparkContext.defaultParallelism, "word")
    found = top.select("word", with_ranks(lambda t: fold(F.col("word"), t), ranks).alias("ids")).toArrow()
    ids = found.column("ids").combine_chunks()
    edges, values = ids.offsets.to_numpy() * 4, ids.values.to_numpy().astype("<i4").tobytes()
    return {w: values[a:b] for w, a, b in zip(found.column("word").to_pylist(), edges[:-1].tolist(), edges[1:].tolist())}


def cuts(known: dict[str, bytes], ranks: dict[bytes, int], most: int = CUTS) -> tuple[dict[bytes, bytes], dict[bytes, bytes], set[bytes]]:
    """The beginnings and ends of folded words, cut between two of their pieces, with their ids; and all two ids side by side in a word.

    The fold of such a part is the part of the fold: what it merges in the word
    on one side of a place that is never merged across doesn't depend on the
    other side. Words of one id are left out, as they may be ids without any
    merge. There are some most parts, so that words of many pieces don't fill
    the memory; words that lack one are folded.
    """
    sizes = {k: len(piece) for piece, k in ranks.items()}
    heads, tails, seams = {}, {}, set()
    for word, ids in known.items():
        if len(heads) + len(tails) >= most:
            break
        if len(ids) > 4:
            raw, at = word.encode(), 0
            for k, own in enumerate(np.frombuffer(ids, "<i4")[:-1].tolist(), 1):
                at += sizes[own]
                heads.setdefault(raw[:at], ids[: 4 * k])
                tails.setdefault(raw[at:], ids[4 * k :])
                seams.add(ids[4 * k - 4 : 4 * k + 4])
    return heads, tails, seams


def joined(word: bytes, heads: dict[bytes, bytes], tails: dict[bytes, bytes], seams: set[bytes]) -> bytes | None:
    """The ids of a word without a rank of its own, from a head and a tail whose ids at the seam are known to stay apart; None if there are no such two.

    The first merge across a seam would be of pieces within the two ids beside
    it, at a time when it has the least rank of all. Merges within the two ids
    come in the same order in every word that holds them, so it would come in
    the word, too, that the seam is known from.
    """
    for at in range(len(word) - 1, 0, -1):
        head = heads.get(word[:at])
        if head is not None:
            tail = tails.get(word[at:])
            if tail is not None and head[-4:] + tail[:4] in seams:
                return head + tail
    return None


def encode(docs: DataFrame, known: int = KNOWN, ranks: str = RANKS) -> DataFrame:
    """docs with ids (array<int>), the tokens of text without special ones.

    Null and empty texts have no ids. Every row of docs has one row, repeated
    ones too; no rows: no rows. All other columns are kept; one named ids is
    replaced.
    """
    import regex

    spark = docs.sparkSession
    folded = frequent_words(docs, known, ranks)
    shared = spark.sparkContext.broadcast((folded, *cuts(folded, ranks_of(ranks))))  # of at most known words of at most FOLDED bytes
    rows = docs.drop("ids")
    own, parts = fresh(rows, "words_text"), fresh(rows, "words_parts")
    plain = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))]).withColumn("words_text", text_or_empty(f"c{rows.columns.index('text')}"))
    kept = [c for c in plain.columns if c != "words_text"]
    types = dict(plain.dtypes)
    split = pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (folded, *own_cuts) = regex.compile(split), shared.value
        known, table = folded.get, ranks_of(ranks)
        for batch in sliced(batches):
            counts, sizes, ids, missing = [0], [0], [], []
            for text in batch.column("words_text").to_pylist():
                found = words.findall(text)
                codes = [known(w) for w in found]
                start, lost = 0, [k for k, c in enumerate(codes) if c is None]
                for k in [*lost, len(codes)]:
                    own = b"".join(codes[start:k])
                    word = found[k] if k < len(codes) else None
                    if word is not None:
                        raw = word.encode()
                        if len(raw) > FOLDED:
                            more = np.array(merge(raw, table), "<i4").tobytes()
                        else:
                            more = None if raw in table else joined(raw, *own_cuts)
                        if more is not None:
                            own, word = own + more, None
                    ids.append(own)
                    sizes.append(len(own) // 4)
                    missing.append(word)
                    start = k + 1
                counts.append(len(lost) + 1)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            struct = pa.StructArray.from_arrays([inner, pa.array(missing, pa.string())], ["ids", "word"])
            outer = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), outer], [*kept, "words_parts"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", words_parts array<struct<ids:array<int>,word:string>>"
    done = plain.mapInArrow(run, schema).toDF(*rows.columns, parts)
    ids = F.flatten(with_ranks(lambda t: F.transform(parts, lambda p: F.when(p["word"].isNull(), p["ids"]).otherwise(F.concat(p["ids"], fold(p["word"], t)))), ranks))
    return done.select(*[F.col(f"`{c}`") for c in rows.columns], ids.alias("ids"))


@lru_cache(maxsize=2)
def _piece_literal(name: str) -> str:
    ranks = ranks_of(name)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, k in ranks.items():
        pieces[k] = piece.decode("latin-1")
    return json.dumps(pieces, separators=(",", ":"))


def decode(ids: Column, ranks: str = RANKS) -> Column:
    """The bytes that ids stand for, their pieces joined; null where an id is null or has no piece."""
    pieces = F.from_json(F.lit(_piece_literal(ranks)), "array<string>")
    least, most = (F.coalesce(of(ids), F.lit(0)) for of in (F.array_min, F.array_max))
    known = ~F.array_contains(ids, F.lit(-1)) & (least >= 0) & (most <= max(ranks_of(ranks).values()))  # null if an id is
    return F.when(known, F.encode(F.array_join(F.transform(ids, lambda k: F.get(pieces, k)), ""), "ISO-8859-1"))


def digest(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the decimal ids, joined by one space, and of the bytes they decode to."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))
