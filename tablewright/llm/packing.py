"""Documents to token pieces, and pieces packed into few sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths). Pieces come longest first; of the open sequences
that can take a piece under every capacity, the one with the least weighted
norm of what would be left gets it (or the largest weighted dot product of
piece and residual, as asked). The pieces are dealt by hash into shards of
about ``shard`` pieces that are packed apart, so no task sees more than a shard
and at most about one sequence per shard is left part-filled.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, sliced, text_or_empty

CAPACITY = 1024
END = 2
SHARD = 16_384
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str):
    """Ids as the tokenizers file gives them, by the faster library that reads the same vocabulary as ranks; the file's added tokens are found in texts as it finds them. Names are files of public_tokenizers, or paths."""
    import public_tokenizers
    import tiktoken

    path = lambda name: name if "/" in name else public_tokenizers.path(name)
    with open(path(ranks), "rb") as file:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    with open(path(tokenizer), encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in own.items() if v not in special.values()}, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    Null and empty texts are one piece with the end id. Rows repeated under one
    doc_id are cut apart, each with pieces from 0. Other columns are not carried.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in sliced(batches):
            row, piece, start, length, ids = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                tokens = np.array([*encode(text), end], dtype="<u4")
                for p, (s, n) in enumerate(cut(len(tokens), capacity)):
                    row.append(k), piece.append(p), start.append(s), length.append(n), ids.append(tokens[s : s + n].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. A piece that alone exceeds a capacity is an error."""
    lengths = np.asarray(lengths, dtype=np.int64)
    tokens, count, cost = capacities
    if len(lengths) and (lengths.max() > tokens or lengths.max() ** 2 > cost or count < 1):
        raise ValueError("a piece exceeds a sequence's capacity")
    scale, weight = np.array(capacities, dtype=float), np.array(weights, dtype=float)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, used, number = np.zeros((3, 256)), np.zeros(256, np.int64), np.zeros(256, np.int64)
    opened = live = 0
    most = 0.0  # no open bin has more tokens left
    for n, k in enumerate(order):
        size = int(lengths[k])
        need = np.array([size, 1.0, float(size) ** 2])
        at = -1
        if size <= most and live:
            fits = np.flatnonzero((left[0, :live] >= size) & (left[1, :live] >= 1) & (left[2, :live] >= need[2]))
            if len(fits):
                rest = left[:, fits]
                if by == "norm":
                    value = (weight[:, None] * ((rest - need[:, None]) / scale[:, None]) ** 2).sum(axis=0)
                else:
                    value = -((weight * need / scale)[:, None] * rest / scale[:, None]).sum(axis=0)
                at = int(fits[np.argmin(value)])
            else:
                most = size - 1.0 if not (left[0, :live] >= size).any() else most
        if at < 0:
            if live == left.shape[1]:
                open_ = np.flatnonzero((left[0, :live] >= least) & (left[1, :live] >= 1))
                room = max(256, 2 * len(open_))
                grown = np.zeros((3, room))
                grown[:, : len(open_)] = left[:, open_]
                left, used, number = grown, np.pad(used[open_], (0, room - len(open_))), np.pad(number[open_], (0, room - len(open_)))
                live = len(open_)
            at, live = live, live + 1
            left[:, at], used[at], number[at] = capacities, 0, opened
            opened += 1
            most = max(most, tokens - size)
        bins[k], offsets[k] = number[at], used[at]
        left[:, at] -= need
        used[at] += size
    return bins, offsets


def pack(lengths: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: float | None = None, shard: int = SHARD, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), by: str = "norm") -> DataFrame:
    """lengths with sequence_id (long) and offset (long) for each row, whose column length is from 1 to capacity; a null length is an error.

    Without max_docs and max_cost these capacities can't bind: a sequence of
    full tokens meets them. The rows are written to the shared checkpoint
    folder first, so that what made them runs once and counts them.
    Repeated rows are packed apart. No rows: no rows. All other columns are
    kept; columns named sequence_id or offset are replaced.
    """
    limits = (float(capacity), float(max_docs or capacity), float(max_cost or capacity**2))
    rows = checkpoint(lengths.drop("sequence_id", "offset"))
    n = max(1, -(-rows.count() // shard))
    own = fresh(rows, "shard")
    dealt = rows.withColumn(own, F.pmod(F.xxhash64(*[F.col(c) for c, t in rows.dtypes if not t.startswith("map")], F.monotonically_increasing_id()), F.lit(n)))

    def run(group: pa.Table) -> pa.Table:
        bins, offsets = best_fit(group.column("length").to_numpy(), limits, weights, by)
        bins += group.column(own)[0].as_py() << 32
        return group.drop_columns([own]).append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy(own).applyInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<long>, documents) from placed pieces that carry ids; a sequence's rows meet in one task, at most its capacity of tokens."""
    pairs = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int64).tolist() for row in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(tokens, pa.list_(pa.int64())), batch.column("documents")], ["sequence_id", "ids", "documents"])

    grouped = placed.groupBy("sequence_id").agg(pairs.alias("p")).select("sequence_id", "p", F.col("p.doc_id").alias("documents"))
    return grouped.mapInArrow(ids, f"sequence_id long, ids array<long>, documents {grouped.schema['documents'].dataType.simpleString()}")
