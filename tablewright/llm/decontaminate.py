"""Benchmark passages inside documents, by the q-gram lemma and banded alignment.

Texts are lower-cased and runs of blanks become one space. An item of m
characters may differ from a region of a document by at most k edits
(insertions, deletions, substitutions): ``budget`` of m, and less for short
items so that the lemma still says something. If it does, the item and the
region share at least m - q + 1 - kq places of equal character q-grams whose
diagonals (place in the document less place in the item) span at most k. So
shared q-grams are counted in diagonal bands of width 2(k + 1), each
overlapping the next by half, and only regions whose count meets the bound are
aligned, in a band about their diagonals. Items too short for a q-gram match
exactly or not at all.

The benchmark is read in parts of bounded size and each part is sent to the
tasks, whole documents are scanned; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, kept_rows, sliced, text_or_empty

Q = 12
BUDGET = 0.06
PART_CHARS = 4_000_000
LISTED = 1 << 20
TABLE_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit polynomial of each q consecutive character codes."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = codes[: len(codes) - q + 1].astype(np.uint64)
        for k in range(1, q):
            total *= _BASE
            total += codes[k : len(codes) - q + 1 + k]
        return total * _MIX


def edit_budget(m: int, budget: float = BUDGET, q: int = Q) -> int:
    """Edits allowed for m characters: the share asked for, less where the lemma's bound would fall under 1."""
    return max(0, min(int(budget * m), (m - q) // q))


@dataclass(frozen=True)
class Items:
    """ids and normalized texts of benchmark items; keys: sorted q-gram values, with item and place of each; seen: a bit table of the keys; short: items without a q-gram."""

    ids: pa.Array
    texts: list[str]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    short: list[int]
    lengths: np.ndarray


def index(ids: pa.Array, texts: list[str | None], q: int = Q) -> Items:
    """Items without text after normalization match nothing and are left out; of items with equal text each is kept."""
    both = [(i, n) for i, t in enumerate(texts) if (n := normalize(t))]
    parts = [grams(_codes(t), q) for _, t in both]
    keys = np.concatenate([np.zeros(0, np.uint64), *parts])
    item = np.repeat(np.arange(len(both)), [len(p) for p in parts])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in parts)])
    order = np.argsort(keys, kind="stable")
    seen = np.zeros(1 << TABLE_BITS, bool)
    seen[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    own = ids.take(pa.array([i for i, _ in both], pa.int64()))
    return Items(own, [t for _, t in both], keys[order], item[order], place[order], seen, [k for k, (_, t) in enumerate(both) if len(t) < q], np.array([len(t) for _, t in both], np.int64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def align(item: str, region: str, diagonal: int, width: int) -> tuple[int, int, int]:
    """Least edits between item and a part of region, over paths whose diagonal is at most width from the given one; (edits, start, end)."""
    a, b = _codes(item).astype(np.int64), _codes(region).astype(np.int64)
    m, n, size = len(a), len(b), 2 * width + 1
    big = m + n + 1
    offsets = diagonal - width + np.arange(size)
    cols = offsets  # column of row 0 in each diagonal
    cost = np.where((cols >= 0) & (cols <= n), 0, big)
    start = np.clip(cols, 0, n)
    for i in range(1, m + 1):
        cols = offsets + i
        inside = (cols >= 1) & (cols <= n)
        hit = np.zeros(size, bool)
        hit[inside] = b[cols[inside] - 1] == a[i - 1]
        best, origin = np.where(inside, cost + ~hit, big), start.copy()
        up = np.append(cost[1:], big) + 1  # a letter of the item is missing
        better = (up < best) & (cols >= 0) & (cols <= n)
        best, origin = np.where(better, up, best), np.where(better, np.append(start[1:], 0), origin)
        # A letter of the region more: from the left within the row; the least of best[j] - j so far.
        shifted = best - np.arange(size)
        run = np.minimum.accumulate(shifted)
        since = np.maximum.accumulate(np.where(shifted == run, np.arange(size), 0))
        left = run + np.arange(size)
        better = (left < best) & (cols >= 0) & (cols <= n)
        start, cost = np.where(better, origin[since], origin), np.where(better, left, best)
    k = int(np.argmin(cost))
    return int(min(cost[k], big)), int(start[k]), int(np.clip(offsets[k] + m, 0, n))


def _added(item: np.ndarray, step: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (item, step) with their numbers added up."""
    order = np.lexsort((step, item))
    item, step = item[order], step[order]
    first = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (step[1:] != step[:-1])]) if len(item) else np.zeros(0, np.int64)
    return item[first], step[first], np.add.reduceat(number[order], first) if len(first) else number


def _counted(values: np.ndarray, at: np.ndarray, items: Items, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, step, number): how many of the document's q-grams (values, at their places) equal one of item on a diagonal in step; steps are half an item's band wide.

    Pairs of places are listed at most ``LISTED`` at a time. Where a value is so
    frequent in both texts that its pairs alone are more, they are counted by a
    correlation of its places instead, so that memory and time follow the texts'
    lengths and not their product.
    """
    low = np.searchsorted(items.keys, values, "left")
    count = np.searchsorted(items.keys, values, "right") - low
    hit = count > 0
    values, at, low, count = values[hit], at[hit], low[hit], count[hit]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    _, first, of, times = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    often = times * count[first] > LISTED
    for v in np.flatnonzero(often):
        places, rows = at[of == v], slice(int(low[first[v]]), int(low[first[v]] + count[first[v]]))
        for k in np.unique(items.item[rows]).tolist():
            own = items.place[rows][items.item[rows] == k]
            n, m = int(places[-1]) + 1, int(own.max()) + 1
            size = 1 << (n + m).bit_length()
            here, there = np.bincount(places, minlength=size), np.bincount(m - 1 - own, minlength=size)
            both = np.rint(np.fft.irfft(np.fft.rfft(here) * np.fft.rfft(there), size)[: n + m - 1]).astype(np.int64)
            diagonal = np.flatnonzero(both)
            parts.append((np.full(len(diagonal), k), (diagonal - (m - 1)) // half[k], both[diagonal]))
    rare = ~often[of]
    at, low, count = at[rare], low[rare], count[rare]
    ends = np.cumsum(count)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LISTED, "right")))
        n = count[begin:end]
        pick = np.repeat(low[begin:end] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item = items.item[pick]
        step = (np.repeat(at[begin:end], n) - items.place[pick]) // half[item]
        parts.append(_added(item, step, np.ones(len(item), np.int64)))
        begin = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return parts[0] if len(parts) == 1 else _added(*(np.concatenate(x) for x in zip(*parts)))


def find(text: str | None, items: Items, budget: float = BUDGET, q: int = Q) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) of the best match of each item in the normalized text, by item; of equally good ones the first."""
    doc = normalize(text)
    out: dict[int, tuple[int, int, int]] = {}
    for k in items.short:
        if (at := doc.find(items.texts[k])) >= 0:
            out[k] = (0, at, at + len(items.texts[k]))
    values = grams(_codes(doc), q)
    at = np.flatnonzero(items.seen[(values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]) if len(values) else np.zeros(0, np.int64)
    if len(at):
        edits = np.maximum(0, np.minimum((budget * items.lengths).astype(np.int64), (items.lengths - q) // q))
        item, step, number = _counted(values[at], at, items, edits + 1)
        need = items.lengths - q + 1 - edits * q
        regions: dict[int, set[int]] = {}
        for shift in (0, 1):  # two steps in turn make a band
            own, band, total = _added(item, (step - shift) // 2, number)
            for k, b in zip(*(x[total >= need[own]].tolist() for x in (own, band))):
                regions.setdefault(k, set()).add((2 * b + 1 + shift) * int(edits[k] + 1))
        for k, middles in regions.items():
            own, most = items.texts[k], int(edits[k])
            for middle in sorted(middles):
                begin = max(0, middle - 3 * (most + 1))
                region = doc[begin : middle + 3 * (most + 1) + len(own)]
                if (found := region.find(own)) >= 0:
                    cost, start, end = 0, found, found + len(own)
                else:
                    cost, start, end = align(own, region, middle - begin, 2 * (most + 1))
                if cost <= most and (k not in out or (cost, begin + start) < out[k][:2]):
                    out[k] = (cost, begin + start, begin + end)
                if not cost:
                    break  # none is better, and none before it as good
    return [(k, *out[k]) for k in sorted(out)]


def parts(benchmark: DataFrame, part_chars: int = PART_CHARS) -> Iterator[Items]:
    """The benchmark as indexes of about part_chars characters each, so that what a task holds is bounded however large the benchmark is."""
    slim = benchmark.select("item_id", text_or_empty().alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // part_chars))
    for k in range(n):
        own = slim.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield index(own.column("item_id").combine_chunks(), own.column("text").to_pylist())


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """One row per document row and benchmark item it holds: doc_id, item_id, edits, start, finish (places in the normalized text).

    Null and empty texts and items match nothing; an item repeated under one
    id gives a row each; an empty benchmark or no documents: no rows. Other
    columns are not carried.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, edits int, start long, finish long"
    result = None
    for items in parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in sliced(batches):
                rows = [(k, *hit) for k, t in enumerate(batch.column("text").to_pylist()) for hit in find(t, items, budget)]
                at, item, edits, start, finish = (pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), items.ids.take(item), edits, start, finish], ["doc_id", "item_id", "edits", "start", "finish"])

        own = slim.mapInArrow(run, schema)
        result = own if result is None else result.union(own)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns as they were. What a part of the benchmark leaves is written before the next, so a task holds one part's index."""
    left = None
    for items in parts(benchmark):
        left = docs if left is None else checkpoint(left)
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                yield batch.filter(pa.array([not find(t, shared.value, budget) for t in batch.column("text").to_pylist()], pa.bool_()))

        left = kept_rows(left, run)
    return left
