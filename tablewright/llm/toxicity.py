"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its hashed terms: lower-cased words and, for families
of inflected forms, the words' first four and five letters. Besides a weight
per term the machine has a short vector per term, and the dot products of
the vectors of all pairs of present terms add to the score: an insult that
stands with the mention of a group can weigh more than the two alone, which a
sum of single weights can't say.

The model is fitted in numpy on at most ``max_rows`` labelled documents (the
least by a hash of doc_id). All terms of their whole texts are counted by Spark,
which picks those that tell the classes apart, at most ``max_terms``; only the
picked ones of each document come to the driver. Everything else, scoring
included, runs in tasks over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, kept_rows, sliced, text_or_empty

WORD = re.compile(r"[^\W_]+")
BITS = 22
MAX_ROWS = 8_000
MAX_TERMS = 8_192
CHI = 20.0  # a chance of about 1e-5, one term of the 1e5 that are tried
THRESHOLD = 0.7
CACHED = 32_768


@dataclass(frozen=True)
class Machine:
    """terms: sorted kept hashes; weights, vectors: one row per kept term."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: for each document the places of its present terms in ``terms``."""
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        raw = np.full(len(rows), self.bias)
        if sizes.sum():
            at = np.concatenate(rows)
            row = np.repeat(np.arange(len(rows)), sizes)
            raw += np.bincount(row, self.weights[at], len(rows))
            for v in self.vectors.T:
                raw += (np.bincount(row, v[at], len(rows)) ** 2 - np.bincount(row, v[at] ** 2, len(rows))) / 2
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word and of its first letters."""
    parts = [f"w:{word}"] + [f"{n}:{word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "replace")) >> (32 - BITS) for p in parts)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def telling_terms(rows: DataFrame, max_terms: int = MAX_TERMS) -> np.ndarray:
    """Of rows (terms binary, toxic int), the max_terms terms with the largest chi-square against toxic, CHI at least, in three rows at least; ties by the term. None without rows of both classes.

    A task adds its rows up in two dense counters, so it shuffles a term once.
    """
    size = rows.agg(F.count("toxic").alias("n"), F.avg("toxic").alias("positive")).first()
    if not size["n"] or size["positive"] in (0, 1):
        return np.zeros(0, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for terms, toxic in zip(batch.column("terms").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic, np.frombuffer(terms, np.uint32)] += 1  # a row's terms differ
        found = np.flatnonzero(counts[0] + counts[1])
        for at in range(0, len(found), 65_536):
            part = found[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part].astype(np.int64)), pa.array(counts[1, part].astype(np.int64))], ["term", "clean", "toxic"])

    counted = rows.mapInArrow(run, "term int, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, p = F.col("clean") + F.col("toxic"), size["positive"]
    chi = (F.col("toxic") - n * p) * (F.col("toxic") - n * p) / (n * (p * (1 - p)))
    best = counted.filter(n >= 3).select("term", chi.alias("chi")).filter(F.col("chi") > CHI).orderBy(F.desc("chi"), "term").limit(max_terms)
    return np.sort(np.array([r["term"] for r in best.collect()], dtype=np.uint32))


def labelled_terms(docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, seed: int = 7) -> list[tuple[bytes, int]]:
    """The telling terms (hashes) and the label of at most max_rows documents that have a label and satisfy allowed. Of several texts under one doc_id the one of the least hash counts; of several labels, 1."""
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(allowed)
    few = checkpoint(marks.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(max_rows))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", F.col("toxic").cast("int").alias("toxic"))

    def all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            terms = [np.unique(np.array([h for w in words_of(t) for h in word_terms(w)], dtype=np.uint32)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), batch.column("toxic")], ["terms", "toxic"])

    rows = checkpoint(texts.mapInArrow(all_terms, "terms binary, toxic int"))
    kept = telling_terms(rows, max_terms)  # max_terms at most

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.intersect1d(np.frombuffer(t, np.uint32), kept, assume_unique=True).tobytes() for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), batch.column("toxic")], ["terms", "toxic"])

    found = rows.mapInArrow(telling, "terms binary, toxic int").toArrow()
    out = sorted(zip(found.column("terms").to_pylist(), found.column("toxic").to_pylist()))
    del found
    pa.default_memory_pool().release_unused()
    return out


def fit(rows: list[tuple[bytes, int]], max_terms: int = MAX_TERMS, rank: int = 4, epochs: int = 150, rate: float = 0.05, decay: float = 1e-3, seed: int = 11) -> Machine:
    """Logistic loss, Adam over the whole sample. Terms: the max_terms with the largest chi-square against the label, CHI at least, in three rows at least. One class only, or no rows: a constant score, that of the class (0.5 without rows)."""
    y = np.array([x[1] for x in rows], dtype=np.float64)
    positive = y.mean() if len(y) else 0.5
    bias = float(np.log((positive + 0.01) / (1 - positive + 0.01)))
    empty = Machine(np.zeros(0, np.uint32), bias, np.zeros(0), np.zeros((0, rank)))
    if not len(y) or positive in (0, 1):
        return empty
    terms = [np.frombuffer(x[0], np.uint32) for x in rows]
    sizes = np.array([len(t) for t in terms])
    flat, row = np.concatenate(terms), np.repeat(np.arange(len(rows)), sizes)
    present, at = np.unique(flat, return_inverse=True)
    n = np.bincount(at, minlength=len(present)).astype(np.float64)
    a = np.bincount(at, y[row], len(present))
    chi = np.where(n >= 3, (a - n * positive) ** 2 / (n * positive * (1 - positive)), 0)
    best = np.sort(np.argsort(-chi, kind="stable")[:max_terms])
    best = best[chi[best] > CHI]
    if not len(best):
        return empty
    kept = present[best]
    place = np.full(len(present), -1, np.int32)
    place[best] = np.arange(len(best))
    at = place[at]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    by_row, by_term, n_rows, n_terms = row[order], at[order], len(rows), len(kept)
    rng = np.random.default_rng(seed)
    params = [np.array([bias]), np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, rank))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    balance = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive)) ** 0.5
    for step in range(1, epochs + 1):
        b, w, v = params
        sums = np.stack([np.bincount(row, v[at, f], n_rows) for f in range(rank)], axis=1)
        squares = np.bincount(row, (v * v).sum(axis=1)[at], n_rows)
        raw = b[0] + np.bincount(row, w[at], n_rows) + ((sums * sums).sum(axis=1) - squares) / 2
        error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y) * balance / n_rows
        per = error[by_row]
        gw = np.bincount(by_term, per, n_terms)
        gv = np.stack([np.bincount(by_term, per * sums[by_row, f], n_terms) for f in range(rank)], axis=1) - gw[:, None] * v
        for i, g in enumerate((np.array([error.sum()]), gw + decay * w / n_rows, gv + decay * v / n_rows)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(kept, float(params[0][0]), params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, max_rows: int = MAX_ROWS) -> Machine:
    return fit(labelled_terms(docs, labels, F.lit(True) if allowed is None else allowed, max_rows))


class Scorer:
    """Scores texts; remembers the places of a bounded number of words."""

    def __init__(self, machine: Machine):
        self.machine, self.seen = machine, {}
        self.place = {int(h): k for k, h in enumerate(machine.terms)}

    def places(self, text: str) -> np.ndarray:
        found: set[int] = set()
        for word in words_of(text):
            own = self.seen.get(word)
            if own is None:
                own = tuple(self.place[h] for h in word_terms(word) if h in self.place)
                if len(self.seen) >= CACHED:
                    self.seen.clear()
                self.seen[word] = own
            found.update(own)
        return np.fromiter(found, np.int64, len(found))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.machine.score([self.places(t or "") for t in texts])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per row of docs: doc_id, score. Null and empty texts get the score of no terms; repeated rows equal scores; other columns are not carried."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most MAX_TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text").to_pylist()))], ["doc_id", "score"])

    slim = docs.select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches threshold; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array(scorer(batch.column("text").to_pylist()) < threshold))

    return kept_rows(docs, run)
