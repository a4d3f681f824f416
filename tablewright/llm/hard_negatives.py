"""Hard negatives by bit-sliced integer products.

Vectors become integers, and a block of them its bit planes, packed eight
components to a byte. A block of anchors meets a block of rows: planes are
taken from the most significant on, so that after each the score of a pair lies
in an interval that the planes left can move it in, half as wide as before. A
pair goes on only while its interval can still qualify: as one of the best
positives against those that are surely as good, or in the window of scores
that some positive of the anchor asks for. While most pairs of a tile are left
a plane is one matrix product; once few are, only those are carried on.

Positives come first, since they say which scores a negative may have. Both
passes join blocks, not rows: every anchor is held against every row, as asked,
and a pair of blocks returns no more than the few best of each anchor, from
which a window takes the best of all. A block holds at most ``ROWS`` rows or
``ANCHORS`` anchors, so no task's memory grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions

SCALE = 256
MOST = 2**20  # integers up to this give exact products in double precision
ROWS = 65_536
ANCHORS = 16_384
LEAST_ROWS = 4_096
LEAST_ANCHORS = 256
TILE = 256  # anchors at a time
WIDTH = 4_096  # rows at a time
SPARSE = 16  # a tile goes on pair by pair once one in so many is left


@dataclass(frozen=True)
class Planes:
    """The bit planes of integer vectors in two's complement, the least significant first."""

    planes: np.ndarray  # (bits, rows, bytes)
    width: int

    @staticmethod
    def of(vectors: np.ndarray) -> Planes:
        most = int(max(vectors.max(initial=0), ~vectors.min(initial=0)))
        bits = most.bit_length() + 1
        return Planes(np.stack([np.packbits((vectors >> p & 1).astype(np.uint8), axis=1) for p in range(bits)]), vectors.shape[1])

    def weight(self, p: int) -> int:
        return -(1 << p) if p == len(self.planes) - 1 else 1 << p

    def bits(self, p: int, rows: np.ndarray | slice) -> np.ndarray:
        return np.unpackbits(self.planes[p, rows], axis=1, count=self.width)


def _kth(values: np.ndarray, rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th greatest of the values of each of n rows, or minus infinity."""
    out = np.full(n, -np.inf)
    order = np.lexsort((-values, rows))
    rows, values = rows[order], values[order]
    first = np.searchsorted(rows, np.arange(n))
    last = np.searchsorted(rows, np.arange(n), "right")
    has = last - first >= k
    out[has] = values[first[has] + k - 1]
    return out


class Best:
    """The k best (score, id) of each of n wishes, the better score first and of equals the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.wish, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)  # what a score must reach

    def add(self, wish: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        if not len(wish):
            return
        wish, score, id = np.r_[self.wish, wish], np.r_[self.score, score], np.r_[self.id, id]
        order = np.lexsort((id, -score, wish))
        wish, score, id = wish[order], score[order], id[order]
        place = np.arange(len(wish)) - np.searchsorted(wish, wish)
        keep = place < self.k
        self.wish, self.score, self.id = wish[keep], score[keep], id[keep]
        full = place == self.k - 1
        self.least[wish[full]] = score[full]


class Positives:
    """The k best pairs of each anchor among those allowed."""

    def __init__(self, anchors: int, k: int) -> None:
        self.best = Best(anchors, k)

    def dense(self, tile: slice, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return alive & (high >= self.best.least[tile, None])

    def sparse(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n = len(self.best.least)
        return high >= np.maximum(self.best.least, _kth(low, rows, n, self.best.k))[rows]

    def take(self, rows: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        self.best.add(rows, score, id)


class Negatives:
    """The k best pairs of each anchor in each of its windows; window (anchor, its score's floor and ceiling), sorted by anchor."""

    def __init__(self, anchors: int, anchor: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int) -> None:
        self.anchor, self.floor, self.ceiling = anchor, floor.astype(float), ceiling.astype(float)
        self.best = Best(len(anchor), k)
        self.first = np.searchsorted(anchor, np.arange(anchors))
        self.count = np.searchsorted(anchor, np.arange(anchors), "right") - self.first
        self.most = int(self.count.max(initial=0))
        self.highest = np.full(anchors, -np.inf)
        np.maximum.at(self.highest, anchor, self.ceiling)

    def dense(self, tile: slice, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        lowest = np.full(len(self.count), np.inf)
        np.minimum.at(lowest, self.anchor, np.maximum(self.floor, self.best.least))
        return alive & (high >= lowest[tile, None]) & (low <= self.highest[tile, None])

    def _pairs(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places among rows, their windows), one window of each anchor at a time."""
        for k in range(self.most):
            has = np.flatnonzero(self.count[rows] > k)
            yield has, self.first[rows[has]] + k

    def sparse(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(rows), bool)
        for has, wish in self._pairs(rows):
            own_low, own_high = low[has], high[has]
            sure = (own_low >= self.floor[wish]) & (own_high <= self.ceiling[wish])
            least = np.maximum(self.best.least, _kth(own_low[sure], wish[sure], len(self.anchor), self.best.k))
            alive[has] |= (own_high >= np.maximum(self.floor, least)[wish]) & (own_low <= self.ceiling[wish])
        return alive

    def take(self, rows: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        for has, wish in self._pairs(rows):
            fits = (score[has] >= self.floor[wish]) & (score[has] <= self.ceiling[wish])
            self.best.add(wish[fits], score[has][fits], id[has][fits])


def sweep(anchors: np.ndarray, rows: Planes, ids: np.ndarray, allowed, goal: Positives | Negatives) -> None:
    """Gives goal the exact scores of all pairs that may qualify. allowed(tile of anchors, tile of rows) tells which pairs count, None: none of them."""
    if not len(anchors) or not len(ids):
        return
    down, up = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
    top = len(rows.planes) - 1
    kind = np.float32 if int(np.abs(anchors).sum(axis=1).max()) << top + 1 < 2**24 else np.float64
    for start in range(0, len(ids), WIDTH):
        part = slice(start, min(start + WIDTH, len(ids)))
        unpacked: dict[int, np.ndarray] = {}

        def bits(p: int) -> np.ndarray:
            if p not in unpacked:
                unpacked[p] = rows.bits(p, part).astype(kind)
            return unpacked[p]

        for at in range(0, len(anchors), TILE):
            tile = slice(at, min(at + TILE, len(anchors)))
            alive = allowed(tile, part)
            if alive is None or not alive.any():
                continue
            own = anchors[tile].astype(kind)
            score = np.zeros(alive.shape, kind)
            p = top
            while p >= 0:
                score += kind(rows.weight(p)) * (own @ bits(p).T)
                rest = (1 << p) - 1
                alive = goal.dense(tile, score + (rest * down[tile, None]).astype(kind), score + (rest * up[tile, None]).astype(kind), alive)
                p -= 1
                if np.count_nonzero(alive) * SPARSE < alive.size:
                    break
            r, c = np.nonzero(alive)
            exact = score[r, c].astype(np.float64)
            while True:
                rest = (1 << p + 1) - 1
                keep = goal.sparse(r + at, exact + rest * down[r + at], exact + rest * up[r + at])
                r, c, exact = r[keep], c[keep], exact[keep]
                if p < 0 or not len(r):
                    break
                exact = exact + rows.weight(p) * np.einsum("ij,ij->i", own[r], bits(p)[c])
                p -= 1
            goal.take(r + at, exact.astype(np.int64), ids[part][c])


def _usable(vectors: DataFrame, modulus: int, labels: int, scale: int) -> DataFrame:
    """(vec_id, label, size, q) of the rows that take part, labels moved on where vec_id is divisible by modulus."""
    own = lambda x: F.floor(x.cast("double") * scale)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > MOST / scale)
    label = F.when(F.col("vec_id") % modulus == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    fits = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(~F.exists("embedding", bad))
    return fits.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.size("embedding").alias("size"), F.transform("embedding", lambda x: own(x).cast("int")).alias("q"))


def _blocks(rows: DataFrame, count: int, most: int, least: int, asks: bool) -> tuple[DataFrame, int]:
    """rows dealt into blocks of about equal size, one row each: size, block, ids, labels and vectors or planes."""
    spark = rows.sparkSession
    n = max(1, -(-count // min(most, max(least, count // (2 * spark.sparkContext.defaultParallelism) + 1))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        n, size = group.num_rows, group.column("size")[0].as_py()
        order = np.argsort(group.column("label").to_numpy(), kind="stable")  # so that a tile holds few labels
        q = group.column("q").combine_chunks().flatten().to_numpy().reshape(n, size).astype(np.int64)[order]
        planes = Planes.of(q)
        data = q.astype("<i4").tobytes() if asks else planes.planes.tobytes()
        ids, labels = (group.column(c).to_numpy().astype("<i8")[order].tobytes() for c in ("vec_id", "label"))
        return pa.table({"size": pa.array([size], pa.int32()), "block": group.column("block").slice(0, 1), "bits": pa.array([0 if asks else len(planes.planes)], pa.int32()), "ids": pa.array([ids], pa.binary()), "labels": pa.array([labels], pa.binary()), "data": pa.array([data], pa.binary())})

    spread = dealt.repartition(max(partitions(spark), min(n, 4096)), "size", "block")
    return checkpoint(spread.groupBy("size", "block").applyInArrow(run, "size int, block int, bits int, ids binary, labels binary, data binary")), n


def _meet(asking: DataFrame, n_asking: int, rows: DataFrame, n_rows: int) -> DataFrame:
    """A row for each pair of a block of anchors and a block of rows whose vectors have equal length."""
    spark = asking.sparkSession
    parts = max(partitions(spark), min(4 * n_asking * n_rows, 8192))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asking.withColumn("other", each(n_rows)).repartition(parts, "size", "block", "other")
    x = rows.select("size", F.col("block").alias("other"), F.col("bits").alias("x_bits"), F.col("ids").alias("x_ids"), F.col("labels").alias("x_labels"), F.col("data").alias("x_data")).withColumn("block", each(n_asking)).repartition(parts, "size", "block", "other")
    return a.join(x, ["size", "block", "other"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(the row's other values, anchors' ids, labels and vectors, rows' ids, labels and planes) of each pair of blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            longs = {c: np.frombuffer(r[c], "<i8") for c in ("ids", "labels", "x_ids", "x_labels")}
            size = r["size"]
            planes = np.frombuffer(r["x_data"], np.uint8).reshape(r["x_bits"], len(longs["x_ids"]), -(-size // 8))
            yield r, longs["ids"], longs["labels"], np.frombuffer(r["data"], "<i4").reshape(len(longs["ids"]), size).astype(np.int64), longs["x_ids"], longs["x_labels"], Planes(planes, size)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, floor: int = 50, ceiling: int = 95, modulus: int = 7, labels: int = 10, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and positive of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by every; positives their
    first rows of another vec_id and the same label, by score and vec_id;
    negatives the first rows of another label whose score is from floor to
    ceiling percent of the positive's. Labels move on by one (modulo labels)
    where vec_id is divisible by modulus.

    Rows with a null vec_id or label, a null vector, or a component that is
    null, not finite or beyond 4096 take no part. Only vectors of equal length
    are compared; the product of empty ones is 0. Rows repeated under one vec_id
    are rows of their own, anchors included, but no positives of each other.
    Anchors without a positive, and positives without a negative, have no rows;
    no rows: no rows. Other columns are not carried.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, modulus, labels, scale)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    total, asked = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first())
    stored, n_rows = _blocks(rows, total, ROWS, LEAST_ROWS, False)
    asking, n_asking = _blocks(anchors, asked, ANCHORS, LEAST_ANCHORS, True)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids, own, a, x_ids, x_own, planes in _pairs(batches):
            goal = Positives(len(ids), positives)

            def allowed(tile: slice, part: slice) -> np.ndarray | None:
                same = own[tile, None] == x_own[None, part]
                return same & (ids[tile, None] != x_ids[None, part]) if same.any() else None

            sweep(a, planes, x_ids, allowed, goal)
            n = len(goal.best.wish)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["size"]), pa.int32()), pa.array(np.full(n, r["block"]), pa.int32()), pa.array(goal.best.wish, pa.int32()), pa.array(goal.best.id), pa.array(goal.best.score)], ["size", "block", "anchor", "id", "score"])

    found = _meet(asking, n_asking, stored, n_rows).mapInArrow(nearest, "size int, block int, anchor int, id long, score long")
    best = _first(found, positives, "size", "block", "anchor")
    # At most positives times the anchors of a block.
    wishes = best.groupBy("size", "block").agg(F.sort_array(F.collect_list(F.struct("anchor", "place", "id", "score"))).alias("wishes"))
    wishing = checkpoint(asking.join(wishes, ["size", "block"]))

    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids, own, a, x_ids, x_own, planes in _pairs(batches):
            anchor, place, positive, score = (np.array([w[c] for w in r["wishes"]], np.int64) for c in ("anchor", "place", "id", "score"))
            goal = Negatives(len(ids), anchor, -(-floor * score // 100), ceiling * score // 100, negatives)
            sweep(a, planes, x_ids, lambda tile, part: own[tile, None] != x_own[None, part], goal)
            w = goal.best.wish
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(w), r["size"]), pa.int32()), pa.array(np.full(len(w), r["block"]), pa.int32()), pa.array(anchor[w], pa.int32()), pa.array(place[w], pa.int32()), pa.array(ids[anchor[w]]), pa.array(positive[w]), pa.array(score[w]), pa.array(goal.best.id), pa.array(goal.best.score)],
                ["size", "block", "anchor", "wish", "anchor_id", "positive_id", "positive_score", "id", "score"],
            )

    schema = "size int, block int, anchor int, wish int, anchor_id long, positive_id long, positive_score long, id long, score long"
    last = _first(_meet(wishing, n_asking, stored, n_rows).mapInArrow(negative, schema), negatives, "size", "block", "anchor", "wish")
    return last.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each group with their place from 1; groups hold at most k rows of each block."""
    place: Column = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
