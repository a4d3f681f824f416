"""Near-duplicate embeddings by product quantisation in coarse inverted lists.

Unit vectors go to the list of their nearest centroid; what is left of them
there is cut into subspaces, each coded by its nearest codeword. A query probes
the lists of its nearest centroids and reads, for each vector in them, an
approximate cosine from tables of its products with the centroid and the
codewords. The length of a vector's quantisation error is stored beside its
code and bounds what the approximation can be off by, so a vector is passed
over only if its cosine is surely too low; the others are compared exactly in
double precision. Within the probed lists nothing is lost; ``PROBES`` lists
suffice for a recall that tests hold against brute force.

Centroids and codewords are fitted in numpy on at most ``SAMPLE`` vectors (the
least by a hash); all vectors are indexed and all are queries. There is a list
for every ``PER_LIST`` vectors: where the sample is too small for as many
centroids, a second level of them is fitted on what the first leaves, shared by
all lists of the first, so that a list is a pair of centroids and their number
is the product of both levels. Only vectors of equal label and length are
compared. Equal vectors are one class and compared once. A list's vectors are
dealt into blocks of about ``BLOCK``, its queries into blocks of ``ASKING``
times as many; a group holds one block of either, so a dense list becomes many
small groups. It returns counts of links and, for the components, a spanning
forest of its links; pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions
from .components import components

COSINE = 0.93
PROBES = 6
SAMPLE = 20_000
PER_LIST = 400
MAX_LISTS = 4_096
SUBSPACES = 8
CODEWORDS = 32
BLOCK = 1_024
ASKING = 4
STEP = 512  # queries compared at a time
MAX_SENT = 200_000  # rows (label, list, two counts) that are sent to all tasks; more are joined by a shuffle


@dataclass(frozen=True)
class Quantizer:
    """centroids (first level, dimensions), unit vectors; finer (second level, dimensions); codebooks: for each subspace its slice and codewords."""

    centroids: np.ndarray
    finer: np.ndarray
    codebooks: list[tuple[slice, np.ndarray]]

    @cached_property
    def _level(self) -> np.ndarray:
        """(first, second): half the square of a centre's length, less that of the first level's."""
        return self.centroids @ self.finer.T + (self.finer * self.finer).sum(axis=1) / 2

    def centre(self, own: np.ndarray | int) -> np.ndarray:
        return self.centroids[own // len(self.finer)] + self.finer[own % len(self.finer)]

    def lists(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each vector, the nearest first; with two levels among those of its nearest probes of the first."""
        first, score = _top(unit @ self.centroids.T, probes)
        if len(self.finer) == 1:
            return first
        out = np.zeros((len(unit), min(probes, first.shape[1] * len(self.finer))), np.int64)
        for at in range(0, len(unit), STEP):
            own = first[at : at + STEP]
            near = score[at : at + STEP, :, None] + (unit[at : at + STEP] @ self.finer.T)[:, None, :] - self._level[own]
            place, _ = _top(near.reshape(len(own), -1), probes)
            which, second = np.divmod(place, len(self.finer))
            out[at : at + STEP] = np.take_along_axis(own, which, 1) * len(self.finer) + second
        return out

    def encode(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of what is left of unit vectors in their lists, and the length of the error."""
        rest = unit - self.centre(own)
        codes = np.zeros((len(unit), len(self.codebooks)), np.uint8)
        error = np.zeros(len(unit))
        for k, (part, words) in enumerate(self.codebooks):
            own = rest[:, part]
            far = (words * words).sum(axis=1) - 2 * own @ words.T
            codes[:, k] = far.argmin(axis=1)
            error += ((own - words[codes[:, k]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def approximate(self, queries: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """(queries, vectors of the list own): cosines with the coded vectors."""
        total = np.repeat((queries @ self.centre(own))[:, None], len(codes), axis=1)
        for k, (part, words) in enumerate(self.codebooks):
            total += (queries[:, part] @ words.T)[:, codes[:, k]]
        return total


def _top(near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the n greatest of each row, the greatest first."""
    n = min(n, near.shape[1])
    top = np.argpartition(-near, n - 1, axis=1)[:, :n]
    own = np.take_along_axis(near, top, 1)
    order = np.argsort(-own, axis=1, kind="stable")
    return np.take_along_axis(top, order, 1), np.take_along_axis(own, order, 1)


def _means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    centers = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = ((centers * centers).sum(axis=1) - 2 * points @ centers.T).argmin(axis=1)
        for d in range(points.shape[1]):
            total = np.bincount(own, points[:, d], len(centers))
            n = np.bincount(own, minlength=len(centers))
            centers[:, d] = np.where(n > 0, total / np.maximum(n, 1), centers[:, d])
        if unit:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, seed: int = 17) -> Quantizer:
    """A level holds at most MAX_LISTS centroids and one for eight of the sample; a second level makes up for the rest of lists."""
    rng = np.random.default_rng(seed)
    most = max(1, min(MAX_LISTS, len(sample) // 8))
    centroids = _means(sample, max(1, min(lists, most)), 8, rng, True)
    rest = sample - centroids[(sample @ centroids.T).argmax(axis=1)]
    second = min(most, -(-lists // most))
    finer = _means(rest, second, 8, rng, False) if second > 1 else np.zeros((1, sample.shape[1]))
    rest = sample - (plain := Quantizer(centroids, finer, [])).centre(plain.lists(sample, 1)[:, 0])
    edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    return Quantizer(centroids, finer, [(slice(a, b), _means(rest[:, a:b], min(codewords, len(rest)), 8, rng, False)) for a, b in zip(edges[:-1], edges[1:])])


def usable(values: list | None) -> bool:
    """Not null, empty or zero, and without null or non-finite components."""
    if not values or any(v is None for v in values):
        return False
    own = np.array(values, dtype=np.float64)
    return bool(np.isfinite(own).all() and own.any())


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    own = vectors.astype(np.float64)
    own /= np.abs(own).max(axis=1, keepdims=True)  # else squares of very large or small numbers would be lost
    return own / np.sqrt((own * own).sum(axis=1, keepdims=True))


def _forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the ids of linked rows and columns to the least id of their component in this block."""
    own_r, own_c = rows.copy(), columns.copy()
    big = np.iinfo(np.int64).max
    while True:
        new_r = np.minimum(own_r, np.where(linked, own_c[None, :], big).min(axis=1, initial=big))
        new_c = np.minimum(own_c, np.where(linked, new_r[:, None], big).min(axis=0, initial=big))
        if (new_r == own_r).all() and (new_c == own_c).all():
            break
        own_r, own_c = new_r, new_c
    ids, roots = np.concatenate([rows, columns]), np.concatenate([own_r, own_c])
    keep = ids != roots
    return list(set(zip(ids[keep].tolist(), roots[keep].tolist())))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (vec_id, label, size, h, g) of usable vectors and classes (label, size, h, g, first, n, raw, cls) of equal ones. raw: the components as bytes, singly precise where the column is."""
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    slim = vectors.select("vec_id", "label", F.col("embedding") if kind == np.float32 else F.col("embedding").cast("array<double>").alias("embedding")).filter("label is not null and embedding is not null")
    types = {f.name: f.dataType.simpleString() for f in slim.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("embedding").to_pylist()
            keep = [k for k, v in enumerate(own) if usable(v)]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([np.array(own[k], kind).tobytes() for k in keep], pa.binary())], ["vec_id", "label", "raw"])

    raw = slim.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, raw binary")
    keyed = checkpoint(raw.select("vec_id", "label", "raw", F.length("raw").alias("size"), F.xxhash64("raw").alias("h"), F.xxhash64(F.lit(97), "raw").alias("g")))
    grouped = keyed.groupBy("label", "size", "h", "g").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw"))
    return keyed.drop("raw"), checkpoint(grouped.withColumn("cls", F.monotonically_increasing_id()))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """Unit vectors of raw ones."""
    rows = [np.frombuffer(u, kind) for u in column.to_pylist()]
    return units(np.stack(rows)) if rows else np.zeros((0, 1))


def _of_size(classes: DataFrame, kind: type, least: float, probes: int) -> tuple[DataFrame, DataFrame]:
    """(cls, links) in parts to be added up, and edges (a, b), among the classes whose vectors take size bytes."""
    spark = classes.sparkSession
    total = classes.count()
    # Hashes are spread evenly, so that this share of them holds some more than SAMPLE rows: only those are sorted.
    few = classes.filter(F.shiftrightunsigned("h", 1) < int(min(1.0, 1.2 * SAMPLE / max(total, 1)) * (2**63 - 1))) if total > 2 * SAMPLE else classes
    drawn = few.orderBy("h", "g", "label").limit(SAMPLE).select("raw").toArrow()
    sample = _matrix(drawn.column("raw"), kind)
    quantizer = fit(sample, total // PER_LIST)
    shared = spark.sparkContext.broadcast(quantizer)  # at most MAX_LISTS centroids a level

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("raw"), kind)
            near = shared.value.lists(unit, probes)
            codes, error = shared.value.encode(unit, near[:, 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "label", "n", "raw")), pa.array(near[:, 0].astype(np.int32)), pa.array([r.tolist() for r in near], pa.list_(pa.int32())), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)], ["cls", "label", "n", "raw", "own", "near", "codes", "error"])

    label = classes.schema["label"].dataType.simpleString()
    indexed = checkpoint(classes.select("cls", "label", "n", "raw").repartition(partitions(spark), "cls").mapInArrow(index, f"cls long, label {label}, n long, raw binary, own int, near array<int>, codes binary, error double"))
    queries = indexed.select("cls", "label", "n", "raw", "own", F.explode("near").alias("list"))
    have = indexed.groupBy("label", F.col("own").alias("list")).agg(F.count("cls").alias("have"))
    ask = queries.groupBy("label", "list").agg(F.count("cls").alias("ask"))
    blocks, askers = F.ceil(F.coalesce("have", F.lit(0)) / BLOCK).cast("int"), F.ceil(F.col("ask") / (BLOCK * ASKING)).cast("int")
    # Only lists that aren't one block of either; an asked list without vectors has no block. Few, as a rule: then vectors needn't be shuffled to meet them.
    sizes = checkpoint(ask.join(have, ["label", "list"], "left").select("label", "list", blocks.alias("blocks"), askers.alias("askers")).filter("blocks <> 1 or askers <> 1"))
    if sizes.count() <= MAX_SENT:
        sizes = F.broadcast(sizes)
    turn = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    stored = indexed.withColumnRenamed("own", "list").join(sizes, ["label", "list"], "left").select("label", "list", turn("blocks", 1).alias("block"), each("askers").alias("asker"), F.lit(False).alias("asks"), "cls", "n", "raw", F.col("list").alias("own"), "near", "codes", "error")
    asking = queries.join(sizes, ["label", "list"], "left").filter("blocks is null or blocks > 0").select("label", "list", each("blocks").alias("block"), turn("askers", 2).alias("asker"), F.lit(True).alias("asks"), "cls", "n", "raw", "own", F.lit(None).cast("array<int>").alias("near"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks")
        q, x = group.filter(asks), group.filter(pc.invert(asks))
        out: list[tuple[int, int | None, int]] = []
        if q.num_rows and x.num_rows:
            here = x.column("list")[0].as_py()
            xu = _matrix(x.column("raw"), kind)
            codes = np.frombuffer(b"".join(x.column("codes").to_pylist()), np.uint8).reshape(len(xu), -1)
            near = x.column("near").combine_chunks().flatten().to_numpy().reshape(len(xu), -1)
            error, xi, xn = (x.column(c).to_numpy() for c in ("error", "cls", "n"))
            stored_links = np.zeros(len(xu), np.int64)
            for start in range(0, q.num_rows, STEP):
                part = q.slice(start, STEP)
                qu = _matrix(part.column("raw"), kind)
                qi, qn, own = (part.column(c).to_numpy() for c in ("cls", "n", "own"))
                maybe = shared.value.approximate(qu, here, codes) >= least - error[None, :] - 1e-9
                maybe &= qi[:, None] != xi[None, :]
                rows, columns = np.nonzero(maybe)
                linked = np.zeros(maybe.shape, bool)
                for at in range(0, len(rows), 16_384):
                    r, c = rows[at : at + 16_384], columns[at : at + 16_384]
                    linked[r, c] = np.einsum("ij,ij->i", qu[r], xu[c]) >= least
                if linked.any():
                    out += [(i, None, c) for i, c in zip(qi.tolist(), (linked @ xn).tolist()) if c]
                    out += [(a, b, 0) for a, b in _forest(linked, qi, xi)]
                    r, c = np.nonzero(linked)
                    once = ~(near[c] == own[r][:, None]).any(axis=1)  # else the stored vector asks in the asker's list too
                    np.add.at(stored_links, c[once], qn[r[once]])
            out += [(i, None, c) for i, c in zip(xi.tolist(), stored_links.tolist()) if c]
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64()), "links": pa.array([o[2] for o in out], pa.int64())})

    found = checkpoint(stored.unionByName(asking).groupBy("label", "list", "block", "asker").applyInArrow(compare, "a long, b long, links long"))
    return found.filter("b is null").select(F.col("a").alias("cls"), "links"), found.filter("b is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, least: float = COSINE, probes: int = PROBES) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Null labels and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are kept. Rows repeated under
    one vec_id are vectors of their own and link with each other; each gets a
    row. A null vec_id never is a component's name unless it has no other. No
    rows: no rows. Other columns are not carried.
    """
    rows, classes = _classes(vectors)
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    counts, edges = [], []
    for size in sorted(r["size"] for r in classes.select("size").distinct().collect()):  # lengths of vectors in use: one, as a rule
        own = _of_size(classes.filter(F.col("size") == size), kind, least, probes)
        counts.append(own[0]), edges.append(own[1])
    if counts:
        links, graph = counts[0], edges[0]
        for c, e in zip(counts[1:], edges[1:]):
            links, graph = links.unionByName(c), graph.unionByName(e)
        roots = components(graph)
        per = links.groupBy("cls").agg(F.sum("links").alias("links"))
        named = classes.select("label", "size", "h", "g", "first", "n", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(per, "cls", "left")
        named = checkpoint(named.select("label", "size", "h", "g", "first", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
        names = named.groupBy("root").agg(F.min("first").alias("component"))
        found = rows.join(named.join(names, "root").select("label", "size", "h", "g", "n_links", "component"), ["label", "size", "h", "g"]).select("vec_id", "n_links", "component")
    else:
        found = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    # Rows without a usable vector: as many per vec_id as vectors has more than rows. All others come from found.
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", _unusable) & F.exists("embedding", lambda v: v != 0)
    alone = vectors.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return found.unionByName(alone).select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def _unusable(v):
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
