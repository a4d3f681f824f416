"""Vectors as a few bytes: codebooks by Lloyd's rounds with a heap of slacks for each entry.

Vectors become integers and are cut into equal parts, each coded by the nearest
entry of its codebook. A round only rescans the parts whose assignment may have
changed. Each part has an upper bound on the distance to its entry and a lower
bound on that to any other; their difference, the slack, shrinks by at most
what its entry and the fastest other entry have moved. Blocks keep one heap an
entry, keyed by the slack plus all that the entry's parts had lost when it was
pushed; so a round adds up each entry's losses once and pops its heap only
while the key is within them. Popped parts are compared with all entries
exactly, in integers, and pushed on the heap of their nearest; what isn't
popped is nearest to the same entry without having been looked at.

Blocks, with their heaps and the sums of their entries' parts, are a table that
each round writes to the shared checkpoint folder; Spark adds the sums up, and
only codebooks (entries × components) pass through the driver.
"""

from __future__ import annotations

import hashlib
import heapq
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_dir, partitions, remove

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 16_384
LEAST_BLOCK = 2_048
STEP = 2_048  # parts compared at a time
ROUNDING = 1e-6  # bounds are roots of exact integers, sums of a few of them: far less is lost
MAX_LABELS = 100_000  # rows (label, sum) that are sent to all tasks; more are joined by a shuffle


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the nearest entry (of equals the first), its squared distance and that of the second nearest; exact for integers in double precision."""
    own, first, second = np.zeros(len(points), np.int64), np.zeros(len(points)), np.full(len(points), np.inf)
    length = (entries * entries).sum(axis=1)
    for at in range(0, len(points), STEP):
        x = points[at : at + STEP]
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + length
        near = far.argmin(axis=1)
        rows = np.arange(len(x))
        own[at : at + STEP], first[at : at + STEP] = near, far[rows, near]
        far[rows, near] = np.inf
        second[at : at + STEP] = far.min(axis=1)
    return own, first, second


class Heaps:
    """One heap of (key, point) for each entry, and the entry of each point."""

    def __init__(self, entries: int, own: np.ndarray, heaps: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.entries, self.own, self.heaps = entries, own, heaps

    @staticmethod
    def fill(points: np.ndarray, entries: np.ndarray, lost: np.ndarray) -> Heaps:
        own, first, second = nearest(points, entries)
        key = np.sqrt(second) - np.sqrt(first) + lost[own]
        order = np.lexsort((key, own))  # sorted, which is a heap
        edges = np.searchsorted(own[order], np.arange(len(entries) + 1))
        return Heaps(len(entries), own, [(key[order[a:b]], order[a:b]) for a, b in zip(edges[:-1], edges[1:])])

    def settle(self, points: np.ndarray, entries: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """Pops and rescans the points that lost (what each entry's slacks have lost by now) may have moved; they are returned."""
        popped: list[int] = []
        changed: dict[int, list[tuple[float, int]]] = {}

        def heap(j: int) -> list[tuple[float, int]]:
            if j not in changed:
                changed[j] = list(zip(self.heaps[j][0].tolist(), self.heaps[j][1].tolist()))
            return changed[j]

        for j, (keys, _) in enumerate(self.heaps):
            if len(keys) and keys[0] <= lost[j] + ROUNDING:
                rest = heap(j)
                while rest and rest[0][0] <= lost[j] + ROUNDING:
                    popped.append(heapq.heappop(rest)[1])
        at = np.array(popped, np.int64)
        own, first, second = nearest(points[at], entries)
        key = np.sqrt(second) - np.sqrt(first) + lost[own]
        for j, k, point in zip(own.tolist(), key.tolist(), popped):
            heapq.heappush(heap(j), (k, point))
        for j, rest in changed.items():
            self.heaps[j] = (np.array([k for k, _ in rest], float), np.array([p for _, p in rest], np.int64))
        self.own = self.own.copy()
        self.own[at] = own
        return at

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        sizes = np.array([len(k) for k, _ in self.heaps], "<i4")
        keys = np.concatenate([k for k, _ in self.heaps]).astype("<f8")
        order = np.concatenate([p for _, p in self.heaps]).astype("<i4")
        return self.own.astype("<u1" if self.entries <= 256 else "<i4").tobytes(), sizes.tobytes(), keys.tobytes(), order.tobytes()

    @staticmethod
    def unpack(own: bytes, sizes: bytes, keys: bytes, order: bytes) -> Heaps:
        n = np.frombuffer(sizes, "<i4")
        edges = np.r_[0, np.cumsum(n)]
        k, p = np.frombuffer(keys, "<f8"), np.frombuffer(order, "<i4").astype(np.int64)
        return Heaps(len(n), np.frombuffer(own, "<u1" if len(n) <= 256 else "<i4").astype(np.int64), [(k[a:b], p[a:b]) for a, b in zip(edges[:-1], edges[1:])])


def _sums(points: np.ndarray, own: np.ndarray, entries: int) -> np.ndarray:
    """(entries, components + 1): sums of each entry's points, and their number."""
    out = np.zeros((entries, points.shape[1] + 1), np.int64)
    np.add.at(out, own, np.c_[points, np.ones(len(points), np.int64)])
    return out


def limit(width: int) -> int:
    """Integers up to this have exact squared distances in double precision."""
    return int((2**51 / max(width, 1)) ** 0.5)


def _kept(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, q) of usable rows; q: integers, filled with zeros up to the longest vector and a multiple of parts."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.filter(F.col("embedding").isNotNull()).filter(~F.exists("embedding", bad))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    most = limit(width // parts)
    fits = rows.filter(~F.exists("embedding", lambda x: F.abs(x.cast("double")) > most / scale))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return fits.select("vec_id", "label", F.concat(q, F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding"))).alias("q"))


STATE = "block int, vec_id array<{vec_id}>, label array<{label}>, q binary, own array<binary>, sizes array<binary>, keys array<binary>, members array<binary>, sums binary, scanned long"


def _add_up(state: DataFrame, cells: int) -> np.ndarray:
    """The sums of all blocks, added up by Spark after each task has added up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for s in batch.column("sums").to_pylist():
                total += np.frombuffer(s, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["cell", "value"])

    found = state.select("sums").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells, np.int64)
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code array<int>, error long) of each row of vectors (vec_id, embedding, label), and the codebooks (parts, entries, components).

    Rows are dropped whose vector is null or holds components that are null, not
    finite or too large for exact distances (above 11,000 with 16 components a
    part). Shorter vectors, empty ones too, are filled with zeros up to the
    longest and a multiple of parts. A codebook starts as that part of the rows
    with the smallest vec_ids (nulls last, of equal ones the smaller vector
    first); with fewer rows it has as many entries. Rows repeated under one
    vec_id each have a row. No rows: no rows and no entries. Other columns are
    not carried.
    """
    spark = vectors.sparkSession
    rows = _kept(vectors, scale, parts)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    start = [r["q"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()]
    if not start or not start[0]:
        codes = rows.select("vec_id", "label", F.array_repeat(F.lit(0), parts).alias("code"), F.lit(0).cast("long").alias("error"))
        return codes, np.zeros((parts, len(start), 0), np.int64)
    width = len(start[0]) // parts
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    k = books.shape[1]
    total = rows.count()
    n = max(1, -(-total // min(block, max(LEAST_BLOCK, total // (2 * spark.sparkContext.defaultParallelism) + 1))))
    lost = np.zeros((parts, k))
    shared = spark.sparkContext.broadcast((books, lost))  # one codebook of entries × components

    def part(q: bytes, p: int) -> np.ndarray:
        return np.frombuffer(q, "<i4").reshape(-1, parts, width)[:, p].astype(np.float64)

    def begin(group: pa.Table) -> pa.Table:
        books, lost = shared.value
        q = group.column("q").combine_chunks().flatten().to_numpy().astype("<i4").tobytes()
        points = [part(q, p) for p in range(parts)]
        heaps = [Heaps.fill(points[p], books[p].astype(float), lost[p]) for p in range(parts)]
        sums = np.stack([_sums(points[p].astype(np.int64), h.own, k) for p, h in enumerate(heaps)])
        return _state(group.column("block")[0].as_py(), *(pa.array([group.column(c).to_pylist()], pa.list_(group.schema.field(c).type)) for c in ("vec_id", "label")), q, heaps, sums, parts * group.num_rows)

    def _state(number: int, ids: pa.Array, labels: pa.Array, q: bytes, heaps: list[Heaps], sums: np.ndarray, scanned: int) -> pa.Table:
        packed = list(zip(*(h.pack() for h in heaps)))
        own = [pa.array([list(x)], pa.list_(pa.binary())) for x in packed]
        return pa.table({"block": pa.array([number], pa.int32()), "vec_id": ids, "label": labels, "q": pa.array([q], pa.binary()), "own": own[0], "sizes": own[1], "keys": own[2], "members": own[3], "sums": pa.array([sums.astype("<i8").tobytes()], pa.binary()), "scanned": pa.array([scanned], pa.int64())})

    def settle(batch: pa.RecordBatch, books: np.ndarray, lost: np.ndarray):
        """Each block of a batch, with its heaps, as they are for these codebooks, and the parts rescanned."""
        for row in range(batch.num_rows):
            r = batch.slice(row, 1)
            q = r.column("q")[0].as_py()
            packed = [r.column(c)[0].as_py() for c in ("own", "sizes", "keys", "members")]
            for p in range(parts):
                heaps = Heaps.unpack(*(x[p] for x in packed))
                before, points = heaps.own, part(q, p)
                yield r, q, p, points, before, heaps, heaps.settle(points, books[p].astype(float), lost[p])

    def again(now):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, lost = now.value
            for batch in batches:
                done: list[Heaps] = []
                scanned, sums = 0, None
                for r, q, p, points, before, heaps, at in settle(batch, books, lost):
                    if p == 0:
                        done, scanned, sums = [], 0, np.frombuffer(r.column("sums")[0].as_py(), "<i8").reshape(parts, k, width + 1).copy()
                    moved = at[before[at] != heaps.own[at]]
                    whole = points[moved].astype(np.int64)
                    sums[p] += _sums(whole, heaps.own[moved], k) - _sums(whole, before[moved], k)
                    done.append(heaps)
                    scanned += len(at)
                    if p == parts - 1:
                        yield from _state(r.column("block")[0].as_py(), r.column("vec_id"), r.column("label"), q, done, sums, scanned).to_batches()

        return run

    def last(now):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, lost = now.value
            for batch in batches:
                codes, error = [], 0
                for r, _, p, points, _, heaps, _ in settle(batch, books, lost):
                    if p == 0:
                        codes, error = [], np.zeros(len(points))
                    codes.append(heaps.own)
                    error = error + ((points - books[p][heaps.own]) ** 2).sum(axis=1)
                    if p == parts - 1:
                        code = pa.ListArray.from_arrays(pa.array(np.arange(0, parts * len(points) + 1, parts), pa.int32()), pa.array(np.stack(codes, axis=1).ravel(), pa.int32()))
                        yield pa.RecordBatch.from_arrays([r.column("vec_id").flatten(), r.column("label").flatten(), code, pa.array(error.astype(np.int64))], ["vec_id", "label", "code", "error"])

        return run

    schema = STATE.format(**types)
    own = F.pmod(F.xxhash64("q", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    state = rows.withColumn("block", own).repartition(max(partitions(spark), min(n, 4096)), "block").groupBy("block").applyInArrow(begin, schema)
    folder, before = posixpath.join(checkpoint_dir(spark), f"codes-{uuid.uuid4().hex}"), None
    for turn in range(rounds):
        path = f"{folder}/{turn}"
        state.write.parquet(path)
        if before:
            remove(spark, before)
        before, state = path, spark.read.parquet(path)
        sums = _add_up(state, parts * k * (width + 1)).reshape(parts, k, width + 1)
        used = sums[:, :, -1:] > 0
        new = np.where(used, sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), books)
        moved = np.sqrt(((new - books) ** 2).sum(axis=2).astype(float))
        lost = lost + moved + _fastest_other(moved)
        books = new
        now = spark.sparkContext.broadcast((books, lost))
        state = state.mapInArrow(again(now), schema) if turn < rounds - 1 else state.mapInArrow(last(now), f"vec_id {types['vec_id']}, label {types['label']}, code array<int>, error long")
    if rounds == 0:
        state = state.mapInArrow(last(shared), f"vec_id {types['vec_id']}, label {types['label']}, code array<int>, error long")
    done = checkpoint(state)
    if before:
        remove(spark, folder)
    return done, books


def _fastest_other(moved: np.ndarray) -> np.ndarray:
    """For each entry (parts, entries) the greatest move of any other one."""
    if moved.shape[1] < 2:
        return np.zeros_like(moved)
    order = np.sort(moved, axis=1)
    top, second = order[:, -1:], order[:, -2:-1]
    return np.where(moved == top, np.where((moved == top).sum(axis=1, keepdims=True) > 1, top, second), top)


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over the rows of equal label (nulls together)."""
    sums = checkpoint(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= MAX_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with decoded, the vector that each code stands for, in the integers of the codebooks."""
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(books)
    schema = ", ".join(f"`{c}` {t}" for c, t in codes.dtypes if c != "decoded") + ", decoded array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            code = batch.column("code").flatten().to_numpy().reshape(batch.num_rows, len(books))
            own = np.concatenate([books[p][code[:, p]] for p in range(len(books))], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "decoded"])

    return codes.drop("decoded").mapInArrow(run, schema)


def fingerprint(books: np.ndarray) -> str:
    """The hexadecimal SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
