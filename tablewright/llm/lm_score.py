"""Cross-entropy difference of a target and a background bigram model.

Both models share one vocabulary of words, the same smoothing and the same
order, so a document's losses under the two differ only by what was counted:
the target's documents, or all others. The score is the mean over tokens of
target loss less background loss; low means like the target. A document's own
counts are taken out of the model that it belongs to before it is scored (each
of identical documents still sees the others).

Counting covers all documents, words by hashes of 64 bits and pairs of words by
hashes of 56 (of 10^11 pairs one in a million shares its hash); no table has a fixed size. Documents are dealt into chunks of some ``CHUNK``
characters by their content. A chunk sends its distinct words and pairs with
its own counts to the part of each, where the chunks' counts are added up, and
is sent back, in the order in which it sent them, what the other chunks have of
each. Then it has the corpus' counts of all that its documents need and scores
them. Keys travel as differences of sorted hashes, both they and the counts
with equal places of their bytes together, which packs well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_or_empty

WORD_BITS = 18  # the smoothing allows for so many words at least
CHUNK = 16_000_000
FAN = 12  # parts at least that words and pairs are dealt to
START = 0  # the word before a document's first; its count is that of documents with words
TOKENS = 1  # its count is that of all words
ADD = 0.1  # to each word's count
PRIOR = 20.0  # weight of the word's own probability among the pairs of its predecessor
BITS = (64, 56)  # of the hashes of words and of pairs
CACHED = 100_000
BROADCAST_IDS = 2_000_000  # 8 bytes each, some 50 MB as a hash table


class Vocabulary(dict):
    """Word to its hash, 2 or more or negative; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        number = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) - (1 << 63)
        self[word] = number = number if number not in (START, TOKENS) else number + 2
        return number


def numbers(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed = (mixed + word.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS[1])).view(np.int64)


def _before(words: np.ndarray) -> np.ndarray:
    return np.concatenate([[START], words[:-1]]).astype(np.int64)


def _tally(keys: list[np.ndarray], targets: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts, [background, target], of documents, and the place of each key of the documents."""
    flat = np.concatenate([np.empty(0, np.int64), *keys])
    once, at = np.unique(flat, return_inverse=True)
    target = np.repeat(np.array(targets, bool), [len(k) for k in keys])
    return once, np.stack([np.bincount(at[~target], minlength=len(once)), np.bincount(at[target], minlength=len(once))]), at


def _tables(texts: list[str], targets: list[bool]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]], int]:
    """The places of each document's words and pairs in the tallies of words (with START and, after it, TOKENS) and pairs; these; the place of START."""
    vocabulary = Vocabulary()
    words = [numbers(t, vocabulary) for t in texts]
    keys, counts, of_word = _tally(words, targets)
    more = np.zeros((2, 2), np.int64)
    for own, target in zip(words, targets):
        more[int(target)] += (len(own) > 0, len(own))
    at = int(np.searchsorted(keys, START))
    both = np.insert(keys, at, [START, TOKENS]), np.insert(counts, [at, at], more, axis=1)
    of_word += 2 * (of_word >= at)
    pair_keys, pair_counts, of_pair = _tally([pairs(_before(w), w) if len(w) else w for w in words], targets)
    ends = np.cumsum([len(w) for w in words])[:-1]
    return list(zip(np.split(of_word, ends), np.split(of_pair, ends))), [both, (pair_keys, pair_counts)], at


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, the first bytes of all before the second ones."""
    own = np.ascontiguousarray(numbers, "<i8").reshape(-1).view(np.uint8).reshape(-1, 8)
    return pa.compress(np.ascontiguousarray(own.T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    own = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(own.T).reshape(-1).view("<i8")


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys."""
    own = keys.astype("<i8").view("<u8")
    return len(own).to_bytes(8, "little") + _packed(np.diff(own, prepend=np.uint64(0)).view("<i8"))


def _unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed[8:], int.from_bytes(packed[:8], "little")).view("<u8"), dtype=np.uint64).view("<i8")


def _dealt(keys: np.ndarray, parts: int, kind: int) -> list[np.ndarray]:
    """The places of the keys of each part, a range of hashes."""
    part = (keys.view(np.uint64) >> np.uint64(BITS[kind] - 32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts).astype(np.uint64)))


_ROW = "kind int, part int, chunk int, keys binary, counts binary"


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table({name.split()[0]: pa.array(c, k) for name, c, k in zip(_ROW.split(", "), columns, kinds)})


def _chunked(docs: DataFrame, chunks: int) -> DataFrame:
    slim = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce("target", F.lit(False)).alias("target"))
    return slim.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))


@dataclass(frozen=True)
class Counts:
    """own: each chunk's tallies by parts. others: for each chunk and part what the other chunks count of its keys, in their order. vocabulary: the number of distinct words."""

    own: DataFrame
    others: DataFrame
    chunks: int
    parts: int
    vocabulary: int

    def _all(self, kind: int) -> np.ndarray:
        """Sums in the order of the keys, gathered: for small corpora."""
        total: dict[int, np.ndarray] = {}
        for row in self.own.filter(F.col("kind") == kind).toLocalIterator():
            keys = _unpacked_keys(bytes(row["keys"]))
            for k, n in zip(keys.tolist(), _unpacked(bytes(row["counts"]), 2 * len(keys)).reshape(2, -1).T):
                total[k] = total.get(k, 0) + n
        tokens = total.pop(TOKENS, None) if kind == 0 else None
        first = [START] if tokens is not None else []
        return np.array([total[k] for k in [*first, *sorted(k for k in total if k not in first)]]).T

    @property
    def words(self) -> np.ndarray:
        return self._all(0)

    @property
    def pairs(self) -> np.ndarray:
        return self._all(1)


def count(docs: DataFrame) -> Counts:
    """docs (doc_id, text, target boolean), all of them; a null target counts as false, a null text as empty."""
    chunks = int((docs.agg(F.sum(F.length(text_or_empty()))).first()[0] or 0) // CHUNK) + 1
    parts = max(FAN, chunks)

    def tables(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        _, found, _ = _tables(group.column("text").to_pylist(), group.column("target").to_pylist())
        rows = []
        for kind, (keys, counts) in enumerate(found):
            rows += [(kind, p, chunk, _packed_keys(keys[own]), _packed(counts[:, own])) for p, own in enumerate(_dealt(keys, parts, kind)) if len(own)]
        return _rows(rows)

    own = _chunked(docs, chunks).groupBy("chunk").applyInArrow(tables, _ROW)

    def add(group: pa.Table) -> pa.Table:
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        keys = [_unpacked_keys(x.as_py()) for x in group.column("keys")]
        counts = [_unpacked(x.as_py(), 2 * len(k)).reshape(2, -1) for x, k in zip(group.column("counts"), keys)]
        once, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros((2, len(once)), np.int64)
        place = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        for own, n in zip(place, counts):
            total[:, own] += n  # a chunk's keys are distinct
        rows = [(kind, part, -1, b"", len(once).to_bytes(8, "little"))]
        rows += [(kind, part, chunk, b"", _packed(total[:, own] - n)) for chunk, own, n in zip(group.column("chunk").to_pylist(), place, counts)]
        return _rows(rows)

    found = checkpoint(own.groupBy("kind", "part").applyInArrow(add, _ROW))
    vocabulary = sum(int.from_bytes(r["counts"], "little") for r in found.filter("chunk = -1 and kind = 0").select("counts").toLocalIterator()) - 2
    return Counts(own, found.filter("chunk >= 0"), chunks, parts, vocabulary)


def _losses(of_word: np.ndarray, of_pair: np.ndarray, start: int, target: bool, counts: np.ndarray, pair_counts: np.ndarray, vocabulary: int) -> tuple[float, float]:
    """Mean loss a token under target and background, natural logarithm, of a document's places in the counts; (0, 0) without tokens."""
    if not len(of_word):
        return 0.0, 0.0
    of_before = np.concatenate([[start], of_word[:-1]])
    out = []
    for m in (1, 0):
        word_n, before_n = counts[m][of_word].astype(float), counts[m][of_before].astype(float)
        pair_n, total = pair_counts[m][of_pair].astype(float), float(counts[m][start + 1])
        if m == int(target):  # less its own
            _, at, own = np.unique(of_word, return_inverse=True, return_counts=True)
            own_words = own[at]
            before_n = before_n - np.concatenate([[1], own_words[:-1]])
            _, at, own = np.unique(of_pair, return_inverse=True, return_counts=True)
            word_n, pair_n, total = word_n - own_words, pair_n - own[at], total - len(of_word)
        p = (word_n + ADD) / (total + ADD * vocabulary)
        p = (np.minimum(pair_n, before_n) + PRIOR * p) / (before_n + PRIOR)
        out.append(float(-np.log(p).mean()))
    return out[0], out[1]


def score(docs: DataFrame, counts: Counts) -> DataFrame:
    """One row per row of docs (doc_id, text, target), those that were counted: doc_id, tokens, target_loss, background_loss, difference. Texts without words: zeros. Other columns are not carried."""
    slim = _chunked(docs, counts.chunks)
    parts = counts.parts
    vocabulary = max(1 << WORD_BITS, counts.vocabulary)

    def run(group: pa.Table, others: pa.Table) -> pa.Table:
        targets = group.column("target").to_pylist()
        documents, tables, start = _tables(group.column("text").to_pylist(), targets)
        places = [_dealt(keys, parts, kind) for kind, (keys, _) in enumerate(tables)]
        for kind, part, more in zip(others.column("kind").to_pylist(), others.column("part").to_pylist(), others.column("counts")):
            own = places[kind][part]
            tables[kind][1][:, own] += _unpacked(more.as_py(), 2 * len(own)).reshape(2, -1)
        found = [_losses(w, p, start, t, tables[0][1], tables[1][1], vocabulary) for (w, p), t in zip(documents, targets)]
        columns = [[len(w) for w, _ in documents], [a for a, _ in found], [b for _, b in found], [a - b for a, b in found]]
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([group.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "tokens", "target_loss", "background_loss", "difference"])

    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, tokens long, target_loss double, background_loss double, difference double"
    return slim.groupBy("chunk").cogroup(counts.others.groupBy("chunk")).applyInArrow(run, schema)


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target): target documents are those that labels gives quality 1 (any of its rows).

    Their ids are written and counted; up to BROADCAST_IDS of them are sent to
    the tasks, so that texts stay where they are, more are joined by a shuffle.
    """
    good = checkpoint(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct())
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    slim = docs.select("doc_id", "text")
    return slim.join(good, slim["doc_id"] == good["good_id"], "left").select("doc_id", "text", F.col("good_id").isNotNull().alias("target"))
