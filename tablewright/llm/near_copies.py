"""Near copies by the exact Jaccard similarity of their sets of five-word shingles.

The first candidates come from SimHash: five-word fingerprints that differ in at
most three bits, found by the ball hashing of ``simhash``. That joins texts with
few edits; at a similarity of 0.8 fingerprints differ in some 9.7 bits, so it
can't reach all. The others come from MinHash bands: two sets of similarity s meet in one of
``BANDS`` bands of ``ROWS`` minima with probability 1 - (1 - s^ROWS)^BANDS, that
is 99.995 % at 0.8 and more above. Every link is verified on the whole sets, of
hashes of 64 bits, so nothing less similar is linked. Texts of equal sets are
one node from the start.

Buckets of bands are first resolved by stars, which cost a multiple of their rows: a
bucket names the member with the most company in all its buckets, and every
member is verified against at most ``STARS`` of those named in its buckets. That
joins most of a large group of copies. Shingles that no other set still apart
holds can't be shared, so the others of a set bound what it can have in common
with any; sets with too few go. Of what is left, all members of a bucket are
compared, in blocks of ``BLOCK``: tasks get a set once for each block that it is
compared with and return a forest of links, so pairs are never listed. Members
of buckets of more than ``LIST`` sets are dealt anew by prefixes first: two sets
of the similarity share one of the rarest fifth (and one more) of the shingles
of each, so this loses nothing, and a passage that many share is in few
prefixes. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpoint, fresh, release, shuffled, sliced, text_or_empty
from .components import components

WORDS = 5
SIMILARITY = (4, 5)  # 0.8, in whole numbers
BANDS, ROWS = 25, 5
STARS = 4
BLOCK, LIST = 256, 4_096

_FACTORS = np.random.default_rng(8).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; a shorter text is one run, one without words has none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(tokens[k:] for k in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in runs), np.uint64, max(1, len(tokens) - words + 1)))


def bands(own: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):
        np.minimum(least, (_FACTORS[:, None] * own[None, at : at + 512]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), 7) - (1 << 63) for x in least.reshape(BANDS, ROWS)]


def _name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 1) - (1 << 63)


def version() -> Column:
    """A hash of a row's text, which tells rows of one doc_id apart."""
    return F.xxhash64(text_or_empty())


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp, node, n, keys) for each row: a hash of its text, its fingerprint, the name of its set, the set's size and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            sets = [shingles(t) for t in texts]
            fps = np.array([simhash.fingerprint(t, WORDS) for t in texts], np.uint64).view(np.int64)
            columns = [pa.array(fps), pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *columns], ["doc_id", "version", "fp", "node", "n", "keys"])

    slim = docs.select("doc_id", version().alias("version"), text_or_empty().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, version long, fp long, node long, n int, keys array<long>")


def _sets(docs: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, own array<long>) of nodes, never broadcast; only texts of documents that stand for one are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "own"])

    ids = checkpoint(prints.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("wanted")).select("wanted").distinct())
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["wanted"]), "left_semi").select(text_or_empty().alias("text"))
    return shuffled(checkpoint(texts.mapInArrow(run, "node long, own array<long>").join(nodes, "node", "left_semi").dropDuplicates(["node"])))


def _alike(prints: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: nodes whose fingerprints differ in few bits. All of a fingerprint are paired with its least node, and the least ones of near fingerprints."""
    of = checkpoint(prints.filter("n > 0").select("fp", "node").distinct())
    least = checkpoint(of.groupBy("fp").agg(F.min("node").alias("least")))
    same = of.join(least, "fp").filter("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}")) for x in "ab")
    near = shuffled(simhash.links(least)).join(a, "a").join(b, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return checkpoint(same.union(near.filter("a < b")).distinct())


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets have the similarity or more."""
    a, b = (sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    both = F.size(F.array_intersect("own_a", "own_b"))
    up, down = SIMILARITY
    near = pairs.join(a, "a").join(b, "b").filter(both * (up + down) >= (F.size("own_a") + F.size("own_b")) * up)
    return checkpoint(near.select("a", "b"))


def _open(rooted: DataFrame) -> DataFrame:
    """rooted (band, key, node, root ..) in buckets of more than one component, with their size now."""
    open_ = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("node").alias("size")).filter("low < high")
    return rooted.drop("size").join(checkpoint(open_.select("band", "key", "size")), ["band", "key"])


def _fits(x: Column, y: Column) -> Column:
    """Whether sets of x and y shingles can be similar."""
    up, down = SIMILARITY
    return F.least(x, y) * down >= F.greatest(x, y) * up


def _sifted(live: DataFrame, sets: DataFrame) -> DataFrame:
    """live (band, key, node, n, root ..) without the sets that share too few shingles with those of other components."""
    up, down = SIMILARITY
    rows = checkpoint(live.select("node", "root").distinct().join(sets, "node").select("node", "root", F.explode("own").alias("shingle")))
    common = checkpoint(rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle"))
    shared = rows.join(common, "shingle").groupBy("node").agg(F.count("shingle").alias("c"))
    return live.join(checkpoint(shared), "node").filter(F.col("c") * down >= F.col("n") * up).drop("c")


def _stars(members: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: each node with up to STARS of the nodes that its buckets name."""
    company = checkpoint(members.groupBy("node").agg((-F.sum("size")).alias("place")))
    named = members.join(company, "node").groupBy("band", "key").agg(F.min(F.struct("place", "node", "n")).alias("y"))
    met = members.join(checkpoint(named), ["band", "key"]).filter((F.col("node") != F.col("y.node")) & _fits(F.col("n"), F.col("y.n")))
    few = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("y")), 1, STARS).alias("few"))  # of BANDS at most
    return few.select("node", F.explode("few.node").alias("y")).select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")).distinct()


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that join all similar sets of rows (band, key, size, node, root) in one bucket."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "root")
    up, down = SIMILARITY

    def compare(group: pa.Table) -> pa.Table:
        node, root, block = (group.column(c).to_numpy() for c in ("node", "root", "block"))
        own = group.column("own").combine_chunks()
        size = own.value_lengths().to_numpy()
        once, at, often = np.unique(own.flatten().to_numpy(), return_inverse=True, return_counts=True)
        keep = often[at] > 1
        row, at = np.repeat(np.arange(len(node)), size)[keep], np.cumsum(often > 1)[at[keep]] - 1
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        common = np.zeros((len(node), len(node)), np.float32)  # counts below 2^24 are exact
        for low in range(0, int((often > 1).sum()), 4096):
            part = slice(*np.searchsorted(at, [low, low + 4096]))
            there = np.zeros((len(node), 4096), np.float32)
            there[row[part], at[part] - low] = 1
            common += there @ there.T
        near = (common * (up + down) >= (size[:, None] + size[None, :]) * float(up)) & (root[:, None] < root[None, :])
        if group.column("x")[0].as_py() != group.column("y")[0].as_py():
            near &= block[:, None] != block[None, :]
        name = {r: r for r in root.tolist()}

        def find(r: int) -> int:
            while name[r] != r:
                name[r] = r = name[name[r]]
            return r

        links = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            a, b = find(int(root[i])), find(int(root[j]))
            if a != b:
                name[b] = a
                links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return checkpoint(dealt.join(sets, "node").groupBy("band", "key", "x", "y").applyInArrow(compare, "a long, b long"))


def _prefixes(large: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of large as members (band, key, node, n, root) of one bucket for each shingle of their prefixes."""
    nodes = large.select("node", "n", "root").distinct()
    rows = checkpoint(nodes.join(sets, "node").select("node", "n", "root", F.explode("own").alias("key")))
    often = checkpoint(rows.groupBy("key").agg(F.count("node").alias("often")))
    ranked = rows.join(often, "key").groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("own"))
    up, down = SIMILARITY
    first = ranked.select("node", "n", "root", F.explode(F.slice("own", F.lit(1), F.col("n") - F.ceil(F.col("n") * up / down).cast("int") + 1)).alias("own"))
    return checkpoint(first.filter("own.often > 1").select(F.lit(0).alias("band"), "own.key", "node", "n", "root"))


def _members(prints: DataFrame) -> DataFrame:
    """(band, key, size, node, n) of the bands' buckets of more than one set."""
    nodes = prints.filter("n > 0").dropDuplicates(["node"])
    rows = checkpoint(nodes.select("node", "n", F.posexplode("keys").alias("band", "key")))
    full = checkpoint(rows.groupBy("band", "key").agg(F.count("node").alias("size")).filter("size > 1"))
    return checkpoint(shuffled(rows).join(full, ["band", "key"]).select("band", "key", "size", "node", "n"))


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with root, the component that the links found join a node to."""
    return checkpoint(members.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")))


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of prints that join all candidates of the similarity or more.

    Each step's shuffles and checkpoints are released after it, so that the disk
    holds one step's at a time and not all.
    """
    spark = docs.sparkSession
    members = _members(prints)
    release(spark)
    alike = _alike(prints)
    release(spark)
    named = members.select("node").union(alike.select("a")).union(alike.select("b"))
    sets = _sets(docs, prints, checkpoint(named.distinct()))
    release(spark)
    found = _similar(checkpoint(_stars(members).union(alike).distinct()), sets)
    release(spark)
    rooted = _rooted(members, found)
    release(spark)
    live = checkpoint(_open(_sifted(_open(rooted), sets)))
    release(spark)
    more = _compared(live.filter(F.col("size") <= LIST), sets)
    large = live.filter(F.col("size") > LIST)
    if not large.isEmpty():
        more = more.union(_compared(_open(_prefixes(large, sets)), sets))
    return checkpoint(found.union(more))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, version (hash of its text), fingerprint (the name of its set of shingles), component_id, root.

    component_id is the smallest doc_id reachable over links of similarity 0.8
    or more; root names the component, as one doc_id with several texts can be
    the smallest of several. Texts without words are copies of each other. A
    null doc_id never is a component_id unless the component has no other. No
    rows: no rows. Other columns of docs are not carried.
    """
    prints = checkpoint(_prints(docs))
    found = links(docs, prints)
    release(docs.sparkSession)
    roots = components(found)
    release(docs.sparkSession)
    first = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    named = checkpoint(first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(names, "root").select("node", "component_id", "root")
    return prints.join(of, "node").select("doc_id", "version", F.col("node").alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the least (doc_id, hash of the text).

    Rows that repeat the kept one's doc_id and text are left out; another text
    under its doc_id that is no near copy stays. Rows with a null doc_id can't be
    told apart and stay. All columns are kept as they are. No rows: no rows.
    """
    groups = checkpoint(near_copies(docs).filter("doc_id is not null").groupBy("root", "doc_id", "version").agg(F.count("fingerprint").alias("rows")))
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("kept"))
    beside = groups.join(kept, "root").filter((F.struct("doc_id", "version") != F.col("kept")) | (F.col("rows") > 1))
    id_, own, again = (fresh(docs, x) for x in ("near_id", "near_version", "near_again"))
    beside = checkpoint(beside.select(F.col("doc_id").alias(id_), F.col("version").alias(own), (F.struct("doc_id", "version") == F.col("kept")).alias(again)))
    same = lambda few: (docs["doc_id"] == few[id_]) & (version() == few[own])
    once = docs.join(beside, same(beside), "left_anti")
    repeated = beside.filter(F.col(again))
    if repeated.isEmpty():
        return once
    one = docs.join(repeated, same(repeated), "left_semi").groupBy("doc_id", version().alias(own))
    one = one.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(0)).alias(again))
    return once.unionByName(one.select(*[F.col(f"{again}.`{c}`") for c in docs.columns]))
