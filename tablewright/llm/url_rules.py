"""Allow and block rules for hosts and paths, by a sort-merge range join.

A host is written backwards by label and closed by a dot (m.example.net is
net.example.m.), so a host and all its subdomains are one interval of keys and
the intervals of two rules are nested or apart. Urls and rules are sorted
together and swept: a stack holds the host rules whose interval is open, the
innermost on top, and a level's path prefixes are a sorted list with, for each,
the longest other prefix that encloses it.

Both sides are range-partitioned by bounds that are sampled from the urls'
keys. Where one host fills several ranges its bound repeats and its urls are
dealt over all of them. A range also gets the rules whose interval was opened
before it: those whose key is a prefix of its lower bound, at most one host rule
a label of the bound.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "allow"
ROWS_PER_RANGE = 100_000
MAX_RANGES = 16_384


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; '' without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(_lower(host), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def nested(prefixes: list[str]) -> list[int]:
    """For each of sorted distinct prefixes the place of the longest other one that encloses it, or -1; by a sweep with a stack."""
    out, stack = [], []
    for k, p in enumerate(prefixes):
        while stack and not p.startswith(prefixes[stack[-1]]):
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(k)
    return out


class Level:
    """The rules of one host: sorted paths with verdicts."""

    def __init__(self, key: str, host: str, rules: list[tuple[str, str]]):
        self.key, self.host = key, host
        best: dict[str, str] = {}
        for path, verdict in rules:
            best[path] = max(verdict, best.get(path, ""))  # block before allow
        self.paths = sorted(best)
        self.verdicts, self.up = [best[p] for p in self.paths], nested(self.paths)

    def longest(self, path: str) -> int:
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.up[k]
        return k


class Sweep:
    """Takes rules and urls of one range in the order of their keys, rules before urls of an equal key."""

    def __init__(self) -> None:
        self.stack: list[Level] = []
        self.host: tuple[str, str] = ("", "")
        self.rules: list[tuple[str, str]] = []  # of the last host, not yet on the stack

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        if self.rules and key != self.host[0]:
            self._open()
        self.host = (key, host)
        self.rules.append((path, verdict))

    def _open(self) -> None:
        self._close(self.host[0])
        self.stack.append(Level(*self.host, self.rules))
        self.rules = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict): of the rules that fit, the longest by host and path together, of equally long ones that of the longer host."""
        if self.rules:
            self._open()
        self._close(key)
        best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
        for level in self.stack:
            if (k := level.longest(path)) >= 0:
                best = max(best, (len(level.host) + len(level.paths[k]), len(level.host), level.host + level.paths[k], level.verdicts[k]), key=lambda b: b[:2])
        return best[2:]


def bounds_of(keys: DataFrame, ranges: int) -> list[str]:
    """ranges - 1 sorted bounds, with repeats, from a sample of about 100 keys a range, fewer for many ranges."""
    n = keys.count()
    if ranges < 2 or not n:
        return []
    drawn = keys.sample(fraction=min(1.0, max(20, min(100, 400_000 // ranges)) * ranges / n), seed=5).toArrow().column(0).to_pylist()
    drawn.sort()
    return [drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if drawn else []


def judge(pages: DataFrame, rules: DataFrame, ranges: int | None = None, default: str = DEFAULT) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules (host, path, verdict allow or block), any number. A rule fits its
    host and all subdomains if the url's path starts with the rule's. Null urls
    and urls without :// have empty host and path, and fit no rule but one of
    an empty host. No rule: rule null and the default verdict. Rules with a
    null host or verdict are ignored, a null path is empty; of equal rules with
    both verdicts block holds. Repeated rows each keep a row. Other columns are
    not carried. No pages: no rows.
    """
    spark = pages.sparkSession
    id_type = pages.schema["page_id"].dataType.simpleString()
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", key_of(F.col("host")))
    if ranges is None:
        ranges = max(1, min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), urls.count() // ROWS_PER_RANGE)))
    bounds = bounds_of(urls.select("key"), ranges)
    n = len(bounds) + 1
    shared = spark.sparkContext.broadcast(bounds)  # at most MAX_RANGES keys

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            ranges = []
            for k, key in enumerate(batch.column("key").to_pylist()):
                low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                ranges.append(low + k % (high - low + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges, pa.int32())], [*batch.schema.names, "range"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            row, ranges = [], []
            for k, key in enumerate(batch.column("key").to_pylist()):
                # All ranges that can hold keys of the rule's interval; "/" is the letter after ".".
                own = range(bisect_left(bounds, key), bisect_left(bounds, key[:-1] + "/") + 1)
                row += [k] * len(own)
                ranges += own
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ranges, pa.int32())], [*batch.schema.names, "range"])

    own = rules.filter("host is not null and verdict is not null").select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct().withColumn("key", key_of(F.col("host")))
    placed = urls.mapInArrow(place, f"page_id {id_type}, host string, path string, key string, range int")
    placed_rules = own.select("key", "host", "path", "verdict").mapInArrow(place_rules, "key string, host string, path string, verdict string, range int")
    none = F.lit(None)
    together = placed_rules.select("range", "key", F.lit(0).alias("kind"), none.cast(id_type).alias("page_id"), "host", "path", "verdict").unionByName(placed.select("range", "key", F.lit(1).alias("kind"), "page_id", "host", "path", none.cast("string").alias("verdict")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sweep = None, Sweep()
        for batch in batches:
            rows, found = [], []
            for k, (r, key, kind, host, path, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict")))):
                if r != at:
                    at, sweep = r, Sweep()
                if kind:
                    rows.append(k)
                    found.append(sweep.judge(key, path))
                else:
                    sweep.add(key, host, path, verdict)
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("page_id", "host", "path")), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] or default for f in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    swept = together.repartition(n, "range").sortWithinPartitions("range", "key", "kind", "path")
    return swept.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string")
