"""Delimited text: what its dialect is, and its records, cut in parallel.

The dialect (delimiter, quote, escape, header) is searched on bounded samples
from several places of the first file, by how well its rows agree.

A record may go over several lines where a quoted value holds line ends, so a
block of a file can't tell where its first record starts. Each block is summed
up for both states that it may begin in, outside or inside a quoted value: the
state it ends in, and how many records start in it. The blocks' sums (one row a
block) are composed in order, which gives every block its state and the number
of its first record; then each is cut on its own, by as many tasks as it has
blocks. Only pieces of records that go over the end of a block are gathered.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What may stand between values, around them and before a quote in them, the most usual first.
DELIMITERS = (",", ";", "\t", "|")
QUOTES = ('"', "'", "")
ESCAPES = ('"', "\\")
HEAD = 65_536  # bytes of a sample
PLACES = 8  # samples


@dataclass(frozen=True)
class Dialect:
    """quote "" : values are never quoted. escape: what makes a quote inside a quoted value an ordinary character, the quote itself where it is doubled."""

    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    header: bool = True
    names: tuple[str, ...] = ()
    renamed: tuple[str, ...] = ()  # header names that stood twice or were empty

    def options(self) -> dict[str, str | bool]:
        """As Spark's readers call them."""
        return dict(sep=self.delimiter, quote=self.quote, escape=self.escape or "\\", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\0", emptyValue="", maxColumns=max(20_480, len(self.names) + 1))


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of the folder's files by name."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    own = [(s.getPath().toString(), s.getLen()) for s in (fs.globStatus(Path(path)) or []) if s.isFile()]
    own += [(s.getPath().toString(), s.getLen()) for d in (fs.globStatus(Path(path)) or []) if d.isDirectory() for s in fs.listStatus(d.getPath())]
    return sorted(f for f in own if not f[0].rsplit("/", 1)[-1].startswith(("_", ".")))


def samples(spark: SparkSession, path: str, size: int = HEAD, places: int = PLACES) -> list[str]:
    """Texts from the start and from evenly spaced places of the first file that isn't empty; those cut off by their ends lose what isn't a whole line."""
    own = next((f for f in files_of(spark, path) if f[1]), None)
    if own is None:
        return []
    name, length = own
    Path = spark._jvm.org.apache.hadoop.fs.Path
    stream = Path(name).getFileSystem(spark._jsc.hadoopConfiguration()).open(Path(name))
    out = []
    try:
        for start in sorted({0, *(length * k // places for k in range(1, places) if length > places * size)}):
            stream.seek(start)
            n = min(size, length - start)
            text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)).decode("utf-8", "replace").removeprefix("\ufeff")
            if start + n < length:
                text = text.rpartition("\n")[0] or text
            out.append(text.partition("\n")[2] if start else text)
    finally:
        stream.close()
    return [x for x in out if x.strip()]


def _rows(text: str, d: Dialect) -> list[list[str]]:
    csv.field_size_limit(sys.maxsize)
    how = dict(quoting=csv.QUOTE_NONE) if not d.quote else dict(quotechar=d.quote, doublequote=d.escape == d.quote, escapechar=None if d.escape == d.quote else d.escape)
    try:
        found = list(csv.reader([f"{x}\n" for x in text.replace("\0", " ").split("\n")], delimiter=d.delimiter, **how))
    except csv.Error:
        return []
    return [[v.rstrip("\r") if k == len(r) - 1 else v for k, v in enumerate(r)] for r in found if any(v.strip() for v in r)]


def _agreement(texts: Sequence[str], d: Dialect) -> tuple:
    """How well rows agree: the share of rows with the most usual number of values, if that is more than one, whether the first row has it, few values that begin or end with a quote still, many values."""
    rows = [r for t in texts for r in _rows(t, d)]
    if not rows:
        return (0.0, False, 0.0, 0)
    usual, share = _usual(rows)
    values = [v.strip() for r in rows for v in r]
    stray = sum(v[:1] in ("'", '"') and v[:1] == v[-1:] and len(v) > 1 or v[:1] == '"' or "\\\"" in v for v in values)
    return (round(share, 2) if usual > 1 else 0.0, len(rows[0]) == usual, -round(stray / len(values), 3), usual)


def _usual(rows: Sequence[Sequence[str]]) -> tuple[int, float]:
    """The most usual number of values, and the share of rows that have it."""
    sizes = np.bincount([len(r) for r in rows])
    usual = int(sizes[1:].argmax()) + 1
    return usual, float(sizes[usual] / len(rows))


def kind_of(value: str) -> str:
    """The narrowest of the types bigint, double, date, timestamp and boolean that a text has by its shape, else string."""
    if re.fullmatch(r"-?(0|[1-9][0-9]{0,17})", value):
        return "bigint"
    if re.fullmatch(r"-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", value) and not re.match(r"-?0[0-9]", value):
        return "double"
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
        return "date"
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?Z?", value):
        return "timestamp"
    return "boolean" if value.lower() in ("true", "false") else "string"


def _column_kind(values: Sequence[str]) -> str:
    kinds = {kind_of(v) for v in values}
    return kinds.pop() if len(kinds) == 1 else "double" if kinds == {"bigint", "double"} else "string"


def has_header(rows: Sequence[Sequence[str]], nulls: Sequence[str] = ("",)) -> bool:
    """Whether the first row are names: it doesn't have the types of a column below it that are no texts. Where all columns are texts it is taken for one, as it is where there are no other rows."""
    if len(rows) > 1 and len(rows[0]) != _usual(rows)[0]:
        rows = [r for r in rows if len(r) == _usual(rows)[0]]
    below = [r for r in rows[1:] if len(r) == len(rows[0])]
    kinds = [_column_kind([r[k] for r in below if r[k] not in nulls]) for k in range(len(rows[0]))]
    if not below or all(k == "string" for k in kinds):
        return True
    fits = lambda v, kind: v in nulls or kind == "string" or _column_kind([v]) == kind or kind == "double" and kind_of(v) == "bigint"
    return not all(fits(v, kind) for v, kind in zip(rows[0], kinds))


def _named(first: Sequence[str], header: bool) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(names, those of the header that had to be changed): places where there is no name, a number after one that stood before (names compare without case)."""
    digits = len(str(max(len(first) - 1, 0)))
    names, taken, changed = [], set(), []
    for k, value in enumerate(first):
        own = name = value.strip("\r") if header and value.strip() else f"column{k:0{digits}d}"
        n = 0
        while name.lower() in taken:
            n += 1
            name = f"{own}_{n}"
        if header and name != value.strip("\r"):
            changed.append(value)
        taken.add(name.lower())
        names.append(name)
    return tuple(names), tuple(changed)


def find_dialect(texts: Sequence[str], nulls: Sequence[str] = ("",), delimiter: str | None = None, quote: str | None = None, escape: str | None = None, header: bool | None = None) -> Dialect:
    """The dialect of samples, the first from the file's start; what is given isn't searched. Of equally good ones the most usual."""
    if not texts:
        return Dialect(delimiter or ",", '"' if quote is None else quote, escape or quote or '"', header is not False)
    best = None
    for d in [delimiter] if delimiter else DELIMITERS:
        for q in [quote] if quote is not None else QUOTES:
            for e in [escape] if escape else [q, "\\"] if q else [""]:
                one = Dialect(d, q, e)
                score = _agreement(texts, one)
                if best is None or score > best[0]:
                    best = (score, one)
    rows = _rows(texts[0], best[1])
    if not rows:
        return replace(best[1], header=header is not False)
    names_first = has_header(rows, [*nulls, ""]) if header is None else header
    names, renamed = _named(rows[0] if names_first else [""] * _usual(rows)[0], names_first)
    return replace(best[1], header=names_first, names=names, renamed=renamed)


def ends_inside(line: str, inside: bool, d: Dialect) -> bool:
    """Whether a quoted value is open at the end of line, if one was (or not) at its start."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(d.quote, at):
                at = line.find(d.delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            k = line.find(d.quote, at)
            if k < 0:
                return True
            if d.escape == d.quote:
                if not line.startswith(d.quote, k + 1):
                    break
                at = k + 2
            else:
                before = len(line[at:k]) - len(line[at:k].rstrip(d.escape))
                at = k + 1
                if before % 2 == 0:
                    break
        inside, at = False, line.find(d.delimiter, k + 1) + 1
        if not at:
            return False


def quoted_line_ends(lines: DataFrame, d: Dialect) -> bool:
    """Whether any line holds an odd number of quotes that aren't escaped, as one that ends inside a quoted value does."""
    if not d.quote:
        return False
    value = F.col("value") if d.escape == d.quote else F.replace("value", F.lit(d.escape + d.quote), F.lit(""))
    return not lines.filter((F.length(value) - F.length(F.replace(value, F.lit(d.quote)))) % 2 == 1).isEmpty()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], np.ndarray, bool]]:
    """(file, start, lines, which of them hold a quote, whether they continue the block before) of stretches of lines of one block."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("start").to_numpy()
        files = pc.dictionary_encode(batch.column("file"))
        code = files.indices.to_numpy()
        edges = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (code[1:] != code[:-1])])
        lines, quoted = batch.column("value").to_pylist(), batch.column("quoted").to_numpy(zero_copy_only=False)
        for a, b in zip(edges, np.r_[edges[1:], batch.num_rows]):
            own = (files.dictionary[code[a]].as_py(), int(start[a]))
            yield *own, lines[a:b], quoted[a:b], own == last
            last = own


def _summed(d: Dialect):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for file, start, lines, quoted, more in _blocks(batches):
            if not more:
                if now:
                    done.append(now)
                now = [file, start, False, True, 0, 0]  # for both states at the start: the state now, records started
            blank = np.array([not x.strip() for x in lines])
            for k in (0, 1):
                at = 0
                for q in [*np.flatnonzero(quoted).tolist(), len(lines)]:
                    if not now[2 + k]:  # all lines between are records
                        now[4 + k] += int(np.count_nonzero(~blank[at:q])) + (q < len(lines) and not blank[q])
                    if q < len(lines):
                        now[2 + k] = ends_inside(lines[q], now[2 + k], d)
                    at = q + 1
        if now:
            done.append(now)
        names = ["file", "start", "end0", "end1", "records0", "records1"]
        yield pa.RecordBatch.from_pydict({n: [x[k] for x in done] for k, n in enumerate(names)}, schema=pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]))))

    return run


def _cut(d: Dialect, pieces: bool):
    """Records of blocks whose state and first record's place are known: whole ones with piece -1, or those over a block's end, in pieces by block. Headers are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        inside = over = skip = heads = False
        place = piece = 0
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            at = 0
            for file, start, lines, quoted, _ in _blocks(iter([batch])):
                if (file, start) != block:
                    if held and pieces and not skip:
                        out.append((place, piece, "\n".join(held)))
                    known = batch.slice(at, 1).select(["inside", "before", "skips", "heads"]).to_pylist()[0]
                    inside, place, skip, heads = known["inside"], known["before"], known["skips"], known["heads"]
                    block, held, over, piece = (file, start), [], inside, start
                at += len(lines)
                for line, has in zip(lines, quoted):
                    if not inside:
                        if not line.strip():
                            continue
                        place, over, skip, heads = place + (not heads), False, heads, False
                    inside = ends_inside(line, inside, d) if has else inside
                    held.append(line)
                    if not inside:
                        if over == pieces and not skip:
                            out.append((place, piece if over else -1, "\n".join(held)))
                        held, over, skip = [], False, False
            yield _pieces(out)
        if held and pieces and not skip:
            yield _pieces([(place, piece, "\n".join(held))])

    return run


def _pieces(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["place", "piece", "record"])


def records(spark: SparkSession, path: str, d: Dialect) -> DataFrame:
    """(record, place from 1 in file order, unclosed) of all records but each file's header; blank lines between them are none. unclosed: a quoted value is open at the file's end."""
    scan = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = scan.withColumn("quoted", F.contains("value", F.lit(d.quote)))
    sums = lines.mapInArrow(_summed(d), "file string, start long, end0 boolean, end1 boolean, records0 long, records1 long").collect()  # one row a block
    known, unclosed, before, last = [], [], 0, None
    inside = skips = False
    header = d.header
    for r in sorted(sums, key=lambda r: (r["file"], r["start"])):
        if r["file"] != last:
            unclosed += [before] if inside else []
            inside, skips, header, last = False, False, d.header, r["file"]
        n = r["records1" if inside else "records0"]
        heads = header and n > 0
        known.append((r["file"], r["start"], inside, before, skips, heads))
        inside = r["end1" if inside else "end0"]
        before += n - heads
        skips = inside and (heads and n == 1 or skips and n == 0)
        header = header and not heads
    unclosed += [before] if inside else []
    ready = lines.join(F.broadcast(spark.createDataFrame(known, "file string, start long, inside boolean, before long, skips boolean, heads boolean")), ["file", "start"])
    schema = "place long, piece long, record string"
    found = ready.mapInArrow(_cut(d, False), schema).select("place", "record", F.lit(False).alias("unclosed"))
    if unclosed or any(k[2] for k in known):
        parts = ready.mapInArrow(_cut(d, True), schema).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("piece", "record"))).alias("p"))
        open_ = F.broadcast(spark.createDataFrame([(x,) for x in unclosed], "place long").withColumn("_open", F.lit(True)))  # at most one a file
        found = found.unionByName(parts.join(open_, "place", "left").select("place", F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"), F.col("_open").isNotNull().alias("unclosed")))
    return found.select(F.regexp_replace("record", "\r$", "").alias("record"), "place", "unclosed")
