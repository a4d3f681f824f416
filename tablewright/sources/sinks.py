"""Tables as CSV files and as folders of Parquet.

What is written goes to a place of its own beside its target first, by as many
tasks as there are. Only when all of a run is written is each target switched:
the old one is put aside, the new one takes its place, and the old one is
deleted last. Whatever fails before leaves the old result as it was.
"""

from __future__ import annotations

import csv
import io
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


class SinkError(OSError):
    """A result that could not be put in its place."""


def stamp(now: datetime | None = None) -> str:
    moment = (now or datetime.now(timezone.utc)).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return moment.replace(":", "-").replace(".", "-")


class Output:
    """Staged results and the targets that they will replace."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.staged = spark, []

    def _path(self, path: str):
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return own, own.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def beside(self, target: str) -> str:
        """A new name beside target, hidden from readers of its folder; it will replace target."""
        top, _, name = target.rstrip("/").rpartition("/")
        made = f"{top}/_{name}.{uuid.uuid4().hex}" if top or target.startswith("/") else f"_{name}.{uuid.uuid4().hex}"
        self.staged.append((made, target))
        return made

    def rename(self, old: str, new: str) -> None:
        path, fs = self._path(old)
        if not fs.rename(path, self._path(new)[0]):
            raise SinkError(f"could not rename {old} to {new}")

    def commit(self) -> None:
        """Switches all targets; if one can't be, those before it are put back."""
        done: list[tuple[str, str, str | None]] = []
        try:
            for made, target in self.staged:
                path, fs = self._path(target)
                old = f"{made}.old" if fs.exists(path) else None
                if old:
                    self.rename(target, old)
                done.append((made, target, old))
                self.rename(made, target)
        except Exception:
            for made, target, old in reversed(done):
                path, fs = self._path(target)
                if old:
                    fs.delete(path, True)
                    self.rename(old, target)
                elif (made, target) != self.staged[len(done) - 1]:
                    fs.delete(path, True)
            self.discard()
            raise
        for _, _, old in done:
            if old:
                path, fs = self._path(old)
                fs.delete(path, True)
        self.staged = []

    def discard(self) -> None:
        """Deletes what is staged."""
        for made, _ in self.staged:
            for path, fs in (self._path(made), self._path(f"{made}.parts")):
                fs.delete(path, True)
        self.staged = []

    def __enter__(self) -> Output:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.discard()


def _header(names: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(names)
    return out.getvalue()


def stage_csv(df: DataFrame, target: str, out: Output, single: bool = True) -> None:
    """Stages df as CSV: header, minimal quoting, quotes doubled, nulls empty and empty texts as \"\".

    single: one file, which the written parts are copied into in their order;
    otherwise a folder of part files, which is the way for large results.
    """
    options = dict(quote='"', escape='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    made = out.beside(target)
    if not single:
        df.write.csv(made, header=True, **options)
        return
    spark = df.sparkSession
    parts = f"{made}.parts"
    df.write.csv(parts, header=False, **options)
    folder, fs = out._path(parts)
    jvm = spark._jvm
    stream = out._path(made)[1].create(out._path(made)[0])
    try:
        stream.write(bytearray(_header(df.columns).encode()))
        for path in sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            source = fs.open(path)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
            finally:
                source.close()
    finally:
        stream.close()
        fs.delete(folder, True)


def stage_database(tables: dict[str, DataFrame], target: str, out: Output) -> None:
    """Stages each table as Parquet under the folder target/<name>; tables of earlier runs won't be there any more."""
    made = out.beside(target)
    for name, df in tables.items():
        df.write.parquet(f"{made}/{name}")


def write_csv(df: DataFrame, path: str, single: bool = True) -> str:
    """df as CSV at path; see stage_csv."""
    with Output(df.sparkSession) as out:
        stage_csv(df, path, out, single)
    return path


def write_database(tables: dict[str, DataFrame], folder: str) -> str:
    """The tables, and no others, as Parquet under folder/<name>."""
    if tables:
        with Output(next(iter(tables.values())).sparkSession) as out:
            stage_database(tables, folder, out)
    return folder
