"""Conditional presence rules inside one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .checks import LIMIT, ROW, VIOLATION, Check, _params, row_violations
from .constraints import SEVERITY


@dataclass(frozen=True)
class When:
    """field present; with equals or among, its text equal to one of the values."""

    field: str
    equals: str | None = None
    among: tuple[str, ...] = ()

    def holds(self) -> Column:
        text = F.col(f"`{self.field}`").cast("string")
        if self.equals is not None:
            return text == self.equals
        return text.isin(*self.among) if self.among else tx.is_present(text)

    def told(self) -> str:
        if self.equals is not None:
            return f"when {self.field} equals '{self.equals}'"
        return f"when {self.field} is one of [{', '.join(self.among)}]" if self.among else f"when {self.field} is present"


@dataclass(frozen=True)
class Dependency:
    """All of the fields, or with one_of at least one, must be present (where when holds)."""

    require: tuple[str, ...]
    one_of: bool = False
    when: When | None = None
    level: str = "required"
    message: str | None = None
    dataset: str | None = None

    @property
    def fields(self) -> list[str]:
        return [*([self.when.field] if self.when else []), *self.require]

    def told(self) -> str:
        if self.message:
            return self.message
        names = ", ".join(self.require)
        if self.one_of:
            return f"At least one of [{names}] required {self.when.told()}" if self.when else f"At least one of [{names}] must be present"
        return f"[{names}] required {self.when.told()}" if self.when else f"Fields [{names}] are required"

    def broken(self) -> Column:
        absent: Sequence[Column] = [tx.is_absent(F.col(f"`{f}`").cast("string")) for f in self.require]
        out = absent[0]
        for a in absent[1:]:
            out = (out & a) if self.one_of else (out | a)
        return out & self.when.holds() if self.when else out

    def check(self) -> Check:
        name = ", ".join(self.require)
        return Check(self.broken(), "DependencyViolation", SEVERITY[self.level], name, name, F.lit(""), F.lit(self.told()), _params({}))


def dependency_violations(df: DataFrame, *rules: Dependency, limit: int | None = LIMIT, row: str = ROW) -> DataFrame:
    """The rows that break rules, in one scan whatever their number, at most limit a rule by row number; nothing for a rule of which df lacks a field."""
    checks = [r.check() for r in rules if all(f in df.columns for f in r.fields)]
    return row_violations(df, checks, limit, row) if checks else df.sparkSession.createDataFrame([], VIOLATION)
