"""Constraints on one field, each a column predicate for the rows that break it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

STRICTNESS = {"required": 3, "recommended": 2, "optional": 1}
SEVERITY = {"required": "error", "recommended": "warning", "optional": "info"}
FORMATS = ("iso8601", "url", "uuid", "decimal-degrees", "integer", "email")


class ConstraintError(ValueError):
    """A constraint that can't be meant."""


@dataclass(frozen=True)
class Range:
    min: float | None = None
    max: float | None = None
    inclusive: bool = True
    message: str | None = None
    type = "range"
    tag = "RangeViolation"

    def __post_init__(self):
        if self.min is None and self.max is None:
            raise ConstraintError("a range needs min or max")
        if self.min is not None and self.max is not None and self.min > self.max:
            raise ConstraintError("min must not be over max")

    def broken(self, text: Column, number: Column | None = None) -> Column:
        """Only values that are numbers can break a range. number: the value where its column is numeric, which spares its text."""
        x = tx.to_double(text) if number is None else number
        low = None if self.min is None else x < self.min if self.inclusive else x <= self.min
        high = None if self.max is None else x > self.max if self.inclusive else x >= self.max
        return low if high is None else high if low is None else low | high

    def explain(self, text: Column, field: str) -> Column:
        return F.lit(self.message or "Value out of range")

    def params(self, text: Column) -> dict[str, Column]:
        return {k: F.lit(str(v)) for k, v in (("min", self.min), ("max", self.max)) if v is not None}


@dataclass(frozen=True)
class Format:
    format: str
    message: str | None = None
    type = "format"
    tag = "FormatViolation"

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ConstraintError(f"unknown format {self.format!r}")

    def broken(self, text: Column, number: Column | None = None) -> Column:
        if number is not None and self.format == "decimal-degrees":
            return F.lit(False)
        return tx.is_present(text) & ~tx.has_format(text, self.format)

    def explain(self, text: Column, field: str) -> Column:
        return F.lit(self.message) if self.message else F.concat(F.lit('Value "'), text, F.lit(f'" is not of format {self.format}'))

    def params(self, text: Column) -> dict[str, Column]:
        return {"format": F.lit(self.format)}


def _automaton_takes(pattern: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


@lru_cache(maxsize=256)
def _by_automaton(pattern: str):
    """A column function that tells whether pattern is found anywhere in a text; null for null."""

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return found


@dataclass(frozen=True)
class Pattern:
    pattern: str
    flags: str | None = None  # told in results, never applied
    message: str | None = None
    type = "pattern"
    tag = "PatternViolation"

    def __post_init__(self):
        try:
            re.compile(self.pattern)
        except re.error as e:
            raise ConstraintError(f"invalid pattern: {e}") from e

    @property
    def usable(self) -> bool:
        """Look-around and back-references pass the config but not the matchers of the checks, nor what an automaton can't be made of."""
        return not re.search(r"\(\?<?[=!]|\\[1-9]", self.pattern) and (not self.repeats_groups or _automaton_takes(self.pattern))

    @property
    def repeats_groups(self) -> bool:
        """Whether a group is repeated without a small bound. Java's matcher recurses for each turn of such a repeat, and may try all ways through nested ones."""
        plain = re.sub(r"\[\^?\]?[^\]]*\]", "x", re.sub(r"\\.", "x", self.pattern, flags=re.S))
        return bool(re.search(r"\)([*+]|\{\d+,\}|\{(\d+,)?\d{2,}\})", plain))

    def broken(self, text: Column, number: Column | None = None) -> Column:
        """Simple patterns stay in the JVM; those that repeat groups are matched by an automaton over Arrow batches, in linear time and without a stack."""
        return tx.is_present(text) & ~(_by_automaton(self.pattern)(text) if self.repeats_groups else text.rlike(self.pattern))

    def explain(self, text: Column, field: str) -> Column:
        return F.lit(self.message) if self.message else F.concat(F.lit('Value "'), text, F.lit(f'" does not match pattern /{self.pattern}/'))

    def params(self, text: Column) -> dict[str, Column]:
        return {"pattern": F.lit(self.pattern), **({"flags": F.lit(self.flags)} if self.flags else {})}


@dataclass(frozen=True)
class Length:
    min_length: int | None = None
    max_length: int | None = None
    message: str | None = None
    type = "length"
    tag = "LengthViolation"

    def __post_init__(self):
        if self.min_length is None and self.max_length is None:
            raise ConstraintError("a length needs minLength or maxLength")
        if self.min_length is not None and self.max_length is not None and self.min_length > self.max_length:
            raise ConstraintError("minLength must not be over maxLength")

    def broken(self, text: Column, number: Column | None = None) -> Column:
        n = F.length(text)
        low = F.lit(False) if self.min_length is None else n < self.min_length
        high = F.lit(False) if self.max_length is None else n > self.max_length
        return text.isNotNull() & (low | high)

    def explain(self, text: Column, field: str) -> Column:
        return F.lit(self.message) if self.message else F.concat(F.lit("Length "), F.length(text).cast("string"), F.lit(" is out of bounds"))

    def params(self, text: Column) -> dict[str, Column]:
        bounds = {k: F.lit(str(v)) for k, v in (("minLength", self.min_length), ("maxLength", self.max_length)) if v is not None}
        return {**bounds, "actualLength": F.length(text).cast("string")}


@dataclass(frozen=True)
class Required:
    level: str = "required"
    allow_empty: bool = False
    allow_whitespace: bool = False
    message: str | None = None
    type = "required"
    tag = "RequiredFieldViolation"

    def __post_init__(self):
        if self.level not in STRICTNESS:
            raise ConstraintError(f"unknown level {self.level!r}")

    @property
    def severity(self) -> str:
        return SEVERITY[self.level]

    def broken(self, text: Column, number: Column | None = None) -> Column:
        if number is not None:
            return number.isNull()
        if not self.allow_empty:
            return tx.is_absent(text)
        if not self.allow_whitespace:
            return text.isNull() | ((F.length(text) > 0) & tx.is_blank(text))
        return text.isNull()

    def explain(self, text: Column, field: str) -> Column:
        return F.lit(self.message or f'Required field "{field}" is empty or null')

    def params(self, text: Column) -> dict[str, Column]:
        return {}


@dataclass(frozen=True)
class Unique:
    message: str | None = None
    type = "unique"
    tag = "UniquenessViolation"


Constraint = Range | Format | Pattern | Length | Required | Unique


def strictest(constraints: Sequence[Constraint]) -> Required | None:
    """The strictest Required, of equally strict ones the first."""
    return max((c for c in constraints if isinstance(c, Required)), key=lambda c: STRICTNESS[c.level], default=None)


def effective(constraints: Sequence[Constraint]) -> list[Constraint]:
    """In the order of checking: the strictest Required only, then all of each other kind; Unique is not row-local and left out."""
    required = strictest(constraints)
    return ([required] if required else []) + [c for kind in (Range, Format, Pattern, Length) for c in constraints if isinstance(c, kind)]
