"""Row-local checks on streams.

They keep no state, so the batch expressions run on a streaming DataFrame as
they are; only the cap per constraint, a window over all rows, is left out. For
counts per event-time window the stream needs a watermark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import field_violations
from ..operators.constraints import Constraint


def stream_violations(stream: DataFrame, fields: Mapping[str, tuple[str, Sequence[Constraint]]], row: str) -> DataFrame:
    """Violations of stream, whose column row identifies its rows."""
    return field_violations(stream, fields, limit=None, row=row)


def violations_per_window(violations: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Counts by tag and severity in windows of event time; rows later than late are dropped."""
    return violations.withWatermark(time, late).groupBy(F.window(time, window), "tag", "severity").agg(F.count(F.lit(1)).alias("n"))
