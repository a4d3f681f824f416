"""Edit distance and nearest values of a vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WITHIN = 3


def distance(a: str, b: str) -> int:
    """Levenshtein distance, for names on the driver."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest_name(value: str, names: Sequence[str], within: int = WITHIN) -> str | None:
    """The first of the closest names that differ by less than within edits."""
    best = min(((distance(value, n), k) for k, n in enumerate(names)), default=(within, 0))
    return names[best[1]] if best[0] < within else None


def nearest(value: Column, vocabulary: Sequence[str], within: int = WITHIN) -> Column:
    """nearest_name as a column expression; vocabularies are metadata of the checks and thus small."""
    if not vocabulary:
        return F.lit(None).cast("string")
    ways = [F.struct(F.levenshtein(value, F.lit(v)).alias("edits"), F.lit(k).alias("place"), F.lit(v).alias("own")) for k, v in enumerate(vocabulary)]
    best = F.array_min(F.array(*ways))
    return F.when(best["edits"] < within, best["own"])
