"""Violations of field constraints and of rules between fields, all row-local ones of a table in one scan.

Each (field, constraint) pair and each rule is one boolean expression. Rows that
break none are dropped by one filter over all of them, which reaches the scan
where it is simple enough; values, messages and parameters are made for broken
pairs only. So K constraints and rules cost one pass over the columns they read. The cap per
constraint is a window limit that Spark applies before and after the exchange,
so at most ``limit`` rows a constraint and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.lineage import cut
from .constraints import Constraint, Pattern, Required, Unique, effective

ROW = "_row_number"
LIMIT = 100
VIOLATION = "tag string, severity string, field_name string, target_name string, row_number bigint, value string, error_message string, params map<string,string>"


def _text(df: DataFrame, name: str) -> Column:
    return tx.as_text(F.col(f"`{name}`"), dict(df.dtypes)[name])


def _params(params: Mapping[str, Column]) -> Column:
    flat = [x for k, v in params.items() for x in (F.lit(k), v)]
    return F.create_map(*flat).cast("map<string,string>") if flat else F.expr("cast(map() as map<string,string>)")


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _number(df: DataFrame, name: str) -> Column | None:
    return F.col(f"`{name}`").cast("double") if dict(df.dtypes)[name] in NUMERIC else None


def _by_check(values: Sequence[Column]) -> Column:
    """The value of the check at hand, computed for that one only."""
    out = F.when(F.col("_check") == 1, values[0])
    for k, v in enumerate(values[1:], 2):
        out = out.when(F.col("_check") == k, v)
    return out


def _constant(values: Sequence[str]) -> Column:
    return F.lit(values[0]) if len(set(values)) == 1 else F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_check"))


@dataclass(frozen=True)
class Check:
    """One judgement of a row: reads names the columns that value, message and params are made from."""

    broken: Column
    tag: str
    severity: str
    field: str
    target: str
    value: Column
    message: Column
    params: Column
    reads: tuple[str, ...] = ()


def row_violations(df: DataFrame, checks: Sequence[Check], limit: int | None = LIMIT, row: str = ROW) -> DataFrame:
    """The violations of all checks in one scan of df; at most limit per check, the least row numbers; None: all. A check that is null for a row isn't broken by it."""
    some = checks[0].broken
    for c in checks[1:]:
        some = some | c.broken
    hits = F.array_compact(F.array(*[F.when(c.broken, F.lit(k)) for k, c in enumerate(checks, 1)]))
    used = list(dict.fromkeys([row, *(name for c in checks for name in c.reads)]))
    found = df.filter(some).select(*[F.col(f"`{c}`") for c in used], F.explode(hits).alias("_check"))
    number = F.col(f"`{row}`").cast("bigint")
    if limit is not None:
        found = found.withColumn("_place", F.row_number().over(Window.partitionBy("_check").orderBy(number))).filter(F.col("_place") <= limit)
    return found.select(
        _constant([c.tag for c in checks]).alias("tag"),
        _constant([c.severity for c in checks]).alias("severity"),
        _constant([c.field for c in checks]).alias("field_name"),
        _constant([c.target for c in checks]).alias("target_name"),
        number.alias("row_number"),
        F.coalesce(_by_check([c.value for c in checks]), F.lit("")).alias("value"),
        _by_check([c.message for c in checks]).alias("error_message"),
        _by_check([c.params for c in checks]).alias("params"),
    )


def field_violations(df: DataFrame, fields: Mapping[str, tuple[str, Sequence[Constraint]]], limit: int | None = LIMIT, row: str = ROW, rules: Sequence[Check] = ()) -> DataFrame:
    """Row-local violations of df, whose column row numbers its rows.

    fields: column to (target name, constraints). At most limit per constraint,
    the least row numbers; None: all. A pattern that the matcher can't run gives
    one violation with row number 0. rules are judged in the same scan.
    """
    checks, unusable = [], []
    for name, (target, constraints) in fields.items():
        for c in effective(constraints):
            if isinstance(c, Pattern) and not c.usable:
                unusable.append((c.tag, "error", name, target, 0, "", f'Invalid regex pattern "/{c.pattern}/"', {"pattern": c.pattern}))
            else:
                text = _text(df, name)
                severity = c.severity if isinstance(c, Required) else "error"
                # broken is null where a value is: no violation
                checks.append(Check(c.broken(text, _number(df, name)), c.tag, severity, name, target, text, c.explain(text, name), _params(c.params(text)), (name,)))
    checks += rules
    out = df.sparkSession.createDataFrame(unusable, VIOLATION)
    if not checks:
        return out
    found = row_violations(df, checks, limit, row)
    return found.unionByName(out) if unusable else found


def duplicate_groups(df: DataFrame, key: str, limit: int | None = LIMIT, row: str = ROW) -> DataFrame:
    """(value, count, row_number), a row for each row of the values that occur more than once, the most frequent limit of them, ties by value.

    Nothing is gathered in lists: the few repeated values are written and joined.
    """
    text = _text(df, key)
    counted = df.select(text.alias("value")).filter("value is not null").groupBy("value").agg(F.count("value").alias("count")).filter("count > 1")
    top = counted if limit is None else counted.orderBy(F.desc("count"), "value").limit(limit)
    member = df.select(text.alias("value"), F.col(row).cast("bigint").alias("row_number"))
    return member.join(cut(top), "value").select("value", "count", "row_number")


def unique_violations(df: DataFrame, field: str, target: str | None = None, constraint: Unique | None = None, limit: int | None = LIMIT, row: str = ROW) -> DataFrame:
    """One violation per row of a repeated value; limit counts values, not rows. Nulls are never repeated.

    Rows are joined with the repeated values, which are written first, and not
    gathered in lists: a value that a third of all rows hold is a join that Spark
    can broadcast or split, not one group.
    """
    text = _text(df, field)
    counted = df.select(text.alias("value")).filter("value is not null").groupBy("value").agg(F.count("value").alias("n")).filter("n > 1")
    top = counted if limit is None else counted.orderBy(F.desc("n"), "value").limit(limit)
    member = df.select(text.alias("value"), F.col(row).cast("bigint").alias("row_number")).join(cut(top.select("value")), "value")
    message = F.lit(constraint.message) if constraint and constraint.message else F.concat(F.lit('Duplicate value: "'), F.col("value"), F.lit('"'))
    return member.select(F.lit(Unique.tag).alias("tag"), F.lit("error").alias("severity"), F.lit(field).alias("field_name"), F.lit(target or field).alias("target_name"), "row_number", "value", message.alias("error_message"), _params({}).alias("params"))
