"""The transformation of input tables into target tables, as the configuration tells it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import TYPES, DialectError, Token, adapt, add_functions, closing, joined, solid, split, tokens, unordered, unquoted, with_places
from ..functions.dialect import statements as separate
from ..operators.integrity import Rules, Vocabulary, integrity_violations, judge
from ..sources import sinks
from ..sources.tables import ROW, check_inputs, dialect_of, numbered, read_csv, table_name, typed
from . import dictionary
from .lineage import cut, staged
from .config import TransformConfig

Value = str | float | int | None
PLACE = "_place"
REJECTED = "_rejected"


class TransformError(ValueError):
    """A statement or a row that the transformation can't take."""


def _expression(value: Value) -> str:
    return "NULL" if value is None else str(value)


CLAUSES = ("from", "where", "group", "having", "order", "limit", "offset", "union", "intersect", "except", "qualify", "window")
JOINS = ("join", "inner", "left", "right", "full", "outer", "cross", "natural", "semi", "anti")


def _has_places(parts: list[Token]) -> bool:
    return any(unordered(parts, k) is not None for k, t in enumerate(parts) if t == "row_number")


def _clauses(parts: list[Token]) -> dict[str, list[Token]]:
    """The clauses of one SELECT by their first words, in order."""
    out: dict[str, list[Token]] = {"select": []}
    depth, now = 0, "select"
    for t in parts[1:]:
        if t.kind == "mark":
            depth += (t.text in "([") - (t.text in ")]")
        word = t.text.lower()
        if not depth and t.kind == "word" and word in CLAUSES:
            if word in out or word in ("union", "intersect", "except", "qualify", "window"):
                raise DialectError(f"row_number() OVER () can't be told in a SELECT with {t.text}")
            now, out[word] = word, []
        else:
            out[now].append(t)
    return out


def _aliases(source: list[Token]) -> list[str]:
    """The names by which the tables of a FROM clause are called."""
    out = []
    for part in split(source, ",", *JOINS):
        own = solid(split(part, "on", "using")[0])
        if own:
            out.append(unquoted(own[-1].text))
    return out


def _name_of(item: list[Token]) -> str:
    """The name of an item of a SELECT list."""
    own = solid(item)
    if own[-1].kind not in ("word", "name"):
        raise DialectError(f"{joined(item).strip()!r} needs a name beside row_number() OVER ()")
    return unquoted(own[-1].text)


def _view(spark: SparkSession, rows: DataFrame, order: list[str]) -> str:
    """A view of rows, written, with PLACE, a number from 1 in the order given or in which they lie; no task sees all of them."""
    view = f"places_{uuid.uuid4().hex}"
    numbered(cut(rows.orderBy(*order) if order else rows), PLACE).createOrReplaceTempView(view)
    return view


def with_numbers(spark: SparkSession, sql: str) -> str:
    """sql in which each SELECT with unordered row numbers reads them as a column of a view of its rows.

    The rows of its FROM and WHERE (or, where it groups, its groups) are written
    and numbered by offsets of their partitions, in the order of the sources'
    own row numbers where they have such.
    """
    parts = tokens(sql)
    if not _has_places(parts):
        return sql
    out, k = [], 0
    while k < len(parts):  # inner ones first
        if parts[k] == "(" and parts[k].kind == "mark" and any(t == "select" for t in solid(parts[k + 1 :])[:1]):
            end = closing(parts, k)
            out += tokens("(" + with_numbers(spark, joined(parts[k + 1 : end])) + ")")
            k = end
        else:
            out.append(parts[k])
        k += 1
    parts = out[next((n for n, t in enumerate(out) if t.kind != "space"), 0) :]
    if not _has_places(parts) or parts[0] != "select":
        return joined(parts)
    own = _clauses(parts)
    source, where = joined(own.get("from", [])), joined(own.get("where", []))
    rest = " ".join(f"{w.upper()} {joined(own[w])}" for w in ("order", "limit", "offset") if w in own)
    items = split([t for t in own["select"] if t != "distinct"], ",")  # numbered rows are distinct
    if "group" in own:
        names = [_name_of(i) for i in items]
        kept = [i for i in items if not _has_places(i)]
        group = f"GROUP BY {joined(own['group']).strip().removeprefix('BY').removeprefix('by')}" + (f" HAVING {joined(own['having'])}" if "having" in own else "")
        view = _view(spark, spark.sql(adapt(f"SELECT {','.join(map(joined, kept))} FROM {source}" + (f" WHERE {where}" if where else "") + f" {group}")), [])
        told = [f"`{n}`" if not _has_places(i) else f"{with_places(joined(_unnamed(i)), PLACE)} AS `{n}`" for i, n in zip(items, names)]
        return f"SELECT {', '.join(told)} FROM {view} {rest}"
    names = _aliases(own["from"])
    if len(names) == 1:
        rows = spark.sql(adapt(f"SELECT * FROM {source}" + (f" WHERE {where}" if where else "")))
        view = _view(spark, rows, [ROW] if ROW in rows.columns else [])
        listed, called = with_places(joined(own["select"]), PLACE), f" AS `{names[0]}`"
        listed = joined([Token("word", ", ".join(f"`{c}`" for c in rows.columns)) if [t.text for t in solid(i)] == ["*"] else Token("word", joined(i)) for i in _commas(split(tokens(listed), ","))])
    else:
        structs = ", ".join(f"struct(`{n}`.*) AS `{n}`" for n in names)
        rows = spark.sql(adapt(f"SELECT {structs} FROM {source}" + (f" WHERE {where}" if where else "")))
        fields = {n: [f.name for f in rows.schema[n].dataType.fields] for n in names}
        once = [c for n in names for c in fields[n] if sum(c in f for f in fields.values()) == 1 and c not in names]
        view = _view(spark, rows, [f"{n}.{ROW}" for n in names if ROW in fields[n]])
        spark.table(view).select("*", *[F.col(f"`{n}`.`{c}`").alias(c) for n in names for c in fields[n] if c in once]).createOrReplaceTempView(view)
        every = ", ".join(f"`{n}`.*" for n in names)
        listed, called = ", ".join(every if [t.text for t in solid(i)] == ["*"] else with_places(joined(i), PLACE) for i in items), ""
    return f"SELECT {listed} FROM {view}{called} {rest}"


def _commas(items: list[list[Token]]) -> list[list[Token]]:
    """items with commas between them."""
    return [x for k, i in enumerate(items) for x in (([[Token("mark", ",")]] if k else []) + [i])]


def _unnamed(item: list[Token]) -> list[Token]:
    """An item of a SELECT list without its name."""
    return split(item, "as")[0]


def project(spark: SparkSession, tables: Mapping[str, DataFrame], sources: Mapping[str, str], fields: Mapping[str, Value]) -> DataFrame:
    """SELECT the fields' expressions FROM the sources, comma-joined: each alias is a table's name or a bracketed subquery.

    Fields may use those listed before them. Unordered row numbers, of fields
    or inside subqueries, are numbers of the rows as they are written, so that
    no task sees all of them.
    """
    add_functions(spark)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    froms = ", ".join(f"{s.strip()} AS `{alias}`" if re.search(r"\s", s.strip()) else f"`{s.strip()}` AS `{alias}`" for alias, s in sources.items())
    select = ", ".join(f"{_expression(v)} AS `{k}`" for k, v in fields.items())
    return spark.sql(adapt(with_numbers(spark, f"SELECT {select} FROM {froms}")))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """df without the columns that hold no value, all counted in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for k, c in enumerate(df.columns) if counts[k]])


def _words(parts: list[Token], *want: str | None) -> list[str] | None:
    """The names at the places of None if the parts begin with the wanted words ("x?": may be left out)."""
    own, out, k = solid(parts), [], 0
    for w in want:
        here = own[k] if k < len(own) else None
        if w is None:
            if here is None or here.kind not in ("word", "name"):
                return None
            out.append(unquoted(here.text))
        elif here is not None and here == w.removesuffix("?"):
            pass
        elif w.endswith("?"):
            continue
        else:
            return None
        k += 1
    return out + [str(k)]


def _after(parts: list[Token], n: int) -> list[Token]:
    """parts without the first n that aren't spaces."""
    k = 0
    while n:
        n -= parts[k].kind != "space"
        k += 1
    return parts[k:]


def _sections(parts: list[Token], *words: str) -> dict[str, str]:
    """Texts after each of the words that stand outside brackets, "" what stands before the first."""
    out, depth, now = {"": []}, 0, ""
    for t in parts:
        if t.kind == "mark":
            depth += (t.text in "([") - (t.text in ")]")
        if not depth and t.kind == "word" and t.text.lower() in words and t.text.lower() not in out:
            now = t.text.lower()
            out[now] = []
        else:
            out[now].append(t)
    return {k: joined(v).strip() for k, v in out.items()}


class Tables(dict):
    """Tables by name, found without regard to case."""

    def own(self, name: str) -> str:
        found = next((t for t in self if t.lower() == name.lower()), None)
        if found is None:
            raise TransformError(f"there is no table {name!r}")
        return found


def _type(text: str) -> str:
    return TYPES.get(text.lower(), text)


def _altered(df: DataFrame, parts: list[Token], what: str) -> DataFrame | None:
    if m := _words(parts, "add", "column?", "if?", "not?", "exists?", None):
        name, kind = m[0], joined(_after(parts, int(m[-1]))).strip()
        if not kind:
            return None
        taken = name.lower() in {c.lower() for c in df.columns}
        if taken and "exists" not in [t.text.lower() for t in solid(parts)[:5]]:
            raise TransformError(f"{what}: there is a column {name!r} already")
        return df if taken else df.withColumn(name, F.lit(None).cast(_type(kind)))
    if m := _words(parts, "drop", "column?", "if?", "exists?", None):
        return df.drop(m[0])
    if m := _words(parts, "rename", "column?", None, "to", None):
        return df.withColumnRenamed(m[0], m[1])
    if m := _words(parts, "alter", "column?", None, "set?", "data?", "type", None):
        return df.withColumn(m[0], F.expr(f"CAST(`{m[0]}` AS {_type(joined(_after(parts, int(m[-1]) - 1)).strip())})"))
    return None


def _updated(spark: SparkSession, tables: Tables, parts: list[Token], what: str) -> None:
    own = _sections(parts, "set", "from", "where")
    head = solid(tokens(own[""]))
    name = tables.own(unquoted(head[0].text)) if head else ""
    called = unquoted(head[-1].text) if head else ""
    sets = [split(i, "=") for i in split(tokens(own.get("set", "")), ",")]
    if not head or any(len(s) < 2 for s in sets):
        raise TransformError(f"can't run {what!r}")
    new = {unquoted(solid(s[0])[-1].text): joined(i[len(s[0]) + 1 :]).strip() for i, s in zip(split(tokens(own["set"]), ","), sets)}
    df = tables[name]
    column = {c: next((x for x in df.columns if x.lower() == c.lower()), None) for c in new}
    if lost := [c for c, x in column.items() if x is None]:
        raise TransformError(f"{what}: {name} has no column {lost[0]!r}")
    if "from" not in own:
        view = f"one_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        held = {c: f"CASE WHEN {own['where']} THEN {e} ELSE `{called}`.`{column[c]}` END" if own.get("where") else e for c, e in new.items()}
        listed = ", ".join(next((f"{e} AS `{c}`" for c0, e in held.items() if column[c0] == c), f"`{called}`.`{c}`") for c in df.columns)
        tables[name] = spark.sql(adapt(f"SELECT {listed} FROM {view} AS `{called}`"))
        return
    rows = numbered(cut(df), "_target")  # each row may meet several of the others: the least new values are taken
    view = f"target_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    listed = ", ".join(f"{e} AS `_new{k}`" for k, e in enumerate(new.values()))
    met = spark.sql(adapt(f"SELECT `{called}`._target AS _met, struct({listed}) AS _new FROM {view} AS `{called}`, {own['from']}" + (f" WHERE {own['where']}" if own.get("where") else "")))
    least = met.groupBy("_met").agg(F.min("_new").alias("_new"))
    joined_ = rows.join(least, F.col("_target") == F.col("_met"), "left")
    values = {column[c]: F.when(F.col("_met").isNotNull(), F.col("_new").getField(f"_new{k}")).otherwise(F.col(f"`{column[c]}`")) for k, c in enumerate(new)}
    tables[name] = joined_.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def _inserted(spark: SparkSession, tables: Tables, parts: list[Token], what: str) -> None:
    own = solid(parts)
    name, df = tables.own(unquoted(own[0].text)), None
    df = tables[name]
    rest = _after(parts, 1)
    listed = [c for c in df.columns if c != ROW]
    by_name = _words(rest, "by", "name") is not None
    if by_name:
        rest = _after(rest, 2)
    elif solid(rest)[:1] and solid(rest)[0] == "(" and not any(t == "select" for t in solid(rest)[1:2]):
        at = next(k for k, t in enumerate(rest) if t.kind != "space")
        end = closing(rest, at)
        listed = [unquoted(joined(i).strip()) for i in split(rest[at + 1 : end], ",")]
        rest = rest[end + 1 :]
    more = spark.sql(adapt(with_numbers(spark, joined(rest))))
    if not by_name:
        if len(more.columns) != len(listed):
            raise TransformError(f"{what}: {len(listed)} columns, but {len(more.columns)} values")
        more = more.toDF(*listed)
    kinds = {c.lower(): (c, t) for c, t in df.dtypes}
    if lost := [c for c in more.columns if c.lower() not in kinds]:
        raise TransformError(f"{what}: {name} has no column {lost[0]!r}")
    more = more.select(*[F.col(f"`{c}`").cast(kinds[c.lower()][1]).alias(kinds[c.lower()][0]) for c in more.columns if c != ROW])
    if ROW in df.columns:
        more = numbered(cut(more)).withColumn(ROW, F.col(ROW) + (df.agg(F.max(ROW)).first()[0] or 0))
    tables[name] = df.unionByName(more, allowMissingColumns=True)


def after_import(spark: SparkSession, tables: Mapping[str, DataFrame], statements: list[str]) -> dict[str, DataFrame]:
    """tables after the statements, each of which makes a table anew from what it was.

    ALTER TABLE (add, drop, rename, retype a column; rename the table), UPDATE
    (also FROM other tables: of several matches the least new values), DELETE,
    INSERT (VALUES or SELECT, by place, listed columns or BY NAME), CREATE TABLE
    or VIEW AS, and DROP. Any other statement is an error.
    """
    add_functions(spark)
    made = Tables(tables)
    for whole in statements:
        for statement in separate(whole):
            parts = tokens(statement)
            for name, df in made.items():
                df.createOrReplaceTempView(name)
            try:
                if m := _words(parts, "alter", "table", "if?", "exists?", None):
                    name, rest = made.own(m[0]), _after(parts, int(m[-1]))
                    if to := _words(rest, "rename", "to", None):
                        made[to[0]] = made.pop(name)
                        continue
                    changed = _altered(made[name], rest, statement)
                    if changed is None:
                        raise TransformError(f"can't run {statement!r}")
                    made[name] = changed
                elif m := _words(parts, "update"):
                    _updated(spark, made, _after(parts, 1), statement)
                elif m := _words(parts, "delete", "from", None):
                    name, own = made.own(m[0]), _sections(_after(parts, 2), "using", "where")
                    if "using" in own:
                        raise TransformError(f"can't run {statement!r}")
                    made[name] = made[name].limit(0) if "where" not in own else spark.sql(adapt(f"SELECT * FROM `{name}` AS `{unquoted(solid(tokens(own['']))[-1].text)}` WHERE NOT coalesce({own['where']}, FALSE)"))
                elif _words(parts, "insert", "into"):
                    _inserted(spark, made, _after(parts, 2), statement)
                elif m := _words(parts, "create", "or?", "replace?", "temp?", "temporary?", "table?", "view?", "if?", "not?", "exists?", None, "as"):
                    made[m[0]] = spark.sql(adapt(with_numbers(spark, joined(_after(parts, int(m[-1]))))))
                elif m := _words(parts, "drop", "table?", "view?", "if?", "exists?", None):
                    found = next((t for t in made if t.lower() == m[0].lower()), None)
                    if found is None and "exists" not in [t.text.lower() for t in solid(parts)[:4]]:
                        raise TransformError(f"there is no table {m[0]!r}")
                    made.pop(found, None)
                else:
                    raise TransformError(f"can't run {statement!r}")
            except TransformError:
                raise
            except Exception as e:
                raise TransformError(f"can't run {statement!r}: {e}") from e
    return dict(made)


@dataclass
class TransformResult:
    tables: dict[str, DataFrame]
    files: list[str]
    database: str | None


def _target(spec: dictionary.ClassSpec, parts: list[DataFrame]) -> DataFrame:
    """The datasets of one class by name, in the order of the class's columns; missing ones are null."""
    known = [f.name for f in spec.fields.values()]
    typed_parts = []
    for p in parts:
        unknown = [c for c in p.columns if c not in spec.fields]
        if unknown:
            raise TransformError(f"{spec.name} has no field {unknown[0]!r}")
        typed_parts.append(p.select(*[F.col(f"`{c}`").cast(spec.fields[c].column_type).alias(c) for c in p.columns]))
    out = typed_parts[0]
    for p in typed_parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") if c in out.columns else F.lit(None).cast(spec.fields[c].column_type).alias(c) for c in known])


def _check(name: str, df: DataFrame, spec: dictionary.ClassSpec) -> None:
    """Raises for the first row that breaks the class's key or a vocabulary."""
    key = spec.key if spec.key in df.columns else None
    words = tuple(Vocabulary(f.name, f.name, f.values) for f in spec.fields.values() if f.enforced and f.name in df.columns)
    rules = Rules(name, (key, key) if key else None, vocabularies=words)
    df = numbered(cut(df))  # counted and numbered in two jobs, which over a shuffle may differ in their partitions
    first = integrity_violations(judge(df, rules), rules).orderBy("row_number").limit(1).collect()
    if first:
        raise TransformError(f"{name}: {first[0]['error_message']} (row {first[0]['row_number']})")


def transform(spark: SparkSession, config: TransformConfig, base: str = ".", out_base: str = ".", single_files: bool | None = None, check: bool = True) -> TransformResult:
    paths = {alias: _under(base, p) for alias, p in config.inputs.items()}
    check_inputs(spark, paths)
    tables, made = {}, []
    for a, p in paths.items():
        how = dialect_of(spark, p, ("",), config.delimiter, config.quote, config.escape, config.header)
        rows = staged(read_csv(spark, p, ("",), config.multiline, rejected=REJECTED, dialect=how), "input", made)
        first = rows.filter(F.col(REJECTED).isNotNull()).agg(F.min(F.struct(ROW, REJECTED)).alias("first")).first()["first"]
        if first is not None:
            raise TransformError(f"{a}: row {first[ROW]} does not fit the file's {len(how.names)} columns: {first[REJECTED][:200]!r}")
        tables[table_name(a)] = typed(rows.drop(REJECTED))
    tables = after_import(spark, tables, config.statements)
    by_class: dict[str, list[DataFrame]] = {}
    for d in config.datasets:
        spec = dictionary.find(d.class_name)
        if spec is None:
            raise TransformError(f"'{d.class_name}' is not a valid class")
        by_class.setdefault(spec.name, []).append(project(spark, tables, d.source, d.fields))
    targets = {}
    for name, parts in by_class.items():
        spec = dictionary.find(name)
        targets[name.lower()] = _target(spec, parts)
        if check:
            _check(name, targets[name.lower()], spec)
    files, database = [], None
    if config.output_dir is not None:
        folder = _under(out_base, config.output_dir)
        suffix = f"_{sinks.stamp()}" if config.timestamped else ""
        with sinks.Output(spark) as staged_output:  # all is switched once all is written
            for name, df in targets.items():
                used = {c for d in config.datasets if d.class_name.lower() == name for c in d.fields}
                out = drop_null_columns(df) if config.drop_null_columns else df.select(*[F.col(f"`{c}`") for c in df.columns if c in used])
                files.append(f"{folder}/{name}{suffix}.csv")
                sinks.stage_csv(out.drop(ROW), files[-1], staged_output, config.single_files if single_files is None else single_files)
            if config.export_db:
                database = f"{folder}/{config.db_name}"
                sinks.stage_database(targets, database, staged_output)
    return TransformResult(targets, files, database)


def _under(base: str, path: str) -> str:
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"
