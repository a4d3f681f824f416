"""Validation of all datasets of a configuration."""

from __future__ import annotations

import time
from collections.abc import Mapping as MappingType
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.suggest import nearest_name
from ..operators.checks import ROW, field_violations
from ..operators.constraints import SEVERITY, Unique
from ..operators.integrity import Reference, Rules, Vocabulary, accepted, integrity_violations, judge, used_columns
from ..operators.repeats import repeated_values
from ..sources.tables import check_inputs, dialect_of, is_parquet, read_table
from . import dictionary, profiles
from .config import Config, DatasetConfig
from .lineage import cut, removed, staged
from .relations import ForeignKey, Shape, infer, targets_first
from .resolution import Diagnostic, ResolvedField, active_variant, resolve_fields

REJECTED = "_rejected"
# The words of messages.
VERBS = {"required": "requires", "recommended": "strongly recommends", "optional": "recommends"}
# The texts of messages on columns and fields.
TEXTS = {
    "preset": "Unknown preset \"{name}\" for field '{target}'.",
    "preset_near": ' Did you mean "{near}"?',
    "origin": "Field '{name}' is specified in config but not found in the data.",
    "origin_near": " Possible alternative fields: {near}",
    "unmapped": "Source column '{name}' is not mapped to any Darwin Core field and will be ignored.",
    "unmapped_near": " Possible alternative columns: {near}",
    "unknown": "Unknown field '{name}' in profile '{profile}'",
    "not_found": "Field '{name}' is specified in config fieldMappings but not found in the dataset",
    "not_mapped": "Profile '{profile}' {verb} field '{name}' but it is not mapped in the dataset",
}


class InvalidDataset(ValueError):
    """A dataset that can't be validated at all."""


@dataclass(frozen=True)
class SchemaViolation:
    tag: str
    severity: str
    field_name: str
    target_name: str
    error_message: str
    params: dict[str, str] = field(default_factory=dict)


@dataclass
class DatasetResult:
    """violations: all of the dataset's, as a table that is written once and that counts and reports read."""

    name: str
    class_name: str
    rows: int
    violations: DataFrame
    schema: list[SchemaViolation]
    seconds: float = 0.0
    _counts: dict[str, int] | None = None

    @property
    def counts(self) -> dict[str, int]:
        if self._counts is None:
            found = {r["severity"]: r["n"] for r in self.violations.groupBy("severity").agg(F.count("tag").alias("n")).collect()}
            for v in self.schema:
                found[v.severity] = found.get(v.severity, 0) + 1
            self._counts = {s: found.get(s, 0) for s in ("error", "warning", "info")}
        return self._counts

    @property
    def status(self) -> str:
        return "fail" if self.counts["error"] else "warn" if self.counts["warning"] else "pass"


@dataclass
class Results:
    datasets: list[DatasetResult]
    warnings: list[str]
    notes: dict[str, list[Diagnostic]]
    seconds: float = 0.0

    @property
    def status(self) -> str:
        own = {d.status for d in self.datasets}
        return "fail" if "fail" in own else "warn" if "warn" in own else "pass"

    def summary(self) -> dict[str, int]:
        """A dataset with warnings only counts as passed, too."""
        return {
            "datasets": len(self.datasets),
            "passed": sum(d.status != "fail" for d in self.datasets),
            "warned": sum(d.status == "warn" for d in self.datasets),
            "failed": sum(d.status == "fail" for d in self.datasets),
            **{f"{s}s": sum(d.counts[s] for d in self.datasets) for s in ("error", "warning", "info")},
        }


def _told(text: str, near: str | None = None, **parts: str) -> str:
    return TEXTS[text].format(**parts) + (TEXTS[f"{text}_near"].format(near=near) if near else "")


def schema_violations(d: DatasetConfig, spec: profiles.Resolved, fields: MappingType[str, ResolvedField], columns: list[str]) -> list[SchemaViolation]:
    out = []
    origins = [m.origin for m in d.mappings]
    for m in d.mappings:
        if m.preset and m.preset not in profiles.PRESETS and m.origin in columns:
            near = nearest_name(m.preset, list(profiles.PRESETS))
            out.append(SchemaViolation("MissingMapping", "error", m.origin, m.target, _told("preset", near, name=m.preset, target=m.target)))
        if m.origin not in columns:
            near = nearest_name(m.origin, columns)
            out.append(SchemaViolation("MissingMapping", "error", m.origin, m.target, _told("origin", near, name=m.origin)))
    used = {f.origin for f in fields.values()}
    for c in columns:
        if c not in used and c not in (ROW, REJECTED):
            near = nearest_name(c, origins)
            out.append(SchemaViolation("UnmappedColumn", "info", c, c, _told("unmapped", near, name=c)))
    told = {m.target for m in d.mappings}
    for name, f in fields.items():
        if f.origin in columns:
            if name not in spec.base.fields:
                out.append(SchemaViolation("UnknownField", "error", f.origin, name, _told("unknown", name=name, profile=spec.name), {"profileId": spec.id}))
        elif name in told:
            out.append(SchemaViolation("MissingField", "error", name, name, _told("not_found", name=name), {"reason": "not_mapped"}))
        elif f.level:
            out.append(SchemaViolation("MissingField", SEVERITY[f.level], name, name, _told("not_mapped", name=name, profile=spec.name, verb=VERBS[f.level]), {"reason": "not_mapped"}))
    return out


def integrity_rules(d: DatasetConfig, spec: profiles.Resolved, variant: str, fields: MappingType[str, ResolvedField], columns: list[str], keys: list[ForeignKey], parents: dict[str, DataFrame]) -> Rules:
    own = {t: f.origin for t, f in fields.items() if f.origin in columns}
    key = next((t for t in own if spec.base.is_key(t)), None)
    told = {m.target for m in d.mappings}
    nulls = tuple((own[t], t) for t in own if t in told and t != key and fields[t].level == "required")
    words, types = [], []
    for t, origin in own.items():
        f = spec.base.fields.get(t)
        if f is None:
            continue
        if f.enforced:
            words.append(Vocabulary(origin, t, f.values, f"{spec.base.name}_{t}".lower(), SEVERITY[f.level(variant) or "recommended"]))
        elif f.type in ("integer", "date", "boolean", "decimal"):
            types.append((origin, "double" if f.type == "decimal" else f.type))
    references = tuple(
        Reference(own[k.source_field], k.source_field, k.target_dataset, k.target_field, SEVERITY[k.requirement])
        for k in keys
        if k.source_dataset == d.name and k.source_field in own and (k.target_dataset == d.name and key or k.target_dataset in parents and k.target_field in parents[k.target_dataset].columns)
    )
    return Rules(d.name, (own[key], key) if key else None, nulls, tuple(words), tuple(types), references, parents, "_kind", "_at")


def validate(spark: SparkSession, config: Config, base: str = ".", fail_fast: bool | None = None, classes: dict[str, dictionary.ClassSpec] | None = None, multiline: bool | None = None) -> Results:
    """Datasets are judged with those they refer to first, so that a child of a rejected row is rejected too, and told in the order of the configuration.

    A dataset is read when its turn comes, or when one before it refers to it:
    under fail_fast those behind a failed one aren't read beyond their columns' names.
    """
    began = time.time()
    v = config.validation
    if v is None:
        raise InvalidDataset("the configuration has no validation")
    variant, warning = active_variant(config.variant)
    path = lambda p: p if p.startswith("/") or "://" in p else f"{base.rstrip('/')}/{p}"
    check_inputs(spark, {d.name: path(d.path) for d in v.datasets})
    specs, fields, notes, known, how = {}, {}, {}, {}, {}
    told, made = [warning] if warning else [], []
    for d in v.datasets:
        spec = profiles.resolve(d.class_name, variant, classes)
        if spec is None:
            near = nearest_name(d.class_name, list(classes or dictionary.built_in()))
            raise InvalidDataset(f"'{d.class_name}' is not a valid class." + (f" Did you mean '{near}'?" if near else ""))
        specs[d.name], notes[d.name] = spec, []
        fields[d.name] = resolve_fields(spec, variant, d.mappings, notes[d.name])
        if is_parquet(d.path):
            known[d.name] = spark.read.parquet(path(d.path)).columns
        else:
            how[d.name] = dialect_of(spark, path(d.path), v.nulls, v.delimiter, v.quote, v.escape, v.header)
            known[d.name] = list(how[d.name].names)
            if how[d.name].renamed:
                told.append(f"{d.name}: column names that stand twice or are empty were changed: {', '.join(map(repr, how[d.name].renamed))}")
    shapes = [Shape(d.name, d.class_name, tuple(t for t, f in fields[d.name].items() if f.origin in known[d.name])) for d in v.datasets]
    keys = [*config.keys, *infer(shapes, config.keys)]
    targets = {k.target_dataset for k in keys}
    tables, judged, rules, parents = {}, {}, {}, {}
    by_name = {d.name: d for d in v.datasets}
    order = targets_first(list(by_name), keys)

    def judge_now(name: str) -> None:
        """Reads and judges a dataset, those it refers to before it; others aren't read."""
        if name in judged:
            return
        for k in keys:
            if k.source_dataset == name and k.target_dataset in by_name and order.index(k.target_dataset) < order.index(name):
                judge_now(k.target_dataset)
        d = by_name[name]
        if is_parquet(d.path):
            tables[name] = read_table(spark, path(d.path))
        else:  # text is parsed once, not for each check
            tables[name] = staged(read_table(spark, path(d.path), v.nulls, v.multiline if multiline is None else multiline, rejected=REJECTED, dialect=how[name]), "input", made)
        columns = [c for c in tables[name].columns if c not in (ROW, REJECTED)]
        rules[name] = integrity_rules(d, specs[name], variant, fields[name], columns, keys, dict(parents))
        referred = [(f.origin, t) for t, f in fields[name].items() if f.origin in columns and t in {k.target_field for k in keys}] if name in targets else []
        read = list(dict.fromkeys([*used_columns(rules[name]), *(origin for origin, _ in referred)]))
        judged[name] = staged(judge(tables[name], rules[name]).select(*[F.col(f"`{c}`") for c in read]), "judged", made)  # judged once; only what violations and children read
        if name in targets:
            parents[name] = accepted(judged[name], referred, rules[name].kind)

    out = []
    for d in v.datasets:
        since = time.time()
        judge_now(d.name)
        result = _dataset(d, tables[d.name], specs[d.name], fields[d.name], judged[d.name], rules[d.name], config, v.limit)
        result.seconds = time.time() - since
        out.append(result)
        if (v.fail_fast if fail_fast is None else fail_fast) and result.status == "fail":
            break
    removed(spark, made)  # violations are tables of their own
    return Results(out, told, notes, time.time() - began)


def rejected_rows(table: DataFrame, columns: int, limit: int | None = None) -> DataFrame:
    """One violation per row of a text file that doesn't fit its columns, the first limit of them; its value is the row's whole text."""
    rows = table.filter(F.col(REJECTED).isNotNull())
    rows = rows if limit is None else rows.orderBy(ROW).limit(limit)
    told = F.lit(f"Row does not fit the file's {columns} columns")
    return rows.select(F.lit("RowShapeViolation").alias("tag"), F.lit("error").alias("severity"), F.lit("").alias("field_name"), F.lit("").alias("target_name"), F.col(ROW).cast("bigint").alias("row_number"), F.col(REJECTED).alias("value"), told.alias("error_message"), F.expr("cast(map() as map<string,string>)").alias("params"))


def _dataset(d: DatasetConfig, table: DataFrame, spec: profiles.Resolved, fields: dict[str, ResolvedField], judged: DataFrame, rules: Rules, config: Config, limit: int | None) -> DatasetResult:
    columns = [c for c in table.columns if c not in (ROW, REJECTED)]
    checked = {f.origin: (t, list(f.constraints)) for t, f in fields.items() if f.origin in columns and t in spec.base.fields}
    between = [r.check() for r in [*spec.rules, *(r for r in config.dependencies if r.dataset in (None, d.name))] if all(f in columns for f in r.fields)]
    parts = [integrity_violations(judged, rules, suggest=config.validation.suggestions), field_violations(table, checked, limit, rules=between)]
    unique = [(origin, target, c) for origin, (target, constraints) in checked.items() if not spec.base.is_key(target) for c in constraints if isinstance(c, Unique)]
    if unique:
        parts.append(repeated_values(table, unique, limit))
    if REJECTED in table.columns:
        parts.append(rejected_rows(table, len(columns), limit))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.select(F.lit(d.name).alias("dataset"), "*")
    return DatasetResult(d.name, d.class_name, judged.count(), cut(found), schema_violations(d, spec, fields, columns))
