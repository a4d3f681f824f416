"""The configuration file: discovery, decoding with defaults, and errors by path."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..operators.constraints import STRICTNESS, Constraint, ConstraintError, Format, Length, Pattern, Range, Required, Unique
from ..operators.dependency import Dependency, When
from ..sources.tables import NULLS
from .relations import ForeignKey
from .resolution import Mapping

FILE_NAMES = ("tablewright.yaml", "tablewright.yml", "tablewright.json")
UPWARD = 10


class ConfigError(ValueError):
    """Each problem as ``dotted.path: message``."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    class_name: str
    path: str
    mappings: tuple[Mapping, ...] = ()


@dataclass(frozen=True)
class ValidationConfig:
    datasets: tuple[DatasetConfig, ...] = ()
    nulls: tuple[str, ...] = NULLS
    fail_fast: bool = False
    debug: bool = False
    suggestions: bool = True
    limit: int | None = 100  # violations a constraint; None: all
    output_dir: str | None = None
    delimiter: str | None = None  # of CSV inputs; None: found on samples of them, as the next three
    quote: str | None = None  # "": none
    escape: str | None = None
    header: bool | None = None
    multiline: bool | None = None  # quoted line ends in CSV inputs; None: found by a pass over their lines


@dataclass(frozen=True)
class TransformDataset:
    class_name: str
    source: dict[str, str]
    fields: dict[str, Any]


@dataclass(frozen=True)
class TransformConfig:
    inputs: dict[str, str] = field(default_factory=dict)
    statements: list[str] = field(default_factory=list)
    datasets: tuple[TransformDataset, ...] = ()
    output_dir: str | None = None
    timestamped: bool = True
    export_db: bool = False
    db_name: str = "workspace.db"
    drop_null_columns: bool = False
    delimiter: str | None = None
    quote: str | None = None
    escape: str | None = None
    header: bool | None = None
    multiline: bool | None = None
    single_files: bool = True  # one CSV file a class, written by one task; else folders of part files


@dataclass(frozen=True)
class Config:
    id: str
    name: str
    version: str
    base: str
    variant: str | None
    keys: tuple[ForeignKey, ...] = ()
    dependencies: tuple[Dependency, ...] = ()
    validation: ValidationConfig | None = None
    transform: TransformConfig | None = None


def discover(path: str | Path = ".", names: tuple[str, ...] = FILE_NAMES) -> Path:
    """path if it is a file, else the first default name in it or up to ten folders above."""
    at = Path(path).resolve()
    if at.is_file():
        return at
    if at.suffix in (".yaml", ".yml", ".json"):
        raise ConfigError([f"{path}: no such file"])
    for folder in [at, *at.parents][: UPWARD + 1]:
        for name in names:
            if (folder / name).is_file():
                return folder / name
    raise ConfigError([f"{path}: no configuration found"])


def load(path: str | Path) -> Config:
    text = Path(path).read_text(encoding="utf-8")
    try:
        raw = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError([f"{path}: not JSON, and no YAML reader is installed"]) from e
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ConfigError([f"{path}: {e}"]) from e
    return decode(raw)


class _Reader:
    def __init__(self) -> None:
        self.problems: list[str] = []

    def get(self, raw: dict, key: str, kind: type | tuple[type, ...], at: str, default: Any = None, need: bool = False) -> Any:
        value = raw.get(key)
        if value is None:
            if need:
                self.problems.append(f"{at}.{key}: is missing")
            return default
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is int):
            self.problems.append(f"{at}.{key}: has the wrong type")
            return default
        return value

    def level(self, raw: dict, at: str, key: str = "requirement") -> str | None:
        value = self.get(raw, key, str, at)
        if value is not None and value not in STRICTNESS:
            self.problems.append(f"{at}.{key}: must be one of {', '.join(STRICTNESS)}")
            return None
        return value

    def constraint(self, raw: Any, at: str) -> Constraint | None:
        if not isinstance(raw, dict):
            self.problems.append(f"{at}: must be an object")
            return None
        message = raw.get("message")
        try:
            match raw.get("type"):
                case "range":
                    return Range(raw.get("min"), raw.get("max"), raw.get("inclusive", True), message)
                case "format":
                    return Format(raw.get("format", ""), message)
                case "pattern":
                    return Pattern(raw["pattern"], raw.get("flags"), message)
                case "length":
                    return Length(raw.get("minLength"), raw.get("maxLength"), message)
                case "required":
                    return Required(raw.get("level", "required"), raw.get("allowEmpty", False), raw.get("allowWhitespace", False), message)
                case "unique":
                    return Unique(message)
            self.problems.append(f"{at}.type: unknown constraint {raw.get('type')!r}")
        except (ConstraintError, KeyError, TypeError) as e:
            self.problems.append(f"{at}: {e}")
        return None

    def mapping(self, raw: Any, at: str) -> Mapping | None:
        if not isinstance(raw, dict):
            self.problems.append(f"{at}: must be an object")
            return None
        constraints = tuple(c for k, r in enumerate(self.get(raw, "constraints", list, at, [])) if (c := self.constraint(r, f"{at}.constraints.{k}")))
        return Mapping(self.get(raw, "originName", str, at, "", True), self.get(raw, "targetName", str, at, "", True), self.level(raw, at), constraints, self.get(raw, "preset", str, at))

    def dataset(self, raw: Any, at: str) -> DatasetConfig:
        mappings = tuple(m for k, r in enumerate(self.get(raw, "fieldMappings", list, at, [])) if (m := self.mapping(r, f"{at}.fieldMappings.{k}")))
        return DatasetConfig(*(self.get(raw, k, str, at, "", True) for k in ("name", "class", "path")), mappings)

    def dependency(self, raw: dict, at: str) -> Dependency | None:
        need, one_of = raw.get("require"), False
        if isinstance(need, dict):
            need, one_of = need.get("oneOf"), True
        if not isinstance(need, list) or not need:
            self.problems.append(f"{at}.require: must name at least one field")
            return None
        when = raw.get("when")
        if isinstance(when, str):
            when = When(when)
        elif isinstance(when, dict) and "equals" in when:
            when = When(when.get("field", ""), equals=str(when["equals"]))
        elif isinstance(when, dict) and when.get("in"):
            when = When(when.get("field", ""), among=tuple(map(str, when["in"])))
        elif when is not None:
            self.problems.append(f"{at}.when: must be a field, or a field with equals or in")
            return None
        return Dependency(tuple(need), one_of, when, self.level(raw, at, "level") or "required", raw.get("message"), raw.get("dataset"))


def decode(raw: Any) -> Config:
    """A configuration from parsed YAML or JSON; unknown properties are ignored, all problems are told at once."""
    if not isinstance(raw, dict):
        raise ConfigError(["config: must be an object"])
    r = _Reader()
    if "validation" not in raw and "transform" not in raw:
        r.problems.append("config: needs validation or transform")
    standard = raw.get("standard")
    base, variant = ("darwin-core", "obis") if standard is None else (standard, None) if isinstance(standard, str) else (standard.get("base", "darwin-core"), standard.get("variant"))
    keys, dependencies = [], []
    for k, rule in enumerate(r.get(raw, "datasetRules", list, "config", [])):
        at = f"datasetRules.{k}"
        match rule.get("ruleType", rule.get("type")) if isinstance(rule, dict) else None:
            case "foreignKey":
                keys.append(ForeignKey(*(r.get(rule, n, str, at, "", True) for n in ("sourceDataset", "sourceField", "targetDataset", "targetField")), r.level(rule, at) or "required"))
            case "dependency":
                if own := r.dependency(rule, at):
                    dependencies.append(own)
            case other:
                r.problems.append(f"{at}.ruleType: unknown rule {other!r}")
    validation = transform = None
    if (v := r.get(raw, "validation", dict, "config")) is not None:
        datasets = tuple(r.dataset(d, f"validation.datasets.{k}") for k, d in enumerate(r.get(v, "datasets", list, "validation", [])))
        validation = ValidationConfig(
            datasets,
            tuple(r.get(v, "nullValues", list, "validation", list(NULLS))),
            r.get(v, "failFast", bool, "validation", False),
            r.get(v, "debug", bool, "validation", False),
            r.get(v, "enableSuggestions", bool, "validation", True),
            None if v.get("maxViolationsPerField", 100) is None else r.get(v, "maxViolationsPerField", int, "validation", 100),  # null: no cap
            r.get(v, "outputDir", str, "validation"),
            r.get(v, "csvDelimiter", str, "validation"),
            r.get(v, "csvQuote", str, "validation"),
            r.get(v, "csvEscape", str, "validation"),
            r.get(v, "csvHeader", bool, "validation"),
            r.get(v, "csvMultiline", bool, "validation"),
        )
    if (t := r.get(raw, "transform", dict, "config")) is not None:
        out = r.get(t, "output", dict, "transform", {})
        parts = []
        for k, d in enumerate(r.get(t, "datasets", list, "transform", [])):
            at = f"transform.datasets.{k}"
            source = r.get(d, "source", (dict, str), at, {}, True)
            parts.append(TransformDataset(r.get(d, "class", str, at, "", True), {source: source} if isinstance(source, str) else source, r.get(d, "fields", dict, at, {}, True)))
        transform = TransformConfig(
            {a: p for a, p in r.get(t, "inputs", dict, "transform", {}).items() if isinstance(p, str)},
            r.get(t, "postImportTransforms", list, "transform", []),
            tuple(parts),
            r.get(out, "outputDir", str, "transform.output"),
            r.get(out, "outputFilesWithTimestamp", bool, "transform.output", True),
            r.get(out, "exportDB", bool, "transform.output", False),
            r.get(out, "exportDBFileName", str, "transform.output", "workspace.db"),
            r.get(out, "dropNullColumns", bool, "transform.output", False),
            r.get(t, "csvDelimiter", str, "transform"),
            r.get(t, "csvQuote", str, "transform"),
            r.get(t, "csvEscape", str, "transform"),
            r.get(t, "csvHeader", bool, "transform"),
            r.get(t, "csvMultiline", bool, "transform"),
            r.get(out, "singleFiles", bool, "transform.output", True),
        )
    if r.problems:
        raise ConfigError(r.problems)
    return Config(str(raw.get("id", uuid.uuid4())), str(raw.get("name", "Workspace")), str(raw.get("version", "1.0.0")), base, variant, tuple(keys), tuple(dependencies), validation, transform)


def json_schema() -> dict:
    """A JSON Schema of the configuration, for editors."""
    text, level = {"type": "string"}, {"enum": list(STRICTNESS)}
    constraint = {"type": "object", "required": ["type"], "properties": {"type": {"enum": ["range", "format", "pattern", "length", "required", "unique"]}, "message": text}}
    mapping = {"type": "object", "required": ["originName", "targetName"], "properties": {"originName": text, "targetName": text, "requirement": level, "constraints": {"type": "array", "items": constraint}, "preset": text}}
    dataset = {"type": "object", "required": ["name", "class", "path"], "properties": {"name": text, "class": text, "path": text, "fieldMappings": {"type": "array", "items": mapping}}}
    part = {"type": "object", "required": ["class", "source", "fields"], "properties": {"class": text, "source": {"type": ["object", "string"]}, "fields": {"type": "object", "additionalProperties": {"type": ["string", "number", "null"]}}}}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "type": "object",
        "anyOf": [{"required": ["validation"]}, {"required": ["transform"]}],
        "properties": {
            "id": text,
            "name": text,
            "version": text,
            "standard": {"anyOf": [text, {"type": "object", "properties": {"base": text, "variant": text}}]},
            "datasetRules": {"type": "array", "items": {"type": "object", "required": ["ruleType"], "properties": {"ruleType": {"enum": ["foreignKey", "dependency"]}}}},
            "validation": {"type": "object", "properties": {"datasets": {"type": "array", "items": dataset}, "nullValues": {"type": "array", "items": text}, "failFast": {"type": "boolean"}, "csvDelimiter": text, "csvQuote": text, "csvEscape": text, "csvHeader": {"type": "boolean"}, "csvMultiline": {"type": "boolean"}, "maxViolationsPerField": {"type": ["integer", "null"]}}},
            "transform": {"type": "object", "properties": {"inputs": {"type": "object"}, "postImportTransforms": {"type": "array", "items": text}, "datasets": {"type": "array", "items": part}, "csvDelimiter": text, "csvQuote": text, "csvEscape": text, "csvHeader": {"type": "boolean"}, "csvMultiline": {"type": "boolean"}, "output": {"type": "object"}}},
        },
    }
