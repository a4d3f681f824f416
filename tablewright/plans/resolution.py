"""The constraints of each field, from the dictionary, the profile and the configuration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from ..operators.constraints import STRICTNESS, Constraint, Required, strictest
from .profiles import PRESETS, Resolved

VARIANTS = ("obis", "gbif")


@dataclass(frozen=True)
class Mapping:
    origin: str
    target: str
    requirement: str | None = None
    constraints: tuple[Constraint, ...] = ()
    preset: str | None = None


@dataclass(frozen=True)
class ResolvedField:
    origin: str
    target: str
    constraints: tuple[Constraint, ...] = ()

    @property
    def level(self) -> str | None:
        own = strictest(self.constraints)
        return own.level if own else None


@dataclass
class Diagnostic:
    field: str
    overlapping: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @property
    def message(self) -> str:
        parts = [f"Field '{self.field}': {d}" for d in self.dropped]
        if self.overlapping:
            names = "', '".join(self.overlapping)
            parts.insert(0, f"The configuration adds '{names}' to field '{self.field}'; values must satisfy all of them")
        return ". ".join(parts)


def active_variant(variant: str | None) -> tuple[str, str | None]:
    """The variant in force, and a warning where that isn't the one asked for."""
    if variant in VARIANTS:
        return variant, None
    told = f'Unknown standard variant "{variant}"' if variant else "No standard variant specified"
    return "obis", f'{told} — defaulting to "obis".' + (f" Known variants: {', '.join(VARIANTS)}." if variant else "")


def replaced(old: Sequence[Constraint], new: Sequence[Constraint]) -> list[Constraint]:
    """new in place of all of old of the same types."""
    types = {c.type for c in new}
    return [c for c in old if c.type not in types] + list(new)


def overlaid(old: Sequence[Constraint], new: Sequence[Constraint]) -> list[Constraint]:
    """As replaced, but of required constraints the strictest stays."""
    own = strictest(old)
    new = [c for c in new if not (isinstance(c, Required) and own and STRICTNESS[c.level] < STRICTNESS[own.level])]
    return replaced(old, new)


def added(old: Sequence[Constraint], new: Sequence[Constraint], note: Diagnostic | None = None) -> list[Constraint]:
    """new after old; a required constraint weaker than those of old is dropped."""
    own = strictest(old)
    out = list(old)
    for c in new:
        if note and any(o.type == c.type for o in old) and c.type not in note.overlapping:
            note.overlapping.append(c.type)
        if isinstance(c, Required) and own and STRICTNESS[c.level] < STRICTNESS[own.level]:
            if note:
                note.dropped.append(f"Config '{c.level}' requirement ignored — spec/profile requires '{own.level}'")
            continue
        out.append(c)
    return out


def resolve_fields(spec: Resolved, variant: str, mappings: Sequence[Mapping], notes: list[Diagnostic] | None = None) -> dict[str, ResolvedField]:
    """By target name: every field of the class, of the profile and of the mappings."""
    out: dict[str, ResolvedField] = {}
    mapped = {m.target for m in mappings}
    for name, f in spec.base.fields.items():
        constraints: list[Constraint] = list(f.constraints)
        if level := f.level(variant):
            constraints = replaced(constraints, [Required(level)])
        elif f.obligations.get(variant) == "required (if exists)" and name in mapped:
            label = f.label or name
            constraints = replaced(constraints, [Required("recommended", message=f'"{label}" is in the dataset and required where it applies; verify that empty values are meant')])
        out[name] = ResolvedField(name, name, tuple(constraints))
    for name, o in spec.overrides.items():
        old = out.get(name, ResolvedField(name, name))
        constraints = overlaid(old.constraints, o.constraints) if o.constraints else list(old.constraints)
        if o.requirement:
            constraints = replaced(constraints, [Required(o.requirement)])
        out[name] = replace(old, constraints=tuple(constraints))
    for m in mappings:
        note = Diagnostic(m.target)
        constraints = list(out[m.target].constraints) if m.target in out else []
        for more in (PRESETS.get(m.preset or "", ()), m.constraints, [Required(m.requirement)] if m.requirement else []):
            constraints = added(constraints, more, note)
        if notes is not None and (note.overlapping or note.dropped):
            notes.append(note)
        out[m.target] = ResolvedField(m.origin, m.target, tuple(constraints))
    return out
