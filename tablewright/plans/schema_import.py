"""A class dictionary from XML definitions and a checklist in CSV."""

from __future__ import annotations

import csv
import json
import re
import xml.etree.ElementTree as ET
from pathlib import Path

from ..operators.constraints import Range
from .dictionary import PRIMARY, by_name


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def label(name: str) -> str:
    """camelCase in words: eventDate is Event Date."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return words[:1].upper() + words[1:]


def vocabulary(path: str | Path) -> list[str]:
    """The identifiers of a thesaurus's concepts."""
    root = ET.parse(path).getroot()
    return [c.attrib[k] for c in root.iter() if _local(c.tag) == "concept" for k in c.attrib if _local(k) == "identifier"]


def definition(path: str | Path, thesauri: dict[str, list[str]] | None = None) -> dict[str, dict]:
    """{class: {fields: {name: facts}}} of one XML definition of a core or an extension."""
    root = ET.parse(path).getroot()
    fields = {}
    for p in root.iter():
        if _local(p.tag) != "property" or "name" not in p.attrib:
            continue
        name, kind = p.attrib["name"], p.attrib.get("type", "string")
        words = [w for k, w in p.attrib.items() if _local(k) == "thesaurus"]
        values = (thesauri or {}).get(words[0], []) if words else []
        fields[name] = {"label": label(name), "type": "controlled-vocabulary" if values else kind, "group": p.attrib.get("group", ""), "gbif_required": p.attrib.get("required", "false"), "values": values}
    return {root.attrib.get("name", Path(path).stem): {"rowType": root.attrib.get("rowType", ""), "fields": fields}}


def checklist(path: str | Path) -> dict[str, str]:
    """Obligation by term; other than ASCII is left out, names and values are trimmed."""
    text = re.sub(r"[^\x00-\x7F]", "", Path(path).read_text(encoding="utf-8", errors="replace"))
    out = {}
    for row in csv.DictReader(text.splitlines()):
        own = {(k or "").strip().lower(): (v or "").strip() for k, v in row.items()}
        if own.get("term"):
            out[own["term"]] = own.get("obis required", own.get("obligation", "")).lower()
    return out


def _validators(cls: str, name: str, facts: dict) -> list:
    out: list = ["uniqueIdentifier"] if name == PRIMARY.get(cls) else []
    for c in by_name(name, facts["type"]):
        out.append({"type": "range", "min": c.min, "max": c.max} if isinstance(c, Range) else {"url": "url", "iso8601": "date"}[c.format])
    return out + (["integer"] if facts["type"] == "integer" else [])


def build(definitions: list[str | Path], duties: str | Path | None = None, thesauri: dict[str, list[str]] | None = None) -> dict[str, dict]:
    """All definitions by class, joined with the checklist's obligations (optional where it has none), with validators by name and type."""
    classes: dict[str, dict] = {}
    for path in definitions:
        for name, own in definition(path, thesauri).items():
            classes.setdefault(name, {"rowType": own["rowType"], "fields": {}})["fields"].update(own["fields"])
    known = checklist(duties) if duties else {}
    for cls, own in classes.items():
        for name, facts in own["fields"].items():
            facts["obligations"] = {"obis": known.get(name) or "optional"}
            facts["unique"] = str(name == PRIMARY.get(cls)).lower()
            facts["validators"] = _validators(cls, name, facts)
    return classes


def write(classes: dict[str, dict], path: str | Path) -> None:
    Path(path).write_text(json.dumps(classes, indent=2, ensure_ascii=False), encoding="utf-8")
