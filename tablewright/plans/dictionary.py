"""Classes of the biodiversity standard: fields, types, vocabularies and obligations.

The built-in dictionary lists common public terms; a fuller one is made by the
import (see ``schema_import``) and loaded from JSON.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import date
from functools import lru_cache

from ..operators.constraints import Constraint, Format, Range, Required, Unique

# Obligations and the levels they stand for.
LEVELS = {"required": "required", "strongly recommended": "recommended", "recommended": "optional"}
# Types of the dictionary and of columns.
COLUMN_TYPES = {"identifier": "string", "uri": "string", "string": "string", "controlled-vocabulary": "string", "integer": "int", "date": "date", "boolean": "boolean", "decimal": "double"}
# Validators given by name.
NAMED = {
    "uniqueIdentifier": Unique(),
    "unique": Unique(),
    "required": Required("required"),
    "recommended": Required("optional"),
    "integer": Format("integer"),
    "date": Format("iso8601"),
    "iso8601Date": Format("iso8601"),
    "url": Format("url"),
    "decimal": Format("decimal-degrees"),
}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "string"
    constraints: tuple[Constraint, ...] = ()
    obligations: dict[str, str] = field(default_factory=dict)  # by variant
    values: tuple[str, ...] = ()
    unique: bool = False
    label: str = ""

    @property
    def column_type(self) -> str:
        return COLUMN_TYPES.get(self.type, "string")

    @property
    def enforced(self) -> bool:
        """A vocabulary is enforced where the field is required or strongly recommended."""
        return bool(self.values) and any(LEVELS.get(o) in ("required", "recommended") for o in self.obligations.values())

    def level(self, variant: str) -> str | None:
        return LEVELS.get(self.obligations.get(variant, ""))


@dataclass(frozen=True)
class ClassSpec:
    name: str
    fields: dict[str, FieldSpec]
    warnings: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        own = self.name[0].lower() + self.name[1:] + "ID"
        return next((f for f in self.fields if f.lower() == own.lower()), PRIMARY.get(self.name, own))

    def is_key(self, name: str) -> bool:
        return name == self.key or (name.endswith("ID") and name in self.fields and self.fields[name].unique)


# A class's identifier, and references within a class.
PRIMARY = {"Event": "eventID", "Occurrence": "occurrenceID", "Taxon": "taxonID", "ExtendedMeasurementOrFact": "measurementID"}
SELF = {"Event": ("parentEventID", "eventID")}

# Classes and fields, each as name, type and obligation (r required, s strongly recommended, o recommended, e required if it exists).
TERMS = {
    "Event": "eventID:identifier:r parentEventID:identifier: eventType:: eventDate::r eventTime:: year:integer:s month:integer:o day:integer:o verbatimEventDate:: habitat:: samplingProtocol::o sampleSizeValue:: sampleSizeUnit:: samplingEffort:: eventRemarks:: fieldNumber:: locationID:identifier: locality::o waterBody:: country::o countryCode:: stateProvince:: island:: islandGroup:: locationRemarks:: decimalLatitude:decimal:r decimalLongitude:decimal:r geodeticDatum::s coordinateUncertaintyInMeters:decimal:s coordinatePrecision:decimal: footprintWKT:: verbatimCoordinates:: minimumDepthInMeters:decimal:s maximumDepthInMeters:decimal:s verbatimDepth:: minimumElevationInMeters:decimal: maximumElevationInMeters:decimal: datasetID:identifier: datasetName:: institutionCode:: license:: modified:date: references:uri:",
    "Occurrence": "basisOfRecord:controlled-vocabulary:r occurrenceID:identifier:r eventID:identifier:e catalogNumber:: recordNumber:: recordedBy:: individualCount:integer: organismQuantity:decimal: organismQuantityType:: sex:controlled-vocabulary:o lifeStage:controlled-vocabulary:o reproductiveCondition:: behavior:: establishmentMeans:: occurrenceStatus:controlled-vocabulary:r preparations:: associatedMedia:: occurrenceRemarks:: eventDate:: decimalLatitude:decimal: decimalLongitude:decimal: scientificName::r scientificNameID:identifier:s taxonID:identifier: taxonRank:controlled-vocabulary:s kingdom::o phylum:: class:: order:: family:: genus:: subgenus:: specificEpithet:: infraspecificEpithet:: scientificNameAuthorship:: vernacularName:: taxonRemarks:: identificationQualifier:: identifiedBy:: institutionCode:: collectionCode:: datasetName:: type:: modified:date: references:uri:",
    "Taxon": "taxonID:identifier:r scientificName::r scientificNameID:identifier:s acceptedNameUsageID:identifier: parentNameUsageID:identifier: nameAccordingTo:: taxonRank:controlled-vocabulary:s kingdom::o phylum:: class:: order:: family:: genus:: specificEpithet:: scientificNameAuthorship:: vernacularName:: taxonomicStatus:: nomenclaturalCode:: taxonRemarks::",
    "ExtendedMeasurementOrFact": "measurementID:identifier: eventID:identifier:r occurrenceID:identifier: measurementType::s measurementTypeID:uri:o measurementValue::s measurementValueID:uri: measurementAccuracy:: measurementUnit::s measurementUnitID:uri: measurementDeterminedDate:: measurementDeterminedBy:: measurementMethod:: measurementRemarks::",
    "dnaDerivedData": "occurrenceID:identifier:e samp_name::o project_name:: env_broad_scale:: env_local_scale:: env_medium:: DNA_sequence::s target_gene::s pcr_primer_forward::o pcr_primer_reverse::o seq_meth:: otu_db::",
    "ResourceRelationship": "resourceRelationshipID:identifier: resourceID:identifier:r relationshipOfResourceID:identifier: relatedResourceID:identifier:r relationshipOfResource::r relationshipAccordingTo:: relationshipEstablishedDate:date: relationshipRemarks::",
}
# Controlled vocabularies.
WORDS = {
    "basisOfRecord": "FossilSpecimen HumanObservation LivingSpecimen MachineObservation MaterialCitation MaterialEntity MaterialSample Occurrence PreservedSpecimen",
    "occurrenceStatus": "present absent",
    "sex": "female male hermaphrodite",
    "lifeStage": "adult egg embryo juvenile larva subadult",
    "taxonRank": "kingdom phylum class order family genus subgenus species subspecies variety form",
}
OBLIGATIONS = {"r": "required", "s": "strongly recommended", "o": "recommended", "e": "required (if exists)"}


def by_name(name: str, type_: str) -> list[Constraint]:
    """Constraints that a field gets by its name and type."""
    lower = name.lower()
    out: list[Constraint] = []
    if lower == "decimallatitude":
        out.append(Range(-90, 90))
    elif lower == "decimallongitude":
        out.append(Range(-180, 180))
    elif name == "year":
        out.append(Range(1600, date.today().year))
    elif name == "month":
        out.append(Range(1, 12))
    elif name == "day":
        out.append(Range(1, 31))
    if type_ == "uri":
        out.append(Format("url"))
    elif type_ == "date" or name == "eventDate":
        out.append(Format("iso8601"))
    return out


@lru_cache(maxsize=1)
def built_in() -> dict[str, ClassSpec]:
    out = {}
    for name, terms in TERMS.items():
        fields = {}
        for term in terms.split():
            f, kind, duty = term.split(":")
            key = f == PRIMARY.get(name)
            own = by_name(f, kind) + ([Unique()] if key else [])
            fields[f] = FieldSpec(f, kind or "string", tuple(own), {v: OBLIGATIONS[duty] for v in ("obis", "gbif") if duty}, tuple(WORDS.get(f, "").split()) if kind == "controlled-vocabulary" else (), key, f)
        out[name] = ClassSpec(name, fields)
    return out


def find(name: str, classes: dict[str, ClassSpec] | None = None) -> ClassSpec | None:
    return (built_in() if classes is None else classes).get(name)


def loads(text: str) -> dict[str, ClassSpec]:
    """Classes from the JSON that the import writes. Validators that can't be read are warnings of the class."""
    out = {}
    for name, raw in json.loads(text).items():
        fields, warnings = {}, []
        for f, own in raw.get("fields", {}).items():
            constraints: list[Constraint] = []
            for v in own.get("validators", []):
                if isinstance(v, str) and v in NAMED:
                    constraints.append(NAMED[v])
                elif isinstance(v, dict) and v.get("type") == "range":
                    constraints.append(Range(v.get("min"), v.get("max")))
                elif v != "optional":
                    warnings.append(f"{name}.{f}: unknown validator {v!r}")
            if str(own.get("gbif_required", "")).lower() in ("true", "false") and "gbif" not in own.get("obligations", {}):
                own = {**own, "obligations": {**own.get("obligations", {}), "gbif": "required" if str(own["gbif_required"]).lower() == "true" else "optional"}}
            fields[f] = FieldSpec(f, own.get("type", "string"), tuple(constraints), dict(own.get("obligations", {})), tuple(own.get("values", ())), str(own.get("unique", "")).lower() == "true", own.get("label", f))
        out[name] = replace(ClassSpec(name, fields), warnings=tuple(warnings))
    return out
