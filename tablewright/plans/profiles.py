"""Presets of constraints, and profiles that overlay a class's dictionary."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.constraints import Constraint, Format, Pattern, Range, Required, Unique
from ..operators.dependency import Dependency
from . import dictionary

# Presets by name.
PRESETS: dict[str, tuple[Constraint, ...]] = {
    "latitude": (Range(-90, 90), Format("decimal-degrees")),
    "longitude": (Range(-180, 180), Format("decimal-degrees")),
    "depth": (Range(0, 11000),),
    "isoDate": (Format("iso8601"),),
    "uniqueId": (Required("required"), Unique()),
    "requiredText": (Required("required"),),
    "url": (Format("url"),),
    "uuid": (Format("uuid"),),
    "countryCode": (Pattern("^[A-Z]{2}$"),),
    "year": (Range(1000, 2100), Format("integer")),
    "month": (Range(1, 12), Format("integer")),
    "day": (Range(1, 31), Format("integer")),
}


@dataclass(frozen=True)
class Override:
    requirement: str | None = None
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    extends: str
    overrides: dict[str, Override] = field(default_factory=dict)
    rules: tuple[Dependency, ...] = ()


def _levels(**names: str) -> dict[str, Override]:
    return {n: Override(level) for level, own in names.items() for n in own.split()}


# The profiles' requirements and messages.
PROFILES = {
    "obis": Profile(
        "obis",
        "OBIS Base Requirements",
        "Event",
        {
            "decimalLatitude": Override("required", (Range(-90, 90, message="Latitude must be between -90 and 90 degrees"),)),
            "decimalLongitude": Override("required", (Range(-180, 180, message="Longitude must be between -180 and 180 degrees"),)),
            "geodeticDatum": Override("required", (Required("required", message="OBIS requires geodeticDatum (e.g., WGS84, EPSG:4326)"),)),
            "coordinateUncertaintyInMeters": Override("recommended", (Range(min=0, message="Coordinate uncertainty should be a positive number"),)),
            "eventDate": Override("required", (Format("iso8601", message="OBIS requires eventDate in ISO 8601 format (YYYY-MM-DD or YYYY-MM-DD/YYYY-MM-DD)"),)),
            "scientificName": Override("recommended", (Required("recommended", message="Scientific name is strongly recommended for taxonomic identification"),)),
            "scientificNameID": Override("recommended", (Format("url", message="Scientific name ID should be a valid URI (e.g., WoRMS LSID)"),)),
            "minimumDepthInMeters": Override("optional", (Range(0, 11000, message="Depth should be between 0 and 11000 meters (Mariana Trench)"),)),
            "maximumDepthInMeters": Override("optional", (Range(0, 11000, message="Depth should be between 0 and 11000 meters"),)),
            **_levels(recommended="year basisOfRecord occurrenceStatus", optional="month day kingdom datasetName institutionCode collectionCode country countryCode locality waterBody"),
        },
    ),
    "obis-event": Profile(
        "obis-event",
        "OBIS Event Core",
        "obis",
        _levels(required="eventID", recommended="parentEventID samplingProtocol", optional="eventType eventRemarks locationID locationRemarks verbatimCoordinates verbatimDepth footprintWKT stateProvince island islandGroup sampleSizeValue sampleSizeUnit samplingEffort"),
    ),
    "obis-extendedmeasurementorfact": Profile(
        "obis-extendedmeasurementorfact",
        "OBIS ExtendedMeasurementOrFact",
        "ExtendedMeasurementOrFact",
        _levels(recommended="eventID occurrenceID"),
        (Dependency(("eventID", "occurrenceID"), one_of=True, message='At least one of "eventID" or "occurrenceID" must be present'),),
    ),
}


@dataclass(frozen=True)
class Resolved:
    """A class with what its profiles lay over it."""

    id: str
    name: str
    base: dictionary.ClassSpec
    overrides: dict[str, Override]
    rules: tuple[Dependency, ...]


def chain(profile_id: str, profiles: dict[str, Profile] | None = None) -> tuple[list[Profile], str]:
    """The profile and those it extends, the outermost first, and the class at the bottom; a cycle is an error."""
    own = PROFILES if profiles is None else profiles
    out: list[Profile] = []
    at = profile_id
    while at in own:
        if any(p.id == at for p in out):
            raise ValueError(f"profiles extend each other: {' -> '.join([*(p.id for p in out), at])}")
        out.append(own[at])
        at = own[at].extends
    return out[::-1], at


def resolve(class_name: str, variant: str, classes: dict[str, dictionary.ClassSpec] | None = None, profiles: dict[str, Profile] | None = None) -> Resolved | None:
    """The profile <variant>-<class> if there is one, else the class alone; None for an unknown class."""
    line, bottom = chain(f"{variant}-{class_name.lower()}", profiles)
    base = dictionary.find(bottom if line else class_name, classes)
    if base is None:
        return None
    overrides: dict[str, Override] = {}
    for p in line:
        for name, o in p.overrides.items():
            old = overrides.get(name, Override())
            overrides[name] = Override(o.requirement or old.requirement, o.constraints or old.constraints)
    return Resolved(line[-1].id if line else base.name, line[-1].name if line else base.name, base, overrides, tuple(r for p in line for r in p.rules))
