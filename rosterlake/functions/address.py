"""Street addresses as Column functions: house number and street in postal form, and the words of a building's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street words and their postal forms.
STREET_FORMS = {
    "STREET": "ST", "STR": "ST", "AVENUE": "AVE", "AV": "AVE", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "BOULEVARD": "BLVD", "HIGHWAY": "HWY", "PARKWAY": "PKWY", "TURNPIKE": "TPKE", "PLACE": "PL",
    "COURT": "CT", "CIRCLE": "CIR", "TERRACE": "TER", "EXPRESSWAY": "EXPY", "PLAZA": "PLZ", "SQUARE": "SQ", "TRAIL": "TRL", "CENTER": "CTR", "CENTRE": "CTR", "ROUTE": "RTE", "MOUNT": "MT", "SAINT": "ST",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
    "FIRST": "1ST", "SECOND": "2ND", "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH", "SIXTH": "6TH", "SEVENTH": "7TH", "EIGHTH": "8TH", "NINTH": "9TH", "TENTH": "10TH",
    "COUNTY": "CO", "MEMORIAL": "MEML", "JUNCTION": "JCT", "ALLEY": "ALY", "EXTENSION": "EXT", "HEIGHTS": "HTS", "POINT": "PT", "VALLEY": "VLY", "ISLAND": "IS", "LANDING": "LNDG", "CROSSING": "XING", "FREEWAY": "FWY", "CAUSEWAY": "CSWY",
}
# Words that begin a unit; it and all behind it go.
UNIT_WORDS = ("STE", "SUITE", "APT", "UNIT", "RM", "ROOM", "FL", "FLR", "FLOOR", "BLDG", "BUILDING", "DEPT", "LEVEL", "LOWR", "UPPR", "LBBY", "OFC", "OFFICE", "SPC", "BSMT", "PH")
# Short forms in building names and what they stand for.
NAME_FORMS = {
    "CTR": ("CENTER",), "CNTR": ("CENTER",), "HOSP": ("HOSPITAL",), "MED": ("MEDICAL",), "UNIV": ("UNIVERSITY",), "DEPT": ("DEPARTMENT",), "HLTH": ("HEALTH",), "MEML": ("MEMORIAL",), "ST": ("SAINT",), "MT": ("MOUNT",),
    "SUNY": ("STATE", "UNIVERSITY", "NEW", "YORK"), "HSC": ("HEALTH", "SCIENCES", "CENTER"), "VA": ("VETERANS",), "SCIENCE": ("SCIENCES",),
}
# Words that don't tell buildings apart.
NAME_FILLERS = ("THE", "OF", "AT", "AND", "FOR", "IN", "ON", "LEVEL", "FLOOR", "FL", "SUITE", "STE", "ROOM", "RM", "BLDG", "BUILDING", "UNIT", "DEPARTMENT", "INC", "LLC", "PC", "PLLC")
# A fixed pattern: a house number (one hyphen allowed, as in 104-23) and the rest.
HOUSE = r"^(\d+[A-Z]?(?:-\d+[A-Z]?)?)\s+(.+)$"


def _words(c: Column) -> Column:
    """Runs of ASCII letters and digits, upper case; all other characters part words."""
    return F.filter(F.split(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "), " "), lambda w: w != "")


def street(c: Column) -> Column:
    """A street in postal form, without the unit: ``N. Country Road Ste 4`` gives ``N COUNTRY RD``."""
    forms = F.create_map(*(F.lit(x) for kv in STREET_FORMS.items() for x in kv))
    plain = F.regexp_replace(F.regexp_replace(F.upper(c), "#", " STE "), "[^A-Z0-9]+", " ")
    plain = F.regexp_replace(plain, rf"\b({'|'.join(UNIT_WORDS)})\b.*$", "")
    return F.array_join(F.transform(_words(plain), lambda w: F.coalesce(forms[w], w)), " ")


def house(c: Column) -> Column:
    """(number, street) of an address; null where it doesn't begin with a house number or has no street behind it."""
    plain = F.upper(F.trim(F.regexp_replace(c, "[^A-Za-z0-9 #-]+", " ")))
    rest = street(F.regexp_extract(plain, HOUSE, 2))
    return F.when(F.rlike(plain, F.lit(HOUSE)) & (rest != ""), F.named_struct(F.lit("number"), F.regexp_extract(plain, HOUSE, 1), F.lit("street"), rest))


def building(c: Column) -> Column:
    """(number, street) of an organisation's address: no hyphens in the number, '' for none; null without a street."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(c), r"\b(EXPRESS\s+WAY|EXPWY|EXPW|EXPR)\b", "EXPY"), r"\b(STES|SUITES)\b", "STE")
    h, whole = house(plain), street(plain)
    bare = F.when(whole != "", F.named_struct(F.lit("number"), F.lit(""), F.lit("street"), whole))
    return F.coalesce(F.when(h.isNotNull(), F.named_struct(F.lit("number"), F.regexp_replace(h["number"], "-", ""), F.lit("street"), h["street"])), bare)


def name_tokens(c: Column) -> Column:
    """The distinct telling words of a building's name, sorted; short forms are spelt out, fillers, single letters and words with digits go."""
    forms = F.create_map(*(x for k, v in NAME_FORMS.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in v)))))
    spelt = F.flatten(F.transform(_words(F.coalesce(c, F.lit(""))), lambda w: F.coalesce(forms[w], F.array(w))))
    return F.array_sort(F.array_distinct(F.filter(spelt, lambda w: ~w.isin(*NAME_FILLERS) & (F.length(w) > 1) & ~F.rlike(w, F.lit("[0-9]")))))


def zip5(c: Column) -> Column:
    """The first five characters, where they are digits."""
    return F.when(F.rlike(c, F.lit("^[0-9]{5}")), F.left(c, F.lit(5)))


def city(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))
