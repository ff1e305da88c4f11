"""The search filter: optional conditions, all of which must hold, as joins over the conformed tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import geo, text
from rosterlake.operators import filters, linkage, ranking

# What callers may sort by, each with its tie-breaker.
SORTS = {
    "name": ("sort_name", "npi"), "first_name": ("first_name", "sort_name", "npi"), "credential": ("credential", "sort_name", "npi"), "specialty": ("primary_taxonomy_code", "sort_name", "npi"),
    "enumerated": ("enumeration_date", "npi"), "updated": ("last_update_date", "npi"), "type": ("entity_type", "sort_name", "npi"), "npi": ("npi",),
}
STOP_WORDS = ("the", "and", "for", "inc", "llc", "ltd", "corp")


class InvalidFilter(ValueError):
    """A condition is out of range or unknown."""


@dataclass
class Tables:
    """The conformed tables; those a filter does not need may be absent."""

    provider: DataFrame
    taxonomy: DataFrame | None = None
    location: DataFrame | None = None
    zip_county: DataFrame | None = None
    zip_centroid: DataFrame | None = None
    county_shortage: DataFrame | None = None
    exclusion: DataFrame | None = None
    opt_out: DataFrame | None = None
    quality: DataFrame | None = None
    group: DataFrame | None = None
    other_name: DataFrame | None = None
    order_referring: DataFrame | None = None
    clinician: DataFrame | None = None
    enrollment: DataFrame | None = None
    address_type: DataFrame | None = None
    address_point: DataFrame | None = None


@dataclass
class SearchFilter:
    npi: str | None = None
    taxonomy_codes: list[str] = field(default_factory=list)
    state: str | list[str] | None = None  #: one or several
    city: str | None = None
    county: str | None = None
    zip5: str | None = None
    near: tuple[float, float, float] | None = None  #: latitude, longitude, miles
    bbox: tuple[float, float, float, float] | None = None  #: west, south, east, north, of a location's own point
    address_type: str | None = None  #: residential, commercial or unknown
    shortage: str | None = None
    last_name: str | None = None
    first_name: str | None = None
    org_name: str | None = None
    similar: bool = False
    credential: str | None = None
    entity_type: int | None = None
    gender: str | None = None
    excluded: bool | None = None
    opted_out: bool | None = None
    order_refer: str | None = None  #: a program that the provider may order or refer in
    accepts_assignment: bool | None = None
    telehealth: bool | None = None
    medicare_active: bool | None = None
    min_years: int | None = None  #: since graduation
    quality: str | None = None  #: current, check, stale or notStale
    new_within_days: int | None = None
    updated_within_days: int | None = None
    all_members: bool = True
    sort: str = "name"
    page: int = 1
    page_size: int = 50

    def check(self) -> None:
        if self.sort.lstrip("-") not in SORTS:
            raise InvalidFilter(f"unknown sort {self.sort}")
        if not 1 <= self.page_size <= 200 or self.page < 1 or self.page * self.page_size > 10_000:
            raise InvalidFilter("a page holds 1 to 200 rows and lies within the first 10,000")
        for days in (self.new_within_days, self.updated_within_days):
            if days is not None and not 1 <= days <= 3650:
                raise InvalidFilter("days are 1 to 3650")
        if self.quality not in (None, "current", "check", "stale", "notStale"):
            raise InvalidFilter(f"unknown quality {self.quality}")
        if self.bbox and not (-180 <= self.bbox[0] < self.bbox[2] <= 180 and -90 <= self.bbox[1] < self.bbox[3] <= 90):
            raise InvalidFilter("a box is west, south, east, north")
        if self.order_refer not in (None, "part_b", "dme", "hha", "pmd", "hospice"):
            raise InvalidFilter(f"unknown program {self.order_refer}")
        if self.address_type not in (None, "residential", "commercial", "unknown"):
            raise InvalidFilter(f"unknown address type {self.address_type}")
        if self.near and not 0 < self.near[2] <= 100:
            raise InvalidFilter("a radius is at most 100 miles")


def _begins(c: str, value: str) -> Column:
    return F.startswith(text.fold(F.col(c)), text.fold(F.lit(value)))


def matches(t: Tables, f: SearchFilter, today: str) -> DataFrame:
    """The providers that meet every condition, unsorted. Conditions on places must hold at one and the same location."""
    f.check()
    out, day = t.provider, F.lit(today).cast("date")
    plain = [(f.npi, "npi"), (f.entity_type, "entity_type"), (f.gender, "gender")]
    for value, column in plain:
        if value is not None:
            out = out.filter(F.col(column) == value)
    if f.new_within_days:
        out = out.filter(F.col("enumeration_date") >= F.date_sub(day, f.new_within_days))
    if f.updated_within_days:
        out = out.filter(F.col("last_update_date") >= F.date_sub(day, f.updated_within_days))
    for value, column, key in ((f.last_name, "last_name", "last_phonetic"), (f.first_name, "first_name", "first_phonetic")):
        if value:
            same = _begins(column, value)
            out = out.filter(same | (F.col(key) == text.phonetic_key(F.lit(value))) if f.similar else same)
    if f.credential:
        key = "".join(ch for ch in f.credential.upper() if ch.isalnum())
        out = out.filter(F.startswith("credential_key", F.lit(key)))
    if f.org_name:
        asked = [w for w in dict.fromkeys("".join(ch if ch.isalnum() else " " for ch in f.org_name.lower()).split()) if len(w) >= 3 and w not in STOP_WORDS]
        if f.similar and asked and t.other_name is not None:
            names = t.provider.select("npi", F.col("org_name").alias("name")).unionByName(t.other_name.select("npi", "name"))
            fit = names.filter(F.forall(F.array(*map(F.lit, asked)), lambda q: F.exists(text.tokens(F.col("name")), lambda w: F.startswith(w, q))))
            fit = fit.select("npi").unionByName(t.provider.filter(_begins("org_name", f.org_name)).select("npi"))
            out = filters.having(out, fit, {"npi": "npi"})
        else:
            out = out.filter(_begins("org_name", f.org_name))
    if f.taxonomy_codes:
        out = filters.having(out, t.taxonomy, {"npi": "npi"}, F.col("taxonomy_code").isin(*f.taxonomy_codes))
    place = t.location
    if f.state:
        place = place.filter(F.col("state").isin(*(x.upper() for x in ([f.state] if isinstance(f.state, str) else f.state))))
    if f.zip5:
        place = place.filter(F.col("zip5") == f.zip5)
    if f.city:
        named = t.zip_county.filter(text.fold(F.col("usps_city")) == f.city.lower()).select("zip5").distinct() if t.zip_county is not None else None
        written = text.fold(F.col("city")) == f.city.lower()
        place = place.filter(written) if named is None else place.join(named.withColumn("_named", F.lit(True)), "zip5", "left").filter(written | F.coalesce("_named", F.lit(False)))
    if f.county:
        place = filters.having(place, t.zip_county, {"zip5": "zip5"}, F.col("county_fips") == f.county)
    if f.shortage:
        counties = filters.having(t.zip_county, t.county_shortage, {"county_fips": "county_fips"}, F.col("discipline") == f.shortage)
        place = filters.having(place, counties, {"zip5": "zip5"})
    if f.near:
        lat, lon, miles = f.near
        place = filters.having(place, t.zip_centroid, {"zip5": "zip5"}, geo.within(F.col("lat"), F.col("lon"), (lat, lon), miles))
    if f.bbox:
        west, south, east, north = f.bbox
        place = filters.having(place, t.address_point, {"addr_key": "addr_key"}, F.col("lon").between(west, east) & F.col("lat").between(south, north))
    if f.address_type:
        place = filters.having(place, t.address_type, {"addr_key": "addr_key"}, F.col("building_type") == f.address_type)
    if place is not t.location:
        out = filters.having(out, place, {"npi": "npi"})
    if f.excluded is not None:
        out = filters.flag(out, t.exclusion, {"npi": "npi"}, f.excluded)
    if f.opted_out is not None:
        out = filters.flag(out, t.opt_out, {"npi": "npi"}, f.opted_out, F.col("end_date").isNull() | (F.col("end_date") >= day))
    if f.order_refer:
        out = filters.having(out, t.order_referring, {"npi": "npi"}, F.col(f.order_refer))
    for wanted, column in ((f.accepts_assignment, "accepts_assignment"), (f.telehealth, "telehealth")):
        if wanted is not None:
            out = filters.flag(out, t.clinician, {"npi": "npi"}, wanted, F.col(column))
    if f.medicare_active is not None:
        out = filters.flag(out, t.enrollment, {"npi": "npi"}, f.medicare_active)
    if f.min_years is not None:
        out = filters.having(out, t.clinician, {"npi": "npi"}, F.col("graduation_year") <= F.year(day) - f.min_years)
    if f.quality == "notStale":
        out = filters.lacking(out, t.quality, {"npi": "npi"}, F.col("label") == 3)  # unlabelled records stay
    elif f.quality:
        out = filters.having(out, t.quality, {"npi": "npi"}, F.col("label") == {"current": 1, "check": 2, "stale": 3}[f.quality])
    if not f.all_members:
        out = out.join(t.group.select("npi", "main_npi", "is_main"), "npi", "left")
        out = linkage.one_per_group(out, "main_npi", F.coalesce("is_main", F.lit(False)), "npi").drop("main_npi", "is_main")
    return out


def relevance(f: SearchFilter) -> list[Column]:
    """What comes before the names under the default sort of a similar search: organisations that begin with the name, people of the nearest spelling."""
    if not f.similar or f.sort != "name":
        return []
    out = [_begins("org_name", f.org_name).desc_nulls_last()] if f.org_name else []
    asked = [text.name_distance(F.lit(v), F.col(c)) for v, c in ((f.last_name, "last_name"), (f.first_name, "first_name")) if v]
    return out + ([reduce(Column.__add__, asked).asc_nulls_last()] if asked else [])


def search(t: Tables, f: SearchFilter, today: str) -> DataFrame:
    """A sorted page with the total on each row; a leading minus sorts down, dates take the key with them."""
    f.check()
    names, down = SORTS[f.sort.lstrip("-")], f.sort.startswith("-")
    dates = names[0].endswith("_date")
    order = [(F.desc_nulls_last if down and (i == 0 or dates) else F.asc_nulls_last)(c) for i, c in enumerate(names)]
    return ranking.page(matches(t, f, today), [*relevance(f), *order], f.page, f.page_size)


def search_all(t: Tables, f: SearchFilter, today: str) -> DataFrame:
    """Every provider that meets the filter, for an export."""
    return matches(t, f, today)
