"""Record quality: evidence as bits, a label from the bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import geo
from rosterlake.operators import filters

CURRENT, CHECK, STALE = 1, 2, 3


def mask(signs: list[Column]) -> Column:
    """Bit i is set if sign i is true; null is not."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.coalesce(s, F.lit(False)), 1 << i).otherwise(0) for i, s in enumerate(signs)))


def label(reasons: Column, activity: Column, stale: int, check: int, check_if_idle: int = 0, stale_always: int = 0) -> Column:
    """Stale: a reason of ``stale`` without activity, or of ``stale_always``; check: one of ``check``, or of ``check_if_idle`` without activity; else current."""
    idle = activity == 0
    has = lambda bits: reasons.bitwiseAND(F.lit(bits)) != 0
    return F.when(has(stale_always) | (has(stale) & idle), STALE).when(has(check) | (has(check_if_idle) & idle), CHECK).otherwise(CURRENT)


# Reasons of a registry record and their bits.
REASONS = {
    "not_updated_5": 1, "not_updated_10": 2, "no_activity": 4, "not_mapped": 8, "po_box": 16, "no_phone": 32, "other_address": 64, "other_specialty": 128, "license_lapsed": 256, "deceased": 512,
    "reactivated": 1024, "home_address": 2048, "facility_closed": 4096, "listed_closed": 8192, "listing_only": 16384, "medicare_stopped": 32768, "other_current": 65536,
}
# Signs of current practice and their bits.
ACTIVITY = {
    "billing": 1, "prescribing": 2, "listed_clinician": 4, "enrollment": 8, "order_refer": 16, "payments": 32, "certified_facility": 64, "current_license": 128, "reassignment": 256, "score": 512,
    "affiliation": 1024, "map_listing": 2048, "equipment": 4096, "opioid_treatment": 8192, "state_enrollment": 16384, "state_billing": 32768,
}


def _bits(*names: str) -> int:
    return sum(REASONS[n] for n in names)


CLOSED = _bits("facility_closed", "listed_closed")
IDLE_CHECKS = _bits("not_updated_5", "medicare_stopped")
CHECKS = _bits("not_mapped", "po_box", "no_phone", "other_address", "other_specialty", "license_lapsed", "listing_only") | CLOSED


def classify(reasons: Column) -> Column:
    """The label of a registry record's reasons.

    Stale: no sign of practice with ten years without update or a closed
    practice; deceased; or another number of the organisation is current.  Check:
    no sign of practice with five years without update or billing that stopped;
    or a reason that always asks for one.  Else current.
    """
    has = lambda bits: reasons.bitwiseAND(F.lit(bits)) != 0
    idle = has(REASONS["no_activity"])
    stale = has(_bits("deceased", "other_current")) | (idle & (has(REASONS["not_updated_10"]) | has(CLOSED)))
    return F.when(stale, STALE).when((idle & has(IDLE_CHECKS)) | has(CHECKS), CHECK).otherwise(CURRENT)


def signs(sources: dict[str, list[DataFrame]], key: str) -> DataFrame:
    """(key, activity): the OR of the bits of the sources that list the key; one shuffle for all sources."""
    parts = [df.select(key).distinct().withColumn("bit", F.lit(ACTIVITY[name])) for name, tables in sources.items() for df in tables]
    return reduce(DataFrame.unionByName, parts).filter(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or("bit").alias("activity"))


def conflict(df: DataFrame, other: DataFrame, on: dict[str, str], agrees: DataFrame) -> DataFrame:
    """Rows that the other source knows and of which it agrees with none: some row there, but no row in ``agrees``, both by ``on``."""
    return filters.lacking(filters.having(df, other, on), agrees, on)


# Years without update that ask for a check and that make a record stale, and miles within which two places are one.
CHECK_YEARS, STALE_YEARS, SAME_AREA_MILES = 5, 10, 25


def _sign(name: str, keys: DataFrame) -> DataFrame:
    return keys.select("npi", F.lit(REASONS[name]).alias("bit"))


def license_reasons(licenses: DataFrame, activity: DataFrame, as_of: Column) -> DataFrame:
    """(npi, bit): holders of a lapsed licence (npi, kind, status, expiration_date) without one in force, and of one that says deceased."""
    own = licenses.filter("kind = 'license'")
    lapsed = own.filter((F.col("expiration_date") < as_of) | filters.is_inactive(F.col("status"))).select("npi").distinct()
    current = activity.filter(F.col("activity").bitwiseAND(F.lit(ACTIVITY["current_license"])) != 0)
    deceased = own.filter(F.contains(F.upper(F.coalesce("status", F.lit(""))), F.lit("DECEASED"))).select("npi").distinct()
    return _sign("license_lapsed", filters.lacking(lapsed, current, {"npi": "npi"})).unionByName(_sign("deceased", deceased))


def stopped_billing(years: DataFrame, current: DataFrame) -> DataFrame:
    """(npi, bit): who billed or prescribed in an older year (npi, data_year) than the newest of ``current`` (npi, data_year), and isn't in it."""
    newest = current.agg(F.coalesce(F.max("data_year"), F.lit(0)).alias("_newest"))
    old = years.join(F.broadcast(newest)).filter(F.col("data_year") < F.col("_newest")).select("npi").distinct()  # one row
    return _sign("medicare_stopped", filters.lacking(old, current, {"npi": "npi"}))


def address_reasons(listed: DataFrame, locations: DataFrame, centroids: DataFrame) -> DataFrame:
    """(npi, bit): whose practices another source lists (npi, zip5, state, city), none of them near one of the record's locations.

    Near: the same ZIP code, the same city and state, or ZIP centres less than SAME_AREA_MILES apart.  A source without a known ZIP code says nothing.
    """
    c = centroids.select("zip5", "lat", "lon")
    theirs = listed.select("npi", "zip5", "state", "city").distinct().join(c, "zip5", "left")
    known = theirs.filter("lat is not null").select("npi").distinct()
    ours = locations.select("npi", F.col("zip5").alias("_zip"), F.col("state").alias("_state"), F.col("city").alias("_city")).distinct().join(c.select(F.col("zip5").alias("_zip"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "_zip", "left")
    near = (F.col("zip5") == F.col("_zip")) | ((F.col("state") == F.col("_state")) & (F.col("city") == F.col("_city"))) | (geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) < SAME_AREA_MILES)
    agrees = theirs.join(ours, "npi").filter(near).select("npi").distinct()
    return _sign("other_address", filters.lacking(known, agrees, {"npi": "npi"}))


def specialty_reasons(clinicians: DataFrame, taxonomies: DataFrame, code_category: DataFrame, specialty_category: DataFrame) -> DataFrame:
    """(npi, bit): whose primary specialty elsewhere (npi, primary_specialty) is known, and none of whose codes lies in one of its categories."""
    wanted = clinicians.select("npi", F.col("primary_specialty").alias("specialty")).join(specialty_category, "specialty").select("npi", "category").distinct()
    own = taxonomies.join(code_category.withColumnRenamed("code", "taxonomy_code"), "taxonomy_code").select("npi", "category").distinct()
    agrees = wanted.join(own, ["npi", "category"], "left_semi").select("npi").distinct()
    return _sign("other_specialty", filters.lacking(wanted.select("npi").distinct(), agrees, {"npi": "npi"}))


def own_reasons(providers: DataFrame, locations: DataFrame, activity: DataFrame, map_points: DataFrame, address_types: DataFrame, as_of: Column) -> DataFrame:
    """(npi, bit): what a record's own row, its primary location and its signs of practice say.

    ``providers``: npi, last_update_date, phone; ``locations``: npi, is_primary,
    addr_key, zip5, address1, phone; ``map_points``: npi, addr_key, source;
    ``address_types``: addr_key, building_type; one row per key each.
    """
    first = locations.filter("is_primary").select("npi", "addr_key", "zip5", "address1", F.col("phone").alias("_phone"))
    out = providers.select("npi", "last_update_date", "phone").join(activity.select("npi", "activity"), "npi", "left").join(first, "npi", "left")
    out = out.join(map_points.select("npi", "addr_key", "source"), ["npi", "addr_key"], "left").join(address_types.select("addr_key", "building_type"), "addr_key", "left")
    since = lambda years: F.coalesce(F.col("last_update_date") < F.add_months(as_of, -12 * years), F.lit(False))
    tests = {
        "not_updated_5": since(CHECK_YEARS), "not_updated_10": since(STALE_YEARS), "no_activity": F.col("activity").isNull(),
        "listing_only": since(STALE_YEARS) & F.coalesce(F.col("activity") == ACTIVITY["map_listing"], F.lit(False)),
        "not_mapped": F.col("zip5").isNotNull() & (F.coalesce("source", F.lit("zip")) == "zip"), "po_box": filters.is_po_box(F.col("address1")),
        "no_phone": F.coalesce("_phone", "phone").isNull(), "home_address": F.coalesce(F.col("building_type") == "residential", F.lit(False)),
    }
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(test, REASONS[n]).otherwise(0) for n, test in tests.items()))
    return out.select("npi", bits.alias("bit"))


def labelled(reasons: list[DataFrame], activity: DataFrame, groups: DataFrame, ages: DataFrame, as_of: Column) -> DataFrame:
    """(npi, label, reasons, activity, other_npi) from the records' own reasons (first) and those of other tables.

    All reasons meet in one shuffle; then members of an organisation with a
    current number get that reason, which can't change a current label.  Reasons
    of keys without a record are left out.  What reasons a source gives is
    computed and put down before the next one's: all are dealt out by record, so
    that one task would else hold the sorts of all their joins at once.
    """
    from rosterlake.plans.session import checkpointed

    activity = checkpointed(activity)
    own, *others = map(checkpointed, reasons)
    records = own.select("npi").distinct()
    every = reduce(DataFrame.unionByName, others, own).groupBy("npi").agg(F.bit_or("bit").alias("reasons")).join(records, "npi", "left_semi")
    told = every.join(activity.select("npi", "activity"), "npi", "left").withColumn("activity", F.coalesce("activity", F.lit(0))).withColumn("label", classify(F.col("reasons")))
    told = checkpointed(told)  # taken three times
    other = other_current(told, groups, ages, as_of)
    out = told.join(other, "npi", "left").withColumn("reasons", F.when(F.col("other_npi").isNotNull(), F.col("reasons").bitwiseOR(F.lit(REASONS["other_current"]))).otherwise(F.col("reasons")))
    return out.select("npi", classify(F.col("reasons")).alias("label"), "reasons", "activity", "other_npi")


# Fixed value: years for which a number that was issued or updated isn't a leftover.
LEFTOVER_YEARS = 2


def other_current(labels: DataFrame, groups: DataFrame, ages: DataFrame, as_of: Column) -> DataFrame:
    """(npi, other_npi): members without a sign of practice whose organisation has a current number with signs, its main one if that is current.

    ``ages``: npi, enumeration_date, last_update_date.  A member issued or updated
    within LEFTOVER_YEARS before ``as_of`` is spared, as a new registration need not
    bill yet; a missing date counts as old.
    """
    known = labels.join(groups, "npi")
    anchor = known.filter((F.col("label") == CURRENT) & (F.col("activity") != 0)).groupBy("main_npi").agg(F.coalesce(F.max(F.when(F.col("is_main"), F.col("npi"))), F.min("npi")).alias("other_npi"))
    limit = F.add_months(as_of, -12 * LEFTOVER_YEARS)
    old = F.coalesce(F.col("enumeration_date") < limit, F.lit(True)) & F.coalesce(F.col("last_update_date") < limit, F.lit(True))
    idle = known.filter("activity = 0").join(ages.select("npi", "enumeration_date", "last_update_date"), "npi", "left").filter(old)
    return idle.join(anchor, "main_npi").filter("other_npi <> npi").select("npi", "other_npi")


def address_types(locations: DataFrame, providers: DataFrame, buildings: DataFrame, points: DataFrame) -> DataFrame:
    """(addr_key, building_type, suite, providers, org, business) of every practice address.

    ``buildings``: addr_key, occ_cls, prim_occ; ``points``: addr_key, source.  A
    suite, a listed place, five providers, or three with an organisation make an
    address a business; a home is where the building is and nothing says business.
    """
    address = F.upper(F.concat_ws(" ", "address1", "address2"))
    at = locations.filter("addr_key is not null").join(providers.select("npi", "entity_type"), "npi")
    own = at.groupBy("addr_key").agg(F.bool_or(F.rlike(address, F.lit(r"\b(STE|SUITE|FL|FLR|FLOOR|BLDG|BUILDING|RM|ROOM)\b"))).alias("suite"), F.count_distinct("npi").alias("providers"), F.bool_or(F.col("entity_type") == 2).alias("org"))
    own = own.join(buildings.select("addr_key", "occ_cls", "prim_occ"), "addr_key", "left").join(points.select("addr_key", "source"), "addr_key", "left")
    business = F.col("suite") | F.coalesce(F.col("source").isin("place", "place_name"), F.lit(False)) | (F.col("providers") >= 5) | (F.col("org") & (F.col("providers") >= 3))
    home = F.col("occ_cls") == "Residential"
    kind = F.when((home & F.col("prim_occ").isin("Nursing Home", "Institutional Dormitory")) | business, "commercial").when(home, "residential").when(F.col("occ_cls").isNull() | (F.col("occ_cls") == "Unclassified"), "unknown").otherwise("commercial")
    return own.select("addr_key", kind.alias("building_type"), "suite", "providers", "org", business.alias("business"))
