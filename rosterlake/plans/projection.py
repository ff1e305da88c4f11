"""The wide registry record as conformed tables.

Column names are the record's own, with underscores; the practice address's are
shortened to Practice_Address, Practice_City_Name, Practice_State_Name,
Practice_Postal_Code and Practice_Country_Code_If_outside_US.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import text
from rosterlake.operators import aggregate, reshape

TAXONOMY_SLOTS, IDENTIFIER_SLOTS = 15, 50


def _t(name: str) -> Column:
    return text.trimmed(F.col(name))


def deactivated(raw: DataFrame) -> DataFrame:
    """npi, deactivated_on of records that are deactivated and not reactivated on that day or later."""
    off, on = text.mdy_date(F.col("NPI_Deactivation_Date")), text.mdy_date(F.col("NPI_Reactivation_Date"))
    return raw.select(F.col("NPI").alias("npi"), off.alias("deactivated_on"), on.alias("_on")).filter("deactivated_on is not null and (_on is null or _on < deactivated_on)").drop("_on")


def active(raw: DataFrame) -> DataFrame:
    """Records in scope: entity type 1 or 2, not deactivated."""
    return raw.filter(F.trim("Entity_Type_Code").isin("1", "2")).join(deactivated(raw).select(F.col("npi").alias("_npi")), F.col("NPI") == F.col("_npi"), "left_anti")


def primary_taxonomy() -> Column:
    """The code of the first slot flagged Y that has a code, else slot 1."""
    flagged = (F.when((F.upper(F.trim(f"Healthcare_Provider_Primary_Taxonomy_Switch_{i}")) == "Y") & _t(f"Healthcare_Provider_Taxonomy_Code_{i}").isNotNull(), _t(f"Healthcare_Provider_Taxonomy_Code_{i}")) for i in range(1, TAXONOMY_SLOTS + 1))
    return F.coalesce(*flagged, _t("Healthcare_Provider_Taxonomy_Code_1"))


def providers(raw: DataFrame) -> DataFrame:
    """One row per active record."""
    last, first, org = _t("Provider_Last_Name_Legal_Name"), _t("Provider_First_Name"), _t("Provider_Organization_Name_Legal_Business_Name")
    credential = _t("Provider_Credential_Text")
    person = F.trim("Entity_Type_Code") == "1"
    return active(raw).select(
        F.col("NPI").alias("npi"), F.trim("Entity_Type_Code").cast("int").alias("entity_type"), last.alias("last_name"), first.alias("first_name"), _t("Provider_Middle_Name").alias("middle_name"), org.alias("org_name"),
        F.coalesce(F.when(person, F.concat_ws(", ", last, first)), org, F.lit("")).alias("sort_name"), credential.alias("credential"), F.nullif(F.upper(F.regexp_replace(credential, "[^A-Za-z0-9]", "")), F.lit("")).alias("credential_key"),
        F.when(person, _t("Provider_Gender_Code")).alias("gender"), primary_taxonomy().alias("primary_taxonomy_code"), text.mdy_date(F.col("Provider_Enumeration_Date")).alias("enumeration_date"), text.mdy_date(F.col("Last_Update_Date")).alias("last_update_date"),
        text.phonetic_key(last).alias("last_phonetic"), text.phonetic_key(first).alias("first_phonetic"),
    )


def taxonomies(raw: DataFrame) -> DataFrame:
    """npi, slot, taxonomy_code, is_primary, license_no, license_state; empty slots go."""
    slots = [{"taxonomy_code": f"Healthcare_Provider_Taxonomy_Code_{i}", "license_no": f"Provider_License_Number_{i}", "license_state": f"Provider_License_Number_State_Code_{i}", "switch": f"Healthcare_Provider_Primary_Taxonomy_Switch_{i}"} for i in range(1, TAXONOMY_SLOTS + 1)]
    rows = reshape.unpivot_slots(active(raw), ["NPI"], slots, need="taxonomy_code")
    state = F.when(F.upper(F.trim("license_state")) != "NULL", _t("license_state"))
    return rows.select(F.col("NPI").alias("npi"), "slot", F.trim("taxonomy_code").alias("taxonomy_code"), (F.upper(F.trim("switch")) == "Y").alias("is_primary"), _t("license_no").alias("license_no"), state.alias("license_state"))


def _location(npi: str, prefix: str, first: str, primary: bool) -> list[Column]:
    postal, country = F.col(f"{prefix}_Postal_Code"), F.col(f"{prefix}_Country_Code_If_outside_US")
    parts = [_t(f"{prefix}_{first}"), _t(f"{prefix}_City_Name"), _t(f"{prefix}_State_Name"), text.zip5(postal, country)]
    return [F.col(npi).alias("npi"), F.lit(primary).alias("is_primary"), parts[0].alias("address1"), parts[1].alias("city"), parts[2].alias("state"), parts[3].alias("zip5"), text.zip4(postal, country).alias("zip4"), F.md5(F.concat_ws("|", *(F.upper(F.coalesce(p, F.lit(""))) for p in parts))).alias("addr_key")]


def locations(raw: DataFrame, secondary: DataFrame) -> DataFrame:
    """The practice address and the secondary ones of active records."""
    scope = active(raw)
    first = scope.select(*_location("NPI", "Practice", "Address", True))
    more = secondary.join(scope.select("NPI"), "NPI", "left_semi").select(*_location("NPI", "Practice", "Address", False))
    return first.unionByName(more)


def search_cells(taxonomy: DataFrame, location: DataFrame) -> DataFrame:
    """Distinct (taxonomy, state, city, zip5, npi): what a search touches."""
    return taxonomy.select("npi", "taxonomy_code").join(location.select("npi", "state", "city", "zip5"), "npi").distinct()


def content_hashes(raw: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], columns: list[str]) -> DataFrame:
    """npi, hash over the record's own columns and each child table's rows in any order."""
    own = raw.select(F.col("NPI").alias("npi"), F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("\x00")) for c in columns))).alias("own"))
    parts = ["own"]
    for name, (child, cols) in children.items():
        own = own.join(aggregate.multiset_hash(child.withColumnRenamed("NPI", "npi"), ["npi"], cols, name), "npi", "left")
        parts.append(name)
    return own.select("npi", F.md5(F.concat_ws("|", *(F.coalesce(F.col(p), F.lit("")) for p in parts))).alias("hash"))


def identifiers(raw: DataFrame) -> DataFrame:
    """npi, slot, identifier, type_code, state, issuer of active records; empty slots go."""
    names = {"identifier": "Other_Provider_Identifier", "type_code": "Other_Provider_Identifier_Type_Code", "state": "Other_Provider_Identifier_State", "issuer": "Other_Provider_Identifier_Issuer"}
    slots = [{out: f"{c}_{i}" for out, c in names.items()} for i in range(1, IDENTIFIER_SLOTS + 1)]
    rows = reshape.unpivot_slots(active(raw), ["NPI"], slots, need="identifier")
    return rows.select(F.col("NPI").alias("npi"), "slot", *(_t(c).alias(c) for c in names))


def other_names(raw: DataFrame, more: DataFrame) -> DataFrame:
    """npi, name, type_code: other organisation names of active records, each once."""
    named = more.join(active(raw).select("NPI"), "NPI", "left_semi")
    return named.select(F.col("NPI").alias("npi"), _t("Provider_Other_Organization_Name").alias("name"), _t("Provider_Other_Organization_Name_Type_Code").alias("type_code")).filter("name is not null").distinct()


def endpoints(raw: DataFrame, more: DataFrame) -> DataFrame:
    """npi, type, endpoint, use, content, affiliation of active records."""
    listed = more.join(active(raw).select("NPI"), "NPI", "left_semi")
    return listed.select(F.col("NPI").alias("npi"), _t("Endpoint_Type").alias("type"), _t("Endpoint").alias("endpoint"), _t("Use_Code").alias("use"), _t("Content_Type").alias("content"), F.coalesce(text.yes_no(F.col("Affiliation")), F.lit(False)).alias("affiliation")).filter("endpoint is not null")


def org_names(provider: DataFrame, other: DataFrame) -> DataFrame:
    """npi, name: distinct legal and other names of organisations (P10)."""
    return provider.filter("org_name is not null").select("npi", F.col("org_name").alias("name")).unionByName(other.select("npi", "name")).distinct()


def incremental(tables: dict[str, DataFrame], fresh: dict[str, DataFrame], changed: DataFrame, total: int, most: float = 0.1) -> dict[str, DataFrame] | None:
    """Every table with the rows of the changed keys replaced; None if more than ``most`` of all keys changed, so that a full build is due."""
    from rosterlake.operators import upsert

    if changed.select("npi").distinct().count() > most * total:
        return None
    return {name: upsert.replace_keys(df, fresh[name], changed, ["npi"]) for name, df in tables.items()}


def display_name(last: Column, first: Column, middle: Column, credential: Column, org: Column) -> Column:
    """A name as it is shown: title case, an organisation's as it is."""
    person = F.nullif(F.concat_ws(" ", F.initcap(first), F.initcap(middle), F.initcap(last)), F.lit(""))
    return F.coalesce(F.when(person.isNotNull(), F.concat_ws(", ", person, credential)), org)


def display_zip(zip5: Column, zip4: Column) -> Column:
    """12345-6789, or the five digits."""
    return F.when(zip4.isNotNull(), F.concat_ws("-", zip5, zip4)).otherwise(zip5)
