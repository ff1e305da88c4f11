"""The external datasets: each one's files as typed specs, and the tables that its rows become.

A dataset has one or more files, each with its own headers.  ``load`` reads them
and applies the dataset's build, a function from the raw tables to the target
tables, so that a build can be used on any tables with the raw columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import text
from rosterlake.operators import aggregate, filters, ranking, reshape
from rosterlake.sources.delimited import Field, FileSpec, read

Tables = dict[str, DataFrame]
OW, ON = "optional_whole", "optional_number"


def spec(*columns: str, **more) -> FileSpec:
    """A file's columns, each as "header | name | kind"; the kind is text where it is left out, a ? behind it makes the column optional."""
    fields = []
    for c in columns:
        header, name, kind = ([p.strip() for p in c.split("|")] + ["text"])[:3]
        fields.append(Field(name, header, kind.rstrip("?"), not kind.endswith("?")))
    return FileSpec(tuple(fields), **more)


@dataclass(frozen=True)
class Dataset:
    files: dict[str, FileSpec]  #: by part
    build: Callable[[Tables], Tables]
    constant: str | None = None  #: the column that tells the parts apart, where they become one raw table
    about: dict[str, str] = field(default_factory=dict)


def only(table: str) -> Callable[[Tables], Tables]:
    """One file that is a table as it is."""
    return lambda raw: {table: raw["main"]}


def _first(n: int, c: Column) -> Column:
    return F.left(c, F.lit(n))


def _max(*columns: str) -> list[Column]:
    return [F.max(c).alias(c) for c in columns]


def _zip5(c: str) -> Column:
    return F.regexp_extract(c, r"^[0-9]{5}", 0)


def _money(c: str | Column) -> Column:
    return aggregate.money(c)


# --- clinicians and facilities ----------------------------------------------------------------------------------------


def clinicians(raw: Tables) -> Tables:
    """One row per clinician, per clinician and group, and per clinician and ZIP code."""
    r = raw["main"]
    yes = lambda c: F.coalesce(F.max(F.col(c) == "Y"), F.lit(False))
    return {
        "cc_clinician": r.groupBy("npi").agg(*_max("ind_pac_id", "medical_school", "graduation_year", "primary_specialty", "secondary_specialties"), yes("ind_assignment").alias("accepts_assignment"), yes("telehealth").alias("telehealth")),
        "cc_group": r.filter("org_pac_id is not null").groupBy("npi", "org_pac_id").agg(F.max("group_name").alias("group_name"), F.max("group_members").alias("members"), yes("grp_assignment").alias("accepts_assignment"), F.min("city").alias("city"), F.min("state").alias("state")),
        "cc_clinician_location": r.withColumn("zip5", _zip5("zip")).filter("zip5 <> ''").groupBy("npi", "zip5").agg(*(F.min(c).alias(c) for c in ("address1", "city", "state"))),
    }


def associate_id(c: str) -> Column:
    """An associate id of ten digits; anything else is null."""
    return F.when(F.rlike(c, F.lit(r"^[0-9]{1,10}$")), F.lpad(c, 10, "0"))


def facility_enrollments(raw: Tables) -> Tables:
    """Distinct (ccn, npi), and one row per enrollment."""
    r = raw["main"]
    one = r.filter("enrollment_id is not null and length(enrollment_id) <= 20").groupBy("enrollment_id")
    return {
        "cms_facility_npi": r.filter("ccn is not null and npi is not null").groupBy("ccn", "npi").agg(F.min("kind").alias("kind")),
        "cms_facility_enrollment": one.agg(F.min("kind").alias("kind"), *_max("ccn", "npi"), F.max(associate_id("associate_id")).alias("associate_id"), _first(200, F.max("org_name")).alias("org_name"), F.max(F.when(F.length("state") == 2, F.col("state"))).alias("state")),
    }


# Codes of roles that mean ownership, and control.
OWNERSHIP_ROLES, CONTROL_ROLES = ("34", "35", "38", "39", "85", "86"), ("43", "25", "63", "71", "72")


# Kinds of owners that a file marks, by the column's header.
OWNER_KINDS = {
    "PRIVATE EQUITY COMPANY - OWNER": "private_equity", "REIT - OWNER": "reit", "INVESTMENT FIRM - OWNER": "investment_firm", "HOLDING COMPANY - OWNER": "holding_company", "CHAIN HOME OFFICE - OWNER": "chain_home_office", "MANAGEMENT SERVICES COMPANY - OWNER": "management_company",
    "MEDICAL STAFFING COMPANY - OWNER": "staffing_company", "FINANCIAL INSTITUTION - OWNER": "financial_institution", "CONSULTING FIRM - OWNER": "consulting_firm", "MEDICAL PROVIDER SUPPLIER - OWNER": "medical_provider", "CREATED FOR ACQUISITION - OWNER": "created_for_acquisition",
    "PARENT COMPANY - OWNER": "parent_company", "TRUST OR TRUSTEE - OWNER": "trust", "FOR PROFIT - OWNER": "for_profit", "NON PROFIT - OWNER": "non_profit", "CORPORATION - OWNER": "corporation", "LLC - OWNER": "llc",
}


def facility_owners(raw: Tables) -> Tables:
    """An owner per enrollment and role, and the organisations that own with their number of facilities."""
    r = raw["main"].filter("length(enrollment_id) <= 20 and length(role_code) <= 4 and owner_type in ('I', 'O')").filter(F.rlike("owner_id", F.lit("^[0-9]{1,10}$")))
    name = F.when(F.col("owner_type") == "I", F.nullif(F.concat_ws(" ", "first_name", "middle_name", "last_name"), F.lit(""))).otherwise(F.coalesce("org_name", "dba_name"))
    kinds = F.nullif(F.concat_ws(",", *(F.when(F.col(f"is_{k}"), k) for k in OWNER_KINDS.values())), F.lit(""))
    owner = r.withColumns({"owner_id": F.lpad("owner_id", 10, "0"), "name": name, "owner_kinds": kinds}).groupBy("enrollment_id", "owner_id", "role_code").agg(
        F.min("kind").alias("kind"), F.max(F.lpad("facility_associate_id", 10, "0")).alias("facility_associate_id"), _first(200, F.max("facility_name")).alias("facility_name"), F.max("owner_type").alias("owner_type"),
        _first(100, F.max("role_text")).alias("role_text"), F.min("association_date").alias("association_date"), _first(200, F.max("name")).alias("name"), _first(100, F.max("title")).alias("title"), _first(200, F.max("dba_name")).alias("dba_name"),
        _first(60, F.max("city")).alias("city"), _first(2, F.max("state")).alias("state"), *_max("percentage", "owner_kinds"),
    )
    owned = F.count_distinct(F.when(F.col("role_code").isin(*OWNERSHIP_ROLES), F.col("enrollment_id")))
    entity = owner.groupBy("owner_id").agg(*_max("owner_type", "name", "dba_name", "city", "state", "owner_kinds"), F.count_distinct("enrollment_id").alias("facilities"), owned.alias("owned"), F.min("owner_type").alias("least"))
    return {"facility_owner": owner, "facility_owner_entity": entity.filter("least = 'O'").drop("least").withColumn("name", F.coalesce("name", F.concat(F.lit("Owner "), "owner_id")))}


def ownership_changes(raw: Tables) -> Tables:
    """Changes of ownership, and who owned or controlled the sellers."""
    change = raw["changes"].withColumns({c: F.lpad(c, 10, "0") for c in ("buyer_associate_id", "seller_associate_id")})
    seller = change.filter("seller_enrollment_id is not null")
    owner = facility_owners({"main": raw["owners"]})["facility_owner"].filter(F.col("role_code").isin(*OWNERSHIP_ROLES, *CONTROL_ROLES))
    return {"facility_ownership_change": change, "facility_ownership_change_owner": filters.having(owner, seller, {"enrollment_id": "seller_enrollment_id"}).select("enrollment_id", "owner_id", "role_code", "owner_type", "name", "role_text", "percentage")}


#: Citations kept of a nursing home, the most serious and the newest.
CITATIONS = 10


def inspections(raw: Tables) -> Tables:
    """Surveys, counts of deficiencies, citations, tags and penalties of nursing homes."""
    d = raw["deficiencies"].filter("length(ccn) <= 10 and survey_date is not null and length(prefix) <= 2 and length(tag) <= 6").filter(F.rlike("scope_severity", F.lit("^[A-L]$")))
    cycle, complaints = F.coalesce("cycle", F.lit(0)), F.count_if("complaint").alias("complaint")
    cited = d.groupBy("ccn", "kind", "survey_date", "prefix", "tag").agg(
        F.coalesce(F.min("cycle"), F.lit(0)).alias("cycle"), F.max("scope_severity").alias("scope_severity"), _first(80, F.max("corrected")).alias("corrected"), F.max("correction_date").alias("correction_date"),
        F.coalesce(F.max("complaint"), F.lit(False)).alias("complaint"), F.coalesce(F.max("infection_control"), F.lit(False)).alias("infection_control"),
    )
    tie = [F.asc("kind"), F.asc("prefix"), F.asc("tag")]
    serious = ranking.top_n(cited, ["ccn"], [F.desc("scope_severity"), F.desc("survey_date"), *tie], CITATIONS).select(*cited.columns)
    newest = ranking.top_n(cited, ["ccn"], [F.desc("survey_date"), F.desc("scope_severity"), *tie], CITATIONS).select(*cited.columns)
    return {
        "nh_deficiency_tag": d.groupBy("prefix", "tag").agg(_first(120, F.max("category")).alias("category"), _first(600, F.max("description")).alias("description")),
        "nh_deficiency_count": d.groupBy("ccn", "kind", cycle.alias("cycle"), "scope_severity").agg(F.count("*").alias("deficiencies"), complaints),
        "nh_survey": d.groupBy("ccn", "kind", "survey_date").agg(F.coalesce(F.min("cycle"), F.lit(0)).alias("cycle"), F.count("*").alias("deficiencies"), complaints, F.max("scope_severity").alias("most_severe")),
        "nh_citation": serious.unionByName(newest).distinct(),
        "nh_penalty": raw["penalties"].filter("ccn is not null and length(ccn) <= 10").withColumn("penalty_type", _first(40, F.col("penalty_type"))),
    }


def revalidation(raw: Tables) -> Tables:
    return {"medicare_revalidation": raw["main"].filter("npi is not null").groupBy("npi").agg(F.max(F.coalesce("adjusted_due_date", "due_date")).alias("due_date"))}


def dme_suppliers(raw: Tables) -> Tables:
    return {"medicare_dme_supplier": raw["main"].filter("npi is not null").groupBy("npi").agg(*_max("beneficiaries", "claims"))}


def otp_providers(raw: Tables) -> Tables:
    return {"cms_otp_provider": raw["main"].filter("npi is not null").groupBy("npi").agg(F.max("name").alias("name"), F.min("effective_date").alias("effective_date"))}


def provider_of_services(raw: Tables) -> Tables:
    """Certified facilities of two files; the second one's row stays where both have a facility."""
    both = raw["main"].filter("ccn is not null")
    active = F.when(F.col("part") == "2", F.coalesce("status", F.lit("")) != "Terminated").otherwise(F.coalesce("termination_code", F.lit("00")) == "00")
    one = ranking.latest(both, ["ccn"], [F.desc("part"), F.asc("name"), F.asc("address"), F.asc("termination_date")])
    return {
        "cms_pos_facility": one.select(
            "ccn", _first(150, F.col("name")).alias("name"), "category", _first(150, F.col("address")).alias("address"), _first(60, F.col("city")).alias("city"), "state", F.nullif(_zip5("zip"), F.lit("")).alias("zip5"),
            active.alias("active"), F.when(F.rlike("termination_code", F.lit("^[0-9]{2}$")), F.col("termination_code")).alias("termination_code"), "termination_date",
        )
    }


def medicare_enrollment(raw: Tables) -> Tables:
    e = raw["enrollments"].filter("npi is not null and enrollment_id is not null").groupBy("npi", "enrollment_id").agg(*_max("pac_id", "provider_type", "state", "org_name"))
    return {"medicare_enrollment": e, "medicare_reassignment": raw["reassignments"].filter("record_type is null or record_type = 'Reassignment'")}


def hospital_survey(raw: Tables) -> Tables:
    r = raw["main"].filter("ccn is not null and measure_id = 'H_STAR_RATING'")
    return {"cms_hospital_survey": r.groupBy("ccn").agg(*_max("star_rating", "surveys", "response_rate"))}


def _rated(listing: DataFrame, survey: DataFrame, name: str) -> DataFrame:
    return listing.join(survey.groupBy("ccn").agg(F.max("star_rating").alias(name)), "ccn", "left")


def hospices(raw: Tables) -> Tables:
    return {"cms_hospice": _rated(raw["listing"], raw["survey"].filter("measure_code = 'SUMMARY_STAR_RATING'"), "family_rating")}


def dialysis(raw: Tables) -> Tables:
    out = _rated(raw["listing"], raw["survey"].filter("star_rating between 1 and 5"), "survey_rating")
    return {"cms_dialysis": out.withColumn("survey_rating", F.round("survey_rating").cast("int"))}


SURGERY = ("asc9_rate", "asc13_rate", *(f"asc{n}_{c}" for n in (12, 17, 18, 19) for c in ("cases", "category", "rate")))


def surgery_centers(raw: Tables) -> Tables:
    r = raw["main"].filter(F.rlike("ccn", F.lit("^[0-9A-Za-z]+$")) & F.length("ccn").isin(6, 10))
    measures = [_first(60, F.max(c)).alias(c) if c.endswith("category") else F.max(c).alias(c) for c in SURGERY]
    return {"cms_asc": r.groupBy(F.upper("ccn").alias("ccn"), F.coalesce("npi", F.lit("")).alias("npi")).agg(_first(200, F.max("name")).alias("name"), F.max("city").alias("city"), _first(2, F.max("state")).alias("state"), *_max("zip", "data_year"), *measures)}


def dialysis_qip(raw: Tables) -> Tables:
    r = raw["main"].filter(F.rlike("ccn", F.lit("^[0-9A-Za-z]+$")))
    whole = [F.max(F.when(F.rlike(c, F.lit("^[0-9]+$")), F.col(c).cast("int"))).alias(c) for c in ("total_score", "state_average", "national_average")]
    cut = F.replace(F.col("payment_reduction"), F.lit("%"), F.lit(""))
    return {"cms_dialysis_qip": r.groupBy(F.upper("ccn").alias("ccn")).agg(*whole, F.max(F.when(F.rlike(cut, F.lit(r"^[0-9]+([.][0-9]+)?$")), cut.cast("double"))).alias("payment_reduction"))}


def post_acute(raw: Tables) -> Tables:
    """Listings, and each facility's measures as rows with a number where the score is one."""
    m = raw["measures"].filter("ccn is not null and code is not null").groupBy("ccn", "code").agg(F.max(text.number(F.col("score"))).alias("score"), *_max("start_date", "end_date"))
    return {"cms_post_acute": raw["listing"], "cms_post_acute_measure": m}


def hospital_measures(raw: Tables) -> Tables:
    """Measures of hospitals, and of the nation under the key NATION."""
    r = raw["main"].withColumn("ccn", F.upper(F.coalesce("ccn", F.lit("NATION"))))
    g = r.filter("code is not null").groupBy("ccn", F.replace(F.col("code"), F.lit("-"), F.lit("_")).alias("measure_id"))
    return {"cms_hospital_measure": g.agg(F.max(text.number(F.col("score"))).alias("score"), _first(60, F.max("compared")).alias("compared"), F.round(F.max(text.number(F.col("cases")))).alias("cases"), *_max("start_date", "end_date"))}


#: Services kept of a hospital and setting.
TOP_SERVICES = 10


def hospital_volume(raw: Tables) -> Tables:
    """Inpatient and outpatient totals in one row, and the top services of each setting."""
    t, s = raw["totals"].filter("ccn is not null"), raw["services"].filter("ccn is not null").withColumn("ccn", F.upper("ccn"))
    inside = t.groupBy(F.upper("ccn").alias("ccn")).agg(*_max("discharges", "beneficiaries", "covered_days", "medicare_payments", "total_payments"))
    out = s.filter("setting = 'O'").groupBy("ccn").agg(F.sum("cases").alias("outpatient_services"), F.sum(F.col("cases") * F.col("avg_medicare_payment")).alias("outpatient_payments"))
    top = ranking.top_n(s.filter("code is not null and cases is not null"), ["ccn", "setting"], [F.desc("cases"), F.asc("code")], TOP_SERVICES, "service_rank")
    return {"cms_hospital_volume": inside.join(out, "ccn", "full_outer"), "cms_hospital_service": top.withColumn("description", _first(255, F.col("description")))}


# --- use, areas -------------------------------------------------------------------------------------------------------


def top_services(raw: Tables) -> Tables:
    """The five services that each clinician gave most often."""
    order = [F.desc("services"), F.desc("beneficiaries"), F.asc("hcpcs"), F.asc("place_of_service")]
    return {"medicare_top_service": ranking.top_n(raw["main"].filter("npi is not null"), ["npi"], order, 5, "service_rank")}


def part_d_brands(raw: Tables) -> Tables:
    """Claims by brand and prescriber, and by brand; a drug sold under its generic name is no brand."""
    r = raw["main"].withColumns({"brand": _first(255, F.trim("brand")), "generic": F.trim("generic")})
    own = r.filter("npi is not null and coalesce(brand, '') <> '' and upper(brand) <> upper(coalesce(generic, ''))")
    by = own.groupBy("brand", "npi").agg(F.sum(F.coalesce("claims", F.lit(0))).alias("claims"), F.sum("fills").alias("fills"), F.round(F.sum("drug_cost"), 2).alias("drug_cost"), F.sum("beneficiaries").alias("beneficiaries"))
    named = r.groupBy("brand").agg(F.max("generic").alias("generic"))
    brand = by.groupBy("brand").agg(F.count("*").alias("prescribers"), F.sum("claims").alias("claims"), F.round(F.sum("drug_cost"), 2).alias("drug_cost"), F.sum("beneficiaries").alias("beneficiaries"))
    return {"part_d_brand_prescriber": by, "part_d_brand": brand.join(named, "brand", "left")}


def shortage_areas(raw: Tables) -> Tables:
    """Designated areas per county and discipline."""
    r = raw["main"].filter(F.col("status").isin("Designated", "Proposed For Withdrawal") & F.rlike("county_fips", F.lit("^[0-9]{5}$")))
    whole = F.coalesce(F.max(F.col("component_type") == "Single County"), F.lit(False))
    return {"county_shortage": r.groupBy("county_fips", "discipline").agg(whole.alias("whole_county"), F.count_distinct("hpsa_id").alias("hpsa_count"), F.max("score").alias("max_score"))}


def county_population(raw: Tables) -> Tables:
    r = raw["main"].filter("sumlev = '050' and population is not null")
    return {"county_population": r.select(F.concat("state_fips", "county_code").alias("county_fips"), "state_fips", "county_code", "population")}


def drug_prices(raw: Tables) -> Tables:
    """The newest price of each drug code."""
    r = raw["main"].filter(F.rlike("ndc", F.lit("^[0-9]{11}$")) & F.col("per_unit").isNotNull())
    return {"nadac": ranking.latest(r, ["ndc"], [F.desc_nulls_last("as_of"), F.desc_nulls_last("effective_date"), F.asc("per_unit"), F.asc("description")])}


def drug_spending(raw: DataFrame, program: str, newest: int = 5) -> DataFrame:
    """Spending by drug and year from columns with a year behind them; of drugs listed by maker, the row over all makers."""
    years = sorted({int(c.rsplit("_", 1)[1]) for c in raw.columns if c.lower().startswith("tot_spndng_")})[-newest:]
    rows = raw.filter(F.col("Mftr_Name") == "Overall") if "Mftr_Name" in raw.columns else raw
    clean = lambda c: _first(255, F.rtrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("*")))
    value = lambda prefix, y: text.number(F.col(f"{prefix}_{y}")) if f"{prefix}_{y}" in raw.columns else F.lit(None).cast("double")
    slots = [F.struct(F.lit(y).alias("year"), *(value(prefix, y).alias(name) for prefix, name in (("Tot_Spndng", "spending"), ("Tot_Dsg_Unts", "units"), ("Tot_Clms", "claims"), ("Tot_Benes", "beneficiaries")))) for y in years]
    flat = rows.filter("Brnd_Name is not null").select(clean(F.col("Brnd_Name")).alias("brand_name"), clean(F.col("Gnrc_Name")).alias("generic_name"), F.inline(F.array(*slots))).filter("spending is not null")
    return flat.groupBy("brand_name", "generic_name", "year").agg(F.round(F.sum("spending"), 2).alias("spending"), *(F.sum(c).alias(c) for c in ("units", "claims", "beneficiaries"))).withColumn("program", F.lit(program))


def enforcement(raw: Tables) -> Tables:
    """Recalls with the key of the firm's name."""
    return {"fda_enforcement": raw["main"].withColumn("firm_key", text.name_key(F.col("firm")))}


def activity_year(table: DataFrame, incoming: DataFrame, bit: int, year: int, value: str) -> DataFrame:
    """(data_year, npi, parts, values): a year's part replaced by what came in; keys that are gone lose the part's bit and value."""
    own = table.filter(F.col("data_year") == year)
    new = incoming.groupBy("npi").agg(F.max("value").alias("_new"))
    both = own.join(new, "npi", "full_outer")
    has = F.col("_new").isNotNull()
    kept = F.coalesce("parts", F.lit(0)).bitwiseAND(F.lit(~bit))
    parts = F.when(has, kept.bitwiseOR(F.lit(bit))).otherwise(kept)
    columns = [F.col("_new").alias(c) if c == value else parts.alias(c) if c == "parts" else F.lit(year).alias(c) if c == "data_year" else F.col(c) for c in table.columns]
    return table.filter(F.col("data_year") != year).unionByName(both.select(*columns))


# --- payments ---------------------------------------------------------------------------------------------------------

#: Rows kept: payers of a recipient, products of a company, specialties and recipients of a product, products of a recipient.
PAYERS, COMPANY_PRODUCTS, SPECIALTIES, RECIPIENTS, PROVIDER_PRODUCTS, COMPANIES, STUDIES = 3, 25, 10, 100, 5, 5, 10
SLOT_COLUMNS = {"name": "product", "kind": "product_kind", "category": "product_category", "ndc": "ndc", "device_id": "device_id"}


def payment_products(raw: DataFrame, slots: int = 5) -> DataFrame:
    """A row for each payment and product that it names."""
    named = [{out: c if n == 1 else f"{c}{n}" for out, c in SLOT_COLUMNS.items()} for n in range(1, slots + 1)]
    keep = [c for c in raw.columns if c in ("npi", "company_id", "nature", "amount", "records", "payment_id")]
    rows = reshape.unpivot_slots(raw, keep, named, need="name")
    return rows.withColumn("slug", text.slug(F.col("name"))).filter("slug <> ''")


def most_used(products: DataFrame, columns: list[str]) -> DataFrame:
    """(slug, columns): of each column the value with most money, then most rows, then the least.

    All columns go through one shuffle of (slug, column, value), then one of the best of each.
    """
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns)))
    each = products.select("slug", "amount", pair.alias("p")).select("slug", "amount", "p.*").filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    used = each.groupBy("slug", "column", "value").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("m"), F.count("*").alias("n"))
    picks = [F.min(F.when(F.col("column") == c, F.struct((-F.col("m")).alias("m"), (-F.col("n")).alias("n"), "value"))).alias(f"_{c}") for c in columns]
    return used.groupBy("slug").agg(*picks).select("slug", *(F.col(f"_{c}.value").alias(c) for c in columns))


def open_payments(raw: Tables) -> Tables:
    """The payments of a year as summaries by recipient, company and product. ``provider``: npi, specialty of the registry."""
    r, registry = raw["main"], raw["provider"]
    records = F.count("*").alias("records")
    nature = aggregate.named_nature("nature").alias("nature")
    known = r.filter("npi is not null")
    paid = known.filter("payer is not null").groupBy("npi", "company_id").agg(F.max("payer").alias("payer"), _money("amount").alias("amount"), records)
    products = payment_products(r)
    pairs = products.filter("npi is not null").groupBy("slug", "npi").agg(_money("amount").alias("amount"), records)
    product = products.groupBy("slug").agg(_money("amount").alias("amount"), records, F.count_distinct("company_id").alias("companies"), F.count_distinct("npi").alias("providers"))
    product = product.join(most_used(products, list(SLOT_COLUMNS)), "slug", "left")
    product = product.withColumn("name", F.coalesce("name", "slug"))
    company = products.filter("company_id is not null").groupBy("company_id", "slug").agg(F.upper(F.max("name")).alias("product"), F.max("kind").alias("kind"), F.max("category").alias("category"), _money("amount").alias("amount"), records)
    placed = pairs.join(registry, "npi")
    special = placed.filter("specialty is not null").groupBy("slug", "specialty").agg(F.count("*").alias("providers"), F.round(F.sum("amount"), 2).alias("amount"))
    return {
        "open_payments_summary": known.groupBy("npi").agg(_money("amount").alias("total_amount"), records, F.count_distinct("payer").alias("payers")),
        "open_payments_nature": known.groupBy("npi", nature).agg(_money("amount").alias("amount"), records),
        "open_payments_payer": ranking.top_n(paid, ["npi"], [F.desc("amount"), F.asc("payer"), F.asc("company_id")], PAYERS, "payer_rank"),
        "op_company_nature": r.filter("company_id is not null").groupBy("company_id", nature).agg(_money("amount").alias("amount"), records),
        "op_company_product": ranking.top_n(company, ["company_id"], [F.desc("amount"), F.asc("slug")], COMPANY_PRODUCTS, "product_rank"),
        "op_product": product,
        "op_product_npi": filters.having(pairs, product, {"slug": "slug"}, F.col("kind").isin("Drug", "Biological")),
        "op_product_company": products.filter("company_id is not null").groupBy("slug", "company_id").agg(_money("amount").alias("amount"), records),
        "op_product_nature": products.groupBy("slug", nature).agg(_money("amount").alias("amount"), records),
        "op_product_specialty": ranking.top_n(special, ["slug"], [F.desc("amount"), F.asc("specialty")], SPECIALTIES, "specialty_rank"),
        "op_product_recipient": ranking.top_n(filters.having(pairs, registry, {"npi": "npi"}), ["slug"], [F.desc("amount"), F.asc("npi")], RECIPIENTS, "recipient_rank"),
        "op_provider_product": ranking.top_n(pairs, ["npi"], [F.desc("amount"), F.asc("slug")], PROVIDER_PRODUCTS, "product_rank"),
    }


YEAR_SUMS = ("general_amount", "research_amount", "associated_research_amount", "invested_amount", "interest_value")
YEAR_COUNTS = ("general_records", "research_records", "associated_research_records", "ownership_records")


def payments_years(raw: Tables) -> Tables:
    r = raw["main"].filter(F.col("npi").isNotNull() & F.rlike("program_year", F.lit("^[0-9]+$")))
    return {"open_payments_year": r.groupBy("npi", F.col("program_year").cast("int").alias("program_year")).agg(*(_money(c).alias(c) for c in YEAR_SUMS), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in YEAR_COUNTS))}


def payments_companies(raw: Tables) -> Tables:
    """Sums by recipient and company, by kind of payment; reach, specialties and recipients of each company."""
    r, registry = raw["main"].filter("npi is not null and company is not null"), raw["provider"]
    part = lambda test: F.round(F.sum(F.when(test, F.coalesce("amount", F.lit(0.0))).otherwise(0.0)), 2)
    kind = F.col("payment_type")
    pairs = r.groupBy("npi", F.coalesce("company_id", F.lit("")).alias("company_id")).agg(
        F.max("company").alias("company"), _money("amount").alias("total_amount"), part(kind == "General").alias("general_amount"), part(kind == "Research").alias("research_amount"),
        part(kind == "Associated Research").alias("associated_research_amount"), part(F.startswith(kind, F.lit("Ownership"))).alias("ownership_amount"), F.sum(F.coalesce("records", F.lit(0))).alias("records"),
    )
    named = pairs.filter("company_id <> ''")
    special = named.join(registry, "npi").filter("specialty is not null").groupBy("company_id", "specialty").agg(F.count("*").alias("providers"), F.round(F.sum("total_amount"), 2).alias("amount"))
    top = ranking.top_n(pairs, ["npi"], [F.desc("total_amount"), F.asc("company"), F.asc("company_id")], COMPANIES, "company_rank")
    return {
        "open_payments_company": top.withColumn("company_id", F.nullif(F.col("company_id"), F.lit(""))),
        "op_company_reach": named.groupBy("company_id").agg(F.count("*").alias("providers"), F.round(F.sum("total_amount"), 2).alias("amount")),
        "op_company_specialty": ranking.top_n(special, ["company_id"], [F.desc("amount"), F.asc("specialty")], SPECIALTIES, "specialty_rank"),
        "op_company_recipient": ranking.top_n(filters.having(named, registry, {"npi": "npi"}), ["company_id"], [F.desc("total_amount"), F.asc("npi")], RECIPIENTS, "recipient_rank"),
    }


def payments_entities(raw: Tables) -> Tables:
    """Companies of the profiles and the yearly sums: names and places from the profile, else the newest year; name keys."""
    profile, yearly = raw["profiles"].filter("company_id is not null"), raw["years"].filter(F.col("company_id").isNotNull() & F.rlike("program_year", F.lit("^[0-9]+$"))).withColumn("program_year", F.col("program_year").cast("int"))
    sums, counts = ("general_amount", "research_amount", "invested_amount", "interest_value"), ("general_records", "research_records", "ownership_records")
    year = yearly.groupBy("company_id", "program_year").agg(*(_money(c).alias(c) for c in sums), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counts))
    alternate = [f"alt_name{n}" for n in range(1, 6)]
    of = profile.groupBy("company_id").agg(*_max("name", "state", "country", *alternate))
    last = ranking.latest(yearly, ["company_id"], [F.desc("program_year"), F.asc("name"), F.asc("state"), F.asc("country")]).select("company_id", *(F.col(c).alias(f"last_{c}") for c in ("name", "state", "country")))
    total = year.groupBy("company_id").agg(*(F.sum(c).alias(c) for c in sums), F.min("program_year").alias("first_year"), F.max("program_year").alias("last_year"))
    ids = profile.select("company_id").unionByName(year.select("company_id")).distinct()
    company = ids.join(of, "company_id", "left").join(last, "company_id", "left").join(total, "company_id", "left")
    company = company.select(
        "company_id", F.coalesce("name", "last_name", "company_id").alias("name"), F.nullif(F.concat_ws(" | ", *alternate), F.lit("")).alias("other_names"), F.coalesce("state", "last_state").alias("state"), F.coalesce("country", "last_country").alias("country"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in sums), "first_year", "last_year",
    )
    names = company.select("company_id", F.explode(F.concat(F.array("name"), F.coalesce(F.split("other_names", r" \| "), F.array().cast("array<string>")))).alias("n"))
    key = names.select("company_id", text.name_key(F.col("n")).alias("name_key")).filter("name_key is not null").distinct()
    return {"op_company": company, "op_company_year": year, "op_company_key": key}


def payments_research(raw: Tables) -> Tables:
    """Research payments by product, and each product's largest studies."""
    r = raw["main"]
    slots = [{"name": "product" if n == 1 else f"product{n}"} for n in range(1, 6)]
    rows = reshape.unpivot_slots(r, ["company_id", "amount", "study", "nct_id"], slots, need="name").withColumn("slug", text.slug(F.col("name"))).filter("slug <> ''")
    study = F.coalesce("nct_id", _first(200, F.col("study")))
    by = rows.filter("study is not null or nct_id is not null").groupBy("slug", study.alias("study_key")).agg(*_max("study", "nct_id", "company_id"), _money("amount").alias("amount"), F.count("*").alias("records"))
    return {
        "op_product_research": rows.groupBy("slug").agg(_money("amount").alias("amount"), F.count("*").alias("records"), F.count_distinct(study).alias("studies")),
        "op_product_study": ranking.top_n(by, ["slug"], [F.desc("amount"), F.asc("study_key")], STUDIES, "study_rank").drop("study_key"),
    }


# --- the catalog ------------------------------------------------------------------------------------------------------
# The headers of the published files.

_PLACE = ("City/Town | city", "State | state", "ZIP Code | zip", "Telephone Number | phone")
_OWNERS = spec(
    "ENROLLMENT ID | enrollment_id", "ASSOCIATE ID | facility_associate_id", "ORGANIZATION NAME | facility_name", "ASSOCIATE ID - OWNER | owner_id", "TYPE - OWNER | owner_type", "ROLE CODE - OWNER | role_code", "ROLE TEXT - OWNER | role_text",
    "ASSOCIATION DATE - OWNER | association_date | date", "FIRST NAME - OWNER | first_name", "MIDDLE NAME - OWNER | middle_name", "LAST NAME - OWNER | last_name", "TITLE - OWNER | title", "ORGANIZATION NAME - OWNER | org_name",
    "DOING BUSINESS AS NAME - OWNER | dba_name", "CITY - OWNER | city", "STATE - OWNER | state", f"PERCENTAGE OWNERSHIP | percentage | {ON}", *(f"{header} | is_{kind} | yes_no?" for header, kind in OWNER_KINDS.items()),
)
_DEFICIENCIES = spec(
    "CMS Certification Number (CCN) | ccn", "Survey Date | survey_date | date", "Deficiency Prefix | prefix", "Deficiency Category | category", "Deficiency Tag Number | tag", "Deficiency Description | description", "Scope Severity Code | scope_severity",
    "Deficiency Corrected | corrected", "Correction Date | correction_date | date", f"Inspection Cycle | cycle | {OW}", "Complaint Deficiency | complaint | yes_no", "Infection Control Inspection Deficiency | infection_control | yes_no?",
)
_MEASURE_DATES = ("Start Date | start_date | date", "End Date | end_date | date")

DATASETS: dict[str, Dataset] = {
    "oig_leie": Dataset({"main": spec(
        "LASTNAME | last_name", "FIRSTNAME | first_name", "MIDNAME | middle_name", "BUSNAME | business_name", "GENERAL | general_category", "SPECIALTY | specialty", "NPI | npi | npi", "ADDRESS | address", "CITY | city", "STATE | state", "ZIP | zip",
        "EXCLTYPE | exclusion_type", "EXCLDATE | exclusion_date | date_ymd", "REINDATE | reinstatement_date | date_ymd", "WAIVERDATE | waiver_date | date_ymd", "WVRSTATE | waiver_state")}, only("oig_exclusion")),
    "cms_opt_out": Dataset({"main": spec("npi | npi | npi", "Specialty | specialty", "Optout Effective Date | effective_date | date_mdy", "Optout End Date | end_date | date_mdy", "Eligible to Order and Refer | can_order_refer | yes_no", "Last updated | last_updated | date_mdy")}, only("medicare_opt_out")),
    "cms_order_referring": Dataset({"main": spec("NPI | npi | npi", "PARTB | part_b | yes_no", "DME | dme | yes_no", "HHA | hha | yes_no", "PMD | pmd | yes_no", "HOSPICE | hospice | yes_no")}, only("medicare_order_referring")),
    "cc_clinicians": Dataset({"main": spec(
        "NPI | npi | npi", "Ind_PAC_ID | ind_pac_id", "Med_sch | medical_school", f"Grd_yr | graduation_year | {OW}", "pri_spec | primary_specialty", "sec_spec_all | secondary_specialties", "Telehlth | telehealth", "Facility Name | group_name", "org_pac_id | org_pac_id",
        f"num_org_mem | group_members | {OW}", "City/Town | city", "State | state", "ind_assgn | ind_assignment", "grp_assgn | grp_assignment", "adr_ln_1 | address1", "ZIP Code | zip")}, clinicians),
    "cc_facility_affiliations": Dataset({"main": spec("NPI | npi | npi", "facility_type | facility_type", "Facility Affiliations Certification Number | ccn", "Facility Type Certification Number | parent_ccn")}, only("cc_facility_affiliation")),
    "cc_hospitals": Dataset({"main": spec(
        "Facility ID | ccn", "Facility Name | name", "Address | address", *_PLACE, "Hospital Type | hospital_type", "Hospital Ownership | ownership", "Emergency Services | emergency_services | yes_no", f"Hospital overall rating | overall_rating | {OW}",
        f"Count of Facility MORT Measures | mort_measures | {OW}", f"Count of MORT Measures Better | mort_better | {OW}", f"Count of MORT Measures Worse | mort_worse | {OW}", f"Count of Facility Safety Measures | safety_measures | {OW}",
        f"Count of Safety Measures Better | safety_better | {OW}", f"Count of Safety Measures Worse | safety_worse | {OW}", f"Count of Facility READM Measures | readm_measures | {OW}", f"Count of READM Measures Better | readm_better | {OW}", f"Count of READM Measures Worse | readm_worse | {OW}")}, only("cms_hospital")),
    "cc_nursing_homes": Dataset({"main": spec(
        "CMS Certification Number (CCN) | ccn", "Provider Name | name", "Provider Address | address", *_PLACE, "Provider Type | provider_type", "Ownership Type | ownership", f"Number of Certified Beds | certified_beds | {OW}",
        f"Overall Rating | overall_rating | {OW}", f"Health Inspection Rating | inspection_rating | {OW}", f"Staffing Rating | staffing_rating | {OW}", f"QM Rating | quality_rating | {OW}")}, only("cms_nursing_home")),
    "cms_facility_enrollments": Dataset({kind: spec("NPI | npi | npi", "CCN | ccn", "ENROLLMENT ID | enrollment_id", "ASSOCIATE ID | associate_id", "ORGANIZATION NAME | org_name", "ENROLLMENT STATE | state", encoding="ISO-8859-1") for kind in ("Hospital", "Skilled nursing", "Home health", "Hospice", "Rural health clinic", "Health center")}, facility_enrollments, "kind"),
    "cms_facility_owners": Dataset({kind: _OWNERS for kind in ("Hospital", "Skilled nursing", "Home health", "Hospice", "Rural health clinic", "Health center")}, facility_owners, "kind"),
    "cms_ownership_changes": Dataset({"changes": spec(
        "ENROLLMENT ID - BUYER | buyer_enrollment_id", "CCN - BUYER | buyer_ccn", "NPI - BUYER | buyer_npi | npi", "ASSOCIATE ID - BUYER | buyer_associate_id", "ORGANIZATION NAME - BUYER | buyer_name", "DOING BUSINESS AS NAME - BUYER | buyer_dba_name", "CHOW TYPE CODE | chow_type_code",
        "CHOW TYPE TEXT | chow_type", "EFFECTIVE DATE | effective_date | date", "ENROLLMENT ID - SELLER | seller_enrollment_id", "CCN - SELLER | seller_ccn", "NPI - SELLER | seller_npi | npi", "ASSOCIATE ID - SELLER | seller_associate_id", "ORGANIZATION NAME - SELLER | seller_name", "DOING BUSINESS AS NAME - SELLER | seller_dba_name"),
        "owners": FileSpec(_OWNERS.fields, constants={"kind": "Seller"})}, ownership_changes),
    "cc_nursing_home_inspections": Dataset({"health": _DEFICIENCIES, "fire": _DEFICIENCIES, "penalties": spec("CMS Certification Number (CCN) | ccn", "Penalty Date | penalty_date | date", "Penalty Type | penalty_type", f"Fine Amount | fine_amount | {ON}", "Payment Denial Start Date | denial_start | date", f"Payment Denial Length in Days | denial_days | {OW}")},
        lambda raw: inspections({"deficiencies": raw["health"].withColumn("kind", F.lit("health")).unionByName(raw["fire"].withColumn("kind", F.lit("fire"))), "penalties": raw["penalties"]})),
    "cms_otp_providers": Dataset({"main": spec("NPI | npi | npi", "PROVIDER NAME | name", "MEDICARE ID EFFECTIVE DATE | effective_date | date_mdy")}, otp_providers),
    "cms_revalidation": Dataset({"main": spec("National Provider Identifier | npi | npi", "Revalidation Due Date | due_date | date_mdy", "Adjusted Due Date | adjusted_due_date | date_mdy")}, revalidation),
    "cms_dme_suppliers": Dataset({"main": spec("Suplr_NPI | npi | npi", f"Tot_Suplr_Benes | beneficiaries | {OW}", f"Tot_Suplr_Clms | claims | {OW}")}, dme_suppliers),
    "cms_provider_of_services": Dataset({
        "1": spec("PRVDR_NUM | ccn", "FAC_NAME | name", "PRVDR_CTGRY_CD | category", "ST_ADR | address", "CITY_NAME | city", "STATE_CD | state", "ZIP_CD | zip", "PGM_TRMNTN_CD | termination_code", "TRMNTN_EXPRTN_DT | termination_date | date_ymd", "fed_crtfctn_stus_name | status | text?"),
        "2": spec("prvdr_num | ccn", "fac_name | name", "prvdr_type_id | category", "st_adr | address", "city_name | city", "state_cd | state", "zip_cd | zip", "pgm_trmntn_cd | termination_code", "trmntn_exprtn_dt | termination_date | date", "fed_crtfctn_stus_name | status")}, provider_of_services, "part"),
    "medicare_enrollment": Dataset({
        "enrollments": spec("NPI | npi | npi", "ENRLMT_ID | enrollment_id", "PECOS_ASCT_CNTL_ID | pac_id", "PROVIDER_TYPE_DESC | provider_type", "STATE_CD | state", "ORG_NAME | org_name"),
        "reassignments": spec("Group PAC ID | group_pac_id", "Group Enrollment ID | group_enrollment_id", "Group Legal Business Name | group_name", "Group State Code | group_state", "Record Type | record_type", "Individual NPI | npi | npi", "Individual Specialty Description | specialty")}, medicare_enrollment),
    "cc_hcahps": Dataset({"main": spec("Facility ID | ccn", "HCAHPS Measure ID | measure_id", f"Patient Survey Star Rating | star_rating | {OW}", f"Number of Completed Surveys | surveys | {OW}", f"Survey Response Rate Percent | response_rate | {ON}")}, hospital_survey),
    "cc_home_health": Dataset({"main": spec("CMS Certification Number (CCN) | ccn", "Provider Name | name", "Address | address", *_PLACE, "Type of Ownership | ownership", f"Quality of patient care star rating | quality_rating | {ON}")}, only("cms_home_health")),
    "cc_hospices": Dataset({"listing": spec("CMS Certification Number (CCN) | ccn", "Facility Name | name", "Address Line 1 | address", *_PLACE, "Ownership Type | ownership"), "survey": spec("CMS Certification Number (CCN) | ccn", "Measure Code | measure_code", f"Star Rating | star_rating | {OW}")}, hospices),
    "cc_dialysis": Dataset({"listing": spec(
        "CMS Certification Number (CCN) | ccn", "Facility Name | name", "Address Line 1 | address", *_PLACE, "Profit or Non-Profit | ownership", "Chain Organization | chain", f"# of Dialysis Stations | stations | {OW}", "Offers in-center hemodialysis | in_center | yes_no", "Offers peritoneal dialysis | peritoneal | yes_no",
        "Offers home hemodialysis training | home_hemodialysis | yes_no", f"Five Star | five_star | {ON}", "Five Star Date | five_star_period", "Patient Survival Category Text | survival", "SMR Date | survival_period", "Patient hospitalization category text | hospitalization", "SHR Date | hospitalization_period",
        "Patient Hospital Readmission Category | readmission", "SRR Date | readmission_period", "SEDR category text | ed_visits", "SEDR Date | ed_visits_period", "Patient Infection category text | infection", "SIR Date | infection_period", "Patient Transfusion category text | transfusion", "STrR Date | transfusion_period",
        "FYSWR category text | waitlist", "FYSWR Date | waitlist_period"), "survey": spec("CMS Certification Number (CCN) | ccn", f"ICH CAHPS Survey of patients' experiences star rating | star_rating | {ON}")}, dialysis),
    "cc_surgery_centers": Dataset({"main": spec("Facility ID | ccn", "NPI | npi | npi", "Facility Name | name", "City/Town | city", "State | state", "ZIP Code | zip", f"Year | data_year | {OW}", f"ASC-9 Rate* | asc9_rate | {ON}", f"ASC-13 Rate* | asc13_rate | {ON}",
        *(c for n in (12, 17, 18, 19) for c in (f"ASC-{n} Total Cases | asc{n}_cases | {OW}", f"ASC-{n} Performance Category | asc{n}_category", f"ASC-{n} RSHV Rate | asc{n}_rate | {ON}")))}, surgery_centers),
    "cc_esrd_qip": Dataset({"main": spec("CMS Certification Number (CCN) | ccn", "Total Performance Score | total_score", "State Average Total Performance Score | state_average", "National Average Total Performance Score | national_average", "Payment Reduction Percentage | payment_reduction")}, dialysis_qip),
    "cc_post_acute": Dataset({"listing": spec("CMS Certification Number (CCN) | ccn", "Provider Name | name", "Address Line 1 | address", *_PLACE, "Ownership Type | ownership", "Certification Date | certified_since | date"), "measures": spec("CMS Certification Number (CCN) | ccn", "Measure Code | code", "Score | score", *_MEASURE_DATES)}, post_acute),
    "cc_hospital_measures": Dataset({
        "hospitals": spec("Facility ID | ccn", "Measure ID | code", "Score | score", "Compared to National | compared | text?", "Denominator | cases | text?", *_MEASURE_DATES),
        "nation": spec("Facility ID | ccn | text?", "Measure ID | code", "National Rate | score", "Compared to National | compared | text?", "Denominator | cases | text?", *_MEASURE_DATES)}, hospital_measures, "part"),
    "cms_hospital_volume": Dataset({
        "totals": spec("Rndrng_Prvdr_CCN | ccn", f"Tot_Benes | beneficiaries | {OW}", f"Tot_Dschrgs | discharges | {OW}", f"Tot_Cvrd_Days | covered_days | {OW}", f"Tot_Pymt_Amt | total_payments | {ON}", f"Tot_Mdcr_Pymt_Amt | medicare_payments | {ON}"),
        "inpatient": spec("Rndrng_Prvdr_CCN | ccn", "DRG_Cd | code", "DRG_Desc | description", f"Bene_Cnt | beneficiaries | {OW}?", f"Tot_Dschrgs | cases | {OW}", f"Avg_Mdcr_Pymt_Amt | avg_medicare_payment | {ON}"),
        "outpatient": spec("Rndrng_Prvdr_CCN | ccn", "APC_Cd | code", "APC_Desc | description", f"Bene_Cnt | beneficiaries | {OW}", f"CAPC_Srvcs | cases | {OW}", f"Avg_Mdcr_Pymt_Amt | avg_medicare_payment | {ON}")},
        lambda raw: hospital_volume({"totals": raw["totals"], "services": raw["inpatient"].withColumn("setting", F.lit("I")).unionByName(raw["outpatient"].withColumn("setting", F.lit("O")))})),
    "cc_mips": Dataset({"main": spec("NPI | npi | npi", "Org_PAC_ID | org_pac_id", "source | source", "Facility Name | facility_name", "Quality_category_score | quality_score | number", "PI_category_score | pi_score | number", "IA_category_score | ia_score | number", "Cost_category_score | cost_score | number", "final_MIPS_score | final_score | number")}, only("cc_mips")),
    "cms_physician_by_provider": Dataset({"main": spec(
        "Rndrng_NPI | npi | npi", "Rndrng_Prvdr_Type | provider_type", "Rndrng_Prvdr_Mdcr_Prtcptg_Ind | participating | yes_no", "Tot_HCPCS_Cds | distinct_services | number", "Tot_Benes | beneficiaries | number", "Tot_Srvcs | services | number", "Tot_Sbmtd_Chrg | submitted_charges | number",
        "Tot_Mdcr_Alowd_Amt | allowed_amount | number", "Tot_Mdcr_Pymt_Amt | payment_amount | number", "Bene_Avg_Age | avg_beneficiary_age | number", "Bene_Avg_Risk_Scre | avg_risk_score | number")}, only("medicare_utilization")),
    "cms_physician_by_service": Dataset({"main": spec("Rndrng_NPI | npi | npi", "HCPCS_Cd | hcpcs", "HCPCS_Desc | description", "HCPCS_Drug_Ind | is_drug | yes_no", "Place_Of_Srvc | place_of_service", "Tot_Benes | beneficiaries | number", "Tot_Srvcs | services | number", "Avg_Mdcr_Pymt_Amt | avg_payment | number")}, top_services),
    "cms_part_d_by_provider": Dataset({"main": spec(
        "Prscrbr_NPI | npi | npi", "Prscrbr_Type | prescriber_type", "Tot_Clms | claims | number", "Tot_30day_Fills | fills_30day | number", "Tot_Drug_Cst | drug_cost | number", "Tot_Day_Suply | day_supply | number", "Tot_Benes | beneficiaries | number", "Brnd_Tot_Clms | brand_claims | number",
        "Gnrc_Tot_Clms | generic_claims | number", "Opioid_Tot_Clms | opioid_claims | number", "Opioid_Prscrbr_Rate | opioid_rate | number", "Antbtc_Tot_Clms | antibiotic_claims | number", "Bene_Avg_Age | avg_beneficiary_age | number")}, only("medicare_part_d")),
    "medicaid_enrollment_segments": Dataset({"main": spec("NPI | npi | npi", "STATE_CD | state", "ENRL_START_DT | start | date", "ENRL_END_DT | end | date", "ENRL_STATUS_CD | status", "ENRL_STATUS_DESC | status_text | text?")}, only("medicaid_enrollment_segment")),
    "medicaid_spending": Dataset({"main": spec("BILLING_PROVIDER_NPI_NUM | billing | npi", "SERVICING_PROVIDER_NPI_NUM | servicing | npi", "HCPCS_CODE | hcpcs", "CLAIM_FROM_MONTH | month", f"TOTAL_CLAIM_LINES | lines | {OW}", f"TOTAL_PAID | paid | {ON}")}, only("medicaid_spending_cell")),
    "hrsa_hpsa": Dataset({d: spec("HPSA ID | hpsa_id", "Designation Type | designation_type", "HPSA Status | status", f"HPSA Score | score | {OW}", "HPSA Component Type Description | component_type", "Common State County FIPS Code | county_fips") for d in ("Primary Care", "Mental Health", "Dental Health")}, shortage_areas, "discipline"),
    "open_payments": Dataset({"main": spec(
        "Covered_Recipient_NPI | npi | npi", "Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Name | payer", "Total_Amount_of_Payment_USDollars | amount | number", f"Number_of_Payments_Included_in_Total_Amount | payments | {OW}", "Nature_of_Payment_or_Transfer_of_Value | nature", "Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_ID | company_id",
        *(f"{header}_{n} | {name}{'' if n == 1 else n}" for n in range(1, 6) for header, name in (("Name_of_Drug_or_Biological_or_Device_or_Medical_Supply", "product"), ("Indicate_Drug_or_Biological_or_Device_or_Medical_Supply", "product_kind"), ("Product_Category_or_Therapeutic_Area", "product_category"), ("Associated_Drug_or_Biological_NDC", "ndc"), ("Associated_Device_or_Medical_Supply_PDI", "device_id"))))}, open_payments),
    "open_payments_years": Dataset({"main": spec(
        "Covered_Recipient_NPI | npi | npi", "Program_Year | program_year", "General_Total_Payment | general_amount | number", f"General_Total_Transactions | general_records | {OW}", "Research_Total_Payment | research_amount | number", f"Research_Total_Transactions | research_records | {OW}",
        "Total_Associated_Research_Payments | associated_research_amount | number", f"Total_Associated_Research_Transactions | associated_research_records | {OW}", "Invested_Total_Amount | invested_amount | number", "Interest_Total_Amount | interest_value | number", f"Invested_Total_Transactions | ownership_records | {OW}")}, payments_years),
    "open_payments_companies": Dataset({"main": spec("Covered_Recipient_NPI | npi | npi", "Payment_Type | payment_type", "AMGPO_Name | company", "AMGPO_ID | company_id", f"Number_of_Transaction | records | {OW}", "Total_Amount | amount | number")}, payments_companies),
    "open_payments_entities": Dataset({
        "profiles": spec("AMGPO_Making_Payment_ID | company_id", "AMGPO_Making_Payment_Name | name", "AMGPO_Making_Payment_State | state", "AMGPO_Making_Payment_Country | country", *(f"AMGPO_Making_Payment_Alternate_Name{n} | alt_name{n}" for n in range(1, 6))),
        "years": spec("AMGPO_Making_Payment_ID | company_id", "AMGPO_Making_Payment_Name | name", "AMGPO_Making_Payment_State | state", "AMGPO_Making_Payment_Country | country", "Total_Amount_General | general_amount | number", "Total_Amount_Research | research_amount | number", "Total_Amount_Investment | invested_amount | number",
            "Total_Amount_Interest | interest_value | number", f"Trans_General | general_records | {OW}", f"Trans_Research | research_records | {OW}", f"Trans_Invested | ownership_records | {OW}", "Program_Year | program_year")}, payments_entities),
    "open_payments_research": Dataset({"main": spec("Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_ID | company_id", "Total_Amount_of_Payment_USDollars | amount | number", "Name_of_Study | study", "ClinicalTrials_Gov_Identifier | nct_id",
        *(f"Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_{n} | product{'' if n == 1 else n}" for n in range(1, 6)))}, payments_research),
    "nadac": Dataset({"main": spec("NDC Description | description", "NDC | ndc", f"NADAC Per Unit | per_unit | {ON}", "Effective Date | effective_date | date_mdy", "Pricing Unit | pricing_unit", "OTC | otc", "Classification for Rate Setting | classification", "As of Date | as_of | date_mdy")}, drug_prices),
    "part_d_prescribers": Dataset({"main": spec("Prscrbr_NPI | npi | npi", "Brnd_Name | brand", "Gnrc_Name | generic", f"Tot_Clms | claims | {OW}", f"Tot_30day_Fills | fills | {ON}", f"Tot_Drug_Cst | drug_cost | {ON}", f"Tot_Benes | beneficiaries | {OW}")}, part_d_brands),
}


def population_file(year: int) -> Dataset:
    """County populations; the estimate's column has its year."""
    return Dataset({"main": spec("SUMLEV | sumlev", "STATE | state_fips", "COUNTY | county_code", f"POPESTIMATE{year} | population | {OW}", encoding="latin1")}, county_population)


def load(spark: SparkSession, dataset: Dataset, paths: dict[str, str], more: Tables | None = None) -> Tables:
    """The target tables of a dataset from its files; ``more``: tables that its build joins."""
    parts = {part: read(spark, paths[part], s) for part, s in dataset.files.items() if part in paths}
    if dataset.constant:
        tables = [df.withColumn(dataset.constant, F.lit(part)) for part, df in parts.items()]
        first, *rest = tables
        for df in rest:
            first = first.unionByName(df, allowMissingColumns=True)
        parts = {"main": first}
    return dataset.build({**parts, **(more or {})})
