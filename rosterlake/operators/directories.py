"""Directories of facilities and groups, similar companies, and who is paid for the products that they prescribe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators import linkage, ranking

# --- facilities and groups --------------------------------------------------------------------------------------------


def facility_directory(registered: DataFrame, listed: DataFrame, billing: DataFrame, providers: DataFrame, centroids: DataFrame, changes: DataFrame, penalties: DataFrame, kinds: list[str], by_number: Column) -> DataFrame:
    """One row per facility (ccn), merged from what each source knows.

    ``listed`` (type, ccn, name, address, city, state, zip5, phone, kind,
    ownership, beds, rating): certified now; its values win, of several listings
    those of the first type in ``kinds``.  ``registered`` (ccn, name, address,
    city, state, zip5, active, termination_code, termination_date): the rest, and
    whether an unlisted facility still is certified; a listed one has no
    termination.  ``billing`` (ccn, npi, kind): its active numbers (in
    ``providers``), and the type of an unlisted facility: the kind of most
    numbers, then the least; else ``by_number``, an expression of the column ccn.
    ``changes`` (buyer_ccn, seller_ccn, effective_date): the newest of either
    side; ``penalties`` (ccn, fine_amount, penalty_date): number, sum, newest.
    Numbers are compared trimmed, in upper case; facilities without a name go.
    """
    key = lambda df, c="ccn": df.withColumn("ccn", F.upper(F.trim(c))).filter("ccn <> ''")
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("type"))
    fields = ["name", "address", "city", "state", "zip5"]
    more = ["type", "phone", "kind", "ownership", "beds", "rating"]
    now = ranking.latest(key(listed).withColumn("_p", F.when(place == 0, len(kinds) + 1).otherwise(place)), ["ccn"], [F.asc("_p"), F.asc("name")]).select("ccn", *(F.col(c).alias(f"_l_{c}") for c in fields), *more)
    before = ranking.latest(key(registered), ["ccn"], [F.desc("active"), F.asc("name")]).select("ccn", *(F.col(c).alias(f"_r_{c}") for c in fields), F.col("active").alias("_active"), "termination_code", "termination_date")
    known = key(billing).join(providers.select("npi").distinct(), "npi", "left_semi").select("ccn", "npi", F.col("kind").alias("_kind")).distinct()
    numbers = known.groupBy("ccn").agg(F.count_distinct("npi").alias("billing_npis"))
    linked = known.groupBy("ccn", "_kind").agg(F.count("*").alias("n")).groupBy("ccn").agg(F.min(F.struct((-F.col("n")).alias("n"), "_kind")).alias("k")).select("ccn", F.col("k._kind").alias("_linked"))
    sides = changes.select(F.explode(F.array("buyer_ccn", "seller_ccn")).alias("ccn"), "effective_date")
    changed = key(sides).groupBy("ccn").agg(F.max("effective_date").alias("ownership_changed"))
    fined = key(penalties).groupBy("ccn").agg(F.count("*").alias("penalties"), F.round(F.sum("fine_amount"), 2).alias("fines"), F.max("penalty_date").alias("last_penalty"))
    out = before.join(now, "ccn", "full_outer")
    for df in (numbers, linked, changed, fined):
        out = out.join(df, "ccn", "left")
    is_listed = F.col("type").isNotNull()
    value = {c: F.coalesce(F.col(f"_l_{c}"), F.col(f"_r_{c}")) for c in fields}
    out = out.filter(F.coalesce(F.trim(value["name"]), F.lit("")) != "").join(centroids.select(F.col("zip5").alias("_z"), "lat", "lon"), value["zip5"] == F.col("_z"), "left")
    ended = lambda c: F.when(~is_listed, F.col(c)).alias(c)
    return out.select(
        "ccn", F.coalesce("type", "_linked", by_number).alias("type"), *(v.alias(c) for c, v in value.items()), "phone", "kind", "ownership", "beds", "rating", (is_listed | F.coalesce("_active", F.lit(False))).alias("active"),
        ended("termination_code"), ended("termination_date"), F.coalesce("billing_npis", F.lit(0)).alias("billing_npis"), "lat", "lon", "ownership_changed", F.coalesce("penalties", F.lit(0)).alias("penalties"), "fines", "last_penalty",
    )


def group_directory(reassignments: DataFrame, members: DataFrame, enrollments: DataFrame, scores: DataFrame, providers: DataFrame) -> DataFrame:
    """(pac_id, name, state, clinicians, organization_npis, accepts_assignment, mips_score, mips_year) of groups with an active clinician.

    A clinician is a member by ``reassignments`` (group_pac_id, npi, group_name,
    group_state) or ``members`` (org_pac_id, npi, group_name, state,
    accepts_assignment), once; the second's name and the first's state win; a
    group without a name is called by its number.  ``enrollments`` (pac_id, npi,
    org_name): its organisations; ``scores`` (org_pac_id, source, program_year,
    final_score).  Only numbers in ``providers`` count.
    """
    active = providers.select("npi").distinct()
    one = reassignments.select(F.col("group_pac_id").alias("pac_id"), "npi").unionByName(members.select(F.col("org_pac_id").alias("pac_id"), "npi"))
    count = one.filter("npi is not null and pac_id is not null").distinct().join(active, "npi", "left_semi").groupBy("pac_id").agg(F.count("*").alias("clinicians"))
    cc = members.groupBy(F.col("org_pac_id").alias("pac_id")).agg(F.max("group_name").alias("_n"), F.max("state").alias("_s"), F.max("accepts_assignment").alias("accepts_assignment"))
    re = reassignments.groupBy(F.col("group_pac_id").alias("pac_id")).agg(F.max("group_name").alias("_rn"), F.max("group_state").alias("_rs"))
    orgs = enrollments.filter("pac_id is not null and org_name is not null").join(active, "npi", "left_semi").groupBy("pac_id").agg(F.count_distinct("npi").alias("organization_npis"))
    scored = scores.filter("source = 'group' and org_pac_id is not null").groupBy(F.col("org_pac_id").alias("pac_id")).agg(F.max("program_year").alias("_y"), F.max("final_score").alias("_m"))
    out = count
    for df in (cc, re, orgs, scored):
        out = out.join(df, "pac_id", "left")
    name = F.coalesce("_n", "_rn", F.concat(F.lit("Group "), "pac_id"))
    return out.select("pac_id", name.alias("name"), F.coalesce("_rs", "_s").alias("state"), "clinicians", F.coalesce("organization_npis", F.lit(0)).alias("organization_npis"), "accepts_assignment", F.round("_m", 2).alias("mips_score"), F.when(F.col("_m").isNotNull(), F.col("_y")).alias("mips_year"))


def organisation_counts(providers: DataFrame, locations: DataFrame, labels: DataFrame) -> DataFrame:
    """(taxonomy_code, state, label, organizations): organisations by primary specialty, state of the primary place and label ('' and 0 for none)."""
    first = locations.filter("is_primary").select("npi", "state")
    out = providers.filter("entity_type = 2").join(first, "npi", "left").join(labels.select("npi", "label"), "npi", "left")
    state = F.when(F.length("state") == 2, F.upper("state")).otherwise("")
    return out.groupBy(F.coalesce("primary_taxonomy_code", F.lit("")).alias("taxonomy_code"), state.alias("state"), F.coalesce("label", F.lit(0)).alias("label")).agg(F.count("*").alias("organizations"))


# --- companies --------------------------------------------------------------------------------------------------------

# Words that many companies' names have.
COMPANY_WORDS = (
    "THE", "AND", "COMPANY", "CORPORATION", "CORP", "INC", "LLC", "LTD", "LIMITED", "GROUP", "HOLDINGS", "INTERNATIONAL", "GLOBAL", "AMERICA", "AMERICAN", "AMERICAS", "NATIONAL", "UNITED", "MEDICAL", "HEALTH", "HEALTHCARE",
    "PHARMA", "PHARMACEUTICAL", "PHARMACEUTICALS", "LABORATORIES", "LABS", "SCIENCES", "SCIENTIFIC", "TECHNOLOGIES", "TECHNOLOGY", "SYSTEMS", "SOLUTIONS", "PRODUCTS", "SERVICES", "DEVICES", "SURGICAL", "THERAPEUTICS",
    "BIOSCIENCES", "BIOLOGICS", "NORTH", "SOUTH", "EAST", "WEST", "NEW", "FIRST",
)


def distinctive_word(name: Column) -> Column:
    """The first word of four ASCII letters or more that isn't common, in upper case; null without one."""
    words = F.transform(F.regexp_extract_all(name, F.lit("[A-Za-z]+"), F.lit(0)), F.upper)
    return F.get(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*COMPANY_WORDS)), F.lit(0))


def similar_companies(companies: DataFrame, most: int) -> DataFrame:
    """(company_id, similar_id, similar_name, rank): other companies (company_id, name, amount) whose name has the company's distinctive word as a whole word.

    Most money first, then the name, then the id; ``most`` of each.  Companies that
    share their word with all others take the same best ones, so a word's list is
    cut to ``most`` + 1 and is one row before the join: no pairs of a common word
    are made, a company meets one row and is told apart from the list within it.
    """
    asked = companies.select("company_id", distinctive_word(F.col("name")).alias("word")).filter("word is not null")
    # A whole word begins and ends where letters, digits or underscores do.
    parts = F.array_distinct(F.transform(F.regexp_extract_all("name", F.lit(r"\w+"), F.lit(0)), F.upper))
    listed = companies.withColumn("word", F.explode(parts)).join(asked.select("word").distinct(), "word", "left_semi")
    order = [F.desc_nulls_last("amount"), F.asc("name"), F.asc("company_id")]
    first = ranking.top_n(listed, ["word"], order, most + 1, "_rank").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("_rank", "company_id", "name"))).alias("_best"))
    # A left join, as only the lists may be broadcast; every asked word has one.
    met = asked.join(first, "word", "left")
    others = F.slice(F.filter("_best", lambda b: b["company_id"] != F.col("company_id")), 1, most)
    return met.select("company_id", F.posexplode(others).alias("_at", "_b")).select("company_id", F.col("_b.company_id").alias("similar_id"), F.col("_b.name").alias("similar_name"), (F.col("_at") + 1).alias("rank"))


# --- prescribing ------------------------------------------------------------------------------------------------------


def product_brands(products: DataFrame, ndc: DataFrame, brands: DataFrame) -> DataFrame:
    """(slug, brand): the prescribed brands of each drug (slug, name, kind, ndc_key): its name or that of its NDC (ndc_key, brand_name), or one of them and more words."""
    drugs = products.filter(F.col("kind").isin("Drug", "Biological"))
    names = drugs.select("slug", F.col("name").alias("candidate")).unionByName(drugs.join(ndc.filter("brand_name is not null"), "ndc_key").select("slug", F.col("brand_name").alias("candidate"))).filter("candidate is not null").distinct()
    return linkage.prefix_join(names, brands.select("brand").distinct(), "candidate", "brand").select("slug", "brand").distinct()


def paid_prescribers(paid: DataFrame, matched: DataFrame, prescribed: DataFrame, providers: DataFrame) -> DataFrame:
    """(slug, npi, amount, records, claims, drug_cost, beneficiaries): who is paid for a product (slug, npi, amount, records) and prescribes its brands (brand, npi, claims, drug_cost, beneficiaries)."""
    own = prescribed.join(matched, "brand").groupBy("slug", "npi").agg(F.sum("claims").alias("claims"), F.round(F.sum("drug_cost"), 2).alias("drug_cost"), F.sum("beneficiaries").alias("beneficiaries"))
    return paid.join(providers.select("npi").distinct(), "npi", "left_semi").join(own, ["slug", "npi"]).select("slug", "npi", "amount", "records", "claims", "drug_cost", "beneficiaries")


def prescribing_overlap(paid: DataFrame, matched: DataFrame, prescribed: DataFrame, brands: DataFrame, providers: DataFrame, most: int = 2000) -> DataFrame:
    """One row per product with prescribed brands: all prescribers and claims, and how many of them are paid.

    (slug, brands, prescribers, claims, drug_cost, paid_providers,
    paid_prescribers, paid_claims, paid_drug_cost); ``brands`` (brand, claims,
    drug_cost): the brands' totals, listed by claims, then name, and cut to
    ``most`` characters.
    """
    listed = matched.join(brands, "brand").groupBy("slug").agg(
        F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("claims")).alias("less"), "brand"))), lambda b: b["brand"]), " | "), F.lit(most)).alias("brands"), F.sum("claims").alias("claims"), F.round(F.sum("drug_cost"), 2).alias("drug_cost")
    )
    everyone = prescribed.select("brand", "npi").join(matched, "brand").groupBy("slug").agg(F.count_distinct("npi").alias("prescribers"))
    active = paid.join(providers.select("npi").distinct(), "npi", "left_semi").groupBy("slug").agg(F.count("*").alias("paid_providers"))
    both = paid_prescribers(paid, matched, prescribed, providers).groupBy("slug").agg(F.count("*").alias("paid_prescribers"), F.sum("claims").alias("paid_claims"), F.round(F.sum("drug_cost"), 2).alias("paid_drug_cost"))
    out = listed
    for df in (everyone, active, both):
        out = out.join(df, "slug", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("slug", "brands", none("prescribers"), "claims", "drug_cost", none("paid_providers"), none("paid_prescribers"), none("paid_claims"), "paid_drug_cost")
