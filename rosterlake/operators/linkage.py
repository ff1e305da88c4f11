"""Record linkage: keys, fallbacks, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import address, text
from rosterlake.operators.ranking import latest


def first_match(left: DataFrame, lookups: list[tuple[DataFrame, dict[str, str]]], value: str, source: str = "matched_by") -> DataFrame:
    """``value`` from the first lookup that has the row's key; ``matched_by`` is its place from 1, null if none has.

    Each lookup must have one row per key.
    """
    out = left
    for i, (table, on) in enumerate(lookups):
        right = table.select(*(F.col(c).alias(f"_k{i}_{n}") for n, c in enumerate(on.values())), F.col(value).alias(f"_v{i}"), F.lit(i + 1).alias(f"_s{i}"))
        out = out.join(right, [F.col(c) == F.col(f"_k{i}_{n}") for n, c in enumerate(on)], "left").drop(*(f"_k{i}_{n}" for n in range(len(on))))
    n = range(len(lookups))
    found = F.coalesce(*(F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.col(f"_v{i}").alias("v"), F.col(f"_s{i}").alias("s"))) for i in n))
    return out.withColumn(value, found["v"]).withColumn(source, found["s"]).drop(*(f"_{c}{i}" for i in n for c in "vs"))


def prefix_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where b equals a or starts with a and a space: an equi join on the first word, then the exact test."""
    x = left.withColumn("_w", F.split(a, " ")[0])
    y = right.withColumn("_w2", F.split(b, " ")[0])
    test = (F.col(b) == F.col(a)) | F.startswith(F.col(b), F.concat(F.col(a), F.lit(" ")))
    return x.join(y, (F.col("_w") == F.col("_w2")) & test).drop("_w", "_w2")


def nearby_cells(lat: Column, lon: Column, step: float = 0.1) -> Column:
    """The point's grid cell and its eight neighbours, as (row, column)."""
    r, c = F.floor(lat / step), F.floor(lon / step)
    return F.array(*(F.struct((r + i).alias("r"), (c + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)))


#: Ids that are broadcast, at most.
HUBS = 10_000


def connected_groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, group): connected components of edges (a, b); group = the least id.

    Large and small stars in turn: each node's larger neighbours are tied to its
    least one, then its smaller ones, so paths halve and edges become stars to the
    least id.  A round is one checkpoint; it is the last if the sum of the edges'
    hashes stays.  Where a node's least neighbour goes back to its edges, nodes
    with more than 2 in HUBS of all edges are broadcast (there are fewer than
    HUBS), so no node's edges are brought together.
    """
    from rosterlake.plans.session import checkpointed

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = checkpointed(df)
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def told(pairs: DataFrame, least: DataFrame, many: int) -> DataFrame:
        """Each pair with its node's least neighbour m."""
        hubs = least.filter(F.col("k") > many).select("u", F.col("m").alias("_hub"))
        marked = pairs.join(F.broadcast(hubs), "u", "left")
        rest = marked.filter("_hub is null").drop("_hub").join(least.filter(F.col("k") <= many).select("u", "m"), "u")
        return rest.unionByName(marked.filter("_hub is not null").withColumnRenamed("_hub", "m"))

    now, state = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if not state[0]:
            break
        many = max(100, -(-2 * state[0] // HUBS))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = told(both, least, many).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = told(large, floor, many).filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now, after = settled(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"connected_groups: not settled after {rounds} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("group"))
    alone = edges.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("group"))
    every = stars.unionByName(stars.select(F.col("group").alias("id"), "group").distinct())
    return every.unionByName(alone.distinct().join(every.select("id"), "id", "left_anti"))


# Kinds of ties between the numbers of one organisation, as bits.
TIES = {"name_address": 1, "facility": 2, "enrollment": 4, "parent": 8}


def _star(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """(a, b, tie): each member of a bucket of two or more, with the bucket's least member."""
    least = Window.partitionBy(*by)
    out = rows.select(*by, "npi").distinct().withColumn("b", F.min("npi").over(least)).withColumn("_n", F.count("*").over(least))
    return out.filter("_n > 1").select(F.col("npi").alias("a"), "b", F.lit(TIES[tie]).alias("tie"))


def _apart(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Stars of buckets whose members are tied unless they share a specialty at different addresses.

    With two specialties or more, every member is tied to all of another one, so
    the bucket is one star; with one, members at the same address are.  So no
    pairs are made.
    """
    bucket = Window.partitionBy(*by)
    kind = F.coalesce("taxonomy", F.lit(""))
    rows = rows.withColumn("_mixed", F.min(kind).over(bucket) != F.max(kind).over(bucket))
    one = _star(rows.filter("_mixed"), by, tie)
    return one.unionByName(_star(rows.filter("not _mixed and street is not null"), [*by, "number", "street"], tie))


def organisation_ties(orgs: DataFrame) -> DataFrame:
    """(a, b, tie): ties of organisations (npi, name_key, zip5, number, street, taxonomy, ccns, pac_ids, parent_key, parent_tin) within a ZIP code.

    Same name and street address (an address without a house number joins those
    of its street that have one and the same); a shared facility; the same
    enrollment; the same parent, by name or tax number.
    """
    at = orgs.filter("zip5 is not null")
    named = at.filter("name_key is not null and street is not null")
    street = ["name_key", "zip5", "street"]
    numbers = named.groupBy(*street).agg(F.count_distinct(F.nullif("number", F.lit(""))).alias("_k"), F.bool_or(F.col("number") == "").alias("_none")).filter("_k = 1 and _none").select(*street)
    parents = at.filter("parent_key is not null").select("zip5", F.col("parent_key").alias("_key")).distinct()
    as_child = at.filter("parent_key is not null").withColumn("_key", F.col("parent_key"))
    as_parent = at.filter("name_key is not null and not name_key <=> parent_key").withColumn("_key", F.col("name_key")).join(parents, ["zip5", "_key"], "left_semi")
    return reduce(
        DataFrame.unionByName,
        [
            _star(named, [*street, "number"], "name_address"),
            _star(named.join(numbers, street, "left_semi"), street, "name_address"),
            _star(at.select("npi", "zip5", F.explode("ccns").alias("_key")), ["zip5", "_key"], "facility"),
            _apart(at.withColumn("_key", F.explode("pac_ids")), ["zip5", "_key"], "enrollment"),
            _apart(as_child.unionByName(as_parent.select(*as_child.columns)), ["zip5", "_key"], "parent"),
            _apart(at.filter("parent_tin is not null"), ["zip5", "parent_tin"], "parent"),
        ],
    )


def organisation_groups(orgs: DataFrame, rank: Column, updated: str) -> DataFrame:
    """(npi, main_npi, members, is_main, ties): the organisations that ties connect, each with its main number and the kinds of its own ties."""
    from rosterlake.plans.session import checkpointed

    ties = checkpointed(organisation_ties(orgs))
    group = connected_groups(ties.select("a", "b").filter("a <> b"))
    own = ties.select(F.explode(F.array("a", "b")).alias("npi"), "tie").groupBy("npi").agg(F.bit_or("tie").alias("ties"))
    member = orgs.join(group, F.col("npi") == F.col("id"))
    main = ranked_main(member, "group", rank, updated, "npi")
    return main.select("npi", F.col("main").alias("main_npi"), "members", "is_main").join(own, "npi")


def license_matches(taxonomies: DataFrame, providers: DataFrame, licenses: DataFrame) -> DataFrame:
    """(npi, id): published licences (id, state, license_number, last_name, full_name) of the clinicians who list them.

    A number matches by all its digits or by its last run of digits, in the same
    state and for the same person; published rows that nobody lists are dropped
    before names are compared.
    """
    every, last = text.license_keys(F.col("license_no"))
    listed = taxonomies.filter("license_no is not null").select("npi", F.col("license_state").alias("state"), F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("how"), every.alias("key")), F.struct(F.lit(1).alias("how"), last.alias("key"))))).alias("k"))
    listed = listed.select("npi", "state", "k.how", "k.key").filter("key is not null").distinct()
    every, last = text.license_keys(F.col("license_number"))
    published = licenses.select("id", "state", "last_name", "full_name", F.explode(F.array(F.struct(F.lit(0).alias("how"), every.alias("key")), F.struct(F.lit(1).alias("how"), last.alias("key")))).alias("k"))
    published = published.select("id", "state", F.col("last_name").alias("_last"), F.col("full_name").alias("_full"), "k.how", "k.key").filter("key is not null")
    met = published.join(listed, ["state", "how", "key"]).join(providers.select("npi", "last_name"), "npi")
    return met.filter(text.same_person(F.col("last_name"), F.col("_last"), F.col("_full"))).select("npi", "id").distinct()


# The first places of a hospital's code in the list of specialties, and the kind that CMS gives a hospital.
HOSPITAL_CODES, HOSPITAL_KIND = "28", "Hospital"


def organisation_input(providers: DataFrame, locations: DataFrame, facilities: DataFrame, enrollments: DataFrame, profiles: DataFrame) -> DataFrame:
    """The organisations that ``organisation_groups`` takes, from the projected tables.

    ``providers``: npi, entity_type, org_name, primary_taxonomy_code,
    last_update_date; ``locations``: npi, is_primary, address1, zip5;
    ``facilities``: npi, ccn, kind; ``enrollments``: npi, pac_id; ``profiles``:
    npi, parent_name, parent_tin.  A hospital unit's CCN is its hospital's; an
    address is a house number without hyphens and a street ('' for no number);
    a ZIP code that isn't five digits is none.  Added: hospital (CMS ties it to
    one, or its specialty is one), enrolled.
    """
    orgs = providers.filter("entity_type = 2").select("npi", "org_name", "primary_taxonomy_code", "last_update_date")
    key = F.nullif(text.letters_key(F.col("org_name")), F.lit(""))
    place = address.building(F.col("address1"))
    at = locations.filter("is_primary").groupBy("npi").agg(F.min(F.struct("address1", "zip5")).alias("l")).select("npi", F.col("l.address1").alias("address1"), F.col("l.zip5").alias("zip5"))
    ccn = facilities.filter("npi is not null and trim(ccn) <> ''").groupBy("npi").agg(F.array_sort(F.collect_set(text.facility_key(F.col("ccn")))).alias("ccns"), F.max(F.col("kind") == HOSPITAL_KIND).alias("_hospital"))
    pac = enrollments.filter("npi is not null").groupBy("npi").agg(F.array_sort(F.collect_set("pac_id")).alias("pac_ids"))
    parent = profiles.groupBy("npi").agg(F.max("parent_name").alias("_p"), F.max("parent_tin").alias("_t"))
    out = orgs.join(at, "npi", "left").join(ccn, "npi", "left").join(pac, "npi", "left").join(parent, "npi", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "npi", "org_name", key.alias("name_key"), F.when(F.length("zip5") == 5, F.col("zip5")).alias("zip5"), place["number"].alias("number"), place["street"].alias("street"), F.col("primary_taxonomy_code").alias("taxonomy"),
        F.col("last_update_date").alias("updated"), F.coalesce("ccns", none).alias("ccns"), F.coalesce("pac_ids", none).alias("pac_ids"), F.nullif(text.letters_key(F.col("_p")), F.lit("")).alias("parent_key"),
        F.nullif(F.regexp_replace("_t", "[^0-9]", ""), F.lit("")).alias("parent_tin"), (F.coalesce("_hospital", F.lit(False)) | F.coalesce(F.startswith("primary_taxonomy_code", F.lit(HOSPITAL_CODES)), F.lit(False))).alias("hospital"), F.col("pac_ids").isNotNull().alias("enrolled"),
    )


def participant_matches(participants: DataFrame, organisations: DataFrame, most: int = 5, family: int = 50) -> DataFrame:
    """(group_id, name, npi, candidates, hospital, grouped_by, grouped_value): participants (group_id, name) with the organisations of the same name.

    ``organisations``: npi, org_name, hospital, ccns, parent_key, parent_tin, as
    ``organisation_input`` has them.  Up to ``most`` of a name are all candidates;
    more are none, unless they are a hospital and its own numbers, ``family`` at
    most: every other one shares a facility with it, or names it or its parent,
    by name or tax number.  A hospital without a parent is tried first, then the
    least number.  ``grouped_by`` tells what joins a family: ``ccn`` (all share
    one), ``parent``, ``parent_tin`` (one parent that all but one name at most),
    else ``hospital``.  A name without letters or digits matches nothing.
    """
    key = F.nullif(text.letters_key(F.col("name")), F.lit(""))
    asked = participants.select("group_id", "name", key.alias("key")).filter("key is not null")
    one = organisations.withColumn("key", F.nullif(text.letters_key(F.col("org_name")), F.lit(""))).join(asked.select("key").distinct(), "key", "left_semi").dropDuplicates(["npi"])
    count = one.groupBy("key").agg(F.count("*").alias("candidates"))
    few = one.join(count.filter(F.col("candidates") <= family), "key")  # a name that more have is never gathered
    row = F.struct("npi", "org_name", "hospital", F.coalesce("ccns", F.array().cast("array<string>")).alias("ccns"), "parent_key", "parent_tin")
    group = few.groupBy("key", "candidates").agg(F.array_sort(F.collect_list(row)).alias("o"))
    joined = F.coalesce  # null-safe equality of what both name
    owns = lambda o, h: joined(F.arrays_overlap(o["ccns"], h["ccns"]), F.lit(False)) | joined((o["parent_key"] == F.col("key")) | (o["parent_key"] == h["parent_key"]), o["parent_key"] == F.col("key"), F.lit(False)) | joined(o["parent_tin"] == h["parent_tin"], F.lit(False))
    heads = F.filter("o", lambda h: F.coalesce(h["hospital"], F.lit(False)) & F.forall("o", lambda o: (o["npi"] == h["npi"]) | owns(o, h)))
    free = F.filter(heads, lambda h: h["parent_key"].isNull() & h["parent_tin"].isNull())
    head = F.coalesce(F.get(free, F.lit(0)), F.get(heads, F.lit(0)))
    group = group.withColumn("head", F.when(F.col("candidates") > 1, head)).filter((F.col("candidates") <= most) | F.col("head").isNotNull())
    shared = F.aggregate("o", F.get("o", F.lit(0))["ccns"], lambda acc, o: F.array_intersect(acc, o["ccns"]))

    def parent(c: str) -> Column:
        """The one parent that all but one of them name at most."""
        given = F.array_distinct(F.filter(F.transform("o", lambda o: o[c]), lambda x: x.isNotNull()))
        lacking = F.size(F.filter("o", lambda o: o[c].isNull()))
        return F.when((F.size(given) == 1) & (lacking <= 1), F.get(given, F.lit(0)))

    by = F.when(F.size(shared) > 0, "ccn").when(parent("parent_key").isNotNull(), "parent").when(parent("parent_tin").isNotNull(), "parent_tin").otherwise("hospital")
    value = F.when(F.size(shared) > 0, F.array_min(shared)).when(parent("parent_key").isNotNull(), parent("parent_key")).when(parent("parent_tin").isNotNull(), F.lit(None).cast("string")).otherwise(F.trim("head.org_name"))
    hospital = F.col("head").isNotNull()
    linked = group.select("key", "candidates", hospital.alias("hospital"), F.when(hospital, by).alias("grouped_by"), F.when(hospital, value).alias("grouped_value"), F.explode("o.npi").alias("npi"))
    return asked.join(linked, "key").select("group_id", "name", "npi", "candidates", "hospital", "grouped_by", "grouped_value")


def one_per_group(df: DataFrame, group: str, main_first: Column, key: str) -> DataFrame:
    """Of the rows that match, one per group: the main member if it matches, else the least key; rows without a group stay."""
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("\x00"), F.col(key).cast("string")))
    return latest(df.withColumn("_g", own), ["_g"], [main_first.desc(), F.asc(key)]).drop("_g")


def ranked_main(df: DataFrame, group: str, rank: Column, updated: str, key: str) -> DataFrame:
    """Each member with its group's main member: highest rank, then newest, then least key."""
    w = Window.partitionBy(group).orderBy(rank.desc(), F.desc_nulls_last(updated), F.asc(key))
    return df.withColumn("main", F.first(key).over(w)).withColumn("is_main", F.col("main") == F.col(key)).withColumn("members", F.count("*").over(Window.partitionBy(group)))
