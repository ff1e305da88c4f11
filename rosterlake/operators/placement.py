"""Practice addresses placed on the map by address points, by places at the address, and by building names.

Joins are merges of what both sides are dealt by: estimates are made from the
bytes of files, and rows with exploded words are many times as large, so that a
side to be broadcast could fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import address

#: Share of an address's name words that a place must have, and their least number.
COVERAGE, SHARED = 0.75, 2


def _areas(zip5: Column, city: Column) -> Column:
    """The areas in which an address is looked up, narrower first: its ZIP code, its city."""
    listed = F.array(F.when(zip5.isNotNull(), F.concat(F.lit("Z"), zip5)), F.when(city.isNotNull(), F.concat(F.lit("C"), city)))
    return F.filter(listed, lambda a: a.isNotNull())


def _spot(rank: Column, source: str, lat: Column, lon: Column, matched: Column) -> Column:
    return F.named_struct(F.lit("rank"), rank, F.lit("source"), F.lit(source), F.lit("lat"), lat, F.lit("lon"), lon, F.lit("matched"), matched)


def _by_house(wanted: DataFrame, points: DataFrame, places: DataFrame) -> DataFrame:
    """(addr_key, found): each address with a house number at its best point or places."""
    areas = _areas(F.col("_zip"), F.col("_city"))
    asked = wanted.filter("_house is not null").select("addr_key", "_house.number", "_house.street", F.explode(areas).alias("area"))
    point = points.select(F.upper(F.trim("number")).alias("number"), address.street(F.col("street")).alias("street"), F.explode(_areas(address.zip5(F.col("zip")), address.city(F.col("city")))).alias("area"), F.lit(0).alias("kind"), "lat", "lon", F.lit(None).cast("string").alias("name"))
    place = places.select(address.house(F.col("address")).alias("h"), F.explode(_areas(address.zip5(F.col("zip")), address.city(F.col("city")))).alias("area"), "lat", "lon", F.coalesce("name", F.lit("")).alias("name"))
    place = place.filter("h is not null").select("h.number", "h.street", "area", F.lit(1).alias("kind"), "lat", "lon", "name")
    keys = ["number", "street", "area"]
    # A state has millions of points and few asked addresses: only their keys are aggregated.
    known = point.filter("number <> '' and street <> ''").unionByName(place).join(asked.select(*keys).distinct().hint("merge"), keys, "left_semi").groupBy(*keys).agg(
        F.min(F.when(F.col("kind") == 0, F.struct("lat", "lon"))).alias("point"),
        F.median(F.when(F.col("kind") == 1, F.col("lat"))).alias("lat"), F.median(F.when(F.col("kind") == 1, F.col("lon"))).alias("lon"), F.min("name").alias("name"),
    )
    in_city = F.startswith("area", F.lit("C")).cast("int")
    exact = F.when(F.col("point").isNotNull(), _spot(in_city, "address", F.col("point.lat"), F.col("point.lon"), F.concat_ws(" ", "number", "street")))
    near = F.when(F.col("lat").isNotNull(), _spot(in_city + 2, "place", F.col("lat"), F.col("lon"), F.col("name")))
    return asked.join(known.hint("merge"), keys).groupBy("addr_key").agg(F.least(F.min(exact), F.min(near)).alias("found"))


def _by_name(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """(addr_key, found): addresses that are a building's name, at the place in their ZIP code or city whose name has their words.

    An inverted index of words by area.  A place that has ``need`` of n words has
    one of any n - need + 1 of them, so only an address's rarest words in its
    area are looked up: a word that most places have is asked for by no address
    that has a rarer one.  Addresses of one name and area are one, and of the
    places of one area and the same words only the one that would be chosen counts.
    """
    tokens = address.name_tokens(F.col("address1"))
    named = wanted.filter("_house is null").withColumn("tokens", tokens).filter(F.size("tokens") >= SHARED).withColumn("area", F.explode(_areas(F.col("_zip"), F.col("_city"))))
    asked = named.select("tokens", "area").distinct()
    z, c = address.zip5(F.col("zip")), address.city(F.col("city"))
    listed = places.select(F.coalesce(F.concat(F.lit("Z"), z), F.concat(F.lit("C"), c)).alias("area"), address.name_tokens(F.col("name")).alias("words"), "lat", "lon", "confidence", "name").filter((F.size("words") >= SHARED) & F.col("area").isNotNull())
    listed = listed.groupBy("area", "words").agg(F.min(F.struct((-F.col("confidence")).alias("sure"), "name", "lat", "lon")).alias("first"))
    index = listed.withColumn("word", F.explode("words"))
    often = index.groupBy("area", "word").agg(F.count("*").alias("k"))
    need = F.greatest(F.ceil(COVERAGE * F.size("tokens") - 1e-9).cast("int"), F.lit(SHARED))
    each = asked.withColumn("word", F.explode("tokens")).join(often.hint("merge"), ["area", "word"], "left")
    rare = each.withColumn("at", F.row_number().over(Window.partitionBy("area", "tokens").orderBy(F.coalesce("k", F.lit(0)), "word")))
    rare = rare.filter((F.col("at") <= F.size("tokens") - need + 1) & F.col("k").isNotNull()).select("area", "tokens", "word")
    shared = F.size(F.array_intersect("tokens", "words"))
    met = rare.join(index.hint("merge"), ["area", "word"]).withColumn("shared", shared).filter(F.col("shared") >= need)
    order = F.struct((-F.col("shared") / F.size("tokens")).alias("covered"), (-F.col("shared") / F.size("words")).alias("closest"), "first.sure", "first.name", "first.lat", "first.lon")
    best = met.groupBy("area", "tokens").agg(F.min(order).alias("best"))
    found = _spot(F.lit(4), "place_name", F.col("o.lat"), F.col("o.lon"), F.col("o.name"))
    return named.select("addr_key", "tokens", "area").join(best.hint("merge"), ["area", "tokens"]).groupBy("addr_key").agg(F.min("best").alias("o")).select("addr_key", found.alias("found"))


def place(addresses: DataFrame, points: DataFrame, places: DataFrame) -> DataFrame:
    """(addr_key, source, lat, lon, matched) of the addresses (addr_key, address1, city, zip5) that can be placed.

    ``points`` (number, street, zip, city, lat, lon) and ``places`` (name,
    address, zip, city, lat, lon, confidence).  With a house number: the address
    point of its number, street and ZIP code, else city (of several the least);
    else the middle of the places listed there.  A number that no data knows
    isn't placed by name.  Without one: the place whose name has at least
    COVERAGE of the words, best covered first, then the closest name, the surest,
    the least.  ``addr_key`` is unique.
    """
    # Reading an address costs more than moving it, and a small file would be read in one task.
    addresses, points, places = addresses.repartition("addr_key"), points.repartition("lat", "lon"), places.repartition("lat", "lon")
    wanted = addresses.select("addr_key", "address1", address.house(F.col("address1")).alias("_house"), address.zip5(F.col("zip5")).alias("_zip"), address.city(F.col("city")).alias("_city"))
    return _by_house(wanted, points, places).unionByName(_by_name(wanted, places)).select("addr_key", "found.source", "found.lat", "found.lon", "found.matched")


def listed_at(addresses: DataFrame, places: DataFrame) -> DataFrame:
    """(addr_key, name, status, updated, sources): the businesses listed at each address's number, street and ZIP code.

    ``places`` also has status, updated and sources (joined by ``;``).  Places of
    one name, whatever its case, are one: open if any is, else the least status;
    all sources once, in order, and the newest date.
    """
    keys = ["number", "street", "zip"]
    at = addresses.select("addr_key", address.house(F.col("address1")).alias("h"), address.zip5(F.col("zip5")).alias("zip")).filter("h is not null and zip is not null").select("addr_key", "h.number", "h.street", "zip")
    listed = places.filter(F.trim("name") != "").select(address.house(F.col("address")).alias("h"), address.zip5(F.col("zip")).alias("zip"), F.trim("name").alias("name"), "status", "updated", "sources")
    listed = listed.filter("h is not null and zip is not null").select("h.number", "h.street", "zip", "name", "status", "updated", "sources").join(at.select(*keys).distinct(), keys, "left_semi")
    one = listed.groupBy(*keys, F.upper("name").alias("_n")).agg(
        F.min("name").alias("name"), F.coalesce(F.max(F.when(F.col("status") == "open", "open")), F.min("status")).alias("status"), F.max("updated").alias("updated"),
        F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.split(F.coalesce("sources", F.lit("")), ";"))), lambda s: s != ""))), ";"), F.lit("")).alias("sources"),
    )
    return at.join(one, keys).select("addr_key", "name", "status", "updated", "sources")
