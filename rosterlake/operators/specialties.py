"""Specialty codes under plain names: an ordered rule table with a fallback, several names for one code, nobody counted twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Where codes without a rule are placed.
OTHER = ("Other", "Other")


def placements(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """(code, category, subcategory, main): every plain name of each code; ``main`` marks the one under which it is shown.

    ``rules``: code, category, subcategory, rank.  The rule of least rank is the
    main one (of equals the least name); a code without rules is Other; codes are
    compared without case, null codes have no place.
    """
    rule = rules.select(F.upper(F.trim("code")).alias("_rule"), "category", "subcategory", "rank").groupBy("_rule", "category", "subcategory").agg(F.min("rank").alias("rank"))
    wanted = codes.select("code").filter("code is not null").distinct()
    met = wanted.join(rule, F.upper(F.trim("code")) == F.col("_rule"), "left")
    met = met.select("code", F.coalesce("category", F.lit(OTHER[0])).alias("category"), F.when(F.col("category").isNull(), F.lit(OTHER[1])).otherwise(F.col("subcategory")).alias("subcategory"), "rank")
    first = F.row_number().over(Window.partitionBy("code").orderBy(F.asc_nulls_last("rank"), "category", "subcategory")) == 1
    return met.withColumn("main", first).drop("rank")


def breakdown(members: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(level, category, subcategory, members): distinct members (key, code) under each plain name, in each category, and in all.

    A member with several codes, or a code with several names, counts once at each
    level that it reaches; so categories can add up to more than all, but each is
    exact.  Levels are grouping sets of one shuffle.
    """
    placed = members.join(placements(members, rules), "code").select(key, "category", "subcategory").distinct()
    rolled = placed.rollup("category", "subcategory").agg(F.count_distinct(key).alias("members"), F.grouping_id().alias("_level"))
    level = F.when(F.col("_level") == 3, "all").when(F.col("_level") == 1, "category").otherwise("subcategory")
    return rolled.select(level.alias("level"), "category", "subcategory", "members")


def shown(members: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(category, subcategory, members): each member once, under the main name of its code (key, code: one code for each)."""
    placed = placements(members, rules).filter("main")
    return members.join(placed, "code").groupBy("category", "subcategory").agg(F.count_distinct(key).alias("members"))
