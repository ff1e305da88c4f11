"""Existence filters as semi and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import text


def having(df: DataFrame, child: DataFrame, on: dict[str, str], where: Column | None = None) -> DataFrame:
    """Rows with at least one child row; ``on`` maps columns of ``df`` to those of ``child``."""
    return _exists(df, child, on, where, "left_semi")


def lacking(df: DataFrame, child: DataFrame, on: dict[str, str], where: Column | None = None) -> DataFrame:
    """Rows without a child row; rows with a null key are kept (unlike NOT IN)."""
    return _exists(df, child, on, where, "left_anti")


def _exists(df: DataFrame, child: DataFrame, on: dict[str, str], where: Column | None, how: str) -> DataFrame:
    child = child if where is None else child.filter(where)
    keys = child.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on.values())))
    cond = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(on)]
    return df.join(keys, cond, how)


def flag(df: DataFrame, child: DataFrame, on: dict[str, str], wanted: bool | None, where: Column | None = None) -> DataFrame:
    """Tri-state filter: None: all rows, True: with a child row, False: without one."""
    if wanted is None:
        return df
    return having(df, child, on, where) if wanted else lacking(df, child, on, where)


def all_words(columns: list[str], asked: str) -> Column:
    """Every word asked is in one of the columns (no case, no accents)."""
    both = text.fold(F.concat_ws(" ", *columns))
    return reduce(lambda a, w: a & F.contains(both, text.fold(F.lit(w))), asked.split(), F.lit(True))


def directory(df: DataFrame, q: str | None = None, id_column: str = "id", zip_column: str = "zip", names: tuple[str, ...] = ("name",), equal: dict[str, object] | None = None, least: dict[str, float] | None = None, most: dict[str, float] | None = None, listed: dict[str, str] | None = None) -> DataFrame:
    """A directory's rows: ``q`` is an id, a ZIP code or words that all must be in the names; equal values; bounds; a value in a comma list."""
    out = df
    if q and q.strip():
        asked = q.strip()
        number = asked.isdigit()
        hit = F.col(id_column).cast("string") == asked
        out = out.filter((hit | (F.col(zip_column) == asked)) if number and len(asked) == 5 else hit if number else hit | all_words(list(names), asked))
    for column, value in (equal or {}).items():
        out = out.filter(F.col(column) == value)
    for column, value in (least or {}).items():
        out = out.filter(F.col(column) >= value)
    for column, value in (most or {}).items():
        out = out.filter(F.col(column) <= value)
    for column, value in (listed or {}).items():
        out = out.filter(F.array_contains(F.split(column, ","), F.lit(value)))
    return out


# What marks a post-office box, a suite, and a status that isn't active.
PO_BOX = r"(^|[^A-Z])(P[ .]*O[ .]*BOX|POST OFFICE BOX)([^A-Z]|$)"
SUITE = r"\b(STE|SUITE|FL|FLR|FLOOR|BLDG|BUILDING|RM|ROOM)\b"
INACTIVE = r"DECEASED|REVOK|SURRENDER|VOID|CANC|TERMINAT|INACTIVE|NOT ACTIVE|EXPIRED|LAPSED|NOT RENEWED|RELINQUISH|SUPERSEDED|CLOSED|DEACTIVATED|SUSPEND|DELINQUENT|^TEXAS RETIRED|^RETIRED$"


def is_po_box(c: Column) -> Column:
    return F.rlike(F.upper(F.coalesce(c, F.lit(""))), F.lit(PO_BOX))


def is_suite(c: Column) -> Column:
    return F.rlike(F.upper(F.coalesce(c, F.lit(""))), F.lit(SUITE))


# Fixed value: what a status in force begins with.
IN_FORCE = r"^(ACTIVE|CURRENT|CLEAR|APPROVED|PERMIT ISSUED|PROBATION|MILITARY ACTIVE|RETIRED ACTIVE|A$)"


def is_in_force(c: Column) -> Column:
    return F.rlike(F.upper(F.coalesce(c, F.lit(""))), F.lit(IN_FORCE))


def is_inactive(c: Column) -> Column:
    return F.rlike(F.upper(F.coalesce(c, F.lit(""))), F.lit(INACTIVE))
