"""The change log: what kind of change each key went through between two states of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_log(old: DataFrame, new: DataFrame, key: list[str], kinds: dict[str, list[str]], added: str = "added", removed: str = "removed") -> DataFrame:
    """(key, kind, was, is): a row for each key that is new or gone, and for each kind one of whose columns differs (null-safe).

    ``was`` and ``is`` are the kind's columns, joined by a comma; a key is
    compared once however many kinds there are.
    """
    columns = list(dict.fromkeys(c for group in kinds.values() for c in group))
    both = old.select(*key, F.struct(F.lit(1).alias("_here"), *columns).alias("_o")).join(new.select(*key, F.struct(F.lit(1).alias("_here"), *columns).alias("_n")), key, "full_outer")
    o, n = F.col("_o"), F.col("_n")

    def shown(side: Column, group: list[str]) -> Column:
        return F.concat_ws(", ", *(side[c].cast("string") for c in group))

    def row(kind: str, was: Column, now: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), was.alias("was"), now.alias("is"))

    none = F.lit(None).cast("string")
    parts = []
    for kind, group in kinds.items():
        differs = F.lit(False)
        for c in group:
            differs = differs | ~o[c].eqNullSafe(n[c])
        parts.append(F.when(o.isNotNull() & n.isNotNull() & differs, row(kind, shown(o, group), shown(n, group))))
    parts += [F.when(o.isNull(), row(added, none, none)), F.when(n.isNull(), row(removed, none, none))]
    return both.select(*key, F.explode(F.array_compact(F.array(*parts))).alias("_c")).select(*key, "_c.*")


def described(log: DataFrame, key: list[str], texts: dict[str, str]) -> DataFrame:
    """(key, text): a key's changes as one text, in the order of ``texts`` (kind: wording with {was} and {is})."""
    wording = F.lit(None).cast("string")
    for kind, text in texts.items():
        first, _, rest = text.partition("{was}")
        middle, _, last = rest.partition("{is}") if rest else ("", "", "")
        said = F.concat(F.lit(first), F.coalesce("was", F.lit("none")), F.lit(middle), F.coalesce("is", F.lit("none")), F.lit(last)) if rest else F.lit(text)
        wording = F.when(F.col("kind") == kind, said).otherwise(wording)
    place = F.array_position(F.array(*map(F.lit, texts)), F.col("kind"))
    rows = log.select(*key, F.struct(place.alias("place"), wording.alias("text")).alias("_t")).filter("_t.text is not null")
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda t: t["text"]), "; ").alias("text"))
