"""Free-text queries read by a vocabulary: a number, a specialty, places and distances, and what is left as a name."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import text

#: Words of the longest phrase of each kind.
LONGEST = {"specialty": 6, "county": 4, "city": 4, "state": 3, "code": 1}
# Words between the parts of a query, dropped once one is found.
BETWEEN = (
    "in", "near", "around", "at", "from", "the", "a", "an", "of", "for", "with", "and", "within", "miles", "mile", "mi", "close", "to", "by", "me", "find", "search", "list", "all", "show",
)
# Words for anyone who practises; they tell no specialty beside a name.
ANYONE = ("doctor", "doctors", "provider", "providers", "physician", "physicians", "specialist", "specialists", "practitioner", "practitioners")
# Words before a town, and behind a county's name.
BEFORE_TOWN, COUNTY_WORDS = ("in", "near", "around", "at", "from"), ("county", "parish", "borough", "counties")
# Words of organisations' names.
ORGANISATION = (
    "llc", "inc", "pc", "pllc", "llp", "ltd", "corp", "corporation", "co", "company", "hospital", "hospitals", "clinic", "clinics", "center", "centre", "centers", "group", "associates", "assoc", "medical", "health", "healthcare", "care", "pharmacy", "lab", "labs", "laboratory",
    "laboratories", "services", "practice", "partners", "dental", "chiropractic", "therapy", "university", "system", "foundation", "institute", "home", "hospice", "ambulance", "imaging", "radiology", "surgery", "surgical", "urgent", "rehab", "rehabilitation", "nursing", "supply",
)
#: Miles for "near" a ZIP code, and at most.
NEAR, FAR = 10, 100


def phrases(names: DataFrame, column: str, kind: str, value: str) -> DataFrame:
    """(phrase, kind, value) of names, with what people write for them: plurals, without what is in parentheses, Saint as St, counties without the word."""
    base = F.regexp_replace(F.col(column), r"\([^)]*\)", " ")
    plain = text.normalised(base)
    plural = F.when(F.rlike(plain, F.lit("[^aeiou]y$")), F.regexp_replace(plain, "y$", "ies")).when(F.endswith(plain, F.lit("s")), plain).otherwise(F.concat(plain, F.lit("s")))
    every = [text.normalised(F.col(column)), plain]
    if kind == "place":
        saint = F.regexp_replace(plain, r"\bsaint\b", "st")
        every += [saint, F.regexp_replace(plain, r"\bst\b", "saint"), F.regexp_replace(plain, r" (county|parish|borough)$", ""), F.regexp_replace(saint, r" (county|parish|borough)$", "")]
    else:
        every.append(plural)
    rows = names.select(F.col(value).alias("value"), F.explode(F.array_distinct(F.array(*every))).alias("phrase"))
    return rows.filter("phrase <> ''").select("phrase", F.lit(kind).alias("kind"), "value").distinct()


def vocabulary(specialties: DataFrame, counties: DataFrame, cities: DataFrame, states: DataFrame) -> DataFrame:
    """(phrase, kind, value, label, state, size) of everything that a query can name.

    ``specialties``: name, value; ``counties``: name, state, fips, population;
    ``cities``: city, state, zips; ``states``: code, name.  A county is named
    without its last word, as that stands behind it in a query.
    """
    columns = ["phrase", "kind", "value", "label", "state", "size"]
    none = F.lit(None).cast("string")
    kinds = phrases(specialties, "name", "specialty", "value").select("phrase", "kind", "value", F.col("value").alias("label"), none.alias("state"), F.lit(0).cast("long").alias("size"))

    def places(df: DataFrame, name: str, kind: str) -> DataFrame:
        plain = text.normalised(F.col(name))
        if kind == "county":
            plain = F.regexp_replace(plain, f" ({'|'.join(COUNTY_WORDS)})$", "")
        every = F.array_distinct(F.array(plain, F.regexp_replace(plain, r"\bsaint\b", "st"), F.regexp_replace(plain, r"\bst\b", "saint")))
        return df.withColumn("phrase", F.explode(every)).withColumn("kind", F.lit(kind))

    county = places(counties, "name", "county").select("phrase", "kind", F.col("fips").alias("value"), F.col("name").alias("label"), "state", F.col("population").cast("long").alias("size"))
    city = places(cities, "city", "city").select("phrase", "kind", F.initcap(F.lower("city")).alias("value"), F.initcap(F.lower("city")).alias("label"), "state", F.col("zips").cast("long").alias("size"))
    state = states.select(text.normalised(F.col("name")).alias("phrase"), F.lit("state").alias("kind"), F.col("code").alias("value"), F.col("name").alias("label"), F.col("code").alias("state"), F.lit(0).cast("long").alias("size"))
    code = states.select(F.lower("code").alias("phrase"), F.lit("code").alias("kind"), F.col("code").alias("value"), F.col("name").alias("label"), F.col("code").alias("state"), F.lit(0).cast("long").alias("size"))
    return reduce(DataFrame.unionByName, (x.select(*columns) for x in (kinds, county, city, state, code))).filter("phrase <> ''").distinct()


class Reading:
    """One query's words, what the vocabulary knows of them, and which words are still free."""

    def __init__(self, words: list[str], hits: list[dict]):
        self.words, self.free, self.notes = words, set(range(len(words))), []
        self.hits = [h for h in hits if h["n"] <= LONGEST[h["kind"]]]

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def take(self, *places: int) -> None:
        self.free -= set(places)

    def known(self, kind: str, fits=lambda h: True) -> list[dict]:
        """What the longest free phrase of a kind stands for, the first of equally long ones; the largest value first."""
        open_ = [h for h in self.hits if h["kind"] == kind and self.free.issuperset(range(h["at"], h["at"] + h["n"])) and fits(h)]
        best = min(open_, key=lambda h: (-h["n"], h["at"]), default=None)
        same = [h for h in open_ if best and (h["at"], h["n"]) == (best["at"], best["n"])]
        return sorted(same, key=lambda h: (-h["size"], h["state"] or "", h["value"]))

    def claim(self, h: dict, more: int = 0) -> dict:
        self.take(*range(h["at"], h["at"] + h["n"] + more))
        return h

    def distance(self) -> int | None:
        """Miles that are named: a number of three digits at most before a word for them."""
        miles = None
        for i in range(len(self.words) - 1):
            number = self.word(i)
            if self.word(i + 1) in ("miles", "mile", "mi") and number.isascii() and number.isdigit() and len(number) <= 3:
                miles = min(max(int(number), 1), FAR)
                self.take(i, i + 1, *([i - 1] if self.word(i - 1) == "within" else []))
        return miles

    def postal(self) -> tuple[str | None, bool]:
        """The first ZIP code, four more digits behind it or not, and whether a word for near stands before it."""
        for i in sorted(self.free):
            if len(self.word(i)) == 5 and self.word(i).isascii() and self.word(i).isdigit():
                more = self.word(i + 1)
                self.take(i, *([i + 1] if len(more) == 4 and more.isascii() and more.isdigit() else []))
                return self.word(i), self.word(i - 1) in ("near", "around")
        return None, False

    def county(self, state: str | None) -> dict | None:
        for at in range(1, len(self.words)):
            if at not in self.free or self.word(at) not in COUNTY_WORDS:
                continue
            # Up to four words before it, the longest that names a county of the state.
            found = self.known("county", lambda h: h["at"] + h["n"] == at and state in (None, h["state"]))  # noqa: B023
            if found:
                if state is None and len(found) > 1:
                    self.notes.append(f"{found[0]['label']}: also in {', '.join(dict.fromkeys(h['state'] for h in found[1:]))}")
                return self.claim(found[0], 1)
        return None


EMPTY = dict.fromkeys(("npi", "specialty", "state", "county", "city", "zip5", "radius", "org_name", "first_name", "last_name", "name"))


def read_words(asked: str | None, words: list[str], hits: list[dict]) -> dict:
    """One query read: what it asks for, as ``interpret`` tells."""
    raw = (asked or "").strip()
    out = {"kind": "empty", **EMPTY, "near_me": False, "notes": []}
    digits = "".join(c for c in raw if c in "0123456789")
    if len(digits) == 10 and not raw.strip("0123456789 -"):
        return out | {"kind": "number", "npi": digits}
    r = Reading(words, hits)
    for i in range(len(words) - 1):
        if words[i : i + 2] == ["near", "me"]:
            r.take(i, i + 1)
            out["near_me"] = True
    radius = r.distance()
    zip5, near = r.postal()
    state = city = None
    for phrase in (["nyc"], ["new", "york", "city"]):
        for i in sorted(r.free):
            if words[i : i + len(phrase)] == phrase and r.free.issuperset(range(i, i + len(phrase))):
                state, city = "NY", "New York"
                r.take(*range(i, i + len(phrase)))
    last = max(r.free, default=-1)
    # A code of two letters counts as the last word only, so that in, or and me stay words.
    if state is None and last >= 0 and (last > 0 or len(words) == 1) and (found := r.known("code", lambda h: h["at"] == last)):
        state = r.claim(found[0])["value"]
    if state is None and (found := r.known("state")):
        state = r.claim(found[0])["value"]
    county = r.county(state)
    state = state or (county and county["state"])
    specialty = r.claim(found[0]) if (found := r.known("specialty")) else None
    own = words[specialty["at"] : specialty["at"] + specialty["n"]] if specialty else []
    r.take(*(i for i in r.free if words[i] in ANYONE))
    # A town needs something beside it, so that a surname isn't one; words that organisations or anyone have don't count.
    telling = specialty is not None and not all(w in ORGANISATION or w in ANYONE for w in own)
    context = telling or state is not None or county is not None
    if city is None and zip5 is None:
        found = r.known("city", lambda h: state in (None, h["state"]) and (context or r.word(h["at"] - 1) in BEFORE_TOWN))
        if found:
            city = r.claim(found[0])["value"]
            state = state or found[0]["state"]
    placed = any((state, county, city, zip5))
    rest = [i for i in sorted(r.free) if words[i] not in BETWEEN]
    if specialty and not placed and rest and all(w in ORGANISATION for w in own):
        r.free |= set(range(specialty["at"], specialty["at"] + specialty["n"]))  # a name, not a kind
        specialty = None
    elif specialty and not placed and rest and all(w in ANYONE for w in own):
        specialty = None
    if not specialty and not placed:
        typed = raw.split()
        typed = typed[1:] if typed and typed[0].lower().strip(".,") == "dr" else typed
        name = " ".join(typed)
        return out | ({"kind": "names", "name": name} if any(c.isalnum() for c in name) else {})
    if zip5 is None and radius is not None:
        r.notes.append("a distance needs a ZIP code")
    names = [words[i] for i in sorted(r.free) if words[i] not in BETWEEN]
    out |= {"kind": "list", "specialty": specialty and specialty["value"], "state": state, "county": county and county["value"], "city": city, "zip5": zip5, "notes": r.notes}
    out["radius"] = (NEAR if radius is None and near else radius) if zip5 else None
    if names:
        out["name"] = " ".join(names)
        if any(w in ORGANISATION for w in names):
            out["org_name"] = out["name"]
        else:
            out["first_name"], out["last_name"] = " ".join(names[:-1]) or None, names[-1]
    return out


def interpret(queries: DataFrame, known: DataFrame) -> DataFrame:
    """What each query (id, text) asks for.

    (id, kind, npi, specialty, state, county, city, zip5, radius, near_me,
    org_name, first_name, last_name, name, notes): ten digits, spaces or hyphens
    between, are a registry number; words that name nothing known are a name, as
    typed; else a list: a specialty (the longest phrase), a state (its code as the
    last word, its name anywhere), a county before its word (of several the most
    populous), a town of most ZIP codes where something else is named, a ZIP code
    with a distance, and what is left as a name.  Blank text, or none, is empty.

    Phrases are found by a join of word runs with the vocabulary (``vocabulary``),
    so it may be large; a small function then weighs one query's few hits.
    """
    longest = max(LONGEST.values())
    base = queries.select("id", "text", text.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i)), lambda n: F.struct(i.alias("at"), n.alias("n")))))
    grams = base.filter("size(w) > 0").select("id", "w", F.explode(spans).alias("s"))
    grams = grams.select("id", "s.at", "s.n", F.array_join(F.slice("w", F.col("s.at") + 1, F.col("s.n")), " ").alias("phrase"))
    hits = grams.join(known, "phrase").groupBy("id").agg(F.collect_list(F.struct("at", "n", "kind", "value", "label", "state", "size")).alias("hits"))
    kind = queries.schema["id"].dataType.simpleString()
    schema = f"id {kind}, kind string, npi string, specialty string, state string, county string, city string, zip5 string, radius int, near_me boolean, org_name string, first_name string, last_name string, name string, notes array<string>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [{"id": q["id"], **read_words(q["text"], q["w"], q["hits"] or [])} for q in batch.to_pylist()]
            types = {"radius": pa.int32(), "near_me": pa.bool_(), "notes": pa.list_(pa.string()), "id": batch.column("id").type}
            yield pa.RecordBatch.from_arrays([pa.array([q[c] for q in read], types.get(c, pa.string())) for c in names], names)

    return base.join(hits, "id", "left").mapInArrow(run, schema)


def suggestions(prefix: str, specialties: DataFrame, places: DataFrame, people: DataFrame, most: int = 8) -> DataFrame:
    """(kind, label, rank): phrases that begin with the prefix, then those with a word that does; places by population; people by name."""
    asked = text.normalised(F.lit(prefix))

    def fit(df: DataFrame, kind: str, order: Column) -> DataFrame:
        plain = text.normalised(F.col("label"))
        first, word = F.startswith(plain, asked), F.contains(F.concat(F.lit(" "), plain), F.concat(F.lit(" "), asked))
        return df.filter(first | word).select(F.lit(kind).alias("kind"), "label", F.struct((~first).alias("later"), order.alias("by"), "label").alias("_o")).orderBy("_o").limit(most)

    parts = [fit(specialties, "specialty", F.lit(0.0)), fit(places, "place", -F.col("population").cast("double")), fit(people, "person", F.lit(0.0))]
    every = reduce(DataFrame.unionByName, parts)  # 3 x most rows
    kinds = F.array_position(F.array(F.lit("specialty"), F.lit("place"), F.lit("person")), F.col("kind"))
    return every.select("kind", "label", F.struct("_o.later", kinds.alias("k"), F.col("_o.by"), "label").alias("_o")).orderBy("_o").limit(most).select("kind", "label")
