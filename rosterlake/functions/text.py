"""Text expressions: converters, folding, keys and distances. All are Column functions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Words that a company name key leaves out.
LEGAL_WORDS = (
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "COMPANIES", "LLC", "LP", "LLP", "LTD", "LIMITED", "PLC", "SA", "AG", "NV", "BV", "GMBH", "SPA", "SRL", "SAS", "AB", "AS", "OY", "KK", "PTY", "PC", "PA", "PLLC", "DBA", "THE", "AND", "OF",
)
# Words that many practices share and that don't tell businesses apart.
COMMON_WORDS = (
    "HEALTH", "HEALTHCARE", "MEDICAL", "MEDICINE", "CENTER", "CENTRE", "CENTERS", "CARE", "CLINIC", "CLINICS", "HOSPITAL", "HOSPITALS", "SERVICES", "SERVICE", "GROUP", "ASSOCIATES", "ASSOCIATION", "PHYSICIANS", "PHYSICIAN", "FAMILY", "PRACTICE", "DENTAL", "DENTISTRY",
    "PHARMACY", "HOME", "NURSING", "REHABILITATION", "REHAB", "THERAPY", "PHYSICAL", "URGENT", "OFFICE", "OFFICES", "INSTITUTE", "SYSTEM", "SYSTEMS", "NETWORK", "COMMUNITY", "PROFESSIONAL", "PROFESSIONALS", "SPECIALISTS", "SPECIALTY", "PARTNERS", "SOLUTIONS", "MANAGEMENT",
    "AMERICA", "AMERICAN", "NATIONAL", "UNITED", "REGIONAL", "COUNTY", "CITY", "NORTH", "SOUTH", "EAST", "WEST", "CENTRAL", "NEW", "LIVING", "SENIOR", "LAB", "LABS", "LABORATORY", "LABORATORIES", "IMAGING", "DIAGNOSTIC", "DIAGNOSTICS", "SURGERY", "SURGICAL", "PEDIATRICS",
    "PEDIATRIC", "CHIROPRACTIC", "OPTOMETRY", "EYE", "VISION", "WELLNESS", "BEHAVIORAL", "MENTAL", "COUNSELING", "HOSPICE", "AGENCY", "SUPPLY", "SUPPLIES", "EQUIPMENT", "DRUG", "DRUGS", "STORE", "DR", "DDS", "MD", "DMD", "OD", "DC", "DO", "PT", "INC", "PLLC",
)


def trimmed(c: Column) -> Column:
    """The trimmed text; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def mdy_date(c: Column) -> Column:
    """A MM/DD/YYYY date; anything else is null."""
    return F.try_to_timestamp(trimmed(c), F.lit("MM/dd/yyyy")).cast("date")


def ymd_date(c: Column) -> Column:
    """A YYYYMMDD date; anything else, 00000000 too, is null."""
    return F.when(F.rlike(trimmed(c), F.lit(r"^\d{8}$")), F.try_to_timestamp(trimmed(c), F.lit("yyyyMMdd")).cast("date"))


def flexible_date(c: Column) -> Column:
    """ISO, US or compact."""
    return F.coalesce(F.try_to_timestamp(trimmed(c), F.lit("yyyy-MM-dd")).cast("date"), mdy_date(c), ymd_date(c))


def yes_no(c: Column) -> Column:
    """Y/YES/TRUE/1 and N/NO/FALSE/0 in any case; anything else is null."""
    v = F.upper(F.trim(c))
    return F.when(v.isin("Y", "YES", "TRUE", "1"), True).when(v.isin("N", "NO", "FALSE", "0"), False)


def whole_number(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "").try_cast("long")


def number(c: Column) -> Column:
    """A number with thousands separators, currency or percent signs left out; anything else is null."""
    return F.regexp_replace(F.trim(c), r"[,$%]", "").try_cast("double")


def check_digit_ok(npi: Column) -> Column:
    """Ten digits that pass Luhn with the 80840 prefix."""
    return F.coalesce(F.rlike(npi, F.lit(r"^\d{10}$")) & F.call_function("luhn_check", F.concat(F.lit("80840"), npi)), F.lit(False))


def registry_id(c: Column) -> Column:
    """A ten-digit identifier; zeros only, or anything else, is null."""
    v = F.trim(c)
    return F.when(F.rlike(v, F.lit(r"^\d{10}$")) & (v != "0000000000"), v)


def zip5(postal: Column, country: Column) -> Column:
    d = F.regexp_replace(postal, r"\D", "")
    return F.when((F.coalesce(F.trim(country), F.lit("")).isin("", "US")) & F.length(d).isin(5, 9), F.left(d, F.lit(5)))


def zip4(postal: Column, country: Column) -> Column:
    d = F.regexp_replace(postal, r"\D", "")
    return F.when((F.coalesce(F.trim(country), F.lit("")).isin("", "US")) & (F.length(d) == 9), F.right(d, F.lit(4)))


def fold(c: Column) -> Column:
    """Without accents, in lower case."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def normalised(c: Column) -> Column:
    """Folded, & as and, other signs as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), "&", " and "), r"[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalised(c), " "), lambda w: w != "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_words(c: Column) -> Column:
    """Sorted distinct words of a company name, upper case and without accents, without legal words and single letters.

    A state of incorporation behind a last slash goes; apostrophes join, all other signs part words.
    """
    plain = F.upper(F.translate(F.regexp_replace(c, r"\s*/\s*[A-Za-z]{2,3}\s*$", ""), ACCENTED, PLAIN))
    words = F.split(F.regexp_replace(F.regexp_replace(plain, "['’]", ""), r"[^\p{L}\p{Nd}]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*LEGAL_WORDS))))


def name_key(c: Column) -> Column:
    """The words of a company name as one key, 255 characters at most; null where fewer than three characters are left."""
    key = F.array_join(name_words(c), " ")
    return F.when(F.length(key) >= 3, F.left(key, F.lit(255)))


def letters_key(c: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "[^A-Za-z0-9]", ""))


def phonetic_key(c: Column) -> Column:
    """The original Soundex: vowels, H, W and Y go first, then repeated codes; four characters. Text without letters gives ''."""
    letters = F.regexp_replace(F.upper(F.translate(c, ACCENTED, PLAIN)), "[^A-Z]", "")
    consonants = F.concat(F.left(letters, F.lit(1)), F.regexp_replace(F.substring(letters, 2, 1000), "[AEIOUYHW]", ""))
    codes = F.translate(consonants, "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    codes = F.regexp_replace(codes, r"(\d)\1+", "$1")
    # The first letter's own code is dropped from the digits behind it.
    first = F.translate(F.left(letters, F.lit(1)), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    rest = F.when(F.left(codes, F.lit(1)) == first, F.substring(codes, 2, 1000)).otherwise(codes)
    rest = F.regexp_replace(rest, r"[A-Z]", "")
    return F.when(letters == "", F.lit("")).otherwise(F.rpad(F.left(F.concat(F.left(letters, F.lit(1)), rest), F.lit(4)), 4, "0"))


def name_distance(a: Column, b: Column) -> Column:
    """Positions that differ, plus twice the difference in length, plus twice the letters of ``a`` missing from ``b``; at most 20."""
    x, y = F.upper(F.translate(a, ACCENTED, PLAIN)), F.upper(F.translate(b, ACCENTED, PLAIN))
    shorter = F.least(F.length(x), F.length(y))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    differ = F.size(F.filter(places, lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1))))
    missing = F.size(F.filter(F.array_distinct(F.split(x, "")), lambda ch: (ch != "") & (F.instr(y, ch) == 0)))
    return F.least(differ + 2 * F.abs(F.length(x) - F.length(y)) + 2 * missing, F.lit(20))


def distinctive_words(c: Column) -> Column:
    """The words of a company name key that few others share; none where there is no key."""
    words = F.filter(F.split(name_key(c), " "), lambda w: ~w.isin(*COMMON_WORDS))
    return F.coalesce(words, F.array().cast("array<string>"))


def shared_word_match(a: Column, b: Column) -> Column:
    """The same business: at least one shared distinctive word, and at least half of the shorter name's."""
    x, y = distinctive_words(a), distinctive_words(b)
    shared = F.size(F.array_intersect(x, y))
    return (shared >= 1) & (2 * shared >= F.least(F.size(x), F.size(y)))


def license_keys(c: Column) -> tuple[Column, Column]:
    """A licence number's two keys without leading zeros: all its digits, and its last run of digits; null without digits but zeros."""
    every = F.nullif(F.ltrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), F.lit("0")), F.lit(""))
    last = F.nullif(F.ltrim(F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9]+)[^0-9]*$", 1), F.lit("0")), F.lit(""))
    return every, last


def same_person(last: Column, other_last: Column, other_full: Column) -> Column:
    """Equal last names or first words of them; without a last name there, the last name as whole words of the full name."""
    def first(x):
        return F.substring_index(x, " ", 1)

    whole = F.contains(F.concat(F.lit(" "), F.replace(other_full, F.lit(","), F.lit(" ")), F.lit(" ")), F.concat(F.lit(" "), last, F.lit(" ")))
    return F.coalesce(F.when(other_last.isNotNull(), (last == other_last) | (first(last) == first(other_last))).otherwise(whole), F.lit(False))


def facility_key(c: Column) -> Column:
    """A facility's number, upper case; a hospital unit's, with a letter in the third place, as its hospital's."""
    v = F.upper(F.trim(c))
    unit = F.rlike(v, F.lit("^[0-9]{2}[STUWYMRZ][0-9]{3}$"))
    digit = F.when(F.substring(v, 3, 1).isin("M", "R", "Z"), "1").otherwise("0")  # units of a critical access hospital, of any other
    return F.when(unit, F.concat(F.left(v, F.lit(2)), digit, F.right(v, F.lit(3)))).otherwise(v)


def pad_key(c: Column, width: int = 10) -> Column:
    return F.lpad(F.trim(c), width, "0")


def ndc_key(c: Column) -> Column:
    """Labeler and product of a hyphenated code, padded to 5 and 4; of eleven digits, the first nine."""
    parts = F.split(c, "-")
    return F.when(F.rlike(c, F.lit(r"^\d{11}$")), F.left(c, F.lit(9))).when(F.size(parts) >= 2, F.concat(F.lpad(parts[0], 5, "0"), F.lpad(F.get(parts, F.lit(1)), 4, "0")))
