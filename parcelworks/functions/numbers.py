"""Functions on parcel numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelworks.functions.bind import let

#: Fixed values.
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
SUFFIXES = r"(X[(（]\p{Nd}+/\p{Nd}+[)）]|W\p{Nd}+|V\p{Nd}+|-内)+$"
SEPARATORS = "[-－ー]"


def normalize_number(s: Column) -> Column:
    """Full-width digits to ASCII, counters and hyphens deleted, lower case; null stays null."""
    return F.lower(F.translate(s, FULL_DIGITS + "番号の-－ー", DIGITS))


def whole_number(digits: Column) -> Column:
    """A sort key (size, digits) of ASCII digits as a number of any length: without zeros in front, shorter ones come first."""
    return let({"d": F.regexp_replace(digits, "^0+(?=[0-9])", "")}, lambda v: F.struct(F.length(v["d"]).alias("size"), v["d"].alias("digits")))


def natural_key(s: Column) -> Column:
    """Sort key, an array of (class, number, rest): parts that begin with digits come first, by number, whatever its length."""

    def part(p: Column) -> Column:
        numeric = F.struct(F.lit(0).alias("c"), whole_number(p["d"]).alias("n"), F.substring(p["p"], F.length(p["d"]) + 1, F.length(p["p"])).alias("r"))
        other = F.struct(F.lit(1).alias("c"), F.struct(F.lit(1).alias("size"), F.lit("0").alias("digits")).alias("n"), p["p"].alias("r"))
        return F.when(p["d"] != "", numeric).otherwise(other)

    digits = lambda p: F.regexp_extract(F.translate(p, FULL_DIGITS, DIGITS), r"^([0-9]+)", 1)
    parts = F.transform(F.split(F.coalesce(s, F.lit("")), SEPARATORS), lambda p: F.struct(p.alias("p"), digits(p).alias("d")))
    return F.transform(parts, part)


def strip_suffixes(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), SUFFIXES, "")


def parent_of(s: Column) -> Column:
    """Text before the first hyphen once suffixes are gone; null counts as empty."""
    return F.element_at(F.split(strip_suffixes(s), "-", 2), 1)


def branch_of(s: Column) -> Column:
    """Text after the first hyphen once suffixes are gone, or empty."""
    return F.coalesce(F.get(F.split(strip_suffixes(s), "-", 2), F.lit(1)), F.lit(""))


def joined_number(parent: Column, branch: Column) -> Column:
    return F.when(branch != "", F.concat(parent, F.lit("-"), branch)).otherwise(parent)


def match_level(parent: Column, branch: Column, other_parent: Column, other_branch: Column) -> Column:
    """exact, parent, near (equal length and all but the last character), or null."""
    size = F.length(parent)
    near = (size == F.length(other_parent)) & (size > 0) & (F.substring(parent, F.lit(1), size - 1) == F.substring(other_parent, F.lit(1), size - 1))
    return F.when(joined_number(parent, branch) == joined_number(other_parent, other_branch), "exact").when(parent == other_parent, "parent").when(near, "near")


def number_class(s: Column) -> Column:
    """Kind of a number: the fixed special values, numeric, or other."""
    kinds = {"道": "road", "水": "water", "筆界未定地": "undetermined", "無地番": "unnumbered", "地図外": "off-map"}
    out = F.when(s.rlike(r"^\p{Nd}"), "numeric").otherwise("other")
    for text, kind in kinds.items():
        out = F.when(s == text, kind).otherwise(out)
    return out
