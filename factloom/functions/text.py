"""Addresses, literals and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host of an address; NULL where it names none."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit(""))


def path(url: Column) -> Column:
    """The path of an address without scheme, host, query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_pairs(url: Column) -> Column:
    """The (name, value) pairs of an address's query in order; a name without a value has ''."""
    parts = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("value")))


def query_value(url: Column, name: str) -> Column:
    """The first value of a name in an address's query; NULL where there is none or it is empty."""
    found = F.get(F.filter(query_pairs(url), lambda p: p["name"] == name), F.lit(0))
    return F.nullif(found["value"], F.lit(""))


def integer(text: Column) -> Column:
    """The value of an integer literal: decimal, 0x, 0o or 0b, with '_' between digits and a length suffix; NULL for other
    texts and values beyond 64 bits."""
    core = F.regexp_replace(F.lower(F.replace(text, F.lit("_"), F.lit(""))), r"(?<=[0-9a-f])(ull|llu|ul|lu|ll|u|l)$", "")
    digits = lambda pattern: F.nullif(F.regexp_extract(core, pattern, 1), F.lit(""))
    based = lambda pattern, base, longest: F.when(F.length(digits(pattern)) <= longest, F.conv(digits(pattern), base, 10).try_cast("long"))
    return F.coalesce(based(r"^0x0*([0-9a-f]+)$", 16, 16), based(r"^0b0*([01]+)$", 2, 63), based(r"^0o?0*([0-7]+)$", 8, 20), digits(r"^([0-9]+)$").try_cast("long"))


def digest(content: Column) -> Column:
    """The content hash by which files are told apart."""
    return F.sha2(content.cast("binary"), 256)
