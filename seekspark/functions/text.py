"""Text expressions: bodies, tokens, hashes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classic English list of search engines (fixed values).
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with"
).split()
#: Words of two characters at least, of letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def body(title: Column, text: Column) -> Column:
    """Title and text on lines of their own, or the one that is not empty."""
    return F.concat_ws("\n", F.nullif(strip(title), F.lit("")), F.nullif(strip(text), F.lit("")))


def tokens(c: Column, stopwords: list[str] | None = STOPWORDS) -> Column:
    every = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(every, lambda t: ~t.isin(stopwords)) if stopwords else every


def token_set(c: Column) -> Column:
    """The different words between white space, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda t: t != ""))


def text_hash(title: Column, text: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n"), text), 256)


def safe_slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def measure_name(c: Column) -> Column:
    """ndcg_cut_10 to ndcg_cut.10."""
    return F.regexp_replace(c, "_([0-9]+)$", ".$1")


def field_name(c: Column) -> Column:
    """ndcg_cut.10 to ndcg_cut_10."""
    return F.regexp_replace(c, r"\.([0-9]+)$", "_$1")


def safe_float(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))
