"""Text expressions: tokens, terms, line numbers, paths. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's filler words, which full-text fallbacks leave out.
STOPWORDS = (
    "about also and are but can code does document documents explain file files find for from how i in is it me of on or related "
    "show the this to what where which why with"
).split()
PATH_STOPWORDS = [*STOPWORDS, "path", "paths", "src"]
# Words that aren't concepts.
CONCEPT_STOPWORDS = "the and for with from this that return true false none null import export class function const let var async await".split()

TOKEN = r"[\p{L}\p{N}_]+"
TERM = r"[a-z0-9_]{3,64}"
PATH_TERM = r"[a-z0-9][a-z0-9_.\\-]{1,63}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,63}"
HASHED = r"[a-z_][a-z0-9_]{1,63}"


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words of any script, in order."""
    return find_all(F.lower(text), TOKEN)


def terms(text: Column, most: int, pattern: str = TERM, stopwords: list[str] = STOPWORDS) -> Column:
    """The first distinct terms that aren't filler words."""
    found = F.array_distinct(find_all(F.lower(text), pattern))
    return F.slice(F.filter(found, lambda t: ~t.isin(stopwords)), 1, most)


def line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def normal_path(path: Column) -> Column:
    return F.trim(F.replace(F.lower(path), F.lit("\\"), F.lit("/")))


def path_matches(actual: Column, expected: Column) -> Column:
    """Paths match if one holds the other's expected form; empty paths match nothing."""
    a, e = normal_path(actual), normal_path(expected)
    return (a != "") & (e != "") & F.contains(a, e)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("int")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
