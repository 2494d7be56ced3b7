"""Text rules as built-in expressions, Unicode aware."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import constants as C

# i: ignore case, U: Unicode classes, boundaries and case, d: "." stops at \n only
FLAGS = "(?iUd)"
# str.split() whitespace is White_Space plus the four separators \x1c-\x1f
SPACE = r"[\s\x1c-\x1f]"
ODD_CASE = ["\u017f", "\u0131", "\u0130", "\u212a"]
NOT_SPACE = r"[^\s\x1c-\x1f]"


def matches(text: Column, pattern: str) -> Column:
    """Does the pattern occur anywhere; a NULL text does not match."""
    return F.coalesce(text.rlike(FLAGS + pattern), F.lit(False))


def matches_any(text: Column, patterns) -> Column:
    return reduce(or_, [matches(text, p) for p in patterns])


def gated(text: Column, needles, test: Column) -> Column:
    """Run a costly case-blind test only on texts that hold one of the needles.

    Letters that are not ASCII but equal an ASCII letter when case is ignored
    would slip past the plain search, so texts with one are tested as well.
    """
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in ODD_CASE])
    return F.when(contains_any(text, needles) | F.coalesce(odd, F.lit(False)), test).otherwise(
        False)


def contains_any(text: Column, words) -> Column:
    """Plain substring search in the lower-cased text."""
    low = F.lower(text)
    return F.coalesce(reduce(or_, [F.contains(low, F.lit(w)) for w in words]), F.lit(False))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?U){NOT_SPACE}+"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def preview(text: Column, chars: int = C.PREVIEW_CHARS) -> Column:
    return F.concat(F.substring(text, 1, chars),
                    F.when(F.length(text) > chars, "...").otherwise(""))


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one digit, ties to even; 0.0 of nothing is 0.0."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))
