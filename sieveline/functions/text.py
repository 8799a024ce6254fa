"""Scalar functions over strings, as native columns."""

from __future__ import annotations

import string
import sys
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def strip(c: Column) -> Column:
    """Python's str.strip(): all its white space, not only spaces."""
    return F.btrim(c, F.lit(V.WHITE_SPACE))


@cache
def folds() -> tuple[str, str, dict[str, str]]:
    """Unicode's full case folding by its definition in Python: characters that fold to one, what these fold to, and those that
    fold to several."""
    changed = {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if c.casefold() != c}
    one = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in changed.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    """str.casefold() in built-in functions; the table is only met by strings beyond ASCII, its rare part by those that need it."""
    plain, to, several = folds()
    ascii_lower = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    some = F.translate(ascii_lower, plain, to)
    long = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), several.items(), some)
    return F.when(~c.rlike(r"[^\x00-\x7F]"), ascii_lower).when(c.rlike("[" + "".join(several) + "]"), long).otherwise(some)


def folded(c: Column, unicode: bool = True) -> Column:
    """Case folding; ``unicode=False`` is exact for ASCII and simpler."""
    return casefold(c) if unicode else F.lower(c)


def normalise_identifier(c: Column, case_insensitive: bool = False, unicode: bool = True) -> Column:
    """Stripped, perhaps case-folded; empty becomes null."""
    stripped = F.nullif(strip(c), F.lit(""))
    return folded(stripped, unicode) if case_insensitive else stripped


def near_duplicate_key(c: Column, unicode: bool = True) -> Column:
    """What identifiers share that differ only in case, hyphens and underscores."""
    return F.regexp_replace(folded(c, unicode), "[-_]", "")


def connectivity(key: Column) -> Column:
    """The first block of a structure key: the skeleton without stereochemistry."""
    return F.substring_index(key, "-", 1)


def has_embedded_control_characters(raw: Column) -> Column:
    return strip(raw).rlike(V.CONTROL_CHARACTERS)


def is_placeholder(stripped: Column) -> Column:
    return F.lower(stripped).isin(V.PLACEHOLDERS) | stripped.rlike(V.FILLER_ONLY) | stripped.rlike(V.BRACKETED_NAME) | ~stripped.rlike(V.ATOM_LETTER)


def looks_truncated(stripped: Column) -> Column:
    more = lambda a, b: F.length(F.replace(stripped, F.lit(b), F.lit(""))) > F.length(F.replace(stripped, F.lit(a), F.lit("")))
    return F.substring(stripped, -1, 1).isin(V.DANGLING_ENDS) | more("(", ")") | more("[", "]")


def parse_failure_category(raw: Column, message: Column) -> Column:
    """The likeliest cause of a parse failure: what the string shows first, then what the parser said."""
    raw = F.coalesce(raw, F.lit(""))
    s, said = strip(raw), F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(s == "", "empty")
        .when(has_embedded_control_characters(raw), "control_characters")
        .when(F.length(raw).isin(V.TRUNCATION_LENGTHS), "truncated")
        .when(is_placeholder(s), "placeholder")
        .when(s.rlike(V.MARKUSH), "markush")
        .when(s.rlike(V.STOICHIOMETRY), "stoichiometry_text")
        .when(said.contains("valence"), "valence")
        .when(said.contains("kekulize"), "kekulisation")
        .when(said.contains("ring") & (said.contains("unclosed") | said.contains("closure")), "ring_closure")
        .when(looks_truncated(s), "truncated")
        .otherwise("other")
    )
