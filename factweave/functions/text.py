"""Text functions of retrieval and normalisation, all ASCII-only on purpose."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words dropped from a query while others remain.
COMMON_TERMS = (
    "a", "all", "an", "and", "are", "as", "at", "be", "by", "for", "from", "i",
    "in", "into", "is", "it", "of", "on", "or", "that", "the", "to", "with",
)
MOST_TERMS = 16


def fold(col: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(col, UPPER, LOWER)


def query_terms(query: str) -> list[str]:
    """Unique folded terms of a query, common ones dropped if any other is left."""
    folded = query.translate(str.maketrans(UPPER, LOWER))
    terms = list(dict.fromkeys(t for t in re.split("[^A-Za-z0-9]+", folded) if t))[:MOST_TERMS]
    rare = [t for t in terms if t not in COMMON_TERMS]
    return rare or terms


def tokens(col: Column) -> Column:
    """Folded parts between camel humps and anything not alphanumeric."""
    parts = F.split(col, r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+", -1)
    return F.transform(F.filter(parts, lambda p: p != ""), fold)


def match_strength(field: Column, term: str) -> Column:
    """How well a field matches a term, 0 to 120; the best of its tokens."""
    low = fold(field)
    initials = F.array_join(F.transform(F.filter(F.split(field, r"(?=[A-Z])", -1), lambda p: p != ""), lambda p: fold(F.substring(p, 1, 1))), "")
    bound = 2 if len(term) >= 8 else 1
    loose = "(?s)^" + ".*".join(term) + ".*$"

    def strength(token: Column) -> Column:
        size = F.length(token)
        near = F.levenshtein(token, F.lit(term), bound)
        out = F.when(token == term, 100).when(token.startswith(term), 72)
        if len(term) >= 3:
            out = out.when(F.contains(token, F.lit(term)), 48)
        edits = F.lit(0)
        if len(term) >= 4:
            edits = F.when((size >= 3) & (near == 1), 32)
            edits = edits.when((size >= 3) & (near == 2), 16).otherwise(0) if bound == 2 else edits.otherwise(0)
        abbreviated = F.when(token.rlike(loose) & (size <= 3 * len(term)) & (size > len(term)), 28).otherwise(0) if len(term) >= 4 else F.lit(0)
        return out.otherwise(F.greatest(edits, abbreviated))

    best = F.coalesce(F.array_max(F.transform(tokens(field), strength)), F.lit(0))
    acronym = F.when((F.length(initials) >= 2) & (initials == term) & (F.length(field) > len(term)), 40).otherwise(0)
    whole = F.when(F.contains(low, F.lit(term)), 44).otherwise(0) if len(term) >= 3 else F.lit(0)
    return F.when(field.isNull() | (field == ""), 0).when(low == term, 120).otherwise(F.greatest(best, acronym, whole))


def strip_affixes(col: Column, prefix: str = "", suffix: str = "") -> Column:
    out = col
    if prefix:
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    if suffix:
        out = F.when(out.endswith(suffix), out.substr(F.lit(1), F.length(out) - len(suffix))).otherwise(out)
    return out


def snake_case(col: Column) -> Column:
    """ASCII snake case; other characters raise, as their case is not defined here."""
    humps = F.regexp_replace(F.regexp_replace(col, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")
    return F.when(col.rlike(r"^\p{ASCII}*$"), fold(humps)).otherwise(F.raise_error(F.lit("not ASCII")))


def leaf(col: Column) -> Column:
    return F.substring_index(col, ".", -1)


def top_area(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def package_name(col: Column, manager: str) -> Column:
    """Comparable package names: Python joins runs of ``-_.``; others fold case only."""
    return F.regexp_replace(fold(col), "[-_.]+", "-") if manager == "python" else fold(col)
