"""Column expressions: tiers, guarded ratios, nearest ranks, identifier and prose tests. All stay inside the JVM."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inclusive upper bounds of the tiers low, moderate and high; above is very_high.
TIERS = {
    "cyclomatic": (10, 20, 50),
    "cognitive": (5, 15, 40),
    "wmc": (20, 50, 200),
    "noc": (1, 5, 20),
    "cbo": (4, 9, 20),
    "rfc": (20, 50, 100),
    "nloc": (250, 500, 1000),
    "arity": (4, 6, 10),
}
TIER_NAMES = ("low", "moderate", "high", "very_high")

STOP_WORDS = (
    "all and any are as at be but by can do does else for from here if in into is it its no not of on or so that the their then there this to was we were when where "
    "which will with yes you a an"
).split()


def tier(value: Column, bounds: tuple[int, int, int]) -> Column:
    """0 (low) to 3 (very high); null for a null value."""
    low, moderate, high = bounds
    return F.when(value <= low, 0).when(value <= moderate, 1).when(value <= high, 2).when(value.isNotNull(), 3).cast("int")


def tier_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIER_NAMES)), ordinal + 1)


def histogram(value: Column, bounds: tuple[int, int, int]) -> list[Column]:
    """Four counters, one a tier."""
    at = tier(value, bounds)
    return [F.count_if(at == i).alias(name) for i, name in enumerate(TIER_NAMES)]


def worst_tier(value: Column, bounds: tuple[int, int, int]) -> Column:
    """The name of the highest occupied tier; null over no rows."""
    return tier_name(F.max(tier(value, bounds)))


def nearest_rank(column: str, share: float = 0.95) -> Column:
    """The value of rank ceil(share n), 0 over no rows, as a long."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})"), F.lit(0)).cast("long")


def mean(value: Column) -> Column:
    """The mean, 0 over no rows."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0: the panel's ratios."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def open_ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0: the test proxies' ratios."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def lines(text: Column) -> Column:
    """Lines as an array: split at line feeds, a trailing empty one dropped, carriage returns at line ends stripped."""
    parts = F.split(text, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def content_words(text: Column) -> Column:
    """Distinct lower-cased alphanumeric runs of two bytes or more that are no stop words."""
    words = F.split(F.translate(text, ascii_uppercase, ascii_lowercase), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def overlap_ratio(words: Column, others: Column) -> Column:
    """The share of ``words`` among ``others``; 0 without words."""
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, others)) / F.size(words))


def identifier_words(name: Column) -> Column:
    """Words of an identifier: parts between underscores, each of as many words as it has steps from lower to upper case, plus one."""
    parts = F.filter(F.split(name, "_"), lambda x: x != "")
    return F.aggregate(parts, F.lit(0), lambda a, x: a + 1 + F.regexp_count(x, F.lit(r"\p{Ll}(?=\p{Lu})")))


#: A line with one of these is no prose.
CODE_SIGNS = "=(){}[]:;@%<>/\\|*+~`\""
STATEMENT_WORDS = (
    "and assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
).split()


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def is_code_line(line: Column) -> Column:
    """Neither blank nor a comment."""
    bare = stripped(line)
    return (bare != "") & ~bare.startswith("#")


def is_prose_line(line: Column) -> Column:
    """At least four white-space separated words, no code sign, and no statement's keyword in front."""
    bare = stripped(line)
    words = F.split(bare, r"\s+")
    return (F.translate(bare, CODE_SIGNS, "") == bare) & (F.size(words) >= 4) & ~F.get(words, F.lit(0)).isin(*STATEMENT_WORDS)


def artifact(line: Column) -> Column:
    """What a line is a leftover of: fence (of markdown), conflict (a merge's marker; seven = alone may be an underline), tag (and nothing else); else null."""
    bare = stripped(line)
    return F.when(bare.rlike("^(?:`{3}|~{3})"), "fence").when(bare.rlike(r"^(?:<{7}|>{7}|\|{7})"), "conflict").when(bare.rlike(r"(?s)^<(?:[A-Za-z].*|/.*[A-Za-z].*)>$"), "tag")


def normalise_distribution(name: Column) -> Column:
    """PEP 503: lower-case, runs of -, _ and . as one -."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-"), "^-|-$", "")
