"""Lints from the writing rules: one boolean column each, true where the rule is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.vocab import FORBIDDEN_PHRASES, HEAVY, TYPICALLY_EMPTY

# Formats of identifiers.
ACCOUNT_ID = r"^001[0-9A-Za-z]{15}$"
CUSTOMER_ID = r"^[1-9]\d{3,5}$"
CASE_NUMBER = r"^\d{8}$"
EMAIL = r"^[^@\s.]+\.[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
QUOTE_ID = r"^[A-Z]+-?\d{8}-?\d{3}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
TYPO_QUARTER = r"Q[1-4]\d{4,}"
QUARTER = r"^Q[1-4]20\d{2}$"

account_id = lambda x: x.rlike(ACCOUNT_ID)
customer_id = lambda x: x.rlike(CUSTOMER_ID)
case_number = lambda x: x.rlike(CASE_NUMBER)
email = lambda x: x.rlike(EMAIL)
quote_id = lambda x: x.rlike(QUOTE_ID)
iso_time = lambda x: x.rlike(ISO_TIME)


def snippet_fits(x: Column, most: int = 200) -> Column:
    return F.length(x) <= most


def no_forbidden_phrase(x: Column, phrases: tuple = FORBIDDEN_PHRASES) -> Column:
    return ~F.lower(x).rlike("|".join(phrases))


def specific_ref(x: Column) -> Column:
    """Not a mere name of a system."""
    return ~F.lower(F.trim(x)).isin("sf data", "sf", "crm", "crm data", "salesforce", "data", "internal", "source")


def concrete_topic(x: Column) -> Column:
    """Not a placeholder in brackets."""
    return ~F.trim(x).rlike(r"^\[.*\]$")


def messy_amount(x: Column) -> Column:
    """Not a multiple of 10,000."""
    return (x % 10_000) != 0


def count_between(n: Column, low: int, high: int) -> Column:
    return n.between(low, high)


def plain_quarter(name: Column) -> Column:
    """No quarter with a mistyped year in an opportunity's name."""
    found = F.regexp_extract(name, TYPO_QUARTER, 0)
    return (found == "") | found.rlike(QUARTER)


def latin(x: Column) -> Column:
    """No letter outside the Latin script."""
    return ~x.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def only_known(x: Column, known: list[str], all_names: list[str]) -> Column:
    """No name of a list is mentioned unless it is among the known ones."""
    out = F.lit(True)
    for name in all_names:
        if name not in known:
            out = out & ~F.lower(x).contains(name.lower())
    return out


def no_url(x: Column) -> Column:
    return ~x.rlike(r"https?://")


def emphasis_gaps(surface: Column, filled: Column) -> Column:
    """Sections that the surface populates heavily and that are not among ``filled``, by name; NULL for unknown surfaces."""
    heavy = F.create_map(*[c for name, sections in HEAVY.items() for c in (F.lit(name), F.array(*[F.lit(s) for s in sorted(sections)]))])
    return F.array_except(F.try_element_at(heavy, surface), filled)


def emphasis(surface: Column, filled: Column) -> Column:
    """All sections that the surface populates heavily are among ``filled``."""
    return F.size(emphasis_gaps(surface, filled)) == 0


def honest_empty(surface: Column, filled: Column) -> Column:
    """None of the sections that the surface typically leaves empty is among ``filled``."""
    out = F.lit(None).cast("boolean")
    for name, sections in TYPICALLY_EMPTY.items():
        out = F.when(surface == name, ~F.arrays_overlap(F.array(*[F.lit(s) for s in sections]), filled)).otherwise(out)
    return out


# Spellings of countries.
COUNTRIES = {"usa": "United States", "us": "United States", "u.s.": "United States", "united states of america": "United States", "uk": "United Kingdom",
             "great britain": "United Kingdom", "prc": "China", "p.r. china": "China", "korea": "South Korea", "republic of korea": "South Korea"}


def country(x: Column) -> Column:
    out = F.trim(x)
    for spelling, name in COUNTRIES.items():
        out = F.when(F.lower(F.trim(x)) == spelling, name).otherwise(out)
    return out


def near_names(a: Column, b: Column, most: int = 2) -> Column:
    """Different names that sound alike or differ by few letters."""
    return (a != b) & ((F.soundex(a) == F.soundex(b)) | (F.levenshtein(a, b) <= most))
