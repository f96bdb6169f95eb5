"""Column expressions for cleaning and naming signals. All stay in codegen."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrade import settings


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_space(c: Column) -> Column:
    """Drop leading and trailing whitespace of any kind (``trim`` drops spaces only)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def clean_count(c: Column) -> Column:
    """Count text to int: keep digits and ``-``; null or unreadable becomes 0."""
    text = c.cast("string")
    # most texts are a number as they are; only the others are rewritten
    kept = F.when(text.rlike("^[0-9]{1,9}$"), text).otherwise(F.regexp_replace(text, "[^0-9-]", ""))
    return F.coalesce(kept.try_cast("int"), F.lit(0))


def clean_name(c: Column) -> Column:
    """One space between words, none around; blank becomes null; case is kept."""
    return _blank_to_null(F.trim(F.regexp_replace(c, r"\s+", " ")))


def name_key(c: Column) -> Column:
    """Case-insensitive key of a name."""
    return F.lower(clean_name(c))


def clean_domain(c: Column) -> Column:
    """Lower case, no surrounding whitespace, no trailing dots; blank becomes null."""
    return _blank_to_null(F.rtrim(F.lower(strip_space(c)), F.lit(".")))


def drop_wildcard(c: Column) -> Column:
    """A certificate name without its leading ``*.`` label."""
    return F.when(c.startswith("*."), F.substring(c, 3, 1 << 30)).otherwise(c)


def parse_flag(c: Column) -> Column:
    """``"true"`` in any case or padding is true, other text false, null stays null."""
    return F.lower(F.trim(c.cast("string"))) == "true"


def parse_day(c: Column) -> Column:
    """ISO timestamp text to its UTC date; unreadable text becomes null."""
    return F.to_date(F.try_to_timestamp(c, F.lit(settings.TIMESTAMP_FORMAT)))


def parse_id(c: Column) -> Column:
    return c.try_cast("bigint")


def urls_specified(prefix: str = "") -> Column:
    """Sum of the four outcome buckets, in bigint."""
    return reduce(add, (F.col(f"{prefix}{c}").cast("bigint") for c in settings.URL_COUNTS))


def removal_rate(removed: Column, specified: Column) -> Column:
    """``removed / specified`` held to [0, 1]; null unless something was specified."""
    share = F.coalesce(removed, F.lit(0)).cast("double") / specified
    return F.when(specified > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def share_or_zero(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where the whole is zero or either is null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


# ---- naming signals -------------------------------------------------------------


def token_count(domain: Column, tokens: Iterable[str] = settings.SUSPICIOUS_TOKENS) -> Column:
    """Number of distinct tokens that are substrings; ``sports`` also counts ``sport``."""
    return reduce(add, (domain.contains(t).cast("int") for t in tokens))


def has_token(domain: Column, tokens: Iterable[str] = settings.SUSPICIOUS_TOKENS) -> Column:
    """True if any token is a substring (not a word) of the domain."""
    return reduce(lambda a, b: a | b, (domain.contains(t) for t in tokens))


def public_suffix(domain: Column, suffixes: Iterable[str] = settings.PUBLIC_SUFFIXES) -> Column:
    """Longest registered suffix that ends the domain at a label border, "" if none.

    A rule ``*.x`` stands for x with any one label before it, ``!a.x`` takes a.x out of it
    again and leaves x. The list is a parameter of the plan, so each label count is one
    hash-set test and no join is needed.
    """
    plain, any_label, excepted = {}, {}, {}
    for rule in suffixes:
        kind = excepted if rule.startswith("!") else any_label if rule.startswith("*.") else plain
        kind.setdefault(rule.count(".") + 1, []).append(rule.removeprefix("!").removeprefix("*."))
    labels = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit(""))) + 1
    found = F.lit("")
    for n in sorted({*plain, *any_label}):
        tail = F.substring_index(domain, ".", -n)
        if n in plain:
            found = F.when(tail.isin(plain[n]), tail).otherwise(found)
        if n in any_label:
            held = F.substring_index(domain, ".", 1 - n).isin(any_label[n]) & (labels >= n) & ~tail.startswith(".")
            found = F.when(held, tail).otherwise(found)
    for n, names in sorted(excepted.items()):
        is_one = F.substring_index(domain, ".", -n).isin(names)
        found = F.when(is_one, F.substring_index(domain, ".", 1 - n)).otherwise(found)
    return found


def last_label(domain: Column) -> Column:
    """Trailing ``.letters`` of the domain, "other" if there is none."""
    return F.coalesce(
        _blank_to_null(F.regexp_extract(domain, r"\.([a-z]{2,})$", 1)), F.lit("other")
    )


def digit_ratio(domain: Column) -> Column:
    """Share of characters that are digits, 0.0 for an empty name."""
    length = F.length(domain)
    digits = length - F.length(F.translate(domain, "0123456789", ""))
    return F.when(length > 0, digits.cast("double") / length).otherwise(F.lit(0.0))


def hyphen_count(domain: Column) -> Column:
    return F.length(domain) - F.length(F.replace(domain, F.lit("-"), F.lit("")))
