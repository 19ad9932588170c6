"""Ordered decision lists over texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import col


def first_keyword(text: Column | str, classes: dict[str, list[str]], rest: str) -> Column:
    """The first class one of whose words the lower-case text contains."""
    text = F.lower(col(text))
    found = None
    for name, words in classes.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.coalesce(text.contains(w), F.lit(False))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return F.lit(rest) if found is None else found.otherwise(rest)


def all_keywords(text: Column | str, classes: dict[str, list[str]]) -> Column:
    """Every class one of whose words the text contains, in order."""
    text = F.lower(col(text))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    return F.array_compact(F.array(*[F.when(hit(words), name) for name, words in classes.items()]))


def flags(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def title_errors(title: Column) -> Column:
    return flags({"too short": F.length(title) < 15, "colon": title.contains(":"), "truncated": title.endswith("...") | title.endswith("…"), "lower case start": title.rlike("^[a-z]")})


def screen(text: Column | str, short: int, reference: str) -> Column:
    """no-opinion for empty texts, then short, references, analyze."""
    text = col(text)
    return F.when(text.isNull() | (F.trim(text) == ""), "no-opinion").when(F.length(text) < short, "short").when(F.lower(text).rlike(reference), "references").otherwise("analyze")


def scope(section: Column, theme: Column, concept: Column, examples: Column, limits: Column) -> dict[str, Column]:
    """in_scope, confidence and reason of an argument: a section named, its theme, a concept, examples of what is out of
    scope (surer with their number), two limits; else uncertain."""
    reason = F.when(section, "section").when(theme, "theme").when(concept, "concept").when(examples > 0, "example").when(limits >= 2, "limits").otherwise("uncertain")
    confidence = (
        F.when(reason == "section", 0.95).when(reason == "theme", 0.9).when(reason == "concept", 0.8)
        .when(reason == "example", F.least(0.5 + 0.15 * examples, F.lit(0.95))).when(reason == "limits", 0.7).otherwise(0.5)
    )
    return {"in_scope": ~reason.isin("example", "limits"), "confidence": confidence, "reason": reason}


def direction(value: Column | str) -> Column:
    """support, against or neutral, from the names that stages use for them."""
    value = F.lower(F.trim(col(value)))
    return F.when(value.isin("support", "pro", "pro_change", "for", "yes"), "support").when(value.isin("against", "contra", "oppose", "pro_status_quo", "no"), "against").otherwise("neutral")


def may_merge(a: Column, b: Column, size: Column | None = None, most: int = 50) -> Column:
    """Only equal directions merge, and only to groups of at most ``most`` members."""
    same = direction(a) == direction(b)
    return same if size is None else same & (size <= most)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cluster_count(n: Column, diversity: Column, direction_factor: Column, substance: Column) -> Column:
    """How many clusters for n arguments: grows with the root of n, between n / 150 (3 at least) and n / 20 (60 at most)."""
    wanted = F.ceil(F.sqrt(n) * 1.2 * diversity * direction_factor * substance)
    return F.greatest(F.least(wanted, F.least(F.lit(60), F.ceil(n / 20))), F.greatest(F.lit(3), F.ceil(n / 150))).cast("int")


def dynamic_threshold(mean_size: Column, distinct: Column, base: float = 0.85) -> Column:
    """The base, lower for large groups and for many respondents, 0.70 at least."""
    by_size = F.greatest(F.lit(0.0), F.least(F.lit(0.08), (mean_size - 5) * 0.01))
    by_number = F.greatest(F.lit(0.0), F.least(F.lit(0.03), (distinct - 50) * 0.0005))
    return F.greatest(F.lit(0.70), base - by_size - by_number)
