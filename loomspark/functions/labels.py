"""Count labels: numbers as words, nouns in number, and whether a label's count is right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import col, joined_list

#: Number words.
WORDS = ["én", "to", "tre", "fire", "fem", "seks", "syv", "otte", "ni", "ti", "elleve", "tolv"]
#: Nouns and their plurals.
PLURALS = {"borger": "borgere", "høringspart": "høringsparter", "organisation": "organisationer", "respondent": "respondenter", "myndighed": "myndigheder"}


def to_word(n: Column | str) -> Column:
    """1 to 12 in words, other numbers in digits."""
    n = col(n)
    return F.when(n.between(1, len(WORDS)), F.element_at(F.array(*map(F.lit, WORDS)), F.greatest(F.least(n, F.lit(len(WORDS))), F.lit(1)).cast("int"))).otherwise(n.cast("string"))


def with_noun(n: Column | str, noun: str = "borger") -> Column:
    n = col(n)
    return F.concat(F.initcap(to_word(n)), F.lit(" "), F.when(n == 1, noun).otherwise(PLURALS.get(noun, noun + "er")))


def parsed_count(label: Column | str) -> Column:
    """The number that a label begins with, in digits or in words; null for none."""
    label = F.lower(F.trim(col(label)))
    found = F.try_to_number(F.regexp_extract(label, "^([0-9]+)", 1), F.lit("999999999")).cast("int")
    for i, w in enumerate(WORDS, 1):
        found = F.coalesce(found, F.when(label.rlike(f"^{w}(?![A-Za-zæøå])"), i))
    return found


def is_count_label(label: Column | str) -> Column:
    text = F.lower(col(label))
    hit = F.lit(False)
    for noun in PLURALS:
        hit = hit | text.contains(noun)
    return hit


def label_matches(label: Column | str, members: Column) -> Column:
    """Whether a label that counts names as many as there are members; labels that do not count are right."""
    n = parsed_count(label)
    return ~is_count_label(label) | n.isNull() | (n == F.size(members))


def from_members(names: Column, citizens: Column) -> Column:
    """'A, B og tre borgere' from named members and a number of citizens."""
    rest = F.when(citizens > 0, F.concat(to_word(citizens), F.lit(" "), F.when(citizens == 1, "borger").otherwise("borgere")))
    return joined_list(F.array_compact(F.concat(names, F.array(rest))))
