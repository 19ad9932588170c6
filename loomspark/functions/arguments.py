"""Texts made from an argument's fields, and rules on single respondents; fields may be null or empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a respondent's type that make it more than a citizen.
ENTITIES = ["lokal", "myndighed", "organisation", "virksomhed", "forening"]
#: Letters with marks, and the letters that are left of them.
MARKED, UNMARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def embedding_text(*fields: Column) -> Column:
    """What is embedded of an item: its fields that are there, parted by dashes."""
    return F.concat_ws(" - ", *map(_some, fields))


def argument_key(what: Column, why: Column, concern: Column) -> Column:
    """What tells arguments with the same content: their fields in lower case."""
    return F.lower(F.concat_ws(" | ", _some(what), _some(why), _some(concern)))


def char_count(*fields: Column) -> Column:
    """Characters of an argument's fields together."""
    return sum((F.coalesce(F.length(f), F.lit(0)) for f in fields[1:]), F.coalesce(F.length(fields[0]), F.lit(0)))


def folded(text: Column) -> Column:
    """Lower case, single-spaced, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """About how many tokens a text has."""
    return F.ceil(F.length(text) / 4)


def built_title(*fields: Column) -> Column:
    """The first field that is there, trimmed, first letter upper; a default else."""
    first = F.trim(F.coalesce(*map(_some, fields), F.lit("Holdning")))
    return F.concat(F.upper(F.substring(first, 1, 1)), F.substr(first, F.lit(2)))


def is_named_entity(name: Column, kind: Column) -> Column:
    """Whether a respondent has a name, or is of a type other than a citizen."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return (F.length(F.trim(F.coalesce(name, F.lit("")))) > 0) | F.exists(F.array(*map(F.lit, ENTITIES)), lambda e: kind.contains(e))


def search_words(title: Column) -> Column:
    """Words of a title for the index: lower case, marks off, all but ASCII letters and digits parts them."""
    plain = F.regexp_replace(F.translate(F.lower(title), MARKED, UNMARKED), "[^a-z0-9 ]", " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def known_refs(refs: Column, known: Column) -> Column:
    """References that exist, each once, in order."""
    return F.array_intersect(refs, known)
