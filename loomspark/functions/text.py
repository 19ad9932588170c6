"""Text functions as Column expressions: no Python runs per row.

Words are runs of ASCII word characters and æ, ø, å, as in the texts this engine was made for; other accented letters
part words. Null text gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as a double; ``empty`` where b is zero."""
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b.cast("double"))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once: an expression named in a lambda is worked out for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokenize(text: Column | str) -> Column:
    """Lower-case words."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(text)), r"[^\w\sæøå]", " "), r"\s+"), lambda w: w != "")


def words_over(text: Column | str, size: int) -> Column:
    """Words of more than ``size`` characters, in order, with repeats."""
    return F.filter(tokenize(text), lambda w: F.length(w) > size)


def word_set(text: Column | str, size: int = 0) -> Column:
    return F.array_distinct(words_over(text, size))


def word_ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words, joined by spaces; none for fewer than n words."""
    def grams(w: Column) -> Column:
        last = F.size(w) - n + 1
        found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(last >= 1, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return bound(words, grams)


def fingerprint(text: Column | str, n: int = 4) -> Column:
    """Distinct n-grams of words of more than two characters."""
    return word_ngrams(words_over(text, 2), n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both.cast("double") / either)


def overlap(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Common elements over the smaller set's size."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return ratio(both, least, empty)


def keyword_overlap(a: Column, b: Column) -> Column:
    """(equal words + half for each of ``a`` that contains or is contained in a word of ``b``) / the smaller size."""
    exact = F.size(F.array_intersect(a, b))
    part = bound(b, lambda own: F.size(F.filter(F.array_except(a, own), lambda x: F.exists(own, lambda y: x.contains(y) | y.contains(x)))))
    return ratio(exact + part * F.lit(0.5), F.least(F.size(a), F.size(b)))


def collapse(text: Column | str) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def normalize_text(text: Column | str) -> Column:
    """Trimmed, single-spaced, plain quotes, lower case."""
    return F.lower(F.translate(collapse(text), "“”„«»‘’‚´`", "\"\"\"\"\"'''''"))


def normalize_quote(text: Column | str) -> Column:
    """:func:`normalize_text` without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_text(text), r"[^\w\sæøå]", ""), r"\s+", " "))


def alphanumeric(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(text)), r"[^a-z0-9æøå]", "")


def char_similarity(a: Column | str, b: Column | str) -> Column:
    """Characters of the shorter text that the longer contains, over the longer's length."""
    a, b = col(a), col(b)
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    hits = bound(long_, lambda own: F.size(F.filter(F.split(short, ""), lambda c: (c != "") & own.contains(c))))
    return F.when(F.length(long_) == 0, 1.0).otherwise(hits.cast("double") / F.length(long_))


def quote_similarity(a: Column | str, b: Column | str) -> Column:
    """1 for equal; half the length ratio where that is under a half; .9 + .1 ratio for containment; else word Jaccard."""
    a, b = normalize_text(a), normalize_text(b)
    size = F.least(F.length(a), F.length(b)).cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (
        F.when(a == b, 1.0)
        .when(size < 0.5, size / 2)
        .when(a.contains(b) | b.contains(a), F.lit(0.9) + size * 0.1)
        .otherwise(jaccard(word_set(a), word_set(b)))
    )


def sentences(text: Column | str) -> Column:
    """Pieces that end with . ! or ?, trimmed, without empty ones."""
    marked = F.regexp_replace(col(text), r"([.!?])\s+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), F.trim), lambda s: s != "")


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), r"\n\s*\n"), F.trim), lambda s: s != "")


def estimate_tokens(text: Column | str) -> Column:
    """Characters over four, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(col(text)) / 4), F.lit(0)).cast("long")


def truncate(text: Column | str, most: int) -> Column:
    """Cut at the last full stop past 70%, else the last comma past 80%, else with an ellipsis."""
    text = col(text)
    head = F.substring(text, 1, most)
    back = lambda mark: most - F.instr(F.reverse(head), mark) + 1
    has = lambda mark: F.instr(head, mark) > 0
    return (
        F.when(F.length(text) <= most, text)
        .when(has(".") & (back(".") > most * 0.7), F.substr(head, F.lit(1), back(".")))
        .when(has(",") & (back(",") > most * 0.8), F.substr(head, F.lit(1), back(",")))
        .otherwise(F.concat(head, F.lit("...")))
    )


def truncate_words(text: Column | str, most: int) -> Column:
    """Cut at the last space past 60%, with an ellipsis."""
    text = col(text)
    head = F.substring(text, 1, most)
    at = most - F.instr(F.reverse(head), " ") + 1
    cut = F.when((F.instr(head, " ") > 0) & (at > most * 0.6), F.substr(head, F.lit(1), at - 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def section_keys(text: Column | str) -> Column:
    """Sorted distinct section numbers (§ 3, § 3 a), joined; 'none' if there are none."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"§\s*([0-9]+)"), F.lit(1))))
    return F.when(F.size(found) > 0, F.array_join(found, "+")).otherwise("none")


def headers(text: Column | str) -> Column:
    """Texts of Markdown headers, distinct and in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(r"(?m)^#{1,6}[ \t]+(.+)$"), F.lit(1)), F.trim))


def has_structure(text: Column | str) -> Column:
    """Whether a header, list or table line is there."""
    return col(text).rlike(r"(?m)^(#{1,6}\s|\s*[-*+]\s|\s*[0-9]+\.\s|\|)")


def balanced(text: Column | str) -> Column:
    """Whether parentheses close in order."""
    step = lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).when(c == ")", d - 1).otherwise(d)
    return F.aggregate(F.split(col(text), ""), F.lit(0), step) == 0


def compress_numbers(numbers: Column) -> Column:
    """Sorted distinct integers as ranges: 1-3, 5."""
    def ranges(sorted_: Column) -> Column:
        # A number begins a range if it follows no other, and ends one if no other follows it.
        starts = F.filter(sorted_, lambda x: ~F.array_contains(sorted_, x - 1))
        ends = F.filter(sorted_, lambda x: ~F.array_contains(sorted_, x + 1))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))), ", ")

    return bound(F.array_sort(F.array_distinct(numbers)), ranges)


def clean_markup(text: Column | str) -> Column:
    """Prose without Markdown: headers, emphasis, links and code marks go."""
    out = F.regexp_replace(col(text), r"(?m)^#{1,6}\s+", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return collapse(F.regexp_replace(out, r"[*_`]+", ""))


def joined_list(names: Column, last: str = "og") -> Column:
    """'a, b og c'."""
    n = F.size(names)
    many = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(f" {last} "), F.element_at(names, -1))
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).otherwise(many)


def contained(text: Column | str, words: list[str]) -> Column:
    """The words of a fixed list that a text contains."""
    text = F.lower(col(text))
    return F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def pattern_hits(text: Column | str, patterns: list[str]) -> Column:
    """How many of the patterns occur in the lower-case text."""
    text = F.lower(col(text))
    return sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in patterns), F.lit(0))
