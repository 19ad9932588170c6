"""Parameters that depend on what a run has found so far, as Column expressions of its figures.

A run is a row; all rules are ordered ladders of bounds, so many runs get their parameters in one job, without Python.
A figure that is null counts as unknown and takes the ladder's last value, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import parameters as P
from loomspark.operators.aggregation import banded

#: Scores by number of responses and by number of themes (up to), by length (below), damping of the volume by
#: diversity (below), weights of volume, length, diversity and theme where diversity is low and elsewhere.
VOLUME = ([(5, 0.1), (20, 0.3), (50, 0.5), (150, 0.7)], 1.0)
THEMES = ([(2, 0.2), (4, 0.4), (6, 0.6), (10, 0.8)], 1.0)
LENGTH = ([(50, 0.1), (150, 0.3), (300, 0.5), (600, 0.7)], 1.0)
DAMPING = ([(0.30, 0.4), (0.40, 0.6), (0.50, 0.8)], 1.0)
WEIGHTS = {True: (0.20, 0.25, 0.40, 0.15), False: (0.35, 0.25, 0.25, 0.15)}
#: Category and its part by score (below).
CATEGORY = ([(0.15, "trivial"), (0.30, "simple"), (0.45, "moderate"), (0.65, "complex")], "very_complex")
PART = ([(0.05, "low"), (0.10, "mid"), (0.15, "high"), (0.20, "low"), (0.25, "mid"), (0.30, "high"), (0.35, "low"), (0.40, "mid"), (0.45, "high"),
         (0.52, "low"), (0.58, "mid"), (0.65, "high"), (0.77, "low"), (0.88, "mid")], "high")
#: Similarity from which positions merge, by category and part.
MERGE = {
    "trivial": (0.76, 0.78, 0.80), "simple": (0.78, 0.80, 0.82), "moderate": (0.80, 0.82, 0.84), "complex": (0.80, 0.82, 0.84), "very_complex": (0.82, 0.84, 0.86),
}
#: Kinds of consultation in which copied answers are common.
COPIED_KINDS = ["lokalplan", "miljørapport", "kommuneplan"]
#: Words by focus; two foci among the titles of a merged group make it worth parting.
FOCI = {
    "støj": ["støj", "larm", "gene"], "trafik": ["trafik", "vej", "kørsel", "parkering"], "højde": ["højde", "etage", "meter", "høj"],
    "placering": ["placering", "flytte", "flyttes", "placeres"], "boldbane": ["boldbane", "boldbur", "bold"], "skole": ["skole", "undervisning"], "bolig": ["bolig", "beboer", "nabo"],
}
#: Seconds that a request of a step takes, and tokens that it answers with.
STEP_SECONDS = {"edge-case-screening": 8, "micro-summarize": 3, "aggregate": 15, "consolidate": 8, "hybrid-writing": 5, "considerations": 30, "theme-extraction": 30}
STEP_TOKENS = {"micro-summarize": 300, "edge-case-screening": 100, "hybrid-writing": 800}


def below(value: Column, bands: list[tuple[float, object]], rest: object) -> Column:
    """The value of the first band whose bound is above."""
    found = None
    for bound, out in bands:
        found = F.when(value < bound, F.lit(out)) if found is None else found.when(value < bound, F.lit(out))
    return found.otherwise(F.lit(rest))


def complexity(responses: Column, length: Column, diversity: Column, themes: Column) -> dict[str, Column]:
    """score, category, part and across (whether to merge across themes) of a run."""
    scores = banded(responses, *VOLUME) * below(diversity, *DAMPING), below(length, *LENGTH), diversity, banded(themes, *THEMES)
    weighed = lambda low: scores[0] * WEIGHTS[low][0] + scores[1] * WEIGHTS[low][1] + scores[2] * WEIGHTS[low][2] + scores[3] * WEIGHTS[low][3]
    score = F.when(diversity < 0.35, weighed(True)).otherwise(weighed(False))
    score = F.when((diversity < 0.30) & (score > 0.45), 0.45).otherwise(score)
    category = below(score, *CATEGORY)
    across = category.isin("trivial", "simple") | ((category == "moderate") & (diversity < 0.40))
    return {"score": score, "category": category, "part": below(score, *PART), "across": across}


def merge_threshold(category: Column, part: Column, diversity: Column, positions: Column, responses: Column, recommended: Column) -> Column:
    """Similarity from which positions merge; ``recommended`` is what mass agreement asks for, null for none."""
    ratio = positions / F.greatest(responses, F.lit(1))
    base = F.lit(0.82)
    for name, values in MERGE.items():
        for own, value in zip(("low", "mid", "high"), values):
            base = F.when((category == name) & (part == own), value).otherwise(base)
    base = base - F.when(ratio > 3, 0.06).when(ratio > 2, 0.04).when(ratio > 1.5, 0.02).otherwise(0.0)
    uniform = F.when(responses > 50, 0.05).when(responses > 20, 0.06).otherwise(0.08)
    base = base - F.when(diversity < 0.30, uniform).when(diversity < 0.35, 0.04).when(diversity < 0.50, 0.02).when(diversity > 0.70, -0.03).otherwise(0.0)
    clamped = F.greatest(F.when(responses <= 30, 0.72).otherwise(0.78), F.least(F.lit(0.92), base))
    small = F.when(responses <= 10, F.when(ratio > 2, 0.72).otherwise(0.75)).when(responses <= 20, F.when(ratio > 2, 0.75).otherwise(0.78))
    return F.coalesce(F.when(recommended.isNotNull(), F.greatest(F.lit(0.78), recommended)), small, clamped)


def across_threshold(within: Column, responses: Column, concentration: Column) -> Column:
    """Similarity from which positions of different themes merge."""
    focus = F.coalesce(concentration, F.lit(0.0))
    few = F.when(responses <= 10, F.least(F.lit(0.90), F.greatest(F.lit(0.78), within + 0.03))).when(responses <= 20, F.least(F.lit(0.90), F.greatest(F.lit(0.80), within + 0.04)))
    many = F.when((responses > 500) & (focus > 0.5), 0.65).when((responses > 100) & (focus > 0.6), 0.70).when(focus > 0.7, 0.75)
    return F.coalesce(few, many, F.least(F.lit(0.92), F.greatest(F.lit(0.83), within + 0.05)))


def duplicate_threshold(category: Column, part: Column) -> Column:
    """Similarity from which arguments are duplicates."""
    return F.when(category.isin("trivial", "simple"), 0.88).when(category == "moderate", F.when(part == "low", 0.90).when(part == "mid", 0.92).otherwise(0.93)).otherwise(0.95)


def across_strategy(category: Column, part: Column, diversity: Column, status: Column, concentration: Column, dominant: Column, agreement: Column) -> Column:
    """full, selective or none: how positions of different themes are merged. Unknown figures are null."""
    focused = (status == "VERY_HIGH_CONCENTRATION") | ((status == "HIGH_CONCENTRATION") & (concentration > 0.6)) | (dominant >= 40)
    focused = F.coalesce(focused, F.lit(False)) & (status != "NO_DATA")
    return (
        F.when(focused, "selective").when(agreement > 0.7, "full").when(category.isin("trivial", "simple"), "full")
        .when(category == "moderate", F.when(diversity < 0.40, "full").otherwise("selective"))
        .when((category == "complex") & (part == "low") & (diversity < 0.35), "selective").otherwise("none")
    )


def mass_agreement(diversity: Column, unanimous: Column, largest_share: Column, mean: Column) -> dict[str, Column]:
    """confidence (share of four signs) and whether mass agreement is found; large says whether one cluster has most."""
    large = F.coalesce(largest_share > 0.6, F.lit(False))
    signs = [F.coalesce(c, F.lit(False)).cast("int") for c in (diversity < 0.35, unanimous, large, mean > 0.75)]
    confidence = sum(signs[1:], signs[0]) / 4
    return {"confidence": confidence, "detected": confidence >= 0.5, "large": large}


def agreement_adjustments(detected: Column, confidence: Column, large: Column) -> dict[str, Column]:
    """What mass agreement changes; null where it is not found or changes nothing."""
    by = lambda high, some: F.when(detected & (confidence > 0.75), high).when(detected & (confidence > 0.5), some)
    return {
        "consolidation": by("full", "selective"), "grouping": by("aggressive", "moderate"), "reduction": by(0.8, 0.6),
        "batch": F.when(detected & large, 50), "least_sub": F.when(detected, 3), "theme_threshold": F.when(detected, 0.75),
    }


def copy_detection(responses: Column, organizations: Column, committees: Column, length: Column, kind: Column) -> dict[str, Column]:
    """likelihood of copied answers, whether to look for them, and the threshold; fewer than five responses: not, without one."""
    likelihood = F.when(organizations >= 3, 0.4).when(organizations >= 2, 0.25).otherwise(0.0) + F.when(committees >= 1, 0.3).otherwise(0.0)
    likelihood = likelihood + F.when(kind.isin(COPIED_KINDS), 0.3).otherwise(0.0) + F.when(length > 500, 0.2).when(length > 200, 0.1).otherwise(0.0)
    enough = responses >= 5
    threshold = F.when(likelihood >= 0.7, 0.70).when(likelihood >= 0.5, 0.78).otherwise(0.85)
    return {"likelihood": F.when(enough, likelihood), "enabled": enough & ((likelihood >= 0.4) | (responses <= 30)), "threshold": F.when(enough, threshold)}


def tier(arguments: Column, themes: Column) -> dict[str, Column]:
    """How arguments are aggregated: tier by arguments a theme, and the sizes of each way."""
    each = F.when(themes > 0, F.ceil(arguments / themes)).otherwise(arguments).cast("long")
    return {
        "each": each, "tier": P.by_bands(each, P.AGGREGATION_TIER), "clusters": F.ceil(F.sqrt(each.cast("double")) * 0.8).cast("long"),
        "sample": F.least(F.lit(200), F.ceil(each * 0.1)).cast("long"),
    }


def several_foci(titles: Column) -> Column:
    """Whether titles (an array of two or more) name two or more foci."""
    named = lambda words: F.exists(titles, lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(t).contains(w)))
    count = sum((F.coalesce(named(words), F.lit(False)).cast("int") for words in FOCI.values()), F.lit(0))
    return F.coalesce((F.size(titles) >= 2) & (count >= 2), F.lit(False))


def parts_wanted(respondents: Column, merges: Column, titles: Column, agreement: Column, concentration: Column, diversity: Column) -> Column:
    """Whether a position is parted into sub-positions: any rule that holds. ``titles`` are those that were merged into it."""
    merges, merged = F.coalesce(merges, F.lit(1)), F.coalesce(F.greatest(F.size(titles), F.lit(0)), F.lit(0))
    diverse = lambda least: F.coalesce(diversity > least, F.lit(False))
    focused = F.coalesce(concentration > 0.6, F.lit(False))
    return (
        diverse(0.35) | (merges >= 3) | (merged >= 3) | (agreement & (respondents > 5)) | (focused & diverse(0.25))
        | ((merges == 1) & (respondents > 10) & (diverse(0.25) | focused)) | ((merges >= 2) & diverse(0.20))
        | ((respondents >= 5) & (merged >= 2) & several_foci(titles))
    )


def parts_bounds(respondents: Column, agreement: Column, concentration: Column) -> dict[str, Column]:
    """least and most sub-positions, and the strategy."""
    focused = F.coalesce(concentration > 0.8, F.lit(False))
    massive = agreement & (respondents > 30)
    least = F.when(focused | massive | (respondents > 40), 4).otherwise(2)
    most = F.when(respondents > 40, F.least(F.lit(15), F.greatest(F.lit(8), F.ceil(respondents / 5).cast("int")))).when(focused, 15).when(massive, 12).otherwise(8)
    return {"least": least, "most": most, "strategy": F.when(agreement, "nuanced").otherwise("standard")}


def batch_size(seconds: Column, tokens: Column, requests_a_minute: int = 10_000, tokens_a_minute: int = 200_000, share: float = 0.6, most: int = 500) -> Column:
    """Requests at once: what the limits allow in ``seconds``, 5 at least; tokens of 0 set no limit."""
    by_requests = F.floor(F.lit(requests_a_minute / 60 * share) * seconds)
    by_tokens = F.when(tokens > 0, F.floor(F.lit(tokens_a_minute / 60 * share) * seconds / tokens))
    return F.greatest(F.lit(5), F.least(by_requests, by_tokens, F.lit(most))).cast("long")


def step_batch_size(step: Column, chars: Column, context: int = 0) -> Column:
    """:func:`batch_size` of a step whose items have ``chars`` characters on average (null for no items)."""
    known = lambda table, rest: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), step), F.lit(rest))
    seconds = known(STEP_SECONDS, 1) + F.coalesce(F.floor(chars / 1000), F.lit(0))
    seconds = F.when(step == "embedding", F.greatest(seconds, F.lit(5))).otherwise(seconds)
    tokens = F.coalesce(F.ceil(chars / 4) + known(STEP_TOKENS, 0) + context, F.lit(0))
    return batch_size(seconds, tokens)


def chunk_size(window: Column, reserve: Column) -> Column:
    """Characters of a chunk that leave room for the answer and for instructions."""
    return F.floor((window - reserve - 2000) * 4 * 0.8).cast("long")


def skip_validation(positions: Column, responses: Column, ratio: Column, complexity: Column) -> dict[str, Column]:
    """Whether positions go unvalidated, and why."""
    many = (responses <= 20) & (positions / F.greatest(responses, F.lit(1)) > 1.0)
    why = (
        F.when(many, None).when((responses <= 5) & (positions <= responses), "tiny").when(ratio < 0.40, "consolidated")
        .when(complexity.contains("very_complex"), "very complex").when(positions <= 3, "few")
    )
    return {"skip": why.isNotNull(), "why": why}


def workload(positions: Column, most: int = 100) -> Column:
    """Pairs of positions in a theme that a model is expected to be asked about."""
    return F.least(F.floor(positions * (positions - 1) / 2 * 0.3), F.lit(most)).cast("long")


def concurrency(calls: Column, themes: Column) -> dict[str, Column]:
    """Themes and calls at a time, by the calls expected over all themes."""
    at_once = F.when(calls < 50, F.least(themes, F.lit(6))).when(calls < 200, F.least(themes, F.lit(4))).when(calls < 500, 3).otherwise(2)
    return {"theme_concurrency": at_once.cast("long"), "base": F.when(calls < 50, 25).when(calls < 200, 20).when(calls < 500, 15).otherwise(10)}


def theme_concurrency(positions: Column, base: Column) -> Column:
    """Calls at a time for a theme of so many positions."""
    return F.when(positions < 15, F.least(F.lit(30), F.floor(base * 1.5 + 0.5))).when(positions < 40, base).when(positions < 100, F.greatest(F.lit(8), F.floor(base * 0.7 + 0.5))).otherwise(
        F.greatest(F.lit(5), F.floor(base * 0.5 + 0.5))
    ).cast("long")


#: Embedding calls at once by responses (up to); tries, texts in a batch, pause in milliseconds and tries of a
#: batch by responses (below); themes that take what fits nowhere.
CALLS = ([(20, 8), (100, 5), (300, 4)], 3)
RETRIES = {
    "attempts": ([(100, 4), (500, 5), (1000, 6)], 8), "batch": ([(100, 50), (500, 40), (1000, 30)], 25), "pause": ([(100, 200), (500, 300), (1000, 400)], 500), "batch_tries": ([(100, 3), (500, 4), (1000, 5)], 6),
}
CATCH_ALL = ["Andre emner", "Generelt"]


def embedding_calls(responses: Column, themes: Column) -> dict[str, Column]:
    """Embedding calls at once over all, and for each theme: one less, but two, where more than five themes run side by side."""
    calls = banded(responses, *CALLS)
    calls = F.when(F.least(themes, F.lit(10)) > 5, F.greatest(F.lit(2), calls - 1)).otherwise(calls)
    return {"calls": calls, "theme_calls": F.least(F.lit(3), F.ceil(calls / 2)).cast("int")}


def embedding_retries(responses: Column) -> dict[str, Column]:
    return {name: below(responses, *table) for name, table in RETRIES.items()}


def theme_threshold(theme: Column, threshold: Column) -> Column:
    """A theme that takes what fits nowhere merges more readily."""
    return F.when(theme.isin(CATCH_ALL), F.greatest(F.lit(0.72), threshold - 0.06)).otherwise(threshold)
