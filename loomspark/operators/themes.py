"""Mapping of arguments to the themes of their run, by ordered rules.

Arguments meet only the themes of their own run, in a join on the run; which theme wins is one aggregate for each argument.
Themes have a place in their run (``pos``); of several that fit, the first rule wins, then the first theme.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import ratio

#: Words of references, in order, and what a theme's name then contains.
INDICATORS = [
    (["ydre fremtræden", "ydre_fremtrædne", "facade"], "ydre fremtræden"), (["omfang og placering", "hoejde", "højde", "bebyggelsesprocent"], "omfang"), (["anvendelse"], "anvendelse"),
    (["parkering", "cykelparkering", "bilparkering"], "parkering"), (["ubebyggede arealer", "friarealer", "byrum"], "ubebyggede"), (["veje", "stier", "adgang"], "veje"), (["støj", "forurening"], "støj"),
]
#: What a theme's name contains by number of the section.
SECTIONS = {
    1: ["formål"], 2: ["område", "områdets afgrænsning"], 3: ["anvendelse"], 4: ["veje", "vej", "adgange", "stier"], 5: ["bebyggelsens omfang", "omfang og placering"],
    6: ["bebyggelsens ydre fremtræden", "ydre fremtræden", "facade"], 7: ["ubebyggede arealer", "friarealer", "byrum"], 8: ["støj", "forurening", "miljø"], 9: ["grundejerforening", "grundejer"],
    10: ["ophævelse", "servitutter"], 11: ["forudsætninger", "betingelser"], 12: ["retsvirkninger"],
}
#: References that name their subject, and words of preservation with the themes that these belong to.
NAMED = "_(?iu:ydre|omfang|anvendelse|parkering|ubebyggede|veje|støj)"
PRESERVE = ["bevar", "bevaring", "bevaringsværdig", "nedriv", "nedrivning", "frede", "fredning", "kulturarv"]
PRESERVED = ["bebyggelsens omfang", "omfang og placering"]
REST = "Andre emner"


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def by_references(arguments: DataFrame, themes: DataFrame, run: str, key: str, refs: str, name: str) -> DataFrame:
    """key, theme: by a word of its references, in their order; else by the lowest section number that has a theme."""
    ref = arguments.select(run, key, F.posexplode(refs).alias("at", "ref")).withColumn("low", F.replace(F.lower("ref"), F.lit("_"), F.lit(" ")))
    words = F.array(*[F.when(_any(F.col("low"), ws), F.struct(F.lit(n).alias("rank"), F.array(F.lit(theme)).alias("need"))) for n, (ws, theme) in enumerate(INDICATORS)])
    named = ref.select(run, key, F.struct(F.lit(0).alias("kind"), F.col("at").alias("at")).alias("order"), F.explode(F.array_compact(words)).alias("x"))
    number = F.regexp_extract("ref", "[§_-]([0-9]+)", 1).try_cast("int")
    need = F.element_at(F.create_map(*[y for k, v in SECTIONS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))]), number)
    numbered = ref.where(~F.col("ref").rlike(NAMED)).select(run, key, F.struct(F.lit(1).alias("kind"), number.alias("at")).alias("order"), F.struct(F.lit(0).alias("rank"), need.alias("need")).alias("x"))
    wanted = named.unionByName(numbered.where("x.need is not null"))
    fits = wanted.join(themes, run).where(F.exists("x.need", lambda w: F.lower(name).contains(w)))
    return fits.groupBy(key).agg(F.min_by(name, F.struct("order", "x.rank", "pos")).alias("theme"))


def by_content(arguments: DataFrame, themes: DataFrame, run: str, key: str, content: str, name: str) -> DataFrame:
    """key, theme: preservation first, else the first theme of whose name two words (or the only one) are in the content."""
    pairs = arguments.select(run, key, F.lower(content).alias("__c")).where("trim(__c) <> ''").join(themes, run)
    low = F.lower(F.col(name))
    words = F.split(low, r"\s+")
    hits = F.size(F.filter(words, lambda w: (F.length(w) > 3) & F.col("__c").contains(w)))
    preserved = _any(F.col("__c"), PRESERVE) & _any(low, PRESERVED)
    rank = F.when(preserved, 0).when(hits >= F.least(F.lit(2), F.size(words)), 1)
    return pairs.withColumn("__r", rank).where("__r is not null").groupBy(key).agg(F.min_by(name, F.struct("__r", "pos")).alias("theme"))


def mapped(arguments: DataFrame, themes: DataFrame, run: str, key: str, refs: str, content: str, name: str) -> DataFrame:
    """run, key, theme, rule of every argument, each once: by references, by content, else the rest."""
    one = arguments.select(run, key).dropDuplicates([key])
    r = by_references(arguments, themes, run, key, refs, name).withColumnRenamed("theme", "__r")
    c = by_content(arguments, themes, run, key, content, name).withColumnRenamed("theme", "__c")
    rule = F.when(F.col("__r").isNotNull(), "references").when(F.col("__c").isNotNull(), "content").otherwise("rest")
    return one.join(r, key, "left").join(c, key, "left").select(run, key, F.coalesce("__r", "__c", F.lit(REST)).alias("theme"), rule.alias("rule"))


def closest_header(names: DataFrame, headers: DataFrame, run: str, name: str, header: str) -> DataFrame:
    """run, name, header: equal, else the first that contains it or is contained, else the first that shares most words (half at least)."""
    pairs = names.select(run, name).distinct().join(headers, run)
    a, b = F.lower(F.trim(name)), F.lower(header)
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 2)
    shared = F.size(F.filter(words(a), lambda w: F.array_contains(words(b), w)))
    score = ratio(shared, F.greatest(F.size(words(a)), F.size(words(b))))
    rank = F.when(a == b, 3.0).when(a.contains(b) | b.contains(a), 2.0).when(score >= 0.5, score)
    return pairs.withColumn("__s", rank).where("__s is not null").groupBy(run, name).agg(F.min_by(header, F.struct(-F.col("__s"), "pos")).alias("header"))
