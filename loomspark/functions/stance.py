"""Titles and stances: prefixes, directions, objects, foci and what titles have in common, as Column expressions.

Word lists and patterns are those of Danish consultation titles. Null titles give null, or an empty array, unless said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import bound, col, jaccard
from loomspark.operators.rules import all_keywords

#: First words by direction.
FIRST_WORDS = {
    "AGAINST": ["modstand", "bekymring", "kritik", "protest", "indsigelse"],
    "FOR": ["støtte", "opbakning", "ros", "tilslutning"],
    "WANT": ["ønske", "krav", "forslag", "opfordring"],
}
#: Words that begin a prefix of two or three words.
PREFIX = "^(?i:støtte|modstand|bekymring|ønske|krav|protest|opbakning|kritik|ros|forslag)"
#: Prefixes that a title may have, and the noun forms of titles that begin with a verb.
PREFIXES = ["støtte til", "modstand mod", "ønske om", "bekymring for", "forslag om", "opfordring til", "krav om"]
VERBS = [
    (r"^(?i:bevare)\s+(.+)", "Ønske om bevaring af $1"), (r"^(?i:bevar)\s+(.+)", "Ønske om bevaring af $1"), (r"^(?i:flytte?)\s+(.+)", "Ønske om flytning af $1"),
    (r"^(?i:ændre?)\s+(.+)", "Ønske om ændring af $1"), (r"^(?i:fjerne?)\s+(.+)", "Ønske om fjernelse af $1"), (r"^(?i:stoppe?)\s+(.+)", "Modstand mod $1"),
    (r"^(?i:sikre?)\s+(.+)", "Ønske om sikring af $1"),
]
#: Patterns of texts for and against a plan (in lower case), and of arguments for and against.
PLAN_FOR = [
    r"\bstøtte(?:r|nde)?\s+(?:til\s+)?(?:projekt|forslag|plan)et?\b", r"\bstøtte\s+til\s+\S+s?\s+(?:transformation|omdannelse|ombygning)\b", r"\bfor\s+(?:forslag|plan)et\b",
    r"\bpositiv\s+(?:overfor|over\s+for)\s+(?:projekt|forslag|plan)", r"\bgod\s+(?:ide|idé)\b", r"\btilslut(?:ter|ning)\s+(?:mig|os|sig)?\s*(?:til\s+)?(?:projekt|forslag)",
    r"\bopbakning\s+til\s+(?:projekt|forslag|plan)", r"\briv\s+(?:det\s+)?ned\b", r"\bfjern\s+(?:den\s+)?(?:gamle\s+)?bygning", r"\bned\s+med\b",
]
PLAN_AGAINST = [
    r"\bbevar(?:e|ing|es|ingsværdig)?", r"\bmod(?:stand)?\s+(?:mod|imod)", r"\bimod\s+(?:projekt|forslag|plan|nedrivning|ændring)", r"\bnej\s+til", r"\bikke\s+(?:nedriv|ændre|fjerne)",
    r"\bbeskyt(?:te|telse|tes)?", r"\bfred(?:e|ning|et)?", r"\brestaurering", r"\brenovering", r"\bgenopret(?:ning|te)?", r"\bkulturarv", r"\bkulturhistorisk",
    r"\bhistorisk\s+(?:værdi|bygning|bevarelse)", r"\btab\s+(?:af|for)\s+(?:identitet|kulturarv|værdi)", r"\bødelæggelse", r"\brisiko\s+for\s+(?:tab|ødelæggelse)", r"\bskal\s+(?:ikke\s+)?(?:bevares|beskyttes)",
]
SAID_FOR = [r"\bstøtter?\b", r"\bfor\s+(?:forslag|projekt|plan)", r"\bpositiv", r"\benig\b", r"\bgodt?\s+ide", r"\bvelkommen", r"\bglad\s+for"]
SAID_AGAINST = [r"\bimod\b", r"\bmod\s+(?:forslag|projekt|plan)", r"\bnej\s+til", r"\bprotester", r"\bbekymr", r"\bkritisk", r"\bafvis", r"\buenig"]
#: Phrases of good and bad feeling.
GOOD = [
    "ønske om", "støtte til", "opbakning til", "forslag om", "anbefaling af", "behov for", "vigtigheden af", "bevaring af", "bevarelse af", "ros af", "tilfredshed med", "glæde over", "håb om", "positiv til",
]
BAD = [
    "modstand mod", "bekymring for", "kritik af", "afvisning af", "indsigelse mod", "protest mod", "utilfredshed med", "frygt for", "skepsis over", "negativ til", "problemer med", "mangel på", "manglende", "nedrivning", "fjernelse af",
]
#: Patterns of objects in lower-case texts; those that are only concerns.
OBJECTS = {
    "palads": "palads", "dahliahus": r"dahliahus|dahlia\s*hus", "grøntorvet": "grøntorv",
    "bygningshøjde": r"bygningshøjde|bygnings\s*højde|[0-9]+\s*meter.*bygning|bygning.*[0-9]\s*meter|høj.*bygning|bygning.*høj",
    "boldbane": r"boldbane|bold\s*bur", "trafik": "trafik", "støj": "støj|larm", "parkering": "parkering|p-pladser", "cykelsti": "cykelsti|cykelvej|cykelinfrastruktur",
    "adgangsforhold": "adgangsforhold|adgang.*skole|skole.*adgang|indkørsel", "gammel køge landevej": r"gammel\s*køge\s*landevej|gl\.?\s*køge\s*landevej", "værkstedvej": "værkstedvej",
    "torveporten": "torveporten", "skole": "skole", "almene boliger": r"almene\s*boliger|boligbyggeri",
}
CONCERNS = ["støj", "trafik", "adgangsforhold"]
#: Words that tell a title's topic; topics that make titles overlap.
TOPICS = (
    "parkering bil cykel cykelparkering bilparkering støj støjforhold larm højde bygningshøjde etager trafik vej adgang bevaring bevaringsværdig kulturarv fredning nedrivning "
    "facade arkitektur udseende miljø klima grøn hotel biograf anvendelse"
).split()
SHARED_TOPICS = ["parkering", "støj", "trafik", "bevaring", "højde", "hotel"]
#: Keywords by dimension of reasoning, in order.
DIMENSIONS = {
    "klima": ["co2", "klima", "klimaaftryk", "bæredygtighed", "miljø", "genbrug", "ressourceforbrug", "cirkulær", "udledning", "affald", "energi"],
    "kulturarv": ["kulturhistorisk", "kulturarv", "historisk", "bevaringsværdig", "kulturhistorie", "fredning", "kulturminde", "fortidsminde"],
    "æstetik": ["arkitektur", "udseende", "visuelt", "æstetisk", "facade", "design", "stil", "smuk", "grim"],
    "identitet": ["vartegn", "landmærke", "symbol", "identitet", "tilhørsforhold", "karakter", "sjæl", "særpræg"],
    "funktion": ["anvendelse", "funktion", "brug", "formål", "aktivitet", "institution", "offentlig"],
    "demokrati": ["borgerinddragelse", "høring", "transparens", "proces", "beslutning", "demokrati", "inddragelse", "dialog"],
    "økonomi": ["økonomi", "pris", "budget", "investering", "finansiering", "værdi", "profit", "omkostning"],
    "natur": ["træ", "træer", "grøn", "natur", "planter", "park", "biodiversitet", "dyreliv", "vegetation"],
    "trafik": ["parkering", "trafik", "vej", "cykel", "støj", "adgang", "infrastruktur", "transport"],
    "social": ["bolig", "boliger", "beboer", "nabo", "fællesskab", "trivsel", "tryghed", "livskvalitet"],
}
#: Prefixes that theme names lose, in order.
NUMBERING = [r"^§\s*[0-9]+\.?\s*", r"^(?i:kapitel)\s+[0-9]+[\.:\s]*", r"^[0-9]+(?:\.[0-9]+)*\.?\s+", r"^(?i:stk)\.?\s*[0-9]+\.?\s*", r"^(?i:bilag)\s*[0-9]*\.?\s*"]
#: Words too common to be concepts, and the roots that compounds are matched by.
STOP = "kan ikke det er og af til i en at den de som for med på".split()
GENERIC = "område området områder områdets krav kravet kravene forhold forholdene regulere regulering reguleres bygning bygninger bygningens specifikke specifik kun ydre indre".split()
SMALL = "og til af i på for med den det de en et".split()
ROOTS = "parkering trafik vej cykel bil bygning areal miljø støj".split()


def _java(pattern: str) -> str:
    r"""``\b`` between ASCII word characters and others only, and capitals of all letters, as in the patterns' own dialect."""
    border = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", border).replace("(?i:", "(?iu:")


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns a text matches."""
    return sum((F.coalesce(text.rlike(_java(p)), F.lit(False)).cast("int") for p in patterns), F.lit(0))


def contained(text: Column, words: list[str]) -> Column:
    """The words that a text contains, in their order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def stance_direction(title: Column | str) -> Column:
    """AGAINST, FOR or WANT by the first word; else null."""
    word = F.element_at(F.split(F.lower(col(title)), r"\s+"), 1)
    found = F.lit(None).cast("string")
    for name, words in FIRST_WORDS.items():
        found = F.when(word.isin(words), name).otherwise(found)
    return found


def stance_prefix(title: Column | str) -> Column:
    """What stands before a colon if it has five characters, else the first three, or two, words of a title that begins with a stance."""
    title = col(title)
    head = F.trim(F.substring_index(title, ":", 1))
    words = F.split(title, r"\s+")
    first = F.when(title.rlike(_java(PREFIX)) & (F.size(words) >= 2), F.array_join(F.slice(words, 1, 3), " "))
    return F.when(title.contains(":") & (F.length(head) >= 5), head).otherwise(first)


def plan_stance(text: Column | str) -> Column:
    """support, against or neutral: the side with hits alone, or with more than one and a half times the other's."""
    text = F.lower(col(text))
    return bound(F.struct(hits(text, PLAN_FOR).alias("f"), hits(text, PLAN_AGAINST).alias("a")), lambda n: F.when(n["f"] > n["a"] * 1.5, "support").when(n["a"] > n["f"] * 1.5, "against").otherwise("neutral"))


def tagged_stance(group: Column, argument: Column) -> Column:
    """The group's own tag if it is one of two, else that of its arguments, else neutral."""
    known = lambda c: F.when(c.isin("support", "against"), c)
    return F.coalesce(known(group), known(argument), F.lit("neutral"))


def said_stance(text: Column | str) -> Column:
    """for, against or neutral: the side with more hits."""
    text = F.lower(col(text))
    return bound(F.struct(hits(text, SAID_FOR).alias("f"), hits(text, SAID_AGAINST).alias("a")), lambda n: F.when(n["f"] > n["a"], "for").when(n["a"] > n["f"], "against").otherwise("neutral"))


def conflict(a: Column, b: Column) -> Column:
    return ((a == "for") & (b == "against")) | ((a == "against") & (b == "for"))


def sentiment(titles: Column) -> dict[str, Column]:
    """sentiment and confidence of a position from its titles (an array): phrases count once in each title."""
    count = lambda words: F.aggregate(titles, F.lit(0), lambda n, t: n + F.size(contained(F.lower(t), words)))
    good, bad = count(GOOD), count(BAD)
    strong = lambda n: F.least(F.lit(0.9), 0.5 + n * 0.1)
    mood = F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")
    sure = F.when(good + bad == 0, 0.3).when(good > bad * 2, strong(good)).when(bad > good * 2, strong(bad)).when(good == bad, 0.4).otherwise(0.5)
    return {"sentiment": mood, "confidence": sure}


def objects(title: Column, summary: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, summary))
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in OBJECTS.items()]))


def physical(found: Column) -> Column:
    """Objects without mere concerns."""
    return F.array_except(found, F.array(*map(F.lit, CONCERNS)))


def clean_theme(name: Column | str) -> Column:
    """Without numbering, first letter upper; the name itself where nothing would be left."""
    name = col(name)
    out = F.trim(name)
    for p in NUMBERING:
        out = F.regexp_replace(out, p, "")
    out = F.trim(out)
    return F.when(out == "", name).otherwise(F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2))))


def plain_title(title: Column | str) -> Column:
    """Lower case, without a stance and without punctuation; empty for null."""
    out = F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"^(ønske om|modstand mod|krav om|støtte til|bekymring for)\s*", "")
    return F.trim(F.regexp_replace(out, r"[^a-zæøå0-9\s]", ""))


def topics(title: Column | str) -> Column:
    return F.coalesce(contained(F.lower(col(title)), TOPICS), F.array().cast("array<string>"))


def overlapping(title_1: Column, title_2: Column, topics_1: Column, topics_2: Column) -> Column:
    """Whether one of two plain titles contains the other, half of their longer words are common, or they share a telling topic."""
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 3))
    both = (title_1 != "") & (title_2 != "")
    alike = title_1.contains(title_2) | title_2.contains(title_1) | (jaccard(words(title_1), words(title_2)) >= 0.5)
    telling = F.exists(F.array_intersect(topics_1, topics_2), lambda k: F.exists(F.array(*map(F.lit, SHARED_TOPICS)), lambda t: k.contains(t)))
    return (both & alike) | telling


def repeated_words(text: Column | str) -> Column:
    """Words of five or more characters that stand in a text twice or more, sorted."""
    words = F.filter(F.split(F.lower(col(text)), r"\s+"), lambda w: F.length(w) > 4)

    def kept(sorted_words: Column) -> Column:
        twin = lambda w, i: (i > 0) & (F.get(sorted_words, i - 1) == w)
        return F.array_distinct(F.filter(sorted_words, twin))

    return bound(F.array_sort(words), kept)


def fixed_title(title: Column | str, direction: Column) -> Column:
    """A title in noun form, without a slash at its end, and with a stance before it."""
    title = col(title)
    out = title
    for pattern, noun in reversed(VERBS):
        out = F.when(title.rlike(_java(pattern)), F.regexp_replace(title, _java(pattern), noun)).otherwise(out)
    out = F.regexp_replace(out, r"/\.?$", "")
    named = F.exists(F.array(*map(F.lit, PREFIXES)), lambda p: F.lower(out).startswith(p))
    worried = F.lower(F.trim(out)).rlike("^(bekymring|frygt|risiko|problem)")
    stance = F.when((direction == "pro_status_quo") & worried, "Bekymring for").when(direction == "contra", "Modstand mod").otherwise("Ønske om")
    stood = F.concat(stance, F.lit(" "), F.lower(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))
    return F.when(title == "", title).when(named, out).otherwise(stood)


def dimensions(text: Column) -> Column:
    """Every dimension of reasoning that a text has a keyword of, in order; the first is its own."""
    return all_keywords(text, DIMENSIONS)


def concepts(text: Column | str) -> Column:
    """The first ten words of four or more characters that are not too common."""
    common = F.array(*map(F.lit, [*STOP, *GENERIC]))
    return F.slice(F.filter(F.split(col(text), r"[\s,()]+"), lambda w: (F.length(w) > 3) & ~F.array_contains(common, w)), 1, 10)


def matchable(text: Column | str) -> Column:
    """Words of three or more characters and the roots of compounds among them."""
    words = F.filter(F.split(F.lower(col(text)), r"[\s\-]+"), lambda w: (F.length(w) > 2) & ~w.isin(SMALL))
    roots = lambda w: F.filter(F.array(*map(F.lit, ROOTS)), lambda r: w.contains(r) & (w != r))
    return bound(words, lambda ws: F.array_distinct(F.concat(ws, F.flatten(F.transform(ws, roots)))))


def matched(theme: Column, authority: Column) -> Column:
    """Words of a theme (both as :func:`matchable`) that an authority has, or that contain or are contained in one of its."""
    near = lambda a, b: (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (a.contains(b) | b.contains(a)))
    return F.filter(theme, lambda a: F.exists(authority, lambda b: near(a, b)))


def consequence(text: Column | str) -> dict[str, Column]:
    """type and direction of a wanted or feared consequence."""
    text = F.lower(F.coalesce(col(text), F.lit("")))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    kind = F.trim(F.regexp_extract(text, r"(?:ønsk|krav|modstand|bekymr).*?(?:om|mod|vedr\.?)\s*(.+?)(?:\.|$)", 1))
    return {
        "type": F.when(kind == "", "general").otherwise(kind),
        "direction": F.when(has("ønsk", "støtt", "krav om"), "positive").when(has("modstand", "bekymr", "kritik"), "negative").otherwise("neutral"),
    }


def argument_direction(direction: Column) -> Column:
    return F.when(direction == "pro_change", "support").when(direction == "pro_status_quo", "oppose").otherwise("neutral")


#: Patterns of wishes that are conditions or alternatives, and of open support; words that name no object.
CONDITIONS = [
    r"\bskal\b.*\b(?:være|have|sikre|tjene|gavne)", r"\bkrav\s+(?:om|til)\b", r"\bforudsætning|forudsat|betingelse", r"\bhvis\b.*\b(?:skal|må|bør)", r"\bønske\s+om\b.*\b(?:at|bedre|mere|grøn)",
    r"\bbør\s+(?:være|sikre|overholde)", r"\b(?:grøn|bæredygtig|klima)[A-Za-z0-9_]*\s+(?:løsning|valg|tiltag)", r"\bi\s+stedet\s+for\b", r"\bfrem\s+for\b", r"\bikke\b.*\b(?:hotel|hoteludvikling|nybyggeri)",
]
SUPPORT = [r"\bstøtter?\b.*\b(?:projekt|forslag|plan)", r"\bpositiv\s+(?:over\s+for|til)", r"\bbakker?\s+op\b", r"\bgod\s+idé\b", r"\bglad\s+for\b", r"\benig\s+i\b"]
NO_OBJECTS = (
    "i og af til en et den det de som for med på om er vil kan skal har være der at ikke fra ønske krav modstand bekymring forslag støtte holdning høringssvar høringssvarene respondent borger borgere"
).split()


def is_conditional(text: Column | str) -> Column:
    """Whether a wish for change is a condition or an alternative, without open support."""
    text = F.lower(col(text))
    return (hits(text, CONDITIONS) > 0) & (hits(text, SUPPORT) == 0)


def object_words(text: Column | str) -> Column:
    """The first ten different words of five or more characters that may name an object."""
    words = F.split(F.lower(col(text)), r"""[\s,.\-:;()"']+""")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 4) & ~w.isin(NO_OBJECTS))), 1, 10)
