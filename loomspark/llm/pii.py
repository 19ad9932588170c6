"""Surrogates for personal data: keyed, type-consistent replacements that keep distinct what is distinct.

Entities are found by pattern: e-mail addresses, bank accounts, payment cards (13 to 19 digits that pass the Luhn test, or
four fours), identity numbers, IP addresses of both versions, telephone numbers (international ones by digit count, in any
grouping; national ones in groups) and names after a title. Names without a title are not looked for. An entity's
surrogate is drawn from a keyed hash of its type and canonical form, so one entity has one surrogate in all texts, and
who lacks the key cannot tell it. The surrogate keeps the format: each digit becomes a digit, each letter a letter of its
script and case, separators and top-level domains stay, what passes the test of its kind (Luhn, modulo 97) still does, an
IP address stays in range, and a name becomes a name of the title's gender and the name's script.

Distinctness: all entities are drawn at once; where two get one surrogate, or a surrogate is an entity of the texts
itself, all but the smallest draw again, round by round, until none collides. Each further draw takes from a larger space
(names and addresses grow at once, numbers only after ``STRICT`` draws), so the rounds end however many entities there are.
Entities are a table of distinct values, grouped and joined by value, never gathered anywhere. Everything is DataFrame work.

Cases: a null text stays null and has no entities; an empty one stays empty; texts are handled whole; rows that repeat
id and text come out alike; an entity that occurs in many texts, or often in one, is drawn once; an empty table gives
an empty result; the output has only the id and the columns named here, so others cannot clash. Of entities that
overlap, the one that begins first counts, then the kind listed first. Letters of scripts without an entry in
``ALPHABETS`` become Latin ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import spread_join, stored, table

#: Titles by gender; a name follows them.
TITLES = {
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κα"],
    "male": ["Mr", "Herr", "Monsieur", "M.", "Señor", "Sr", "Г-н", "Κος"],
}
# A run of one class of characters costs the matcher no stack, a repeated group does: such groups have small bounds.
_FREE, _ENDS, _OCTET = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])", "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NAME = r"\.?\x20[\p{Lu}\p{Lo}][\p{L}\p{M}'-]+(?:\x20[\p{Lu}\p{Lo}][\p{L}\p{M}'-]+)?"


def _titled(gender: str) -> str:
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(t.replace(".", r"\.") for t in TITLES[gender]) + ")" + _NAME


#: Patterns by kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}\p{M}._%+-])[\p{L}\p{N}\p{M}._%+-]{1,64}@[\p{L}\p{N}][\p{L}\p{N}\p{M}.-]*\.[\p{L}\p{M}]{2,}",
    "iban": r"(?=[A-Z])" + _FREE + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?" + _ENDS,
    "card": r"(?=[0-9])(?<![\p{L}\p{N}_+])(?:[0-9]{4}(?:[\x20-]?[0-9]{4}){3}|(?:[3-6]|2[2-7])[0-9](?:[\x20-]?[0-9]){11,17})" + _ENDS,
    "ssn": r"(?=[0-9])" + _FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _ENDS,
    "ip": r"(?=[0-9])" + _FREE + r"(?<![0-9]\.)(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\.?[0-9])" + _ENDS,
    "ipv6": r"(?=[0-9A-Fa-f:]{0,39}[0-9])(?<![\p{L}\p{N}_:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|"
    r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}_:])",
    "phone": r"(?=[+(0-9])(?<![\p{L}\p{N}_+])(?:\+[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}|"
    r"(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}|0[0-9](?:[\x20.-][0-9]{2}){4})" + _ENDS,
    "female": _titled("female"),
    "male": _titled("male"),
}
#: A name's title, with what follows it up to the name.
TITLE = r"^\p{L}+(?:-\p{L}+)?\.?\x20"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: First names by gender and script.
FIRST = {
    ("female", "latin"): ["Anna", "Clara", "Elena", "Hanna", "Ida", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"],
    ("male", "latin"): ["Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Victor"],
    ("female", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"],
    ("male", "cyrillic"): ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Юрий"],
    ("female", "greek"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Νίκη", "Σοφία"],
    ("male", "greek"): ["Ανδρέας", "Γιώργος", "Λεωνίδας", "Νίκος", "Παύλος", "Σταύρος"],
}
#: Syllables that surnames are put together from, by script.
SYLLABLES = {
    "latin": ["ba", "del", "fen", "gor", "han", "kel", "lin", "mar", "nor", "pel", "ros", "sten", "tal", "ven", "wil", "zan"],
    "cyrillic": ["ба", "вел", "гор", "дан", "кол", "лен", "мар", "нов", "пет", "рос", "сал", "тар", "фед", "чер", "шан", "яр"],
    "greek": ["βα", "γεν", "δορ", "ζαν", "καλ", "λιν", "μαρ", "νικ", "πελ", "ροσ", "σταυ", "τακ", "φιλ", "χαρ", "παπ", "δημ"],
}
#: Characters that tell a name's script.
SCRIPTS = {"cyrillic": "[Ѐ-ӿ]", "greek": "[Ͱ-Ͽ]", "other": r"[^\p{IsLatin}\p{IsCommon}\p{M}]"}
#: Classes of characters, and the first and number of the code points that replace them; the first class that fits counts.
ALPHABETS = [
    ("[0-9]", 0x30, 10), ("[٠-٩]", 0x660, 10), ("[०-९]", 0x966, 10), (r"\p{N}", 0x30, 10),
    (r"[\p{IsLatin}&&\p{Lu}]", 0x41, 26), (r"\p{IsLatin}", 0x61, 26), (r"[\p{IsGreek}&&\p{Lu}]", 0x391, 17), (r"\p{IsGreek}", 0x3B1, 17),
    (r"[\p{IsCyrillic}&&\p{Lu}]", 0x410, 32), (r"\p{IsCyrillic}", 0x430, 32), (r"[\p{IsArmenian}&&\p{Lu}]", 0x531, 38), (r"\p{IsArmenian}", 0x561, 38),
    (r"[\p{IsHebrew}&&\p{L}]", 0x5D0, 27), (r"[\p{IsArabic}&&\p{L}]", 0x628, 19), (r"[\p{IsDevanagari}&&\p{L}]", 0x915, 37), (r"[\p{IsThai}&&\p{L}]", 0xE01, 46),
    (r"[\p{IsGeorgian}&&\p{L}]", 0x10D0, 33), (r"[\p{IsHiragana}&&\p{L}]", 0x3041, 83), (r"[\p{IsKatakana}&&\p{L}]", 0x30A1, 90), (r"[\p{IsHangul}&&\p{L}]", 0xAC00, 11172),
    (r"[\p{IsHan}&&\p{L}]", 0x4E00, 20902), (r"\p{L}", 0x61, 26),
]
#: Draws after which numbers, too, grow.
STRICT = 40
#: The key of the registered query alone, whose results are compared from run to run; operators take one of the caller's own.
QUERY_KEY = "key-of-the-registered-query"


def canonical(value: Column, kind: Column) -> Column:
    """What tells an entity: e-mail addresses in lower case, numbers without separators, names without their title."""
    digits = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    name = F.regexp_replace(value, TITLE, "")
    return F.when(kind.isin("email", "ipv6"), F.lower(value)).when(kind.isin("female", "male"), name).when(kind == "ip", value).otherwise(digits)


def kind_of(value: Column) -> Column:
    """The first kind whose pattern the whole value matches; null for a run of digits that is no card after all."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        fits = value.rlike(rf"^(?:{pattern})\z")
        if kind == "card":
            fits = fits & (value.rlike(r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}\z") | _luhn(F.regexp_replace(value, "[^0-9]", "")))
        found = F.when(fits, kind).otherwise(found)
    return found


def _draw(seed: Column, at: Column, size: int | Column) -> Column:
    return F.pmod(F.xxhash64(seed, at), F.lit(size) if isinstance(size, int) else size).cast("int")


def _pick(words: list[str], seed: Column, at: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(words)), " "), _draw(seed, at, len(words)) + 1)


def _character(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def _shaped(value: Column, seed: Column) -> Column:
    """Each letter and digit replaced by one of its class; all else stays."""

    def change(c: Column, i: Column) -> Column:
        out = None
        for fits, first, size in ALPHABETS:
            new = _character(F.lit(first) + _draw(seed, i, size))
            out = F.when(c.rlike(fits), new) if out is None else out.when(c.rlike(fits), new)
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), change), "")


def _grown(seed: Column, times: Column, words: list[str]) -> Column:
    """As many more words as ``times`` says."""
    more = F.when(times > 0, F.transform(F.sequence(F.lit(1), times), lambda n: _pick(words, seed, n + 100))).otherwise(F.array().cast("array<string>"))
    return F.array_join(more, "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits: 0 modulo 10 if it passes."""
    turned = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def part(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.transform(turned, part), F.lit(0), lambda s, x: s + x)


def _luhn(digits: Column) -> Column:
    return F.coalesce(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, F.lit(False))


def _mod_97(account: Column) -> Column:
    """The remainder that tells a bank account's check digits: 1 if they are right."""
    turned = F.filter(F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), ""), lambda c: c != "")
    number = lambda c: F.call_function("locate", c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
    return F.aggregate(turned, F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c), F.lit(97)))


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon, attempt) with ``drawn``, the replacement in canonical form: all forms of one entity change alike."""
    kind, canon, attempt, secret, plain, script = (F.col(c) for c in ("kind", "canon", "attempt", "__secret", "__plain", "__script"))
    letters, digits = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")
    found = F.lit("latin")
    for name, fits in reversed(SCRIPTS.items()):
        found = F.when(canon.rlike(fits), name).otherwise(found)
    # Values used more than once are columns of their own, or each use would hold their whole expression.
    out = entities.withColumns({"__secret": F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256), "__script": found})
    # The top-level domain of an address stays, as does an account's country.
    last = F.when(kind == "email", F.regexp_extract(canon, r"(\.[^.]+)\z", 1)).otherwise(F.lit(""))
    body = F.substr(canon, F.lit(1), F.length(canon) - F.length(last))
    out = out.withColumns({"__shaped": _shaped(body, secret), "__last": last})
    late = F.greatest(attempt - STRICT, F.lit(0))
    out = out.withColumns({"__late": _grown(secret, late, digits), "__more": _grown(secret, attempt, letters)})
    out = out.withColumn("__plain", F.concat("__shaped", "__late"))
    email = F.concat(F.substring_index("__shaped", "@", 1), F.col("__more"), F.lit("@"), F.substring_index("__shaped", "@", -1), F.col("__last"))
    drawn = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit("0"))
    check = F.pmod(-_luhn_sum(drawn), F.lit(10)).cast("string")
    card = F.when(_luhn(canon), F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), check)).otherwise(plain)
    beyond = F.when(F.col("__late") == "", "").otherwise(F.concat(F.lit("."), "__late"))
    octets = F.array_join(F.transform(F.split(canon, r"\."), lambda x, i: (_draw(secret, i, 254) + 1).cast("string")), ".")
    hexes = F.transform(F.filter(F.split(canon, ""), lambda c: c != ""), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(_draw(secret, i, 16)))))
    country, rest = F.substr(canon, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    right = F.lpad((98 - _mod_97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_mod_97(canon) == 1, right).otherwise(F.substr(plain, F.lit(3), F.lit(2))), rest)
    # A name in a script without syllables here has letters of its script, and one more with each draw.
    more = F.when(attempt > 0, _shaped(F.repeat(F.substr(canon, F.lit(-1), F.lit(1)), attempt), F.sha2(secret, 256))).otherwise(F.lit(""))
    surname, first = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, words in SYLLABLES.items():
        surname = F.when(script == own, F.concat(*[_pick(words, secret, F.lit(n)) for n in (11, 12, 13, 14)], _grown(secret, attempt, words))).otherwise(surname)
    for (gender, own), words in FIRST.items():
        first = F.when((kind == gender) & (script == own), _pick(words, secret, F.lit(10))).otherwise(first)
    titled = F.concat(F.when(canon.contains(" "), F.concat(first, F.lit(" "))).otherwise(F.lit("")), F.initcap(surname))
    named = F.coalesce(titled, F.concat(plain, more))
    one = F.when(kind == "email", email).when(kind == "ip", F.concat(octets, beyond)).when(kind == "ipv6", F.concat(F.array_join(hexes, ""), beyond))
    one = one.when(kind.isin("female", "male"), named).when(kind == "card", card).when(kind == "iban", iban).otherwise(plain)
    return out.withColumn("drawn", one).select(*entities.columns, "drawn")


def in_form(kind: Column, value: Column, drawn: Column) -> Column:
    """A surrogate of the canonical form, in the form of ``value``: with its separators or capitals, or after its title."""
    fill = F.aggregate(
        F.filter(F.split(value, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct((acc["at"] + 1).alias("at"), F.concat(acc["out"], F.substr(drawn, acc["at"] + 1, F.lit(1))).alias("out"))).otherwise(
            F.struct(acc["at"].alias("at"), F.concat(acc["out"], c).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substr(drawn, acc["at"] + 1)),
    )
    title = F.regexp_extract(value, TITLE, 0)
    upper = F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(drawn)).otherwise(drawn)
    return F.when(kind.isin("email", "ipv6"), upper).when(kind == "ip", drawn).when(kind.isin("female", "male"), F.concat(title, drawn)).otherwise(fill)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon), each once, with ``drawn``, a surrogate that no other has and that is none of them."""
    entities = stored(entities.select("kind", "canon"), "entities")
    open_, done = entities.withColumn("attempt", F.lit(0)), []
    taken = entities.select("kind", F.col("canon").alias("drawn"))
    while True:
        tried = stored(with_surrogates(open_, key), "surrogates")
        # Of those that drew the same, the smallest keeps it; what is taken, by an earlier round or by an entity, is lost.
        first = tried.groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        won = stored(first.join(taken, ["kind", "drawn"], "left_anti").select("kind", "canon", "drawn"), "surrogates-won")
        done.append(won)
        open_ = stored(tried.join(won, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "surrogates-open")
        if open_.isEmpty():
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out
        taken = taken.unionByName(won.select("kind", "drawn"))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``values``, what looks like an entity in order (empty or null for none), of every row."""
    text = F.col(text_col).cast("string")
    # Every entity has a digit, an at sign or a title; texts without them need no match of all patterns.
    may = text.rlike("[0-9@]")
    for title in [t for titles in TITLES.values() for t in titles]:
        may = may | text.contains(title)
    found = F.when(may, F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), found.alias("values"))


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with surrogates), n_entities (places replaced), kinds (how many of each kind) of every row."""
    # Texts are searched once; a row's number, fixed by the stored table, tells it from its copies.
    rows = stored(detected(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    hits = rows.where("size(values) > 0")
    forms = hits.select(F.explode(F.array_distinct("values")).alias("value")).distinct().withColumn("kind", kind_of(F.col("value"))).where("kind is not null")
    forms = stored(forms.withColumn("canon", canonical(F.col("value"), F.col("kind"))), "pii-forms")
    drawn = assigned(forms.select("kind", "canon").distinct(), key)
    # Forms are few to an entity: they get their surrogates first, then go back to their places.
    shown = forms.join(drawn, ["kind", "canon"]).select("value", "kind", in_form(F.col("kind"), F.col("value"), F.col("drawn")).alias("shown"))
    places = hits.select("row", F.posexplode("values").alias("at", "value"))
    placed = spread_join(places, stored(shown, "pii-shown"), "value", ["row", "at"], how="left")
    by_row = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("shown", "value").alias("shown"), "kind"))).alias("new"))
    hit = hits.join(by_row, "row")
    text_out = F.array_join(F.zip_with(F.split("text", ANY, -1), F.col("new.shown"), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    number = lambda k: F.size(F.filter("found", lambda x: x == k)).cast("long")
    hit = hit.select("doc_id", text_out.alias("text"), F.filter("new.kind", lambda k: k.isNotNull()).alias("found"))
    clean = rows.where("coalesce(size(values), 0) < 1").select("doc_id", "text", F.array().cast("array<string>").alias("found"))
    return hit.unionByName(clean).select("doc_id", "text", F.size("found").cast("long").alias("n_entities"), *[number(k).alias(f"n_{k}") for k in PATTERNS])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents"), QUERY_KEY)
