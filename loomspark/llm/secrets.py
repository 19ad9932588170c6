"""Secret scans: patterns for strong candidates, and multipart credential linking for weak ones.

Base patterns find assignments of passwords and keys, access identifiers and long hexadecimal runs, leftmost first and
without overlap. The linking adds weak parts: identifiers (a user or client named in an assignment), secrets (long
mixed runs of letters and digits) and endpoints (URLs and connection strings). A weak part is reported only where parts
that complete it begin within ``SCOPE`` characters of it: a weak identifier needs a secret, a weak secret an identifier
or an endpoint, an endpoint an identifier and a secret.

Everything is DataFrame work. Spans come from splitting a text at a pattern: the pieces between matches and the matches
themselves, added up by length, give each match's place. The linking is an interval join: parts fall into buckets of
``SCOPE`` characters of their text; of each bucket and role only the first and the last place are kept, and a part looks
at its own bucket and the two beside it. That is exact (in the bucket before, the last part is the nearest; in the
bucket after, the first) and grows with the number of parts, not of pairs.

Cases: a null or empty text has no spans; texts are read whole, and places count code points; rows that repeat id and
text have the same spans; a null id is a key like any other; an empty table gives an empty result; the output has only
the id and the columns named here, so others cannot clash. A weak part that overlaps a base span, or a weak part of a
kind listed earlier, is not a candidate; but a weak secret that stands after ``=``, as in a query string, leaves the
endpoint that it is in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import spread_join, stored, table, text_of

#: The base patterns by kind, in the order in which ties are listed.
BASE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: By kind, the least length of what the number after it names: the match (0) or its group.
LEAST = {"assign": (6, 2), "access": (20, 0), "hex": (24, 0)}
#: What a match of at least that length looks like; finds the texts, and hexadecimal runs, worth splitting.
LONG = {"assign": BASE["assign"], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Weak parts by kind.
WEAK = {
    "client": r"""(?i)(user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""",
    "blob": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"(?i)\b[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:@%/?#=&+-]{4,}",
}
KINDS = [*BASE, *WEAK]
#: Roles of the kinds.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "client": "identifier", "blob": "secret", "endpoint": "endpoint"}
#: Roles that must be near a weak part: one of each group.
NEEDS = {"client": [["secret"]], "blob": [["identifier", "endpoint"]], "endpoint": [["identifier"], ["secret"]]}
SCOPE = 256

SPANS = "array<struct<kind: int, start: int, end: int>>"


def spans(text: Column, kind: str) -> Column:
    """The places of a kind's matches in a text, as an array of (kind, start, end)."""
    # Runs of hexadecimal digits and access identifiers end where their class ends, so a run that is long enough is the
    # whole leftmost match; an assignment too short must still be matched, for it can hide the next one.
    pattern = LONG[kind] if kind in LONG else WEAK[kind]
    least, group = LEAST.get(kind, (0, 0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    sizes = F.arrays_zip(F.transform(matches, lambda x: F.length(x)).alias("m"), F.transform(values, lambda x: F.length(x)).alias("v"))
    # Running sums in blocks would be faster for very many matches; aggregate's array grows by one each step.
    number = F.lit(KINDS.index(kind))
    zipped = F.zip_with(F.slice(gaps, 1, F.size(matches)), sizes, lambda g, s: F.struct(g.alias("g"), s["m"].alias("m"), s["v"].alias("v")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["m"]
        one = F.array(F.struct(number.alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["v"] >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(zipped, begin, add, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def in_order(found: Column) -> Column:
    """Spans by start, then kind."""
    key = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(key), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(in_order(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _apart(weak: Column, others: Column) -> Column:
    """The spans of ``weak`` that overlap none of ``others``."""
    return F.filter(weak, lambda w: ~F.exists(others, lambda o: (o["start"] < w["end"]) & (w["start"] < o["end"])))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text, which alone decides the spans), base and weak spans of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.md5("text").alias("key"), F.concat(*[spans(F.col("text"), k) for k in BASE]).alias("base"), *[spans(F.col("text"), k).alias(k) for k in WEAK])
    others = F.col("base")
    parts = []
    for kind in WEAK:
        parts.append(_apart(F.col(kind), others))
        others = F.concat(others, F.filter(kind, lambda s: F.substr("text", s["start"], F.lit(1)) != "=") if kind == "blob" else F.col(kind))
    return rows.select("doc_id", "key", "base", F.concat(*parts).alias("weak"))


def linked(rows: DataFrame) -> DataFrame:
    """key, linked: the weak spans of each key that complementary parts are near."""
    some = rows.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    parts = some.dropDuplicates(["key"]).select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s.*")
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("kind") + 1)
    parts = parts.select("key", "kind", "start", "end", role.alias("role"), F.floor(F.col("start") / SCOPE).alias("bucket"))
    edges = parts.groupBy("key", "bucket", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    # Each bucket's edges go to the buckets that look at them: the one before sees the first, the one after the last.
    seen = edges.select("key", "role", F.explode(F.array(
        F.struct((F.col("bucket") - 1).alias("bucket"), F.col("first").alias("place")),
        F.struct(F.col("bucket").alias("bucket"), F.col("first").alias("place")),
        F.struct((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("place")),
    )).alias("x"))
    near = seen.groupBy("key", F.col("x.bucket").alias("bucket")).agg(F.collect_list(F.struct("role", F.col("x.place").alias("place"))).alias("near"))
    weak = parts.where(F.col("kind") >= len(BASE)).join(near, ["key", "bucket"])

    def is_near(roles: list[str]) -> Column:
        return F.exists("near", lambda n: n["role"].isin(roles) & (F.abs(n["place"] - F.col("start")) <= SCOPE))

    complete = F.lit(False)
    for kind, groups in NEEDS.items():
        every = F.lit(True)
        for roles in groups:
            every = every & is_near(roles)
        complete = F.when(F.col("kind") == KINDS.index(kind), every).otherwise(complete)
    return weak.where(complete).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, base (spans of the base patterns) and found (these and the linked weak spans) of every row."""
    rows = stored(scanned(docs, id_col, text_col), "secret-spans")
    # Only rows with weak spans have anything to link; a text that very many rows repeat is spread by id.
    weak = spread_join(rows.where("size(weak) > 0"), linked(rows), "key", ["doc_id"], how="left").select("doc_id", "key", "base", "linked")
    out = weak.unionByName(rows.where("size(weak) = 0").select("doc_id", "key", "base", F.lit(None).cast(SPANS).alias("linked")))
    return out.select("doc_id", "key", in_order(F.col("base")).alias("base"), in_order(F.concat("base", F.coalesce("linked", F.array().cast(SPANS)))).alias("found"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """doc_id, text: texts with every span of :func:`scan` replaced."""
    found = scan(docs, id_col, text_col).where("size(found) > 0").select("key", "found").dropDuplicates(["key"])
    text = text_of(text_col)
    rows = spread_join(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.md5(text).alias("key")), found, "key", ["doc_id"], how="left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.substr("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        add = F.when(s["start"] >= acc["at"], F.concat(piece, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    done = F.aggregate("found", begin, cut, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.coalesce(done, F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )
