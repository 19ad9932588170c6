"""Titles and stances; a part stands for a position, whose title is picked from a list by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import stance as S
from loomspark.operators import integrity as I
from loomspark.plans.registry import query
from loomspark.plans.tuning import pick
from loomspark.sources.tables import read

TITLES = [
    "Støtte til projektet og en god ide", "Modstand mod nedrivning af palads", "Ønske om bevaring af skolens boldbane", "Bekymring for støj og trafik på vejen", "Krav om flere parkering pladser",
    "Bevare den gamle bygning", "Flyt cykelsti til anden side/", "Stoppe høj bygning på 30 meter", "Høring: proces og inddragelse", "Vej: adgang til skole", "Kritik af planen, nej til hotel",
    "§ 4. veje og stier", "Kapitel 3: anvendelse", "1.2 bebyggelsens omfang", "bilag 2 facader", "Sikre grøn natur og træer", "positiv overfor projektet men imod nedrivning", "Ros af dialog og proces",
    "Opbakning til forslag om biograf", "Risiko for tab af kulturarv", "Parkering og bilparkering i området", "Ændre facade og arkitektur i klimaets navn", "Fjern støjgener og larm fra gl. køge landevej", "",
]
CONSEQUENCES = ["Ønske om bevaring. Mere", "Bekymring mod støj", "Kritik", "Krav om parkering", "Modstand mod støj.", "", "Støtter planen", "ønsker noget vedr. trafik"]
_T = f"t AS (SELECT p_partkey AS id, p_brand AS theme, {TITLES}[p_partkey % {len(TITLES)} + 1] AS title, {TITLES}[p_partkey // 3 % {len(TITLES)} + 1] AS summary, {CONSEQUENCES}[p_partkey % {len(CONSEQUENCES)} + 1] AS consequence FROM part)"


def titled(spark, d):
    third = F.element_at(F.array(*map(F.lit, TITLES)), (F.floor(F.col("p_partkey") / 3) % len(TITLES) + 1).cast("int"))
    rows = read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("theme"), pick(TITLES, "p_partkey").alias("title"), third.alias("summary"), pick(CONSEQUENCES, "p_partkey").alias("consequence")
    )
    return rows


def _hits(text, patterns):
    return "(" + " + ".join(f"CAST(regexp_matches({text}, '{p}') AS INT)" for p in patterns) + ")"


def _contained(text, words):
    return f"list_filter({words}, lambda w: contains({text}, w))"


@query("stance_directions", f"""WITH {_T}, f AS (SELECT id, string_split_regex(lower(title), '\\s+')[1] AS w FROM t)
SELECT id, CASE {' '.join(f"WHEN w IN ({', '.join(repr(x) for x in ws)}) THEN '{n}'" for n, ws in S.FIRST_WORDS.items())} END AS direction FROM f""")
def stance_directions(spark, d):
    return titled(spark, d).select("id", S.stance_direction("title").alias("direction"))


@query("stance_prefixes", f"""WITH {_T}, p AS (SELECT id, title, trim(string_split(title, ':')[1]) AS head, string_split_regex(title, '\\s+') AS w, '{S.PREFIX[5:-1]}' AS s FROM t),
q AS (SELECT CASE WHEN contains(title, ':') AND length(head) >= 5 THEN head WHEN regexp_matches(title, '(?i)^(' || s || ')') AND len(w) >= 2 THEN array_to_string(w[:3], ' ') END AS prefix, id FROM p)
SELECT prefix, count(*) AS n, min(id) AS first FROM q WHERE prefix IS NOT NULL GROUP BY prefix""")
def stance_prefixes(spark, d):
    return titled(spark, d).select("id", S.stance_prefix("title").alias("prefix")).where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("plan_stances", f"""WITH {_T}, h AS (SELECT id, {_hits("lower(title || ' ' || summary)", S.PLAN_FOR)} AS f, {_hits("lower(title || ' ' || summary)", S.PLAN_AGAINST)} AS a FROM t)
SELECT id, CASE WHEN f > a * 1.5 THEN 'support' WHEN a > f * 1.5 THEN 'against' ELSE 'neutral' END AS stance FROM h""")
def plan_stances(spark, d):
    return titled(spark, d).select("id", S.plan_stance(F.concat_ws(" ", "title", "summary")).alias("stance"))


@query("tagged_stances", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'support' WHEN p_partkey % 4 = 1 THEN 'against' WHEN p_partkey % 3 = 0 THEN 'support' WHEN p_partkey % 3 = 1 THEN 'against' ELSE 'neutral' END AS stance FROM part")
def tagged_stances(spark, d):
    tags = ["support", "against", "neutral", "x"]
    return titled(spark, d).select("id", S.tagged_stance(F.element_at(F.array(*map(F.lit, tags)), (F.col("id") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, tags)), (F.col("id") % 3 + 1).cast("int"))).alias("stance"))


_SAID = f"""u AS (SELECT id, title, lower(title) AS a, lower(summary) AS b FROM t), v AS (SELECT id, title, {_hits("a", S.SAID_FOR)} AS f1, {_hits("a", S.SAID_AGAINST)} AS a1, {_hits("b", S.SAID_FOR)} AS f2, {_hits("b", S.SAID_AGAINST)} AS a2 FROM u),
s AS (SELECT id, CASE WHEN f1 > a1 THEN 'for' WHEN a1 > f1 THEN 'against' ELSE 'neutral' END AS s1, CASE WHEN f2 > a2 THEN 'for' WHEN a2 > f2 THEN 'against' ELSE 'neutral' END AS s2 FROM v)"""


@query("said_stances", f"WITH {_T}, {_SAID} SELECT id, s1 AS stance FROM s")
def said_stances(spark, d):
    return titled(spark, d).select("id", S.said_stance("title").alias("stance"))


@query("stance_conflicts", f"WITH {_T}, {_SAID} SELECT id, (s1 = 'for' AND s2 = 'against') OR (s1 = 'against' AND s2 = 'for') AS conflict FROM s")
def stance_conflicts(spark, d):
    return titled(spark, d).select("id", S.conflict(S.said_stance("title"), S.said_stance("summary")).alias("conflict"))


@query("title_sentiments", f"""WITH {_T}, c AS (SELECT id, len({_contained("lower(title)", S.GOOD)}) + len({_contained("lower(summary)", S.GOOD)}) AS g, len({_contained("lower(title)", S.BAD)}) + len({_contained("lower(summary)", S.BAD)}) AS b FROM t)
SELECT id, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' ELSE 'neutral' END AS sentiment,
 round(CAST(CASE WHEN g + b = 0 THEN 0.3 WHEN g > b * 2 THEN least(0.9, 0.5 + g * 0.1) WHEN b > g * 2 THEN least(0.9, 0.5 + b * 0.1) WHEN g = b THEN 0.4 ELSE 0.5 END AS DOUBLE), 6) AS confidence FROM c""")
def title_sentiments(spark, d):
    found = S.sentiment(F.array("title", "summary"))
    return titled(spark, d).select("id", found["sentiment"].alias("sentiment"), F.round(found["confidence"], 6).alias("confidence"))


_OBJECTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{n}' END" for n, p in S.OBJECTS.items()) + "], lambda o: o IS NOT NULL)"


@query("title_objects", f"""WITH {_T}, x AS (SELECT id, lower(title || ' ' || summary) AS x FROM t), o AS (SELECT id, {_OBJECTS} AS objects FROM x)
SELECT id, array_to_string(objects, ',') AS objects, array_to_string(list_filter(objects, lambda o: o NOT IN ('støj', 'trafik', 'adgangsforhold')), ',') AS physical FROM o""")
def title_objects(spark, d):
    rows = titled(spark, d).select("id", S.objects(F.col("title"), F.col("summary")).alias("o"))
    return rows.select("id", F.array_join("o", ",").alias("objects"), F.array_join(S.physical(F.col("o")), ",").alias("physical"))


_CLEAN = "trim(title)"
for _p in [r"^§\s*[0-9]+\.?\s*", r"(?i)^kapitel\s+[0-9]+[\.:\s]*", r"^[0-9]+(?:\.[0-9]+)*\.?\s+", r"(?i)^stk\.?\s*[0-9]+\.?\s*", r"(?i)^bilag\s*[0-9]*\.?\s*"]:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '')"


@query("clean_themes", f"WITH {_T}, c AS (SELECT id, title, trim({_CLEAN}) AS x FROM t) SELECT id, CASE WHEN x = '' THEN title ELSE upper(substr(x, 1, 1)) || substr(x, 2) END AS theme FROM c")
def clean_themes(spark, d):
    return titled(spark, d).select("id", S.clean_theme("title").alias("theme"))


_PLAIN = r"trim(regexp_replace(regexp_replace(lower({}), '^(ønske om|modstand mod|krav om|støtte til|bekymring for)\s*', ''), '[^a-zæøå0-9\s]', '', 'g'))"


@query("plain_titles", f"WITH {_T} SELECT id, {_PLAIN.format('title')} AS plain, array_to_string({_contained('lower(title)', S.TOPICS)}, ',') AS topics FROM t")
def plain_titles(spark, d):
    return titled(spark, d).select("id", S.plain_title("title").alias("plain"), F.array_join(S.topics("title"), ",").alias("topics"))


@query("overlapping_titles", f"""WITH {_T}, p AS (SELECT id, {_PLAIN.format('title')} AS a, {_PLAIN.format('summary')} AS b, {_contained('lower(title)', S.TOPICS)} AS ka, {_contained('lower(summary)', S.TOPICS)} AS kb FROM t),
w AS (SELECT *, list_distinct(list_filter(string_split_regex(a, '\\s+'), lambda x: length(x) > 3)) AS wa, list_distinct(list_filter(string_split_regex(b, '\\s+'), lambda x: length(x) > 3)) AS wb FROM p)
SELECT id, (a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR (len(wa) > 0 AND len(wb) > 0 AND len(list_intersect(wa, wb)) / CAST(len(list_distinct(wa || wb)) AS DOUBLE) >= 0.5)))
 OR len(list_filter(list_intersect(ka, kb), lambda k: len(list_filter({S.SHARED_TOPICS}, lambda s: contains(k, s))) > 0)) > 0 AS overlap FROM w""")
def overlapping_titles(spark, d):
    rows = titled(spark, d).select("id", S.plain_title("title").alias("a"), S.plain_title("summary").alias("b"), S.topics("title").alias("ka"), S.topics("summary").alias("kb"))
    return rows.select("id", S.overlapping(F.col("a"), F.col("b"), F.col("ka"), F.col("kb")).alias("overlap"))


@query("repeated_words", r"""WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '\s+')) AS w FROM conversations), c AS (SELECT conv_id, turn, w FROM w WHERE length(w) > 4 GROUP BY ALL HAVING count(*) >= 2)
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY w) AS words FROM c GROUP BY ALL""")
def repeated_words(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(S.repeated_words("text"), " ").alias("words")).where("words <> ''").distinct()


_VERB = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN regexp_replace(title, '{p}', '{n.replace('$', chr(92))}')" for p, n in S.VERBS) + " ELSE title END"


@query("fixed_titles", f"""WITH {_T}, v AS (SELECT id, title, CASE WHEN id % 3 = 0 THEN 'contra' WHEN id % 3 = 1 THEN 'pro_status_quo' ELSE 'pro_change' END AS direction, regexp_replace({_VERB}, '/\\.?$', '') AS x FROM t)
SELECT id, CASE WHEN title = '' THEN '' WHEN {' OR '.join(f"starts_with(lower(x), '{p}')" for p in S.PREFIXES)} THEN x ELSE
 CASE WHEN direction = 'pro_status_quo' AND regexp_matches(lower(trim(x)), '^(bekymring|frygt|risiko|problem)') THEN 'Bekymring for' WHEN direction = 'contra' THEN 'Modstand mod' ELSE 'Ønske om' END || ' ' || lower(substr(x, 1, 1)) || substr(x, 2) END AS fixed FROM v""")
def fixed_titles(spark, d):
    direction = F.when(F.col("id") % 3 == 0, "contra").when(F.col("id") % 3 == 1, "pro_status_quo").otherwise("pro_change")
    return titled(spark, d).select("id", S.fixed_title("title", direction).alias("fixed"))


_DIM = "list_filter([" + ", ".join(f"CASE WHEN len(list_filter({ws}, lambda w: contains(x, w))) > 0 THEN '{n}' END" for n, ws in S.DIMENSIONS.items()) + "], lambda o: o IS NOT NULL)"


@query("reasoning_dimensions", f"WITH {_T}, x AS (SELECT id, lower(title || ' ' || summary) AS x FROM t), o AS (SELECT id, {_DIM} AS o FROM x) SELECT id, o[1] AS dimension, array_to_string(o, ',') AS dimensions FROM o")
def reasoning_dimensions(spark, d):
    rows = titled(spark, d).select("id", S.dimensions(F.concat_ws(" ", "title", "summary")).alias("o"))
    return rows.select("id", F.get("o", F.lit(0)).alias("dimension"), F.array_join("o", ",").alias("dimensions"))


@query("key_concepts", f"WITH {_T} SELECT id, array_to_string(list_filter(string_split_regex(summary, '[\\s,()]+'), lambda w: length(w) > 3 AND NOT list_contains({S.STOP + S.GENERIC}, w))[:10], ',') AS concepts FROM t")
def key_concepts(spark, d):
    return titled(spark, d).select("id", F.array_join(S.concepts("summary"), ",").alias("concepts"))


@query("authority_matches", rf"""WITH {_T}, w AS (SELECT id, list_filter(string_split_regex(lower(title), '[\s\-]+'), lambda w: length(w) > 2 AND NOT list_contains({S.SMALL}, w)) AS a, list_filter(string_split_regex(lower(summary), '[\s\-]+'), lambda w: length(w) > 2 AND NOT list_contains({S.SMALL}, w)) AS b FROM t),
m AS (SELECT id, list_distinct(a || flatten(list_transform(a, lambda w: list_filter({S.ROOTS}, lambda r: contains(w, r) AND w <> r)))) AS a, list_distinct(b || flatten(list_transform(b, lambda w: list_filter({S.ROOTS}, lambda r: contains(w, r) AND w <> r)))) AS b FROM w)
SELECT id, coalesce(array_to_string(list_sort(list_filter(a, lambda x: len(list_filter(b, lambda y: x = y OR (length(x) >= 4 AND length(y) >= 4 AND (contains(x, y) OR contains(y, x))))) > 0)), ','), '') AS words FROM m""")
def authority_matches(spark, d):
    return titled(spark, d).select("id", F.array_join(F.array_sort(S.matched(S.matchable("title"), S.matchable("summary"))), ",").alias("words"))


_CONS = f"""c AS (SELECT id, theme, trim(regexp_extract(lower(consequence), '(?:ønsk|krav|modstand|bekymr).*?(?:om|mod|vedr\\.?)\\s*(.+?)(?:\\.|$)', 1)) AS k,
  CASE WHEN contains(lower(consequence), 'ønsk') OR contains(lower(consequence), 'støtt') OR contains(lower(consequence), 'krav om') THEN 'positive' WHEN contains(lower(consequence), 'modstand') OR contains(lower(consequence), 'bekymr') OR contains(lower(consequence), 'kritik') THEN 'negative' ELSE 'neutral' END AS dir FROM t),
g AS (SELECT id, theme, CASE WHEN k = '' THEN 'general' ELSE k END AS kind, dir FROM c)"""


@query("consequence_groups", f"""WITH {_T}, {_CONS}, m AS (SELECT theme, kind, count(DISTINCT dir) AS dirs FROM g GROUP BY ALL)
SELECT theme, kind, CASE WHEN dirs > 1 THEN dir END AS dir, count(*) AS n, min(id) AS first FROM g JOIN m USING (theme, kind) GROUP BY ALL""")
def consequence_groups(spark, d):
    found = S.consequence("consequence")
    rows = titled(spark, d).select("id", "theme", found["type"].alias("kind"), found["direction"].alias("dir"))
    return I.by_consequence(rows, ["theme"], "kind", "dir").groupBy("theme", "kind", "dir").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_DIRS = ["pro_change", "pro_status_quo", "neutral", "x", "pro_change"]
_DIR = f"""a AS (SELECT p_brand AS theme, p_partkey AS id, CASE {_DIRS}[p_partkey // 7 % 5 + 1] WHEN 'pro_change' THEN 'support' WHEN 'pro_status_quo' THEN 'oppose' ELSE 'neutral' END AS direction FROM part)"""


def directed(spark, d):
    raw = F.element_at(F.array(*map(F.lit, _DIRS)), (F.floor(F.col("p_partkey") / 7) % 5 + 1).cast("int"))
    return read(spark, d, "part").select(F.col("p_brand").alias("theme"), F.col("p_partkey").alias("id"), S.argument_direction(raw).alias("direction"))


@query("tagged_arguments", f"WITH {_DIR} SELECT * FROM a")
def tagged_arguments(spark, d):
    return directed(spark, d)


@query("direction_split", f"WITH {_DIR} SELECT theme, count_if(direction = 'support') AS support, count_if(direction = 'oppose') AS oppose, count_if(direction = 'neutral') AS neutral FROM a GROUP BY theme")
def direction_split(spark, d):
    return I.direction_counts(directed(spark, d), "theme", "direction")


@query("others_buckets", f"""WITH {_DIR}, n AS (SELECT theme, count_if(direction = 'support') AS s, count_if(direction = 'against') AS g, count_if(direction NOT IN ('support', 'against')) AS u, count(*) AS n FROM a GROUP BY theme)
SELECT theme, 'Øvrige synspunkter om ' || theme AS title, n, CASE WHEN s >= g AND s >= u THEN 'support' WHEN g >= u THEN 'against' ELSE 'neutral' END AS dominant FROM n""")
def others_buckets(spark, d):
    return I.others_bucket(directed(spark, d), "theme", "direction")
