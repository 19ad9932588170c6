"""Consolidation and attribution; vectors stand for positions or arguments, their labels for themes, conversations for quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import arguments as A
from loomspark.operators import consolidation as C
from loomspark.plans.registry import query
from loomspark.plans.stance import CONSEQUENCES, TITLES
from loomspark.plans.themes import _ARGS, _T, _THEMES, arguments, run_themes
from loomspark.plans.tuning import pick
from loomspark.sources.tables import read

REASONS = ["Bygningen er alt for høj her", "ikke specificeret", "", "  kort ", "Trafikken på vejen bliver værre"]
LABELS = ["To borgere mener", "én borger", "Hele 21 borgere og tre borgere", "respondenterne", "5 borgere", "Tretten borgere ønsker", "", "Kun en borger, to borgere", "tretteborgere"]
QUOTED = ["[MANGLER citat]", "", "sourceQuote ikke tilgængelig"]
_V = f"v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, ['support', 'against', 'neutral'][vec_id % 3 + 1] AS stance, {REASONS}[vec_id % {len(REASONS)} + 1] AS why, vec_id % 25 = 0 AS head, {TITLES}[vec_id % {len(TITLES)} + 1] AS title FROM embeddings)"


def vectors(spark, d):
    i = F.col("vec_id")
    stance = F.element_at(F.array(*map(F.lit, ["support", "against", "neutral"])), (i % 3 + 1).cast("int"))
    return read(spark, d, "embeddings").select(i.alias("id"), "label", F.col("embedding").alias("v"), stance.alias("stance"), pick(REASONS, "vec_id").alias("why"), (i % 25 == 0).alias("head"), pick(TITLES, "vec_id").alias("title"))


_NEAR = """p AS (SELECT a.id, h.id AS place, list_cosine_similarity(a.v, h.v) AS sim, {free} AS free FROM v a JOIN v h ON a.label = h.label AND h.head WHERE NOT a.head),
b AS (SELECT id, max(sim) FILTER (WHERE free) AS sim, arg_max(place, sim) FILTER (WHERE free) AS place FROM p GROUP BY id)"""


@query("skeleton_attribution", f"""WITH {_V}, {_NEAR.format(free="NOT (a.stance = 'support' AND h.stance = 'against' OR a.stance = 'against' AND h.stance = 'support')")}
SELECT v.id, CASE WHEN sim >= 0.2 AND sim > 0.1 THEN place END AS place, round(sim, 6) AS sim FROM v LEFT JOIN b ON b.id = v.id WHERE NOT v.head""")
def skeleton_attribution(spark, d):
    rows = vectors(spark, d)
    heads = rows.where("head").select("label", F.col("id").alias("place"), F.col("v").alias("centroid"), "stance")
    return C.attributed(rows.where("not head"), heads, "label", "id", "v", "place", 0.2, 0.1, "stance").withColumn("sim", F.round("sim", 6))


@query("centroid_attribution", f"""WITH {_V}, {_NEAR.format(free="true")}
SELECT v.id, CASE WHEN sim >= 0.15 AND length(trim(why)) >= 15 AND lower(trim(why)) <> 'ikke specificeret' THEN place END AS place FROM v LEFT JOIN b ON b.id = v.id WHERE NOT v.head""")
def centroid_attribution(spark, d):
    rows = vectors(spark, d)
    heads = rows.where("head").select("label", F.col("id").alias("place"), F.col("v").alias("centroid"))
    rest = rows.where("not head").withColumn("v", F.when(C.reasoned(F.col("why")), F.col("v")))
    return C.attributed(rest, heads, "label", "id", "v", "place", 0.15).select("id", "place")


@query("theme_link_pairs", f"""WITH {_V}, r AS (SELECT id, label, lower(trim(title)) AS t, CASE WHEN id % 4 = 0 THEN id % 7 END AS single, v FROM v),
fi AS (SELECT t, label, min(id) AS f FROM r WHERE t <> '' GROUP BY ALL), tw AS (SELECT t, min(f) AS f1, arg_min(label, f) AS l1 FROM fi GROUP BY t HAVING count(*) > 1),
t2 AS (SELECT tw.*, (SELECT min(f) FROM fi WHERE fi.t = tw.t AND fi.label <> tw.l1) AS f2 FROM tw),
s AS (SELECT DISTINCT least(id, CASE WHEN label = l1 THEN f2 ELSE f1 END) AS i, greatest(id, CASE WHEN label = l1 THEN f2 ELSE f1 END) AS j, CAST(1 AS DOUBLE) AS sim FROM r JOIN t2 USING (t)),
n AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS sim FROM r a JOIN r b ON a.id < b.id AND a.label <> b.label WHERE NOT coalesce(a.single = b.single, false))
SELECT i, j, round(max(sim), 6) AS sim FROM (SELECT * FROM s UNION ALL SELECT * FROM n WHERE sim >= 0.35) GROUP BY i, j""")
def theme_link_pairs(spark, d):
    i = F.col("id")
    members = F.when(i % 4 == 0, F.array(i % 7)).otherwise(F.array(i % 7, i % 7 + 1))
    return C.theme_links(vectors(spark, d).withColumn("m", members), "id", "label", "title", "m", "v", 0.30).withColumn("sim", F.round("sim", 6))


_SCORE = """th2 AS (SELECT *, (pos * 7 + ascii(right(run, 1))) % 4 AS c FROM (SELECT * REPLACE (CASE WHEN pos = 9 THEN 'Andre emner' WHEN pos % 4 = 2 THEN '§ ' || pos || ' ' || name ELSE name END AS name) FROM th)),
po AS (SELECT run, id, content, CASE WHEN id % 3 = 0 THEN (SELECT name FROM th2 x WHERE x.run = a.run AND x.pos = a.id % 10 + 1) WHEN id % 3 = 1 THEN 'unknown' END AS o FROM a),
sc AS (SELECT run, id, pos, name, name = o AS own, CASE WHEN name <> 'Andre emner' AND c > 0 THEN 2 * len(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: length(w) > 3 AND contains(content, w))) + CASE WHEN starts_with(name, '§') THEN 3 ELSE 0 END + c * 0.5 END AS s FROM po JOIN th2 USING (run))"""


@query("best_themes", f"""WITH {_T}, {_THEMES}, {_ARGS}, {_SCORE} SELECT run, id, coalesce(arg_min(name, pos) FILTER (WHERE own), arg_min(name, (-s, pos)) FILTER (WHERE s IS NOT NULL), arg_min(name, pos) FILTER (WHERE name = 'Andre emner'), arg_min(name, pos)) AS theme FROM sc GROUP BY run, id""")
def best_themes(spark, d):
    pos = F.col("pos")
    name = F.when(pos == 9, "Andre emner").when(pos % 4 == 2, F.concat(F.lit("§ "), pos.cast("string"), F.lit(" "), F.col("name"))).otherwise(F.col("name"))
    themes = run_themes(spark, d).withColumn("name", name).withColumn("n", (pos * 7 + F.ascii(F.substring("run", -1, 1))) % 4)
    rows = arguments(spark, d).withColumn("p", F.col("id") % 10 + 1)
    own = rows.join(themes.select("run", F.col("pos").alias("p"), F.col("name").alias("__own")), ["run", "p"], "left")
    rows = own.withColumn("o", F.when(F.col("id") % 3 == 0, F.col("__own")).when(F.col("id") % 3 == 1, "unknown"))
    return C.best_theme(rows, themes, "run", "id", "content", "o", "name", "n")


_LONG = r"list_filter(string_split_regex(lower({}), '\s+'), lambda w: length(w) > 3)"


@query("best_groups", f"""WITH {_T}, o AS (SELECT theme AS run, id, title || ' ' || summary AS text, consequence FROM t WHERE id % 6 = 0),
m AS (SELECT theme AS run, id AS spot, id % 5 AS grp, title || ' ' || summary AS text, consequence FROM t WHERE id % 6 <> 0),
g AS (SELECT run, grp, arg_min(text, spot) AS title, arg_min(consequence, spot) AS c, count(*) AS n FROM m GROUP BY ALL),
w AS (SELECT run, id, unnest({_LONG.format('text')}) AS w FROM o), wn AS (SELECT run, id, w, count(*) AS n FROM w GROUP BY ALL),
ti AS (SELECT id, g.grp, 2 * sum(wn.n) AS s FROM wn JOIN g ON wn.run = g.run AND list_contains({_LONG.format('g.title')}, w) GROUP BY ALL),
co AS (SELECT id, m.grp, sum(wn.n) / any_value(g.n) AS s FROM wn JOIN m ON wn.run = m.run AND list_contains({_LONG.format('m.text')}, w) JOIN g ON g.run = m.run AND g.grp = m.grp GROUP BY ALL),
st AS (SELECT id, grp, 3 AS s FROM o JOIN g USING (run) WHERE len(list_filter({C.STANCES}, lambda x: contains(lower(o.consequence), x) AND contains(lower(g.c), x))) > 0),
sc AS (SELECT id, grp, round(sum(s), 9) AS s FROM (SELECT id, grp, CAST(s AS DOUBLE) AS s FROM ti UNION ALL SELECT id, grp, CAST(s AS DOUBLE) FROM co UNION ALL SELECT id, grp, CAST(s AS DOUBLE) FROM st) GROUP BY ALL),
al AS (SELECT o.id, g.grp, coalesce(s, 0) AS s FROM o JOIN g USING (run) LEFT JOIN sc ON sc.id = o.id AND sc.grp = g.grp)
SELECT id, arg_min(grp, (-s, grp)) AS grp FROM al GROUP BY id""")
def best_groups(spark, d):
    from loomspark.plans.stance import titled

    rows = titled(spark, d).select(F.col("theme").alias("run"), "id", F.concat_ws(" ", "title", "summary").alias("text"), "consequence", (F.col("id") % 5).alias("grp"))
    members = rows.where("id % 6 <> 0").withColumnRenamed("id", "at")
    groups = members.groupBy("run", "grp").agg(F.min_by("text", "at").alias("title"))
    return C.best_group(rows.where("id % 6 = 0").drop("grp"), groups, members, "run", "id", "grp", "text", "title", "consequence")


@query("argument_registry", f"""WITH {_T}, k AS (SELECT theme, id, id % 4 AS grp, lower(concat_ws(' | ', nullif(title, ''), nullif(summary, ''), nullif(consequence, ''))) AS content FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY theme, grp, content ORDER BY id) AS r FROM k WHERE length(content) >= 30)
SELECT id, theme, content, row_number() OVER (ORDER BY theme, id) - 1 AS number FROM f WHERE r = 1""")
def argument_registry(spark, d):
    from loomspark.plans.stance import titled

    rows = titled(spark, d).select("theme", "id", (F.col("id") % 4).alias("grp"), A.argument_key(F.col("title"), F.col("summary"), F.col("consequence")).alias("content"))
    return C.registry(rows, "theme", ["id"], ["theme", "grp"], "content").drop("grp")


@query("cross_theme_duplicates", """WITH e AS (SELECT vec_id AS id, label AS theme, vec_id % 3 AS member, 's' || vec_id % 60 AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT *, first_value(id) OVER (PARTITION BY member, s ORDER BY theme, id) AS first FROM e)
SELECT id, NOT EXISTS (SELECT 1 FROM e x WHERE x.member = f.member AND x.s = f.s AND (x.theme, x.id) < (f.theme, f.id) AND list_cosine_similarity(x.v, f.v) >= 0.05) AS kept, first FROM f""")
def cross_theme_duplicates(spark, d):
    i = F.col("vec_id")
    rows = read(spark, d, "embeddings").select(i.alias("id"), F.col("label").alias("theme"), (i % 3).alias("member"), F.concat(F.lit("s"), (i % 60).cast("string")).alias("s"), "embedding")
    return C.across_duplicates(rows, "member", "s", ["theme", "id"], "id", "embedding", 0.05)


_WORD = "CASE WHEN k BETWEEN 1 AND 12 THEN ['Én', 'To', 'Tre', 'Fire', 'Fem', 'Seks', 'Syv', 'Otte', 'Ni', 'Ti', 'Elleve', 'Tolv'][k] ELSE CAST(k AS VARCHAR) END || CASE WHEN k = 1 THEN ' borger' ELSE ' borgere' END"
_HIT = " ".join(f"WHEN regexp_matches(lower(l), '(^|[^\\p{{L}}]){C._counted(n)}([^\\p{{L}}]|$)') THEN {n + 1}" for n in sorted(range(len(C.COUNTED)), key=lambda n: (-len(C.COUNTED[n]), n)))
_PUT = " ".join(f"WHEN regexp_matches(l, '(?i)(^|[^\\p{{L}}]){C._counted(n)}([^\\p{{L}}]|$)') THEN regexp_replace(l, '(^|[^\\p{{L}}]){C._counted(n)}([^\\p{{L}}]|$)', '\\1' || w || '\\2', 'i')" for n in range(len(C.COUNTED)))


@query("citation_map_labels", f"""WITH e AS (SELECT p_partkey AS id, {LABELS}[p_partkey % {len(LABELS)} + 1] AS l, list_filter([p_size, p_partkey % 9, p_size], lambda x: x % 2 = 0 OR x > 30) || range(CAST(p_partkey % 15 AS BIGINT)) AS m FROM part),
f AS (SELECT id, l, list_sort(list_distinct(list_filter(m, lambda x: x < 35))) AS members FROM e WHERE l <> ''),
k AS (SELECT *, len(members) AS k FROM f WHERE len(members) > 0), w AS (SELECT *, {_WORD} AS w, CASE {_HIT} ELSE try_cast(nullif(regexp_extract(lower(l), '(^|[^\\d])(\\d+)\\s+borgere?([^\\p{{L}}]|$)', 2), '') AS INT) END AS c FROM k)
SELECT id, members, CASE WHEN c IS NULL OR c = k THEN l ELSE CASE {_PUT} ELSE regexp_replace(l, '(\\d+)\\s+(borgere?)', w, 'i') END END AS label FROM w""")
def citation_map_labels(spark, d):
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    some = F.filter(F.array(size, p % 9, size), lambda x: (x % 2 == 0) | (x > 30))
    upto = F.when(p % 15 > 0, F.sequence(F.lit(0).cast("long"), F.greatest(p % 15 - 1, F.lit(0)))).otherwise(F.array().cast("array<long>"))
    rows = read(spark, d, "part").select(p.alias("id"), pick(LABELS, "p_partkey").alias("label"), F.concat(some, upto).alias("members"))
    return C.citation_map(rows, "label", "members", F.sequence(F.lit(0).cast("long"), F.lit(34).cast("long"))).withColumn("members", F.array_sort("members"))


_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("quote_origins", f"""WITH c AS (SELECT conv_id, turn, text FROM conversations), s AS (SELECT conv_id, text AS src FROM c WHERE turn % 2 = 0), x AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM c GROUP BY 1),
q AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN {QUOTED}[conv_id % 3 + 1] WHEN 2 THEN upper(text) WHEN 3 THEN substr(text, 3, 30) ELSE reverse(text) END AS q FROM c),
r AS (SELECT conv_id, turn, trim(q) AS q FROM q WHERE length(q) > 0),
n AS (SELECT r.conv_id, r.turn, bool_or(trim(src) = q) AS e, bool_or(CASE WHEN greatest(length(src), length(q)) = 0 THEN true ELSE len(list_filter(string_split(CASE WHEN length(src) <= length(q) THEN src ELSE q END, ''), lambda c: c <> '' AND contains(CASE WHEN length(src) <= length(q) THEN q ELSE src END, c))) / greatest(length(src), length(q)) > 0.8 END) AS m
 FROM r JOIN s USING (conv_id) WHERE length(trim(src)) > 0 GROUP BY ALL)
SELECT r.conv_id, r.turn, CASE WHEN contains(q, '[MANGLER') OR contains(q, 'sourceQuote ikke tilgængelig') THEN 'placeholder' WHEN e THEN 'exact' WHEN m THEN 'modified' WHEN contains(t, q) OR contains({{t}}, {{q}}) THEN 'in_source' ELSE 'not_in_source' END AS status
FROM r LEFT JOIN n ON n.conv_id = r.conv_id AND n.turn = r.turn LEFT JOIN x ON x.conv_id = r.conv_id""".replace("{t}", _NORM.format("t")).replace("{q}", _NORM.format("q")))
def quote_origins(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    t, text = F.col("turn") % 5, F.col("text")
    q = F.when(t == 0, text).when(t == 1, F.element_at(F.array(*map(F.lit, QUOTED)), (F.col("conv_id") % 3 + 1).cast("int"))).when(t == 2, F.upper(text)).when(t == 3, F.substring(text, 3, 30)).otherwise(F.reverse(text))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("whole"))
    own = c.where("turn % 2 = 0").select("conv_id", F.col("text").alias("source"))
    return C.quote_origins(c.withColumn("q", q), own, whole, ["conv_id", "turn"], "conv_id", "q", "source", "whole")


ISSUES = ["empty", "misaligned", "malformed"]
_REPORT = """c AS (SELECT l_suppkey AS s, l_quantity < 2 AS empty, l_linenumber = 7 AND l_tax > 0.07 AS misaligned, l_discount > 0.099 AS malformed FROM lineitem WHERE l_suppkey % 4 > 0),
p AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 6 <> 1 THEN s_suppkey % 6 END AS m FROM supplier),
r AS (SELECT p.s, coalesce(any_value(m), 0) AS m, count(c.s) AS n, count(*) FILTER (WHERE empty) AS empty, count(*) FILTER (WHERE misaligned) AS misaligned, count(*) FILTER (WHERE malformed) AS malformed FROM p LEFT JOIN c ON c.s = p.s GROUP BY p.s),
o AS (SELECT s, CASE WHEN m > 0 THEN n ELSE 0 END AS citations, m > 0 AND n > 0 AND empty + misaligned + malformed = 0 AS valid, CASE WHEN m > 0 AND n = 0 THEN m ELSE 0 END AS missing,
 CASE WHEN m > 0 THEN empty ELSE 0 END AS empty, CASE WHEN m > 0 THEN misaligned ELSE 0 END AS misaligned, CASE WHEN m > 0 THEN malformed ELSE 0 END AS malformed FROM r)"""


@query("position_report", f"WITH {_REPORT} SELECT * FROM o")
def position_report(spark, d):
    s = F.col("s_suppkey")
    positions = read(spark, d, "supplier").select(s.alias("s"), F.when(s % 6 != 1, s % 6).alias("m"))
    cited = read(spark, d, "lineitem").where("l_suppkey % 4 > 0").select(
        F.col("l_suppkey").alias("s"), (F.col("l_quantity") < 2).alias("empty"), ((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.07)).alias("misaligned"), (F.col("l_discount") > 0.099).alias("malformed"))
    return C.position_report(positions, cited, "s", "m", ISSUES)


@query("analysis_report", f"WITH {_REPORT} SELECT count(*) AS positions, sum(citations) AS citations, bool_and(valid) AS valid, sum(missing) AS missing, sum(empty) AS empty, sum(misaligned) AS misaligned, sum(malformed) AS malformed FROM o")
def analysis_report(spark, d):
    return C.analysis_report(position_report(spark, d), ISSUES)


@query("small_groups")
def small_groups(spark, d):
    return C.small_groups(vectors(spark, d), "label", "id", "title", "v", 0.35, 0.25)[0]


@query("member_variations")
def member_variations(spark, d):
    return C.variations(vectors(spark, d).withColumn("m", F.array(F.col("id") % 4)), "label", "id", "m", "v", 0.30)


@query("text_groups")
def text_groups(spark, d):
    from loomspark.plans.stance import titled

    rows = titled(spark, d).select("id", F.lower(F.concat_ws(" ", "title", "summary")).alias("text"), F.element_at(F.array(*map(F.lit, ["pro_change", "pro_status_quo", "unknown"])), (F.col("id") % 3 + 1).cast("int")).alias("stance"))
    return C.text_groups(rows, "id", "text", "stance")
