"""Themes of runs and texts of arguments; a brand stands for a run, a part for an argument."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import arguments as A
from loomspark.functions import stance as S
from loomspark.functions import tuning as P
from loomspark.operators import graph
from loomspark.operators import integrity as I
from loomspark.operators import themes as M
from loomspark.plans.registry import query
from loomspark.plans.stance import _T, _hits, titled
from loomspark.plans.tuning import _RUNS, pick, runs
from loomspark.sources.tables import checkpointed, read

THEMES = [
    "Lokalplanens formål", "Områdets anvendelse", "Veje og stier", "Bebyggelsens omfang og placering", "Bebyggelsens ydre fremtræden", "Ubebyggede arealer", "Støj og forurening", "Parkering", "Grundejerforening", "Retsvirkninger",
]
REFS = ["lp_§3_anvendelse", "§5", "lp-6", "§4", "x", "LP_§8_støj", "§12", "facade mod gaden", "§9 og §2", "LP_7_Friarealer"]
KINDS = ["Borger", "Lokaludvalg", "Offentlig myndighed", "", "Grundejerforening"]
_THEMES = f"""th AS (SELECT DISTINCT p_brand AS run, i AS pos, {THEMES}[i] AS name FROM part CROSS JOIN (SELECT unnest(range(1, {len(THEMES) + 1})) AS i) WHERE (ascii(right(p_brand, 1)) + i) % 3 > 0)"""
_ARGS = f"""a AS (SELECT t.theme AS run, id, lower(title || ' ' || summary) AS content, [{REFS}[id % {len(REFS)} + 1], {REFS}[id // 10 % {len(REFS)} + 1]][:id % 3] AS refs FROM t)"""
_IND = " UNION ALL ".join(f"SELECT {n} AS rank, {ws} AS ws, '{w}' AS need" for n, (ws, w) in enumerate(M.INDICATORS))
_SEC = " UNION ALL ".join(f"SELECT {k} AS num, {v} AS needs" for k, v in M.SECTIONS.items())
_BY_REFS = f"""{_THEMES}, {_ARGS}, ind AS ({_IND}), sec AS ({_SEC}),
rf AS (SELECT run, id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS spot FROM a),
wd AS (SELECT run, id, 0 AS kind, spot, rank, [need] AS needs FROM rf JOIN ind ON len(list_filter(ws, lambda w: contains(replace(lower(ref), '_', ' '), w))) > 0
 UNION ALL SELECT run, id, 1, num, 0, needs FROM rf JOIN sec ON try_cast(regexp_extract(ref, '[§_-]([0-9]+)', 1) AS INT) = num WHERE NOT regexp_matches(ref, '(?i)_(ydre|omfang|anvendelse|parkering|ubebyggede|veje|støj)')),
br AS (SELECT id, arg_min(name, (kind, spot, rank, pos)) AS theme FROM wd JOIN th USING (run) WHERE len(list_filter(needs, lambda w: contains(lower(name), w))) > 0 GROUP BY id)"""
_BY_CONTENT = rf"""pc AS (SELECT id, name, pos, content, string_split_regex(lower(name), '\s+') AS w FROM a JOIN th USING (run) WHERE trim(content) <> ''),
rc AS (SELECT *, CASE WHEN len(list_filter({M.PRESERVE}, lambda k: contains(content, k))) > 0 AND len(list_filter({M.PRESERVED}, lambda k: contains(lower(name), k))) > 0 THEN 0
  WHEN len(list_filter(w, lambda x: length(x) > 3 AND contains(content, x))) >= least(2, len(w)) THEN 1 END AS r FROM pc),
bc AS (SELECT id, arg_min(name, (r, pos)) AS theme FROM rc WHERE r IS NOT NULL GROUP BY id)"""


def run_themes(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("run")).distinct()
    rows = rows.select("run", F.posexplode(F.array(*map(F.lit, THEMES))).alias("i", "name")).withColumn("pos", F.col("i") + 1)
    return rows.where((F.ascii(F.substring("run", -1, 1)) + F.col("pos")) % 3 > 0).select("run", "pos", "name")


def arguments(spark, d):
    rows = titled(spark, d)
    other = F.element_at(F.array(*map(F.lit, REFS)), (F.floor(F.col("id") / 10) % len(REFS) + 1).cast("int"))
    refs = F.slice(F.array(pick(REFS, "id"), other), 1, (F.col("id") % 3).cast("int"))
    return rows.select(F.col("theme").alias("run"), "id", F.lower(F.concat_ws(" ", "title", "summary")).alias("content"), refs.alias("refs"))


@query("themes_by_references", f"WITH {_T}, {_BY_REFS} SELECT * FROM br")
def themes_by_references(spark, d):
    return M.by_references(arguments(spark, d), run_themes(spark, d), "run", "id", "refs", "name")


@query("themes_by_content", f"WITH {_T}, {_THEMES}, {_ARGS}, {_BY_CONTENT} SELECT * FROM bc")
def themes_by_content(spark, d):
    return M.by_content(arguments(spark, d), run_themes(spark, d), "run", "id", "content", "name")


@query("mapped_themes", f"""WITH {_T}, {_BY_REFS}, {_BY_CONTENT}
SELECT a.run, a.id, coalesce(br.theme, bc.theme, '{M.REST}') AS theme, CASE WHEN br.theme IS NOT NULL THEN 'references' WHEN bc.theme IS NOT NULL THEN 'content' ELSE 'rest' END AS rule FROM a LEFT JOIN br USING (id) LEFT JOIN bc USING (id)""")
def mapped_themes(spark, d):
    return M.mapped(arguments(spark, d), run_themes(spark, d), "run", "id", "refs", "content", "name")


@query("closest_headers", rf"""WITH {_T}, {_THEMES}, p AS (SELECT DISTINCT t.theme AS run, title, lower(trim(title)) AS x, lower(name) AS y, name, pos FROM t JOIN th ON th.run = t.theme),
w AS (SELECT *, list_filter(string_split_regex(x, '\s+'), lambda v: length(v) > 2) AS wx, list_filter(string_split_regex(y, '\s+'), lambda v: length(v) > 2) AS wy FROM p),
s AS (SELECT *, CASE WHEN greatest(len(wx), len(wy)) > 0 THEN len(list_filter(wx, lambda v: list_contains(wy, v))) / CAST(greatest(len(wx), len(wy)) AS DOUBLE) ELSE 0 END AS o FROM w),
r AS (SELECT *, CASE WHEN x = y THEN 3.0 WHEN contains(x, y) OR contains(y, x) THEN 2.0 WHEN o >= 0.5 THEN o END AS sc FROM s)
SELECT run, title, arg_min(name, (-sc, pos)) AS header FROM r WHERE sc IS NOT NULL GROUP BY ALL""")
def closest_headers(spark, d):
    names = titled(spark, d).select(F.col("theme").alias("run"), "title")
    return M.closest_header(names, run_themes(spark, d).withColumnRenamed("name", "header"), "run", "title", "header").select("run", "title", "header")


@query("argument_texts", rf"""WITH {_T} SELECT id, concat_ws(' - ', nullif(title, ''), nullif(consequence, '')) AS embedding_text, lower(concat_ws(' | ', nullif(title, ''), nullif(summary, ''), nullif(consequence, ''))) AS key,
 length(title) + length(summary) + length(consequence) AS chars, lower(trim(regexp_replace(summary, '\s+', ' ', 'g'))) AS folded, CAST(ceil(length(summary) / 4) AS BIGINT) AS tokens,
 upper(substr(trim(coalesce(nullif(consequence, ''), nullif(title, ''), 'Holdning')), 1, 1)) || substr(trim(coalesce(nullif(consequence, ''), nullif(title, ''), 'Holdning')), 2) AS title FROM t""")
def argument_texts(spark, d):
    t, s, c = F.col("title"), F.col("summary"), F.col("consequence")
    return titled(spark, d).select(
        "id", A.embedding_text(t, c).alias("embedding_text"), A.argument_key(t, s, c).alias("key"), A.char_count(t, s, c).alias("chars"), A.folded(s).alias("folded"), A.tokens(s).alias("tokens"), A.built_title(c, t).alias("title")
    )


@query("named_entities", f"""SELECT c_custkey, length(trim(n)) > 0 OR len(list_filter({A.ENTITIES}, lambda e: contains(lower(k), e))) > 0 AS named FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN ' ' ELSE '' END AS n, {KINDS}[c_custkey % 5 + 1] AS k FROM customer)""")
def named_entities(spark, d):
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.col("c_name")).when(k == 1, " ")
    return read(spark, d, "customer").select("c_custkey", A.is_named_entity(name, F.when(F.col("c_custkey") % 5 != 3, pick(KINDS, "c_custkey"))).alias("named"))


@query("search_words", "SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> ''), ' ') AS words FROM benchmark")
def search_words(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(A.search_words(F.col("text")), " ").alias("words"))


@query("known_references", f"""WITH {_T}, {_ARGS} SELECT id, array_to_string(list_filter(list_distinct(refs), lambda r: list_contains(['§5', '§4', '§12', 'lp-6'], r)), ',') IS NOT NULL AS ok, len(list_filter(list_distinct(refs), lambda r: list_contains(['§5', '§4', '§12', 'lp-6'], r))) AS n FROM a""")
def known_references(spark, d):
    known = F.array(*map(F.lit, ["§5", "§4", "§12", "lp-6"]))
    return arguments(spark, d).select("id", F.lit(True).alias("ok"), F.size(A.known_refs(F.col("refs"), known)).cast("long").alias("n"))


@query("direction_breakdown", """WITH a AS (SELECT p_brand AS position, CASE WHEN p_partkey % 4 = 0 THEN 'support' WHEN p_partkey % 4 = 1 THEN 'against' WHEN p_partkey % 4 = 2 THEN 'unknown' ELSE 'neutral' END AS direction FROM part) SELECT position, direction, count(*) AS n FROM a GROUP BY ALL""")
def direction_breakdown(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "support").when(k == 1, "against").when(k == 3, "neutral")
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("position"), F.coalesce(raw, F.lit("unknown")).alias("direction")).agg(F.count("*").alias("n"))


@query("executed_merges", """WITH RECURSIVE m AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS s FROM lineitem), p AS (SELECT DISTINCT id FROM m), e AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON b.id = a.id + 1 WHERE a.id % 4 > 1),
ed AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), w AS (SELECT id AS n, id AS l FROM p UNION SELECT ed.y, w.l FROM w JOIN ed ON ed.x = w.n), c AS (SELECT n, min(l) AS position FROM w GROUP BY n)
SELECT position, count(DISTINCT n) AS merged, count(DISTINCT s) AS members FROM c JOIN m ON m.id = c.n GROUP BY position""")
def executed_merges(spark, d):
    members = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("s")).distinct()
    nodes = checkpointed(members.select("id").distinct())
    edges = nodes.where("id % 4 > 1").join(nodes.select((F.col("id") - 1).alias("before")), F.col("id") == F.col("before")).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graph.components(nodes, edges, "id").withColumnRenamed("component", "position")
    return found.join(members, "id").groupBy("position").agg(F.count_distinct("id").alias("merged"), F.count_distinct("s").alias("members"))


_TEXT = "lower(title || ' ' || consequence)"


@query("conditional_arguments", f"WITH {_T} SELECT id, {_hits(_TEXT, S.CONDITIONS)} > 0 AND {_hits(_TEXT, S.SUPPORT)} = 0 AS conditional FROM t")
def conditional_arguments(spark, d):
    return titled(spark, d).select("id", S.is_conditional(F.concat_ws(" ", "title", "consequence")).alias("conditional"))


@query("object_words", rf"""WITH {_T} SELECT id, array_to_string(list_filter(string_split_regex(lower(summary), '[\s,.\-:;()"'']+'), lambda w: length(w) > 4 AND NOT list_contains({S.NO_OBJECTS}, w))[:10], ',') AS words FROM t""")
def object_words(spark, d):
    return titled(spark, d).select("id", F.array_join(S.object_words("summary"), ",").alias("words"))


@query("object_counts", f"WITH {_T} SELECT theme, nullif(consequence, '') AS object, count(*) AS n FROM t GROUP BY ALL")
def object_counts(spark, d):
    return I.object_counts(titled(spark, d).withColumnRenamed("consequence", "object"), "theme", "object")


@query("first_references", "SELECT l_suppkey, l_returnflag, l_linestatus, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2, 3")
def first_references(spark, d):
    return I.first_references(read(spark, d, "lineitem"), "l_suppkey", ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("next_citation", "SELECT max(CAST(regexp_extract(c_name, '^Customer#([0-9]+)$', 1) AS BIGINT)) + 1 AS next FROM customer")
def next_citation(spark, d):
    return I.next_citation(read(spark, d, "customer"), "c_name", "Customer#")


@query("cache_keys", """SELECT conv_id, turn, sha256('{"f0":"' || role || '","f1":' || turn || '}') AS key FROM conversations""")
def cache_keys(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", I.cache_key(F.col("role"), F.col("turn")).alias("key"))


@query("embedding_calls", f"""WITH {_RUNS}, c AS (SELECT id, themes, responses, CASE WHEN responses <= 20 THEN 8 WHEN responses <= 100 THEN 5 WHEN responses <= 300 THEN 4 ELSE 3 END AS c FROM s), e AS (SELECT *, CASE WHEN themes > 5 THEN greatest(2, c - 1) ELSE c END AS calls FROM c)
SELECT id, calls, least(3, CAST(ceil(calls / 2) AS INT)) AS theme_calls, CASE WHEN responses < 100 THEN 4 WHEN responses < 500 THEN 5 WHEN responses < 1000 THEN 6 ELSE 8 END AS attempts, CASE WHEN responses < 100 THEN 50 WHEN responses < 500 THEN 40 WHEN responses < 1000 THEN 30 ELSE 25 END AS batch,
 CASE WHEN responses < 100 THEN 200 WHEN responses < 500 THEN 300 WHEN responses < 1000 THEN 400 ELSE 500 END AS pause, CASE WHEN responses < 100 THEN 3 WHEN responses < 500 THEN 4 WHEN responses < 1000 THEN 5 ELSE 6 END AS batch_tries FROM e""")
def embedding_calls(spark, d):
    found = {**P.embedding_calls(F.col("responses"), F.col("themes")), **P.embedding_retries(F.col("responses"))}
    return runs(spark, d).select("id", *[c.alias(n) for n, c in found.items()])


@query("theme_thresholds", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN greatest(CAST(0.72 AS DOUBLE), CAST(0.7 AS DOUBLE) + CAST(p_partkey % 20 AS DOUBLE) / 100 - CAST(0.06 AS DOUBLE)) ELSE CAST(0.7 AS DOUBLE) + CAST(p_partkey % 20 AS DOUBLE) / 100 END AS threshold FROM part")
def theme_thresholds(spark, d):
    p = F.col("p_partkey")
    return read(spark, d, "part").select(p.alias("id"), P.theme_threshold(pick(["Andre emner", "Generelt", "Parkering"], "p_partkey"), F.lit(0.7) + (p % 20).cast("double") / 100).alias("threshold"))
