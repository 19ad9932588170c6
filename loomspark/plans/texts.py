"""Text queries: tokens, n-grams, similarity, quotes, headers, titles.

Word patterns are the ASCII ones of the functions, which DuckDB's engine shares.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as T
from loomspark.operators import quotes as Q
from loomspark.plans.registry import query
from loomspark.sources.tables import read

_TOK = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\w\sæøå]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_LONG = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\w\sæøå]', ' ', 'g'), '\s+'), lambda w: length(w) > {1})"
_PLAIN = "'" + '"' * 5 + "''" * 5 + "'"  # five double, five single quotes, in SQL's quotes
_NORM = r"lower(translate(trim(regexp_replace({0}, '\s+', ' ', 'g')), '“”„«»‘’‚´`', " + _PLAIN + "))"


@query("token_counts", f"SELECT doc_id, len({_TOK.format('text')}) AS tokens, len(list_distinct({_TOK.format('text')})) AS words FROM documents")
def token_counts(spark, d):
    words = T.tokenize("text")
    return read(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("words"))


@query("ngram_fingerprint", f"""WITH w AS (SELECT doc_id, {_LONG.format('text', 2)} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 4 THEN len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) ELSE 0 END AS grams FROM w""")
def ngram_fingerprint(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.fingerprint("text")).cast("long").alias("grams"))


@query("jaccard_pairs", f"""WITH w AS (SELECT item_id, list_distinct({_LONG.format('text', 3)}) AS w FROM benchmark)
SELECT a.item_id AS i, b.item_id AS j, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS jaccard FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""")
def jaccard_pairs(spark, d):
    # The pairs come from shared words by an equi join, so texts that share none never meet.
    rows = read(spark, d, "benchmark").select("item_id", T.word_set("text", 3).alias("w"))
    words = rows.select("item_id", F.explode("w").alias("word"))
    pairs = words.withColumnRenamed("item_id", "i").join(words.withColumnRenamed("item_id", "j"), "word").where("i < j").groupBy("i", "j").agg(F.count("*").alias("both"))
    size = rows.select("item_id", F.size("w").alias("n"))
    full = pairs.join(size.select(F.col("item_id").alias("i"), F.col("n").alias("a")), "i").join(size.select(F.col("item_id").alias("j"), F.col("n").alias("b")), "j")
    return full.select("i", "j", F.round(F.col("both") / (F.col("a") + F.col("b") - F.col("both")), 6).alias("jaccard"))


@query("overlap_coefficient", f"""WITH b AS (SELECT item_id, list_distinct({_LONG.format('text', 3)}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({_LONG.format('text', 3)}) AS w FROM documents)
SELECT doc_id, round(len(list_intersect(d.w, b.w)) / greatest(least(len(d.w), len(b.w)), 1), 6) AS overlap FROM d CROSS JOIN (SELECT w FROM b ORDER BY item_id LIMIT 1) b""")
def overlap_coefficient(spark, d):
    one = read(spark, d, "benchmark").orderBy("item_id").limit(1).select(T.word_set("text", 3).alias("b"))
    docs = read(spark, d, "documents").select("doc_id", T.word_set("text", 3).alias("w")).join(F.broadcast(one))
    return docs.select("doc_id", F.round(T.overlap(F.col("w"), F.col("b")), 6).alias("overlap"))


@query("normalized_text", f"SELECT doc_id, md5({_NORM.format('text')}) AS digest, length({_NORM.format('text')}) AS n FROM documents")
def normalized_text(spark, d):
    norm = T.normalize_text("text")
    return read(spark, d, "documents").select("doc_id", F.md5(norm).alias("digest"), F.length(norm).cast("long").alias("n"))


@query("quote_found_exact", "SELECT doc_id, item_id, instr(d.text, b.text) AS place FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_found_exact(spark, d):
    return Q.exact_places(read(spark, d, "documents"), read(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query("quote_similarity", f"""WITH p AS (SELECT a.item_id AS i, b.item_id AS j, {_NORM.format('a.text')} AS x, {_NORM.format('b.text')} AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
r AS (SELECT *, least(length(x), length(y)) / CAST(greatest(length(x), length(y), 1) AS DOUBLE) AS size FROM p),
w AS (SELECT *, list_distinct({_TOK.format('x')}) AS u, list_distinct({_TOK.format('y')}) AS v FROM r)
SELECT i, j, round(CASE WHEN x = y THEN 1 WHEN size < 0.5 THEN size / 2 WHEN contains(x, y) OR contains(y, x) THEN 0.9 + size * 0.1
  ELSE len(list_intersect(u, v)) / CAST(len(list_distinct(u || v)) AS DOUBLE) END, 6) AS similarity FROM w""")
def quote_similarity(spark, d):
    b = read(spark, d, "benchmark")
    pairs = b.select(F.col("item_id").alias("i"), F.col("text").alias("x")).join(b.select(F.col("item_id").alias("j"), F.col("text").alias("y")), F.col("j") == F.col("i") + 1)
    return pairs.select("i", "j", F.round(T.quote_similarity("x", "y"), 6).alias("similarity"))


@query("best_sentence", r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents),
n AS (SELECT doc_id, s, CAST(contains(lower(s), 'the') AS INT) + CAST(contains(lower(s), 'and') AS INT) + CAST(contains(lower(s), 'nicht') AS INT) AS hits FROM s),
m AS (SELECT doc_id, max(hits) AS hits FROM n GROUP BY 1)
SELECT doc_id, hits, round(hits / 3.0, 6) AS share FROM m WHERE hits / 3.0 > 0.3""")
def best_sentence(spark, d):
    found = Q.best_sentence(read(spark, d, "documents"), "doc_id", "text", ["the", "and", "nicht"])
    return found.select("doc_id", F.col("hits"), F.round("share", 6).alias("share"))


@query("sentence_counts", r"""SELECT doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS sentences,
 len(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '')) AS paragraphs FROM documents""")
def sentence_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.sentences("text")).cast("long").alias("sentences"), F.size(T.paragraphs("text")).cast("long").alias("paragraphs"))


@query("html_headers", r"SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS headers FROM pages")
def html_headers(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r"<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1)).alias("headers"))


@query("clean_html_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def clean_html_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.collapse(F.regexp_replace("html", "<[^>]*>", " "))).alias("digest"))


@query("section_keys", r"""WITH k AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all('§ ' || (doc_id % 5) || ' og §' || (doc_id % 3) || ' ' || lang, '§\s*([0-9]+)', 1))) AS k FROM documents)
SELECT doc_id, array_to_string(k, '+') AS key FROM k""")
def section_keys(spark, d):
    text = F.concat(F.lit("§ "), (F.col("doc_id") % 5).cast("string"), F.lit(" og §"), (F.col("doc_id") % 3).cast("string"), F.lit(" "), F.col("lang"))
    return read(spark, d, "documents").select("doc_id", T.section_keys(text).alias("key"))


@query("truncated_text", """
WITH h AS (SELECT doc_id, text, substr(text, 1, 400) AS h FROM documents), b AS (SELECT *, 400 - instr(reverse(h), '.') + 1 AS dot, 400 - instr(reverse(h), ',') + 1 AS comma FROM h)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN contains(h, '.') AND dot > 280 THEN substr(h, 1, CAST(dot AS BIGINT)) WHEN contains(h, ',') AND comma > 320 THEN substr(h, 1, CAST(comma AS BIGINT)) ELSE h || '...' END AS short FROM b""")
def truncated_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncate("text", 400).alias("short"))


@query("keyword_classes", """
SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'secret' WHEN contains(lower(text), '@') THEN 'contact' WHEN contains(lower(text), 'license') THEN 'license' ELSE 'plain' END AS kind FROM documents""")
def keyword_classes(spark, d):
    from loomspark.operators.rules import first_keyword

    return read(spark, d, "documents").select("doc_id", first_keyword("text", {"secret": ["token"], "contact": ["@"], "license": ["license"]}, "plain").alias("kind"))


@query("title_rules", """
WITH t AS (SELECT p_partkey, p_name AS title FROM part)
SELECT p_partkey, list_filter([CASE WHEN length(title) < 15 THEN 'too short' END, CASE WHEN contains(title, ':') THEN 'colon' END, CASE WHEN title LIKE '%...' OR title LIKE '%…' THEN 'truncated' END,
  CASE WHEN regexp_matches(title, '^[a-z]') THEN 'lower case start' END], lambda x: x IS NOT NULL) AS errors FROM t""")
def title_rules(spark, d):
    from loomspark.operators.rules import title_errors

    return read(spark, d, "part").select("p_partkey", title_errors(F.col("p_name")).alias("errors"))


@query("edge_case_screen", r"""
SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no-opinion' WHEN length(text) < 40 THEN 'short' WHEN regexp_matches(lower(text), '(see|voir|siehe) ') THEN 'references' ELSE 'analyze' END AS action FROM conversations""")
def edge_case_screen(spark, d):
    from loomspark.operators.rules import screen

    return read(spark, d, "conversations").select("conv_id", "turn", screen("text", 40, "(see|voir|siehe) ").alias("action"))


@query("content_hashes", """SELECT doc_id, substr(sha256(doc_id || '|' || trim(text) || '|' || coalesce(lang, '')), 1, 16) AS hash FROM documents""")
def content_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.trim("text"), F.coalesce("lang", F.lit(""))), 256), 1, 16).alias("hash"))


@query("partition_hashes", """SELECT source, sha256(string_agg(doc_id || ':' || md5(text), '|||' ORDER BY doc_id)) AS hash FROM documents GROUP BY source""")
def partition_hashes(spark, d):
    # Digests, not texts, are gathered: what meets in one row is 40 bytes a document.
    rows = read(spark, d, "documents").select("source", "doc_id", F.md5("text").alias("m"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "m"))), lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["m"]))
    return rows.groupBy("source").agg(F.sha2(F.array_join(parts, "|||"), 256).alias("hash"))


@query("consecutive_roles", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations)
SELECT conv_id, role, min(turn) AS first_turn, count(*) AS run FROM r GROUP BY conv_id, role, g""")
def consecutive_roles(spark, d):
    w = Window.partitionBy("conv_id")
    island = F.row_number().over(w.orderBy("turn")) - F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    rows = read(spark, d, "conversations").withColumn("g", island)
    return rows.groupBy("conv_id", "role", "g").agg(F.min("turn").alias("first_turn"), F.count("*").alias("run")).drop("g")


@query("referenced_text", """
SELECT a.conv_id, a.turn, coalesce(string_agg(b.text, chr(10) ORDER BY b.turn), '') AS before FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn IN (a.turn - 1, a.turn - 2) GROUP BY a.conv_id, a.turn""")
def referenced_text(spark, d):
    rows = read(spark, d, "conversations")
    refs = rows.select("conv_id", "turn", F.posexplode(F.array(F.col("turn") - 2, F.col("turn") - 1)).alias("pos", "ref"))
    other = rows.select("conv_id", F.col("turn").alias("ref"), "text")
    joined = refs.join(other, ["conv_id", "ref"], "left").groupBy("conv_id", "turn")
    packed = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text"))))
    return joined.agg(F.array_join(F.transform(packed, lambda x: x["text"]), "\n").alias("before"))


@query("marker_duplicates", r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3}')) AS marker FROM documents) SELECT doc_id, marker, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) > 2""")
def marker_duplicates(spark, d):
    m = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{3}"), F.lit(0))).alias("marker"))
    return m.groupBy("doc_id", "marker").agg(F.count("*").alias("n")).where("n > 2")


@query("flexible_quotes")
def flexible_quotes(spark, d):
    docs = read(spark, d, "documents").where("doc_id is not null").select("doc_id", "text")
    return Q.flexible(Q.shared_words(docs, read(spark, d, "benchmark"), "doc_id", "item_id"), "text", "quote").select("doc_id", "item_id", "method", "confidence", "start", "end")
