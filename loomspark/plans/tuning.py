"""Parameters of runs; a part stands for a run or a position, its key gives the figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import tuning as T
from loomspark.plans.registry import query
from loomspark.sources.tables import read

KINDS = ["lokalplan", "dispensation", "kommuneplan", "politik"]
STATUS = ["NO_DATA", "LOW", "HIGH_CONCENTRATION", "VERY_HIGH_CONCENTRATION"]
STEPS = ["edge-case-screening", "micro-summarize", "embedding", "hybrid-writing", "other", "considerations"]
FOCUS_TITLES = ["Støj fra vejen", "Bygningens højde", "Flytte boldbanen", "Om planen", "Skole og bolig"]
_RUNS = """s AS (SELECT p_partkey AS id, (p_partkey * 7) % 700 AS responses, (p_partkey * 13) % 800 AS avg_length, CAST((p_partkey * 17) % 100 AS DOUBLE) / 100 AS diversity,
  (p_partkey * 3) % 13 AS themes, (p_partkey * 11) % 900 AS positions, CAST((p_partkey * 19) % 100 AS DOUBLE) / 100 AS concentration FROM part)"""
_COMPLEX = _RUNS + """,
v AS (SELECT *, CAST(CASE WHEN responses <= 5 THEN 0.1 WHEN responses <= 20 THEN 0.3 WHEN responses <= 50 THEN 0.5 WHEN responses <= 150 THEN 0.7 ELSE 1 END AS DOUBLE)
    * CAST(CASE WHEN diversity < 0.3 THEN 0.4 WHEN diversity < 0.4 THEN 0.6 WHEN diversity < 0.5 THEN 0.8 ELSE 1 END AS DOUBLE) AS vol,
  CAST(CASE WHEN avg_length < 50 THEN 0.1 WHEN avg_length < 150 THEN 0.3 WHEN avg_length < 300 THEN 0.5 WHEN avg_length < 600 THEN 0.7 ELSE 1 END AS DOUBLE) AS len,
  CAST(CASE WHEN themes <= 2 THEN 0.2 WHEN themes <= 4 THEN 0.4 WHEN themes <= 6 THEN 0.6 WHEN themes <= 10 THEN 0.8 ELSE 1 END AS DOUBLE) AS th FROM s),
w AS (SELECT *, CASE WHEN diversity < 0.35 THEN vol * 0.20 + len * 0.25 + diversity * 0.40 + th * 0.15 ELSE vol * 0.35 + len * 0.25 + diversity * 0.25 + th * 0.15 END AS raw FROM v),
x AS (SELECT *, CASE WHEN diversity < 0.3 AND raw > 0.45 THEN CAST(0.45 AS DOUBLE) ELSE raw END AS score FROM w),
c AS (SELECT *, CASE WHEN score < 0.15 THEN 'trivial' WHEN score < 0.30 THEN 'simple' WHEN score < 0.45 THEN 'moderate' WHEN score < 0.65 THEN 'complex' ELSE 'very_complex' END AS category,
  CASE WHEN score < 0.15 THEN CASE WHEN score < 0.05 THEN 'low' WHEN score < 0.10 THEN 'mid' ELSE 'high' END
       WHEN score < 0.30 THEN CASE WHEN score < 0.20 THEN 'low' WHEN score < 0.25 THEN 'mid' ELSE 'high' END
       WHEN score < 0.45 THEN CASE WHEN score < 0.35 THEN 'low' WHEN score < 0.40 THEN 'mid' ELSE 'high' END
       WHEN score < 0.65 THEN CASE WHEN score < 0.52 THEN 'low' WHEN score < 0.58 THEN 'mid' ELSE 'high' END
       ELSE CASE WHEN score < 0.77 THEN 'low' WHEN score < 0.88 THEN 'mid' ELSE 'high' END END AS part FROM x)"""


def pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def runs(spark, d):
    p = F.col("p_partkey")
    share = lambda n: (p * n % 100).cast("double") / 100
    return read(spark, d, "part").select(
        p.alias("id"), (p * 7 % 700).alias("responses"), (p * 13 % 800).alias("avg_length"), share(17).alias("diversity"), (p * 3 % 13).alias("themes"), (p * 11 % 900).alias("positions"), share(19).alias("concentration")
    )


def complex_runs(spark, d):
    c = T.complexity(F.col("responses"), F.col("avg_length"), F.col("diversity"), F.col("themes"))
    return runs(spark, d).withColumns(c)


@query("run_complexity", f"WITH {_COMPLEX} SELECT id, round(score, 6) AS score, category, part, category IN ('trivial', 'simple') OR (category = 'moderate' AND diversity < 0.4) AS across FROM c")
def run_complexity(spark, d):
    return complex_runs(spark, d).select("id", F.round("score", 6).alias("score"), "category", "part", "across")


_BASE = " ".join(f"WHEN category = '{c}' AND part = '{p}' THEN {v}" for c, row in T.MERGE.items() for p, v in zip(("low", "mid", "high"), row))
_MERGE = _COMPLEX + f""",
r AS (SELECT *, positions / CAST(greatest(responses, 1) AS DOUBLE) AS ratio, CASE WHEN id % 9 = 0 THEN CAST(id % 20 AS DOUBLE) / 100 + 0.7 END AS recommended, CAST(CASE {_BASE} END AS DOUBLE) AS b0 FROM c),
b AS (SELECT *, b0 - CAST(CASE WHEN ratio > 3 THEN 0.06 WHEN ratio > 2 THEN 0.04 WHEN ratio > 1.5 THEN 0.02 ELSE 0 END AS DOUBLE)
   - CAST(CASE WHEN diversity < 0.3 THEN CASE WHEN responses > 50 THEN 0.05 WHEN responses > 20 THEN 0.06 ELSE 0.08 END WHEN diversity < 0.35 THEN 0.04 WHEN diversity < 0.5 THEN 0.02 WHEN diversity > 0.7 THEN -0.03 ELSE 0 END AS DOUBLE) AS base FROM r),
t AS (SELECT *, CASE WHEN recommended IS NOT NULL THEN greatest(0.78, recommended) WHEN responses <= 10 THEN CASE WHEN ratio > 2 THEN 0.72 ELSE 0.75 END WHEN responses <= 20 THEN CASE WHEN ratio > 2 THEN 0.75 ELSE 0.78 END
   ELSE greatest(CASE WHEN responses <= 30 THEN 0.72 ELSE 0.78 END, least(0.92, base)) END AS within FROM b)"""


def merged_runs(spark, d):
    recommended = F.when(F.col("id") % 9 == 0, (F.col("id") % 20).cast("double") / 100 + 0.7)
    within = T.merge_threshold(F.col("category"), F.col("part"), F.col("diversity"), F.col("positions"), F.col("responses"), recommended)
    return complex_runs(spark, d).withColumn("within", within)


@query("merge_thresholds", f"WITH {_MERGE} SELECT id, round(within, 6) AS within FROM t")
def merge_thresholds(spark, d):
    return merged_runs(spark, d).select("id", F.round("within", 6).alias("within"))


@query("across_thresholds", f"""WITH {_MERGE} SELECT id, round(CASE WHEN responses <= 10 THEN least(0.90, greatest(0.78, within + 0.03)) WHEN responses <= 20 THEN least(0.90, greatest(0.80, within + 0.04))
 WHEN responses > 500 AND concentration > 0.5 THEN 0.65 WHEN responses > 100 AND concentration > 0.6 THEN 0.70 WHEN concentration > 0.7 THEN 0.75 ELSE least(0.92, greatest(0.83, within + 0.05)) END, 6) AS across FROM t""")
def across_thresholds(spark, d):
    return merged_runs(spark, d).select("id", F.round(T.across_threshold(F.col("within"), F.col("responses"), F.col("concentration")), 6).alias("across"))


@query("argument_duplicate_thresholds", f"""WITH {_COMPLEX} SELECT id, CAST(CASE WHEN category IN ('trivial', 'simple') THEN 0.88 WHEN category = 'moderate' AND part = 'low' THEN 0.90 WHEN category = 'moderate' AND part = 'mid' THEN 0.92
 WHEN category = 'moderate' THEN 0.93 ELSE 0.95 END AS DOUBLE) AS threshold FROM c""")
def argument_duplicate_thresholds(spark, d):
    return complex_runs(spark, d).select("id", T.duplicate_threshold(F.col("category"), F.col("part")).alias("threshold"))


@query("across_strategies", f"""WITH {_COMPLEX}, q AS (SELECT *, {STATUS}[id % 4 + 1] AS status, id * 23 % 60 AS dominant, CASE WHEN id % 6 = 0 THEN CAST(id % 100 AS DOUBLE) / 100 END AS agreement FROM c)
SELECT id, CASE WHEN status <> 'NO_DATA' AND (status = 'VERY_HIGH_CONCENTRATION' OR (status = 'HIGH_CONCENTRATION' AND concentration > 0.6) OR dominant >= 40) THEN 'selective' WHEN agreement > 0.7 THEN 'full'
 WHEN category IN ('trivial', 'simple') THEN 'full' WHEN category = 'moderate' THEN CASE WHEN diversity < 0.4 THEN 'full' ELSE 'selective' END WHEN category = 'complex' AND part = 'low' AND diversity < 0.35 THEN 'selective' ELSE 'none' END AS strategy FROM q""")
def across_strategies(spark, d):
    agreement = F.when(F.col("id") % 6 == 0, (F.col("id") % 100).cast("double") / 100)
    out = T.across_strategy(F.col("category"), F.col("part"), F.col("diversity"), pick(STATUS, "id"), F.col("concentration"), F.col("id") * 23 % 60, agreement)
    return complex_runs(spark, d).select("id", out.alias("strategy"))


_AGREE = _RUNS + """, m AS (SELECT *, CAST(diversity < 0.35 AS INT) + CAST(id % 3 = 0 AS INT) + CAST(concentration > 0.6 AS INT) + CAST(CAST(id * 29 % 100 AS DOUBLE) / 100 > 0.75 AS INT) AS n, concentration > 0.6 AS large FROM s)"""


def agreeing(spark, d):
    mean = (F.col("id") * 29 % 100).cast("double") / 100
    return runs(spark, d).withColumns(T.mass_agreement(F.col("diversity"), F.col("id") % 3 == 0, F.col("concentration"), mean))


@query("mass_agreement", f"WITH {_AGREE} SELECT id, n / 4.0 AS confidence, n >= 2 AS detected, large FROM m")
def mass_agreement(spark, d):
    return agreeing(spark, d).select("id", "confidence", "detected", "large")


@query("agreement_adjustments", f"""WITH {_AGREE} SELECT id, CASE WHEN n > 3 THEN 'full' WHEN n > 2 THEN 'selective' END AS consolidation, CASE WHEN n > 3 THEN 'aggressive' WHEN n > 2 THEN 'moderate' END AS grouping,
 CAST(CASE WHEN n > 3 THEN 0.8 WHEN n > 2 THEN 0.6 END AS DOUBLE) AS reduction, CASE WHEN n >= 2 AND large THEN 50 END AS batch, CASE WHEN n >= 2 THEN 3 END AS least_sub, CAST(CASE WHEN n >= 2 THEN 0.75 END AS DOUBLE) AS theme_threshold FROM m""")
def agreement_adjustments(spark, d):
    changes = T.agreement_adjustments(F.col("detected"), F.col("confidence"), F.col("large"))
    return agreeing(spark, d).select("id", *[c.alias(n) for n, c in changes.items()])


@query("copy_detection", f"""WITH {_RUNS}, l AS (SELECT id, id * 7 % 60 AS n, CAST(CASE WHEN id % 5 >= 3 THEN 0.4 WHEN id % 5 >= 2 THEN 0.25 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN id % 3 >= 1 THEN 0.3 ELSE 0 END AS DOUBLE)
   + CAST(CASE WHEN {KINDS}[id % 4 + 1] IN ('lokalplan', 'miljørapport', 'kommuneplan') THEN 0.3 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN avg_length > 500 THEN 0.2 WHEN avg_length > 200 THEN 0.1 ELSE 0 END AS DOUBLE) AS p FROM s)
SELECT id, round(CASE WHEN n >= 5 THEN p END, 6) AS likelihood, n >= 5 AND (p >= 0.4 OR n <= 30) AS enabled, CAST(CASE WHEN n >= 5 THEN CASE WHEN p >= 0.7 THEN 0.70 WHEN p >= 0.5 THEN 0.78 ELSE 0.85 END END AS DOUBLE) AS threshold FROM l""")
def copy_detection(spark, d):
    i = F.col("id")
    found = T.copy_detection(i * 7 % 60, i % 5, i % 3, F.col("avg_length"), pick(KINDS, "id"))
    return runs(spark, d).select("id", F.round(found["likelihood"], 6).alias("likelihood"), found["enabled"].alias("enabled"), found["threshold"].alias("threshold"))


@query("aggregation_tiers", f"""WITH {_RUNS}, e AS (SELECT id, CASE WHEN themes > 0 THEN CAST(ceil(positions / CAST(themes AS DOUBLE)) AS BIGINT) ELSE positions END AS each FROM s)
SELECT id, each, CASE WHEN each <= 100 THEN 'small' WHEN each <= 500 THEN 'medium' ELSE 'large' END AS tier, CAST(ceil(sqrt(each) * 0.8) AS BIGINT) AS clusters, least(200, CAST(ceil(each * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS sample FROM e""")
def aggregation_tiers(spark, d):
    return runs(spark, d).select("id", *[c.alias(n) for n, c in T.tier(F.col("positions"), F.col("themes")).items()])


_FOCI = "(" + " + ".join(f"CAST(len(list_filter(titles, lambda t: len(list_filter({w}, lambda w: contains(lower(t), w))) > 0)) > 0 AS INT)" for w in T.FOCI.values()) + ")"
_PARTS = _RUNS + f""", t AS (SELECT *, id % 25 AS n, id % 4 AS merges, list_distinct([{FOCUS_TITLES}[id % 5 + 1], {FOCUS_TITLES}[id // 2 % 5 + 1]])[:id % 3] AS titles, id % 7 = 0 AS agreement, CASE WHEN id % 4 > 0 THEN diversity / 2 END AS dv FROM s)"""


def parting(spark, d):
    i = F.col("id")
    titles = F.array_distinct(F.array(pick(FOCUS_TITLES, "id"), F.element_at(F.array(*map(F.lit, FOCUS_TITLES)), (F.floor(i / 2) % 5 + 1).cast("int"))))
    return runs(spark, d).withColumns({"n": i % 25, "merges": i % 4, "titles": F.slice(titles, 1, (i % 3).cast("int")), "agreement": i % 7 == 0, "dv": F.when(i % 4 > 0, F.col("diversity") / 2)})


@query("several_foci", f"WITH {_PARTS} SELECT id, len(titles) >= 2 AND {_FOCI} >= 2 AS several FROM t")
def several_foci(spark, d):
    return parting(spark, d).select("id", T.several_foci(F.col("titles")).alias("several"))


@query("parts_wanted", f"""WITH {_PARTS} SELECT id, coalesce(dv > 0.35, false) OR merges >= 3 OR len(titles) >= 3 OR (agreement AND n > 5) OR (concentration > 0.6 AND coalesce(dv > 0.25, false))
 OR (merges = 1 AND n > 10 AND (coalesce(dv > 0.25, false) OR concentration > 0.6)) OR (merges >= 2 AND coalesce(dv > 0.2, false)) OR (n >= 5 AND len(titles) >= 2 AND {_FOCI} >= 2) AS wanted FROM t""")
def parts_wanted(spark, d):
    out = T.parts_wanted(*[F.col(c) for c in ("n", "merges", "titles", "agreement", "concentration", "dv")])
    return parting(spark, d).select("id", out.alias("wanted"))


@query("parts_bounds", f"""WITH {_PARTS}, r AS (SELECT *, responses % 90 AS k FROM t) SELECT id, CASE WHEN concentration > 0.8 OR (agreement AND k > 30) OR k > 40 THEN 4 ELSE 2 END AS least,
 CASE WHEN k > 40 THEN least(15, greatest(8, CAST(ceil(k / 5) AS INT))) WHEN concentration > 0.8 THEN 15 WHEN agreement AND k > 30 THEN 12 ELSE 8 END AS most, CASE WHEN agreement THEN 'nuanced' ELSE 'standard' END AS strategy FROM r""")
def parts_bounds(spark, d):
    out = T.parts_bounds(F.col("responses") % 90, F.col("agreement"), F.col("concentration"))
    return parting(spark, d).select("id", *[c.alias(n) for n, c in out.items()])


@query("step_batches", f"""WITH {_RUNS}, b AS (SELECT id, {STEPS}[id % 6 + 1] AS step, CASE WHEN id % 5 > 0 THEN CAST(avg_length * 9 AS DOUBLE) END AS chars FROM s),
k AS (SELECT id, step, CASE step WHEN 'edge-case-screening' THEN 8 WHEN 'micro-summarize' THEN 3 WHEN 'hybrid-writing' THEN 5 WHEN 'considerations' THEN 30 ELSE 1 END + coalesce(floor(chars / 1000), 0) AS sec,
  coalesce(ceil(chars / 4) + CASE step WHEN 'micro-summarize' THEN 300 WHEN 'edge-case-screening' THEN 100 WHEN 'hybrid-writing' THEN 800 ELSE 0 END, 0) AS tok FROM b),
f AS (SELECT id, step, CASE WHEN step = 'embedding' THEN greatest(sec, 5) ELSE sec END AS sec, tok FROM k)
SELECT id, step, CAST(greatest(5, least(floor({10_000 / 60 * 0.6!r}::DOUBLE * sec), CASE WHEN tok > 0 THEN floor({200_000 / 60 * 0.6!r}::DOUBLE * sec / tok) END, 500)) AS BIGINT) AS size FROM f""")
def step_batches(spark, d):
    chars = F.when(F.col("id") % 5 > 0, (F.col("avg_length") * 9).cast("double"))
    return runs(spark, d).withColumn("step", pick(STEPS, "id")).select("id", "step", T.step_batch_size(F.col("step"), chars).alias("size"))


@query("chunk_sizes", f"WITH {_RUNS} SELECT id, CAST(floor((id * 1000 + 8000 - avg_length - 2000) * 4 * CAST(0.8 AS DOUBLE)) AS BIGINT) AS size FROM s")
def chunk_sizes(spark, d):
    return runs(spark, d).select("id", T.chunk_size(F.col("id") * 1000 + 8000, F.col("avg_length")).alias("size"))


@query("skipped_validations", f"""WITH {_COMPLEX}, y AS (SELECT id, responses % 40 AS n, positions % 30 AS k, CASE WHEN id % 5 > 0 THEN concentration END AS ratio, category FROM c),
z AS (SELECT id, CASE WHEN n <= 20 AND k / CAST(greatest(n, 1) AS DOUBLE) > 1 THEN NULL WHEN n <= 5 AND k <= n THEN 'tiny' WHEN ratio < 0.4 THEN 'consolidated' WHEN category = 'very_complex' THEN 'very complex' WHEN k <= 3 THEN 'few' END AS why FROM y)
SELECT id, why IS NOT NULL AS skip, why FROM z""")
def skipped_validations(spark, d):
    out = T.skip_validation(F.col("positions") % 30, F.col("responses") % 40, F.when(F.col("id") % 5 > 0, F.col("concentration")), F.col("category"))
    return complex_runs(spark, d).select("id", out["skip"].alias("skip"), out["why"].alias("why"))


@query("theme_workload", """
WITH n AS (SELECT p_brand AS theme, count(*) AS positions FROM part GROUP BY 1), e AS (SELECT *, least(CAST(floor(positions * (positions - 1) / 2 * CAST(0.3 AS DOUBLE)) AS BIGINT), 100) AS calls FROM n),
a AS (SELECT sum(calls) AS calls, count(*) AS themes FROM e),
b AS (SELECT CASE WHEN calls < 50 THEN least(themes, 6) WHEN calls < 200 THEN least(themes, 4) WHEN calls < 500 THEN 3 ELSE 2 END AS theme_concurrency, CASE WHEN calls < 50 THEN 25 WHEN calls < 200 THEN 20 WHEN calls < 500 THEN 15 ELSE 10 END AS base FROM a)
SELECT theme, positions, e.calls, theme_concurrency, CAST(CASE WHEN positions < 15 THEN least(30, floor(base * 1.5 + 0.5)) WHEN positions < 40 THEN base WHEN positions < 100 THEN greatest(8, floor(base * 0.7 + 0.5)) ELSE greatest(5, floor(base * 0.5 + 0.5)) END AS BIGINT) AS at_once
FROM e CROSS JOIN b""")
def theme_workload(spark, d):
    themes = read(spark, d, "part").groupBy(F.col("p_brand").alias("theme")).agg(F.count("*").alias("positions")).withColumn("calls", T.workload(F.col("positions")))
    whole = themes.agg(F.sum("calls").alias("all_calls"), F.count("*").alias("themes"))  # one row
    whole = whole.select(*[c.alias(n) for n, c in T.concurrency(F.col("all_calls"), F.col("themes")).items()])
    return themes.join(F.broadcast(whole)).select("theme", "positions", "calls", "theme_concurrency", T.theme_concurrency(F.col("positions"), F.col("base")).alias("at_once"))
