"""Queries over predictions, result tables, ensembles and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.counts_queries import CVNB, GAIN
from strandlab.catalog.registry import query
from strandlab.catalog.learner_queries import _dist
from strandlab.catalog.tables import ATTRS, CUST, FOLDS, INST, LMAP, PAIRS, VEC, class_positions, customers_mixed, label_map, orders_nominal, pair_scores, r6, table, vectors
from strandlab.catalog.tables_queries import _SPLIT, _train_test
from strandlab.operators import counts, decode, neighbors
from strandlab.plans import crossval, ensemble, evaluate, folds, learners, search
from strandlab.session import cut
from strandlab.sources import paths

# -- predictions of the one-attribute rules ------------------------------------

PREDS = f"""
{INST}, c AS (SELECT attr, value, label, count(*) AS w FROM lng GROUP BY ALL),
rule AS (SELECT attr, value, label AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY attr, value ORDER BY w DESC, label) = 1),
preds AS (SELECT lng.attr AS scheme, lng.id AS row_id, lng.label AS actual, predicted FROM lng JOIN rule USING (attr, value))
"""


def preds(spark, d):
    df = orders_nominal(spark, d)
    rule = cut(counts.one_rule_nominal(df, ATTRS).select("attr", "value", "predicted"))
    long = counts.to_long(df, ATTRS, ["id", "label"])
    return long.join(rule, ["attr", "value"]).select(
        F.col("attr").alias("scheme"), F.col("id").alias("row_id"), F.col("label").alias("actual"), "predicted"
    )


@query("agreement", f"WITH {PREDS} SELECT a.scheme AS scheme_x, b.scheme AS scheme_y, count(*) AS n, round(avg(CASE WHEN a.predicted = b.predicted THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM preds a JOIN preds b ON a.row_id = b.row_id AND a.scheme < b.scheme GROUP BY ALL")
def _agreement(spark, d):
    return evaluate.agreement(preds(spark, d)).withColumn("agreement", r6(F.col("agreement")))


@query(
    "confusion_matrix",
    f"""
    WITH {LMAP}, e AS (SELECT event_type AS label, CAST(floor(value / 20) AS BIGINT) AS b FROM events),
    c AS (SELECT b, label, count(*) AS w FROM e GROUP BY ALL),
    r AS (SELECT b, label AS p FROM c QUALIFY row_number() OVER (PARTITION BY b ORDER BY w DESC, label) = 1),
    m AS (SELECT x.canonical AS actual, y.canonical AS predicted FROM e JOIN r USING (b) JOIN lmap x ON x.label = e.label JOIN lmap y ON y.label = r.p)
    SELECT actual, {', '.join(f"CAST(sum(CASE WHEN predicted = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS as_{c}" for c in ('active', 'deal', 'fault'))},
      round(avg(CASE WHEN predicted <> actual THEN 1.0 ELSE 0.0 END), 6) AS error FROM m GROUP BY actual
    """,
)
def _confusion(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor(F.col("value") / 20).alias("b"))
    rule = ensemble.AttributeRule("b", "event_type")
    p = rule.score(e, rule.fit(e)).select(F.col("event_type").alias("actual"), "predicted")
    out = evaluate.confusion_matrix(p, ["active", "deal", "fault"], label_map(spark))
    return out.withColumn("error", r6(F.col("error")))


_SET_PATH = "concat('runs/', d.lang, '/mfcc/', CASE WHEN d.source = 'src1' THEN 'prototype' ELSE 'left_right' END, '/kmeans/', d.n_chars % 4 + 1, '_gaussians/', CASE WHEN d.source = 'src2' THEN 'final' ELSE 'test' END)"


@query(
    "error_by_setting",
    f"""
    WITH p AS (SELECT {_SET_PATH} AS path, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
    s AS (SELECT string_split(path, '/') AS a, quality, toxic FROM p WHERE NOT contains(path, 'prototype') AND NOT contains(path, 'final'))
    SELECT a[-6] AS label_table, CAST(regexp_extract(a[-2], '(\\d+)', 1) AS INTEGER) AS gaussians, count(*) AS n,
      round(avg(CASE WHEN quality = toxic THEN 0.0 ELSE 1.0 END), 6) AS error FROM s GROUP BY ALL
    """,
)
def _by_setting(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").alias("d")
    p = docs.join(table(spark, d, "labels").alias("l"), "doc_id").select(
        F.expr(_SET_PATH).alias("path"), F.col("quality").alias("actual"), F.col("toxic").alias("predicted")
    )
    out = evaluate.error_by_setting(paths.parse_run_identifier(p), ["label_table", "gaussians"])
    return out.withColumn("error", r6(F.col("error")))


@query(
    "mcnemar",
    f"""
    WITH {PREDS}, t AS (SELECT a.scheme AS scheme_x, b.scheme AS scheme_y,
      CAST(sum(CASE WHEN a.predicted = a.actual AND b.predicted = b.actual THEN 1 ELSE 0 END) AS BIGINT) AS both_right,
      CAST(sum(CASE WHEN a.predicted = a.actual AND b.predicted <> b.actual THEN 1 ELSE 0 END) AS BIGINT) AS only_x,
      CAST(sum(CASE WHEN a.predicted <> a.actual AND b.predicted = b.actual THEN 1 ELSE 0 END) AS BIGINT) AS only_y,
      CAST(sum(CASE WHEN a.predicted <> a.actual AND b.predicted <> b.actual THEN 1 ELSE 0 END) AS BIGINT) AS both_wrong
      FROM preds a JOIN preds b ON a.row_id = b.row_id AND a.scheme < b.scheme GROUP BY ALL)
    SELECT *, round(power(abs(only_x - only_y) - 1, 2) / (only_x + only_y), 6) AS statistic, power(abs(only_x - only_y) - 1, 2) / (only_x + only_y) <= 3.841459 AS equivalent FROM t
    """,
)
def _mcnemar(spark, d):
    return evaluate.mcnemar(preds(spark, d)).withColumn("statistic", r6(F.col("statistic")))


@query("bootstrap_diff")
def _bootstrap(spark, d):
    return evaluate.bootstrap_diff(evaluate.outcome_table(preds(spark, d)))


@query(
    "relevant_binary_errors",
    f"""
    WITH {PAIRS}, ref AS (SELECT vec.id AS row_id, vec.label AS actual, class AS predicted FROM dist JOIN vec ON vec.id = row_id QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d2, class) = 1),
    w AS (SELECT r.row_id, x.bit AS want, CASE WHEN ap.score <= 0 THEN -1 ELSE 1 END AS got FROM ref r JOIN apcode x ON x.class = r.actual JOIN apcode y ON y.class = r.predicted AND y.clf = x.clf
          JOIN ap ON ap.row_id = r.row_id AND ap.clf = x.clf WHERE r.actual <> r.predicted AND x.bit * y.bit = -1)
    SELECT row_id, count(*) AS relevant, round(avg(CASE WHEN want <> got THEN 1.0 ELSE 0.0 END), 6) AS wrong_share FROM w GROUP BY row_id
    """,
)
def _relevant(spark, d):
    from strandlab.catalog.tables import centroid_distances

    near = centroid_distances(spark, d).groupBy("row_id").agg(F.min(F.struct("d2", "class"))["class"].alias("predicted"))
    ref = near.join(vectors(spark, d).select(F.col("id").alias("row_id"), F.col("label").alias("actual")), "row_id")
    bits = pair_scores(spark, d).select("row_id", "clf", F.when(F.col("score") <= 0, -1).otherwise(1).alias("bit"))
    out = evaluate.relevant_binary_errors(ref, bits, decode.code_all_pairs(class_positions(spark, d)))
    return out.withColumn("wrong_share", r6(F.col("wrong_share")))


# -- result tables -------------------------------------------------------------

SCHEMES = ["band", "month", "year"]

RES = f"""
{INST}, {FOLDS},
im AS (SELECT finst.id, priority AS dataset, year, band, CAST(month(o_orderdate) AS VARCHAR) AS month, label, fold FROM finst JOIN orders ON o_orderkey = finst.id),
rl AS (SELECT dataset, fold, label, 'year' AS attr, year AS value FROM im UNION ALL SELECT dataset, fold, label, 'band', band FROM im UNION ALL SELECT dataset, fold, label, 'month', month FROM im),
fc AS (SELECT dataset, attr, value, label, fold, count(*) AS w FROM rl GROUP BY ALL),
ft AS (SELECT dataset, attr, value, label, sum(w) AS w FROM fc GROUP BY ALL), fo AS (SELECT unnest(range(0, 10)) AS fold),
fg AS (SELECT ft.dataset, ft.attr, ft.value, ft.label, fo.fold, coalesce(fc.w, 0) AS tw, ft.w - coalesce(fc.w, 0) AS rest
  FROM ft CROSS JOIN fo LEFT JOIN fc ON fc.dataset = ft.dataset AND fc.attr = ft.attr AND fc.value = ft.value AND fc.label = ft.label AND fc.fold = fo.fold),
fr AS (SELECT dataset, attr, fold, sum(tw) OVER (PARTITION BY dataset, attr, value, fold) AS tested, tw AS hit FROM fg
  QUALIFY row_number() OVER (PARTITION BY dataset, attr, value, fold ORDER BY rest DESC, label) = 1),
results AS (SELECT dataset, attr AS scheme, 1 AS run, fold, sum(tested) AS n, 1.0 - CAST(sum(hit) AS DOUBLE) / sum(tested) AS error FROM fr GROUP BY ALL)
"""


def results(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.month("o_orderdate").cast("string").alias("month"))
    df = orders_nominal(spark, d).join(o, "id").withColumnRenamed("priority", "dataset")
    folded = folds.assign_folds(df, 10)
    return folds.cross_validate_rules(folded, SCHEMES, ["dataset"]).withColumn("run", F.lit(1))


RUNS = f"""
{INST}, rf AS (SELECT id, run, CAST((row_number() OVER (PARTITION BY run, label ORDER BY md5(CAST(id AS VARCHAR) || '|' || run), id) - 1) % 10 AS INTEGER) AS fold FROM inst, (SELECT unnest([0, 1]) AS run)),
ra AS (SELECT attr, run, fold, value, label, count(*) AS w FROM lng JOIN rf USING (id) WHERE attr IN ('year', 'priority') GROUP BY ALL),
rt AS (SELECT attr, run, value, label, sum(w) AS w FROM ra GROUP BY ALL),
rg AS (SELECT t.attr, t.run, f.fold, t.value, t.label, coalesce(a.w, 0) AS tw, t.w - coalesce(a.w, 0) AS rest FROM rt t CROSS JOIN (SELECT unnest(range(0, 10)) AS fold) f
  LEFT JOIN ra a ON a.attr = t.attr AND a.run = t.run AND a.fold = f.fold AND a.value = t.value AND a.label = t.label),
rh AS (SELECT attr, run, fold, tw AS hit, sum(tw) OVER (PARTITION BY attr, run, fold, value) AS tested FROM rg
  QUALIFY row_number() OVER (PARTITION BY attr, run, fold, value ORDER BY rest DESC, label) = 1),
rr AS (SELECT attr AS scheme, CAST(run AS INTEGER) AS run, CAST(fold AS INTEGER) AS fold, CAST(sum(tested) AS BIGINT) AS n, 1.0 - CAST(sum(hit) AS DOUBLE) / sum(tested) AS error FROM rh GROUP BY ALL)
"""


def run_results(spark, d):
    rules = {a: crossval.OneAttribute(a) for a in ("year", "priority")}
    return crossval.cross_validated_results(orders_nominal(spark, d), rules, runs=2)


@query("cross_validate_runs", f"WITH {RUNS} SELECT scheme, run, fold, n, round(error, 6) AS error FROM rr")
def _cv_runs(spark, d):
    return run_results(spark, d).withColumn("error", r6(F.col("error")))


@query("average_runs", f"WITH {RUNS} SELECT scheme, run, count(*) AS results, round(avg(error), 6) AS avg_error, round(stddev_samp(error), 6) AS sd_error FROM rr GROUP BY scheme, run")
def _average_runs(spark, d):
    out = folds.average_results(run_results(spark, d), ["scheme", "run"], ["error"])
    return out.withColumns({"avg_error": r6(F.col("avg_error")), "sd_error": r6(F.col("sd_error"))})


@query("cross_validate_rules", f"WITH {RES} SELECT dataset, scheme, run, CAST(fold AS INTEGER) AS fold, CAST(n AS DOUBLE) AS n, round(error, 6) AS error FROM results")
def _cv_rules(spark, d):
    return results(spark, d).withColumn("error", r6(F.col("error")))


PR = f"{RES}, pr AS (SELECT a.dataset, a.run, a.fold, a.scheme AS scheme_x, b.scheme AS scheme_y, a.error AS x, b.error AS y FROM results a JOIN results b USING (dataset, run, fold) WHERE a.scheme < b.scheme)"


@query("pair_results", f"WITH {PR} SELECT dataset, run, CAST(fold AS INTEGER) AS fold, scheme_x, scheme_y, round(x, 6) AS x, round(y, 6) AS y FROM pr")
def _pair(spark, d):
    out = evaluate.pair_results(results(spark, d), "error")
    return out.withColumns({"x": r6(F.col("x")), "y": r6(F.col("y"))})


@query(
    "unpaired_results",
    """
    WITH r AS (SELECT event_type AS dataset, user_id AS scheme, CAST(dayofweek(ts) AS INTEGER) AS fold FROM events),
    k AS (SELECT dataset, fold, count(DISTINCT scheme) AS schemes, count(*) AS "rows" FROM r GROUP BY ALL),
    w AS (SELECT dataset, count(DISTINCT scheme) AS expected FROM r GROUP BY ALL)
    SELECT dataset, fold, schemes, "rows", expected FROM k JOIN w USING (dataset) WHERE schemes <> expected OR "rows" <> schemes
    """,
)
def _unpaired(spark, d):
    r = table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("scheme"), (F.dayofweek("ts") - 1).alias("fold"))
    return evaluate.unpaired_results(r, ["dataset", "fold"])


# fixed value: two-sided 5 % point of t with 9 degrees of freedom (10 folds)
T95_9 = 2.2621571627409915
PT = f"""
{PR}, pt AS (SELECT dataset, scheme_x, scheme_y, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, avg(x - y) AS mean_diff, stddev_samp(x - y) AS sd_diff,
  avg(x - y) * sqrt(count(*)) / stddev_samp(x - y) AS t FROM pr GROUP BY ALL),
sg AS (SELECT *, CASE WHEN abs(t) < {T95_9} THEN 0 WHEN mean_x > mean_y THEN 1 ELSE -1 END AS s FROM pt),
bw AS (SELECT dataset, scheme_x AS r, scheme_y AS c, CASE WHEN s < 0 THEN 1 ELSE 0 END AS beats FROM sg UNION ALL SELECT dataset, scheme_y, scheme_x, CASE WHEN s > 0 THEN 1 ELSE 0 END FROM sg)
"""


def _paired(spark, d):
    return evaluate.paired_t(results(spark, d), "error")


@query(
    "paired_t",
    f"WITH {PT} SELECT dataset, scheme_x, scheme_y, n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff, round(t, 6) AS t, s AS significance FROM sg",
)
def _paired_t(spark, d):
    out = _paired(spark, d)
    return out.select("dataset", "scheme_x", "scheme_y", "n", *[r6(F.col(c)).alias(c) for c in ("mean_x", "mean_y", "mean_diff", "sd_diff", "t")], "significance")


@query("win_matrix", f"WITH {PT} SELECT r AS row, {', '.join(f'''CAST(sum(CASE WHEN c = '{s}' THEN beats ELSE 0 END) AS BIGINT) AS {s}''' for s in SCHEMES)} FROM bw GROUP BY r")
def _wins(spark, d):
    return evaluate.win_matrix(_paired(spark, d), SCHEMES)


@query(
    "rank_schemes",
    f"""
    WITH {PT}, w AS (SELECT c AS scheme, sum(beats) AS wins FROM bw GROUP BY c), l AS (SELECT r AS scheme, sum(beats) AS losses FROM bw GROUP BY r)
    SELECT scheme, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(wins - losses AS BIGINT) AS diff FROM w JOIN l USING (scheme)
    """,
)
def _rank(spark, d):
    return evaluate.rank_schemes(_paired(spark, d))


_VS = f"""
{RES}, bs AS (SELECT dataset, run, fold, error AS y FROM results WHERE scheme = 'year'),
vs AS (SELECT r.dataset, r.scheme, avg(r.error) AS m, stddev_samp(r.error) AS sd, avg(r.error - y) AS df, avg(r.error - y) * sqrt(count(*)) / nullif(stddev_samp(r.error - y), 0) AS t
  FROM results r JOIN bs USING (dataset, run, fold) GROUP BY r.dataset, r.scheme),
mk AS (SELECT *, CASE WHEN scheme = 'year' OR abs(t) < {T95_9} THEN 0 WHEN df > 0 THEN 1 ELSE -1 END AS s FROM vs)
"""


@query(
    "comparison_table",
    f"WITH {_VS} SELECT dataset, "
    + ", ".join(
        f"max(CASE WHEN scheme = '{s}' THEN round(m, 6) END) AS {s}_mean, max(CASE WHEN scheme = '{s}' THEN round(sd, 6) END) AS {s}_sd, "
        f"max(CASE WHEN scheme = '{s}' THEN CASE s WHEN 1 THEN 'v' WHEN -1 THEN '*' ELSE '' END END) AS {s}_mark"
        for s in SCHEMES
    )
    + " FROM mk GROUP BY dataset",
)
def _comparison(spark, d):
    out = evaluate.comparison_table(results(spark, d), "error", "year", SCHEMES)
    return out.withColumns({f"{s}_{c}": r6(F.col(f"{s}_{c}")) for s in SCHEMES for c in ("mean", "sd")})


@query(
    "win_tie_loss",
    f"WITH {_VS} SELECT scheme, CAST(sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS BIGINT) AS win, CAST(sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tie, "
    "CAST(sum(CASE WHEN s = -1 THEN 1 ELSE 0 END) AS BIGINT) AS loss FROM mk WHERE scheme <> 'year' GROUP BY scheme",
)
def _wtl(spark, d):
    return evaluate.win_tie_loss(results(spark, d), "error", "year")


@query("distinct_specifiers", f"WITH {RES} SELECT DISTINCT dataset, scheme FROM results")
def _specifiers(spark, d):
    return evaluate.distinct_specifiers(results(spark, d), ["dataset", "scheme"])


@query(
    "two_sample_t",
    """
    WITH g AS (SELECT l_returnflag, l_linestatus = 'O' AS o, l_extendedprice AS v FROM lineitem),
    s AS (SELECT l_returnflag, count(CASE WHEN o THEN v END) AS n1, count(CASE WHEN NOT o THEN v END) AS n2, avg(CASE WHEN o THEN v END) AS m1, avg(CASE WHEN NOT o THEN v END) AS m2,
      var_samp(CASE WHEN o THEN v END) AS v1, var_samp(CASE WHEN NOT o THEN v END) AS v2 FROM g GROUP BY ALL)
    SELECT l_returnflag, n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t, round(greatest(v1, v2) / least(v1, v2), 6) AS f FROM s
    """,
)
def _two_sample(spark, d):
    df = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_linestatus") == "O").alias("open"))
    out = evaluate.two_sample_t(df, "l_extendedprice", "open", ["l_returnflag"])
    return out.select("l_returnflag", "n1", "n2", r6(F.col("t")).alias("t"), r6(F.col("f")).alias("f"))


@query("p_values")
def _p_values(spark, d):
    return _paired(spark, d).select("dataset", "scheme_x", "scheme_y", r6(F.col("p")).alias("p"))


BV = f"""
{INST}, h AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|0'), id) AS rk FROM inst),
it AS (SELECT unnest(range(1, 51)) AS iter),
tr AS (SELECT h.*, iter FROM h CROSS JOIN it WHERE rk <= 100 QUALIFY row_number() OVER (PARTITION BY iter ORDER BY md5(CAST(id AS VARCHAR) || '|0:' || CAST(iter AS VARCHAR)), id) <= 50),
cn AS (SELECT iter, priority, label, count(*) AS w FROM tr GROUP BY ALL),
rl AS (SELECT iter, priority, label AS p FROM cn QUALIFY row_number() OVER (PARTITION BY iter, priority ORDER BY w DESC, label) = 1),
df AS (SELECT iter, label AS fb FROM (SELECT iter, label, count(*) AS w FROM tr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY iter ORDER BY w DESC, label) = 1),
vt AS (SELECT te.id, te.label, iter, coalesce(p, fb) AS predicted FROM (SELECT * FROM h WHERE rk > 100) te CROSS JOIN it LEFT JOIN rl USING (iter, priority) JOIN df USING (iter)),
fq AS (SELECT id, label, predicted, count(*) / 50.0::DOUBLE AS p FROM vt GROUP BY ALL),
lb AS (SELECT DISTINCT label AS c FROM inst),
al AS (SELECT i.id, lb.c, CASE WHEN i.label = lb.c THEN 1.0 ELSE 0.0 END AS a, coalesce(fq.p, 0) AS p FROM (SELECT DISTINCT id, label FROM vt) i CROSS JOIN lb LEFT JOIN fq ON fq.id = i.id AND fq.predicted = lb.c),
pr AS (SELECT id, sum(power(a - p, 2) - p * (1 - p) / 49) AS b, 1 - sum(p * p) AS v, sum((1 - a) * p) AS e FROM al GROUP BY id)
"""


@query("bias_variance", f"WITH {BV} SELECT round(sum(b) / (2 * count(*)), 6) AS bias, round(sum(v) / (2 * count(*)), 6) AS variance, 0.0::DOUBLE AS sigma, round(avg(e), 6) AS error FROM pr")
def _bv(spark, d):
    return _bias_variance(spark, d, learners.OneAttribute("priority"))


def _bias_variance(spark, d, learner):
    out = evaluate.bias_variance(ensemble.bias_variance_votes(orders_nominal(spark, d), learner), 50)
    return out.select(*[r6(F.col(c)).alias(c) for c in ("bias", "variance", "sigma", "error")])


def _nb_sql(p: str, long: str, classes: str, rows: str, attrs, smooth: str = "1.0", keys: str = "m") -> str:
    """Naive Bayes of every model ``m`` of the counts ``long`` and ``classes`` on ``rows`` (which name their model): ``{p}z``."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    joins = " ".join(f"LEFT JOIN {p}g a{i} ON {on(f'a{i}', 'r')} AND a{i}.label = r.label AND a{i}.attr = '{a}' AND a{i}.value = x.{a}" for i, a in enumerate(attrs))
    return f"""
{p}v AS (SELECT DISTINCT {keys}, attr, value FROM {long}),
{p}g AS (SELECT {', '.join(f'c.{k}' for k in keys.split(', '))}, v.attr, v.value, c.label, ln((coalesce(l.w, 0) + {smooth}) / sum(coalesce(l.w, 0) + {smooth}) OVER (PARTITION BY {', '.join(f'c.{k}' for k in keys.split(', '))}, v.attr, c.label)) AS lp
  FROM {classes} c JOIN {p}v v ON {on('v', 'c')} LEFT JOIN {long} l ON {on('l', 'c')} AND l.attr = v.attr AND l.value = v.value AND l.label = c.label),
{p}p AS (SELECT {keys}, label, ln((w + 1.0) / sum(w + 1.0) OVER (PARTITION BY {keys})) AS lp FROM {classes}),
{p}s AS (SELECT x.*, r.label AS cls, r.lp + {' + '.join(f'coalesce(a{i}.lp, 0)' for i in range(len(attrs)))} AS lp FROM {rows} x JOIN {p}p r ON {on('r', 'x')} {joins}),
{p}z AS (SELECT *, exp(lp) / sum(exp(lp)) OVER (PARTITION BY id, {keys}) AS pr FROM {p}s)"""


BVB = BV.split("cn AS (")[0] + f"""
cls AS (SELECT iter AS m, label, count(*) AS w FROM tr GROUP BY ALL),
clg AS (SELECT iter AS m, 'priority' AS attr, priority AS value, label, count(*) AS w FROM tr GROUP BY ALL UNION ALL SELECT iter, 'band', band, label, count(*) FROM tr GROUP BY ALL),
bx AS (SELECT te.*, iter AS m FROM (SELECT * FROM h WHERE rk > 100) te CROSS JOIN it),
{_nb_sql('n', 'clg', 'cls', 'bx', ['priority', 'band'])},
vt AS (SELECT id, label, m AS iter, cls AS predicted FROM nz QUALIFY row_number() OVER (PARTITION BY id, m ORDER BY round(pr, 9) DESC, cls) = 1),
fq AS (""" + BV.split("fq AS (")[1]


@query("bias_variance_bayes", f"WITH {BVB} SELECT round(sum(b) / (2 * count(*)), 6) AS bias, round(sum(v) / (2 * count(*)), 6) AS variance, 0.0::DOUBLE AS sigma, round(avg(e), 6) AS error FROM pr")
def _bv_bayes(spark, d):
    return _bias_variance(spark, d, learners.NaiveBayes(["priority", "band"]))


# -- rankings ------------------------------------------------------------------


@query(
    "rank_attributes",
    f"""
    WITH {INST}, {GAIN}, g AS (SELECT attr, (n * log2(n) - classes - bags + cells) / n AS gain FROM gs JOIN bg USING (attr) JOIN cl USING (attr))
    SELECT attr, round(gain, 8) AS gain, CAST(row_number() OVER (ORDER BY round(gain, 9) DESC, attr) AS INTEGER) AS rank FROM g QUALIFY rank <= 2
    """,
)
def _rank_attrs(spark, d):
    gains = counts.info_gain(counts.contingency(orders_nominal(spark, d), ATTRS))
    return evaluate.rank_attributes(gains, count=2).withColumn("gain", r6(F.col("gain"), 8))


FS = f"""
{INST}, {FOLDS}, fo AS (SELECT unnest(range(0, 10)) AS f),
c AS (SELECT f AS fold, attr, value, label, CAST(count(*) AS DOUBLE) AS w FROM flng JOIN fo ON fold <> f GROUP BY ALL),
gs AS (SELECT fold, attr, sum(w) AS n, sum(w * log2(w)) AS cells FROM c GROUP BY ALL),
bg AS (SELECT fold, attr, sum(w * log2(w)) AS bags FROM (SELECT fold, attr, value, sum(w) AS w FROM c GROUP BY ALL) GROUP BY ALL),
cl AS (SELECT fold, attr, sum(w * log2(w)) AS classes FROM (SELECT fold, attr, label, sum(w) AS w FROM c GROUP BY ALL) GROUP BY ALL),
g AS (SELECT fold, attr, (n * log2(n) - classes - bags + cells) / n AS gain FROM gs JOIN bg USING (fold, attr) JOIN cl USING (fold, attr)),
rk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(gain, 9) DESC, attr) AS rank FROM g)
"""


def _fold_rankings(spark, d):
    folded = folds.assign_folds(orders_nominal(spark, d), 10)
    train = folds.all_but_fold(counts.contingency(folded, ATTRS, by=["fold"]))
    return evaluate.rank_attributes(counts.info_gain(train, ["fold"]), by=["fold"])


@query(
    "feature_selection_cv",
    f"WITH {FS} SELECT attr, round(avg(gain), 8) AS mean_merit, round(stddev_pop(gain), 8) AS sd_merit, round(avg(rank), 6) AS mean_rank, round(stddev_pop(rank), 6) AS sd_rank FROM rk GROUP BY attr",
)
def _fs(spark, d):
    out = evaluate.feature_selection_cv(_fold_rankings(spark, d))
    return out.select("attr", r6(F.col("mean_merit"), 8).alias("mean_merit"), r6(F.col("sd_merit"), 8).alias("sd_merit"), r6(F.col("mean_rank")).alias("mean_rank"), r6(F.col("sd_rank")).alias("sd_rank"))


@query("selection_counts", f"WITH {FS} SELECT attr, count(*) AS folds, round(count(*) / 10.0::DOUBLE, 6) AS share FROM rk WHERE rank <= 2 GROUP BY attr")
def _sel(spark, d):
    out = evaluate.selection_counts(_fold_rankings(spark, d).filter("rank <= 2"), 10)
    return out.withColumn("share", r6(F.col("share")))


# -- ensembles -----------------------------------------------------------------

_U = "(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|0:' || CAST(bag AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _poisson_sql() -> str:
    import math

    total, p, parts = 0.0, math.exp(-1.0), []
    for k in range(12):
        total += p
        parts.append(f"CASE WHEN u >= {total!r} THEN 1 ELSE 0 END")
        p *= 1.0 / (k + 1)
    return " + ".join(parts)


@query(
    "bagging",
    f"""
    WITH {INST}, bg AS (SELECT unnest(range(0, 5)) AS bag), bu AS (SELECT inst.*, bag, {_U} AS u FROM inst CROSS JOIN bg),
    bw AS (SELECT *, {_poisson_sql()} AS w FROM bu),
    bl AS (SELECT bag, 'priority' AS attr, priority AS value, label, w FROM bw UNION ALL SELECT bag, 'year', year, label, w FROM bw UNION ALL SELECT bag, 'band', band, label, w FROM bw),
    dom AS (SELECT DISTINCT attr, value FROM lng), cl AS (SELECT DISTINCT label FROM inst),
    cn AS (SELECT bag, attr, value, label, sum(w) AS w FROM bl GROUP BY ALL),
    nb AS (SELECT bg.bag, dom.attr, dom.value, cl.label, (coalesce(w, 0) + 1.0) / sum(coalesce(w, 0) + 1.0) OVER (PARTITION BY bg.bag, dom.attr, cl.label) AS p
           FROM bg CROSS JOIN dom CROSS JOIN cl LEFT JOIN cn ON cn.bag = bg.bag AND cn.attr = dom.attr AND cn.value = dom.value AND cn.label = cl.label),
    pc AS (SELECT bag, label, sum(w) + 1.0 AS n FROM bw GROUP BY ALL), pri AS (SELECT bag, label, n / sum(n) OVER (PARTITION BY bag) AS p FROM pc),
    cells AS (SELECT DISTINCT priority, year, band FROM inst),
    s AS (SELECT c.priority, c.year, c.band, p.bag, p.label, ln(p.p) + ln(a.p) + ln(b.p) + ln(e.p) AS lp FROM cells c CROSS JOIN pri p
          JOIN nb a ON a.bag = p.bag AND a.label = p.label AND a.attr = 'priority' AND a.value = c.priority
          JOIN nb b ON b.bag = p.bag AND b.label = p.label AND b.attr = 'year' AND b.value = c.year
          JOIN nb e ON e.bag = p.bag AND e.label = p.label AND e.attr = 'band' AND e.value = c.band),
    z AS (SELECT *, exp(lp) / sum(exp(lp)) OVER (PARTITION BY priority, year, band, bag) AS pr FROM s),
    m AS (SELECT priority, year, band, label, avg(pr) AS pr FROM z GROUP BY ALL)
    SELECT id, m.label, round(pr, 6) AS prob FROM inst JOIN m USING (priority, year, band)
    """,
)
def _bagging(spark, d):
    df = orders_nominal(spark, d)
    return _bag_rows(ensemble.bagging(df, df.drop("label"), learners.NaiveBayes(ATTRS), bags=5))


def _bag_rows(out):
    z = F.arrays_zip(F.col("classes").alias("label"), F.transform("probs", lambda p: F.round(p, 6)).alias("prob"))
    return out.select("id", F.explode(z).alias("z")).select("id", "z.label", "z.prob")


@query(
    "bagged_mean",
    f"""
    WITH l AS (SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders), bg AS (SELECT unnest(range(0, 10)) AS bag),
    bu AS (SELECT l.*, bag, {_U} AS u FROM l CROSS JOIN bg), bw AS (SELECT *, {_poisson_sql()} AS w FROM bu),
    m AS (SELECT o_orderstatus, bag, sum(w * o_totalprice) / sum(w) AS m FROM bw GROUP BY ALL)
    SELECT o_orderstatus, round(avg(m), 4) AS predicted FROM m GROUP BY ALL
    """,
)
def _bagged_mean(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    return ensemble.bagged_mean(o, "o_totalprice", ["o_orderstatus"]).withColumn("predicted", r6(F.col("predicted"), 4))


@query(
    "stack_out_of_fold",
    f"WITH {CVNB} SELECT sn.id, inst.label, sn.fold, " + ", ".join(f"round(max(CASE WHEN sn.label = '{c}' THEN p END), 6) AS p_{c}" for c in "FOP") + " FROM sn JOIN inst USING (id) GROUP BY ALL",
)
def _stack(spark, d):
    out = ensemble.stack_out_of_fold(orders_nominal(spark, d), ATTRS, ["F", "O", "P"])
    return out.withColumns({f"p_{c}": r6(F.col(f"p_{c}")) for c in "FOP"})


@query(
    "bagging_votes",
    f"""
    WITH {INST}, bg AS (SELECT unnest(range(0, 7)) AS bag), bu AS (SELECT inst.*, bag, {_U} AS u FROM inst CROSS JOIN bg),
    bw AS (SELECT *, {_poisson_sql()} AS w FROM bu), cn AS (SELECT bag, year, label, sum(w) AS w FROM bw GROUP BY ALL),
    rl AS (SELECT bag, year, label AS p FROM cn QUALIFY sum(w) OVER (PARTITION BY bag, year) > 0 AND row_number() OVER (PARTITION BY bag, year ORDER BY w DESC, label) = 1),
    fb AS (SELECT bag, label AS f FROM (SELECT bag, label, sum(w) AS w FROM bw GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY bag ORDER BY w DESC, label) = 1),
    vt AS (SELECT y.year, coalesce(rl.p, fb.f) AS label, count(*) AS n FROM (SELECT DISTINCT year FROM inst) y CROSS JOIN fb LEFT JOIN rl ON rl.bag = fb.bag AND rl.year = y.year GROUP BY ALL)
    SELECT id, c.label, round(coalesce(n, 0) / 7.0, 6) AS prob FROM inst CROSS JOIN (SELECT DISTINCT label FROM inst) c LEFT JOIN vt ON vt.year = inst.year AND vt.label = c.label
    """,
)
def _bagging_votes(spark, d):
    df = orders_nominal(spark, d)
    return _bag_rows(ensemble.bagging(df, df.drop("label"), learners.OneAttribute("year"), bags=7, vote=True))


_STEP = "CAST(least(9, CAST(floor(round({}, 9) * 10) AS INTEGER)) AS VARCHAR)"
_FEATURES = [f"{b}_{c}" for b in ("bayes", "rule") for c in "FOP"]


@query(
    "stack_score",
    f"""
    WITH {INST}, te AS (SELECT *, -1 AS m FROM inst WHERE NOT {_SPLIT}),
    tr AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|0'), id) - 1) % 5 AS INTEGER) AS m FROM inst WHERE {_SPLIT}),
    fo AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f),
    lg AS (SELECT f AS m, attr, value, lng.label, sum(CASE WHEN tr.m <> f THEN 1.0 ELSE 0.0 END) AS w FROM lng JOIN tr USING (id) CROSS JOIN fo GROUP BY ALL),
    cl AS (SELECT f AS m, label, sum(CASE WHEN m <> f THEN 1.0 ELSE 0.0 END) AS w FROM tr CROSS JOIN fo GROUP BY ALL),
    rw AS (SELECT id, priority, year, band, label, m FROM tr UNION ALL SELECT id, priority, year, band, label, m FROM te),
    {_nb_sql('b', 'lg', 'cl', 'rw', ATTRS)},
    ru AS (SELECT m, value, label AS p FROM lg WHERE attr = 'year' QUALIFY sum(w) OVER (PARTITION BY m, value) > 0 AND row_number() OVER (PARTITION BY m, value ORDER BY w DESC, label) = 1),
    fb AS (SELECT m, label AS f FROM cl QUALIFY row_number() OVER (PARTITION BY m ORDER BY w DESC, label) = 1),
    ft AS (SELECT b.id, b.m, b.label, {', '.join(_STEP.format(f"max(CASE WHEN cls = '{c}' THEN pr END)") + f" AS bayes_{c}" for c in "FOP")},
           {', '.join(f"CASE WHEN coalesce(any_value(ru.p), any_value(fb.f)) = '{c}' THEN '9' ELSE '0' END AS rule_{c}" for c in "FOP")}
           FROM bz b JOIN fb ON fb.m = b.m LEFT JOIN ru ON ru.m = b.m AND ru.value = b.year GROUP BY b.id, b.m, b.label),
    mt AS (SELECT 0 AS m, * EXCLUDE (m) FROM ft WHERE m >= 0), me AS (SELECT 0 AS m, * EXCLUDE (m) FROM ft WHERE m < 0),
    ml AS ({' UNION ALL '.join(f"SELECT m, '{f}' AS attr, {f} AS value, label, count(*) AS w FROM mt GROUP BY ALL" for f in _FEATURES)}),
    mc AS (SELECT m, label, count(*) AS w FROM mt GROUP BY ALL),
    {_nb_sql('q', 'ml', 'mc', 'me', _FEATURES)}
    SELECT id, any_value(label) AS label, {', '.join(f"round(max(CASE WHEN cls = '{c}' THEN pr END), 6) AS p_{c}" for c in "FOP")},
           arg_min(cls, struct_pack(s := -round(pr, 9), l := cls)) AS predicted FROM qz GROUP BY id
    """,
)
def _stack_score(spark, d):
    train, test = _train_test(orders_nominal(spark, d))
    stack = ensemble.Stack({"bayes": learners.NaiveBayes(ATTRS), "rule": learners.OneAttribute("year")}, learners.NaiveBayes, ["F", "O", "P"])
    out = stack.score(test, stack.fit(train, k=5))
    probs = F.map_from_arrays("classes", "probs")
    return out.select("id", "label", *[r6(F.element_at(probs, F.lit(c))).alias(f"p_{c}") for c in "FOP"], "predicted")


# -- subsets and searches ------------------------------------------------------


@query(
    "subset_eval_holdout",
    f"""
    WITH {INST}, tr AS (SELECT * FROM inst WHERE {_SPLIT}), te AS (SELECT * FROM inst WHERE NOT {_SPLIT}),
    tl AS (SELECT lng.* FROM lng JOIN tr USING (id)), dom AS (SELECT DISTINCT attr, value FROM tl),
    cl AS (SELECT label, count(*) + 1.0 AS n FROM tr GROUP BY label), pri AS (SELECT label, n / (SELECT sum(n) FROM cl) AS p FROM cl),
    cn AS (SELECT attr, value, label, count(*) AS w FROM tl GROUP BY ALL),
    nb AS (SELECT dom.attr, dom.value, cl.label, ln((coalesce(w, 0) + 1.0) / sum(coalesce(w, 0) + 1.0) OVER (PARTITION BY dom.attr, cl.label)) AS lp
           FROM dom CROSS JOIN cl LEFT JOIN cn ON cn.attr = dom.attr AND cn.value = dom.value AND cn.label = cl.label),
    sub(subset_id, attr) AS (VALUES ('a', 'year'), ('b', 'year'), ('b', 'band'), ('c', 'priority'), ('c', 'band'), ('c', 'year')),
    s AS (SELECT l.id, sub.subset_id, nb.label, sum(nb.lp) AS lp FROM lng l JOIN te USING (id) JOIN sub ON sub.attr = l.attr JOIN nb ON nb.attr = l.attr AND nb.value = l.value GROUP BY ALL),
    p AS (SELECT s.id, subset_id, s.label FROM s JOIN pri USING (label) QUALIFY row_number() OVER (PARTITION BY s.id, subset_id ORDER BY round(lp + ln(p), 9) DESC, s.label) = 1)
    SELECT subset_id, round(avg(CASE WHEN p.label = te.label THEN 0.0 ELSE 1.0 END), 6) AS error FROM p JOIN te USING (id) GROUP BY subset_id
    """,
)
def _holdout(spark, d):
    train, test = _train_test(orders_nominal(spark, d))
    sets = {"a": ["year"], "b": ["year", "band"], "c": ["priority", "band", "year"]}
    return search.subset_eval_holdout(sets, train, test).withColumn("error", r6(F.col("error")))


@query(
    "subset_eval_numeric",
    f"""
    WITH {INST}, x AS (SELECT inst.*, o_totalprice AS y FROM inst JOIN orders ON o_orderkey = id), tr AS (SELECT * FROM x WHERE {_SPLIT}), te AS (SELECT * FROM x WHERE NOT {_SPLIT}),
    m AS (SELECT band, avg(y) AS m FROM tr GROUP BY band), m2 AS (SELECT priority, year, avg(y) AS m FROM tr GROUP BY ALL)
    SELECT 'band' AS subset_id, round(avg(abs(y - m)), 3) AS error FROM te JOIN m USING (band)
    UNION ALL SELECT 'both', round(avg(abs(y - m)), 3) FROM te JOIN m2 USING (priority, year)
    """,
)
def _holdout_numeric(spark, d):
    y = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"))
    train, test = _train_test(orders_nominal(spark, d).join(y, "id"))
    return search.subset_eval_numeric({"band": ["band"], "both": ["priority", "year"]}, train, test, "y").withColumn("error", r6(F.col("error"), 3))


_SUBSETS = [[], ["band"], ["priority"], ["year"], ["band", "priority"], ["band", "year"], ["priority", "year"], ["band", "priority", "year"]]


def _best_of(errors: str) -> str:
    """All subsets of three attributes and the best one; a search that may miss five times scores each of them."""
    size = "CASE WHEN subset_id = '(none)' THEN 0 ELSE length(subset_id) - length(replace(subset_id, '+', '')) + 1 END"
    return f"SELECT subset_id, round(error, 6) AS error, row_number() OVER (ORDER BY round(error, 9), {size}, subset_id) = 1 AS best FROM ({errors})"


_INCONSISTENT = " UNION ALL ".join(
    f"SELECT '{'+'.join(x) or '(none)'}' AS subset_id, 1 - sum(best)::DOUBLE / sum(n) AS error FROM (SELECT max(w) AS best, sum(w) AS n FROM (SELECT {', '.join([*x, 'label'])}, count(*) AS w FROM inst GROUP BY ALL) {'GROUP BY ' + ', '.join(x) if x else ''})"
    for x in _SUBSETS
)


@query("best_first_consistency", f"WITH {INST} {_best_of(_INCONSISTENT)}")
def _best_consistent(spark, d):
    out = search.best_first(search.Inconsistency(orders_nominal(spark, d), ATTRS), ATTRS)
    return out.select("subset_id", r6(F.col("error")).alias("error"), "best")


_HELD_OUT = " UNION ALL ".join(
    f"SELECT '{'+'.join(x) or '(none)'}' AS subset_id, avg(CASE WHEN cls = label THEN 0.0 ELSE 1.0 END) AS error FROM "
    f"(SELECT id, label, cls FROM bs QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(lp0{''.join(f' + l_{a}' for a in x)}, 9) DESC, cls) = 1)"
    for x in _SUBSETS
)


@query(
    "best_first_holdout",
    f"""
    WITH {INST}, tr AS (SELECT * FROM inst WHERE {_SPLIT}), te AS (SELECT * FROM inst WHERE NOT {_SPLIT}),
    cl AS (SELECT label, count(*) + 1.0 AS n FROM tr GROUP BY label), cn AS (SELECT attr, value, lng.label, count(*) AS w FROM lng JOIN tr USING (id) GROUP BY ALL),
    nb AS (SELECT v.attr, v.value, cl.label, ln((coalesce(w, 0) + 1.0) / sum(coalesce(w, 0) + 1.0) OVER (PARTITION BY v.attr, cl.label)) AS lp
           FROM cl CROSS JOIN (SELECT DISTINCT attr, value FROM cn) v LEFT JOIN cn ON cn.attr = v.attr AND cn.value = v.value AND cn.label = cl.label),
    bs AS (SELECT te.id, te.label, cl.label AS cls, ln(n / (SELECT sum(n) FROM cl)) AS lp0, {', '.join(f"coalesce(x_{a}.lp, 0) AS l_{a}" for a in ATTRS)} FROM te CROSS JOIN cl
           {' '.join(f"LEFT JOIN nb x_{a} ON x_{a}.attr = '{a}' AND x_{a}.value = te.{a} AND x_{a}.label = cl.label" for a in ATTRS)})
    {_best_of(_HELD_OUT)}
    """,
)
def _best_holdout(spark, d):
    train, test = _train_test(orders_nominal(spark, d))
    out = search.best_first(search.HoldoutError(train, test, ATTRS), ATTRS)
    return out.select("subset_id", r6(F.col("error")).alias("error"), "best")


@query("subset_eval_cv")
def _subset_cv(spark, d):
    sets = {"year": ["year"], "band+year": ["band", "year"]}
    return search.subset_eval_cv(sets, orders_nominal(spark, d))


@query("forward_race")
def _forward(spark, d):
    return search.hill_race(orders_nominal(spark, d), ATTRS)


@query("backward_race")
def _backward(spark, d):
    return search.hill_race(orders_nominal(spark, d), ATTRS, backward=True)


@query("rank_race")
def _rank_race(spark, d):
    df = orders_nominal(spark, d)
    ranking = [r["attr"] for r in evaluate.rank_attributes(counts.info_gain(counts.contingency(df, ATTRS))).orderBy("rank").collect()]
    return search.rank_race(df, ranking)


@query("schemata_race")
def _schemata(spark, d):
    return search.schemata_race(orders_nominal(spark, d), ATTRS)


@query(
    "grid_search_cv",
    f"""
    WITH {RES}, g AS (SELECT scheme, avg(error) AS error, count(*) AS folds FROM results GROUP BY scheme)
    SELECT scheme, round(error, 6) AS error, folds, scheme = (SELECT scheme FROM g ORDER BY round(error, 9), scheme LIMIT 1) AS best FROM g
    """,
)
def _grid(spark, d):
    return search.grid_search_cv(results(spark, d), ["scheme"]).withColumn("error", r6(F.col("error")))


_GRID = [(smooth, top) for smooth in (0.5, 25.25, 50.0) for top in (1.0, 2.0, 4.0)]


@query(
    "parameter_search",
    f"""
    WITH {FS}, gp(point, smooth, top) AS (VALUES {', '.join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_GRID))}),
    al AS (SELECT f AS fold, attr, value, label, sum(CASE WHEN flng.fold <> f THEN 1.0 ELSE 0.0 END) AS w FROM flng CROSS JOIN fo GROUP BY ALL),
    lg AS (SELECT al.fold, point, attr, value, label, w, smooth FROM al CROSS JOIN gp JOIN rk USING (fold, attr) WHERE rank <= top),
    cc AS (SELECT f AS fold, point, label, sum(CASE WHEN finst.fold <> f THEN 1.0 ELSE 0.0 END) AS w, any_value(smooth) AS smooth FROM finst CROSS JOIN fo CROSS JOIN gp GROUP BY f, point, label),
    rx AS (SELECT finst.*, point FROM finst CROSS JOIN gp),
    {_nb_sql('n', 'lg', 'cc', 'rx', ATTRS, 'c.smooth', 'fold, point')},
    pd AS (SELECT id, point, label, cls FROM nz QUALIFY row_number() OVER (PARTITION BY id, point ORDER BY round(pr, 9) DESC, cls) = 1),
    er AS (SELECT point, count(*) AS n, avg(CASE WHEN cls = label THEN 0.0 ELSE 1.0 END) AS error FROM pd GROUP BY point)
    SELECT er.point, smooth, top, CAST(n AS DOUBLE) AS n, round(error, 6) AS error, er.point = (SELECT point FROM er ORDER BY round(error, 9), point LIMIT 1) AS best FROM er JOIN gp ON gp.point = er.point
    """,
)
def _parameter_search(spark, d):
    grid = [search.Parameter("smooth", 0.5, 50, 3), search.Parameter("top", 1, "A", 3, whole=True)]
    out = search.parameter_search(orders_nominal(spark, d), learners.NaiveBayes(ATTRS, "smooth", "top"), grid)
    return out.withColumn("error", r6(F.col("error")))


@query(
    "grid_search_knn",
    f"""
    WITH {CUST}, cf AS (SELECT id, bal, nation, label, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|0'), id) - 1) % 5 AS fold FROM cust),
    st AS (SELECT f, min(bal) AS lo, max(bal) AS hi FROM cf CROSS JOIN (SELECT unnest(range(0, 5)) AS f) WHERE fold <> f GROUP BY f),
    c AS (SELECT id, f, fold, (bal - lo) / (hi - lo) AS b, nation, label FROM cf CROSS JOIN st),
    pr AS (SELECT q.id AS query, q.label AS actual, q.fold, t.label, {_dist('q', 't')} AS distance FROM c q JOIN c t ON q.f = t.f AND q.fold = q.f AND t.fold <> t.f),
    rk AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY distance) AS r FROM pr QUALIFY r <= 4), ks AS (SELECT unnest(range(1, 5)) AS k),
    v AS (SELECT query, actual, fold, k, label, count(*) AS v FROM rk JOIN ks ON r <= k GROUP BY ALL),
    p AS (SELECT query, actual, fold, k, label FROM v QUALIFY row_number() OVER (PARTITION BY query, k ORDER BY v DESC, label) = 1),
    e AS (SELECT k, fold, avg(CASE WHEN label = actual THEN 0.0 ELSE 1.0 END) AS error FROM p GROUP BY ALL), g AS (SELECT CAST(k AS INTEGER) AS k, avg(error) AS error, count(*) AS folds FROM e GROUP BY k)
    SELECT k, round(error, 6) AS error, folds, k = (SELECT k FROM g ORDER BY round(error, 9), k LIMIT 1) AS best FROM g
    """,
)
def _grid_knn(spark, d):
    folded = folds.assign_folds(customers_mixed(spark, d), 5)
    out = search.grid_search_cv(neighbors.knn_cv_errors(folded, 4, ["bal"], ["nation"]), ["k"])
    return out.withColumn("error", r6(F.col("error")))


@query("doubling_search")
def _doubling(spark, d):
    v = vectors(spark, d)
    train, test = _train_test(v)
    machines = v.select(F.collect_set("label").alias("c"))
    base = train.join(machines).select(F.explode("c").alias("clf"), "label", "x")
    support = base.select("clf", "x", F.when(F.col("label") == F.col("clf"), 1.0).otherwise(-0.1).alias("alpha"))
    truth = test.select(F.col("id").alias("row_id"), "label")

    def errors(gammas: list[float]) -> list[float]:
        scores = cut(neighbors.kernel_scores(test, support, gammas))
        out = []
        for gamma in gammas:
            s = scores.filter(F.col("gamma") == gamma).select("row_id", F.col("clf").alias("class"), F.col("score").alias("value"))
            p = decode.choose_class(s).join(truth, "row_id")
            out.append(float(p.agg(F.avg(F.when(F.col("predicted") == F.col("label"), 0.0).otherwise(1.0))).first()[0]))
        return out

    value, top, trace = search.doubling_search(lambda g: errors([g])[0], 1.0, together=errors)
    return spark.createDataFrame([(g, e, g == value) for g, e in trace], "gamma double, error double, best boolean")


@query("run_grid")
def _run_grid(spark, d):
    df = folds.assign_folds(orders_nominal(spark, d), 5)

    def cell(c):
        if c["attr"] == "absent":
            raise KeyError("no such attribute")
        return folds.cross_validate_rules(df, [c["attr"]]).select("scheme", "fold", "n", "error")

    done, _ = folds.run_grid([{"attr": a} for a in ("year", "absent", "band")], cell, ["attr"])
    return done
