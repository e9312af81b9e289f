"""Queries over moments, mixtures and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.registry import query
from strandlab.catalog.tables import CENTROID, FRAMES, INST, LINES, VEC, centroid_distances, event_frames, line_frames, orders_nominal, r6, spread_table, table, vectors
from strandlab.functions.exprs import gaussian_logpdf, gaussian_logpdf_full
from strandlab.operators import cluster, mixture, moments
from strandlab.plans.folds import assign_folds
from strandlab.session import cut

D64 = 64
_EX = f"{VEC}, ex AS (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM vec)"


def _r(df, cols, digits=6):
    return df.withColumns({c: r6(F.col(c), digits) for c in cols})


@query(
    "set_summary",
    f"""
    WITH {FRAMES}, s AS (SELECT seq_id, count(*) AS len, min(x) AS lo, max(x) AS hi FROM frames GROUP BY ALL)
    SELECT count(*) AS sequences, min(len) AS min_len, max(len) AS max_len, round(avg(len), 6) AS mean_len, min(lo) AS min_value, max(hi) AS max_value FROM s
    """,
)
def _summary(spark, d):
    return _r(moments.set_summary(event_frames(spark, d)), ["mean_len"])


@query("dynamic_ranges", f"WITH {_EX} SELECT CAST(dim AS INTEGER) AS dim, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM ex GROUP BY ALL")
def _ranges(spark, d):
    return _r(moments.dynamic_ranges(vectors(spark, d), D64), ["lo", "hi"])


@query("global_mean_var", f"WITH {_EX} SELECT CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var FROM ex GROUP BY ALL")
def _global(spark, d):
    return _r(moments.by_dim(moments.global_mean_var(vectors(spark, d), D64), [], ["mean", "var"]), ["mean", "var"])


@query("class_mean_var", f"WITH {_EX} SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(greatest(var_pop(v), 1e-4), 6) AS var FROM ex GROUP BY ALL")
def _class_mv(spark, d):
    return _r(moments.by_dim(moments.class_mean_var(vectors(spark, d), D64), ["label"], ["mean", "var"]), ["mean", "var"])


def _trio(spark, d):
    return table(spark, d, "lineitem").select(
        F.array(F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100).alias("x"),
        F.col("l_quantity").alias("w"), F.col("l_returnflag").alias("label"),
    )


@query(
    "weighted_covariance",
    """
    WITH l AS (SELECT l_returnflag AS label, l_quantity AS w, [l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS x FROM lineitem),
    e AS (SELECT label, w, a.i, b.j, x[a.i + 1] AS p, x[b.j + 1] AS q FROM l CROSS JOIN (SELECT unnest(range(0, 3)) AS i) a CROSS JOIN (SELECT unnest(range(0, 3)) AS j) b)
    SELECT label, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(w * p * q) / sum(w) - (sum(w * p) / sum(w)) * (sum(w * q) / sum(w)), 4) AS cov FROM e GROUP BY ALL
    """,
)
def _cov(spark, d):
    return _r(moments.weighted_covariance(_trio(spark, d), 3, "w", ["label"]), ["cov"], 4)


@query(
    "cross_cov_regression",
    """
    WITH l AS (SELECT l_returnflag AS label, l_extendedprice / 1000 AS y1, l_tax * 100 AS y2, l_quantity AS x FROM lineitem)
    SELECT label, 0 AS "row", 0 AS col, round(regr_slope(y1, x), 6) AS a FROM l GROUP BY label
    UNION ALL SELECT label, 1, 0, round(regr_slope(y2, x), 6) FROM l GROUP BY label
    """,
)
def _cross(spark, d):
    df = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.array(F.col("l_extendedprice") / 1000, F.col("l_tax") * 100).alias("y"), F.array("l_quantity").alias("x")
    )
    return _r(moments.cross_cov_regression(df, "y", "x", 2, 1, None, ["label"]), ["a"])


@query(
    "param_mean_var",
    "SELECT p_type, round(avg(p_size), 6) AS mean, round(var_pop(p_size), 6) AS var, round(log2(avg(p_size)), 6) AS log2_mean FROM part GROUP BY p_type",
)
def _param(spark, d):
    return _r(moments.param_mean_var(table(spark, d, "part"), ["p_type"], "p_size"), ["mean", "var", "log2_mean"])


@query(
    "linear_rls",
    """
    WITH l AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
    s AS (SELECT sum(x * x) AS xx, sum(x) AS x, count(*) AS n, sum(x * y) AS xy, sum(y) AS y FROM l)
    SELECT round(((xy) * n - x * y) / ((xx + 0.5 * n) * n - x * x), 6) AS slope, round(((xx + 0.5 * n) * y - x * xy) / ((xx + 0.5 * n) * n - x * x), 6) AS bias FROM s
    """,
)
def _rls(spark, d):
    df = table(spark, d, "lineitem").select(F.array("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return moments.linear_rls(df, "y", 1, 0.5).select(r6(F.col("w")[0]).alias("slope"), r6(F.col("w")[1]).alias("bias"))


_CLS = f"{_EX}, mv AS (SELECT label, dim, avg(v) AS m, greatest(var_pop(v), 1e-4) AS s FROM ex GROUP BY ALL)"
_LP = "-0.5 * sum(power(v - m, 2) / s + ln(s) + ln(2 * pi()))"


@query("gaussian_logpdf", f"WITH {_CLS} SELECT ex.id, ex.label, round({_LP}, 5) AS loglik FROM ex JOIN mv USING (label, dim) GROUP BY ALL")
def _logpdf(spark, d):
    v = vectors(spark, d)
    m = cut(moments.class_mean_var(v, D64))
    return v.join(m, "label").select("id", "label", r6(gaussian_logpdf(F.col("x"), F.col("mean"), F.col("var")), 5).alias("loglik"))


@query(
    "gmm_classify",
    f"""
    WITH {_CLS}, n AS (SELECT label, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM vec) AS p FROM vec GROUP BY label),
    l AS (SELECT ex.id AS row_id, mv.label, {_LP} AS ll FROM ex JOIN mv USING (dim) GROUP BY ALL),
    z AS (SELECT row_id, label, ll, ll + ln(p) - max(ll + ln(p)) OVER (PARTITION BY row_id) AS a FROM l JOIN n USING (label))
    SELECT row_id, label, round(ll, 5) AS loglik, round(exp(a) / sum(exp(a)) OVER (PARTITION BY row_id), 6) AS prob FROM z
    """,
)
def _classify(spark, d):
    v = vectors(spark, d)
    model = mixture.one_gaussian(v, D64)
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(v.agg(F.count(F.lit(1)).alias("t")))
    out = mixture.gmm_classify(v, model, n.select("label", (F.col("n") / F.col("t")).alias("prior")))
    return out.withColumns({"loglik": r6(F.col("loglik"), 5), "prob": r6(F.col("prob"))})


def _pairs2(spark, d):
    return spread_table(spark, d, "lineitem").select(F.array(F.col("l_quantity") / 10, F.col("l_discount") * 100).alias("x"), F.col("l_returnflag").alias("label"))


def _em_sql(steps: int) -> str:
    parts = [
        "l AS (SELECT row_number() OVER () AS id, l_returnflag AS label, l_quantity / 10 AS a, l_discount * 100 AS b FROM lineitem)",
        "m0 AS (SELECT label, avg(a) AS ma, avg(b) AS mb, greatest(var_pop(a), 1e-4) AS va, greatest(var_pop(b), 1e-4) AS vb FROM l GROUP BY label)",
        """m1 AS (SELECT label, 0 AS comp, 0.5::DOUBLE AS w, ma - 0.2 * sqrt(va) AS ma, mb - 0.2 * sqrt(vb) AS mb, va, vb FROM m0
           UNION ALL SELECT label, 1, 0.5, ma + 0.2 * sqrt(va), mb + 0.2 * sqrt(vb), va, vb FROM m0)""",
    ]
    for i in range(1, steps + 1):
        parts += [
            f"""e{i} AS (SELECT l.id, l.label, comp, a, b, ln(w) - 0.5 * (power(a - ma, 2) / va + ln(va) + power(b - mb, 2) / vb + ln(vb) + 2 * ln(2 * pi())) AS lp
                 FROM l JOIN m{i} USING (label))""",
            f"r{i} AS (SELECT *, max(lp) OVER (PARTITION BY id) AS mx, sum(exp(lp)) OVER (PARTITION BY id) AS z FROM e{i})",
            f"q{i} AS (SELECT *, exp(lp) / z AS r FROM r{i})",
            f"""m{i + 1} AS (SELECT label, comp, sum(r) / sum(sum(r)) OVER (PARTITION BY label) AS w, sum(r * a) / sum(r) AS ma, sum(r * b) / sum(r) AS mb,
                 greatest(sum(r * a * a) / sum(r) - power(sum(r * a) / sum(r), 2), 1e-4) AS va, greatest(sum(r * b * b) / sum(r) - power(sum(r * b) / sum(r), 2), 1e-4) AS vb,
                 sum(ln(z)) AS ll, count(*) AS n FROM q{i} GROUP BY label, comp)""",
        ]
    return "WITH " + ", ".join(parts)


@query(
    "gmm_em_step",
    _em_sql(2) + " SELECT label, comp, round(w, 6) AS weight, round(ma, 5) AS m1, round(mb, 5) AS m2, round(va, 5) AS v1, round(vb, 5) AS v2, round(ll, 2) AS loglik, n FROM m3",
)
def _em(spark, d):
    df = _pairs2(spark, d)
    model = mixture.split_heaviest(mixture.one_gaussian(df, 2))
    one = mixture.gmm_em_step(df, model, 2).drop("loglik", "n")
    two = mixture.gmm_em_step(df, one, 2)
    return two.select(
        "label", "comp", r6(F.col("weight")).alias("weight"), *[r6(F.col("mean")[i], 5).alias(f"m{i + 1}") for i in range(2)],
        *[r6(F.col("var")[i], 5).alias(f"v{i + 1}") for i in range(2)], r6(F.col("loglik"), 2).alias("loglik"), "n",
    )


@query("drop_light_components", _em_sql(1) + ", k AS (SELECT * FROM m2 WHERE w >= 0.49) SELECT label, comp, round(w / sum(w) OVER (PARTITION BY label), 6) AS weight FROM k")
def _light(spark, d):
    df = _pairs2(spark, d)
    one = mixture.gmm_em_step(df, mixture.split_heaviest(mixture.one_gaussian(df, 2)), 2)
    return mixture.drop_light_components(one, 0.49).select("label", "comp", r6(F.col("weight")).alias("weight"))


def _flat(model):
    return model.select("label", "comp", r6(F.col("weight"), 4).alias("weight"), r6(F.col("mean")[0], 3).alias("m1"), r6(F.col("mean")[1], 3).alias("m2"))


@query("gmm_fit")
def _fit(spark, d):
    return _flat(mixture.gmm_fit(_pairs2(spark, d), 2, 2))


@query("gmm_select_bic")
def _bic(spark, d):
    return _flat(mixture.gmm_select_bic(_pairs2(spark, d), 2))


@query(
    "gmm_discriminative_step",
    _em_sql(0) + """,
    sh AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM l GROUP BY label),
    lp AS (SELECT l.id, l.label, m1.label AS cls, comp, a, b, ln(w * share) - 0.5 * (power(a - ma, 2) / va + ln(va) + power(b - mb, 2) / vb + ln(vb) + 2 * ln(2 * pi())) AS lp FROM l CROSS JOIN m1 JOIN sh ON sh.label = m1.label),
    po AS (SELECT *, exp(lp) / sum(exp(lp)) OVER (PARTITION BY id) AS g, CASE WHEN cls = label THEN exp(lp) / sum(CASE WHEN cls = label THEN exp(lp) END) OVER (PARTITION BY id) ELSE 0 END AS o FROM lp),
    su AS (SELECT cls AS label, comp, sum(o - g) AS surplus, greatest(2 * sum(g), 1) AS d, sum((o - g) * a) AS a1, sum((o - g) * b) AS b1, sum((o - g) * a * a) AS a2, sum((o - g) * b * b) AS b2 FROM po GROUP BY ALL),
    up AS (SELECT label, comp, greatest(surplus + d * w, 1e-10) AS w, (a1 + d * ma) / (surplus + d) AS m1, (b1 + d * mb) / (surplus + d) AS m2,
           greatest((a2 + d * (va + ma * ma)) / (surplus + d) - power((a1 + d * ma) / (surplus + d), 2), 1e-4) AS v1, greatest((b2 + d * (vb + mb * mb)) / (surplus + d) - power((b1 + d * mb) / (surplus + d), 2), 1e-4) AS v2, surplus
           FROM su JOIN m1 USING (label, comp))
    SELECT label, comp, round(w / sum(w) OVER (PARTITION BY label), 4) AS weight, round(m1, 3) AS m1, round(m2, 3) AS m2, round(v1, 3) AS v1, round(v2, 3) AS v2, round(surplus, 2) AS surplus FROM up""",
)
def _mmi(spark, d):
    df = _pairs2(spark, d)
    out = mixture.gmm_discriminative_step(df, mixture.split_heaviest(mixture.one_gaussian(df, 2)), 2)
    return out.select(
        "label", "comp", r6(F.col("weight"), 4).alias("weight"), *[r6(F.col(c)[i], 3).alias(f"{c[0]}{i + 1}") for c in ("mean", "var") for i in range(2)], r6(F.col("surplus"), 2).alias("surplus")
    )


@query("gmm_grow_discriminative")
def _grow_mmi(spark, d):
    return _flat(mixture.gmm_grow_discriminative(_pairs2(spark, d), 2))


_FULL = """
l AS (SELECT row_number() OVER () AS rid, l_returnflag AS label, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS id, l_extendedprice / 1000 AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM lineitem),
mu AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS prior, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM l GROUP BY label),
cv AS (SELECT label, any_value(prior) AS prior, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mc) AS mc, avg((a - ma) * (a - ma)) AS aa, avg((a - ma) * (b - mb)) AS ab, avg((a - ma) * (c - mc)) AS ac,
       avg((b - mb) * (b - mb)) AS bb, avg((b - mb) * (c - mc)) AS bc, avg((c - mc) * (c - mc)) AS cc FROM l JOIN mu USING (label) GROUP BY label),
dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM cv),
sc AS (SELECT l.rid, l.id, l.label AS own, dt.label, prior, -0.5 * (3 * ln(2 * pi()) + ln(det) + (
       power(l.a - ma, 2) * (bb * cc - bc * bc) + power(l.b - mb, 2) * (aa * cc - ac * ac) + power(l.c - mc, 2) * (aa * bb - ab * ab)
       + 2 * (l.a - ma) * (l.b - mb) * (ac * bc - ab * cc) + 2 * (l.a - ma) * (l.c - mc) * (ab * bc - ac * bb) + 2 * (l.b - mb) * (l.c - mc) * (ab * ac - aa * bc)) / det) AS ll FROM l CROSS JOIN dt)
"""


def _trio_rows(spark, d):
    return spread_table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice")).alias("id"),
        F.array(F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100).alias("x"), F.col("l_returnflag").alias("label"),
    )


@query("gaussian_logpdf_full", f"WITH {_FULL} SELECT own AS label, count(*) AS n, round(sum(ll), 3) AS total, round(min(ll), 5) AS least, round(max(ll), 5) AS most FROM sc WHERE own = label GROUP BY own")
def _logpdf_full(spark, d):
    v = _trio_rows(spark, d)
    ll = v.join(cut(moments.full_gaussian(v, 3)), "label").select("label", gaussian_logpdf_full(F.col("x"), F.col("mean"), F.col("factor")).alias("ll"))
    return ll.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("ll"), 3).alias("total"), r6(F.min("ll"), 5).alias("least"), r6(F.max("ll"), 5).alias("most"))


@query("full_classify", f"WITH {_FULL} SELECT id AS row_id, label, round(ll, 5) AS loglik, round(prior * exp(ll) / sum(prior * exp(ll)) OVER (PARTITION BY rid), 6) AS prob FROM sc")
def _full_classes(spark, d):
    v = _trio_rows(spark, d)
    model = cut(moments.full_gaussian(v, 3))
    priors = mixture.class_shares(v).withColumnRenamed("share", "prior")
    return _r(_r(mixture.full_classify(v, model, priors), ["loglik"], 5), ["prob"])


@query("kmeans_codebook")
def _codebook(spark, d):
    out = cluster.kmeans_codebook(vectors(spark, d).select("x", "label"), D64, 2, ["label"])
    return out.select("label", "code", *[r6(F.col("center")[i], 4).alias(f"c{i + 1}") for i in range(D64)])


_ASG = f"""
{CENTROID}, nearest AS (SELECT row_id, class, d2 FROM dist QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d2, class) = 1),
asg AS (SELECT row_id, CASE WHEN d2 < 1.02 THEN CAST(class AS INTEGER) END AS cluster, exp(-d2) AS density, vec.label FROM nearest JOIN vec ON vec.id = row_id)
"""


def _assign(spark, d):
    near = centroid_distances(spark, d).groupBy("row_id").agg(F.min(F.struct("d2", "class")).alias("b"))
    labels = vectors(spark, d).select(F.col("id").alias("row_id"), "label")
    return near.join(labels, "row_id").select(
        "row_id", F.when(F.col("b.d2") < 1.02, F.col("b.class").cast("int")).alias("cluster"), F.exp(-F.col("b.d2")).alias("density"), "label"
    )


@query(
    "cluster_sizes",
    f"WITH {_ASG} SELECT cluster, count(*) AS n, round(avg(ln(density)), 6) AS mean_log_density, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM asg), 6) AS share FROM asg GROUP BY cluster",
)
def _sizes(spark, d):
    return _r(cluster.cluster_sizes(_assign(spark, d)), ["mean_log_density", "share"])


@query("classes_to_clusters", f"WITH {_ASG} SELECT label, cluster, count(*) AS n FROM asg WHERE cluster IS NOT NULL GROUP BY ALL")
def _c2c(spark, d):
    return cluster.classes_to_clusters(_assign(spark, d))


@query("map_clusters")
def _map(spark, d):
    return cluster.map_clusters(cluster.classes_to_clusters(_assign(spark, d)))


@query("cluster_cv_loglik")
def _ccv(spark, d):
    li = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("id"), F.array(F.col("l_quantity") / 10, F.col("l_discount") * 100).alias("x")
    )
    return _r(cluster.cluster_cv_loglik(assign_folds(li, 4, label=None), 2, 2, 4), ["mean_log_density"], 4)


@query(
    "hard_assignment_distribution",
    f"WITH {_ASG} SELECT row_id, " + ", ".join(f"CASE WHEN cluster = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c{c}" for c in range(10)) + " FROM asg",
)
def _hard(spark, d):
    return cluster.hard_assignment_distribution(_assign(spark, d), list(range(10)))
