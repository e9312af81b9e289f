"""Queries over trees, rules, item sets, neighbours and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.registry import query
from strandlab.catalog.tables import ATTRS, CUST, GAPPY, INST, OVR, VEC, customers_mixed, orders_gappy, orders_nominal, ovr_scores, r6, table, vectors
from strandlab.catalog.tables_queries import _SPLIT, _train_test
from strandlab.functions.exprs import seeded_hash
from strandlab.operators import itemsets, neighbors, rules
from strandlab.operators.counts import contingency


def _long(source: str, cols: str) -> str:
    return " UNION ALL ".join(f"SELECT {cols}, '{a}' AS attr, {a} AS value FROM {source}" for a in ATTRS)


def _id3_sql(depth: int) -> str:
    parts = [INST.strip(), "n0 AS (SELECT *, '' AS node FROM inst)"]
    out = []
    for i in range(depth + 1):
        parts.append(
            f"""p{i} AS (SELECT node, label AS predicted, w, sum(w) OVER (PARTITION BY node) AS n
                FROM (SELECT node, label, count(*) AS w FROM n{i} GROUP BY ALL)
                QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, label) = 1)"""
        )
        if i == depth:
            out.append(f"SELECT node, {i} AS depth, CAST(NULL AS VARCHAR) AS attr, predicted, CAST(n AS DOUBLE) AS n FROM p{i}")
            continue
        parts += [
            f"l{i} AS ({_long(f'n{i}', 'node, label')})",
            f"c{i} AS (SELECT node, attr, value, label, CAST(count(*) AS DOUBLE) AS w FROM l{i} GROUP BY ALL)",
            f"a{i} AS (SELECT node, attr, sum(w) AS n, sum(w * log2(w)) AS cells FROM c{i} GROUP BY ALL)",
            f"b{i} AS (SELECT node, attr, sum(w * log2(w)) AS bags FROM (SELECT node, attr, value, sum(w) AS w FROM c{i} GROUP BY ALL) GROUP BY ALL)",
            f"d{i} AS (SELECT node, attr, sum(w * log2(w)) AS cls FROM (SELECT node, attr, label, sum(w) AS w FROM c{i} GROUP BY ALL) GROUP BY ALL)",
            f"""g{i} AS (SELECT node, attr, (n * log2(n) - cls - bags + cells) / n AS gain FROM a{i} JOIN b{i} USING (node, attr) JOIN d{i} USING (node, attr)
                QUALIFY row_number() OVER (PARTITION BY node ORDER BY round((n * log2(n) - cls - bags + cells) / n, 9) DESC, attr) = 1)""",
            f"s{i} AS (SELECT * FROM g{i} WHERE gain > 1e-6)",
            f"""n{i + 1} AS (SELECT n{i}.* EXCLUDE (node, st), CASE WHEN node = '' THEN st ELSE node || '/' || st END AS node FROM
                (SELECT n{i}.*, s{i}.attr || '=' || CASE s{i}.attr WHEN 'priority' THEN priority WHEN 'year' THEN year ELSE band END AS st
                 FROM n{i} JOIN s{i} USING (node)) n{i})""",
        ]
        out.append(f"SELECT node, {i} AS depth, s{i}.attr, predicted, CAST(n AS DOUBLE) AS n FROM p{i} LEFT JOIN s{i} USING (node)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(out)


@query("id3_tree", _id3_sql(2))
def _id3(spark, d):
    return rules.id3_tree(orders_nominal(spark, d), ATTRS, max_depth=2).drop("gain")


@query(
    "tree_score",
    f"""
    WITH {INST}, cells AS (SELECT priority, year, band, label, count(*) AS w FROM inst GROUP BY ALL),
    b AS (SELECT priority, year, band, label AS predicted FROM cells QUALIFY row_number() OVER (PARTITION BY priority, year, band ORDER BY w DESC, label) = 1)
    SELECT id, label, predicted FROM inst JOIN b USING (priority, year, band)
    """,
)
def _tree_score(spark, d):
    # grown to full depth, every attribute combination with a mixed class is a leaf
    df = orders_nominal(spark, d)
    model = rules.id3_tree(df, ATTRS)
    return rules.tree_score(df, model, ATTRS).select("id", "label", "predicted")


def _cover_sql() -> str:
    parts = [
        INST.strip(),
        "cell AS (SELECT priority, year, band, label, count(*) AS w FROM inst GROUP BY ALL)",
        "v0 AS (SELECT t.label AS target, cell.*, '' AS used, [''] AS test, 0 AS covers, -1 AS correct FROM cell CROSS JOIN (SELECT DISTINCT label FROM inst) t)",
    ]
    pick = " ".join(f"WHEN '{a}' THEN {a}" for a in ATTRS)
    for i in range(len(ATTRS)):
        stack = " UNION ALL ".join(
            f"SELECT target, label, w, {p} AS pos, '{a}' AS attr, {a} AS value FROM v{i} WHERE covers <> correct AND NOT contains(used, '{a}')" for p, a in enumerate(ATTRS)
        )
        parts += [
            f"t{i} AS (SELECT target, pos, attr, value, sum(w) AS cv, sum(CASE WHEN label = target THEN w ELSE 0 END) AS ck FROM ({stack}) GROUP BY ALL)",
            f"""b{i} AS (SELECT * FROM t{i} QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(CAST(ck AS DOUBLE) / cv, 12) DESC, ck DESC, pos, value) = 1)""",
            f"""v{i + 1} AS (SELECT v.target, v.priority, v.year, v.band, v.label, v.w,
                 CASE WHEN b.attr IS NULL THEN v.used ELSE v.used || ',' || b.attr END AS used,
                 CASE WHEN b.attr IS NULL THEN v.test ELSE list_append(v.test, b.attr || '=' || b.value) END AS test,
                 coalesce(b.cv, v.covers) AS covers, coalesce(b.ck, v.correct) AS correct
               FROM v{i} v LEFT JOIN b{i} b ON b.target = v.target WHERE b.attr IS NULL OR (CASE b.attr {pick} END) = b.value)""",
        ]
    last = f"v{len(ATTRS)}"
    return "WITH " + ", ".join(parts) + f""" SELECT DISTINCT target, array_to_string(list_sort(list_filter(test, lambda x: x <> '')), '&') AS test,
        CAST(covers AS DOUBLE) AS covers, CAST(correct AS DOUBLE) AS correct FROM {last}"""


@query("covering_first_rules", _cover_sql())
def _cover_first(spark, d):
    out = rules.covering_rules(orders_nominal(spark, d), ATTRS, max_rules=1)
    return out.select("target", F.array_join("test", "&").alias("test"), "covers", "correct")


def _doc_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    lab = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"), F.col("quality").cast("string").alias("label"))
    return docs.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "lang", "toxic", "label")


@query("covering_rules")
def _cover(spark, d):
    df = _doc_quality(spark, d)
    found = rules.covering_rules(df, ["lang", "toxic"])
    return rules.covering_predict(df, found, ["lang", "toxic"]).groupBy("label", "predicted").count()


@query("covered_by", f"WITH {GAPPY} SELECT id FROM gappy WHERE priority = '1-URGENT' AND year = '1997'")
def _covered(spark, d):
    return rules.covered_by(orders_gappy(spark, d), {"priority": "1-URGENT", "year": "1997"}).select("id")


@query("not_covered_by", f"WITH {GAPPY} SELECT id FROM gappy WHERE NOT coalesce(priority = '1-URGENT' AND year = '1997', false)")
def _not_covered(spark, d):
    return rules.not_covered_by(orders_gappy(spark, d), {"priority": "1-URGENT", "year": "1997"}).select("id")


@query(
    "rule_cascade_score",
    f"""
    WITH {INST}, c AS (SELECT attr, value, label, count(*) AS w FROM lng GROUP BY ALL),
    r AS (SELECT attr, value, CAST(max(w) AS DOUBLE) / sum(w) AS weight FROM c GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (ORDER BY round(weight, 9) DESC, attr, value) AS ord FROM r),
    m AS (SELECT l.id, o.ord, o.attr, o.value, o.weight, coalesce(sum(ln(1 - o.weight)) OVER (PARTITION BY l.id ORDER BY o.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lr
          FROM lng l JOIN o ON o.attr = l.attr AND o.value = l.value),
    p AS (SELECT attr, value, label, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY attr, value) AS p FROM c)
    SELECT m.id, p.label, round(sum(exp(m.lr) * p.p), 6) AS score FROM m JOIN p ON p.attr = m.attr AND p.value = m.value GROUP BY ALL
    """,
)
def _cascade(spark, d):
    from pyspark.sql.window import Window

    df = orders_nominal(spark, d)
    c = contingency(df, ATTRS)
    labels = ["F", "O", "P"]
    per = c.groupBy("attr", "value").agg(
        (F.max("w") / F.sum("w")).alias("weight"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("label") == v, F.col("w"))), F.lit(0.0)) / F.sum("w") for v in labels]).alias("probs"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy(F.round("weight", 9).desc(), "attr", "value")
    model = per.select(F.row_number().over(w).alias("ord"), F.array(F.concat_ws("=", "attr", "value")).alias("test"), "weight", "probs")
    out = rules.rule_cascade_score(df, model, ATTRS, len(labels))
    z = F.arrays_zip(F.array(*[F.lit(v) for v in labels]).alias("label"), F.transform("probs", lambda p: F.round(p, 6)).alias("score"))
    return out.select("id", F.explode(z).alias("z")).select("id", "z.label", "z.score")


# -- item sets -----------------------------------------------------------------

ITEMS = f"""
{INST}, it AS (SELECT id, attr || '=' || value AS i FROM lng UNION ALL SELECT id, 'label=' || label FROM inst),
nn AS (SELECT count(*) AS n FROM inst), lo AS (SELECT CAST(floor(0.01 * n + 0.5) AS BIGINT) AS lo FROM nn),
f1 AS (SELECT i AS a, count(*) AS n FROM it GROUP BY i HAVING count(*) >= (SELECT lo FROM lo)),
t1 AS (SELECT id, i FROM it WHERE i IN (SELECT a FROM f1)),
t2 AS (SELECT x.id, x.i AS a, y.i AS b FROM t1 x JOIN t1 y ON x.id = y.id AND x.i < y.i),
f2 AS (SELECT a, b, count(*) AS n FROM t2 GROUP BY ALL HAVING count(*) >= (SELECT lo FROM lo)),
t3 AS (SELECT t2.id, t2.a, t2.b, t1.i AS c FROM t2 JOIN t1 ON t1.id = t2.id AND t1.i > t2.b),
f3 AS (SELECT a, b, c, count(*) AS n FROM t3 GROUP BY ALL HAVING count(*) >= (SELECT lo FROM lo)),
f4 AS (SELECT a, b, c, t1.i AS d, count(*) AS n FROM t3 JOIN t1 ON t1.id = t3.id AND t1.i > t3.c GROUP BY ALL HAVING count(*) >= (SELECT lo FROM lo)),
fs AS (SELECT a AS itemset, 1 AS size, n FROM f1 UNION ALL SELECT a || '&' || b, 2, n FROM f2 UNION ALL SELECT a || '&' || b || '&' || c, 3, n FROM f3
       UNION ALL SELECT a || '&' || b || '&' || c || '&' || d, 4, n FROM f4)
"""


def _rule_splits() -> str:
    """Every premise and consequence of the sets of two, three and four items."""
    parts = []
    for table, names in (("f2", "ab"), ("f3", "abc"), ("f4", "abcd")):
        for mask in range(1, 2 ** len(names) - 1):
            side = [" || '&' || ".join(x for i, x in enumerate(names) if (mask >> i) % 2 == bit) for bit in (1, 0)]
            parts.append(f"SELECT {side[0]} AS p, {side[1]} AS q, n FROM {table}")
    return " UNION ALL ".join(parts)


ITEM_ATTRS = [*ATTRS, "label"]


@query("frequent_itemsets", f"WITH {ITEMS} SELECT itemset, size, n FROM fs")
def _itemsets(spark, d):
    out = itemsets.frequent_itemsets(orders_nominal(spark, d), ITEM_ATTRS, 0.01)
    return out.select(F.array_join("itemset", "&").alias("itemset"), "size", "n")


RULES = f"""
{ITEMS},
ru AS ({_rule_splits()}),
rm AS (SELECT p, q, ru.n, x.n AS np, y.n AS nq, t.n AS t FROM ru JOIN fs x ON x.itemset = p JOIN fs y ON y.itemset = q, nn t),
rr AS (SELECT p AS premise, q AS consequence, n, CAST(n AS DOUBLE) / np AS confidence, (CAST(n AS DOUBLE) / np) / (CAST(nq AS DOUBLE) / t) AS lift,
  CAST(n AS DOUBLE) / t - (CAST(np AS DOUBLE) / t) * (CAST(nq AS DOUBLE) / t) AS leverage,
  CAST(np AS DOUBLE) * (t - nq) * t / (np - n + 1) AS conviction,
  CAST(t AS DOUBLE) * power(CAST(n AS DOUBLE) * (t - np - nq + n) - CAST(np - n AS DOUBLE) * (nq - n), 2) / (CAST(np AS DOUBLE) * (t - np) * nq * (t - nq)) AS chi
  FROM rm)
"""


def _rule_cols(out):
    return out.select(
        F.array_join("premise", "&").alias("premise"), F.array_join("consequence", "&").alias("consequence"), "n",
        r6(F.col("confidence")).alias("confidence"), r6(F.col("lift")).alias("lift"), r6(F.col("leverage"), 8).alias("leverage"),
        r6(F.col("conviction"), 2).alias("conviction"),
    )


_RULE_SQL = "premise, consequence, n, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage, 8) AS leverage, round(conviction, 2) AS conviction"


@query("association_rules", f"WITH {RULES} SELECT {_RULE_SQL} FROM rr WHERE confidence >= 0.3")
def _rules(spark, d):
    df = orders_nominal(spark, d)
    sets = itemsets.frequent_itemsets(df, ITEM_ATTRS, 0.01)
    return _rule_cols(itemsets.association_rules(sets, df.count(), "confidence", 0.3))


@query("association_rules_lift", f"WITH {RULES} SELECT {_RULE_SQL} FROM rr WHERE lift >= 1.05")
def _rules_lift(spark, d):
    df = orders_nominal(spark, d)
    sets = itemsets.frequent_itemsets(df, ITEM_ATTRS, 0.01)
    return _rule_cols(itemsets.association_rules(sets, df.count(), "lift", 1.05))


@query("chi_square", f"WITH {RULES} SELECT premise, consequence, round(chi, 4) AS chi_square FROM rr WHERE chi >= 3.841458820694124")
def _chi(spark, d):
    df = orders_nominal(spark, d)
    sets = itemsets.frequent_itemsets(df, ITEM_ATTRS, 0.01)
    out = itemsets.association_rules(sets, df.count(), "confidence", 0.0, significance=0.05)
    return out.select(F.array_join("premise", "&").alias("premise"), F.array_join("consequence", "&").alias("consequence"), r6(F.col("chi_square"), 4).alias("chi_square"))


@query(
    "top_rules",
    f"""
    WITH RECURSIVE {RULES},
    cyc(i, s) AS (SELECT 0, greatest(1.0 - 0.05, 0.01)::DOUBLE UNION ALL SELECT i + 1, greatest(s - 0.05, 0.01) FROM cyc WHERE s > 0.01 + 1e-12),
    cn AS (SELECT i, CAST(floor(s * n + 0.5) AS BIGINT) AS c FROM cyc, nn),
    ok AS (SELECT i, c, (SELECT count(*) FROM rr WHERE confidence >= 0.3 AND n >= c) AS held FROM cn),
    ch AS (SELECT c FROM ok ORDER BY CASE WHEN held >= 10 THEN 0 ELSE 1 END, CASE WHEN held >= 10 THEN i ELSE -i END LIMIT 1)
    SELECT {_RULE_SQL} FROM rr WHERE confidence >= 0.3 AND n >= (SELECT c FROM ch)
    ORDER BY round(rr.confidence, 9) DESC, n DESC, string_split(premise, '&'), string_split(consequence, '&') LIMIT 10
    """,
)
def _top_rules(spark, d):
    return _rule_cols(itemsets.top_rules(orders_nominal(spark, d), ITEM_ATTRS, 10, 0.05, 0.01, 1.0, "confidence", 0.3))


@query(
    "itemset_contains",
    f"WITH {GAPPY} SELECT id AS row_id, 'band=2&priority=1-URGENT' AS itemset FROM gappy WHERE band = '2' AND priority = '1-URGENT' "
    "UNION ALL SELECT id, 'year=1996' FROM gappy WHERE year = '1996'",
)
def _contains(spark, d):
    sets = spark.createDataFrame([(["band=2", "priority=1-URGENT"],), (["year=1996"],)], "itemset array<string>")
    out = itemsets.itemset_contains(orders_gappy(spark, d), "id", ATTRS, sets)
    return out.select("row_id", F.array_join("itemset", "&").alias("itemset"))


# -- neighbours ----------------------------------------------------------------

KNN = f"""
{CUST}, tr0 AS (SELECT * FROM cust WHERE {_SPLIT}), te0 AS (SELECT * FROM cust WHERE NOT {_SPLIT}),
st AS (SELECT min(bal) AS lo, max(bal) AS hi FROM tr0),
tr AS (SELECT id, (bal - lo) / (hi - lo) AS b, nation, label FROM tr0, st), te AS (SELECT id, (bal - lo) / (hi - lo) AS b, nation, label FROM te0, st)
"""


def _dist(q: str, t: str) -> str:
    return f"""round(sqrt((CASE WHEN {q}.b IS NULL AND {t}.b IS NULL THEN 1.0 WHEN {t}.b IS NULL THEN power(greatest({q}.b, 1 - {q}.b), 2)
      WHEN {q}.b IS NULL THEN power(greatest({t}.b, 1 - {t}.b), 2) ELSE power({q}.b - {t}.b, 2) END
      + CASE WHEN {q}.nation = {t}.nation THEN 0.0 ELSE 1.0 END) / 2), 9)"""


PAIRS_SQL = f"""
{KNN}, pr AS (SELECT q.id AS query, t.id AS neighbor, t.label, {_dist('q', 't')} AS distance FROM te q CROSS JOIN tr t),
nn AS (SELECT * FROM pr QUALIFY rank() OVER (PARTITION BY query ORDER BY distance) <= 5)
"""


def _near(spark, d, k=5):
    train, test = _train_test(customers_mixed(spark, d))
    return neighbors.knn_topk(test, train, k, ["bal"], ["nation"]), train


@query("knn_topk", f"WITH {PAIRS_SQL} SELECT query, neighbor, label, round(distance, 6) AS distance FROM nn")
def _knn(spark, d):
    near, train = _near(spark, d)
    out = neighbors.with_train_ids(near, train, ["bal"], ["nation"])
    return out.select("query", "neighbor", "label", r6(F.col("distance")).alias("distance"))


@query(
    "knn_pairs",
    f"""
    WITH {PAIRS_SQL} SELECT query, label, round(distance, 6) AS distance, CAST(count(*) AS DOUBLE) AS w,
      CAST(min(rk) - 1 AS DOUBLE) AS closer FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY distance) AS rk FROM pr)
    WHERE rk <= 3 GROUP BY query, label, distance
    """,
)
def _knn_groups(spark, d):
    near, _ = _near(spark, d, 3)
    g = near.groupBy("query", "label", "distance").agg(F.sum("w").alias("w"), F.min("closer").alias("closer"))
    return g.withColumn("distance", r6(F.col("distance")))


def _vote_sql(weight: str) -> str:
    return f"""
    WITH {PAIRS_SQL}, dm AS (SELECT DISTINCT label FROM tr), n AS (SELECT count(*) AS n FROM tr),
    v AS (SELECT query, label, sum({weight}) AS v FROM nn GROUP BY ALL),
    g AS (SELECT q.query, dm.label, coalesce(v.v, 0) + 1.0 / n AS s FROM (SELECT DISTINCT query FROM nn) q CROSS JOIN dm CROSS JOIN n
          LEFT JOIN v ON v.query = q.query AND v.label = dm.label)
    SELECT query, label, round(s / sum(s) OVER (PARTITION BY query), 6) AS prob FROM g
    """


def _vote(spark, d, weighting):
    near, train = _near(spark, d)
    out = neighbors.knn_vote(near, train.select("label").distinct(), train.agg(F.count(F.lit(1)).alias("n")), weighting)
    return out.select("query", F.explode(F.arrays_zip(F.col("classes").alias("label"), F.transform("probs", lambda p: F.round(p, 6)).alias("prob"))).alias("z")).select("query", "z.label", "z.prob")


@query("knn_vote", _vote_sql("1.0::DOUBLE"))
def _vote_none(spark, d):
    return _vote(spark, d, "none")


@query("knn_vote_inverse", _vote_sql("1.0 / (distance + 0.001)"))
def _vote_inverse(spark, d):
    return _vote(spark, d, "inverse")


@query("knn_vote_similarity", _vote_sql("1.0 - distance"))
def _vote_similarity(spark, d):
    return _vote(spark, d, "similarity")


@query(
    "knn_regress",
    f"""
    WITH {VEC}, tr AS (SELECT * FROM vec WHERE {_SPLIT}), te AS (SELECT * FROM vec WHERE NOT {_SPLIT}),
    pr AS (SELECT q.id AS query, CAST(t.label AS DOUBLE) AS y, round(list_distance(q.x, t.x), 9) AS distance FROM te q CROSS JOIN tr t),
    nn AS (SELECT * FROM pr QUALIFY rank() OVER (PARTITION BY query ORDER BY distance) <= 7)
    SELECT query, round(sum(y / (distance + 0.001)) / sum(1 / (distance + 0.001)), 5) AS predicted FROM nn GROUP BY query
    """,
)
def _regress(spark, d):
    train, test = _train_test(vectors(spark, d).withColumn("label", F.col("label").cast("double")))
    near = neighbors.knn_topk(test, train, 7, vector="x")
    return neighbors.knn_regress(near, "inverse").withColumn("predicted", r6(F.col("predicted"), 5))


@query(
    "knn_choose_k",
    f"""
    WITH {CUST}, st AS (SELECT min(bal) AS lo, max(bal) AS hi FROM cust),
    c AS (SELECT id, (bal - lo) / (hi - lo) AS b, nation, label FROM cust, st),
    pr AS (SELECT q.id AS query, q.label AS actual, t.label, {_dist('q', 't')} AS distance FROM c q JOIN c t ON q.id <> t.id),
    rk AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY distance) AS r FROM pr QUALIFY r <= 6),
    ks AS (SELECT unnest(range(1, 7)) AS k),
    v AS (SELECT query, actual, k, label, count(*) AS v FROM rk JOIN ks ON r <= k GROUP BY ALL),
    p AS (SELECT query, actual, k, label FROM v QUALIFY row_number() OVER (PARTITION BY query, k ORDER BY v DESC, label) = 1),
    e AS (SELECT CAST(k AS INTEGER) AS k, count(*) AS n, avg(CASE WHEN label = actual THEN 0.0 ELSE 1.0 END) AS error FROM p GROUP BY k)
    SELECT k, n, round(error, 6) AS error, k = (SELECT k FROM e ORDER BY round(error, 9), k LIMIT 1) AS best FROM e
    """,
)
def _choose_k(spark, d):
    out = neighbors.knn_choose_k(customers_mixed(spark, d), 6, ["bal"], ["nation"])
    return out.withColumn("error", r6(F.col("error")))


@query("last_window", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _last(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", "ts")
    return neighbors.last_window(e, ["ts", "event_id"], 1000).drop("ts")


@query(
    "kernel_score",
    f"""
    WITH {VEC}, tr AS (SELECT * FROM vec WHERE {_SPLIT}), cl AS (SELECT DISTINCT label AS clf FROM vec),
    k AS (SELECT q.id AS row_id, t.label, exp(-0.5 * power(list_distance(q.x, t.x), 2)) AS k FROM vec q CROSS JOIN tr t)
    SELECT row_id, clf, round(sum(CASE WHEN label = clf THEN k ELSE -0.1 * k END), 5) AS score,
      CASE WHEN round(sum(CASE WHEN label = clf THEN k ELSE -0.1 * k END), 9) > 0 THEN 1 ELSE -1 END AS sign
    FROM k CROSS JOIN cl GROUP BY ALL
    """,
)
def _kernel(spark, d):
    v = vectors(spark, d)
    train, _ = _train_test(v)
    machines = v.select(F.collect_set("label").alias("c"))
    support = train.join(machines).select(F.explode("c").alias("clf"), "label", "x")
    support = support.select("clf", "x", F.when(F.col("label") == F.col("clf"), 1.0).otherwise(-0.1).alias("alpha"))
    return neighbors.kernel_score(v, support, gamma=0.5).withColumn("score", r6(F.col("score"), 5))


@query(
    "unique_support",
    f"""
    WITH {OVR}, u AS (SELECT row_id, clf FROM ovr JOIN ovrcode USING (clf) JOIN vec ON vec.id = row_id AND vec.label = class WHERE bit * score < 0.05)
    SELECT count(DISTINCT row_id) AS distinct_rows, count(*) AS entries FROM u
    """,
)
def _support(spark, d):
    from strandlab.catalog.tables import class_positions
    from strandlab.operators.decode import code_one_vs_rest

    code = code_one_vs_rest(class_positions(spark, d))
    rows = vectors(spark, d).select(F.col("id").alias("row_id"), F.col("label").alias("class"))
    m = ovr_scores(spark, d).join(code, "clf").join(rows, ["row_id", "class"])
    models = m.select("row_id", "clf", F.when(F.col("bit") * F.col("score") < 0.05, F.col("bit")).otherwise(0).alias("alpha"))
    return neighbors.unique_support(models)
