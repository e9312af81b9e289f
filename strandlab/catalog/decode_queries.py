"""Queries over code matrices and score decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.registry import query
from strandlab.catalog.tables import CENTROID, OVR, PAIRS, VEC, centroid_distances, class_positions, ovr_scores, pair_scores, r6, table, vectors
from strandlab.operators import decode
from strandlab.sources.instances import class_domain

_TYPES = "dom AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM (SELECT DISTINCT event_type AS label FROM events)), nc AS (SELECT count(*) AS n FROM dom)"


def _types(spark, d):
    return class_domain(table(spark, d, "events").select(F.col("event_type").alias("label")))


@query("code_one_vs_rest", f"WITH {_TYPES} SELECT CAST(a.pos AS INTEGER) AS clf, b.label AS class, CASE WHEN a.pos = b.pos THEN 1 ELSE -1 END AS bit FROM dom a CROSS JOIN dom b")
def _ovr(spark, d):
    return decode.code_one_vs_rest(_types(spark, d))


@query(
    "code_all_pairs",
    f"""
    WITH {_TYPES}, p AS (SELECT a.pos AS i, b.pos AS j, CAST(row_number() OVER (ORDER BY a.pos, b.pos) - 1 AS INTEGER) AS clf FROM dom a JOIN dom b ON a.pos < b.pos)
    SELECT clf, label AS class, CASE WHEN pos = i THEN -1 WHEN pos = j THEN 1 ELSE 0 END AS bit FROM p CROSS JOIN dom
    """,
)
def _pairs(spark, d):
    return decode.code_all_pairs(_types(spark, d))


@query(
    "code_complete",
    f"""
    WITH {_TYPES}, c AS (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS clf)
    SELECT clf, label AS class, CASE WHEN pos = 0 THEN 1 WHEN CAST(floor(clf / power(2, 4 - pos)) AS INTEGER) % 2 <> 0 THEN 1 ELSE -1 END AS bit FROM c CROSS JOIN dom
    """,
)
def _complete(spark, d):
    return decode.code_complete(_types(spark, d))


@query(
    "code_split",
    f"""
    WITH {_TYPES}, q AS (SELECT a.pos AS p1, b.pos AS p2, c.pos AS p3, e.pos AS p4 FROM dom a JOIN dom b ON a.pos < b.pos JOIN dom c ON b.pos < c.pos JOIN dom e ON c.pos < e.pos),
    s AS (SELECT *, p2 AS o FROM q UNION ALL SELECT *, p3 FROM q UNION ALL SELECT *, p4 FROM q),
    n AS (SELECT *, CAST(row_number() OVER (ORDER BY p1, p2, p3, p4, o) - 1 AS INTEGER) AS clf FROM s)
    SELECT clf, label AS class, CASE WHEN pos IN (p1, o) THEN 1 WHEN pos IN (p1, p2, p3, p4) THEN -1 ELSE 0 END AS bit FROM n CROSS JOIN dom
    """,
)
def _split(spark, d):
    return decode.code_split(_types(spark, d), 2, 2)


def _v(df):
    return df.withColumn("value", r6(F.col("value")))


_J = "FROM {s} JOIN {s}code USING (clf) GROUP BY row_id, class"
_SG = "(CASE WHEN score <= 0 THEN -1 ELSE 1 END)"


@query("decode_hamming", f"WITH {PAIRS} SELECT row_id, class, round(sum((1 - bit * {_SG}) / 2.0), 6) AS value {_J.format(s='ap')}")
def _hamming(spark, d):
    return _v(decode.decode_hamming(pair_scores(spark, d), decode.code_all_pairs(class_positions(spark, d))))


def _clf_weights(spark, d):
    code = decode.code_all_pairs(class_positions(spark, d))
    return code.select("clf").distinct().select("clf", (1.0 / (F.col("clf") + 1)).alias("weight"))


@query(
    "decode_hamming_weighted",
    f"""
    WITH {PAIRS}, w AS (SELECT DISTINCT clf, 1.0::DOUBLE / (clf + 1) AS weight FROM apcode), wn AS (SELECT sum(weight) AS t FROM w)
    SELECT row_id, class, round(sum(weight / t * (1 - bit * {_SG}) / 2.0), 6) AS value FROM ap JOIN apcode USING (clf) JOIN w USING (clf), wn GROUP BY row_id, class
    """,
)
def _hamming_w(spark, d):
    code = decode.code_all_pairs(class_positions(spark, d))
    return _v(decode.decode_hamming(pair_scores(spark, d), code, weights=_clf_weights(spark, d)))


@query("decode_wins", f"WITH {PAIRS} SELECT row_id, class, CAST(sum(CASE WHEN bit = {_SG} THEN 1 ELSE 0 END) AS BIGINT) AS value {_J.format(s='ap')}")
def _wins(spark, d):
    return decode.decode_wins(pair_scores(spark, d), decode.code_all_pairs(class_positions(spark, d)))


_P = "(1 / (1 + exp(-score)))"


def _probs(scores):
    return scores.withColumn("score", 1 / (1 + F.exp(-F.col("score"))))


@query("decode_prob_sum", f"WITH {PAIRS} SELECT row_id, class, round(sum(CASE bit WHEN 1 THEN {_P} WHEN -1 THEN 1 - {_P} ELSE 0.5 END), 6) AS value {_J.format(s='ap')}")
def _prob_sum(spark, d):
    return _v(decode.decode_prob_sum(_probs(pair_scores(spark, d)), decode.code_all_pairs(class_positions(spark, d))))


@query(
    "decode_prob_sum_weighted",
    f"""
    WITH {PAIRS} SELECT row_id, class, round(sum(CASE bit WHEN 1 THEN {_P} WHEN -1 THEN 1 - {_P} ELSE 0 END / (clf + 1)), 6) AS value {_J.format(s='ap')}
    """,
)
def _prob_sum_w(spark, d):
    code = decode.code_all_pairs(class_positions(spark, d))
    return _v(decode.decode_prob_sum(_probs(pair_scores(spark, d)), code, _clf_weights(spark, d)))


@query("decode_score_sum", f"WITH {OVR} SELECT row_id, class, round(sum(bit * score), 6) AS value {_J.format(s='ovr')}")
def _score_sum(spark, d):
    return _v(decode.decode_score_sum(ovr_scores(spark, d), decode.code_one_vs_rest(class_positions(spark, d))))


@query("decode_score_sum_weighted", f"WITH {PAIRS} SELECT row_id, class, round(sum(bit * score / (clf + 1)), 6) AS value {_J.format(s='ap')}")
def _score_sum_w(spark, d):
    return _v(decode.decode_score_sum(pair_scores(spark, d), decode.code_all_pairs(class_positions(spark, d)), _clf_weights(spark, d)))


def _loss(name, sql, loss):
    @query(name, f"WITH {PAIRS} SELECT row_id, class, round(sum({sql}), 6) AS value {_J.format(s='ap')}")
    def run(spark, d):
        return _v(decode.decode_loss(pair_scores(spark, d), decode.code_all_pairs(class_positions(spark, d)), loss))

    return run


_loss("decode_loss_hinge", "greatest(0, 1 - bit * score)", "hinge")
_loss("decode_loss_exponential", "exp(-(bit * score))", "exponential")
_loss("decode_loss_linear", "-(bit * score)", "linear")
_loss("decode_loss_pluggable", "ln(1 + exp(-(bit * score)))", lambda z: F.log1p(F.exp(-z)))


@query(
    "choose_class",
    f"""
    WITH {OVR}, v AS (SELECT row_id, class, sum(bit * score) AS value {_J.format(s='ovr')})
    SELECT row_id, class AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(value, 9) DESC, class) = 1
    """,
)
def _choose(spark, d):
    return decode.choose_class(decode.decode_score_sum(ovr_scores(spark, d), decode.code_one_vs_rest(class_positions(spark, d))))


_NB = "nb AS (SELECT row_id, class, -d2 AS value, row_number() OVER (PARTITION BY row_id ORDER BY round(-d2, 9) DESC, class) AS rk FROM dist)"


@query("nbest", f"WITH {CENTROID}, {_NB} SELECT row_id, class, round(value, 6) AS value, CAST(rk AS INTEGER) AS rank FROM nb WHERE rk <= 3")
def _nbest(spark, d):
    s = centroid_distances(spark, d).select("row_id", "class", (-F.col("d2")).alias("value"))
    return _v(decode.nbest(s, 3))


@query(
    "nbest_forced",
    f"""
    WITH {CENTROID}, {_NB}, x AS (SELECT nb.*, vec.label = class AS tr, max(CASE WHEN vec.label = class AND rk > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id) AS o FROM nb JOIN vec ON vec.id = row_id)
    SELECT row_id, class, round(value, 6) AS value, CAST(rk AS INTEGER) AS rank FROM x WHERE rk <= 3 - o OR (tr AND rk > 3)
    """,
)
def _nbest_forced(spark, d):
    s = centroid_distances(spark, d).select("row_id", "class", (-F.col("d2")).alias("value"))
    forced = vectors(spark, d).select(F.col("id").alias("row_id"), F.col("label").alias("class"))
    return _v(decode.nbest(s, 3, forced))


@query(
    "decode_shortlist",
    f"""
    WITH {PAIRS}, {_NB}, sh AS (SELECT row_id, class FROM nb WHERE rk <= 3),
    act AS (SELECT sh.row_id, clf FROM sh JOIN apcode ON apcode.class = sh.class AND bit <> 0 GROUP BY ALL HAVING count(*) = 2)
    SELECT sh.row_id, sh.class, CAST(sum(CASE WHEN bit = {_SG} THEN 1 ELSE 0 END) AS BIGINT) AS value
    FROM sh JOIN apcode ON apcode.class = sh.class JOIN act ON act.row_id = sh.row_id AND act.clf = apcode.clf
    JOIN ap ON ap.row_id = sh.row_id AND ap.clf = apcode.clf GROUP BY ALL
    """,
)
def _shortlist(spark, d):
    s = centroid_distances(spark, d).select("row_id", "class", (-F.col("d2")).alias("value"))
    short = decode.nbest(s, 3).select("row_id", "class")
    return decode.decode_shortlist(pair_scores(spark, d), decode.code_all_pairs(class_positions(spark, d)), short)


# with scores from one distance per class, the survivor is the class that wins all of its pairs
@query("decode_elimination", f"WITH {CENTROID} SELECT row_id, class AS predicted FROM dist QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d2, class) = 1")
def _elimination(spark, d):
    return decode.decode_elimination(pair_scores(spark, d), decode.code_all_pairs(class_positions(spark, d)))


@query(
    "pairwise_from_class_probs",
    f"""
    WITH {PAIRS}, e AS (SELECT row_id, class, exp(-d2) / sum(exp(-d2)) OVER (PARTITION BY row_id) AS p FROM dist),
    z AS (SELECT row_id, clf, sum(CASE WHEN bit = 1 THEN p ELSE 0 END) AS a, sum(CASE WHEN bit = -1 THEN p ELSE 0 END) AS b FROM e JOIN apcode USING (class) GROUP BY ALL)
    SELECT row_id, clf, round(a / (a + b), 6) AS pairwise, round(a + b, 6) AS pair_sum, round(greatest(a, b), 6) AS pair_max FROM z
    """,
)
def _pairwise(spark, d):
    from pyspark.sql.window import Window

    s = centroid_distances(spark, d).withColumn("e", F.exp(-F.col("d2")))
    p = s.select("row_id", "class", (F.col("e") / F.sum("e").over(Window.partitionBy("row_id"))).alias("p"))
    out = decode.pairwise_from_class_probs(p, decode.code_all_pairs(class_positions(spark, d)))
    return out.select("row_id", "clf", *[r6(F.col(c)).alias(c) for c in ("pairwise", "pair_sum", "pair_max")])


@query(
    "binary_outcome",
    f"""
    WITH {PAIRS} SELECT row_id, clf, CASE WHEN bit = 0 THEN 0 WHEN bit = {_SG} THEN 1 ELSE -1 END AS outcome
    FROM ap JOIN vec ON vec.id = row_id JOIN apcode USING (clf) WHERE apcode.class = vec.label
    """,
)
def _outcome(spark, d):
    labels = vectors(spark, d).select(F.col("id").alias("row_id"), "label")
    return decode.binary_outcome(pair_scores(spark, d), decode.code_all_pairs(class_positions(spark, d)), labels)
