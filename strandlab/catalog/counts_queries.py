"""Queries over contingency tables, splits, naive Bayes and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.registry import query
from strandlab.catalog.tables import ATTRS, CUST, FOLDS, GAPPY, INST, customers_mixed, orders_gappy, orders_nominal, r6, spread_table, table
from strandlab.operators import bayes, buckets, counts
from strandlab.plans import folds


@query("contingency", f"WITH {INST} SELECT attr, value, label, CAST(count(*) AS DOUBLE) AS w FROM lng GROUP BY ALL")
def _contingency(spark, d):
    return counts.contingency(orders_nominal(spark, d), ATTRS)


@query(
    "combine_counts",
    f"""
    WITH {INST} SELECT attr, value, label, CAST(count(*) AS DOUBLE) AS w FROM lng
    WHERE id IN (SELECT id FROM inst WHERE NOT (priority = '1-URGENT')) GROUP BY ALL
    """,
)
def _combine(spark, d):
    df = orders_nominal(spark, d)
    urgent = df.filter("priority = '1-URGENT'")
    return counts.combine_counts(counts.contingency(df, ATTRS), counts.contingency(urgent, ATTRS), -1)


@query(
    "shift_rows",
    f"""
    WITH {INST} SELECT attr, CASE WHEN value = '1-URGENT' THEN '2-HIGH' ELSE value END AS value, label,
      CAST(count(*) AS DOUBLE) AS w FROM lng WHERE attr = 'priority' GROUP BY ALL
    """,
)
def _shift(spark, d):
    df = orders_nominal(spark, d)
    all_rows = counts.contingency(df, ["priority"])
    return counts.shift_rows(all_rows, all_rows.filter("value = '1-URGENT'"), F.lit("2-HIGH"))


@query(
    "contingency_with_missing",
    f"""
    WITH {GAPPY}, k AS (SELECT attr, value, label, count(*) AS w FROM glng GROUP BY ALL),
    bags AS (SELECT attr, value, sum(w) AS bag FROM k GROUP BY ALL),
    share AS (SELECT attr, value, CAST(bag AS DOUBLE) / sum(bag) OVER (PARTITION BY attr) AS share FROM bags),
    miss AS (SELECT 'priority' AS attr, label, count(*) AS miss FROM gappy WHERE priority IS NULL GROUP BY label
             UNION ALL SELECT 'band', label, count(*) FROM gappy WHERE band IS NULL GROUP BY label),
    u AS (SELECT attr, value, label, CAST(w AS DOUBLE) AS w FROM k
          UNION ALL SELECT attr, value, label, share * miss FROM share JOIN miss USING (attr))
    SELECT attr, value, label, round(sum(w), 6) AS w FROM u GROUP BY ALL
    """,
)
def _missing(spark, d):
    return counts.contingency_with_missing(orders_gappy(spark, d), ATTRS).withColumn("w", r6(F.col("w")))


@query(
    "majority_baseline",
    f"""
    WITH {INST}, c AS (SELECT label, count(*) + 1.0::DOUBLE AS n FROM inst GROUP BY label)
    SELECT label, n, round(n / (SELECT sum(n) FROM c), 6) AS prior,
      (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS predicted
    FROM c
    """,
)
def _majority(spark, d):
    prior = counts.majority_baseline(orders_nominal(spark, d))
    return prior.withColumn("prior", r6(F.col("prior"))).join(counts.majority_predict(prior))


@query("mean_baseline", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS predicted FROM lineitem GROUP BY ALL")
def _mean(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return counts.mean_baseline(li, "l_extendedprice", "l_quantity", ["l_returnflag"]).withColumn(
        "predicted", r6(F.col("predicted"), 4)
    )


GAIN = """
c AS (SELECT attr, value, label, CAST(count(*) AS DOUBLE) AS w FROM lng GROUP BY ALL),
gs AS (SELECT attr, sum(w) AS n, sum(w * log2(w)) AS cells FROM c GROUP BY attr),
bg AS (SELECT attr, sum(w * log2(w)) AS bags FROM (SELECT attr, value, sum(w) AS w FROM c GROUP BY ALL) GROUP BY attr),
cl AS (SELECT attr, sum(w * log2(w)) AS classes FROM (SELECT attr, label, sum(w) AS w FROM c GROUP BY ALL) GROUP BY attr)
"""


@query(
    "info_gain",
    f"""
    WITH {INST}, {GAIN}
    SELECT attr, round((n * log2(n) - classes) / n, 6) AS entropy, round((bags - cells) / n, 6) AS cond_entropy,
      round((n * log2(n) - classes - bags + cells) / n, 6) AS gain
    FROM gs JOIN bg USING (attr) JOIN cl USING (attr)
    """,
)
def _gain(spark, d):
    out = counts.info_gain(counts.contingency(orders_nominal(spark, d), ATTRS))
    return out.select("attr", *[r6(F.col(c)).alias(c) for c in ("entropy", "cond_entropy", "gain")])


C45 = """
tot AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM gappy),
k AS (SELECT attr, value, label, CAST(count(*) AS DOUBLE) AS w FROM glng GROUP BY ALL),
cells AS (SELECT attr, sum(w) AS n, sum(w * log2(w)) AS cell_sum FROM k GROUP BY attr),
bag AS (SELECT attr, value, sum(w) AS w FROM k GROUP BY ALL),
bags AS (SELECT attr, sum(w * log2(w)) AS bag_sum, sum(CASE WHEN w >= 2 THEN 1 ELSE 0 END) AS big FROM bag GROUP BY attr),
cls AS (SELECT attr, label, sum(w) AS cw FROM k GROUP BY ALL),
clss AS (SELECT attr, sum(cw * log2(cw)) AS class_sum FROM cls GROUP BY attr),
multi AS (
  SELECT attr, (n * log2(n) - class_sum - bag_sum + cell_sum) / total AS gain,
    (total * log2(total) - bag_sum - CASE WHEN total > n THEN (total - n) * log2(total - n) ELSE 0 END) / total AS split
  FROM cells JOIN bags USING (attr) JOIN clss USING (attr), tot WHERE big >= 2),
grid AS (
  SELECT cls.attr, bag.value, cls.label, coalesce(k.w, 0) AS w, cls.cw - coalesce(k.w, 0) AS rest, cls.cw
  FROM cls JOIN bag ON cls.attr = bag.attr LEFT JOIN k ON k.attr = cls.attr AND k.value = bag.value AND k.label = cls.label),
sides AS (
  SELECT attr, value, sum(w) AS i, sum(rest) AS o,
    sum(CASE WHEN w > 0 THEN w * log2(w) ELSE 0 END + CASE WHEN rest > 0 THEN rest * log2(rest) ELSE 0 END) AS cell_sum,
    sum(cw * log2(cw)) AS class_sum FROM grid GROUP BY ALL HAVING sum(w) >= 2 AND sum(rest) >= 2),
bin0 AS (
  SELECT attr, value, ((i + o) * log2(i + o) - class_sum - i * log2(i) - o * log2(o) + cell_sum) / total AS gain,
    (total * log2(total) - i * log2(i) - o * log2(o)
     - CASE WHEN total > i + o THEN (total - i - o) * log2(total - i - o) ELSE 0 END) / total AS split FROM sides, tot),
bin AS (
  SELECT attr, value AS point, gain, gain / split AS gain_ratio FROM bin0
  QUALIFY row_number() OVER (PARTITION BY attr ORDER BY round(gain / split, 9) DESC, value) = 1)
"""


def _totals(df):
    return df.agg(F.count(F.lit(1)).cast("double").alias("total"))


@query(
    "split_nominal_multiway",
    f"WITH {GAPPY}, {C45} SELECT attr, round(gain, 8) AS gain, round(gain / split, 8) AS gain_ratio FROM multi",
)
def _multiway(spark, d):
    df = orders_gappy(spark, d)
    out = counts.split_nominal_multiway(counts.contingency(df, ATTRS), _totals(df))
    return out.select("attr", r6(F.col("gain"), 8).alias("gain"), r6(F.col("gain_ratio"), 8).alias("gain_ratio"))


@query(
    "split_nominal_binary",
    f"WITH {GAPPY}, {C45} SELECT attr, point, round(gain, 8) AS gain, round(gain_ratio, 8) AS gain_ratio FROM bin",
)
def _binary(spark, d):
    df = orders_gappy(spark, d)
    out = counts.split_nominal_binary(counts.contingency(df, ATTRS), _totals(df))
    return out.select("attr", "point", r6(F.col("gain"), 8).alias("gain"), r6(F.col("gain_ratio"), 8).alias("gain_ratio"))


# the label depends on all three numbers, so that each has a split at any size
NUM = """
marked AS (SELECT *, CAST(datediff('day', TIMESTAMP '1990-01-01', l_shipdate) AS DOUBLE) AS shipped, CASE WHEN datediff('day', TIMESTAMP '1990-01-01', l_shipdate) >= 3650 THEN 'A'
           WHEN l_extendedprice > 50000 AND l_quantity > 20 THEN 'N' ELSE 'R' END AS label FROM lineitem),
nlng AS (SELECT 'price' AS attr, l_extendedprice AS v, label FROM marked UNION ALL SELECT 'quantity', l_quantity, label FROM marked UNION ALL SELECT 'shipped', shipped, label FROM marked),
pv AS (SELECT attr, v, CAST(sum(CASE WHEN label = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS a,
  CAST(sum(CASE WHEN label = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS n, CAST(sum(CASE WHEN label = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS r
  FROM nlng GROUP BY ALL),
cum AS (SELECT attr, v, lead(v) OVER w AS nv, sum(a) OVER w AS la, sum(n) OVER w AS ln, sum(r) OVER w AS lr,
  sum(a) OVER (PARTITION BY attr) AS ta, sum(n) OVER (PARTITION BY attr) AS tn, sum(r) OVER (PARTITION BY attr) AS tr
  FROM pv WINDOW w AS (PARTITION BY attr ORDER BY v)),
cut AS (SELECT *, la + ln + lr AS i, ta + tn + tr - la - ln - lr AS o, ta + tn + tr AS t,
  least(25, greatest(2, 0.1 * (ta + tn + tr) / 3)) AS flr FROM cum),
xl AS (SELECT *, i * log2(i) + o * log2(o) AS bag_sum, ta * log2(ta) + tn * log2(tn) + tr * log2(tr) AS class_sum,
  CASE WHEN la > 0 THEN la * log2(la) ELSE 0 END + CASE WHEN ln > 0 THEN ln * log2(ln) ELSE 0 END
  + CASE WHEN lr > 0 THEN lr * log2(lr) ELSE 0 END + CASE WHEN ta > la THEN (ta - la) * log2(ta - la) ELSE 0 END
  + CASE WHEN tn > ln THEN (tn - ln) * log2(tn - ln) ELSE 0 END + CASE WHEN tr > lr THEN (tr - lr) * log2(tr - lr) ELSE 0 END AS cells
  FROM cut WHERE nv > v + 1e-5 AND i >= flr AND o >= flr),
g AS (SELECT attr, v, nv, t, (t * log2(t) - class_sum - bag_sum + cells) / t AS raw, (t * log2(t) - bag_sum) / t AS split,
  count(*) OVER (PARTITION BY attr) AS cuts FROM xl),
num AS (
  SELECT attr, CASE WHEN nv <= (v + nv) / 2 THEN nv ELSE v END AS threshold, cuts, raw - log2(cuts) / t AS gain, split FROM g
  QUALIFY row_number() OVER (PARTITION BY attr ORDER BY round(raw, 9) DESC, v) = 1)
"""


def _lines_numeric(spark, d):
    shipped = F.datediff(F.col("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("double")
    label = F.when(shipped >= 3650, "A").when((F.col("l_extendedprice") > 50000) & (F.col("l_quantity") > 20), "N").otherwise("R")
    return spread_table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), shipped.alias("shipped"), label.alias("label"))


@query(
    "split_numeric",
    f"""
    WITH {NUM} SELECT attr, round(threshold, 4) AS threshold, cuts, round(gain, 8) AS gain, round(gain / split, 8) AS gain_ratio
    FROM num WHERE gain > 0
    """,
)
def _numeric(spark, d):
    out = counts.split_numeric(_lines_numeric(spark, d), ["price", "quantity", "shipped"])
    return out.select(
        "attr", r6(F.col("threshold"), 4).alias("threshold"), "cuts", r6(F.col("gain"), 8).alias("gain"),
        r6(F.col("gain_ratio"), 8).alias("gain_ratio"),
    )


@query(
    "select_split",
    f"""
    WITH {GAPPY}, {C45},
    sp AS (SELECT attr, gain, gain_ratio, point FROM bin),
    best AS (SELECT * FROM sp WHERE gain >= (SELECT avg(gain) FROM sp) - 1e-3 AND gain_ratio > 1e-6
             ORDER BY round(gain_ratio, 9) DESC, attr LIMIT 1)
    SELECT attr, 'binary' AS kind, point, round(gain, 8) AS gain, round(gain_ratio, 8) AS gain_ratio FROM best
    """,
)
def _select_split(spark, d):
    df = orders_gappy(spark, d)
    table_counts = counts.contingency(df, ATTRS)
    per_class = df.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = per_class.agg(F.sum("n").alias("total"), F.max("n").alias("top_class"))
    domains = table_counts.groupBy("attr").agg(F.countDistinct("value").alias("values"))
    splits = counts.split_nominal_binary(table_counts, totals.select("total"))
    out = counts.select_split(splits, totals, domains)
    return out.withColumns({"gain": r6(F.col("gain"), 8), "gain_ratio": r6(F.col("gain_ratio"), 8)})


@query("select_split_any")
def _select_split_any(spark, d):
    """The split among all kinds: one bag per value, one value against the rest, and thresholds of numbers."""
    numbers = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.unix_date(F.col("o_orderdate").cast("date")).alias("placed"))
    df = orders_gappy(spark, d).join(numbers, "id")
    table_counts = counts.contingency(df, ATTRS)
    per_class = df.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = per_class.agg(F.sum("n").alias("total"), F.max("n").alias("top_class"))
    thresholds = counts.split_numeric(df, ["price", "placed"]).withColumn("point", F.col("threshold").cast("string")).drop("threshold", "cuts")
    splits = counts.split_nominal_multiway(table_counts, totals.select("total"))
    splits = splits.unionByName(counts.split_nominal_binary(table_counts, totals.select("total"))).unionByName(thresholds)
    domains = table_counts.groupBy("attr").agg(F.countDistinct("value").alias("values"))
    domains = domains.unionByName(spark.createDataFrame([("price", None), ("placed", None)], "attr string, values long"))
    out = counts.select_split(splits, totals, domains)
    return out.withColumns({"gain": r6(F.col("gain"), 8), "gain_ratio": r6(F.col("gain_ratio"), 8)})


@query(
    "one_rule_nominal",
    f"""
    WITH {GAPPY},
    f AS (SELECT 'priority' AS attr, coalesce(priority, '?missing') AS value, label FROM gappy
          UNION ALL SELECT 'year', year, label FROM gappy UNION ALL SELECT 'band', coalesce(band, '?missing'), label FROM gappy),
    c AS (SELECT attr, value, label, count(*) AS w FROM f GROUP BY ALL),
    v AS (SELECT attr, value, label AS predicted, w FROM c QUALIFY row_number() OVER (PARTITION BY attr, value ORDER BY w DESC, label) = 1),
    s AS (SELECT *, sum(w) OVER (PARTITION BY attr) AS rc FROM v)
    SELECT attr, value, predicted, CAST(w AS DOUBLE) AS correct, CAST(rc AS DOUBLE) AS rule_correct,
      attr = (SELECT attr FROM s ORDER BY rc DESC, attr LIMIT 1) AS best FROM s
    """,
)
def _one_rule(spark, d):
    return counts.one_rule_nominal(orders_gappy(spark, d), ATTRS)


# -- naive Bayes ---------------------------------------------------------------

BAYES = """
dom AS (SELECT DISTINCT attr, value FROM glng),
cls AS (SELECT label, count(*) + 1.0 AS n FROM gappy GROUP BY label),
pri AS (SELECT label, n / (SELECT sum(n) FROM cls) AS prior FROM cls),
cnt AS (SELECT attr, value, label, count(*) AS w FROM glng GROUP BY ALL),
nb AS (SELECT dom.attr, dom.value, cls.label, (coalesce(w, 0) + 1.0) / sum(coalesce(w, 0) + 1.0) OVER (PARTITION BY dom.attr, cls.label) AS p
       FROM dom CROSS JOIN cls LEFT JOIN cnt ON cnt.attr = dom.attr AND cnt.value = dom.value AND cnt.label = cls.label)
"""


@query("naive_bayes_fit", f"WITH {GAPPY}, {BAYES} SELECT attr, value, label, round(p, 8) AS p FROM nb")
def _nb_fit(spark, d):
    model = bayes.naive_bayes_fit(orders_gappy(spark, d), ATTRS)
    return model["nominal"].withColumn("p", r6(F.col("p"), 8))


NUMNB = """
nl AS (SELECT 'price' AS attr, l_extendedprice AS v, l_returnflag AS label FROM lineitem
       UNION ALL SELECT 'quantity', l_quantity, l_returnflag FROM lineitem),
wd AS (SELECT attr, (max(v) - min(v)) / (count(DISTINCT v) - 1) AS width FROM nl GROUP BY attr),
gr AS (SELECT attr, label, width, floor(v / width + 0.5) * width AS g FROM nl JOIN wd USING (attr)),
nm AS (SELECT attr, label, avg(g) AS mean, greatest(stddev_pop(g), max(width) / 6) AS sd, max(width) AS width FROM gr GROUP BY ALL)
"""


@query(
    "naive_bayes_fit_numeric",
    f"WITH {NUMNB} SELECT attr, label, round(mean, 4) AS mean, round(sd, 4) AS sd, round(width, 6) AS width FROM nm",
)
def _nb_numeric(spark, d):
    df = table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("label")
    )
    out = bayes.numeric_model(df, ["price", "quantity"])
    return out.select("attr", "label", r6(F.col("mean"), 4).alias("mean"), r6(F.col("sd"), 4).alias("sd"), r6(F.col("width")).alias("width"))


@query(
    "naive_bayes_score",
    f"""
    WITH {GAPPY}, {BAYES},
    s AS (SELECT g.id, p0.label, ln(p0.prior) + coalesce(sum(ln(greatest(nb.p, 1e-75))), 0) AS lp
          FROM gappy g CROSS JOIN pri p0 LEFT JOIN glng l ON l.id = g.id LEFT JOIN nb ON nb.attr = l.attr AND nb.value = l.value AND nb.label = p0.label
          GROUP BY g.id, p0.label, p0.prior),
    z AS (SELECT id, label, exp(lp - max(lp) OVER (PARTITION BY id)) AS e FROM s)
    SELECT id, label, round(e / sum(e) OVER (PARTITION BY id), 6) AS prob FROM z
    """,
)
def _nb_score(spark, d):
    df = orders_gappy(spark, d)
    m = bayes.naive_bayes_fit(df, ATTRS)
    out = bayes.naive_bayes_score(df.drop("label"), m["prior"].select("label", "prior"), m["nominal"], ATTRS)
    return out.select("id", F.explode(F.arrays_zip(F.col("classes").alias("label"), r6_array("probs").alias("prob"))).alias("z")).select(
        "id", "z.label", "z.prob"
    )


def r6_array(name):
    return F.transform(F.col(name), lambda p: F.round(p, 6))


_PDF = "exp(-0.5 * (({x} - mean) / sd) * (({x} - mean) / sd)) * 0.3989422804014327 / sd"
_MASS = (
    "(2.0 * (width / 4) / 45.0) * (7 * " + _PDF.format(x="(g - width / 2)") + " + 32 * " + _PDF.format(x="(g - width / 4)")
    + " + 12 * " + _PDF.format(x="g") + " + 32 * " + _PDF.format(x="(g + width / 4)") + " + 7 * " + _PDF.format(x="(g + width / 2)") + ")"
)


@query(
    "naive_bayes_score_numeric",
    f"""
    WITH {NUMNB}, cls AS (SELECT l_returnflag AS label, count(*) + 1.0 AS n FROM lineitem GROUP BY 1),
    ll AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_partkey FROM lineitem),
    x AS (SELECT rid, 'price' AS attr, l_extendedprice AS v FROM ll UNION ALL SELECT rid, 'quantity', l_quantity FROM ll),
    q AS (SELECT rid, attr, label, mean, sd, nm.width, floor(v / nm.width + 0.5) * nm.width AS g FROM x JOIN nm USING (attr)),
    s AS (SELECT rid, label, sum(ln(greatest({_MASS}, 1e-75))) AS lp FROM q GROUP BY ALL),
    p AS (SELECT rid, label, lp + ln(n / (SELECT sum(n) FROM cls)) AS lp FROM s JOIN cls USING (label)),
    z AS (SELECT rid, label, exp(lp - max(lp) OVER (PARTITION BY rid)) AS e FROM p),
    o AS (SELECT rid, label, e / sum(e) OVER (PARTITION BY rid) AS pr FROM z),
    pred AS (SELECT rid, label, pr FROM o QUALIFY row_number() OVER (PARTITION BY rid ORDER BY round(pr, 9) DESC, label) = 1)
    SELECT label AS predicted, CAST(count(*) AS BIGINT) AS n, round(avg(pr), 6) AS mean_prob FROM pred GROUP BY label
    """,
)
def _nb_score_numeric(spark, d):
    df = spread_table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("label")
    )
    m = bayes.naive_bayes_fit(df, [], ["price", "quantity"])
    out = bayes.naive_bayes_score(df, m["prior"].select("label", "prior"), None, [], m["numeric"], ["price", "quantity"])
    return out.groupBy(bayes.predicted().alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.array_max("probs"))).alias("mean_prob")
    )


_KD = """
    kl AS (SELECT 'quantity' AS attr, l_quantity AS v, l_returnflag AS label FROM lineitem UNION ALL SELECT 'discount', l_discount, l_returnflag FROM lineitem),
    kv AS (SELECT attr, label, v, CAST(count(*) AS DOUBLE) AS w FROM kl GROUP BY ALL), wd AS (SELECT attr, (max(v) - min(v)) / (count(DISTINCT v) - 1) AS width FROM kl GROUP BY attr),
    st AS (SELECT attr, label, sum(w) AS n, max(v) - min(v) AS rg FROM kv GROUP BY ALL),
    sd AS (SELECT kv.attr, kv.label, v AS mean, w / n AS w, width, greatest(rg / sqrt(n), width / 6) AS sd FROM kv JOIN st USING (attr, label) JOIN wd USING (attr)),
    qs AS (SELECT DISTINCT attr, v AS g FROM kl)
"""


@query("kernel_density_nb", f"WITH {_KD} SELECT sd.attr, g AS value, label, round(sum(w * {_MASS}), 6) AS p FROM qs JOIN sd USING (attr) GROUP BY sd.attr, g, label")
def _kernel_nb(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("label"))
    out = bayes.kernel_density_model(df, df, ["quantity", "discount"])
    return out.select("attr", F.col("value").cast("double").alias("value"), "label", r6(F.col("p")).alias("p"))


@query(
    "one_rule_numeric",
    """
    WITH RECURSIVE l AS (SELECT 'price' AS attr, o_totalprice::DOUBLE AS value, o_orderstatus AS label FROM orders UNION ALL SELECT 'day', dayofyear(o_orderdate)::DOUBLE, o_orderstatus FROM orders),
    c AS MATERIALIZED (SELECT attr, value, label, count(*)::DOUBLE AS w, dense_rank() OVER (PARTITION BY attr ORDER BY value) - 1 AS i FROM l GROUP BY attr, value, label),
    o AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY attr, label ORDER BY i) AS upto FROM c),
    j AS (SELECT o.attr, o.i, min(x.i) AS j FROM (SELECT *, upto - w + 6 AS target FROM o) o ASOF LEFT JOIN o x ON o.attr = x.attr AND o.label = x.label AND o.target <= x.upto GROUP BY ALL),
    s AS MATERIALIZED (SELECT attr, i, min(j) OVER (PARTITION BY attr ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS j FROM j),
    fc AS (SELECT s.attr, s.i, s.j, x.label, x.upto FROM s JOIN o x ON x.attr = s.attr AND x.i = s.j),
    f AS (SELECT fc.attr, fc.i, any_value(fc.j) AS j, arg_min(fc.label, struct_pack(n := -(fc.upto - coalesce(b.upto, 0)), l := fc.label)) AS f
          FROM fc ASOF LEFT JOIN o b ON fc.attr = b.attr AND fc.label = b.label AND fc.i > b.i GROUP BY fc.attr, fc.i),
    pv AS (SELECT attr, i, CASE WHEN count(*) = 1 THEN any_value(label) END AS pure, any_value(value) AS value FROM c GROUP BY attr, i),
    ru AS (SELECT *, sum(CASE WHEN pure IS NULL OR pure IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY attr ORDER BY i) AS run FROM (SELECT *, lag(pure) OVER (PARTITION BY attr ORDER BY i) AS p FROM pv)),
    re AS MATERIALIZED (SELECT *, max(i) OVER (PARTITION BY attr, run) AS runend FROM ru),
    top AS (SELECT attr, max(i) + 1 AS n FROM pv GROUP BY attr),
    nx AS MATERIALIZED (SELECT pv.attr, pv.i, CASE WHEN f.j IS NULL THEN top.n WHEN r.pure = f.f THEN r.runend + 1 ELSE f.j + 1 END AS nx FROM pv JOIN top ON top.attr = pv.attr LEFT JOIN f ON f.attr = pv.attr AND f.i = pv.i LEFT JOIN re r ON r.attr = f.attr AND r.i = f.j + 1),
    ch(attr, i) AS (SELECT attr, 0::BIGINT FROM top UNION ALL SELECT ch.attr, nx.nx FROM ch JOIN nx ON nx.attr = ch.attr AND nx.i = ch.i JOIN top ON top.attr = ch.attr WHERE nx.nx < top.n),
    bk AS (SELECT c.attr, ch.i AS b, c.label, c.w, c.value FROM (SELECT ch.attr, ch.i, nx.nx FROM ch JOIN nx ON nx.attr = ch.attr AND nx.i = ch.i) ch JOIN c ON c.attr = ch.attr AND c.i >= ch.i AND c.i < ch.nx),
    bc AS (SELECT attr, b, label, sum(w) AS w, min(value) AS low, max(value) AS high FROM bk GROUP BY ALL),
    bm AS (SELECT *, max(w) OVER (PARTITION BY attr, b) AS m FROM bc),
    bt AS MATERIALIZED (SELECT attr, row_number() OVER (PARTITION BY attr ORDER BY b) AS k, min(low) AS low, max(high) AS high, max(w) AS correct, sum(w) AS n, list(label ORDER BY label) FILTER (w = m) AS ties FROM bm GROUP BY attr, b),
    cy(attr, k, cls) AS (SELECT attr, k, ties[1] FROM bt WHERE k = 1 UNION ALL SELECT bt.attr, bt.k, CASE WHEN list_contains(bt.ties, cy.cls) THEN cy.cls ELSE bt.ties[1] END FROM cy JOIN bt ON bt.attr = cy.attr AND bt.k = cy.k + 1),
    mg AS (SELECT bt.*, cls, sum(CASE WHEN cls <> p THEN 1 ELSE 0 END) OVER (PARTITION BY attr ORDER BY k) AS bucket FROM (SELECT bt.*, cls, lag(cls) OVER (PARTITION BY bt.attr ORDER BY bt.k) AS p FROM bt JOIN cy ON cy.attr = bt.attr AND cy.k = bt.k) bt),
    rr AS (SELECT attr, bucket::BIGINT AS bucket, min(low) AS low, max(high) AS high, any_value(cls) AS predicted, sum(correct) AS correct, sum(n) AS n FROM mg GROUP BY attr, bucket)
    SELECT *, sum(correct) OVER (PARTITION BY attr) AS rule_correct, attr = (SELECT attr FROM rr GROUP BY attr ORDER BY sum(correct) DESC, attr LIMIT 1) AS best FROM rr
    """,
)
def _one_rule_numeric(spark, d):
    df = table(spark, d, "orders").select(
        F.col("o_totalprice").alias("price"), F.dayofyear("o_orderdate").cast("double").alias("day"), F.col("o_orderstatus").alias("label")
    )
    return buckets.one_rule_numeric(df, ["price", "day"]).select("attr", "bucket", "low", "high", "predicted", "correct", "n", "rule_correct", "best")


# -- folds ---------------------------------------------------------------------


@query("assign_folds", f"WITH {INST}, {FOLDS} SELECT id, label, fold FROM finst")
def _folds(spark, d):
    return folds.assign_folds(orders_nominal(spark, d).select("id", "label"), 10)


@query("train_side", f"WITH {INST}, {FOLDS} SELECT id, label FROM finst WHERE fold <> 3")
def _train(spark, d):
    return folds.train_side(folds.assign_folds(orders_nominal(spark, d).select("id", "label"), 10), 3).select("id", "label")


CVNB = f"""
{INST}, {FOLDS},
ff AS (SELECT DISTINCT fold FROM fold), dom AS (SELECT DISTINCT attr, value FROM lng),
tot AS (SELECT attr, value, label, count(*) AS w FROM flng GROUP BY ALL),
ftot AS (SELECT fold, attr, value, label, count(*) AS w FROM flng GROUP BY ALL),
ctot AS (SELECT label, count(*) AS n FROM inst GROUP BY ALL),
fct AS (SELECT fold, label, count(*) AS n FROM finst GROUP BY ALL),
pri AS (SELECT ff.fold, c.label, c.n - coalesce(f.n, 0) + 1.0 AS n FROM ff CROSS JOIN ctot c LEFT JOIN fct f ON f.fold = ff.fold AND f.label = c.label),
prior AS (SELECT fold, label, n / sum(n) OVER (PARTITION BY fold) AS p FROM pri),
grid AS (SELECT ff.fold, dom.attr, dom.value, c.label, coalesce(t.w, 0) - coalesce(f.w, 0) + 1.0 AS w
  FROM ff CROSS JOIN dom CROSS JOIN ctot c
  LEFT JOIN tot t ON t.attr = dom.attr AND t.value = dom.value AND t.label = c.label
  LEFT JOIN ftot f ON f.fold = ff.fold AND f.attr = dom.attr AND f.value = dom.value AND f.label = c.label),
nb AS (SELECT fold, attr, value, label, w / sum(w) OVER (PARTITION BY fold, attr, label) AS p FROM grid),
sc AS (SELECT l.id, l.fold, nb.label, sum(ln(nb.p)) AS lp FROM flng l JOIN nb ON nb.fold = l.fold AND nb.attr = l.attr AND nb.value = l.value GROUP BY ALL),
sp AS (SELECT id, sc.fold, sc.label, lp + ln(p) AS lp FROM sc JOIN prior ON prior.fold = sc.fold AND prior.label = sc.label),
so AS (SELECT id, fold, label, exp(lp - max(lp) OVER (PARTITION BY id)) AS e FROM sp),
sn AS (SELECT id, fold, label, e / sum(e) OVER (PARTITION BY id) AS p FROM so),
pred AS (SELECT s.id, s.fold, i.label, s.label AS predicted FROM sn s JOIN inst i USING (id)
  QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY round(s.p, 9) DESC, s.label) = 1)
"""


@query(
    "cross_validate",
    f"""
    WITH {CVNB} SELECT fold, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN label = predicted THEN 0.0 ELSE 1.0 END), 6) AS error
    FROM pred GROUP BY fold
    """,
)
def _cv(spark, d):
    preds = folds.cross_validate_bayes(orders_nominal(spark, d), ATTRS)
    return folds.fold_errors(preds, ["fold"]).withColumn("error", r6(F.col("error")))


@query(
    "average_results",
    f"""
    WITH {CVNB}, e AS (SELECT fold, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN label = predicted THEN 0.0 ELSE 1.0 END) AS error FROM pred GROUP BY fold)
    SELECT 'orders' AS dataset, 'bayes' AS scheme, CAST(count(*) AS BIGINT) AS results, round(avg(error), 6) AS avg_error,
      round(stddev_samp(error), 6) AS sd_error, round(avg(n), 6) AS avg_n, round(stddev_samp(n), 6) AS sd_n FROM e
    """,
)
def _average(spark, d):
    e = folds.fold_errors(folds.cross_validate_bayes(orders_nominal(spark, d), ATTRS), ["fold"])
    e = e.withColumns({"dataset": F.lit("orders"), "scheme": F.lit("bayes")})
    out = folds.average_results(e, ["dataset", "scheme"], ["error", "n"])
    return out.select("dataset", "scheme", "results", *[r6(F.col(c)).alias(c) for c in ("avg_error", "sd_error", "avg_n", "sd_n")])


@query(
    "average_violations",
    """
    WITH r AS (SELECT user_id AS scheme, event_type AS fold FROM events),
    g AS (SELECT scheme, count(*) AS results, count(DISTINCT fold) AS distinct_keys FROM r GROUP BY ALL)
    SELECT scheme, results, distinct_keys, CASE WHEN distinct_keys < results THEN 'duplicate key' ELSE 'wrong count' END AS problem
    FROM g WHERE distinct_keys < results OR results <> 5
    """,
)
def _violations(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("scheme"), F.col("event_type").alias("fold"))
    return folds.average_violations(r, ["scheme"], "fold", 5)
