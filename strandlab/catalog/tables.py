"""Views over the given tables, in Spark and in SQL.

Every pair below describes the same rows; the SQL side is a list of common table
expressions that the oracle statements start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.sources.frames import as_frames
from strandlab.sources.instances import read_spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_spread(spark, f"{folder}/{name}.parquet")


def r6(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)


# -- nominal instances from orders ---------------------------------------------

ATTRS = ["priority", "year", "band"]


def orders_nominal(spark: SparkSession, folder: str) -> DataFrame:
    return spread_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.floor(F.col("o_totalprice") / 100000).cast("string").alias("band"),
        F.col("o_orderstatus").alias("label"),
    )


INST = """
inst AS (
  SELECT o_orderkey AS id, o_orderpriority AS priority,
         CAST(year(o_orderdate) AS VARCHAR) AS year,
         CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) AS band,
         o_orderstatus AS label
  FROM orders),
lng AS (
  SELECT id, 'priority' AS attr, priority AS value, label FROM inst
  UNION ALL SELECT id, 'year', year, label FROM inst
  UNION ALL SELECT id, 'band', band, label FROM inst)
"""


def orders_gappy(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows with every 17th priority and every 13th band missing."""
    df = orders_nominal(spark, folder)
    return df.withColumns(
        {
            "priority": F.when(F.col("id") % 17 != 0, F.col("priority")),
            "band": F.when(F.col("id") % 13 != 0, F.col("band")),
        }
    )


GAPPY = """
gappy AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS priority,
         CAST(year(o_orderdate) AS VARCHAR) AS year,
         CASE WHEN o_orderkey % 13 <> 0
              THEN CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) END AS band,
         o_orderstatus AS label
  FROM orders),
glng AS (
  SELECT id, 'priority' AS attr, priority AS value, label FROM gappy WHERE priority IS NOT NULL
  UNION ALL SELECT id, 'year', year, label FROM gappy
  UNION ALL SELECT id, 'band', band, label FROM gappy WHERE band IS NOT NULL)
"""

FOLDS = """
fold AS (
  SELECT id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|0'), id) - 1) % 10 AS INTEGER) AS fold
  FROM inst),
finst AS (SELECT inst.*, fold.fold FROM inst JOIN fold USING (id)),
flng AS (SELECT lng.*, fold.fold FROM lng JOIN fold USING (id))
"""

# -- mixed instances from customer ---------------------------------------------


def customers_mixed(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal")).alias("bal"),
        F.when(F.col("c_custkey") % 19 != 0, F.col("c_nationkey").cast("string")).alias("nation"),
        F.col("c_mktsegment").alias("label"),
    )


CUST = """
cust AS (
  SELECT c_custkey AS id,
         CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS bal,
         CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation,
         c_mktsegment AS label
  FROM customer)
"""

# -- frames from events --------------------------------------------------------


def event_frames(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return as_frames(e, "user_id", ["ts", "event_id"], ["value"], "event_type")


FRAMES = """
frames AS (
  SELECT user_id AS seq_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         value AS x, event_type AS label
  FROM events)
"""


def line_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of an order as a two-dimensional sequence; class = order status.

    Line numbers are not unique, so the order is completed by part and price.
    """
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount"
    )
    li = li.withColumn("q", F.col("l_quantity") / 10.0).withColumn("d", F.col("l_discount") * 10.0)
    return as_frames(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"], ["q", "d"])


LINES = """
lines AS (
  SELECT l_orderkey AS seq_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS t,
         l_quantity / 10.0 AS q, l_discount * 10.0 AS d
  FROM lineitem)
"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label")
    )


VEC = """
vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS VARCHAR) AS label FROM embeddings)
"""

LABEL_MAP = [("click", 0, "active"), ("view", 0, "active"), ("purchase", 1, "deal"), ("signup", 1, "deal"), ("error", 2, "fault")]


def label_map(spark: SparkSession) -> DataFrame:
    """Synonym table: labels of one entry share their canonical name."""
    return spark.createDataFrame(LABEL_MAP, "label string, entry int, canonical string")


LMAP = "lmap(label, entry, canonical) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in LABEL_MAP) + ")"


# -- binary scores from class centroids ----------------------------------------


def centroid_distances(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, class, d2)``: squared distance of every vector to every class mean."""
    from strandlab.functions.exprs import squared_distance
    from strandlab.operators.moments import class_mean_var

    v = vectors(spark, folder)
    means = class_mean_var(v, 64).groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("_m"))
    d2 = F.transform("_m", lambda m: F.struct(m["label"].alias("class"), squared_distance(F.col("x"), m["mean"]).alias("d2")))
    return v.join(F.broadcast(means.limit(1))).select(F.col("id").alias("row_id"), F.explode(d2).alias("z")).select("row_id", "z.class", "z.d2")


CENTROID = f"""
{VEC},
ex AS (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM vec),
mean AS (SELECT label, i, avg(v) AS m FROM ex GROUP BY ALL),
dist AS (SELECT ex.id AS row_id, mean.label AS class, sum((v - m) * (v - m)) AS d2 FROM ex JOIN mean USING (i) GROUP BY ALL),
dom AS (SELECT label AS class, row_number() OVER (ORDER BY label) - 1 AS pos FROM (SELECT DISTINCT label FROM vec)),
ncls AS (SELECT count(*) AS n FROM dom)
"""

# one-vs-rest: mean distance of all classes minus the distance of the class
OVR = CENTROID + """,
ovr AS (SELECT row_id, CAST(pos AS INTEGER) AS clf, avg(d2) OVER (PARTITION BY row_id) - d2 AS score FROM dist JOIN dom USING (class)),
ovrcode AS (SELECT CAST(a.pos AS INTEGER) AS clf, b.class, CASE WHEN a.pos = b.pos THEN 1 ELSE -1 END AS bit FROM dom a CROSS JOIN dom b)
"""

# pairs: distance to the first class minus distance to the second
PAIRS = CENTROID + """,
dp AS (SELECT row_id, class, pos, d2 FROM dist JOIN dom USING (class)),
apair AS (SELECT a.pos AS i, b.pos AS j, CAST(a.pos * n - (a.pos * (a.pos + 1)) // 2 + b.pos - a.pos - 1 AS INTEGER) AS clf
  FROM dom a JOIN dom b ON a.pos < b.pos, ncls),
ap AS (SELECT a.row_id, clf, a.d2 - b.d2 AS score FROM apair JOIN dp a ON a.pos = i JOIN dp b ON b.pos = j AND b.row_id = a.row_id),
apcode AS (SELECT clf, class, CASE WHEN pos = i THEN -1 WHEN pos = j THEN 1 ELSE 0 END AS bit FROM apair CROSS JOIN dom)
"""


def class_positions(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.sources.instances import class_domain

    return class_domain(vectors(spark, folder).select("label"))


def ovr_scores(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql.window import Window

    d = centroid_distances(spark, folder).join(class_positions(spark, folder).withColumnRenamed("label", "class"), "class")
    mean = F.avg("d2").over(Window.partitionBy("row_id"))
    return d.select("row_id", F.col("pos").alias("clf"), (mean - F.col("d2")).alias("score"))


def pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all pair classifiers from the short per-row list of distances."""
    d = centroid_distances(spark, folder).join(class_positions(spark, folder).withColumnRenamed("label", "class"), "class")
    rows = d.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "d2"))).alias("a")).withColumn("n", F.size("a"))
    ij = F.flatten(
        F.transform("a", lambda p: F.transform(F.filter("a", lambda q: q["pos"] > p["pos"]), lambda q: F.struct(p["pos"].alias("i"), q["pos"].alias("j"), (p["d2"] - q["d2"]).alias("score"))))
    )
    flat = rows.select("row_id", "n", F.explode(ij).alias("z")).select("row_id", "n", "z.*")
    clf = F.col("i") * F.col("n") - F.expr("i * (i + 1) div 2") + F.col("j") - F.col("i") - 1
    return flat.select("row_id", clf.cast("int").alias("clf"), "score")
