"""Queries over sources and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.registry import query
from strandlab.catalog.tables import (
    CUST, FRAMES, INST, LMAP, customers_mixed, event_frames, label_map, orders_nominal, r6, table,
)
from strandlab.functions.exprs import log_add, softmax
from strandlab.operators import prep
from strandlab.session import fresh_path
from strandlab.sources import frames as frame_source
from strandlab.sources import instances, paths, store


@query("load_instances", "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus AS label FROM orders")
def _load(spark, d):
    return instances.load_instances(
        spark, f"{d}/orders.parquet", "o_orderstatus", ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
    )


@query(
    "sanitize_nominals",
    """
    WITH s AS (SELECT o_orderkey, translate(o_orderpriority, '-/& ''', 'RRRRR') AS v FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_matches(v, '^[0-9]') THEN 'V' || v ELSE v END AS priority FROM s
    """,
)
def _sanitize(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    return instances.sanitize_nominals(df, ["priority"])


@query("write_delimited", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def _write(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = fresh_path(spark, "delimited")
    instances.write_delimited(df, out, "o_orderstatus")
    return spark.read.schema("o_orderkey long, o_orderpriority string, o_orderstatus string").csv(f"{out}/data")


URL_PATTERN = r"^(https?)://((?:m|www|blog)\.)?([a-z0-9-]+)\.example\.(com|net|org)/([a-z]{2})/(\d+)"


@query(
    "label_from_path",
    """
    SELECT page_id, NULLIF(regexp_extract(url, '^https?://[^/]+/*([^/]+)/', 1), '') AS label FROM pages
    """,
)
def _label_path(spark, d):
    df = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return paths.label_from_path(df, root="https?://[^/]+").select("page_id", "label")


@query(
    "parse_path_fields",
    f"""
    SELECT page_id, regexp_matches(url, '{URL_PATTERN}') AS valid,
      CASE WHEN regexp_matches(url, '{URL_PATTERN}') THEN regexp_extract(url, '{URL_PATTERN}', 1) END AS scheme,
      CASE WHEN regexp_matches(url, '{URL_PATTERN}') THEN regexp_extract(url, '{URL_PATTERN}', 3) END AS site,
      CASE WHEN regexp_matches(url, '{URL_PATTERN}') THEN regexp_extract(url, '{URL_PATTERN}', 5) END AS lang,
      CASE WHEN regexp_matches(url, '{URL_PATTERN}') THEN regexp_extract(url, '{URL_PATTERN}', 6) END AS number
    FROM pages
    """,
)
def _path_fields(spark, d):
    df = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    out = paths.parse_path_fields(df, URL_PATTERN, ["scheme", "prefix", "site", "tld", "lang", "number"])
    return out.select("page_id", "valid", "scheme", "site", "lang", "number")


_RUN_PATH = "concat('out/', lang, '/mfcc/left_right_', n_chars % 7, '/kmeans/', n_chars % 5 + 1, '_gaussians/', source, '/')"


@query(
    "parse_run_identifier",
    f"""
    WITH p AS (SELECT doc_id, rtrim({_RUN_PATH}, '/') AS path FROM documents),
    s AS (SELECT doc_id, string_split(path, '/') AS a FROM p)
    SELECT doc_id, a[-1] AS split, CAST(regexp_extract(a[-2], '(\\d+)', 1) AS INTEGER) AS gaussians, a[-3] AS algorithm,
      a[-4] AS topology, a[-5] AS features, a[-6] AS label_table,
      concat_ws('_', a[-6], a[-5], a[-4], a[-3], a[-2], a[-1]) AS run_id
    FROM s
    """,
)
def _run_id(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.expr(_RUN_PATH).alias("path"))
    return paths.parse_run_identifier(df).drop("path")


@query(
    "read_frames",
    f"WITH {FRAMES} SELECT seq_id AS user_id, t, round(x, 6) AS x1 FROM frames",
)
def _read_frames(spark, d):
    # one text file per user with a frame per line, in time order
    out = fresh_path(spark, "frames")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.round("value", 6).cast("string").alias("line"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # files take longer than bytes
    frame_source.write_lines(e, "user_id", "line", out, tasks, ["ts", "event_id"])
    user = F.regexp_extract("seq_id", r"user_id=(\d+)/", 1).cast("long")
    return frame_source.read_frames(spark, out).select(user.alias("user_id"), "t", F.col("x")[0].alias("x1"))


@query(
    "append_results_once",
    """
    WITH k AS (SELECT DISTINCT lang, source FROM documents),
    stored AS (SELECT lang, source, CAST(-1 AS BIGINT) AS n FROM k WHERE lang = 'en')
    SELECT k.lang, k.source, coalesce(stored.n, c.n) AS n
    FROM k LEFT JOIN stored USING (lang, source)
    JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) c USING (lang, source)
    """,
)
def _append_once(spark, d):
    docs = table(spark, d, "documents").select("lang", "source")
    keys = docs.distinct()
    out = fresh_path(spark, "results")
    # a first run stored the English cells; they must not be computed again
    keys.filter("lang = 'en'").withColumn("n", F.lit(-1).cast("long")).write.parquet(out)
    compute = lambda todo: docs.join(todo, ["lang", "source"], "left_semi").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n")
    )
    return store.append_results_once(spark, out, keys, ["lang", "source"], compute)


@query(
    "export_flat_vectors",
    f"""
    WITH {LMAP}, g AS (SELECT event_id AS seq_id, event_type AS label, value FROM events)
    SELECT seq_id, canonical AS label, true AS single, value AS x1, round(value * 2, 6) AS x2
    FROM g JOIN lmap USING (label)
    """,
)
def _flat(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_id").alias("seq_id"), F.lit(0).alias("t"), F.array("value", r6(F.col("value") * 2)).alias("x"),
        F.col("event_type").alias("label"),
    )
    return frame_source.export_flat_vectors(e, label_map(spark), 2)


# -- preprocessing -------------------------------------------------------------


@query("select_range", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _range(spark, d):
    return prep.select_range(table(spark, d, "orders"), "first-3,last")


@query("select_range_inverted", "SELECT o_totalprice, o_orderdate FROM orders")
def _range_inv(spark, d):
    return prep.select_range(table(spark, d, "orders"), "1-3,last", invert=True)


@query("drop_missing_label", f"WITH {CUST} SELECT id, bal, nation FROM cust WHERE nation IS NOT NULL")
def _drop_label(spark, d):
    return prep.drop_missing_label(customers_mixed(spark, d).select("id", "bal", "nation"), "nation")


@query("drop_all_missing_columns", f"WITH {CUST} SELECT id, bal, label FROM cust")
def _drop_cols(spark, d):
    df = customers_mixed(spark, d).select("id", "bal", F.lit(None).cast("string").alias("gone"), "label")
    return prep.drop_all_missing_columns(df)


_SPLIT = "CAST(substr(md5(CAST(id AS VARCHAR) || '|split'), 1, 1) < '8' AS BOOLEAN)"


def _train_test(df):
    from strandlab.functions.exprs import seeded_hash

    flag = F.substring(seeded_hash(F.col("id"), "split"), 1, 1) < "8"
    return df.filter(flag), df.filter(~flag)


_STATS = f"""
tr AS (SELECT * FROM cust WHERE {_SPLIT}), te AS (SELECT * FROM cust WHERE NOT {_SPLIT}),
st AS (SELECT avg(bal) AS m, min(bal) AS lo, max(bal) AS hi, stddev_samp(bal) AS sd FROM tr),
md AS (SELECT nation AS mode FROM tr WHERE nation IS NOT NULL GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 1)
"""


@query(
    "impute_mean_mode",
    f"""
    WITH {CUST}, {_STATS}
    SELECT id, round(coalesce(bal, m), 6) AS bal, coalesce(nation, mode) AS nation, label FROM te, st, md
    """,
)
def _impute(spark, d):
    train, test = _train_test(customers_mixed(spark, d))
    return prep.impute_mean_mode(test, train, ["bal"], ["nation"]).withColumn("bal", r6(F.col("bal")))


@query(
    "minmax_scale",
    f"WITH {CUST}, {_STATS} SELECT id, round((bal - lo) / (hi - lo), 6) AS bal, nation, label FROM te, st",
)
def _minmax(spark, d):
    train, test = _train_test(customers_mixed(spark, d))
    return prep.minmax_scale(test, train, ["bal"]).withColumn("bal", r6(F.col("bal")))


@query("standardize", f"WITH {CUST}, {_STATS} SELECT id, round((bal - m) / sd, 6) AS bal, nation, label FROM te, st")
def _standardize(spark, d):
    train, test = _train_test(customers_mixed(spark, d))
    return prep.standardize(test, train, ["bal"]).withColumn("bal", r6(F.col("bal")))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _hot_sql(col):
    return ", ".join(f"CASE WHEN {col} = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"label={s}\"" for s in _SEGMENTS)


@query("one_hot", f"WITH {CUST} SELECT id, {_hot_sql('label')} FROM cust")
def _one_hot(spark, d):
    df = customers_mixed(spark, d).select("id", "label")
    return prep.one_hot(df, {"label": prep.nominal_domain(df, "label")})


@query(
    "prep_pipeline",
    f"""
    WITH {CUST}, {_STATS}
    SELECT id, round((coalesce(bal, m) - lo) / (hi - lo), 6) AS bal, {_hot_sql('label')} FROM te, st
    """,
)
def _pipeline(spark, d):
    train, test = _train_test(customers_mixed(spark, d).select("id", "bal", "label"))
    return prep.prep_pipeline(train, test, ["bal"], ["label"]).withColumn("bal", r6(F.col("bal")))


@query(
    "quantize",
    """
    SELECT event_id, CAST(least(15, greatest(0, floor((value - 0) / (150.0::DOUBLE / 15) + 0.5))) AS INTEGER) AS value_q FROM events
    """,
)
def _quantize(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return prep.quantize(e, ["value"], {"value": (0.0, 150.0)}, 16).select("event_id", "value_q")


@query(
    "union_sets",
    "SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
)
def _union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return instances.union_sets(a, b)


@query(
    "log_domain",
    """
    WITH s AS (SELECT event_id, -value / 10 AS a, -value / 20 - 1 AS b FROM events)
    SELECT event_id, round(ln(exp(a) + exp(b)), 6) AS total, round(exp(a) / (exp(a) + exp(b)), 6) AS share FROM s
    """,
)
def _log_domain(spark, d):
    e = table(spark, d, "events").select("event_id", (-F.col("value") / 10).alias("a"), (-F.col("value") / 20 - 1).alias("b"))
    return e.select("event_id", r6(log_add(F.col("a"), F.col("b"))).alias("total"), r6(softmax(F.array("a", "b"))[0]).alias("share"))


@query(
    "string_functions",
    """
    SELECT o_orderkey, lower(o_orderpriority) AS low, string_split(o_orderpriority, '-')[1] AS head,
      string_split(o_orderpriority, '-')[-1] AS tail, translate(o_orderpriority, '-', '_') AS swapped,
      starts_with(o_orderpriority, '1') AS urgent
    FROM orders
    """,
)
def _strings(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", F.lower(p).alias("low"), F.element_at(F.split(p, "-"), 1).alias("head"),
        F.element_at(F.split(p, "-"), -1).alias("tail"), F.translate(p, "-", "_").alias("swapped"),
        p.startswith("1").alias("urgent"),
    )
