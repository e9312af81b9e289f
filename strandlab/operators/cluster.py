"""Codebooks, cluster tables and cluster validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import squared_distance
from strandlab.operators.mixture import gmm_fit, gmm_loglik
from strandlab.operators.moments import per_dim
from strandlab.operators.rowblocks import row_blocks
from strandlab.session import cut


def assign_codewords(frames: DataFrame, codebook: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nearest codeword per row (ties to the smallest code) and the squared distance."""
    books = codebook.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("code", "center"))).alias("_book"))
    joined = frames.join(books, list(by)) if by else frames.join(books)
    dist = F.transform("_book", lambda c: F.struct(F.round(squared_distance(F.col("x"), c["center"]), 9).alias("d"), c["code"].alias("code")))
    return joined.withColumn("_b", F.array_min(dist)).withColumns({"code": F.col("_b.code"), "dist": F.col("_b.d")}).drop("_b", "_book")


def update_codewords(assigned: DataFrame, codebook: DataFrame, dims: int, by: Sequence[str] = ()) -> DataFrame:
    means = assigned.groupBy(*by, "code").agg(per_dim("x", dims, F.avg).alias("_c"))
    return codebook.join(means, [*by, "code"], "left").select(*by, "code", F.coalesce("_c", "center").alias("center"))


def kmeans_codebook(frames: DataFrame, dims: int, k: int, by: Sequence[str] = (), rounds: int = 10, tol: float = 1e-4, step: float = 0.01) -> DataFrame:
    """Codebook of ``k`` words per group by splitting and refinement: ``(<by>, code, center)``.

    Starts at the mean; every codeword moves by ``+-step`` (relative, plus a small
    constant) until there are ``k``.  All groups are refined in the same jobs.
    """
    book = cut(frames.groupBy(*by).agg(per_dim("x", dims, F.avg).alias("center")).withColumn("code", F.lit(0)))
    size = 1
    while size < k:
        grow = min(size, k - size)
        low = F.transform("center", lambda c: c * (1 - step) - step)
        high = F.transform("center", lambda c: c * (1 + step) + step)
        split = F.when(
            F.col("code") < grow,
            F.array(F.struct("code", low.alias("center")), F.struct((F.col("code") + size).alias("code"), high.alias("center"))),
        ).otherwise(F.array(F.struct("code", "center")))
        book = book.select(*by, F.explode(split).alias("p")).select(*by, "p.code", "p.center")
        size += grow
        last = None
        for _ in range(rounds):
            assigned = assign_codewords(frames, book, by)
            book = cut(update_codewords(assigned, book, dims, by))
            cost = assign_codewords(frames, book, by).agg(F.avg("dist")).first()[0]
            if cost is None or (last is not None and last - cost <= tol * max(last, 1e-12)):
                break
            last = cost
    return book


def cluster_sizes(assign: DataFrame) -> DataFrame:
    """Rows and share per cluster; the null cluster holds the unclustered rows.

    ``assign(row_id, cluster, density)``; ``mean_log_density`` uses rows with a
    positive density only.
    """
    g = assign.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("density") > 0, F.log("density"))).alias("mean_log_density")
    )
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def classes_to_clusters(assign: DataFrame) -> DataFrame:
    """Class x cluster counts in long form."""
    return assign.filter(F.col("cluster").isNotNull()).groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))


MAX_MAP_CLASSES = 20


def map_clusters(matrix: DataFrame) -> DataFrame:
    """One-to-one class per cluster with the fewest errors; clusters may stay unmapped.

    The matrix has classes x clusters cells; the best assignment is found over
    subsets of classes.
    """
    rows = matrix.limit(MAX_MAP_CLASSES * 10_000 + 1).collect()
    classes = sorted({r["label"] for r in rows})
    clusters = sorted({r["cluster"] for r in rows})
    if len(classes) > MAX_MAP_CLASSES or len(rows) > MAX_MAP_CLASSES * 10_000:
        raise ValueError(f"mapping is limited to {MAX_MAP_CLASSES} classes")
    hits = {(r["cluster"], r["label"]): r["n"] for r in rows}

    @lru_cache(maxsize=None)
    def best(i: int, used: int) -> tuple[int, tuple]:
        if i == len(clusters):
            return 0, ()
        top = best(i + 1, used)
        choice = (top[0], (None, *top[1]))
        for c, name in enumerate(classes):
            n = hits.get((clusters[i], name), 0)
            if n and not used >> c & 1:
                rest = best(i + 1, used | 1 << c)
                if n + rest[0] > choice[0]:
                    choice = (n + rest[0], (name, *rest[1]))
        return choice

    total = sum(hits.values())
    correct, names = best(0, 0)
    data = [(cl, nm, int(hits.get((cl, nm), 0)), total - correct) for cl, nm in zip(clusters, names)]
    kind = dict(matrix.dtypes)
    return matrix.sparkSession.createDataFrame(data, f"cluster {kind['cluster']}, label {kind['label']}, hits long, errors long")


def cluster_cv_loglik(folded: DataFrame, dims: int, k: int, folds: int, max_iter: int = 10) -> DataFrame:
    """Mean test log density per fold of a mixture trained on the other folds.

    The rows are written and packed once; their blocks are copied to the folds they train where they are read, so all
    folds are one fit.
    """
    rows = cut(folded.select("fold", "x"))
    blocks = row_blocks(rows, ["fold"], dims)

    def train(df: DataFrame) -> DataFrame:
        return df.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("fold"))))

    model = gmm_fit(train(rows), dims, k, ["fold"], max_iter, blocks=train(blocks))
    return gmm_loglik(blocks, model, ["fold"], dims).select("fold", (F.col("loglik") / F.col("n")).alias("mean_log_density"), "n")


def hard_assignment_distribution(assign: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """One 0/1 column per cluster."""
    return assign.select("row_id", *[F.when(F.col("cluster") == c, 1.0).otherwise(0.0).alias(f"c{c}") for c in clusters])
