"""Quality of a labelling of vectors, as aggregates over the whole table; the Euclidean silhouette is that of a named sample."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.operators.lookups import class_map
from regimeweave.operators.regimes import mean_vectors


def inertia(df: DataFrame, distance: str = "distance_to_centroid") -> DataFrame:
    """Sum of squared distances to the assigned centroid."""
    return df.agg(F.sum(F.col(distance) * F.col(distance)).alias("inertia"))


def cluster_balance(df: DataFrame, classes: Sequence[int], label: str = "cluster_id") -> DataFrame:
    """Smallest and largest cluster, their shares, and the entropy relative to ``ln K``; empty clusters count."""
    k = len(classes)
    sizes = df.agg(F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("sizes"))
    shares = sizes.withColumn("_p", V.scaled_to_one(F.transform("sizes", lambda x: x.cast("double"))))
    entropy = -V.total(F.transform("_p", lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))))
    return shares.select(
        "sizes",
        F.array_min("sizes").alias("minimum_cluster_size"),
        F.array_max("sizes").alias("maximum_cluster_size"),
        F.array_min("_p").alias("minimum_cluster_proportion"),
        F.array_max("_p").alias("maximum_cluster_proportion"),
        (entropy / math.log(k) if k > 1 else F.lit(0.0)).alias("normalized_cluster_entropy"),
    )


def _with_own_center(df: DataFrame, vector: str, label: str, dim: int, classes: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    means = mean_vectors(df, vector, label, dim, classes)
    held = df.where(F.col(label).isin(list(classes))).withColumn(
        "_means", class_map(means, "cluster_id", "center", classes).scalar()
    )
    return held.withColumn("_own", F.col("_means")[F.col(label)]), means


def davies_bouldin(df: DataFrame, vector: str, label: str, dim: int, classes: Sequence[int]) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance ratio."""
    held, _ = _with_own_center(df, vector, label, dim, classes)
    spread = held.groupBy(label).agg(
        F.avg(V.euclidean(F.col(vector), F.col("_own"))).alias("_s"), F.any_value("_own").alias("_c")
    )
    # one entry per class
    table = spread.agg(F.collect_list(F.struct(F.col(label).alias("id"), "_s", "_c")).alias("t"))
    ratios = F.transform(
        "t",
        lambda a: F.array_max(
            F.transform(
                F.filter("t", lambda b: b["id"] != a["id"]),
                lambda b: (a["_s"] + b["_s"]) / V.euclidean(a["_c"], b["_c"]),
            )
        ),
    )
    return table.select((V.total(ratios) / F.size("t")).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, vector: str, label: str, dim: int, classes: Sequence[int]) -> DataFrame:
    """Between-cluster over within-cluster dispersion, each per degree of freedom."""
    held, _ = _with_own_center(df, vector, label, dim, classes)
    own = V.euclidean(F.col(vector), F.col("_own"))
    parts = held.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(own * own).alias("_w"), F.any_value("_own").alias("_c")
    )
    table = parts.agg(F.sum("_n").alias("n"), F.sum("_w").alias("w"), F.collect_list(F.struct("_n", "_c")).alias("t"))
    weighted = F.transform("t", lambda e: F.transform(e["_c"], lambda x: x * e["_n"] / F.col("n")))
    zeros = F.array(*[F.lit(0.0)] * dim)
    grand = F.aggregate(weighted, zeros, lambda acc, c: F.zip_with(acc, c, lambda x, y: x + y))
    placed = table.withColumn("g", grand)
    between = V.total(
        F.transform("t", lambda e: e["_n"] * V.euclidean(e["_c"], F.col("g")) * V.euclidean(e["_c"], F.col("g")))
    )
    k = F.size("t")
    return placed.select(((between / (k - 1)) / (F.col("w") / (F.col("n") - k))).alias("calinski_harabasz"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    cells = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    # cell, row and column totals of the contingency table in one pass over the rows
    totals = cells.cube("_a", "_b").agg(F.sum("_n").alias("_n"), F.grouping_id().alias("_level"))

    def level(k: int, value: Column) -> Column:
        return F.sum(F.when(F.col("_level") == k, value))

    pairs = _pairs(F.col("_n"))
    held = totals.agg(
        level(0, pairs).alias("_ij"), level(1, pairs).alias("_i"), level(2, pairs).alias("_j"), level(3, F.col("_n")).alias("_n")
    )
    expected = F.col("_i") * F.col("_j") / _pairs(F.col("_n"))
    most = (F.col("_i") + F.col("_j")) / 2
    # two labelings that are both all-equal or both all-different agree fully
    same = (most == expected) | (F.col("_n") < 2)
    return held.select(
        F.when(same, F.lit(1.0)).otherwise((F.col("_ij") - expected) / (most - expected)).alias("adjusted_rand")
    )


def mean_pairwise_rand(df: DataFrame, labelings: Sequence[str]) -> DataFrame:
    """Mean adjusted Rand index over all pairs of labelings; 1 for a single labelling."""
    pairs = list(combinations(labelings, 2))
    if not pairs:
        return df.sparkSession.range(1).select(F.lit(1.0).alias("stability_ari_mean"))
    scores = adjusted_rand(df, *pairs[0])
    for a, b in pairs[1:]:
        scores = scores.unionByName(adjusted_rand(df, a, b))
    return scores.agg(F.avg("adjusted_rand").alias("stability_ari_mean"))


def silhouette(df: DataFrame, vector: str, label: str, classes: Sequence[int]) -> DataFrame:
    """Mean silhouette of all rows by squared Euclidean distance: ``rows, unlabelled, silhouette``; NaN for one label.

    The mean squared distance of a row to a cluster is its squared distance to the cluster's mean plus the cluster's
    variance, so one mergeable aggregate (count, mean and variance per cluster, one expression for any dimension) and one
    pass give the exact value. Rows without a label are counted as ``unlabelled`` and are in no cluster; a label that
    ``classes`` does not declare stops the job. A row alone in its cluster scores 0.
    """
    known = df.select(F.col(label).cast("int").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("v")).alias("s")
    stats = known.where("label is not null").groupBy("label").agg(summary)
    spread = (F.col("s.count") - 1) / F.col("s.count") * V.total(vector_to_array("s.variance"))
    entry = F.struct(F.col("label").alias("id"), F.col("s.count").alias("n"), F.coalesce(spread, F.lit(0.0)).alias("spread"), vector_to_array("s.mean").alias("mean"))
    table = stats.where(F.col("label").isin(list(classes))).agg(F.sort_array(F.collect_list(entry)).alias("t"))  # one entry per class
    held = known.withColumn("_t", table.scalar())

    def score(far: Column) -> Column:
        own = F.filter(far, lambda e: e["id"] == F.col("label"))[0]
        nearest = F.array_min(F.transform(F.filter(far, lambda e: e["id"] != F.col("label")), lambda e: e["d"]))
        inside = own["d"] * own["n"] / (own["n"] - 1)
        return F.when(own["n"] == 1, 0.0).otherwise(F.coalesce(F.try_divide(nearest - inside, F.greatest(inside, nearest)), F.lit(0.0)))

    def distances(v: Column) -> Column:
        return F.transform(
            "_t", lambda e: V.let(V.euclidean(v, e["mean"]), lambda d: F.struct(e["id"].alias("id"), e["n"].alias("n"), (d * d + e["spread"]).alias("d")))
        )

    undeclared = F.raise_error(F.concat(F.lit("label without a declared class: "), F.col("label")))
    value = F.when(F.col("label").isin(list(classes)), V.let(distances(F.col("v")), score)).when(F.col("label").isNotNull(), undeclared)
    scored = held.select("label", F.size("_t").alias("_k"), value.alias("s"))
    return scored.agg(
        F.count("label").alias("rows"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.when(F.max("_k") < 2, float("nan")).otherwise(F.avg("s")).alias("silhouette"),
    )


def sampled_silhouette(
    df: DataFrame, vector: str, label: str, key: str, max_n: int, seed: int = 42, rank_expr: Column | None = None, block_rows: int = 512
) -> DataFrame:
    """Mean Euclidean silhouette within a repeatable sample of at most ``max_n`` rows: ``sampled, silhouette``; NaN for one label.

    The sample, which its caller bounds, is sent to every task as one matrix; tasks compare blocks of its rows with it. A row without a label is
    in no cluster and not drawn.
    """
    order = F.xxhash64(F.col(key), F.lit(seed)) if rank_expr is None else rank_expr
    picked = df.where(F.col(label).isNotNull()).orderBy(order, key).limit(max_n)
    rows = picked.select(F.col(label).cast("int").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v")).collect()  # at most max_n
    spark = df.sparkSession
    if len({r.label for r in rows}) < 2:
        return spark.range(1).select(F.lit(len(rows)).cast("bigint").alias("sampled"), F.lit(float("nan")).alias("silhouette"))
    sent = spark.sparkContext.broadcast((np.array([r.v for r in rows]), np.unique([r.label for r in rows], return_inverse=True)[1]))

    def compare(batches: Iterator) -> Iterator:
        points, own = sent.value
        hot = np.eye(own.max() + 1)[own]
        sizes = hot.sum(axis=0)
        for frame in batches:
            for first in frame["id"]:
                at = np.arange(first, min(first + block_rows, len(points)))
                # differences, not products, so that equal points are at distance zero
                far = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in points[at]])
                sums, here = far @ hot, (np.arange(len(at)), own[at])
                alone = sizes[own[at]] == 1
                inside = sums[here] / np.where(alone, 1.0, sizes[own[at]] - 1)
                means = sums / sizes
                means[here] = np.inf
                outside = means.min(axis=1)
                with np.errstate(invalid="ignore"):
                    scores = np.where(alone, 0.0, (outside - inside) / np.maximum(inside, outside))
                yield type(frame)({"s": np.nan_to_num(scores)})

    blocks = spark.range(0, len(rows), block_rows, -(-len(rows) // block_rows))
    return blocks.mapInPandas(compare, "s double").agg(F.count("s").alias("sampled"), F.avg("s").alias("silhouette"))
