"""Regime discovery: PCA and K-means fits, the sweep over K, its scoring, and cluster inspection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.operators import cluster_metrics as M
from regimeweave.operators.lookups import class_map, class_rows
from regimeweave.operators.regimes import assign, centroid_table
from regimeweave.operators.restarts import fit_kmeans_many
from regimeweave.session import stage

# weight of each score in the choice of K
SCORE_WEIGHTS = {
    "score_silhouette": 0.25,
    "score_davies_bouldin": 0.15,
    "score_calinski_harabasz": 0.10,
    "score_stability": 0.25,
    "score_min_cluster": 0.15,
    "score_balance": 0.10,
}


def _as_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))


def fit_pca(train: DataFrame, vector: str, dim: int, components: int | float) -> DataFrame:
    """PCA of the training rows as a one-row table ``(mean, components, explained)``.

    An integer is limited to ``2 .. min(n - 1, dim)``; a fraction keeps the components that
    explain at least that share. The fitted matrix has ``dim * components`` numbers.
    """
    facts = train.agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]).alias("mean")
    ).first()
    fraction = isinstance(components, float) and 0.0 < components < 1.0
    k = dim if fraction else max(2, min(int(components), facts["n"] - 1, dim))
    model = PCA(k=k, inputCol="features", outputCol="reduced").fit(_as_vector(train, vector))
    explained = [float(x) for x in model.explainedVariance.toArray()]
    rows = model.pc.toArray().T.tolist()
    if fraction:
        share, keep = 0.0, 0
        while keep < len(explained) and share < components:
            share += explained[keep]
            keep += 1
        rows, explained = rows[:keep], explained[:keep]
    return train.sparkSession.createDataFrame(
        [(list(facts["mean"]), rows, explained)], "mean array<double>, components array<array<double>>, explained array<double>"
    )


def fit_kmeans(df: DataFrame, vector: str, k: int, n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """Centroid table of the best of ``n_init`` seeded restarts, all of them fitted side by side."""
    starts = [(k, seed + restart) for restart in range(n_init)]
    fitted = fit_kmeans_many(df, vector, starts, max_iter, tol)
    return centroid_table(df.sparkSession, min(fitted, key=lambda f: f.cost).centers)


def _nearest(vector: str, centers: list[list[float]]) -> Column:
    distances = V.distances_to(F.col(vector), F.array(*[F.array(*[F.lit(x) for x in c]) for c in centers]))
    return V.let(distances, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def stability(
    df: DataFrame, vector: str, k: int, key: str, repeats: int = 5, max_n: int | None = None, n_init: int = 10, seed: int = 42
) -> DataFrame:
    """Mean adjusted Rand index between repeated fits on all rows, or on one repeatable sample of ``max_n``."""
    sample = df if max_n is None else df.orderBy(F.xxhash64(F.col(key), F.lit(seed + 1000 + k)), key).limit(max_n)
    fitted = fit_kmeans_many(sample, vector, [(k, seed + 1000 * (repeat + 1) + restart) for repeat in range(repeats) for restart in range(n_init)])
    best = [min(fitted[r * n_init : (r + 1) * n_init], key=lambda f: f.cost).centers for r in range(repeats)]
    runs = [_nearest(vector, centers).alias(f"run_{r}") for r, centers in enumerate(best)]
    return M.mean_pairwise_rand(stage(sample.select(*runs), "stability"), [f"run_{r}" for r in range(repeats)])


def sweep_k(
    df: DataFrame,
    vector: str,
    dim: int,
    key: str,
    ks: Sequence[int],
    n_init: int = 10,
    repeats: int = 5,
    silhouette_n: int | None = None,
    stability_n: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """One row of quality measures per candidate K, of all rows; see ``sweep_fits``."""
    return sweep_fits(df, vector, dim, key, ks, n_init, repeats, silhouette_n, stability_n, seed)[0]


def sweep_fits(
    df: DataFrame,
    vector: str,
    dim: int,
    key: str,
    ks: Sequence[int],
    n_init: int = 10,
    repeats: int = 5,
    silhouette_n: int | None = None,
    stability_n: int | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Quality measures per candidate K, and the written assignment ``key, vector, k, cluster_id, distance_to_centroid, runs``
    they come from.

    The restarts of every K, and those of the repeated fits whose agreement is the stability, are all fitted side by
    side, one job per iteration. The silhouette takes squared distances of all rows, or with ``silhouette_n`` the Euclidean ones of
    a repeatable sample; ``stability_n`` names a sample for the repeated fits.
    """
    ks = [k for k in ks if k >= 2]
    if not ks:
        raise ValueError("no valid K to evaluate")
    whole = [(k, seed + restart) for k in ks for restart in range(n_init)]
    again = [(k, seed + 1000 * (repeat + 1) + restart) for k in ks for repeat in range(repeats) for restart in range(n_init)]
    if stability_n is None:
        fitted = fit_kmeans_many(df, vector, whole + again)
    else:
        sample = df.orderBy(F.xxhash64(F.col(key), F.lit(seed + 1000)), key).limit(stability_n)
        fitted = fit_kmeans_many(df, vector, whole) + fit_kmeans_many(sample, vector, again)

    def best(start: int) -> list[list[float]]:
        return min(fitted[start : start + n_init], key=lambda f: f.cost).centers

    parts = []
    for i, k in enumerate(ks):
        runs = [best(len(whole) + (i * repeats + repeat) * n_init) for repeat in range(repeats)]
        placed = assign(df.select(key, vector), vector, centroid_table(df.sparkSession, best(i * n_init)))
        nearest = F.array(*[_nearest(vector, centers) for centers in runs])
        parts.append(placed.select(key, vector, F.lit(k).alias("k"), "cluster_id", "distance_to_centroid", nearest.alias("runs")))
    written = stage(reduce(DataFrame.unionByName, parts), "sweep")

    rows = []
    for k in ks:
        classes, labelled = list(range(k)), written.where(F.col("k") == k)
        if silhouette_n is None:
            score = M.silhouette(labelled, vector, "cluster_id", classes)
        else:
            score = M.sampled_silhouette(labelled, vector, "cluster_id", key, silhouette_n, seed)
        agree = labelled.select(*[F.col("runs")[r].alias(f"run_{r}") for r in range(repeats)])
        measures = [
            score.select(F.col("silhouette").alias("silhouette_score")),
            M.davies_bouldin(labelled, vector, "cluster_id", dim, classes).select(F.col("davies_bouldin").alias("davies_bouldin_score")),
            M.calinski_harabasz(labelled, vector, "cluster_id", dim, classes).select(
                F.col("calinski_harabasz").alias("calinski_harabasz_score")
            ),
            M.inertia(labelled),
            M.mean_pairwise_rand(agree, agree.columns),
        ]
        row = M.cluster_balance(labelled, classes).drop("sizes").withColumn("k", F.lit(k))
        for measure in measures:
            row = row.withColumn(measure.columns[0], measure.scalar())
        rows.append(row)
    return reduce(DataFrame.unionByName, rows), written


def min_max(value: Column, reverse: bool = False) -> Column:
    """Scaled to 0..1 over all rows; a constant column gives 1, a non-finite value 0, reversed last.

    Meant for candidate tables (one row per K): the window is the whole table.
    """
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    everything = Window.partitionBy(F.lit(1))
    kept = F.when(finite, value)
    low, high = F.min(kept).over(everything), F.max(kept).over(everything)
    constant = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    scaled = F.when(constant, F.lit(1.0)).otherwise(F.try_divide(value - low, high - low))
    return F.when(finite, 1.0 - scaled if reverse else scaled).otherwise(F.lit(0.0))


def score_candidates(metrics: DataFrame) -> DataFrame:
    """The six scores of each K and their weighted sum, best first, smaller K on a tie."""
    scored = metrics.withColumns(
        {
            "score_silhouette": min_max(F.col("silhouette_score")),
            "score_davies_bouldin": min_max(F.col("davies_bouldin_score"), reverse=True),
            "score_calinski_harabasz": min_max(F.log1p("calinski_harabasz_score")),
            "score_stability": min_max(F.col("stability_ari_mean")),
            "score_min_cluster": min_max(F.col("minimum_cluster_proportion")),
            "score_balance": min_max(F.col("normalized_cluster_entropy")),
        }
    )
    total = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        total = total + F.col(name) * weight
    return scored.withColumn("recommendation_score", total).orderBy(F.col("recommendation_score").desc(), "k")


def recommend_k(metrics: DataFrame) -> DataFrame:
    """The best scoring K."""
    return score_candidates(metrics).limit(1)


def _top_n(df: DataFrame, n: int, classes: Sequence[int], order: Sequence[str], label: str) -> DataFrame:
    """First ``n`` rows per class in ``order``.

    A rank filter this small is applied inside every input partition before the shuffle, so a
    class that holds most rows still sends only ``n`` rows per partition to its task.
    """
    inside = Window.partitionBy(label).orderBy(*order)
    kept = df.where(F.col(label).isin(list(classes)))
    return kept.withColumn("_i", F.row_number().over(inside)).where(F.col("_i") <= n).drop("_i")


def exemplars(
    df: DataFrame,
    n: int,
    classes: Sequence[int],
    key: str,
    seed: int = 42,
    label: str = "cluster_id",
    distance: str = "distance_to_centroid",
    rank_expr: Column | None = None,
) -> DataFrame:
    """Per cluster the ``n`` nearest and ``n`` randomly chosen members, with their role."""
    order = F.xxhash64(F.col(key), F.lit(seed)) if rank_expr is None else rank_expr
    slim = df.select(key, label, distance, order.alias("_o"))
    nearest = _top_n(slim, n, classes, [distance, key], label).withColumn("role", F.lit("nearest"))
    chosen = _top_n(slim, n, classes, ["_o", key], label).withColumn("role", F.lit("random"))
    return nearest.unionByName(chosen).drop("_o")


def inspect_clusters(
    df: DataFrame, classes: Sequence[int], key: str, label: str = "cluster_id", distance: str = "distance_to_centroid"
) -> DataFrame:
    """Size, closest member, mean and largest distance per cluster; an empty cluster keeps its row."""
    facts = df.where(F.col(label).isin(list(classes))).groupBy(F.col(label).alias("cluster_id")).agg(
        F.struct(
            F.count(F.lit(1)).alias("training_size"),
            F.min_by(key, F.struct(distance, key)).alias("representative"),
            F.avg(distance).alias("mean_distance_to_centroid"),
            F.max(distance).alias("maximum_distance_to_centroid"),
        ).alias("_f")
    )
    held = df.sparkSession.range(1).select(class_rows(classes)).withColumn(
        "_all", class_map(facts, "cluster_id", "_f", classes).scalar()
    )
    found = held.withColumn("_f", F.try_element_at("_all", F.col("cluster_id")))
    return found.select(
        "cluster_id",
        F.coalesce("_f.training_size", F.lit(0)).alias("training_size"),
        F.col("_f.representative").alias("representative"),
        F.col("_f.mean_distance_to_centroid").alias("mean_distance_to_centroid"),
        F.col("_f.maximum_distance_to_centroid").alias("maximum_distance_to_centroid"),
    )


def assignment_summary(df: DataFrame, classes: Sequence[int], label: str = "cluster_id", split: str = "split") -> DataFrame:
    """Training and validation size and share of every cluster, empty clusters included."""
    parts = ("train", "validation")
    counts = df.agg(
        *[F.count_if(F.col(split) == s).alias(f"_n_{s}") for s in parts],
        F.array(
            *[
                F.struct(F.lit(c).alias("cluster_id"), *[F.count_if((F.col(label) == c) & (F.col(split) == s)).alias(s) for s in parts])
                for c in classes
            ]
        ).alias("_c"),
    )
    rows = counts.select("_n_train", "_n_validation", F.inline("_c"))
    return rows.select(
        "cluster_id",
        F.col("train").alias("training_size"),
        F.col("validation").alias("validation_size"),
        F.try_divide(F.col("train"), F.col("_n_train")).alias("training_proportion"),
        F.try_divide(F.col("validation"), F.col("_n_validation")).alias("validation_proportion"),
    )


def cluster_summary(assignment: DataFrame, inspection: DataFrame) -> DataFrame:
    """Assignment report with the inspection columns, matched on cluster and size."""
    return assignment.join(inspection, ["cluster_id", "training_size"], "left")
