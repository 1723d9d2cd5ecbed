"""Frozen regime definitions and the assignment of vectors to regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.operators.quality import GateError


def centroid_table(spark: SparkSession, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Centroids as a table; ids are the positions ``0..K-1``."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    if sum(len(c) for _, c in rows) > 2000:
        return spark.createDataFrame(rows, "cluster_id int, center array<double>")
    entries = [
        F.struct(F.lit(i).alias("cluster_id"), F.array(*[F.lit(x) for x in c]).alias("center")) for i, c in rows
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def mean_vectors(df: DataFrame, vector: str, by: str, dim: int, classes: Sequence[int]) -> DataFrame:
    """Mean vector per class as a centroid table. Partial sums merge before the shuffle."""
    means = F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)])
    grouped = df.where(F.col(by).isin(list(classes))).groupBy(F.col(by).cast("int").alias("cluster_id"))
    return grouped.agg(means.alias("center"))


def center_array(centroids: DataFrame) -> DataFrame:
    """One row, one column: the K centers ordered by id."""
    ordered = F.sort_array(F.collect_list(F.struct("cluster_id", "center")))
    return centroids.agg(F.transform(ordered, lambda s: s["center"]).alias("centers"))


def with_distances(df: DataFrame, vector: str, centroids: DataFrame, out: str = "distances") -> DataFrame:
    """Euclidean distance of each row to all K centers, as one array."""
    held = df.withColumn("_centers", center_array(centroids).scalar())
    return held.withColumn(out, V.distances_to(F.col(vector), F.col("_centers"))).drop("_centers")


def with_label_columns(df: DataFrame, distances: str = "distances", floor: float = 1e-12) -> DataFrame:
    """Nearest regime, its distance, the runner-up, both margins and the full order."""
    ranked = df.withColumn("_r", V.ranked(F.col(distances)))
    d1, d2 = F.col("_r")[0]["distance"], F.col("_r")[1]["distance"]
    return ranked.withColumns(
        {
            "cluster_id": F.col("_r")[0]["id"],
            "distance_to_centroid": d1,
            "second_nearest_distance": d2,
            "distance_margin": d2 - d1,
            "relative_distance_margin": (d2 - d1) / F.greatest(d2, F.lit(floor)),
            "nearest_cluster_order": F.transform("_r", lambda s: s["id"]),
        }
    ).drop("_r")


def assign(df: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """Distances and label columns; the lower id wins a tie."""
    return with_label_columns(with_distances(df, vector, centroids))


def apply_pca(df: DataFrame, vector: str, pca: DataFrame, out: str = "reduced") -> DataFrame:
    """Frozen PCA from a one-row table ``(mean, components)``: centre, then project."""
    frozen = df.withColumn("_pca", pca.select(F.struct("mean", "components")).scalar())
    return frozen.withColumn(out, V.project(F.col(vector), F.col("_pca.mean"), F.col("_pca.components"))).drop("_pca")


def score(
    df: DataFrame,
    vector: str,
    centroids: DataFrame,
    pca: DataFrame | None = None,
    normalize: bool = True,
    floor: float = 1e-8,
) -> DataFrame:
    """Score new vectors with a frozen definition: unit length, PCA, distances, labels."""
    work = df.withColumn("_v", V.l2_normalize(F.col(vector)) if normalize else F.col(vector))
    if pca is not None:
        work = apply_pca(work, "_v", pca, "_v")
    return with_label_columns(with_distances(work, "_v", centroids), floor=floor).drop("_v")


def flat(df: DataFrame, array: str, prefix: str, k: int) -> list[Column]:
    """Output columns ``prefix0 .. prefix(k-1)`` of an array column."""
    return [F.col(array)[i].alias(f"{prefix}{i}") for i in range(k)]


def centroid_matrix(centroids: DataFrame) -> DataFrame:
    """Distance between every two centroids; two centroids at one place stop the job."""
    arrays = center_array(centroids)
    rows = arrays.select("centers", F.posexplode("centers").alias("cluster_id", "_c"))
    cells = rows.select(
        "cluster_id", F.posexplode(V.distances_to(F.col("_c"), F.col("centers"))).alias("other_id", "distance")
    )
    apart = (F.col("cluster_id") == F.col("other_id")) | (F.col("distance") > 0)
    return cells.withColumn(
        "distance", F.when(apart, F.col("distance")).otherwise(F.raise_error(F.lit("two centroids coincide")))
    )


def definition_facts(centroids: DataFrame, pca: DataFrame | None = None) -> DataFrame:
    """Size, shape and content hash of a frozen definition, one row."""
    arrays = center_array(centroids)
    facts = arrays.select(
        F.size("centers").alias("k"),
        F.array_min(F.transform("centers", F.size)).alias("min_dim"),
        F.array_max(F.transform("centers", F.size)).alias("max_dim"),
        F.sha2(F.to_json("centers"), 256).alias("centroid_hash"),
    )
    if pca is None:
        return facts
    shape = pca.select(
        F.struct(
            F.size("mean").alias("features"),
            F.size("components").alias("components"),
            F.sha2(F.to_json(F.struct("mean", "components")), 256).alias("hash"),
        )
    )
    held = facts.withColumn("_p", shape.scalar())
    return held.select("*", F.col("_p.features").alias("pca_features"), F.col("_p.components").alias("pca_components"), F.col("_p.hash").alias("pca_hash")).drop("_p")


def check_frozen(centroids: DataFrame, k: int, dim: int, pca: DataFrame | None = None, features: int | None = None, hashes: dict[str, str] | None = None) -> None:
    """Stop unless a frozen definition has the agreed size, shape and content."""
    found = definition_facts(centroids, pca).first().asDict()
    wanted = {"k": k, "min_dim": dim, "max_dim": dim, **(hashes or {})}
    if pca is not None:
        wanted["pca_components"] = dim
        if features:
            wanted["pca_features"] = features
    wrong = {name: (found.get(name), value) for name, value in wanted.items() if found.get(name) != value}
    if wrong:
        raise GateError(f"frozen definition differs (found, wanted): {wrong}")
