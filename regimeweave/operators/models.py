"""Training-only standardiser and Spark ML classifiers for soft and hard targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.operators.lookups import with_lookup


def fit_standardizer(train: DataFrame, vector: str, dim: int, mode: str = "epsilon") -> DataFrame:
    """One row ``(mean, scale)``: population statistics of the training rows.

    ``epsilon`` adds 1e-8 to the deviation, ``floor`` turns one below 1e-7 into 1, ``zero``
    turns an exact zero into 1.
    """
    value = [F.col(vector)[i].cast("double") for i in range(dim)]
    fitted = train.agg(
        F.array(*[F.avg(v) for v in value]).alias("mean"), F.array(*[F.stddev_pop(v) for v in value]).alias("_s")
    )
    rules = {
        "epsilon": lambda s: s + 1e-8,
        "floor": lambda s: F.when(s < 1e-7, 1.0).otherwise(s),
        "zero": lambda s: F.when(s == 0, 1.0).otherwise(s),
    }
    return fitted.select("mean", F.transform("_s", rules[mode]).alias("scale"))


def standardize(df: DataFrame, vector: str, standardizer: DataFrame, out: str = "standardized") -> DataFrame:
    held = df.withColumn("_z", standardizer.select(F.struct("mean", "scale")).scalar())
    centred = V.subtract(F.col(vector), F.col("_z.mean"))
    return held.withColumn(out, F.zip_with(centred, F.col("_z.scale"), lambda x, s: x / s)).drop("_z")


def _features(df: DataFrame, vector: str) -> Column:
    return array_to_vector(F.transform(vector, lambda x: x.cast("double")))


def fit_soft_logistic(
    train: DataFrame,
    weights: DataFrame,
    classes: Sequence[int],
    vector: str,
    soft: str = "target_soft",
    certainty: str = "certainty_weight",
    reg: float = 1e-4,
    max_iter: int = 100,
):
    """Multinomial logistic regression on soft targets.

    A row with memberships ``s`` is the same as ``K`` rows with labels ``0..K-1`` and weights
    ``certainty * class_weight * s``; the weighted likelihood of those is the soft loss.
    """
    long = train.select(
        _features(train, vector).alias("features"),
        F.col(certainty).alias("_c"),
        F.posexplode(soft).alias("_label", "_s"),
    )
    weighted = with_lookup(long, weights, "cluster_id", "soft_class_weight", classes, "_w", "_label")
    rows = weighted.select(
        "features", F.col("_label").cast("double").alias("label"), (F.col("_c") * F.col("_w") * F.col("_s")).alias("weight")
    )
    return _logistic(reg, max_iter).fit(rows)


def fit_logistic(
    train: DataFrame, weights: DataFrame, classes: Sequence[int], vector: str, label: str = "target_cluster_id", reg: float = 1e-4, max_iter: int = 100
):
    """Class-weighted multinomial logistic regression on hard labels."""
    held = with_lookup(train, weights, "cluster_id", "class_weight", classes, "weight", label)
    rows = held.select(_features(held, vector).alias("features"), F.col(label).cast("double").alias("label"), "weight")
    return _logistic(reg, max_iter).fit(rows)


def _logistic(reg: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        family="multinomial", weightCol="weight", standardization=False, regParam=reg, maxIter=max_iter
    )


def fit_mlp(
    train: DataFrame,
    vector: str,
    dim: int,
    k: int,
    hidden: Sequence[int] = (256, 64),
    label: str = "target_cluster_id",
    max_iter: int = 60,
    seed: int = 42,
):
    """Multilayer perceptron on hard labels. Spark's has sigmoid layers, no dropout and no row weights."""
    rows = train.select(_features(train, vector).alias("features"), F.col(label).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[dim, *hidden, k], maxIter=max_iter, seed=seed).fit(rows)


def resample_weighted(train: DataFrame, weight: Column, seed: int, key: str = "pair_id") -> DataFrame:
    """Repeat or drop rows so that a row appears ``weight`` times on average; how weights reach the perceptron.

    The draw is a hash of the key, so a repeated task gives the same rows.
    """
    uniform = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    copies = F.floor(weight + uniform).cast("int")
    held = train.withColumn("_copies", copies).where("_copies > 0")
    return held.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")


def predict(model, df: DataFrame, vector: str, out: str = "probability") -> DataFrame:
    """Class probabilities as an array column."""
    scored = model.transform(df.withColumn("features", _features(df, vector)))
    return scored.withColumn(out, vector_to_array("probability")).drop(
        *[c for c in ("features", "rawPrediction", "prediction") if c not in df.columns]
    )
