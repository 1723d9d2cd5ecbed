"""Classification metrics as arithmetic on one row of confusion counts per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.functions import vectors as V

# upper edges of the two lower certainty strata
STRATA_EDGES = (1 / 3, 2 / 3)


def confusion_cells(
    df: DataFrame,
    k: int,
    by: Sequence[str] = (),
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """Per group one array of ``k * k`` counts, actual class by predicted class."""
    cells = [
        F.count_if((F.col(actual) == a) & (F.col(predicted) == p)) for a in range(k) for p in range(k)
    ]
    return df.groupBy(*by).agg(F.array(*cells).alias("cells"))


def confusion(df: DataFrame, k: int, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Long confusion matrix over fixed labels, empty cells included."""
    rows = confusion_cells(df, k, by, actual, predicted).select(*by, F.posexplode("cells").alias("_i", "count"))
    return rows.select(
        *by,
        F.expr(f"cast(_i div {k} as int)").alias("actual"),
        (F.col("_i") % k).alias("predicted"),
        "count",
    )


def _sums(cells: Column, k: int) -> tuple[list[Column], list[Column], list[Column]]:
    def add(parts: list[Column]) -> Column:
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    hits = [cells[i * k + i] for i in range(k)]
    support = [add([cells[i * k + j] for j in range(k)]) for i in range(k)]
    chosen = [add([cells[j * k + i] for j in range(k)]) for i in range(k)]
    return hits, support, chosen


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _f1(hits, support, chosen) -> list[Column]:
    return [_ratio(2.0 * h, s + c) for h, s, c in zip(hits, support, chosen)]


def _mean(values: list[Column], present: list[Column]) -> Column:
    kept = F.lit(0.0)
    n = F.lit(0)
    for value, flag in zip(values, present):
        kept = kept + F.when(flag, value).otherwise(F.lit(0.0))
        n = n + flag.cast("int")
    return F.when(n > 0, kept / n)


def macro_f1(cells: Column, k: int, labels: str = "observed") -> Column:
    """Unweighted mean F1 over the labels seen as actual or predicted, or over all ``k``."""
    hits, support, chosen = _sums(cells, k)
    scores = _f1(hits, support, chosen)
    if labels == "all":
        return _mean(scores, [F.lit(True)] * k)
    return _mean(scores, [s + c > 0 for s, c in zip(support, chosen)])


def metric_columns(cells: Column, k: int, labels: str = "observed") -> dict[str, Column]:
    """Accuracy, balanced accuracy (classes with actual rows), macro-F1 and support-weighted F1."""
    hits, support, chosen = _sums(cells, k)
    n = sum(support[1:], support[0])
    weighted = F.lit(0.0)
    for score, s in zip(_f1(hits, support, chosen), support):
        weighted = weighted + score * s
    return {
        "samples": n,
        "accuracy": F.when(n > 0, sum(hits[1:], hits[0]) / n),
        "balanced_accuracy": _mean([_ratio(h * 1.0, s) for h, s in zip(hits, support)], [s > 0 for s in support]),
        "macro_f1": macro_f1(cells, k, labels),
        "weighted_f1": F.when(n > 0, weighted / n),
    }


def metrics(
    df: DataFrame, k: int, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted", labels: str = "observed"
) -> DataFrame:
    cells = confusion_cells(df, k, by, actual, predicted)
    return cells.select(*by, *[c.alias(n) for n, c in metric_columns(F.col("cells"), k, labels).items()])


def per_class(df: DataFrame, k: int, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each fixed label; an undefined ratio is zero."""
    cells = confusion_cells(df, k, by, actual, predicted)
    hits, support, chosen = _sums(F.col("cells"), k)
    f1 = _f1(hits, support, chosen)
    entries = [
        F.struct(
            F.lit(i).alias("cluster_id"),
            _ratio(hits[i] * 1.0, chosen[i]).alias("precision"),
            _ratio(hits[i] * 1.0, support[i]).alias("recall"),
            f1[i].alias("f1"),
            support[i].alias("support"),
        )
        for i in range(k)
    ]
    return cells.select(*by, F.inline(F.array(*entries)))


def soft_scores(
    df: DataFrame, by: Sequence[str] = (), probability: str = "probability", soft: str = "target_soft"
) -> DataFrame:
    """Mean soft cross-entropy (probabilities clipped at 1e-12) and mean soft Brier score."""
    p, s = F.col(probability), F.col(soft)
    entropy = -V.total(F.zip_with(s, p, lambda a, b: a * F.ln(V.clip(b, V.TINY, 1.0))))
    brier = V.total(F.zip_with(p, s, lambda a, b: (a - b) * (a - b)))
    return df.groupBy(*by).agg(F.avg(entropy).alias("soft_cross_entropy"), F.avg(brier).alias("soft_brier"))


def soft_loss(
    df: DataFrame,
    weights: DataFrame | None,
    k: int,
    by: Sequence[str] = (),
    probability: str = "probability",
    soft: str = "target_soft",
    certainty: str | None = "certainty_weight",
) -> DataFrame:
    """Class-weighted soft cross-entropy, averaged with the certainty weights.

    ``weights`` is a table ``(cluster_id, soft_class_weight)`` with one row per class.
    """
    if weights is None:
        held = df.withColumn("_w", F.array(*[F.lit(1.0)] * k))
    else:
        ordered = F.sort_array(F.collect_list(F.struct("cluster_id", "soft_class_weight")))
        array = weights.where(F.col("cluster_id").isin(list(range(k)))).agg(
            F.transform(ordered, lambda e: e["soft_class_weight"])
        )
        held = df.withColumn("_w", array.scalar())
    terms = F.zip_with(soft, probability, lambda a, b: -a * F.ln(V.clip(b, V.TINY, 1.0)))
    row = V.total(F.zip_with(terms, "_w", lambda t, w: t * w))
    if certainty is None:
        return held.groupBy(*by).agg(F.avg(row).alias("soft_loss"))
    c = F.col(certainty)
    return held.groupBy(*by).agg((F.sum(row * c) / F.sum(c)).alias("soft_loss"))


def prediction_frame(df: DataFrame, k: int, probability: str = "probability", actual: str = "target_cluster_id", keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Keys, actual and predicted class, one probability column per class, and a correct flag."""
    predicted = V.argmax(F.col(probability))
    return df.select(
        *keys,
        F.col(actual).alias("actual_target_cluster_id"),
        predicted.alias("predicted_target_cluster_id"),
        *[F.col(probability)[i].alias(f"predicted_probability_cluster_{i}") for i in range(k)],
        (F.col(actual) == predicted).alias("prediction_correct"),
    )


def _probability_array(k: int, prefix: str) -> Column:
    return F.array(*[F.col(f"{prefix}{i}").cast("double") for i in range(k)])


def audit_predictions(
    predictions: DataFrame,
    k: int,
    tolerances: Sequence[float] = (1e-5, 1e-4, 5e-4, 1e-3),
    by: Sequence[str] = (),
    prefix: str = "predicted_probability_cluster_",
    label: str = "predicted_target_cluster_id",
) -> DataFrame:
    """Finiteness, range, row sums and argmax agreement of saved probabilities, one pass."""
    rows = predictions.withColumn("_p", _probability_array(k, prefix))
    finite = F.forall("_p", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("_sum", V.total(F.col("_p")))
    off = F.abs(F.col("_sum") - 1.0)
    exceeding = [F.count_if(off > t).alias(f"rows_over_{t:g}".replace("-", "m").replace(".", "p")) for t in tolerances]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~finite).alias("non_finite_rows"),
        F.min(F.array_min("_p")).alias("min_probability"),
        F.max(F.array_max("_p")).alias("max_probability"),
        F.min("_sum").alias("min_row_sum"),
        F.max("_sum").alias("max_row_sum"),
        F.avg("_sum").alias("mean_row_sum"),
        F.max(off).alias("max_deviation"),
        F.avg(off).alias("mean_deviation"),
        F.count_if(V.argmax(F.col("_p")) != F.col(label)).alias("argmax_mismatches"),
        *exceeding,
    )


def worst_rows(predictions: DataFrame, k: int, n: int = 10, prefix: str = "predicted_probability_cluster_", key: str = "pair_id", digits: int = 12) -> DataFrame:
    """The ``n`` rows whose probabilities are farthest from summing to one, compared at ``digits`` decimals."""
    total = V.total(_probability_array(k, prefix))
    rows = predictions.select(
        key, *[F.col(f"{prefix}{i}") for i in range(k)], total.alias("row_sum"), F.abs(total - 1.0).alias("absolute_deviation")
    )
    return rows.orderBy(F.round("absolute_deviation", digits).desc(), key).limit(n)


def changed_rows(
    old: DataFrame, new: DataFrame, k: int, prefix: str = "predicted_probability_cluster_", key: str = "pair_id"
) -> DataFrame:
    """Rows of ``new`` whose predicted class differs from ``old``, with their top-two margin."""
    before = old.select(
        key,
        F.col("predicted_target_cluster_id").alias("original_predicted_target_cluster_id"),
        F.col("actual_target_cluster_id").alias("_actual"),
    )
    ordered = F.array_sort(_probability_array(k, prefix))
    joined = new.join(before, key).where("original_predicted_target_cluster_id <> predicted_target_cluster_id")
    return joined.withColumn("top_two_margin", ordered[k - 1] - ordered[k - 2]).drop("_actual")


def diff_summary(old: DataFrame, new: DataFrame, k: int, key: str = "pair_id") -> DataFrame:
    """One row: changed predictions, target agreement and the change of each metric.

    Without common rows all targets agree, and the changed share is not a number.
    """
    both = new.select(
        key, F.col("actual_target_cluster_id").alias("actual"), F.col("predicted_target_cluster_id").alias("after")
    ).join(
        old.select(key, F.col("actual_target_cluster_id").alias("_was"), F.col("predicted_target_cluster_id").alias("before")), key
    )
    pairs = [(a, p) for a in range(k) for p in range(k)]

    def cells(column: str) -> Column:
        return F.array(*[F.count_if((F.col("actual") == a) & (F.col(column) == p)) for a, p in pairs])

    counted = both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bool_and(F.col("actual") == F.col("_was")), F.count(F.lit(1)) == 0).alias("targets_identical"),
        F.count_if(F.col("before") != F.col("after")).alias("changed"),
        cells("before").alias("_b"),
        cells("after").alias("_a"),
    )
    first, second = metric_columns(F.col("_b"), k), metric_columns(F.col("_a"), k)
    names = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")
    return counted.select(
        "rows",
        "targets_identical",
        "changed",
        F.when(F.col("rows") > 0, 100.0 * F.col("changed") / F.col("rows")).otherwise(float("nan")).alias("changed_percentage"),
        *[(second[n] - first[n]).alias(f"{n}_change") for n in names],
    )


def change_crosstab(changed: DataFrame) -> DataFrame:
    """Original against new class of the changed rows."""
    return changed.groupBy("original_predicted_target_cluster_id", "predicted_target_cluster_id").agg(
        F.count(F.lit(1)).alias("count")
    )


def strata_metrics(
    df: DataFrame, k: int, by: Sequence[str] = (), certainty: str = "certainty_weight", actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Metrics per certainty stratum; an empty stratum keeps its row with zero samples."""
    low, high = STRATA_EDGES
    c = F.col(certainty)
    names = ("low", "medium", "high")
    member = (c <= low, (c > low) & (c <= high), c > high)
    arrays = []
    for inside in member:
        arrays.append(
            F.array(
                *[
                    F.count_if(inside & (F.col(actual) == a) & (F.col(predicted) == p))
                    for a in range(k)
                    for p in range(k)
                ]
            )
        )
    entries = F.array(*[F.struct(F.lit(n).alias("certainty_stratum"), a.alias("cells")) for n, a in zip(names, arrays)])
    rows = df.groupBy(*by).agg(entries.alias("_e")).select(*by, F.inline("_e"))
    found = metric_columns(F.col("cells"), k)
    return rows.select(
        *by, "certainty_stratum", *[found[n].alias(n) for n in ("samples", "accuracy", "balanced_accuracy", "macro_f1")]
    )
