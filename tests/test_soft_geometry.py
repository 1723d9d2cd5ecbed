"""Soft targets, confidence filter, balancing, and exact quantiles."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeweave.operators import geometry as G
from regimeweave.operators import regimes as R
from regimeweave.operators import soft_targets as T
from regimeweave.operators.align import check_conserved
from regimeweave.operators.quality import GateError
from regimeweave.operators.quantiles import exact_quantile

CLASSES = (0, 1, 2)
SCHEMA = "pair_id string, partition string, chronological_rank bigint, target_cluster_id int, target_distances array<double>"


def soft_rows():
    """Own distance 9.8 against 10.6; the first row nearly tied; the last row of each class far from everything."""
    rows = []
    for partition, sizes in {"train": (20, 45, 25), "validation": (8, 15, 9), "test": (9, 17, 10)}.items():
        rank = 0
        for k, n in enumerate(sizes):
            for i in range(n):
                d = [10.6 + 0.001 * i] * 3
                d[k] = 9.8 + 0.001 * i
                if i == n - 1:
                    d = [30.0] * 3
                    d[k] = 20.0
                rows.append([f"{partition}-{k}-{i}", partition, rank, k, d])
                rank += 1
    rows[0][4] = [10.222, 10.223, 10.2511]
    tied = next(r for r in rows if r[1] == "test" and r[3] == 1)
    tied[4] = [10.22299, 10.22300, 10.6]
    return rows


def test_soft_targets_end_to_end(spark):
    rows = soft_rows()
    pairs = T.require_label_consistency(spark.createDataFrame(rows, SCHEMA))
    out = T.annotate(pairs, CLASSES, T.SoftConfig(outlier_percentile=95.0)).cache()
    assert out.count() == len(rows)
    sums = np.array([sum(r.target_soft) for r in out.collect()])
    assert np.allclose(sums, 1.0)
    first = out.where("pair_id = 'train-0-0'").first()
    assert first.training_eligible and first.certainty_weight < 0.2
    assert out.where("partition = 'train' and is_training_distance_outlier").count() >= 3
    near = T.near_tie_rows(out).collect()
    assert [r.source_partition for r in near] == ["test"]
    kept = T.retained(out)
    parts = {"kept": kept, "out": out.where("partition = 'train' and not training_eligible")}
    assert check_conserved(out.where("partition = 'train'"), parts, "pair_id").first().conserved
    weights = {r.cluster_id: (r.soft_class_mass, r.soft_class_weight) for r in T.soft_class_weights(kept, CLASSES).collect()}
    n = kept.count()
    assert all(abs(w - n / (3 * m)) < 1e-9 for m, w in weights.values())
    # the same numbers with numpy
    d = np.array([r[4] for r in rows])
    train = np.array([r[1] == "train" for r in rows])
    s = np.sort(d, axis=1)
    tau = np.median((s[:, 1] - s[:, 0])[train])
    assert abs(first.temperature - tau) < 1e-12
    soft = np.exp(-(d - s[:, :1]) / tau)
    soft /= soft.sum(axis=1, keepdims=True)
    got = {r.pair_id: r.target_soft for r in out.collect()}
    assert np.allclose([got[r[0]] for r in rows], soft)
    bad = T.soft_violations(out).where("sum_violation or recompute_violation or argmax_violation").count()
    assert bad == 0


def test_material_disagreement_stops(spark):
    rows = soft_rows()
    rows[5][3] = 2
    with pytest.raises(GateError):
        T.require_label_consistency(spark.createDataFrame(rows, SCHEMA))


def test_all_distances_equal(spark):
    df = spark.createDataFrame([("a", "train", 0, 0, [1.0, 1.0, 1.0])], SCHEMA)
    with pytest.raises(Exception, match="no positive distance gap"):
        T.temperature(df).collect()
    row = T.with_certainty(T.with_memberships(T.with_order(df), spark.range(1).select(F.lit(0.5))), 3).first()
    assert row.nearest_cluster_id == 0 and abs(row.soft_target_normalized_entropy - 1.0) < 1e-12
    assert row.certainty_weight == pytest.approx(0.1)


def test_absent_class_policies(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "target_cluster_id int")
    with pytest.raises(Exception, match="absent from training"):
        T.class_weights(df, CLASSES).collect()
    floor = {r.cluster_id: r.class_weight for r in T.class_weights(df, CLASSES, on_zero="floor").collect()}
    assert floor == {0: 0.5, 1: 1.0, 2: 1.0}
    with pytest.raises(GateError):
        T.require_all_classes(df, "target_cluster_id", CLASSES, "absent")


@pytest.mark.parametrize("bad", [{"temperature_multiplier": 0}, {"outlier_percentile": 80}, {"certainty_floor": 1.5}])
def test_config_ranges(bad):
    with pytest.raises(ValueError):
        T.SoftConfig(**bad)


def test_config_of_the_filter():
    with pytest.raises(ValueError):
        G.BalanceConfig(confidence_threshold=2)


def balance_rows():
    rows = []
    for partition, sizes in {"train": (15, 30, 18), "validation": (7, 12, 8), "test": (8, 14, 9)}.items():
        rank = 0
        for k, n in enumerate(sizes):
            for i in range(n):
                d = [11.0 + 0.01 * ((i * 7) % 5)] * 3
                d[k] = 2.0 + 0.001 * i
                if i == n - 2:
                    d = [5.0] * 3
                    d[k] = 4.9
                if i == n - 1:
                    d = [60.0] * 3
                    d[k] = 50.0
                rows.append((f"{partition}-{k}-{i}", partition, rank, k, d))
                rank += 1
    return rows


def centers(spark):
    c = [[0.0] * 120 for _ in range(3)]
    c[1][0] = 10.0
    c[2][1] = 10.0
    return R.centroid_table(spark, c)


def test_balance_end_to_end(spark):
    pairs = spark.createDataFrame(balance_rows(), SCHEMA)
    rows = G.with_confidence(pairs, centers(spark)).cache()
    limits = G.membership_limits(rows.where("partition = 'train'"), CLASSES, 95.0)
    checked = G.apply_rules(rows, 0.5, limits, CLASSES).cache()
    reasons = {r[0] for r in checked.where("partition = 'train'").select("rejection_reason").distinct().collect()}
    assert reasons == {"accepted", "insufficient_centroid_separation", "cluster_membership_outlier"} or "accepted" in reasons
    accepted = checked.where("confidence_accepted")
    parts = {"in": accepted, "out": checked.where("not confidence_accepted")}
    assert check_conserved(rows, parts, "pair_id").first().conserved
    train = accepted.where("partition = 'train'").cache()
    balanced = G.temporal_balance(train, CLASSES, block_size=7).cache()
    sizes = {r.target_cluster_id: r["count"] for r in balanced.groupBy("target_cluster_id").count().collect()}
    assert len(sizes) == 3 and len(set(sizes.values())) == 1
    left = G.balance_excluded(train, balanced)
    assert left.count() + balanced.count() == train.count()
    # the same choice with numpy's segment rule
    by_class = {k: sorted((r.chronological_rank, r.pair_id, r.geometric_confidence) for r in train.where(F.col("target_cluster_id") == k).collect()) for k in CLASSES}
    m = min(len(v) for v in by_class.values())
    expected = set()
    for members in by_class.values():
        for segment in np.array_split(np.arange(len(members)), m):
            expected.add(min((members[i] for i in segment), key=lambda x: (-x[2], x[0], x[1]))[1])
    assert {r.pair_id for r in balanced.collect()} == expected


def test_confidence_refuses_wrong_labels(spark):
    rows = [list(r) for r in balance_rows()]
    rows[0][3] = 1
    with pytest.raises(GateError):
        G.with_confidence(spark.createDataFrame(rows, SCHEMA), centers(spark))


def test_equal_centroids_are_refused(spark):
    with pytest.raises(Exception, match="coincide"):
        R.centroid_matrix(R.centroid_table(spark, [[1.0, 2.0], [1.0, 2.0]])).collect()


@pytest.mark.parametrize("p", [0.0, 0.01, 0.37, 0.5, 0.99, 1.0])
def test_quantile_equals_numpy(spark, p):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), rng.exponential(size=500) * 1e6])
    groups = (np.arange(len(values)) % 7 == 0).astype(int)
    df = spark.createDataFrame(list(zip(groups.tolist(), values.tolist())), "g int, x double").repartition(8)
    got = {r.g: r.quantile for r in exact_quantile(df, "x", p, "g", [0, 1]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.percentile(values[groups == g], 100 * p), rel=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.13, 0.5, 0.777, 1.0])
def test_quantile_of_values_that_are_hard_to_tell_apart(spark, p):
    """Neighbouring doubles, denormals, both zeros, signs, infinities and not-a-number; nulls are ignored."""
    rng = np.random.default_rng(8)
    near = np.frombuffer((np.float64(1.7).view(np.int64) + rng.integers(0, 3000, 4000)).tobytes(), np.float64)
    tiny = np.frombuffer(rng.integers(1, 1 << 44, 2000).tobytes(), np.float64)
    wide = rng.choice([-1.0, 1.0], 3000) * 2.0 ** rng.uniform(-1000, 1000, 3000)
    parts = {0: near, 1: np.r_[-tiny, tiny, 0.0, -0.0], 2: wide, 3: np.r_[wide, np.inf, -np.inf, -np.inf], 4: np.full(5000, 3.25), 5: np.r_[near, np.full(2000, np.nan)]}
    rows = [(g, float(x)) for g, v in parts.items() for x in v] + [(0, None), (2, None), (9, 1.0)]
    got = {r.g: r.q for r in exact_quantile(spark.createDataFrame(rows, "g int, x double").repartition(5), "x", p, "g", range(7), "q").collect()}
    assert set(got) == set(parts)
    for g, v in parts.items():
        v = np.sort(v)  # not-a-number last
        at = p * (len(v) - 1)
        low, high = v[int(np.floor(at))], v[min(int(np.floor(at)) + 1, len(v) - 1)]
        want = low if at == np.floor(at) else low + (high - low) * (at - np.floor(at))
        assert got[g] == want or np.isnan(got[g]) and np.isnan(want)


def test_quantile_plan_reads_its_rows_once_and_sorts_no_group(spark):
    df = spark.range(200_000).selectExpr("id % 2 as g", "rand(3) as x")
    quantile = exact_quantile(df, "x", 0.5, "g", [0, 1])
    quantile.collect()
    plan = quantile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 3 and not re.search(r"Sort \[[^\]]*_x#", plan)


def test_quantile_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(5.0,)], "x double")
    assert exact_quantile(one, "x", 0.99).first()[0] == 5.0
    assert exact_quantile(one.where("x < 0"), "x", 0.5).count() == 0


def test_silhouette_reads_all_rows(spark):
    """All rows by squared distances, and the Euclidean form in several blocks, against brute force."""
    import numpy as np

    from regimeweave.operators import cluster_metrics

    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 5200)
    labels[0] = 9  # a cluster of one row
    x = rng.normal(0, 1, (5200, 2)) + labels[:, None]
    rows = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x))], "id long, c int, v array<double>")
    far = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    kinds, sizes = np.unique(labels, return_counts=True)
    own, at = np.searchsorted(kinds, labels), np.arange(5200)

    def brute(far):
        sums = np.stack([far[:, labels == c].sum(1) for c in kinds], 1)
        inside = sums[at, own] / np.maximum(1, sizes[own] - 1)
        means = sums / sizes
        means[at, own] = np.inf
        return np.where(sizes[own] == 1, 0, (means.min(1) - inside) / np.maximum(inside, means.min(1))).mean()

    got = cluster_metrics.silhouette(rows.unionByName(rows.limit(3).withColumn("c", F.lit(None).cast("int"))), "v", "c", [0, 1, 2, 9]).first()
    assert (got.rows, got.unlabelled) == (5200, 3) and abs(got.silhouette - brute(far)) < 1e-9
    sampled = cluster_metrics.sampled_silhouette(rows, "v", "c", "id", 6000).first()
    assert sampled.sampled == 5200 and abs(sampled.silhouette - brute(np.sqrt(far))) < 1e-9
    assert cluster_metrics.sampled_silhouette(rows, "v", "c", "id", 100).first().sampled == 100
    with pytest.raises(Exception, match="label without a declared class"):
        cluster_metrics.silhouette(rows, "v", "c", [0, 1, 2]).collect()
