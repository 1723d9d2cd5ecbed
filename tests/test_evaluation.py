"""Metrics, bootstrap, baselines, discovery and models against plain Python."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeweave.operators import baselines as B
from regimeweave.operators import bootstrap as BB
from regimeweave.operators import cluster_metrics as M
from regimeweave.operators import compare as CP
from regimeweave.operators import discovery as D
from regimeweave.operators import metrics as MX
from regimeweave.operators import models as ML
from regimeweave.operators import regimes as R
from regimeweave.operators import restarts, strides
from regimeweave.operators.quality import GateError
from regimeweave.operators.restarts import fit_kmeans_many, spread_start


def f1_macro(y, p, k=3, observed=True):
    scores = []
    for c in range(k):
        tp = sum(a == c and b == c for a, b in zip(y, p))
        both = sum(a == c for a in y) + sum(b == c for b in p)
        if both or not observed:
            scores.append(2 * tp / both if both else 0.0)
    return sum(scores) / len(scores)


def test_metrics_with_an_absent_class(spark):
    y, p = [0, 0, 1, 1, 1], [0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(y, p)), "actual int, predicted int")
    row = MX.metrics(df, 3).first()
    assert row.macro_f1 == pytest.approx(f1_macro(y, p))
    assert row.accuracy == 0.6 and row.balanced_accuracy == pytest.approx((0.5 + 2 / 3) / 2)
    assert MX.metrics(df, 3, labels="all").first().macro_f1 == pytest.approx(f1_macro(y, p, observed=False))
    table = {r.cluster_id: r for r in MX.per_class(df, 3).collect()}
    assert table[2].f1 == 0.0 and table[2].support == 0 and table[1].precision == pytest.approx(2 / 3)


def test_strata_keep_empty_rows(spark):
    df = spark.createDataFrame([(0, 0, 1 / 3), (1, 0, 0.5)], "actual int, predicted int, certainty_weight double")
    rows = {r.certainty_stratum: (r.samples, r.accuracy) for r in MX.strata_metrics(df, 3).collect()}
    assert rows == {"low": (1, 1.0), "medium": (1, 0.0), "high": (0, None)}


def test_prediction_audit_flags(spark):
    rows = [("a", 0, [0.7, 0.2, 0.1]), ("b", 1, [0.7, 0.2, 0.1]), ("c", 2, [float("nan"), 0.5, 0.5])]
    frame = MX.prediction_frame(spark.createDataFrame(rows, "pair_id string, target_cluster_id int, probability array<double>"), 3)
    assert frame.where("pair_id = 'a'").first().prediction_correct
    row = MX.audit_predictions(frame, 3).first()
    assert row.rows == 3 and row.non_finite_rows == 1


@pytest.mark.parametrize("n,length", [(61, 12), (40, 40), (7, 12), (100, 1)])
def test_bootstrap_equals_resampling(spark, n, length):
    rng = np.random.default_rng(n)
    y, a, b = (rng.integers(0, 3, n) for _ in range(3))
    y[: n // 2] = 0  # class 2 is absent in some draws
    df = spark.createDataFrame([(i, int(y[i]), int(a[i]), int(b[i])) for i in range(n)], "position bigint, actual int, a int, b int")
    starts = BB.numpy_starts(spark, n, length, 20, seed=3)
    got = {r.draw: r for r in BB.bootstrap_draws(df, starts, length, 3, ["a"], "b", block_size=9).collect()}
    generator = np.random.default_rng(3)
    for draw in range(20):
        picked = generator.choice(np.arange(max(1, n - length + 1)), size=math.ceil(n / length), replace=True)
        idx = np.concatenate([np.arange(s, min(s + length, n)) for s in picked])[:n]
        assert got[draw].f1_a == pytest.approx(f1_macro(y[idx], a[idx]))
        assert got[draw].difference == pytest.approx(f1_macro(y[idx], a[idx]) - f1_macro(y[idx], b[idx]))


def test_hashed_starts_fit(spark):
    rows = spark.range(1000).withColumnRenamed("id", "position")
    starts = BB.draw_starts(rows, 30, 50, seed=1, chunk=7)
    row = starts.agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("start").alias("z"), F.count_distinct("start").alias("d")).first()
    assert row.n == 50 * 34 and row.a >= 0 and row.z <= 970 and row.d > 700
    assert sorted(starts.collect()) == sorted(BB.draw_starts(rows, 30, 50, seed=1).collect())


def test_block_length():
    assert BB.block_length(90, 30, 5) == 48 and BB.block_length(90, 30, 60) == 8


def test_baselines_on_ties_and_unseen_classes(spark):
    train = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2)], "input_cluster_id int, target_cluster_id int")
    assert B.majority(train, (0, 1, 2)).first()[0] == 1
    rules = {r.current_cluster_id: r.predicted_cluster_id for r in B.transition_map(train, (0, 1, 2)).collect()}
    assert rules == {0: 1, 1: 1, 2: 1}
    rows = B.with_baselines(train.withColumn("partition", F.lit("train")), (0, 1, 2))
    assert {(r.majority, r.persistence, r.transition) for r in rows.collect()} == {(1, 0, 1), (1, 1, 1)}


def test_strides_share_one_job(spark):
    df = spark.range(31).withColumnRenamed("id", "input_start_index")
    counts = {r.stride: r["count"] for r in strides.stride_frames(df, (5, 10, 30)).groupBy("stride").count().collect()}
    assert counts == {5: 7, 10: 4, 30: 2}


def test_selection_ignores_test_rows(spark):
    rows = [("a", 0, "validation", 0.5), ("b", 1, "validation", 0.5), ("b", 1, "test", 0.9)]
    scores = spark.createDataFrame(rows, "model string, listing_order int, partition string, macro_f1 double")
    assert CP.select_model(scores).first().model == "a"
    first = CP.compare({"x": scores.where("model = 'a'"), "y": scores.where("model = 'b'").withColumn("extra", F.lit(1))}).first()
    assert first.experiment == "y" and first.partition == "test"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c, center in enumerate([(0, 0, 0), (8, 0, 0), (0, 8, 0)]):
        for i in range(60):
            rows.append((len(rows), [float(x) for x in rng.normal(center, 0.5)], c))
    return spark.createDataFrame(rows, "id bigint, v array<double>, label int").cache()


def test_kmeans_finds_the_blobs(spark, blobs):
    labelled = R.assign(blobs, "v", D.fit_kmeans(blobs, "v", 3, n_init=2))
    assert M.adjusted_rand(labelled, "label", "cluster_id").first()[0] == pytest.approx(1.0)
    assert M.silhouette(labelled, "v", "cluster_id", range(3)).first().silhouette > 0.8
    assert M.sampled_silhouette(labelled, "v", "cluster_id", "id", 1000).first().silhouette > 0.8


def test_restarts_equal_lloyd(spark, blobs):
    """Every start runs on its own, whatever runs beside it, and equals plain iterations from the same rows."""
    points = [r.v for r in blobs.collect()]
    x = np.array(points)
    starts = [(2, 1), (3, 1), (3, 2), (5, 7)]
    together = fit_kmeans_many(blobs.repartition(4), "v", starts)
    sample = np.array([r.v for r in blobs.orderBy(F.xxhash64("v"), "v").collect()])
    for (k, seed), f in zip(starts, together, strict=True):
        c = spread_start(sample, k, seed)
        for _ in range(300):
            own = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        assert np.array(f.centers) == pytest.approx(c, abs=1e-6)
        assert f.cost == pytest.approx(((x[:, None] - c) ** 2).sum(2).min(1).sum())
    with pytest.raises(ValueError, match="no rows"):
        fit_kmeans_many(blobs.limit(0), "v", starts)
    same = spark.createDataFrame([([1.0, 2.0],)] * 5 + [(None,)], "v array<double>")
    assert fit_kmeans_many(same, "v", [(3, 0)])[0].cost == pytest.approx(0.0)


def test_fits_read_blocks_dealt_over_the_tasks(spark, monkeypatch):
    """Rows in one file part are stepped over by all tasks, and the fits are those of tasks' sums that meet in a shuffle."""
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (600, 4)) + 3 * rng.integers(0, 3, (600, 1))
    rows = spark.createDataFrame([(p.tolist(),) for p in points] + [(None,)], "v array<double>").coalesce(1)
    monkeypatch.setattr(restarts, "BLOCK", 64)
    seen, step = [], restarts.sums_over_rows

    def watched(held, params, add, **how):
        seen.append((held.rdd.getNumPartitions(), how["merged"]))
        return step(held, params, add, **how)

    monkeypatch.setattr(restarts, "sums_over_rows", watched)
    starts = [(2, 1), (3, 1), (3, 2)]
    plain = fit_kmeans_many(rows, "v", starts)
    assert set(seen) == {(spark.sparkContext.defaultParallelism, False)} and spark.sparkContext.defaultParallelism > 1
    monkeypatch.setattr(restarts, "FEW", 0)
    monkeypatch.setattr(restarts, "MOST", 300)
    merged = fit_kmeans_many(rows, "v", starts)
    assert seen[-1] == (8, True)
    for a, b in zip(plain, merged, strict=True):
        assert np.array(a.centers) == pytest.approx(np.array(b.centers)) and a.iterations == b.iterations
        assert a.cost == pytest.approx(b.cost) == pytest.approx(((points[:, None] - np.array(a.centers)) ** 2).sum(2).min(1).sum())


def test_sweep_measures_come_from_its_written_assignment(spark, blobs, tmp_path):
    measures, written = D.sweep_fits(blobs, "v", 3, "id", range(2, 5), n_init=3, repeats=3)
    got = {r.k: r for r in measures.collect()}
    written.write.parquet(str(tmp_path / "w"))
    con = duckdb.connect()
    con.execute(f"create table w as select * from '{tmp_path}/w/*.parquet'")
    assert sorted(got) == [2, 3, 4] and max(got, key=lambda k: got[k].silhouette_score) == 3
    for k, r in got.items():
        inertia, smallest = con.execute("select sum(d), min(n) from (select cluster_id, sum(distance_to_centroid ** 2) d, count(*) n from w where k = ? group by 1)", [k]).fetchone()
        assert r.inertia == pytest.approx(inertia) and r.minimum_cluster_size == smallest
        want = con.execute("""with p as (select x.id, x.cluster_id own, y.cluster_id other, sum(list_distance(x.v, y.v) ** 2) s, count(*) n from w x, w y where x.k = ? and y.k = ? group by all),
          s as (select id, sum(s) filter (own = other) / (max(n) filter (own = other) - 1) a, min(s / n) filter (own <> other) b from p group by 1) select avg((b - a) / greatest(a, b)) from s""", [k, k]).fetchone()[0]
        assert r.silhouette_score == pytest.approx(want)
        runs = np.array([x[0] for x in con.execute("select runs from w where k = ? order by id", [k]).fetchall()])
        ari = np.mean([adjusted_rand_by_pairs(runs[:, i], runs[:, j]) for i in range(3) for j in range(i)])
        assert r.stability_ari_mean == pytest.approx(ari)
    assert D.stability(blobs, "v", 3, "id", repeats=2, n_init=3).first()[0] == pytest.approx(1.0)


def adjusted_rand_by_pairs(a, b):
    i, j = np.triu_indices(len(a), 1)
    same_a, same_b = a[i] == a[j], b[i] == b[j]
    both, n = (same_a & same_b).sum(), len(i)
    expected = same_a.sum() * same_b.sum() / n
    most = (same_a.sum() + same_b.sum()) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


def test_cluster_metrics_equal_numpy(spark, blobs):
    rows = blobs.collect()
    x, y = np.array([r.v for r in rows]), np.array([r.label for r in rows])
    means = np.array([x[y == c].mean(axis=0) for c in range(3)])
    spread = [np.linalg.norm(x[y == c] - means[c], axis=1).mean() for c in range(3)]
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(3) if j != i) for i in range(3)])
    within = sum(((x[y == c] - means[c]) ** 2).sum() for c in range(3))
    between = sum((y == c).sum() * ((means[c] - x.mean(axis=0)) ** 2).sum() for c in range(3))
    assert M.davies_bouldin(blobs, "v", "label", 3, range(3)).first()[0] == pytest.approx(db)
    assert M.calinski_harabasz(blobs, "v", "label", 3, range(3)).first()[0] == pytest.approx((between / 2) / (within / 177))


def test_silhouette_of_one_label_is_nan(spark, blobs):
    one = blobs.withColumn("label", F.lit(0))
    row = M.sampled_silhouette(one, "v", "label", "id", max_n=50).first()
    assert row.sampled == 50 and math.isnan(row.silhouette)
    assert math.isnan(M.silhouette(one, "v", "label", [0]).first().silhouette)


def test_adjusted_rand_edges(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)], "a int, b int, c int")
    assert M.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(-0.5)
    assert M.adjusted_rand(df, "c", "c").first()[0] == 1.0
    assert M.mean_pairwise_rand(df, ["a"]).first()[0] == 1.0


def test_pca_limits_and_fraction(spark, blobs):
    whole = D.fit_pca(blobs, "v", 3, 120).first()
    assert len(whole.components) == 3 and sum(whole.explained) == pytest.approx(1.0)
    part = D.fit_pca(blobs, "v", 3, 0.9).first()
    assert sum(part.explained) >= 0.9 > sum(part.explained[:-1])
    few = D.fit_pca(blobs.limit(3), "v", 3, 3).first()
    assert len(few.components) == 2
    x = np.array([r.v for r in blobs.collect()])
    reduced = R.apply_pca(blobs, "v", D.fit_pca(blobs, "v", 3, 3))
    z = np.array([r.reduced for r in reduced.collect()])
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(np.linalg.norm(z, axis=1), np.linalg.norm(x - x.mean(axis=0), axis=1))


def test_frozen_definition_contract(spark, blobs):
    table = R.mean_vectors(blobs, "v", "label", 3, range(3))
    R.check_frozen(table, 3, 3)
    with pytest.raises(GateError):
        R.check_frozen(table, 4, 3)
    good = R.definition_facts(table).first().centroid_hash
    R.check_frozen(table, 3, 3, hashes={"centroid_hash": good})
    with pytest.raises(GateError):
        R.check_frozen(table, 3, 3, hashes={"centroid_hash": "0"})


def test_distance_ties_take_the_lower_id(spark):
    df = spark.createDataFrame([([0.0],)], "v array<double>")
    row = R.assign(df, "v", R.centroid_table(spark, [[2.0], [1.0], [-1.0]])).first()
    assert row.cluster_id == 1 and row.nearest_cluster_order == [1, 2, 0] and row.relative_distance_margin == 0.0


def test_scores_of_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (float("nan"), 5.0), (3.0, 5.0)], "a double, b double")
    rows = df.select(D.min_max(F.col("a")).alias("a"), D.min_max(F.col("a"), True).alias("r"), D.min_max(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(0.0, 1.0, 1.0), (0.0, 0.0, 1.0), (1.0, 0.0, 1.0)]


def test_empty_cluster_keeps_its_row(spark, blobs):
    labelled = R.assign(blobs, "v", R.mean_vectors(blobs, "v", "label", 3, range(3)))
    rows = {r.cluster_id: r.training_size for r in D.inspect_clusters(labelled, range(5), "id").collect()}
    assert rows == {0: 60, 1: 60, 2: 60, 3: 0, 4: 0}
    assert D.exemplars(labelled, 4, range(5), "id").count() == 24


def test_standardizer_modes(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    scale = {m: ML.fit_standardizer(df, "v", 2, m).first().scale for m in ("epsilon", "floor", "zero")}
    assert scale["epsilon"] == pytest.approx([1.0 + 1e-8, 1e-8]) and scale["floor"] == [1.0, 1.0] and scale["zero"] == [1.0, 1.0]


def test_models_learn_the_blobs(spark, blobs):
    soft = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.when(c == F.col("label"), 0.9).otherwise(0.05))
    rows = blobs.withColumns({"target_soft": soft, "certainty_weight": F.lit(1.0), "target_cluster_id": F.col("label")})
    weights = spark.createDataFrame([(c, 1.0, 1.0) for c in range(3)], "cluster_id int, soft_class_weight double, class_weight double")
    fitted = [
        ML.fit_soft_logistic(rows, weights, range(3), "v"),
        ML.fit_logistic(rows, weights, range(3), "v"),
        ML.fit_mlp(rows, "v", 3, 3, hidden=(8,), max_iter=50),
    ]
    for model in fitted:
        out = ML.predict(model, rows, "v").withColumn("predicted", F.array_position("probability", F.array_max("probability")) - 1)
        assert MX.metrics(out, 3, actual="label").first().accuracy > 0.95
    shares = ML.predict(fitted[0], rows, "v").agg(F.avg(F.array_max("probability"))).first()[0]
    assert shares < 0.97  # soft targets keep the model from full confidence


def test_weighted_resampling_is_repeatable(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("pair_id"), (F.col("id") % 4 / 2.0).alias("w"))
    once = ML.resample_weighted(df, F.col("w"), 1).groupBy("w").count().collect()
    assert sorted(once) == sorted(ML.resample_weighted(df, F.col("w"), 1).groupBy("w").count().collect())
    counts = {r.w: r["count"] for r in once}
    assert 0.0 not in counts and counts[1.0] == 1000 and 420 < counts[0.5] < 580 and 1420 < counts[1.5] < 1580
