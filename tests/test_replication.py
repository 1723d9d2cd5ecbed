"""Replicated fits: metrics and paired intervals recomputed from the predictions as they were written."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeweave.operators import bootstrap as BB
from regimeweave.plans import replication as RP
from regimeweave.plans.cases_eval import formula


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    data, place = [], {"train": 0, "validation": 0, "test": 0}
    for i in range(300):
        part = "train" if i < 180 else "validation" if i < 230 else "test"
        x = rng.normal(size=2)
        y = int(x[0] > 0) + int(x[1] > 0.8)
        soft = np.full(3, 0.1)
        soft[y] = 0.8
        data.append((part, place[part], y, int(rng.integers(0, 3)), [float(v) for v in x], [float(v) for v in soft], float(rng.uniform(0.2, 1)), bool(rng.uniform() < 0.95)))
        place[part] += 1
    made = spark.createDataFrame(data, "partition string, position long, target_cluster_id int, input_cluster_id int, x array<double>, target_soft array<double>, certainty_weight double, training_eligible boolean")
    weights = spark.createDataFrame([(0, 1.5), (1, 0.5), (2, 2.0)], "cluster_id int, soft_class_weight double")
    return RP.with_soft_mass(made, weights)


def test_soft_mass(rows):
    r = rows.first()
    assert r.mass == pytest.approx([s * w * r.certainty_weight for s, w in zip(r.target_soft, (1.5, 0.5, 2.0), strict=True)])


def test_summary_equals_the_written_predictions(spark, rows, tmp_path):
    nets = RP.grid({"a": ("x", "mass", 2)}, (0, 1, 2), seeds=(1, 2, 3))
    fitted, scored = RP.fit_and_predict(rows, nets, steps=15)
    got = {r.kind: r for r in RP.compare_kinds(scored, nets, "a", 3, 8, draws=300, start_expr=formula).collect()}
    assert set(got) == {"linear", "mlp"} and all(r.seeds == 3 and r.draws == 300 for r in got.values())
    scored.select("partition", "position", "target_cluster_id", "input_cluster_id", "predicted").write.parquet(str(tmp_path / "p"))
    starts = BB.draw_starts(scored.where("partition = 'test'"), 8, 300, start_expr=formula)
    starts.write.parquet(str(tmp_path / "s"))
    con = duckdb.connect()
    con.execute(f"""create table m as select "partition" as part, position, target_cluster_id as actual, m, case when m < 6 then predicted[m + 1] else input_cluster_id end as guess
      from '{tmp_path}/p/*.parquet', range(7) t(m)""")
    con.execute(f"""create table d as select s.draw, s.start + o as position from '{tmp_path}/s/*.parquet' s, range(8) t(o)
      where o < least(8, 70 - s.block * 8, 70 - s.start)""")
    f1 = """select g, m, avg(case when c is null then null else f end) as f1 from (
        select g, m, c, 2.0 * sum(case when actual = c and guess = c then 1 else 0 end) / nullif(sum(case when actual = c then 1 else 0 end) + sum(case when guess = c then 1 else 0 end), 0) as f
        from ({source}), range(3) k(c) group by all) where f is not null group by all"""
    plain = dict(((g, m), f) for g, m, f in con.execute(f1.format(source="select part as g, m, actual, guess from m where part <> 'train'")).fetchall())
    drawn = dict(((g, m), f) for g, m, f in con.execute(f1.format(source="select d.draw as g, m.m, actual, guess from d join m on m.part = 'test' and m.position = d.position")).fetchall())
    for kind, at in {"linear": (0, 1, 2), "mlp": (3, 4, 5)}.items():
        r = got[kind]
        test = [plain["test", m] for m in at]
        assert r.test_mean == pytest.approx(np.mean(test)) and r.test_sd == pytest.approx(np.std(test, ddof=1))
        assert r.validation_mean == pytest.approx(np.mean([plain["validation", m] for m in at]))
        assert r.point == pytest.approx(np.mean(test) - plain["test", 6])
        differences = [np.mean([drawn[g, m] for m in at]) - drawn[g, 6] for g in range(300)]
        assert [r.ci_low, r.ci_high] == pytest.approx(list(np.percentile(differences, [2.5, 97.5])))
        assert r.p_gt_0 == pytest.approx(np.mean(np.array(differences) > 0))
        assert [f.validation for f in fitted][at[0]] == pytest.approx(plain["validation", at[0]])


def test_long_bootstrap_equals_the_wide_one(spark, rows):
    test = rows.where("partition = 'test'").select("position", F.col("target_cluster_id").alias("actual"), F.col("input_cluster_id").alias("base"), (F.col("position") % 3).cast("int").alias("other"))
    starts = BB.draw_starts(test, 8, 100, seed=3)
    wide = BB.bootstrap_draws(test, starts, 8, 3, ["other"], "base")
    long = test.select("position", "actual", F.expr("inline(array(struct('base' as model, base as guess), struct('other' as model, other as guess)))"))
    tall = BB.bootstrap_scores(long, starts, 8, 3, ["model"], predicted="guess", block_size=16)
    a = {(r.draw, m): r[f"f1_{m}"] for r in wide.collect() for m in ("base", "other")}
    b = {(r.draw, r.model): r.macro_f1 for r in tall.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
