"""Queries for baselines, models, metrics and uncertainty, each with its check statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.operators import baselines as B
from regimeweave.operators import bootstrap as BB
from regimeweave.operators import compare as CP
from regimeweave.operators import metrics as MX
from regimeweave.operators import models as ML
from regimeweave.operators import soft_targets as T
from regimeweave.operators.lookups import with_lookup
from regimeweave.operators import splits, strides
from regimeweave.operators import windows as W
from regimeweave.operators.networks import Network, fit_networks, predict_networks
from regimeweave.operators.reports import with_rank
from regimeweave.plans import inputs as I
from regimeweave.plans import replication as RP
from regimeweave.plans import sql_parts as S
from regimeweave.plans.cases_align import LONG_SQL, long_pairs
from regimeweave.plans.inputs import CLASSES, K, N, PERIODS, tidy
from regimeweave.plans.sql_parts import b, r
from regimeweave.session import stage

QUERIES, SQL = {}, {}
SOFT = S.base()
PARTS = S.base(upto="parts")
DIM = 64


def case(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- baselines and metrics ---------------------------------------------------------------

RULES = """mj AS (SELECT target_cluster_id AS maj FROM parts WHERE "partition" = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
tr AS (SELECT a, coalesce((SELECT target_cluster_id FROM parts WHERE "partition" = 'train' AND input_cluster_id = a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), maj) AS nxt
  FROM (SELECT unnest(range(3)) AS a), mj),
rules AS (SELECT pair_id, "partition", input_start_time, target_cluster_id AS actual, 'majority' AS rule, maj AS predicted FROM parts, mj
  UNION ALL SELECT pair_id, "partition", input_start_time, target_cluster_id, 'persistence', input_cluster_id FROM parts
  UNION ALL SELECT pair_id, "partition", input_start_time, target_cluster_id, 'transition', nxt FROM parts JOIN tr ON a = input_cluster_id)"""
RULE_CELLS = f'{PARTS},\n{RULES}, cells AS (SELECT "partition", rule, {S.cells()} FROM rules GROUP BY 1, 2)'


def predictions(spark, sf):
    return B.long_predictions(B.with_baselines(I.pairs(spark, sf), CLASSES))


@case(
    "I0_persistence_macro_f1",
    f"""{PARTS}, cells AS (SELECT "partition", {S.cells('target_cluster_id', 'input_cluster_id')} FROM parts GROUP BY 1)
    SELECT "partition", {', '.join(S.metric_columns())} FROM cells""",
)
def persistence_macro_f1(spark, sf):
    """Bars, windows, regimes, pairs, split, and the score of 'nothing changes' per partition."""
    rows = splits.split_fixed(I.all_pairs(spark, sf), PERIODS)
    return tidy(MX.metrics(rows, K, ["partition"], "target_cluster_id", "input_cluster_id"))


@case("I1_majority", f"""{PARTS},\n{RULES} SELECT {b('maj', 'majority_class')} FROM mj""")
def majority(spark, sf):
    return tidy(B.majority(I.pairs(spark, sf).where("partition = 'train'"), CLASSES))


@case("I1_label_majority", "SELECT CAST(label AS BIGINT) AS majority_class FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1")
def label_majority(spark, sf):
    return tidy(B.majority(I.table(spark, sf, "embeddings"), range(10), "label"))


@case("I3_transition_map", f"{PARTS},\n{RULES} SELECT {b('a', 'current_cluster_id')}, {b('nxt', 'predicted_cluster_id')} FROM tr")
def transition_map(spark, sf):
    return tidy(B.transition_map(I.pairs(spark, sf).where("partition = 'train'"), CLASSES))


@case("I1_I2_I3_predictions", f"""{PARTS},\n{RULES} SELECT pair_id, "partition", rule, {b('actual')}, {b('predicted')} FROM rules""")
def baseline_predictions(spark, sf):
    return tidy(predictions(spark, sf))


@case(
    "I4_confusion",
    f"""{PARTS},\n{RULES}, k AS (SELECT p, q, x.c AS a, y.c AS z FROM (SELECT DISTINCT "partition" AS p, rule AS q FROM rules), {S.classes()} x, {S.classes()} y)
    SELECT p AS "partition", q AS rule, {b('a', 'actual')}, {b('z', 'predicted')}, count(pair_id) AS count
    FROM k LEFT JOIN rules ON "partition" = p AND rule = q AND rules.actual = a AND rules.predicted = z GROUP BY p, q, a, z""",
)
def confusion(spark, sf):
    return tidy(MX.confusion(predictions(spark, sf), K, ["partition", "rule"]))


@case(
    "I5_per_class",
    f"""{PARTS},\n{RULES}, k AS (SELECT "partition", rule, c, count(*) FILTER (WHERE actual = c AND predicted = c) AS tp,
      count(*) FILTER (WHERE predicted = c) AS chosen, count(*) FILTER (WHERE actual = c) AS support FROM rules, {S.classes()} GROUP BY 1, 2, 3)
    SELECT "partition", rule, {b('c', 'cluster_id')}, {r('coalesce(tp / nullif(chosen, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(support, 0), 0)', 'recall')},
    {r('coalesce(2.0 * tp / nullif(chosen + support, 0), 0)', 'f1')}, support FROM k""",
)
def per_class(spark, sf):
    return tidy(MX.per_class(predictions(spark, sf), K, ["partition", "rule"]))


@case("I6_metrics", f"""{RULE_CELLS} SELECT "partition", rule, {', '.join(S.metric_columns())} FROM cells""")
def metrics(spark, sf):
    return tidy(MX.metrics(predictions(spark, sf), K, ["partition", "rule"]))


# --- probabilistic predictions -----------------------------------------------------------


def model_sql(name: str, temperature: float, shift: tuple[float, float, float] = (0, 0, 0), source: str = "ann") -> str:
    """Class probabilities from the input window's own distances: a stand-in model both engines can compute."""
    e = [f"exp((least(i0 + {shift[0]}, i1 + {shift[1]}, i2 + {shift[2]}) - (i{k} + {shift[k]})) / {temperature})" for k in range(3)]
    total = " + ".join(e)
    p = ", ".join(f"{e[k]} / ({total}) AS p{k}" for k in range(3))
    return f"""{name}_p AS (SELECT *, {p} FROM {source}),
{name} AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM {name}_p)"""


def with_model(df, temperature: float, shift=(0.0, 0.0, 0.0), out: str = "probability"):
    moved = F.zip_with("input_distances", F.array(*[F.lit(float(s)) for s in shift]), lambda d, s: d + s)
    return df.withColumn(out, V.gibbs(moved, F.lit(float(temperature))))


FIRST, SECOND = (0.5, (0.0, 0.0, 0.0)), (0.5, (0.3, 0.0, 0.15))
MODEL = f"{SOFT},\n{model_sql('ma', *FIRST)}"


def scored(spark, sf):
    rows = I.soft_pairs(I.pairs(spark, sf)).where("temperature is not null")
    return with_model(stage(rows, "annotated"), *FIRST)


@case(
    "I7_soft_scores",
    f"""{MODEL} SELECT "partition", {r('avg(-(m0 * ln(least(greatest(p0, 1e-12), 1)) + m1 * ln(least(greatest(p1, 1e-12), 1)) + m2 * ln(least(greatest(p2, 1e-12), 1))))', 'soft_cross_entropy')},
    {r('avg((p0 - m0) ** 2 + (p1 - m1) ** 2 + (p2 - m2) ** 2)', 'soft_brier')} FROM ma GROUP BY 1""",
)
def soft_scores(spark, sf):
    return tidy(MX.soft_scores(scored(spark, sf), ["partition"]))


@case(
    "I8_soft_loss",
    f"""{MODEL}, w AS (SELECT count(*) / (3 * sum(m0)) AS w0, count(*) / (3 * sum(m1)) AS w1, count(*) / (3 * sum(m2)) AS w2 FROM kept)
    SELECT "partition", {r('sum(cw * -(w0 * m0 * ln(greatest(p0, 1e-12)) + w1 * m1 * ln(greatest(p1, 1e-12)) + w2 * m2 * ln(greatest(p2, 1e-12)))) / sum(cw)', 'soft_loss')}
    FROM ma, w GROUP BY 1""",
)
def soft_loss(spark, sf):
    rows = scored(spark, sf)
    weights = T.soft_class_weights(T.retained(rows), CLASSES, on_none="null")
    return tidy(MX.soft_loss(rows, weights, K, ["partition"]))


@case(
    "I9_standardizer",
    """WITH em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    f AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) + 1e-8 AS s FROM em, (SELECT unnest(range(1, 65)) AS i) WHERE label < 8 GROUP BY 1)
    SELECT vec_id, CAST(i - 1 AS BIGINT) AS position, round((v[i] - m) / s, 6) + 0.0 AS value FROM em, f""",
)
def standardizer(spark, sf):
    rows = I.table(spark, sf, "embeddings")
    fitted = ML.fit_standardizer(rows.where("label < 8"), "embedding", DIM)
    out = ML.standardize(rows, "embedding", fitted)
    return tidy(out.select("vec_id", F.posexplode("standardized").alias("position", "value")))


def _seed_runs(spark, sf):
    rows = stage(I.pairs(spark, sf).select("pair_id", "partition", "target_cluster_id", "input_distances"), "slim")
    models = [with_model(rows, 0.5, (0.1 * s, 0.0, 0.05 * s)).withColumn("seed", F.lit(s)) for s in range(5)]
    both = models[0]
    for m in models[1:]:
        both = both.unionByName(m)
    return both.withColumn("predicted", V.argmax(F.col("probability"))).withColumnRenamed("target_cluster_id", "actual")


SEEDS_SQL = ",\n".join([PARTS] + [model_sql(f"s{s}", 0.5, (round(0.1 * s, 2), 0, round(0.05 * s, 2)), "parts") for s in range(5)])
SEED_CELLS = f"""{SEEDS_SQL}, runs AS ({' UNION ALL '.join(f'SELECT {s} AS seed, "partition", target_cluster_id AS actual, pred AS predicted FROM s{s}' for s in range(5))}),
cells AS (SELECT seed, "partition", {S.cells()} FROM runs GROUP BY 1, 2), f AS (SELECT seed, "partition", {S.macro_f1(lambda a, p: f'c{a}{p}')} AS macro_f1 FROM cells)"""


@case(
    "I13_select_model",
    f"""{SEED_CELLS} SELECT {b('seed')}, {r('macro_f1')} FROM f WHERE "partition" = 'validation' ORDER BY f.macro_f1 DESC, seed LIMIT 1""",
)
def select_model(spark, sf):
    scores = MX.metrics(_seed_runs(spark, sf), K, ["seed", "partition"])
    return tidy(CP.select_model(scores, "seed").select("seed", "macro_f1"))


@case(
    "I18_seed_summary",
    f"""{SEED_CELLS} SELECT "partition", count(*) AS seeds, {r('avg(macro_f1)', 'mean_macro_f1')}, {r('stddev_samp(macro_f1)', 'sd_macro_f1')} FROM f GROUP BY 1""",
)
def seed_summary(spark, sf):
    scores = MX.metrics(_seed_runs(spark, sf), K, ["seed", "partition"])
    return tidy(CP.seed_summary(scores, ["partition"]))


FRAME = f"""pair_id, {b('target_cluster_id', 'actual_target_cluster_id')}, {b('pred', 'predicted_target_cluster_id')},
  {r('p0', 'predicted_probability_cluster_0')}, {r('p1', 'predicted_probability_cluster_1')}, {r('p2', 'predicted_probability_cluster_2')},
  target_cluster_id = pred AS prediction_correct"""
PLAIN = f"{PARTS},\n{model_sql('ma', *FIRST, 'parts')},\n{model_sql('mb', *SECOND, 'parts')}"


def frame(spark, sf, model=FIRST):
    return MX.prediction_frame(with_model(I.pairs(spark, sf), *model), K)


@case("I14_prediction_frame", f"{PLAIN} SELECT {FRAME} FROM ma")
def prediction_frame(spark, sf):
    return tidy(frame(spark, sf))


BENT = """bent AS (SELECT pair_id, pred, p0, p1, p2 + ((chronological_rank * 7919) % 1000) / 500000.0 AS p2b FROM ma)"""


def bent_frame(spark, sf):
    rows = with_model(I.pairs(spark, sf), *FIRST)
    out = MX.prediction_frame(rows, K, keys=("pair_id", "chronological_rank"))
    extra = ((F.col("chronological_rank") * 7919) % 1000) / 500000.0
    return out.withColumn("predicted_probability_cluster_2", F.col("predicted_probability_cluster_2") + extra)


@case(
    "I15_prediction_audit",
    f"""{PLAIN}, {BENT}, s AS (SELECT *, p0 + p1 + p2b AS s FROM bent) SELECT count(*) AS rows, {b('0', 'non_finite_rows')},
    {r('min(least(p0, p1, p2b))', 'min_probability')}, {r('max(greatest(p0, p1, p2b))', 'max_probability')}, {r('min(s)', 'min_row_sum')}, {r('max(s)', 'max_row_sum')},
    {r('avg(s)', 'mean_row_sum')}, {r('max(abs(s - 1))', 'max_deviation')}, {r('avg(abs(s - 1))', 'mean_deviation')},
    count(*) FILTER (WHERE CASE WHEN p0 >= p1 AND p0 >= p2b THEN 0 WHEN p1 >= p2b THEN 1 ELSE 2 END <> pred) AS argmax_mismatches,
    count(*) FILTER (WHERE abs(s - 1) > 1e-5) AS rows_over_1em05, count(*) FILTER (WHERE abs(s - 1) > 1e-4) AS rows_over_0p0001,
    count(*) FILTER (WHERE abs(s - 1) > 5e-4) AS rows_over_0p0005, count(*) FILTER (WHERE abs(s - 1) > 1e-3) AS rows_over_0p001 FROM s""",
)
def prediction_audit(spark, sf):
    return tidy(MX.audit_predictions(bent_frame(spark, sf), K))


@case(
    "I15_worst_rows",
    f"""{PLAIN}, {BENT} SELECT pair_id, {r('p0', 'predicted_probability_cluster_0')}, {r('p1', 'predicted_probability_cluster_1')}, {r('p2b', 'predicted_probability_cluster_2')},
    {r('p0 + p1 + p2b', 'row_sum')}, {r('abs(p0 + p1 + p2b - 1)', 'absolute_deviation')} FROM bent ORDER BY round(abs(p0 + p1 + p2b - 1), 9) DESC, pair_id LIMIT 10""",
)
def worst_rows(spark, sf):
    rows = bent_frame(spark, sf)
    return tidy(MX.worst_rows(rows, K, digits=9))


DIFF = f"""{PLAIN}, chg AS (SELECT x.pair_id, x.target_cluster_id AS y, x.pred AS before, z.pred AS after, list_sort([z.p0, z.p1, z.p2]) AS q
  FROM ma x JOIN mb z USING (pair_id))"""


@case(
    "I16_changed_rows",
    f"""{DIFF} SELECT pair_id, {b('before', 'original_predicted_target_cluster_id')}, {b('after', 'predicted_target_cluster_id')}, {r('q[3] - q[2]', 'top_two_margin')} FROM chg WHERE before <> after""",
)
def changed_rows(spark, sf):
    rows = stage(I.pairs(spark, sf), "both")
    old, new = (MX.prediction_frame(with_model(rows, *m), K) for m in (FIRST, SECOND))
    changed = MX.changed_rows(old, new, K)
    return tidy(changed.select("pair_id", "original_predicted_target_cluster_id", "predicted_target_cluster_id", "top_two_margin"))


@case(
    "I16_change_crosstab",
    f"""{DIFF} SELECT {b('before', 'original_predicted_target_cluster_id')}, {b('after', 'predicted_target_cluster_id')}, count(*) AS count FROM chg WHERE before <> after GROUP BY before, after""",
)
def change_crosstab(spark, sf):
    rows = stage(I.pairs(spark, sf), "both")
    old, new = (MX.prediction_frame(with_model(rows, *m), K) for m in (FIRST, SECOND))
    return tidy(MX.change_crosstab(MX.changed_rows(old, new, K)))


def _metric(name: str) -> str:
    text = next(m for m in S.metric_columns() if m.endswith(f" AS {name}"))
    return text[len("round(CAST("): text.index(" AS DOUBLE), 6)")]


@case(
    "I16_diff_summary",
    f"""{DIFF}, m AS (SELECT w, {', '.join(f'{_metric(n)} AS {n}' for n in ('accuracy', 'balanced_accuracy', 'macro_f1', 'weighted_f1'))}
      FROM (SELECT 0 AS w, {S.cells('y', 'before')} FROM chg UNION ALL SELECT 1, {S.cells('y', 'after')} FROM chg)),
    n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE before <> after) AS changed FROM chg)
    SELECT rows, true AS targets_identical, changed, {r('100.0 * changed / rows', 'changed_percentage')},
    {', '.join(r(f'z.{c} - x.{c}', f'{c}_change') for c in ('accuracy', 'balanced_accuracy', 'macro_f1', 'weighted_f1'))} FROM n, m x, m z WHERE x.w = 0 AND z.w = 1""",
)
def diff_summary(spark, sf):
    rows = stage(I.pairs(spark, sf), "both")
    old, new = (MX.prediction_frame(with_model(rows, *m), K) for m in (FIRST, SECOND))
    return tidy(MX.diff_summary(old, new, K))


@case(
    "I17_certainty_strata",
    f"""{MODEL}, x AS (SELECT CASE WHEN cw <= 1.0 / 3 THEN 'low' WHEN cw <= 2.0 / 3 THEN 'medium' ELSE 'high' END AS st, target_cluster_id AS actual, pred AS predicted, "partition" AS p FROM ma),
    k AS (SELECT p, st FROM (SELECT DISTINCT p FROM x), (SELECT unnest(['low', 'medium', 'high']) AS st)),
    cells AS (SELECT k.p, k.st, {S.cells()} FROM k LEFT JOIN x ON x.p = k.p AND x.st = k.st GROUP BY 1, 2)
    SELECT p AS "partition", st AS certainty_stratum, {', '.join(S.metric_columns()[:4])} FROM cells""",
)
def certainty_strata(spark, sf):
    rows = scored(spark, sf).withColumn("predicted", V.argmax(F.col("probability")))
    return tidy(MX.strata_metrics(rows, K, ["partition"], actual="target_cluster_id"))


# --- bootstrap ---------------------------------------------------------------------------

LENGTH, DRAWS = 12, 2000
POSITION = """test AS (SELECT *, row_number() OVER (ORDER BY input_start_time, pair_id) - 1 AS i FROM {source} WHERE "partition" = 'test')"""


def formula(draw, block, places):
    """A start that both engines can compute."""
    return (draw * 7919 + block * 104729 + 17) % places


def boot_sql(models: list[str], columns: list[str]) -> str:
    """Explodes every resampled row, unlike the Spark operator."""
    select = ", ".join(f"{c} AS {m}" for m, c in zip(models, columns))
    parts = [
        f"""nn AS (SELECT count(*) AS n FROM test),
st AS (SELECT d, j, (d * 7919 + j * 104729 + 17) % greatest(n - {LENGTH - 1}, 1) AS s, n FROM nn, (SELECT unnest(range({DRAWS})) AS d),
  (SELECT unnest(range((SELECT CAST(ceil(n / {LENGTH}.0) AS BIGINT) FROM nn))) AS j)),
pos AS (SELECT d, s + o AS i FROM st, (SELECT unnest(range({LENGTH})) AS o) WHERE o < least({LENGTH}, n - j * {LENGTH}, n - s)),
res AS (SELECT d, target_cluster_id AS actual, {select} FROM pos JOIN test USING (i))"""
    ]
    for m in models:
        parts.append(f"c_{m} AS (SELECT d, {S.cells('actual', m)} FROM res GROUP BY 1)")
        parts.append(f"f_{m} AS (SELECT d, {S.macro_f1(lambda a, p: f'c{a}{p}')} AS f FROM c_{m})")
    return ",\n".join(parts)


@case(
    "I19_bootstrap_draws",
    f"""{PARTS},\n{RULES}, joined AS (SELECT p.*, nxt FROM parts p JOIN tr ON a = input_cluster_id), {POSITION.format(source='joined')},
    {boot_sql(['transition', 'persistence'], ['nxt', 'input_cluster_id'])}
    SELECT d AS draw, {r('x.f', 'f1_transition')}, {r('z.f', 'f1_persistence')}, {r('x.f - z.f', 'difference')} FROM f_transition x JOIN f_persistence z USING (d)""",
)
def bootstrap_draws(spark, sf):
    rows = _test_rows(spark, sf)
    starts = BB.draw_starts(rows, LENGTH, DRAWS, start_expr=formula)
    return tidy(BB.bootstrap_draws(rows, starts, LENGTH, K, ["transition"], "persistence"))


def _test_rows(spark, sf):
    """Test pairs in time order: the rank inside the partition is the position."""
    with_rules = B.with_baselines(I.pairs(spark, sf), CLASSES)
    test = with_rules.where("partition = 'test'").withColumnsRenamed({"chronological_rank": "position", "target_cluster_id": "actual"})
    return stage(test, "test_rows")


@case(
    "I19_block_bootstrap",
    f"""{PARTS},\n{RULES}, joined AS (SELECT p.*, nxt FROM parts p JOIN tr ON a = input_cluster_id), {POSITION.format(source='joined')},
    {boot_sql(['transition', 'persistence'], ['nxt', 'input_cluster_id'])}, df AS (SELECT x.f - z.f AS v FROM f_transition x JOIN f_persistence z USING (d))
    SELECT count(*) AS draws, {r('avg(v)', 'mean_difference')}, {r('quantile_cont(v, 0.025)', 'ci_low')}, {r('quantile_cont(v, 0.975)', 'ci_high')},
    {r('avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)', 'p_gt_0')} FROM df""",
)
def block_bootstrap(spark, sf):
    rows = _test_rows(spark, sf)
    starts = BB.draw_starts(rows, LENGTH, DRAWS, start_expr=formula)
    return tidy(BB.block_bootstrap(rows, K, ["transition"], "persistence", LENGTH, starts=starts))


@case("I19_block_bootstrap_hashed")
def block_bootstrap_hashed(spark, sf):
    return tidy(BB.block_bootstrap(_test_rows(spark, sf), K, ["transition"], "persistence", 30, 2000, seed=0))


MULTI = f"""{PARTS}, {model_sql('ma', *FIRST, 'parts')}, {model_sql('mb', *SECOND, 'parts')}, joined AS (SELECT p.*, x.pred AS pa, z.pred AS pb FROM parts p JOIN ma x USING (pair_id) JOIN mb z USING (pair_id))"""


@case(
    "I20_multi_model_bootstrap",
    f"""{MULTI}, {POSITION.format(source='joined')}, {boot_sql(['first', 'second', 'base'], ['pa', 'pb', 'input_cluster_id'])},
    df AS (SELECT (x.f + y.f) / 2 - z.f AS v FROM f_first x JOIN f_second y USING (d) JOIN f_base z USING (d))
    SELECT count(*) AS draws, {r('avg(v)', 'mean_difference')}, {r('quantile_cont(v, 0.025)', 'ci_low')}, {r('quantile_cont(v, 0.975)', 'ci_high')},
    {r('avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)', 'p_gt_0')} FROM df""",
)
def multi_model_bootstrap(spark, sf):
    test = I.pairs(spark, sf).where("partition = 'test'").withColumnsRenamed({"chronological_rank": "position", "target_cluster_id": "actual"})
    rows = with_model(with_model(test, *FIRST, "_a"), *SECOND, "_b").withColumns(
        {"first": V.argmax(F.col("_a")), "second": V.argmax(F.col("_b")), "base": F.col("input_cluster_id")}
    )
    rows = stage(rows.select("position", "actual", "first", "second", "base"), "multi")
    starts = BB.draw_starts(rows, LENGTH, DRAWS, start_expr=formula)
    return tidy(BB.block_bootstrap(rows, K, ["first", "second"], "base", LENGTH, starts=starts))


@case(
    "I21_effective_blocks",
    f"""{PARTS} SELECT "partition", count(*) AS rows, {b('ceil(count(*) / 120.0)', 'blocks')} FROM parts GROUP BY 1""",
)
def effective_blocks(spark, sf):
    counts = I.pairs(spark, sf).groupBy("partition").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("blocks", BB.effective_blocks(F.col("rows"), 120))


@case(
    "I22_comparison",
    f"""{RULE_CELLS}, s AS (SELECT "partition", {S.cells('target_cluster_id', 'pred')} FROM ma GROUP BY 1)
    SELECT "partition", 'baseline' AS kind, rule AS experiment, {', '.join(S.metric_columns())} FROM cells
    UNION ALL SELECT "partition", NULL, 'model', {', '.join(S.metric_columns())} FROM s""".replace(", s AS (", f",\n{model_sql('ma', *FIRST, 'parts')}, s AS ("),
)
def comparison(spark, sf):
    rows = B.with_baselines(I.pairs(spark, sf), CLASSES)
    rules = stage(with_model(rows, *FIRST), "compared")
    results = {
        rule: MX.metrics(rules, K, ["partition"], "target_cluster_id", rule).withColumn("kind", F.lit("baseline"))
        for rule in ("majority", "persistence", "transition")
    }
    results["model"] = MX.metrics(rules.withColumn("pred", V.argmax(F.col("probability"))), K, ["partition"], "target_cluster_id", "pred")
    return tidy(CP.compare(results))


# --- strides -----------------------------------------------------------------------------

STRIDES = (5, 10, 15, 30)
STRIDE_SQL = f"""{LONG_SQL}, {S.pair()}, {S.parts()}, {S.soft()},
lp AS (SELECT *, {S.partition_case()} AS p, {S.NEAREST.format(p='t')} AS near FROM aligned),
le AS (SELECT lp.*, exp((ts[1] - t0) / tau) AS a0, exp((ts[1] - t1) / tau) AS a1, exp((ts[1] - t2) / tau) AS a2, ts[1] > lim AS outlier
  FROM lp CROSS JOIN tau LEFT JOIN lim ON class = near WHERE p IS NOT NULL),
fr AS (SELECT le.*, stride, a0 / (a0 + a1 + a2) AS m0, a1 / (a0 + a1 + a2) AS m1, a2 / (a0 + a1 + a2) AS m2 FROM le, (SELECT unnest({list(STRIDES)}) AS stride) WHERE input_start_index % stride = 0),
ft AS (SELECT * FROM fr WHERE p = 'train' AND NOT outlier)"""


def stride_table(spark, sf):
    """90-to-30 pairs per stride, with the temperature and limits of the 30-to-30 pairs."""
    short = T.with_order(I.pairs(spark, sf))
    train = stage(short.where("partition = 'train'").select("target_distances", "nearest_cluster_id", "nearest_distance"), "short_train")
    tau, limits = T.temperature(train, on_none="null"), T.class_limits(train, CLASSES, 99.0)
    long = splits.split_fixed(long_pairs(spark, sf), PERIODS)
    annotated = T.annotate(long, CLASSES, tau=tau, limits=limits)
    return stage(strides.stride_frames(annotated, STRIDES), "strides")


@case(
    "I23_stride_weights",
    f"""{STRIDE_SQL}, s AS (SELECT stride, count(*) AS n, sum(m0) AS s0, sum(m1) AS s1, sum(m2) AS s2 FROM ft GROUP BY 1)
    SELECT {b('stride')}, {b('c', 'cluster_id')}, {r('CASE c WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END', 'soft_class_mass')},
    {r('n / (3 * (CASE c WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END))', 'soft_class_weight')} FROM s, {S.classes()}""",
)
def stride_weights(spark, sf):
    frames = stride_table(spark, sf)
    return tidy(T.soft_class_weights(T.retained(frames), CLASSES, by=["stride"]))


@case(
    "I23_stride_metrics",
    f"""{STRIDE_SQL}, mj AS (SELECT stride, target_cluster_id AS maj FROM ft GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY stride ORDER BY count(*) DESC, target_cluster_id) = 1),
    tt AS (SELECT stride, input_cluster_id AS a, target_cluster_id AS nxt FROM ft GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY stride, input_cluster_id ORDER BY count(*) DESC, target_cluster_id) = 1),
    pr AS (SELECT stride, p, 'majority' AS rule, target_cluster_id AS actual, maj AS predicted FROM fr JOIN mj USING (stride)
      UNION ALL SELECT stride, p, 'persistence', target_cluster_id, input_cluster_id FROM fr
      UNION ALL SELECT fr.stride, p, 'transition', target_cluster_id, coalesce(nxt, maj) FROM fr JOIN mj USING (stride) LEFT JOIN tt ON tt.stride = fr.stride AND a = input_cluster_id),
    cells AS (SELECT stride, p, rule, {S.cells()} FROM pr GROUP BY 1, 2, 3)
    SELECT {b('stride')}, p AS "partition", rule, {', '.join(S.metric_columns())} FROM cells""",
)
def stride_metrics(spark, sf):
    frames = stride_table(spark, sf)
    ruled = strides.with_stride_baselines(frames, T.retained(frames), STRIDES, CLASSES)
    long = B.long_predictions(ruled, keys=("stride", "partition"))
    return tidy(MX.metrics(long, K, ["stride", "partition", "rule"]))


# --- fitted models -----------------------------------------------------------------------


def _with_features(spark, sf):
    run_table = stage(I.runs(spark, sf), "runs")
    features = I.describe(run_table).select("symbol", F.col("start_index").alias("input_start_index"), "features")
    annotated = I.soft_pairs(I.pairs(spark, sf))
    return stage(annotated.join(features, ["symbol", "input_start_index"]), "featured")


def _unfitted(rows, *flags):
    """The report of a model that cannot be fitted, as there are no training rows: samples, and null for what it would show."""
    unknown = [F.lit(None).cast("boolean").alias(c) for c in ("probabilities_ok", *flags)]
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("samples")).select("partition", "samples", *unknown)


def _beats_prior(rows, probability: str):
    """Does the fitted model have a lower training loss than the constant class shares."""
    train = rows.where("partition = 'train'")
    shares = train.agg(F.array(*[F.avg(F.col("target_soft")[i]) for i in range(K)]))
    held = train.withColumn("_prior", shares.scalar())
    fitted = MX.soft_scores(held, probability=probability)
    prior = MX.soft_scores(held, probability="_prior")
    return fitted.select((F.col("soft_cross_entropy") < prior.select("soft_cross_entropy").scalar()).alias("beats_prior"))


FITTED = f"""{PARTS} SELECT "partition", count(*) AS samples, true AS probabilities_ok FROM parts GROUP BY 1"""


def _mass_met(train, probability, mass, tolerance=1e-3):
    """Is the predicted mass of every class the class's own: the gradient of the undecayed offsets is zero at an optimum.

    It starts at about a half for the perceptron and at a tenth for linear models.
    """
    given = [F.sum(mass[i]) for i in range(K)]
    got = [F.sum(V.total(mass) * probability[i]) for i in range(K)]
    off = F.greatest(*[F.abs(a - b) for a, b in zip(given, got, strict=True)]) / sum(given[1:], given[0])
    return train.agg((off < tolerance).alias("class_mass_met"))


def _sound(predicted):
    ok = (F.abs(V.total(F.col("probability")) - 1.0) < 1e-9) & (F.array_min("probability") >= 0)
    return predicted.groupBy("partition").agg(F.count(F.lit(1)).alias("samples"), F.bool_and(ok).alias("probabilities_ok"))


@case("I10_soft_logistic", FITTED.replace("true AS probabilities_ok", "true AS probabilities_ok, true AS class_mass_met"))
def soft_logistic(spark, sf):
    rows = _with_features(spark, sf)
    train = T.retained(rows)
    if train.isEmpty():
        return _unfitted(rows, "class_mass_met")
    weights = stage(T.soft_class_weights(train, CLASSES), "weights")
    scored = ML.predict(ML.fit_soft_logistic(train, weights, CLASSES, "features"), rows, "features")
    met = _mass_met(RP.with_soft_mass(T.retained(scored), weights), F.col("probability"), F.col("mass"))
    return tidy(_sound(scored).withColumn("class_mass_met", met.scalar()))


@case("I10_soft_logistic_gain", "SELECT true AS beats_prior")
def soft_logistic_gain(spark, sf):
    rows = _with_features(spark, sf)
    train = T.retained(rows)
    if train.isEmpty():
        return spark.range(1).select(F.lit(None).cast("boolean").alias("beats_prior"))
    even = T.soft_class_weights(train, CLASSES).withColumn("soft_class_weight", F.lit(1.0))
    fitted = ML.fit_soft_logistic(train.withColumn("certainty_weight", F.lit(1.0)), even, CLASSES, "features", reg=0.0)
    return _beats_prior(T.retained(ML.predict(fitted, rows, "features")), "probability")


@case("I11_logistic", FITTED.replace("true AS probabilities_ok", "true AS probabilities_ok, true AS class_mass_met"))
def logistic(spark, sf):
    rows = _with_features(spark, sf)
    train = rows.where("partition = 'train'")
    if train.isEmpty():
        return _unfitted(rows, "class_mass_met")
    weights = stage(T.class_weights(train, CLASSES), "weights")
    scored = ML.predict(ML.fit_logistic(train, weights, CLASSES, "features"), rows, "features")
    held = with_lookup(scored.where("partition = 'train'"), weights, "cluster_id", "class_weight", CLASSES, "_w", "target_cluster_id")
    one = F.array(*[(F.col("target_cluster_id") == c).cast("double") * F.col("_w") for c in CLASSES])
    return tidy(_sound(scored).withColumn("class_mass_met", _mass_met(held, F.col("probability"), one).scalar()))


@case("I12_mlp", FITTED.replace("true AS probabilities_ok", "true AS probabilities_ok, true AS class_mass_met, true AS beats_linear"))
def mlp(spark, sf):
    """Row weights are exact; near an optimum the predicted mass of each class is the class's, whatever the layers."""
    rows = _with_features(spark, sf)
    if rows.where("partition = 'train'").isEmpty():
        return _unfitted(rows, "class_mass_met", "beats_linear")
    weights = T.class_weights(rows.where("partition = 'train'"), CLASSES)
    one = F.transform(F.array(*[F.lit(c) for c in CLASSES]), lambda c: (c == F.col("target_cluster_id")).cast("double") * F.col("_w"))
    held = with_lookup(rows, weights, "cluster_id", "class_weight", CLASSES, "_cw", "target_cluster_id").withColumn("_w", F.col("_cw") * F.col("certainty_weight"))
    scaler = stage(ML.fit_standardizer(rows.where("partition = 'train'"), "features", 2), "standardizer")
    ready = stage(ML.standardize(held.withColumn("mass", one), "features", scaler), "weighted")
    nets = [Network("linear", "standardized", "mass", 2, K), Network("mlp", "standardized", "mass", 2, K, (256, 64), seed=42)]
    fitted = fit_networks(ready, nets, "partition = 'train'", steps=80, tolerance=1e-4)
    scored = stage(predict_networks(ready, fitted), "perceptron")
    train = scored.where("partition = 'train'")
    loss = [F.sum(-V.dot(F.col("mass"), F.transform(F.col("probabilities")[m], lambda p: F.ln(F.greatest(p, F.lit(V.TINY)))))) for m in (0, 1)]
    better = train.agg((loss[1] < loss[0]).alias("b")).scalar()
    made = _sound(scored.withColumn("probability", F.col("probabilities")[1]))
    return made.withColumn("class_mass_met", _mass_met(train, F.col("probabilities")[1], F.col("mass"), 0.05).scalar()).withColumn("beats_linear", better)


@case("I23_stride_models")
def stride_models(spark, sf):
    """Linear models and perceptrons of every stride and seed in one fit; blocks of twice the span of a sample.

    A stride without training rows has no model and no row.
    """
    frames = stride_table(spark, sf)
    run_table = stage(I.runs(spark, sf), "runs")
    features = I.describe(run_table, 90).select("symbol", F.col("start_index").alias("input_start_index"), "features")
    rows = stage(_ranked(frames).join(features, ["symbol", "input_start_index"]), "ranked")
    trained = sorted(r.stride for r in T.retained(rows).select("stride").distinct().collect())  # at most one row per stride
    weights = T.soft_class_weights(T.retained(rows), CLASSES, by=["stride"])
    held = weights.groupBy("stride").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "soft_class_weight"))).alias("_w"))
    mass = F.zip_with("target_soft", "_w", lambda t, w: t * w["soft_class_weight"] * F.col("certainty_weight"))
    rows = rows.join(F.broadcast(held), "stride").withColumn("mass", mass)  # one row per stride
    rows = stage(rows.withColumns({f"mass_{s}": F.when(F.col("stride") == s, F.col("mass")) for s in STRIDES}), "stride_rows")
    nets = RP.grid({str(s): ("features", f"mass_{s}", 2) for s in trained or STRIDES}, CLASSES)
    scored = RP.fit_and_predict(rows, nets)[1] if trained else RP.unfitted(rows)
    parts = [RP.compare_kinds(scored.where(F.col("stride") == s), nets, str(s), K, BB.block_length(90, N, s), start_expr=formula) for s in trained or STRIDES]
    return tidy(RP.union(parts))


def _ranked(frames):
    """Time order inside each stride and partition."""
    keyed = frames.withColumn("_frame", F.concat_ws("/", F.col("stride"), "partition"))
    return with_rank(keyed, partition="_frame", tiebreak=("symbol", "input_start_index"), out="position").drop("_frame")


@case("I24_numeric_controls")
def numeric_controls(spark, sf):
    """Shape features alone, then shape and scale: five seeds of a linear model and a perceptron each, fitted together.

    Without training rows there is no model and no row.
    """
    run_table = stage(I.runs(spark, sf), "runs")
    shapes = W.shape_features(W.window_arrays(run_table, N)).select("symbol", "start_index", "shape")
    scales = W.scale_features(run_table, N).select(
        "symbol", "start_index", F.array("log_return", "volatility", "mean_abs_return", "range_ratio").alias("scale")
    )
    features = shapes.join(scales, ["symbol", "start_index"]).withColumnRenamed("start_index", "input_start_index")
    rows = I.soft_pairs(I.pairs(spark, sf)).join(features, ["symbol", "input_start_index"])
    rows = stage(rows.withColumn("both", F.concat("shape", "scale")), "controls")
    train = T.retained(rows)
    groups = {"shape": ("shape_z", "mass", 4 * N), "shape+scale": ("both_z", "mass", 4 * N + 4)}
    nets = RP.grid(groups, CLASSES)
    if train.isEmpty():
        none = RP.unfitted(rows.withColumnRenamed("chronological_rank", "position"))
        return tidy(RP.union([RP.compare_kinds(none, nets, group, K, LENGTH, start_expr=formula) for group in groups]))
    ready = RP.with_soft_mass(rows, T.soft_class_weights(train, CLASSES))
    for column, (out, _, width) in zip(("shape", "both"), groups.values(), strict=True):
        ready = ML.standardize(ready, column, stage(ML.fit_standardizer(train, column, width), "standardizer"), out)
    _, scored = RP.fit_and_predict(stage(ready.withColumnRenamed("chronological_rank", "position"), "controls"), nets)
    return tidy(RP.union([RP.compare_kinds(scored, nets, group, K, LENGTH, start_expr=formula) for group in groups]))
