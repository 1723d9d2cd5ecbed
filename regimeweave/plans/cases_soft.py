"""Queries for soft targets and the geometric confidence filter, each with its check statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimeweave.operators import geometry as G
from regimeweave.operators import soft_targets as T
from regimeweave.operators.quantiles import exact_quantile
from regimeweave.operators.regimes import flat
from regimeweave.plans import inputs as I
from regimeweave.plans import sql_parts as S
from regimeweave.plans.inputs import CENTERS, CLASSES, K, tidy
from regimeweave.plans.sql_parts import b, r
from regimeweave.session import stage

QUERIES, SQL = {}, {}
SOFT = S.base()
FLOOR = 0.10


def case(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def annotated(spark, sf):
    """Pairs with soft targets; none where training rows give no temperature."""
    return I.soft_pairs(I.pairs(spark, sf)).where("temperature is not null")


def train_of(pairs):
    return T.with_order(pairs).where("partition = 'train'")


# --- soft targets ------------------------------------------------------------------------

TIE = """tie AS (SELECT *, CASE input_cluster_id WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END AS own FROM ord)"""


@case(
    "F1_near_tie_audit",
    f"""{SOFT}, {TIE} SELECT pair_id, input_cluster_id = near AS source_hard_label_matches_recorded_nearest,
    input_cluster_id <> near AS source_hard_label_near_tie_disagreement, {r('own', 'source_hard_label_distance')}, {r('own - n1', 'source_hard_label_distance_gap')},
    {r('100.0 * (own - n1) / greatest(n1, 1e-12)', 'source_hard_label_distance_gap_percent')},
    input_cluster_id <> near AND own - n1 > 0.01 + 0.5 * greatest(n1, 1e-12) AS material_disagreement FROM tie""",
)
def near_tie_audit(spark, sf):
    rows = T.near_tie_audit(I.pairs(spark, sf), label="input_cluster_id", absolute=0.01, relative=0.5)
    return tidy(
        rows.select(
            "pair_id", "source_hard_label_matches_recorded_nearest", "source_hard_label_near_tie_disagreement",
            "source_hard_label_distance", "source_hard_label_distance_gap", "source_hard_label_distance_gap_percent",
            "material_disagreement",
        )
    )


@case("F2_temperature", f"{SOFT} SELECT {r('tau', 'temperature')} FROM tau")
def temperature(spark, sf):
    return tidy(T.temperature(train_of(I.pairs(spark, sf)), on_none="null"))


@case(
    "F2_embedding_gap_quantiles",
    """WITH em AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT CAST(label AS BIGINT) AS label, round(quantile_cont(v[1], 0.9), 6) + 0.0 AS q FROM em GROUP BY 1""",
)
def embedding_quantiles(spark, sf):
    rows = I.table(spark, sf, "embeddings")
    return tidy(exact_quantile(rows, F.col("embedding")[0], 0.9, "label", range(10), "q"))


@case(
    "F2_event_value_quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.99), 6) + 0.0 AS q FROM events GROUP BY 1""",
)
def event_quantiles(spark, sf):
    rows = I.table(spark, sf, "events")
    return tidy(exact_quantile(rows, "value", 0.99, "event_type", ["click", "error", "purchase", "signup", "view"], "q"))


@case("F3_class_limits", f"{SOFT} SELECT {b('class', 'nearest_cluster_id')}, {r('lim', 'distance_limit')} FROM lim")
def class_limits(spark, sf):
    return tidy(T.class_limits(train_of(I.pairs(spark, sf)), CLASSES, 99.0))


@case(
    "F4_F5_memberships",
    f"""{SOFT} SELECT pair_id, {r('m0', 'soft_0')}, {r('m1', 'soft_1')}, {r('m2', 'soft_2')}, {r('entropy', 'soft_target_entropy')},
    {r('nent', 'soft_target_normalized_entropy')}, {r('cert', 'soft_target_certainty')}, {r('cw', 'certainty_weight')}, {r('tau', 'temperature')} FROM ann""",
)
def memberships(spark, sf):
    rows = annotated(spark, sf)
    return tidy(
        rows.select(
            "pair_id", *flat(rows, "target_soft", "soft_", K), "soft_target_entropy", "soft_target_normalized_entropy",
            "soft_target_certainty", "certainty_weight", "temperature",
        )
    )


@case(
    "F6_distance_order",
    f"""{SOFT} SELECT pair_id, {b('near', 'nearest_cluster_id')}, {r('n1', 'nearest_distance')}, {r('n2', 'second_nearest_distance_recomputed')},
    {r('n3', 'third_nearest_distance')}, {r('gap', 'nearest_second_gap')}, {r('100.0 * gap / greatest(n1, 1e-12)', 'nearest_second_gap_percent')},
    {r('100.0 * (n3 - n1) / greatest(n1, 1e-12)', 'nearest_third_gap_percent')}, {b('3 - near - far', 'second_nearest_cluster_id')}, {b('far', 'third_nearest_cluster_id')}
    FROM (SELECT *, CASE WHEN t2 = n3 THEN 2 WHEN t1 = n3 THEN 1 ELSE 0 END AS far FROM ord)""",
)
def distance_order(spark, sf):
    rows = T.with_order(I.pairs(spark, sf))
    return tidy(
        rows.select(
            "pair_id", "nearest_cluster_id", "second_nearest_cluster_id", "third_nearest_cluster_id", "nearest_distance",
            "second_nearest_distance_recomputed", "third_nearest_distance", "nearest_second_gap", "nearest_second_gap_percent",
            "nearest_third_gap_percent",
        )
    )


@case(
    "F7_outliers",
    f"""{SOFT} SELECT pair_id, {r('lim', 'cluster_outlier_distance_limit')}, outlier AS is_training_distance_outlier, NOT outlier AS training_eligible,
    CASE WHEN outlier THEN 'cluster_membership_distance_outlier' ELSE 'retained' END AS exclusion_reason FROM ann""",
)
def outliers(spark, sf):
    rows = I.soft_pairs(I.pairs(spark, sf))
    return tidy(
        rows.select("pair_id", "cluster_outlier_distance_limit", "is_training_distance_outlier", "training_eligible", "exclusion_reason")
    )


WEIGHTS = """sw AS (SELECT c, CASE c WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS mass, n FROM
  (SELECT sum(m0) AS m0, sum(m1) AS m1, sum(m2) AS m2, count(*) AS n FROM kept), (SELECT unnest(range(3)) AS c))"""


@case(
    "F8_soft_class_weights",
    f"{SOFT}, {WEIGHTS} SELECT {b('c', 'cluster_id')}, {r('mass', 'soft_class_mass')}, {r('n / (3 * mass)', 'soft_class_weight')} FROM sw",
)
def soft_class_weights(spark, sf):
    return tidy(T.soft_class_weights(T.retained(annotated(spark, sf)), CLASSES, on_none="null"))


@case(
    "F9_class_weights",
    f"""{S.base(upto='parts')} SELECT {b('target_cluster_id', 'cluster_id')}, count(*) AS count, {r('sum(count(*)) OVER () / (3 * count(*))', 'class_weight')}
    FROM parts WHERE "partition" = 'train' GROUP BY target_cluster_id""",
)
def class_weights(spark, sf):
    return tidy(T.class_weights(I.pairs(spark, sf).where("partition = 'train'"), CLASSES, on_zero="drop"))


@case(
    "F9_class_weights_floor",
    """WITH c AS (SELECT k, count(vec_id) AS n FROM (SELECT unnest(range(12)) AS k) LEFT JOIN embeddings ON label = k GROUP BY 1)
    SELECT CAST(k AS BIGINT) AS cluster_id, n AS count, round(sum(n) OVER () / (12.0 * greatest(n, 1)), 6) + 0.0 AS class_weight FROM c""",
)
def class_weights_floor(spark, sf):
    return tidy(T.class_weights(I.table(spark, sf, "embeddings"), range(12), "label", on_zero="floor"))


@case(
    "F10_mass_report",
    f"""{SOFT}, a AS (SELECT "partition", count(*) AS n, sum(m0) AS s0, sum(m1) AS s1, sum(m2) AS s2 FROM ann GROUP BY 1),
    h AS (SELECT "partition", c, count(*) FILTER (WHERE target_cluster_id = c) AS h, count(*) FILTER (WHERE near = c) AS g FROM ann, {S.classes()} GROUP BY 1, 2)
    SELECT a."partition", {b('c', 'cluster_id')}, h AS hard_count, {r('100.0 * h / n', 'hard_percentage')}, g AS nearest_count, {r('100.0 * g / n', 'nearest_percentage')},
    {r('CASE c WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END', 'soft_membership_mass')},
    {r('100.0 * (CASE c WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END) / (s0 + s1 + s2)', 'soft_mass_percentage')}, n AS rows FROM a JOIN h USING ("partition")""",
)
def mass_report(spark, sf):
    return tidy(T.mass_report(annotated(spark, sf), CLASSES))


@case(
    "F11_uncertainty",
    f"""{SOFT} SELECT "partition", count(*) AS rows, {r('avg(mmax)', 'mean_max_membership')}, {r('median(mmax)', 'median_max_membership')},
    {r('avg(nent)', 'mean_normalized_entropy')}, {r('median(nent)', 'median_normalized_entropy')}, count(*) FILTER (WHERE mmax <= 0.4) AS near_uniform_rows,
    count(*) FILTER (WHERE outlier) AS training_distance_outliers FROM ann GROUP BY 1""",
)
def uncertainty(spark, sf):
    return tidy(T.uncertainty_report(stage(annotated(spark, sf), "annotated"), list(I.PERIODS)))


@case(
    "F12_near_tie_rows",
    f"""{SOFT}, {TIE} SELECT "partition" AS source_partition, pair_id, {b('input_cluster_id', 'target_cluster_id')}, {b('near', 'nearest_cluster_id')},
    {r('t0', 'target_distance_cluster_0')}, {r('t1', 'target_distance_cluster_1')}, {r('t2', 'target_distance_cluster_2')}, {r('own', 'source_hard_label_distance')},
    {r('own - n1', 'source_hard_label_distance_gap')}, {r('100.0 * (own - n1) / greatest(n1, 1e-12)', 'source_hard_label_distance_gap_percent')}
    FROM tie WHERE input_cluster_id <> near""",
)
def near_tie_rows(spark, sf):
    rows = I.pairs(spark, sf).withColumn("target_cluster_id", F.col("input_cluster_id"))
    return tidy(T.near_tie_rows(T.with_order(T.near_tie_audit(rows))))


@case(
    "F13_check_weights",
    f"""{SOFT}, {WEIGHTS} SELECT {b('c', 'cluster_id')}, {r('n / (3 * mass)', 'soft_class_weight')}, c <> 1 AS agrees FROM sw""",
)
def check_weights(spark, sf):
    kept = stage(T.retained(annotated(spark, sf)), "retained")
    saved = T.soft_class_weights(kept, CLASSES, on_none="null")
    off = F.coalesce(F.col("soft_class_weight"), F.lit(1.0)) * 1.01  # differs from the weight, and from no weight
    bent = saved.withColumn("soft_class_weight", F.when(F.col("cluster_id") == 1, off).otherwise(F.col("soft_class_weight")))
    return tidy(T.check_weights(bent, kept, CLASSES, on_none="null").select("cluster_id", "soft_class_weight", "agrees"))


@case(
    "F14_soft_violations",
    f"""{SOFT} SELECT pair_id, chronological_rank % 9 = 0 AS sum_violation,
    CASE WHEN chronological_rank % 9 = 0 THEN (CASE WHEN m0 + 0.5 >= m1 AND m0 + 0.5 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END) <> near ELSE false END AS argmax_violation,
    chronological_rank % 9 = 0 AS recompute_violation FROM ann""",
)
def soft_violations(spark, sf):
    rows = annotated(spark, sf)
    bent = F.transform("target_soft", lambda m, i: F.when((F.col("chronological_rank") % 9 == 0) & (i == 0), m + 0.5).otherwise(m))
    return T.soft_violations(rows.withColumn("target_soft", bent)).select(
        "pair_id", "sum_violation", "argmax_violation", "recompute_violation"
    )


# --- geometric confidence ----------------------------------------------------------------


def _gap(i: int, j: int) -> str:
    (a, c), (d, e) = CENTERS[i], CENTERS[j]
    return repr(((a - d) ** 2 + (c - e) ** 2) ** 0.5)


def _q(j: int) -> str:
    grid = " ".join(f"WHEN near = {i} THEN {_gap(i, j)}" for i in range(3) if i != j)
    return f"CASE WHEN near <> {j} THEN least(greatest((t{j} - n1) / (CASE {grid} END), 0), 1) END AS q{j}"


GEO = f"""{SOFT}, geo AS (SELECT *, least(q0, q1, q2) AS conf FROM (SELECT *, {_q(0)}, {_q(1)}, {_q(2)} FROM ord)),
glim AS (SELECT target_cluster_id AS class, quantile_cont(n1, 0.95) AS glim FROM geo WHERE "partition" = 'train' GROUP BY 1),
chk AS (SELECT *, conf >= 0.3 AS apart, n1 <= glim AS inside FROM geo JOIN glim ON class = target_cluster_id)"""
THRESHOLD = 0.3


def confident(spark, sf):
    return G.with_confidence(I.pairs(spark, sf), I.frozen(spark))


def checked(spark, sf):
    rows = stage(confident(spark, sf), "confidence")
    limits = G.membership_limits(rows.where("partition = 'train'"), CLASSES, 95.0)
    return G.apply_rules(rows, THRESHOLD, limits, CLASSES)


@case(
    "G1_geometric_confidence",
    f"""{GEO} SELECT pair_id, {r('conf', 'geometric_confidence')}, {r('greatest(q0, q1, q2)', 'largest')} FROM geo""",
)
def geometric_confidence(spark, sf):
    rows = confident(spark, sf)
    return tidy(rows.select("pair_id", "geometric_confidence", F.greatest("confidence_vs_second", "confidence_vs_third").alias("largest")))


@case("G2_membership_limits", f"{GEO} SELECT {b('class', 'target_cluster_id')}, {r('glim', 'distance_limit')} FROM glim")
def membership_limits(spark, sf):
    rows = confident(spark, sf).where("partition = 'train'")
    return tidy(G.membership_limits(rows, CLASSES, 95.0))


@case(
    "G3_acceptance_rules",
    f"""{GEO} SELECT pair_id, apart AS passes_centroid_separation, inside AS passes_cluster_membership, apart AND inside AS confidence_accepted,
    CASE WHEN apart AND inside THEN 'accepted' WHEN inside THEN 'insufficient_centroid_separation' WHEN apart THEN 'cluster_membership_outlier'
    ELSE 'insufficient_centroid_separation_and_membership_outlier' END AS rejection_reason FROM chk""",
)
def acceptance_rules(spark, sf):
    return checked(spark, sf).select(
        "pair_id", "passes_centroid_separation", "passes_cluster_membership", "confidence_accepted", "rejection_reason"
    )


BALANCE = f"""{GEO}, acc AS (SELECT * FROM chk WHERE apart AND inside AND "partition" = 'train'),
num AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY class) AS n, (SELECT min(c) FROM (SELECT count(*) AS c FROM acc GROUP BY class)) AS m
  FROM acc WINDOW w AS (PARTITION BY class ORDER BY chronological_rank, pair_id)),
seg AS (SELECT *, CASE WHEN i < (n % m) * (n // m + 1) THEN i // (n // m + 1) ELSE (n % m) + (i - (n % m) * (n // m + 1)) // (n // m) END AS s FROM num),
bal AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY class, s ORDER BY conf DESC, chronological_rank, pair_id) = 1)"""


def accepted_train(spark, sf):
    return stage(checked(spark, sf).where("confidence_accepted and partition = 'train'"), "accepted")


@case("G4_temporal_balance", f"{BALANCE} SELECT pair_id, {b('class', 'target_cluster_id')}, {b('chronological_rank')}, {r('conf', 'geometric_confidence')} FROM bal")
def temporal_balance(spark, sf):
    rows = G.temporal_balance(accepted_train(spark, sf), CLASSES)
    return tidy(rows.select("pair_id", "target_cluster_id", "chronological_rank", "geometric_confidence"))


@case(
    "G5_balance_excluded",
    f"""{BALANCE} SELECT pair_id, 'confident_sample_not_selected_by_temporal_spread_undersampling' AS balance_exclusion_reason
    FROM acc ANTI JOIN bal USING (pair_id)""",
)
def balance_excluded(spark, sf):
    accepted = accepted_train(spark, sf)
    return G.balance_excluded(accepted, G.temporal_balance(accepted, CLASSES)).select("pair_id", "balance_exclusion_reason")


@case(
    "G6_stage_counts",
    f"""{GEO}, st AS (SELECT 'original' AS stage, "partition", target_cluster_id AS y FROM chk UNION ALL
      SELECT 'accepted', "partition", target_cluster_id FROM chk WHERE apart AND inside),
    g AS (SELECT DISTINCT stage, "partition", c FROM st, {S.classes()}), n AS (SELECT g.*, count(y) AS n FROM g LEFT JOIN st ON st.stage = g.stage AND st."partition" = g."partition" AND y = c GROUP BY ALL)
    SELECT stage, "partition", {b('c', 'cluster_id')}, n AS count, {b('sum(n) OVER (PARTITION BY stage, "partition")', 'total_rows')},
    {r('100.0 * n / sum(n) OVER (PARTITION BY stage, "partition")', 'percentage')} FROM n""",
)
def stage_counts(spark, sf):
    rows = stage(checked(spark, sf), "checked")
    return tidy(G.stage_counts({"original": rows, "accepted": rows.where("confidence_accepted")}, CLASSES))


@case(
    "G7_threshold_sweep",
    f"""{GEO}, th AS (SELECT unnest({list(G.SWEEP)}) AS t), g AS (SELECT t, "partition" AS p, c FROM th, (SELECT DISTINCT "partition" FROM chk WHERE "partition" <> 'test'), {S.classes()}),
    n AS (SELECT t, p, c, count(pair_id) AS o, count(*) FILTER (WHERE inside AND conf >= t) AS a FROM g LEFT JOIN chk ON "partition" = p AND target_cluster_id = c GROUP BY 1, 2, 3)
    SELECT {r('t', 'threshold')}, p AS "partition", {b('c', 'cluster_id')}, o AS original_count, a AS accepted_count, {r('100.0 * a / greatest(o, 1)', 'cluster_coverage_percent')},
    {b('sum(a) OVER (PARTITION BY t, p)', 'partition_accepted_total')}, {r('100.0 * sum(a) OVER (PARTITION BY t, p) / sum(o) OVER (PARTITION BY t, p)', 'partition_coverage_percent')} FROM n""",
)
def threshold_sweep(spark, sf):
    rows = stage(confident(spark, sf), "confidence")
    limits = G.membership_limits(rows.where("partition = 'train'"), CLASSES, 95.0)
    return tidy(G.threshold_sweep(rows, limits, CLASSES))


@case(
    "G8_rejections",
    f"""{GEO}, x AS (SELECT "partition", CASE WHEN apart AND inside THEN 'accepted' WHEN inside THEN 'insufficient_centroid_separation'
      WHEN apart THEN 'cluster_membership_outlier' ELSE 'insufficient_centroid_separation_and_membership_outlier' END AS rejection_reason FROM chk),
    n AS (SELECT "partition", rejection_reason, count(*) AS count FROM x GROUP BY 1, 2), z AS (SELECT *, 100.0 * count / sum(count) OVER (PARTITION BY "partition") AS pc FROM n)
    SELECT "partition", rejection_reason, count, {r('pc', 'percentage_of_partition')} FROM z WHERE rejection_reason <> 'accepted'""",
)
def rejections(spark, sf):
    return tidy(G.rejection_report(checked(spark, sf)))


@case(
    "G9_accepted_weights",
    f"""{BALANCE} SELECT {b('class', 'cluster_id')}, count(*) AS count, {r('sum(count(*)) OVER () / (3.0 * count(*))', 'class_weight')} FROM acc GROUP BY class""",
)
def accepted_weights(spark, sf):
    return tidy(T.class_weights(accepted_train(spark, sf), CLASSES, on_zero="drop"))
