"""Queries for regime discovery, assignment and cluster quality, each with its check statement."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.operators import cluster_metrics as M
from regimeweave.operators import discovery as D
from regimeweave.operators import regimes as R
from regimeweave.plans import inputs as I
from regimeweave.plans import sql_parts as S
from regimeweave.plans.inputs import CLASSES, tidy
from regimeweave.plans.sql_parts import b, r

QUERIES, SQL = {}, {}
DIM = 64
LABELS = tuple(range(10))
COMPONENTS = 8


def case(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# a frozen orthonormal projection that both engines can compute: the first cosine waves
WAVES = [
    [math.cos(math.pi * (i + 0.5) * (j + 1) / DIM) * math.sqrt(2.0 / DIM) for i in range(DIM)] for j in range(COMPONENTS)
]

EM = "em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
UNIT = "unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM em)"


def means(source: str = "em", name: str = "means", dim: int = DIM) -> str:
    return f"""{name} AS (SELECT label, list(m ORDER BY i) AS c FROM (
      SELECT label, i, avg(v[i]) AS m FROM {source}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY 1, 2) GROUP BY 1)"""


DIST = f"""{means()}, dist AS (SELECT vec_id, label, v,
  list_distance(v, (SELECT c FROM means WHERE label = 0)) AS d0, list_distance(v, (SELECT c FROM means WHERE label = 1)) AS d1,
  list_distance(v, (SELECT c FROM means WHERE label = 2)) AS d2 FROM em),
lab AS (SELECT *, {S.NEAREST.format(p='d')} AS cluster_id, list_sort([d0, d1, d2]) AS ds FROM dist)"""


def wave_sql() -> str:
    return f"""avgs AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(v[i]) AS m FROM unit, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY 1)),
waves AS (SELECT j, list(cos(pi() * (i - 0.5) * (j + 1) / {DIM}) * sqrt(2.0 / {DIM}) ORDER BY i) AS w
  FROM (SELECT unnest(range(0, {COMPONENTS})) AS j), (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY 1),
red AS (SELECT vec_id, label, list(list_dot_product(v, w) - list_dot_product(mean, w) ORDER BY j) AS v FROM unit, waves, avgs GROUP BY ALL)"""


def embeddings(spark, sf):
    return I.table(spark, sf, "embeddings")


def frozen_means(spark, sf, classes=CLASSES):
    return R.mean_vectors(embeddings(spark, sf), "embedding", "label", DIM, classes)


def unit_rows(spark, sf):
    return embeddings(spark, sf).select("vec_id", "label", V.l2_normalize(F.col("embedding")).alias("v"))


def frozen_waves(spark, sf):
    """One-row PCA table: mean of the unit vectors, cosine components."""
    waves = F.array(*[F.array(*[F.lit(x) for x in w]) for w in WAVES])
    mean = unit_rows(spark, sf).agg(F.array(*[F.avg(F.col("v")[i]) for i in range(DIM)]).alias("mean"))
    return mean.select("mean", waves.alias("components"))


def assigned(spark, sf):
    return R.assign(embeddings(spark, sf), "embedding", frozen_means(spark, sf))


@case("E1_l2_normalize", f"WITH {EM}, {UNIT} SELECT vec_id, {b('i', 'position')}, {r('v[i + 1]', 'value')} FROM unit, (SELECT unnest(range(0, {DIM})) AS i)")
def l2_normalize(spark, sf):
    return tidy(unit_rows(spark, sf).select("vec_id", F.posexplode("v").alias("position", "value")))


@case(
    "E2_fit_pca",
    f"""WITH {EM}, x AS (SELECT i, var_pop(v[i]) AS s FROM em, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY 1)
    SELECT {b(str(DIM), 'components')}, CAST(1 AS DOUBLE) AS explained, {r('sum(s)', 'score_variance')}, true AS decreasing FROM x""",
)
def fit_pca(spark, sf):
    rows = embeddings(spark, sf)
    pca = D.fit_pca(rows, "embedding", DIM, DIM)
    reduced = R.apply_pca(rows, "embedding", pca)
    spread = reduced.agg(
        V.total(F.array(*[F.var_pop(F.col("reduced")[i]) for i in range(DIM)])).alias("score_variance"),
        *[F.var_pop(F.col("reduced")[i]).alias(f"_v{i}") for i in (0, DIM // 2, DIM - 1)],
    )
    held = spread.withColumn("_p", pca.select(F.struct(F.size("components").alias("n"), V.total(F.col("explained")).alias("e"))).scalar())
    falling = (F.col("_v0") >= F.col(f"_v{DIM // 2}")) & (F.col(f"_v{DIM // 2}") >= F.col(f"_v{DIM - 1}"))
    return tidy(held.select(F.col("_p.n").alias("components"), F.col("_p.e").alias("explained"), "score_variance", falling.alias("decreasing")))


@case("E3_apply_pca", f"WITH {EM}, {UNIT}, {wave_sql()} SELECT vec_id, {b('i', 'component')}, {r('v[i + 1]', 'value')} FROM red, (SELECT unnest(range(0, {COMPONENTS})) AS i)")
def apply_pca(spark, sf):
    reduced = R.apply_pca(unit_rows(spark, sf), "v", frozen_waves(spark, sf))
    return tidy(reduced.select("vec_id", F.posexplode("reduced").alias("component", "value")))


@case(
    "E4_fit_kmeans",
    "SELECT count(*) AS rows, CAST(4 AS BIGINT) AS clusters, true AS centers_are_means, true AS better_than_one_cluster FROM embeddings",
)
def fit_kmeans(spark, sf):
    rows = embeddings(spark, sf)
    labelled = R.assign(rows, "embedding", D.fit_kmeans(rows, "embedding", 4, tol=1e-9)).drop("label")
    labelled = labelled.withColumnRenamed("cluster_id", "label")
    means_now = R.mean_vectors(labelled, "embedding", "label", DIM, range(4))
    again = R.assign(labelled.select("vec_id", "embedding", "label", F.col("distance_to_centroid").alias("d")), "embedding", means_now)
    one = R.mean_vectors(rows.withColumn("one", F.lit(0)), "embedding", "one", DIM, [0])
    alone = R.with_distances(rows, "embedding", one, "whole").agg(F.sum(F.col("whole")[0] * F.col("whole")[0]))
    facts = again.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("label").alias("clusters"),
        (F.max(F.abs(F.col("d") - F.col("distances")[F.col("label")])) < 1e-3).alias("centers_are_means"),
        F.sum(F.col("d") * F.col("d")).alias("_cost"),
    )
    return facts.withColumn("better_than_one_cluster", F.col("_cost") < alone.scalar()).drop("_cost")


@case(
    "E5_E6_E7_assign",
    f"""WITH {EM}, {DIST} SELECT vec_id, {r('d0')}, {r('d1')}, {r('d2')}, {b('cluster_id')}, {r('ds[1]', 'distance_to_centroid')},
    {r('ds[2]', 'second_nearest_distance')}, {r('ds[2] - ds[1]', 'distance_margin')}, {r('(ds[2] - ds[1]) / greatest(ds[2], 1e-12)', 'relative_distance_margin')},
    {b('CASE WHEN ds[3] = d0 THEN 0 WHEN ds[3] = d1 THEN 1 ELSE 2 END', 'farthest')} FROM lab""",
)
def assign(spark, sf):
    rows = assigned(spark, sf)
    return tidy(
        rows.select(
            "vec_id", *R.flat(rows, "distances", "d", 3), "cluster_id", "distance_to_centroid", "second_nearest_distance",
            "distance_margin", "relative_distance_margin", F.col("nearest_cluster_order")[2].alias("farthest"),
        )
    )


@case(
    "E6_window_labels",
    f"""{S.base(True, 'lab')} SELECT symbol, {b('start_index')}, {b('cluster_id')}, {r('ds[1]', 'distance_to_centroid')},
    {r('(ds[2] - ds[1]) / greatest(ds[2], 1e-12)', 'relative_distance_margin')} FROM lab""",
)
def window_labels(spark, sf):
    return tidy(I.labelled(spark, sf, True).select("symbol", "start_index", "cluster_id", "distance_to_centroid", "relative_distance_margin"))


@case("E8_inertia", f"WITH {EM}, {DIST} SELECT {r('sum(ds[1] * ds[1])', 'inertia')} FROM lab")
def inertia(spark, sf):
    return tidy(M.inertia(assigned(spark, sf)))


RANK = "(vec_id * 7919 + 42) % 1000003"


@case(
    "E9_silhouette",
    f"""WITH {EM}, smp AS (SELECT * FROM em ORDER BY {RANK}, vec_id LIMIT 5000),
    pd AS (SELECT x.vec_id, x.label AS own, y.label AS other, sum(list_distance(x.v, y.v)) AS s, count(*) AS n FROM smp x, smp y GROUP BY 1, 2, 3),
    ab AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a,
      min(CASE WHEN own <> other THEN s / n END) AS z FROM pd GROUP BY 1)
    SELECT {b('count(*)', 'sampled')}, {r('avg(CASE WHEN n = 1 THEN 0 ELSE (z - a) / greatest(a, z) END)', 'silhouette')} FROM ab""",
)
def silhouette(spark, sf):
    return tidy(M.sampled_silhouette(embeddings(spark, sf), "embedding", "label", "vec_id", 5000, rank_expr=F.expr(RANK)))


@case(
    "E9_squared_silhouette",
    f"""WITH {EM}, sq AS (SELECT x.vec_id, x.label AS own, y.label AS other, sum(list_distance(x.v, y.v) ** 2) AS s, count(*) AS n
      FROM em x, em y WHERE x.label IS NOT NULL AND y.label IS NOT NULL GROUP BY 1, 2, 3),
    ab AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a,
      min(CASE WHEN own <> other THEN s / n END) AS z FROM sq GROUP BY 1)
    SELECT {b('count(*)', 'rows')}, (SELECT count(*) FROM em WHERE label IS NULL) AS unlabelled,
    {r('avg(CASE WHEN n = 1 THEN 0 ELSE (z - a) / greatest(a, z) END)', 'silhouette')} FROM ab""",
)
def squared_silhouette(spark, sf):
    return tidy(M.silhouette(embeddings(spark, sf), "embedding", "label", LABELS))


@case(
    "E10_davies_bouldin",
    f"""WITH {EM}, {means()}, s AS (SELECT label, c, avg(list_distance(v, c)) AS s FROM em JOIN means USING (label) GROUP BY ALL)
    SELECT {r('avg(w)', 'davies_bouldin')} FROM (SELECT x.label, max((x.s + y.s) / list_distance(x.c, y.c)) AS w FROM s x JOIN s y ON x.label <> y.label GROUP BY 1)""",
)
def davies_bouldin(spark, sf):
    return tidy(M.davies_bouldin(embeddings(spark, sf), "embedding", "label", DIM, LABELS))


@case(
    "E11_calinski_harabasz",
    f"""WITH {EM}, {means()}, {means('(SELECT 0 AS label, v FROM em)', 'grand')},
    s AS (SELECT label, m.c, count(*) AS n, sum(list_distance(v, m.c) ** 2) AS w FROM em JOIN means m USING (label) GROUP BY ALL)
    SELECT {r('(sum(n * list_distance(s.c, g.c) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*)))', 'calinski_harabasz')} FROM s, grand g""",
)
def calinski_harabasz(spark, sf):
    return tidy(M.calinski_harabasz(embeddings(spark, sf), "embedding", "label", DIM, LABELS))


def rand_sql(a: str, z: str, source: str) -> str:
    pairs = lambda x: f"sum({x} * ({x} - 1) / 2)"
    return f"""(SELECT (ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)) FROM
      (SELECT {pairs('c')} AS ij FROM (SELECT count(*)::DOUBLE AS c FROM {source} GROUP BY {a}, {z})),
      (SELECT {pairs('c')} AS i FROM (SELECT count(*)::DOUBLE AS c FROM {source} GROUP BY {a})),
      (SELECT {pairs('c')} AS j FROM (SELECT count(*)::DOUBLE AS c FROM {source} GROUP BY {z})), (SELECT count(*)::DOUBLE AS n FROM {source}))"""


@case("E12_adjusted_rand", f"WITH {EM}, {DIST} SELECT {r(rand_sql('label', 'cluster_id', 'lab'), 'adjusted_rand')}")
def adjusted_rand(spark, sf):
    return tidy(M.adjusted_rand(assigned(spark, sf), "label", "cluster_id"))


@case(
    "E12_mean_pairwise_rand",
    f"""WITH {EM}, {DIST}, three AS (SELECT *, vec_id % 5 AS g FROM lab)
    SELECT {r(f"({rand_sql('label', 'cluster_id', 'three')} + {rand_sql('label', 'g', 'three')} + {rand_sql('cluster_id', 'g', 'three')}) / 3", 'stability_ari_mean')}""",
)
def mean_pairwise_rand(spark, sf):
    rows = assigned(spark, sf).withColumn("g", F.col("vec_id") % 5)
    return tidy(M.mean_pairwise_rand(rows, ["label", "cluster_id", "g"]))


@case(
    "E13_cluster_balance",
    f"""WITH c AS (SELECT k, count(vec_id) AS n FROM (SELECT unnest(range(12)) AS k) LEFT JOIN embeddings ON label = k GROUP BY 1),
    p AS (SELECT n, n / sum(n) OVER () AS p FROM c)
    SELECT {b('min(n)', 'minimum_cluster_size')}, {b('max(n)', 'maximum_cluster_size')}, {r('min(p)', 'minimum_cluster_proportion')},
    {r('max(p)', 'maximum_cluster_proportion')}, {r('-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(12.0)', 'normalized_cluster_entropy')} FROM p""",
)
def cluster_balance(spark, sf):
    return tidy(M.cluster_balance(embeddings(spark, sf), range(12), "label").drop("sizes"))


CANDIDATES = """cand AS (SELECT label + 2 AS k, avg(embedding[1]) AS silhouette_score, avg(abs(embedding[2])) AS davies_bouldin_score,
  100 * avg(abs(embedding[3])) AS calinski_harabasz_score, 0.5 AS stability_ari_mean, count(*) / 10000 AS minimum_cluster_proportion,
  CASE WHEN label = 4 THEN 'NaN'::DOUBLE ELSE avg(abs(embedding[5])) END AS normalized_cluster_entropy FROM embeddings GROUP BY label)"""


def _scaled(expr: str, reverse: bool = False) -> str:
    core = f"({expr} - min(CASE WHEN isfinite({expr}) THEN {expr} END) OVER ()) / nullif(max(CASE WHEN isfinite({expr}) THEN {expr} END) OVER () - min(CASE WHEN isfinite({expr}) THEN {expr} END) OVER (), 0)"
    core = f"coalesce({core}, 1)"
    return f"CASE WHEN isfinite({expr}) THEN {'1 - ' if reverse else ''}{core} ELSE 0 END"


@case(
    "E14_E15_recommend_k",
    f"""WITH {CANDIDATES}, s AS (SELECT k, {_scaled('silhouette_score')} AS a, {_scaled('davies_bouldin_score', True)} AS z,
      {_scaled('ln(1 + calinski_harabasz_score)')} AS c, {_scaled('stability_ari_mean')} AS d, {_scaled('minimum_cluster_proportion')} AS e,
      {_scaled('normalized_cluster_entropy')} AS f FROM cand)
    SELECT {b('k')}, {r('a', 'score_silhouette')}, {r('z', 'score_davies_bouldin')}, {r('c', 'score_calinski_harabasz')}, {r('d', 'score_stability')},
    {r('e', 'score_min_cluster')}, {r('f', 'score_balance')}, {r('0.25 * a + 0.15 * z + 0.10 * c + 0.25 * d + 0.15 * e + 0.10 * f', 'recommendation_score')} FROM s""",
)
def score_candidates(spark, sf):
    e = F.col("embedding")
    entropy = F.when(F.col("label") == 4, F.lit(float("nan"))).otherwise(F.avg(F.abs(e[4])))
    rows = embeddings(spark, sf).groupBy("label").agg(
        F.avg(e[0]).alias("silhouette_score"), F.avg(F.abs(e[1])).alias("davies_bouldin_score"),
        (100 * F.avg(F.abs(e[2]))).alias("calinski_harabasz_score"), F.lit(0.5).alias("stability_ari_mean"),
        (F.count(F.lit(1)) / 10000).alias("minimum_cluster_proportion"), entropy.alias("normalized_cluster_entropy"),
    )
    scored = D.score_candidates(rows.withColumn("k", F.col("label") + 2))
    return tidy(scored.select("k", *D.SCORE_WEIGHTS, "recommendation_score"))


@case("E16_sweep_k")
def sweep_k(spark, sf):
    rows = embeddings(spark, sf).select("vec_id", "embedding")
    return tidy(D.sweep_k(rows, "embedding", DIM, "vec_id", range(2, 9)))


@case(
    "E17_exemplars",
    f"""WITH {EM}, {DIST}, n AS (SELECT vec_id, cluster_id, ds[1] AS d, row_number() OVER (PARTITION BY cluster_id ORDER BY ds[1], vec_id) AS i,
      row_number() OVER (PARTITION BY cluster_id ORDER BY {RANK}, vec_id) AS j FROM lab)
    SELECT vec_id, {b('cluster_id')}, {r('d', 'distance_to_centroid')}, 'nearest' AS role FROM n WHERE i <= 7
    UNION ALL SELECT vec_id, {b('cluster_id')}, {r('d', 'distance_to_centroid')}, 'random' FROM n WHERE j <= 7""",
)
def exemplars(spark, sf):
    return tidy(D.exemplars(assigned(spark, sf), 7, CLASSES, "vec_id", rank_expr=F.expr(RANK)))


@case(
    "E17_inspect_clusters",
    f"""WITH {EM}, {DIST} SELECT {b('c', 'cluster_id')}, {b('count(vec_id)', 'training_size')}, {b('arg_min(vec_id, ds[1])', 'representative')},
    {r('avg(ds[1])', 'mean_distance_to_centroid')}, {r('max(ds[1])', 'maximum_distance_to_centroid')}
    FROM {S.classes(5)} LEFT JOIN lab ON cluster_id = c GROUP BY c""",
)
def inspect_clusters(spark, sf):
    return tidy(D.inspect_clusters(assigned(spark, sf), range(5), "vec_id"))


SUMMARY = f"""c AS (SELECT c, count(vec_id) FILTER (WHERE vec_id % 5 <> 0) AS a, count(vec_id) FILTER (WHERE vec_id % 5 = 0) AS z
  FROM {S.classes(5)} LEFT JOIN lab ON cluster_id = c GROUP BY c)"""


@case(
    "E18_assignment_summary",
    f"""WITH {EM}, {DIST}, {SUMMARY} SELECT {b('c', 'cluster_id')}, {b('a', 'training_size')}, {b('z', 'validation_size')},
    {r('a / sum(a) OVER ()', 'training_proportion')}, {r('z / sum(z) OVER ()', 'validation_proportion')} FROM c""",
)
def assignment_summary(spark, sf):
    split = F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train")
    return tidy(D.assignment_summary(assigned(spark, sf).withColumn("split", split), range(5)))


@case(
    "D11_cluster_summary",
    f"""WITH {EM}, {DIST}, {SUMMARY}, n AS (SELECT cluster_id, max(ds[1]) AS d FROM lab WHERE vec_id % 5 <> 0 GROUP BY 1)
    SELECT {b('c', 'cluster_id')}, {b('a', 'training_size')}, {b('z', 'validation_size')}, {r('d', 'maximum_distance_to_centroid')}
    FROM c LEFT JOIN n ON n.cluster_id = c""",
)
def cluster_summary(spark, sf):
    rows = assigned(spark, sf).withColumn("split", F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train"))
    inspection = D.inspect_clusters(rows.where("split = 'train'"), range(5), "vec_id")
    joined = D.cluster_summary(D.assignment_summary(rows, range(5)), inspection)
    return tidy(joined.select("cluster_id", "training_size", "validation_size", "maximum_distance_to_centroid"))


@case(
    "E19_centroid_matrix",
    f"WITH {EM}, {means()} SELECT {b('x.label', 'cluster_id')}, {b('y.label', 'other_id')}, {r('list_distance(x.c, y.c)', 'distance')} FROM means x, means y",
)
def centroid_matrix(spark, sf):
    return tidy(R.centroid_matrix(frozen_means(spark, sf, LABELS)))


@case(
    "E20_frozen_definition",
    f"""WITH {EM}, {means()} SELECT count(*) AS k, {b('min(len(c))', 'min_dim')}, {b('max(len(c))', 'max_dim')},
    {b(str(DIM), 'pca_features')}, {b(str(COMPONENTS), 'pca_components')} FROM means""",
)
def frozen_definition(spark, sf):
    facts = R.definition_facts(frozen_means(spark, sf, LABELS), frozen_waves(spark, sf))
    return tidy(facts.drop("centroid_hash", "pca_hash"))


@case(
    "E21_score",
    f"""WITH {EM}, {UNIT}, {wave_sql()}, {means('red', 'rm', COMPONENTS)}, dist AS (SELECT vec_id, list_distance(v, (SELECT c FROM rm WHERE label = 0)) AS d0,
      list_distance(v, (SELECT c FROM rm WHERE label = 1)) AS d1, list_distance(v, (SELECT c FROM rm WHERE label = 2)) AS d2 FROM red),
    s AS (SELECT *, list_sort([d0, d1, d2]) AS ds FROM dist)
    SELECT vec_id, {b(S.NEAREST.format(p='d'), 'cluster_id')}, {r('d0')}, {r('d1')}, {r('d2')}, {r('(ds[2] - ds[1]) / greatest(ds[2], 1e-8)', 'relative_distance_margin')} FROM s""",
)
def score(spark, sf):
    pca = frozen_waves(spark, sf)
    reduced = R.apply_pca(unit_rows(spark, sf), "v", pca)
    centers = R.mean_vectors(reduced, "reduced", "label", COMPONENTS, CLASSES)
    scored = R.score(embeddings(spark, sf), "embedding", centers, pca)
    return tidy(scored.select("vec_id", "cluster_id", *R.flat(scored, "distances", "d", 3), "relative_distance_margin"))
