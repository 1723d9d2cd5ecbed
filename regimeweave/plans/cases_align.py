"""Queries for joins, splits, audits and reports, each with its check statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimeweave.functions.timing import moment
from regimeweave.operators import align, audits, regimes, reports, splits
from regimeweave.operators import windows as W
from regimeweave.operators.lookups import with_lookup
from regimeweave.plans import inputs as I
from regimeweave.plans import sql_parts as S
from regimeweave.plans.inputs import CLASSES, K, N, PERIODS, tidy
from regimeweave.plans.sql_parts import b, r, t
from regimeweave.session import stage

QUERIES, SQL = {}, {}


def case(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- joins -------------------------------------------------------------------------------


@case(
    "D1_pairs",
    f"""{S.base(True, 'pair')} SELECT pair_id, symbol, {b('input_start_index')}, {b('input_stop_index')}, {b('target_start_index')},
    {b('target_stop_index')}, {t('input_start_time')}, {t('target_stop_time')}, {b('input_cluster_id')}, {b('target_cluster_id')},
    {r('t0', 'd0')}, {r('t1', 'd1')}, {r('t2', 'd2')} FROM pair""",
)
def pairs(spark, sf):
    rows = I.all_pairs(spark, sf, True)
    return tidy(
        rows.select(
            "pair_id", "symbol", "input_start_index", "input_stop_index", "target_start_index", "target_stop_index",
            "input_start_time", "target_stop_time", "input_cluster_id", "target_cluster_id",
            *regimes.flat(rows, "target_distances", "d", K),
        )
    )


@case(
    "D1b_unpaired",
    f"""{S.base(True, 'lab')} SELECT symbol, sample_name AS input_sample_name, {t('start_time', 'input_start_time')},
    {t("start_time + INTERVAL '30 hours'", 'required_target_start_time')}, 'exact_future_target_image_unavailable' AS reason
    FROM lab a WHERE NOT EXISTS (FROM lab z WHERE z.symbol = a.symbol AND z.start_time = a.start_time + INTERVAL '30 hours')""",
)
def unpaired(spark, sf):
    return tidy(align.unpaired(stage(I.windows(spark, sf, True), "windows"), N))


LONG_SQL = f"""{S.base(upto='lab')},\n{S.cand(90, 'c90')}, long AS (SELECT symbol, row_index AS i, open_time FROM c90 WHERE oks = 89),
aligned AS (SELECT l.symbol, l.i AS input_start_index, l.open_time AS input_start_time, t.stop_time AS target_stop_time,
  t.cluster_id AS target_cluster_id, c.cluster_id AS input_cluster_id, t.d0 AS t0, t.d1 AS t1, t.d2 AS t2, t.ds AS ts
  FROM long l JOIN lab t ON t.symbol = l.symbol AND t.start_index = l.i + 90
  JOIN lab c ON c.symbol = l.symbol AND c.start_index = l.i + 60)"""


def long_pairs(spark, sf):
    """90-candle inputs with their 30-candle target and current window."""
    run_table = stage(I.runs(spark, sf), "runs")
    labelled = regimes.assign(I.describe(run_table), "features", I.frozen(spark))
    labelled = stage(labelled.select("symbol", "start_index", "stop_time", "cluster_id", "distances"), "labelled")
    return align.align_long(W.build_windows(run_table, 90), labelled, 90, 30)


@case(
    "D2_align_long",
    f"""{LONG_SQL} SELECT symbol, {b('input_start_index')}, {t('target_stop_time')}, {b('target_cluster_id')}, {b('input_cluster_id')} FROM aligned""",
)
def align_long(spark, sf):
    return tidy(long_pairs(spark, sf).select("symbol", "input_start_index", "target_stop_time", "target_cluster_id", "input_cluster_id"))


@case(
    "D3_reconstruct_current",
    f"""{S.base(upto='lab')}, {S.cand(90, 'c90')}, span AS (SELECT s.symbol, s.row_index AS i, z.cluster_id FROM c90 s
      JOIN lab z ON z.symbol = s.symbol AND z.start_index = s.row_index + 60 WHERE s.oks = 89)
    SELECT a.symbol, {b('a.i', 'input_start_index')}, {b('a.cluster_id', 'target_cluster_id')}, {b('k.cluster_id', 'recent_input_cluster_id')}
    FROM span a LEFT JOIN span k ON k.symbol = a.symbol AND k.i + 60 = a.i + 30""",
)
def reconstruct_current(spark, sf):
    run_table = stage(I.runs(spark, sf), "runs")
    labelled = regimes.assign(I.describe(run_table), "features", I.frozen(spark))
    spans = W.build_spans(run_table, 60, 30)
    targets = labelled.select("symbol", F.col("start_index").alias("target_start_index"), F.col("cluster_id").alias("target_cluster_id"))
    held = stage(spans.join(targets, ["symbol", "target_start_index"]), "spans")
    return tidy(align.reconstruct_current(held, 30).select("symbol", "input_start_index", "target_cluster_id", "recent_input_cluster_id"))


@case(
    "D4_attach_labels",
    f"""{S.base(True, 'lab')},\n{S.cand(60, 'span')} SELECT s.symbol, {b('s.row_index', 'input_start_index')}, {b('z.cluster_id', 'cluster_id')}
    FROM span s JOIN lab z ON z.symbol = s.symbol AND z.start_index = s.row_index + 30 WHERE s.oks = 59""",
)
def attach_labels(spark, sf):
    run_table = stage(I.runs(spark, sf, True), "runs")
    labelled = regimes.assign(I.describe(run_table), "features", I.frozen(spark))
    spans = W.build_spans(run_table, 30, 30).select("symbol", "input_start_index", F.col("target_start_index").alias("start_index"))
    found = align.attach_labels(spans, labelled, ["symbol", "start_index"], "cluster_id", strict=False)
    return tidy(found.select("symbol", "input_start_index", "cluster_id"))


@case(
    "D4_document_labels",
    """SELECT d.lang, count(*) AS documents, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def document_labels(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "lang")
    found = align.attach_labels(docs, I.table(spark, sf, "labels"), ["doc_id"], "quality", strict=False)
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("labelled"))


OLD = f"""{S.base(upto='parts')}, old AS (SELECT * FROM parts WHERE input_start_index % 10 <> 3),
corr AS (SELECT *, n % 4 <> 0 AS eligible FROM (SELECT *, input_start_index AS n FROM parts)),
merged AS (SELECT o.pair_id, o."partition", c.target_cluster_id, c.eligible FROM old o JOIN corr c
  ON o."partition" = c."partition" AND o.input_start_time = c.input_start_time WHERE o."partition" <> 'train' OR c.eligible)"""


def _relabelled(spark, sf):
    """An older manifest that lacks some pairs, and the corrected labels of all of them."""
    rows = I.pairs(spark, sf)
    iso = F.concat(F.replace(F.col("input_start_time").cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
    old = rows.where("input_start_index % 10 <> 3").select(
        "pair_id", "partition", iso.alias("input_start_time"), F.lit(-1).alias("target_cluster_id"), F.lit(False).alias("training_eligible")
    )
    corrected = rows.select(
        "partition", "input_start_time", "target_cluster_id", (F.col("input_start_index") % 4 != 0).alias("training_eligible")
    )
    return old, corrected


@case("D5_merge_labels", f"""{OLD} SELECT pair_id, "partition", {b('target_cluster_id')}, eligible AS training_eligible FROM merged""")
def merge_labels(spark, sf):
    old, corrected = _relabelled(spark, sf)
    merged = align.merge_labels(old, corrected, ["target_cluster_id", "training_eligible"])
    return tidy(merged.select("pair_id", "partition", "target_cluster_id", "training_eligible"))


@case(
    "D5_match_rate",
    f"""{OLD}, e AS (SELECT "partition", count(*) FILTER (WHERE "partition" <> 'train' OR eligible) AS expected FROM corr GROUP BY 1),
    w AS (SELECT "partition", count(*) AS written FROM merged GROUP BY 1)
    SELECT "partition", expected, written, {r('written / expected', 'match_rate')}, written / expected >= 0.98 AS passed FROM e JOIN w USING ("partition")""",
)
def match_rate(spark, sf):
    old, corrected = _relabelled(spark, sf)
    merged = align.merge_labels(old, corrected, ["target_cluster_id", "training_eligible"])
    return tidy(align.match_rate(merged, corrected))


KEYS_SQL = f"""{S.base(upto='win')}, n AS (SELECT count(*) AS n FROM win),
shares AS (SELECT 'sample_name' AS "column", 0.0 AS parsed_share, 0.0 AS hit_share UNION ALL SELECT 'start_index', 0.0, 0.0
  UNION ALL SELECT 'start_time', 1.0, (SELECT count(*) FROM win a WHERE EXISTS (FROM win z WHERE z.stop_time = a.start_time)) / n FROM n
  UNION ALL SELECT 'stop_time', 1.0, 1.0)"""


@case("D6_time_columns", f"""{KEYS_SQL} SELECT "column", {r('parsed_share')}, {r('hit_share')} FROM shares""")
def time_columns(spark, sf):
    found = stage(I.windows(spark, sf).select("sample_name", F.concat(F.lit("no. "), F.col("start_index")).alias("start_index"), "start_time", "stop_time"), "windows")
    return tidy(align.time_column_overlap(found, found.select("stop_time"), "stop_time"))


@case("D6_pick_time_column", f"""{KEYS_SQL} SELECT "column", {r('parsed_share')}, {r('hit_share')} FROM shares ORDER BY hit_share DESC LIMIT 1""")
def pick_time_column(spark, sf):
    found = stage(I.windows(spark, sf).select("sample_name", F.concat(F.lit("no. "), F.col("start_index")).alias("start_index"), "start_time", "stop_time"), "windows")
    return tidy(align.pick_time_column(found, found.select("stop_time"), "stop_time"))


@case(
    "D6_pick_image_column",
    r"""SELECT 'url' AS "column", round(avg(CASE WHEN regexp_matches(url, '\.(jpg|jpeg|png)\s*$', 'i') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS image_share
    FROM (SELECT CASE WHEN page_id % 3 = 0 THEN url ELSE url || '.PNG ' END AS url FROM pages)""",
)
def pick_image_column(spark, sf):
    rows = I.table(spark, sf, "pages").select(
        "page_id", "html", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.col("url"), F.lit(".PNG "))).alias("url")
    )
    return tidy(align.pick_image_column(rows))


NAMES = {0: "rising", 1: "flat", 2: "falling"}


@case(
    "D7_lookup",
    f"""{S.base(True, 'lab')} SELECT symbol, {b('start_index')}, CASE cluster_id WHEN 0 THEN 'rising' WHEN 1 THEN 'flat' ELSE 'falling' END AS regime_name FROM lab""",
)
def lookup(spark, sf):
    names = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("cluster_id"), F.lit(v).alias("name")) for k, v in NAMES.items()]))
    )
    rows = with_lookup(I.labelled(spark, sf, True), names, "cluster_id", "name", CLASSES, "regime_name")
    return tidy(rows.select("symbol", "start_index", "regime_name"))


@case(
    "D8_conserved",
    f"""WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 = 0) AS lost, count(*) FILTER (WHERE doc_id % 10 = 1) AS twice FROM documents)
    SELECT {b('n', 'original_ids')}, {b('n - lost', 'part_ids')}, {b('0', 'repeated_inside_a_part')}, {b('twice', 'shared_by_parts')},
    {b('lost')}, {b('0', 'invented')}, false AS conserved FROM o""",
)
def conserved(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id")
    m = F.col("doc_id") % 10
    parts = {"left": docs.where(m.between(1, 5)), "right": docs.where((m == 1) | (m > 5))}
    return tidy(align.check_conserved(docs, parts, "doc_id"))


@case(
    "D9_missing_files",
    f"{S.base(True, 'win')} SELECT symbol, sample_name FROM win WHERE start_index % 6 = 1",
)
def missing_files(spark, sf):
    found = stage(I.windows(spark, sf, True), "windows")
    # the listing lacks some files, so that there is something to find
    manifest = found.select("symbol", "sample_name", F.concat_ws("\\", "symbol", "sample_name").alias("image_path"))
    files = found.where("start_index % 6 <> 1").select(F.concat_ws("/", "symbol", "sample_name").alias("path"))
    return align.missing_files(manifest, files).select("symbol", "sample_name")


@case(
    "D10_resolve_paths",
    f"""{S.base(True, 'win')}, f AS (SELECT *, CASE start_index % 4 WHEN 0 THEN '' WHEN 1 THEN 'data/' WHEN 2 THEN 'data/images/' ELSE 'other/' END
      || CASE WHEN start_index % 4 = 3 THEN '' ELSE symbol || '/' END || sample_name || '.jpg' AS path FROM win),
    names AS (SELECT sample_name, min(path) AS p, count(DISTINCT path) - 1 AS others FROM f GROUP BY 1)
    SELECT symbol, {b('start_index')}, CASE WHEN start_index % 4 = 3 THEN p ELSE path END AS resolved_path,
    {b('CASE WHEN start_index % 4 = 3 THEN others ELSE 0 END', 'ambiguous')} FROM f JOIN names USING (sample_name)""",
)
def resolve_paths(spark, sf):
    found = stage(I.windows(spark, sf, True), "windows")
    name = F.concat(F.col("sample_name"), F.lit(".jpg"))
    whole = F.concat_ws("/", F.col("symbol"), name)
    m = F.col("start_index") % 4
    files = found.select(
        F.when(m == 0, whole).when(m == 1, F.concat(F.lit("data/"), whole)).when(m == 2, F.concat(F.lit("data/images/"), whole))
        .otherwise(F.concat(F.lit("other/"), name)).alias("path")
    )
    manifest = found.select("symbol", "start_index", F.replace(whole, F.lit("/"), F.lit("\\")).alias("image_path"))
    return tidy(align.resolve_paths(manifest, files, "data").drop("image_path"))


@case(
    "D12_agreement",
    f"""{S.base(True, 'lab')} SELECT {b('count(*)', 'rows')}, {r('avg(CASE WHEN cluster_id = (CASE WHEN log_return > 0.75 THEN 0 WHEN log_return < -0.75 THEN 2 ELSE 1 END) THEN 1.0 ELSE 0.0 END)', 'agreement')} FROM lab""",
)
def agreement(spark, sf):
    rows = stage(I.labelled(spark, sf, True).select("symbol", "start_index", "cluster_id", "features"), "labelled")
    ret = F.col("features")[0]
    other = rows.withColumn("cluster_id", F.when(ret > 0.75, 0).when(ret < -0.75, 2).otherwise(1))
    return tidy(align.agreement(rows, other, ["symbol", "start_index"]))


# --- splits ------------------------------------------------------------------------------


@case(
    "H5_split_fixed",
    f"""{S.base(True, 'pair')} SELECT pair_id, {S.partition_case()} AS "partition" FROM pair""",
)
def split_fixed(spark, sf):
    return splits.mark_fixed(I.all_pairs(spark, sf, True), PERIODS).select("pair_id", "partition")


@case(
    "H5_split_counts",
    f"""{S.base(upto='pair')} SELECT coalesce({S.partition_case()}, 'purged') AS "partition", count(*) AS rows FROM pair GROUP BY 1""",
)
def split_counts(spark, sf):
    return splits.split_counts(splits.mark_fixed(I.all_pairs(spark, sf), PERIODS))


TEST_START = PERIODS["test"][0]


@case(
    "H6_split_by_source",
    f"""{S.base(upto='pair')}, s AS (SELECT *, CASE WHEN input_start_time >= TIMESTAMP '2024-01-30' THEN 'spare'
      WHEN input_start_time >= TIMESTAMP '{TEST_START}' THEN 'test' ELSE 'train_validation' END AS source_id, {S.partition_case()} AS p FROM pair),
    q AS (SELECT *, CASE WHEN source_id = 'train_validation' AND p IN ('train', 'validation') THEN p WHEN source_id = 'test' AND p = 'test' THEN p END AS pp FROM s)
    SELECT pair_id, source_id, pp AS "partition", CASE WHEN pp IS NOT NULL THEN NULL
      WHEN source_id = 'spare' THEN 'unknown_source_id: spare' WHEN source_id = 'test' THEN 'future_target_outside_fixed_test_period'
      WHEN input_start_time < TIMESTAMP '2024-01-21' AND target_stop_time >= TIMESTAMP '2024-01-21' THEN 'crosses_train_validation_boundary'
      ELSE 'outside_fixed_train_or_validation_period' END AS reason FROM q""",
)
def split_by_source(spark, sf):
    rows = I.all_pairs(spark, sf)
    start = F.col("input_start_time")
    source = (
        F.when(start >= F.expr("timestamp_ntz'2024-01-30 00:00:00'"), "spare")
        .when(start >= moment(TEST_START), "test")
        .otherwise("train_validation")
    )
    return splits.split_by_source(rows.withColumn("source_id", source), PERIODS).select("pair_id", "source_id", "partition", "reason")


@case(
    "H7_split_embargo2",
    f"""{S.base(True, 'win')}, o AS (SELECT symbol, start_index, row_number() OVER (PARTITION BY symbol ORDER BY start_index) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM win),
    v AS (SELECT symbol, start_index AS v FROM o WHERE i = least(greatest(floor(n * 0.9), 1), n - 1))
    SELECT symbol, {b('start_index')}, CASE WHEN stop_index < v - 30 THEN 'train' WHEN start_index >= v THEN 'validation' ELSE 'purged' END AS split,
    {b('v', 'validation_start_index')} FROM win JOIN v USING (symbol)""",
)
def split_embargo2(spark, sf):
    found = stage(I.windows(spark, sf, True), "windows")
    return tidy(splits.split_embargo2(found, by=["symbol"]).select("symbol", "start_index", "split", "validation_start_index"))


@case(
    "H7_split_details",
    f"""{S.base(True, 'win')}, s AS (SELECT *, CASE WHEN stop_index < 470 THEN 'train' WHEN start_index >= 500 THEN 'validation' ELSE 'purged' END AS split FROM win)
    SELECT {b('500', 'validation_start_index')}, {b("max(start_index) FILTER (WHERE split = 'train')", 'train_last_start_index')},
    {b("max(stop_index) FILTER (WHERE split = 'train')", 'train_last_stop_index')}, {b("min(start_index) FILTER (WHERE split = 'validation')", 'validation_first_start_index')},
    {b("count(*) FILTER (WHERE split = 'purged')", 'purged_sample_count')} FROM s""",
)
def split_details(spark, sf):
    return tidy(splits.split_details(splits.split_embargo2(I.windows(spark, sf, True), validation_start=500)))


@case(
    "H8_split_embargo3",
    f"""{S.base(True, 'pair')}, n AS (SELECT symbol, count(*) AS n FROM pair GROUP BY 1), o AS (SELECT symbol, input_start_index AS s, row_number() OVER (PARTITION BY symbol ORDER BY input_start_index) - 1 AS i FROM pair),
    p AS (SELECT symbol, least(greatest(floor(n * 0.7), 1), n - 2) AS a, n, least(greatest(floor(n * {0.70 + 0.15!r}), least(greatest(floor(n * 0.7), 1), n - 2) + 1), n - 1) AS z FROM n),
    v AS (SELECT symbol, max(s) FILTER (WHERE i = a) AS v, max(s) FILTER (WHERE i = z) AS t FROM o JOIN p USING (symbol) GROUP BY 1)
    SELECT pair_id, {b('v', 'validation_start_index')}, {b('t', 'test_start_index')}, CASE WHEN target_stop_index < v - 5 THEN 'train'
      WHEN input_start_index >= v AND target_stop_index < t - 5 THEN 'validation' WHEN input_start_index >= t THEN 'test' ELSE 'purged' END AS split
    FROM pair JOIN v USING (symbol)""",
)
def split_embargo3(spark, sf):
    rows = stage(I.all_pairs(spark, sf, True).select("symbol", "pair_id", "input_start_index", "target_stop_index"), "all_pairs")
    marked = splits.split_embargo3(rows, embargo=5, by=["symbol"])
    return tidy(marked.select("pair_id", "validation_start_index", "test_start_index", "split"))


@case(
    "H9_split_purge_forward",
    f"""{S.base(True, 'win')}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_index, stop_index) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM win),
    c AS (SELECT *, n - least(greatest(round_even(n * 0.1, 0), 1), n - 1) AS cut FROM o), l AS (SELECT symbol, max(stop_index) AS l FROM c WHERE i = cut - 1 GROUP BY 1)
    SELECT symbol, {b('start_index')}, CASE WHEN i < cut THEN 'train' WHEN start_index <= l + 30 THEN 'purged' ELSE 'validation' END AS split FROM c JOIN l USING (symbol)""",
)
def split_purge_forward(spark, sf):
    found = stage(I.windows(spark, sf, True), "windows")
    marked = splits.split_purge_forward(found, by=["symbol"])
    return tidy(marked.select("symbol", "start_index", "split"))


# --- audits and reports ------------------------------------------------------------------


@case(
    "H1_distribution",
    f"""{S.base(upto='parts')}, k AS (SELECT "partition", c FROM (SELECT DISTINCT "partition" FROM parts), (SELECT unnest(range(4)) AS c))
    SELECT k."partition", {b('c', 'cluster_id')}, {b('count(pair_id)', 'count')},
    {r('100.0 * count(pair_id) / sum(count(pair_id)) OVER (PARTITION BY k."partition")', 'percentage')}
    FROM k LEFT JOIN parts p ON p."partition" = k."partition" AND p.target_cluster_id = c GROUP BY 1, c""",
)
def distribution(spark, sf):
    return tidy(reports.distribution(I.pairs(spark, sf), range(4)))


@case(
    "H2_transitions",
    f"""{S.base(upto='parts')}, k AS (SELECT "partition", x.c AS a, y.c AS z FROM (SELECT DISTINCT "partition" FROM parts), {S.classes()} x, {S.classes()} y)
    SELECT k."partition", {b('a', 'current_cluster_id')}, {b('z', 'future_cluster_id')}, {b('count(pair_id)', 'count')}
    FROM k LEFT JOIN parts p ON p."partition" = k."partition" AND p.input_cluster_id = a AND p.target_cluster_id = z GROUP BY 1, a, z""",
)
def transitions(spark, sf):
    return tidy(reports.transition_counts(I.pairs(spark, sf), CLASSES))


HASHED = "h AS (SELECT doc_id, sha256(text) AS digest FROM documents)"


@case(
    "H3_duplicate_groups",
    f"WITH {HASHED} SELECT digest, count(*) AS members, min(doc_id) AS first_name FROM h GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_groups(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return reports.duplicate_groups(docs, "digest", "doc_id")


@case(
    "H3_duplicate_members",
    f"WITH {HASHED} SELECT digest, doc_id FROM h WHERE digest IN (SELECT digest FROM h GROUP BY 1 HAVING count(*) > 1)",
)
def duplicate_members(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return reports.duplicate_members(docs, "digest", "doc_id")


@case(
    "H3_duplicate_summary",
    f"""WITH {HASHED}, g AS (SELECT digest, count(*) AS n FROM h GROUP BY 1)
    SELECT {b('sum(n)', 'row_count')}, count(*) AS unique_hash_count, count(*) FILTER (WHERE n > 1) AS duplicate_group_count FROM g""",
)
def duplicate_summary(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return reports.duplicate_summary(docs, "digest", "doc_id")


@case(
    "H10_partition_findings",
    f"""{S.base(True, 'parts')} SELECT "partition", count(*) AS rows, {b('0', 'mixed_source_rows')}, {b('0', 'backward_rows')},
    {t('min(input_start_time)', 'first_input_time')}, {t('max(target_stop_time)', 'last_target_time')}, {b('0', 'repeated_ids')}, {b('0', 'shared_ids')}
    FROM parts GROUP BY 1""",
)
def partition_findings(spark, sf):
    return tidy(audits.partition_findings(I.pairs(spark, sf, True)))


@case(
    "H10_boundaries",
    f"""{S.base(True, 'parts')}, e AS (SELECT "partition" AS p, min(input_start_time) AS a, max(target_stop_time) AS z FROM parts GROUP BY 1),
    x AS (SELECT 'train' AS l, 'validation' AS n UNION ALL SELECT 'validation', 'test'),
    s AS (SELECT symbol, "partition" AS p, min(input_start_index) AS a, max(target_stop_index) AS z FROM parts GROUP BY 1, 2)
    SELECT l || '_to_' || n AS boundary, {t('f.z', 'left_target_end')}, {t('g.a', 'right_input_start')}, {r('epoch(g.a) - epoch(f.z)', 'gap_seconds')},
    (SELECT count(*) FROM s u JOIN s v USING (symbol) WHERE u.p = l AND v.p = n) AS shared_sources,
    (SELECT count(*) FROM s u JOIN s v USING (symbol) WHERE u.p = l AND v.p = n AND u.z >= v.a) AS index_violations, g.a > f.z AS passed
    FROM x JOIN e f ON f.p = l JOIN e g ON g.p = n""",
)
def boundaries(spark, sf):
    return tidy(audits.audit_boundaries(I.pairs(spark, sf, True)))


@case(
    "H11_index_boundaries",
    f"""{S.base(upto='parts')}, e AS (SELECT "partition", count(*) AS rows, min(input_start_index) AS a, max(target_stop_index) AS z FROM parts GROUP BY 1)
    SELECT "partition", rows, {b('a', 'first_input_index')}, {b('z', 'last_target_index')},
    coalesce(a > lag(z) OVER (ORDER BY CASE "partition" WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END), true) AS separated FROM e""",
)
def index_boundaries(spark, sf):
    return tidy(audits.index_boundaries(I.pairs(spark, sf)))


@case(
    "H11_index_boundaries_by_symbol",
    f"""{S.base(True, 'parts')}, e AS (SELECT symbol, "partition", count(*) AS rows, min(input_start_index) AS a, max(target_stop_index) AS z FROM parts GROUP BY ALL)
    SELECT symbol, "partition", rows, {b('a', 'first_input_index')}, {b('z', 'last_target_index')},
    coalesce(a > lag(z) OVER (PARTITION BY symbol ORDER BY CASE "partition" WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END), true) AS separated FROM e""",
)
def index_boundaries_by_symbol(spark, sf):
    return tidy(audits.index_boundaries(I.pairs(spark, sf, True), by=["symbol"]))


@case(
    "H12_span_audit",
    f"""{S.base(upto='parts')}, e AS (SELECT *, lag(input_start_index) OVER (PARTITION BY "partition" ORDER BY chronological_rank) AS before FROM parts),
    c AS (SELECT "partition", count(*) FILTER (WHERE input_stop_index - input_start_index + 1 <> 30) AS wrong_input_length,
      count(*) FILTER (WHERE target_stop_index - target_start_index + 1 <> 29) AS wrong_target_length,
      count(*) FILTER (WHERE target_start_index <> input_stop_index + 1) AS overlap_or_gap,
      count(*) FILTER (WHERE target_cluster_id NOT IN (0, 1)) AS label_outside_range,
      count(*) FILTER (WHERE input_start_index < before) AS not_chronological, 0 AS overlaps_previous_partition FROM e GROUP BY 1)
    SELECT "partition", rule, CAST(violations AS BIGINT) AS violations FROM (UNPIVOT (SELECT "partition", wrong_input_length::BIGINT AS wrong_input_length,
      wrong_target_length::BIGINT AS wrong_target_length, overlap_or_gap::BIGINT AS overlap_or_gap, label_outside_range::BIGINT AS label_outside_range,
      not_chronological::BIGINT AS not_chronological, overlaps_previous_partition::BIGINT AS overlaps_previous_partition FROM c)
      ON wrong_input_length, wrong_target_length, overlap_or_gap, label_outside_range, not_chronological, overlaps_previous_partition
      INTO NAME rule VALUE violations)""",
)
def span_audit(spark, sf):
    return tidy(audits.audit_spans(I.pairs(spark, sf), 30, 29, [0, 1]))


@case(
    "H12_span_audit_by_symbol",
    f"""{S.base(True, 'parts')}, e AS (SELECT *, lag(input_start_index) OVER (PARTITION BY symbol, "partition" ORDER BY chronological_rank) AS before FROM parts),
    ends AS (SELECT symbol, "partition", min(input_start_index) AS a, max(target_stop_index) AS z FROM parts GROUP BY ALL),
    late AS (SELECT "partition", a <= lag(z) OVER (PARTITION BY symbol ORDER BY CASE "partition" WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END) AS late FROM ends),
    c AS (SELECT "partition", count(*) FILTER (WHERE input_stop_index - input_start_index + 1 <> 30) AS wrong_input_length,
      count(*) FILTER (WHERE target_stop_index - target_start_index + 1 <> 29) AS wrong_target_length,
      count(*) FILTER (WHERE target_start_index <> input_stop_index + 1) AS overlap_or_gap,
      count(*) FILTER (WHERE target_cluster_id NOT IN (0, 1)) AS label_outside_range,
      count(*) FILTER (WHERE input_start_index < before) AS not_chronological, (SELECT count(*) FILTER (WHERE late) FROM late WHERE late."partition" = e."partition") AS overlaps_previous_partition FROM e GROUP BY 1)
    SELECT "partition", rule, CAST(violations AS BIGINT) AS violations FROM (UNPIVOT (SELECT "partition", wrong_input_length::BIGINT AS wrong_input_length,
      wrong_target_length::BIGINT AS wrong_target_length, overlap_or_gap::BIGINT AS overlap_or_gap, label_outside_range::BIGINT AS label_outside_range,
      not_chronological::BIGINT AS not_chronological, overlaps_previous_partition::BIGINT AS overlaps_previous_partition FROM c)
      ON wrong_input_length, wrong_target_length, overlap_or_gap, label_outside_range, not_chronological, overlaps_previous_partition
      INTO NAME rule VALUE violations)""",
)
def span_audit_by_symbol(spark, sf):
    return tidy(audits.audit_spans(I.pairs(spark, sf, True), 30, 29, [0, 1], by=["symbol"]))


@case(
    "H13_grid_complete",
    f"""{S.base(True, 'parts')}, g AS (SELECT s, p FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'search']) AS s),
      (SELECT unnest(['train', 'validation']) AS p))
    SELECT s AS symbol, p AS "partition", 'missing' AS finding FROM g ANTI JOIN parts ON parts.symbol = s AND parts."partition" = p
    UNION ALL SELECT DISTINCT symbol, "partition", 'unexpected' FROM parts WHERE "partition" NOT IN ('train', 'validation')""",
)
def grid_complete(spark, sf):
    rows = I.pairs(spark, sf, True)
    axes = {
        "symbol": ["click", "error", "purchase", "signup", "view", "search"],
        "partition": ["train", "validation"],
    }
    return audits.grid_complete(rows, axes)


@case(
    "H14_hash_ledger",
    """SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 11 = 0 THEN 'absent' WHEN page_id % 7 = 0 THEN 'changed' ELSE 'match' END AS state FROM pages""",
)
def hash_ledger(spark, sf):
    pages = I.table(spark, sf, "pages").select("page_id", "html")
    path = F.col("page_id").cast("string").alias("path")
    recorded = F.when(F.col("page_id") % 7 == 0, F.concat(F.col("html"), F.lit("!"))).otherwise(F.col("html"))
    ledger = pages.select(path, F.sha2(recorded, 256).alias("sha256"))
    files = pages.where("page_id % 11 <> 0").select(path, F.sha2("html", 256).alias("sha256"))
    return audits.verify_ledger(ledger, files).select("path", "state")


