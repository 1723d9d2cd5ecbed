"""Queries for sources, row gates and time-series windows, each with its check statement."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from regimeweave.functions.predicates import not_finite, ohlc_invalid, parsed_flag
from regimeweave.functions.timing import id_block, moment
from regimeweave.operators import align, gaps, ordering, quality, reports
from regimeweave.operators import windows as W
from regimeweave.plans import inputs as I
from regimeweave.plans import sql_parts as S
from regimeweave.plans.inputs import CLASSES, N, tidy
from regimeweave.plans.sql_parts import b, r, t
from regimeweave.session import stage_path
from regimeweave.sources import candles as C
from regimeweave.sources import files as FS
from regimeweave.sources import manifests as M

QUERIES, SQL = {}, {}
BARS = "WITH " + S.bars()
BARS_T = "WITH " + S.bars(True)
IDX_T = BARS_T + ",\n" + S.idx()
PRICES_SQL = ", ".join(r(p) for p in ("open", "high", "low", "close"))


def case(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- sources and sinks -------------------------------------------------------------------


@case("A1_kline_pages", f"{BARS} SELECT {t('open_time')}, {PRICES_SQL} FROM bars")
def kline_pages(spark, sf):
    rows = I.candles(spark, sf)
    path = stage_path(spark, "pages")
    millis = F.unix_micros(F.to_timestamp(F.concat(F.col("open_time").cast("string"), F.lit("+00:00")))) / 1000
    millis = F.floor(millis).cast("bigint").cast("string")

    def page(copy, shift):
        prices = [(F.col(p) + shift).cast("string") for p in ("open", "high", "low", "close")]
        fields = F.array(millis, *prices, *[F.lit("0")] * 7)
        day = F.date_trunc("day", "open_time")
        pages = rows.groupBy(day.alias("day")).agg(F.sort_array(F.collect_list(fields)).alias("p"))
        pages.select(F.to_json("p")).write.text(f"{path}/{copy}")

    page(0, 0)
    page(1, 1000)  # a later copy of every candle, to be dropped
    return tidy(C.read_kline_pages(spark, f"{path}/*"))


@case("A2_ohlc_csv", f"{BARS} SELECT {t('open_time')}, {PRICES_SQL} FROM bars")
def ohlc_csv(spark, sf):
    path = stage_path(spark, "csv")
    text = F.concat(F.replace(F.col("open_time").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    rows = I.candles(spark, sf).select(
        F.col("low").alias("LOW"), text.alias("Timestamp"), F.col("open").alias("Open"),
        F.col("close").alias("close"), F.col("high").alias(" High"),
    )
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return tidy(C.read_ohlc(spark, path))


@case("A2_ohlc_layouts", f"{BARS} SELECT {t('open_time')}, {PRICES_SQL} FROM bars")
def ohlc_layouts(spark, sf):
    """Two layouts side by side: other names, another order, a further column."""
    path = stage_path(spark, "layouts")
    text = F.concat(F.replace(F.col("open_time").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    rows = I.candles(spark, sf)
    early = F.col("open_time") < F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    one = rows.where(early).select(text.alias("date"), "open", "high", "low", "close")
    two = rows.where(~early).select(F.lit("x").alias("note"), "close", F.col("low").alias("Low"), "high", F.col("open").alias("OPEN"), text.alias("time"))
    for name, part in (("one", one), ("two", two)):
        part.write.option("header", True).csv(f"{path}/layout={name}")
    return tidy(C.read_ohlc(spark, path).select("open_time", "open", "high", "low", "close"))


@case(
    "A3_union_sources",
    f"""WITH {S.bars()}, tagged AS (SELECT 'old' AS source_id, 0 AS k, * FROM bars WHERE open_time < TIMESTAMP '2024-01-16'
    UNION ALL SELECT 'new', 1, * REPLACE (close + 1 AS close, high + 1 AS high) FROM bars WHERE open_time >= TIMESTAMP '2024-01-15')
    SELECT source_id, {t('open_time')}, {PRICES_SQL} FROM tagged QUALIFY row_number() OVER (PARTITION BY open_time ORDER BY k) = 1""",
)
def union_sources(spark, sf):
    rows = I.candles(spark, sf).drop("symbol")
    old = rows.where("open_time < timestamp_ntz'2024-01-16 00:00:00'")
    new = rows.where("open_time >= timestamp_ntz'2024-01-15 00:00:00'").withColumns(
        {"close": F.col("close") + 1, "high": F.col("high") + 1}
    )
    return tidy(C.union_sources({"old": old, "new": new}, merge=True))


PAIR_SQL = f"""pair_id, "partition", {b('chronological_rank')}, {b('input_start_index')}, {b('target_stop_index')},
  {t('input_start_time')}, {t('target_stop_time')}, {b('input_cluster_id')}, {b('target_cluster_id')}"""
PAIR_COLUMNS = [
    "pair_id", "partition", "chronological_rank", "input_start_index", "target_stop_index",
    "input_start_time", "target_stop_time", "input_cluster_id", "target_cluster_id",
]


@case("A4_A5_manifest_roundtrip", f"{S.base(upto='parts')} SELECT {PAIR_SQL} FROM parts")
def manifest_roundtrip(spark, sf):
    rows = reports.with_shuffle_rank(I.pairs(spark, sf).select(*PAIR_COLUMNS), 42)
    root = stage_path(spark, "manifests")
    M.write_manifest_set(rows, root)
    contract = M.Contract(
        rows.schema,
        domains={"target_cluster_id": CLASSES, "partition": tuple(I.PERIODS)},
        finite=("chronological_rank",),
        empty=True,
    )
    back = M.read_manifest(spark, f"{root}/shuffled", contract)
    return tidy(back.select(*PAIR_COLUMNS))


@case("A6_pairs_parquet", f"{S.base(upto='parts')} SELECT {PAIR_SQL}, {r('t0', 'target_distance_cluster_0')} FROM parts")
def pairs_parquet(spark, sf):
    rows = I.pairs(spark, sf)
    return tidy(rows.select(*PAIR_COLUMNS, F.col("target_distances")[0].alias("target_distance_cluster_0")))


@case(
    "A7_H4_report_roundtrip",
    f"""{S.base(upto='parts')} SELECT "partition", {b('count(*)', 'rows')} FROM parts GROUP BY 1""",
)
def report_roundtrip(spark, sf):
    rows = I.pairs(spark, sf)
    counts = rows.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"))
    spread = reports.distribution(rows, CLASSES).drop("percentage")
    record = reports.run_summary({"partitions": counts, "distribution": spread})
    path = stage_path(spark, "report")
    M.write_report(record, path)
    line = spark.read.text(path).select(F.from_json("value", "record string").alias("v"))
    parsed = F.from_json("v.record", "partitions array<struct<partition:string,rows:bigint>>")
    return tidy(line.select(F.inline(parsed["partitions"])))


@case(
    "A8_skip_log",
    f"""{IDX_T},\n{S.cand()} SELECT symbol, {b('row_index', 'start_index')}, 'timestamp_gap_inside_30_candle_window' AS reason
    FROM cand WHERE oks <> 29""",
)
def skip_log(spark, sf):
    path = stage_path(spark, "skips")
    M.write_skips(W.skipped_windows(I.runs(spark, sf, True), N), path)
    back = spark.read.schema("symbol string, start_index bigint, reason string").json(path)
    return tidy(back)


@case(
    "A9_vector_store",
    f"SELECT vec_id, {b('label')}, {b('len(embedding)', 'dims')}, {r('list_sum(embedding)', 'total')} FROM embeddings",
)
def vector_store(spark, sf):
    path = stage_path(spark, "vectors")
    M.write_features(I.table(spark, sf, "embeddings"), path, "vec_id", ["embedding"])
    back = M.read_features(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return tidy(back.select("vec_id", "label", F.size("embedding").alias("dims"), total.alias("total")))


@case("A10_file_hashes", "SELECT item_id, sha256(text || chr(10)) AS sha256 FROM benchmark")
def file_hashes(spark, sf):
    path = stage_path(spark, "texts")
    # single-line texts, one file each
    I.table(spark, sf, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    hashed = FS.hash_files(spark, path, "*.txt")
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint")
    return hashed.select(item.alias("item_id"), "sha256")


@case(
    "A11_sample_listing",
    f"{S.base(True, 'win')} SELECT symbol, sample_name, {b('start_index')}, {b('stop_index')}, {b('30', 'window_length')} FROM win",
)
def sample_listing(spark, sf):
    found = I.windows(spark, sf, True)
    paths = found.select(
        "symbol", F.explode(F.array(
            F.concat(F.lit("root/"), F.col("sample_name"), F.lit("/images/candlestick.jpg")),
            F.concat(F.lit("root/samples_"), F.col("start_index").cast("string"), F.lit("/readme.txt")),
        )).alias("path"),
    )
    return tidy(FS.samples_from_paths(paths).drop("path"))


@case(
    "A14_cache_compatible",
    f"""{S.base(True, 'win')} SELECT {b('count(*)', 'rows_stored')}, {b('count(*)', 'rows_current')},
    {b('0', 'only_stored')}, {b('0', 'only_current')}, true AS compatible FROM win""",
)
def cache_compatible(spark, sf):
    run_table = I.runs(spark, sf, True)
    keys = ["symbol", "sample_name", "start_index", "stop_index"]

    def ranked(df):
        return ordering.with_position(df.select(*keys), ["symbol"], ["start_index"], id_block(F.col("start_index"), 1_000_000), "rank")

    path = stage_path(spark, "cache")
    ranked(W.build_windows(run_table, N)).write.parquet(path)
    stored = spark.read.parquet(path)
    spans = W.build_spans(run_table, 20, 10).select(
        "symbol",
        W.sample_name(F.col("input_start_index"), F.col("target_stop_index")).alias("sample_name"),
        F.col("input_start_index").alias("start_index"),
        F.col("target_stop_index").alias("stop_index"),
    )
    return tidy(align.same_keys(stored, ranked(spans), keys, "rank"))


# --- row gates ---------------------------------------------------------------------------

TEXT_SQL = """texts AS (SELECT symbol, open_time,
  CASE WHEN hour(open_time) % 7 = 0 THEN 'n/a' WHEN hour(open_time) % 7 = 1 THEN 'NaN' ELSE CAST(close AS VARCHAR) END AS close_text,
  CASE WHEN hour(open_time) % 5 = 0 THEN 'yesterday' ELSE strftime(open_time, '%Y-%m-%dT%H:%M:%SZ') END AS time_text FROM bars)"""


@case(
    "B1_coerce",
    f"""{BARS},\n{TEXT_SQL} SELECT {t('open_time')},
    {r('CASE WHEN hour(open_time) % 7 >= 2 THEN CAST(close_text AS DOUBLE) END', 'close_value')},
    {t('CASE WHEN hour(open_time) % 5 <> 0 THEN open_time END', 'time_value')} FROM texts""",
)
def coerce(spark, sf):
    hour = F.hour("open_time")
    text = F.when(hour % 7 == 0, "n/a").when(hour % 7 == 1, "NaN").otherwise(F.col("close").cast("string"))
    iso = F.concat(F.replace(F.col("open_time").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    rows = I.bars(spark, sf).select(
        "open_time", text.alias("close_value"), F.when(hour % 5 == 0, "yesterday").otherwise(iso).alias("time_value")
    )
    return tidy(quality.coerce(rows, ["time_value"], ["close_value"]))


@case(
    "B2_reject_examples",
    f"{BARS_T} SELECT symbol, {t('open_time')} FROM bars WHERE close < open ORDER BY symbol, bars.open_time LIMIT 10",
)
def reject_examples(spark, sf):
    return tidy(quality.examples(I.bars(spark, sf, True), F.col("close") < F.col("open"), ["symbol", "open_time"]))


@case(
    "B2_B7_B16_violations",
    """SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
      SELECT 'label_outside_domain' AS rule, count(*) FILTER (WHERE label NOT BETWEEN 0 AND 7) AS violations FROM embeddings
      UNION ALL SELECT 'wrong_dimension', count(*) FILTER (WHERE len(embedding) <> 64) FROM embeddings
      UNION ALL SELECT 'negative_first', count(*) FILTER (WHERE embedding[1] < 0) FROM embeddings)""",
)
def violations(spark, sf):
    rows = I.table(spark, sf, "embeddings")
    return tidy(
        quality.violations(
            rows,
            {
                "label_outside_domain": ~F.col("label").isin(*range(8)),
                "wrong_dimension": F.size("embedding") != 64,
                "negative_first": F.col("embedding")[0] < 0,
            },
        )
    )


@case(
    "B3_drop_invalid",
    "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL",
)
def drop_invalid(spark, sf):
    joined = I.table(spark, sf, "documents").select("doc_id").join(I.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    kept, _ = quality.drop_invalid(joined, ["quality"])
    return tidy(kept)


@case(
    "B4_dedupe_first",
    f"""SELECT user_id, event_id, event_type, {r('value')} FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def dedupe_first(spark, sf):
    events = I.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return tidy(quality.dedupe_first(events, ["user_id"], ["ts", "event_id"]).drop("ts"))


@case("B5_duplicated_keys", "SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicated_keys(spark, sf):
    return quality.duplicated_keys(I.table(spark, sf, "events"), ["user_id", "event_type"])


@case(
    "B6_ohlc_invalid",
    f"""WITH {S.bars(True, valid=False)}, bent AS (SELECT * REPLACE (CASE WHEN hour(open_time) = 3 THEN low - 1 ELSE high END AS high,
      CASE WHEN hour(open_time) = 5 THEN NULL ELSE close END AS close) FROM bars)
    SELECT symbol, {b('count(*)', 'rows')}, {b('count(*) FILTER (WHERE high IS NULL OR close IS NULL OR low <= 0 OR high < greatest(open, low, close) OR low > least(open, high, close))', 'invalid')}
    FROM bent GROUP BY 1""",
)
def ohlc_validity(spark, sf):
    hour = F.hour("open_time")
    bent = I.bars(spark, sf, True, valid=False).withColumns(
        {"high": F.when(hour == 3, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(hour != 5, F.col("close"))}
    )
    return tidy(bent.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ohlc_invalid()).alias("invalid")))


@case(
    "B7_not_finite",
    """SELECT event_type, count(*) FILTER (WHERE value < 30) AS not_finite, count(*) AS rows FROM events GROUP BY 1""",
)
def finite_check(spark, sf):
    bent = (
        F.when(F.col("value") < 10, F.lit(float("inf")))
        .when(F.col("value") < 20, F.lit(float("nan")))
        .when(F.col("value") >= 30, F.col("value"))
    )
    rows = I.table(spark, sf, "events").select("event_type", bent.alias("x"))
    return tidy(
        rows.groupBy("event_type").agg(F.count_if(not_finite(F.col("x"))).alias("not_finite"), F.count(F.lit(1)).alias("rows"))
    )


LO, HI = datetime(2024, 1, 5), datetime(2024, 1, 12, 23)


@case(
    "B8_slice_period",
    f"""{BARS} SELECT {t('open_time')}, {b('row_number() OVER (ORDER BY bars.open_time) - 1', 'period_index')}, {r('close')}
    FROM bars WHERE open_time BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'""",
)
def slice_period(spark, sf):
    rows = quality.slice_period(I.candles(spark, sf), LO, HI, check=False)
    return tidy(rows.select("open_time", "period_index", "close"))


@case(
    "B8_period_ends",
    f"""{BARS_T} SELECT symbol, bool_or(open_time = TIMESTAMP '{LO}') AS has_start, bool_or(open_time = TIMESTAMP '{HI}') AS has_end
    FROM bars GROUP BY 1""",
)
def period_ends(spark, sf):
    return quality.period_ends(I.bars(spark, sf, True), LO, HI)


CUT = datetime(2024, 1, 21)


@case(
    "B9_check_boundary",
    f"""{BARS} SELECT {t('min(open_time) FILTER (WHERE open_time < c)', 'first_start')}, {t('max(open_time) FILTER (WHERE open_time < c)', 'first_end')},
    {t('min(open_time) FILTER (WHERE open_time >= c)', 'second_start')}, {t('max(open_time) FILTER (WHERE open_time >= c)', 'second_end')},
    CAST(0 AS BIGINT) AS overlapping_timestamps, true AS first_start_ok, true AS first_end_ok, true AS second_start_ok, true AS second_end_ok,
    CAST(3600 AS DOUBLE) AS gap_seconds, CAST(0 AS BIGINT) AS inner_missing, true AS passed FROM bars, (SELECT TIMESTAMP '{CUT}' AS c)""",
)
def check_boundary(spark, sf):
    rows = I.candles(spark, sf)
    cut = moment(CUT)
    expected = {
        "first_start": datetime(2024, 1, 1), "first_end": datetime(2024, 1, 20, 23),
        "second_start": CUT, "second_end": datetime(2024, 1, 30, 23),
    }
    return tidy(
        quality.check_boundary(
            rows.where(F.col("open_time") < cut), rows.where(F.col("open_time") >= cut), expected, gaps.HOUR, [datetime(2024, 1, 10)]
        )
    )


@case("B10_row_index", f"{IDX_T} SELECT symbol, {t('open_time')}, {b('row_index')} FROM idx")
def row_index(spark, sf):
    return tidy(quality.with_row_index(I.candles(spark, sf, True)).select("symbol", "open_time", "row_index"))


@case(
    "B11_prefixed",
    f"{S.base(True, 'win')} SELECT symbol AS input_symbol, sample_name AS input_sample_name, {b('start_index', 'input_start_index')} FROM win",
)
def prefixed(spark, sf):
    return tidy(quality.prefixed(I.windows(spark, sf, True), "input_", ["symbol", "sample_name", "start_index"]))


@case(
    "B12_canonical_path",
    f"{S.base(True, 'win')} SELECT symbol, {b('start_index')}, 'images/' || sample_name || '.jpg' AS input_image FROM win",
)
def canonical_path(spark, sf):
    found = I.windows(spark, sf, True)
    rows = found.select(
        "symbol", "start_index", F.concat(F.lit("images/"), F.col("sample_name"), F.lit(".jpg")).alias("input_image_path")
    )
    return tidy(quality.canonicalize(rows))


@case(
    "B13_flags",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE quality = 1 END AS flag FROM labels""",
)
def flags(spark, sf):
    q, d = F.col("quality"), F.col("doc_id") % 5
    yes = F.when(d == 0, "TRUE").when(d == 1, "true").when(d == 2, " True ").when(d == 3, "1").otherwise("yes")
    no = F.when(d == 0, "FALSE").when(d == 1, "false").when(d == 2, " False ").when(d == 3, "0").otherwise("no")
    return I.table(spark, sf, "labels").select("doc_id", parsed_flag(F.when(q == 1, yes).otherwise(no)).alias("flag"))


@case(
    "B14_candle_geometry",
    f"""{BARS_T} SELECT symbol, {t('open_time')}, {r('least(open, close)', 'body_low')}, {r('greatest(open, close)', 'body_high')},
    {r('(open + close) / 2', 'body_mid')}, {r('low', 'wick_low')}, {r('high', 'wick_high')}, open <= close AS rising FROM bars""",
)
def candle_geometry(spark, sf):
    return tidy(W.candle_geometry(I.bars(spark, sf, True)).drop("open", "high", "low", "close"))


MEMBERS = """mem AS (SELECT w.symbol, w.start_index, i.row_index - w.start_index AS position, i.open, i.high, i.low, i.close, w.top, w.bottom
  FROM win w JOIN idx i ON i.symbol = w.symbol AND i.row_index BETWEEN w.start_index AND w.start_index + 29)"""


@case(
    "B14b_padded_geometry",
    f"""{S.base(True, 'win')},\n{MEMBERS}, flat AS (SELECT *, CASE WHEN position % 3 = 0 THEN open ELSE close END AS c,
      least(open, CASE WHEN position % 3 = 0 THEN open ELSE close END) AS lo, greatest(open, CASE WHEN position % 3 = 0 THEN open ELSE close END) AS hi FROM mem),
    lifted AS (SELECT *, CASE WHEN hi = lo THEN lo + greatest(greatest(top - bottom, 1e-12) * 0.001, 1e-12) ELSE hi END AS up,
      greatest(top - bottom, abs(top) * 1e-6, 1e-12) AS axis FROM flat)
    SELECT symbol, {b('start_index')}, {b('position')}, {r('lo', 'body_low')}, {r('up', 'body_high')}, {r('(lo + up) / 2', 'body_mid')},
    {r('low', 'wick_low')}, {r('high', 'wick_high')}, c >= open AS rising, {r('-0.5', 'axis_x_low')}, {r('29.5', 'axis_x_high')},
    {r('bottom - axis * 0.02', 'axis_y_low')}, {r('top + axis * 0.02', 'axis_y_high')} FROM lifted""",
)
def padded_geometry(spark, sf):
    arrays = W.window_arrays(I.runs(spark, sf, True), N).drop("start_time")
    level = F.transform("closes", lambda c, i: F.when(i % 3 == 0, F.get("opens", i)).otherwise(c))
    return tidy(W.padded_geometry(arrays.withColumn("closes", level)))


@case("B15_stride", f"{S.base(True, 'win')} SELECT symbol, {b('start_index')} FROM win WHERE start_index % 7 = 0")
def stride(spark, sf):
    return tidy(W.stride_filter(I.windows(spark, sf, True), 7).select("symbol", "start_index"))


# --- windows -----------------------------------------------------------------------------


@case(
    "C1_gap_events",
    f"""{IDX_T} SELECT symbol, {b('row_index')}, {t('prev_time')}, {t('open_time')},
    {r('epoch(open_time) - epoch(prev_time)', 'gap_seconds')} FROM idx WHERE prev_time IS NOT NULL AND step_ok = 0""",
)
def gap_events(spark, sf):
    return tidy(gaps.gap_events(I.runs(spark, sf, True)))


MISSING = """slots AS (SELECT symbol, unnest(generate_series(min(open_time), max(open_time), INTERVAL '1 hour')) AS open_time FROM bars GROUP BY 1),
missing AS (SELECT * FROM slots ANTI JOIN bars USING (symbol, open_time))"""


@case("C2_missing_slots", f"{BARS_T},\n{MISSING} SELECT symbol, {t('open_time')} FROM missing")
def missing_slots(spark, sf):
    return tidy(gaps.missing_slots(I.candles(spark, sf, True)))


@case(
    "C3_contiguous_ranges",
    f"""{IDX_T},\n{S.cand()} SELECT symbol, {b('min(row_index)', 'first')}, {b('max(row_index)', 'last')}, {b('count(*)', 'count')}
    FROM (SELECT symbol, row_index, row_index - row_number() OVER (PARTITION BY symbol ORDER BY row_index) AS island
          FROM cand WHERE oks <> 29) GROUP BY symbol, island""",
)
def contiguous_ranges(spark, sf):
    return tidy(gaps.skipped_start_ranges(I.runs(spark, sf, True), N))


@case(
    "C3_user_ranges",
    """SELECT event_type, min(user_id) AS first, max(user_id) AS last, count(*) AS count FROM (
      SELECT event_type, user_id, user_id - row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS island
      FROM (SELECT DISTINCT event_type, user_id FROM events)) GROUP BY event_type, island""",
)
def user_ranges(spark, sf):
    return ordering.contiguous_ranges(I.table(spark, sf, "events"), "user_id", ["event_type"])


@case(
    "C4_audit",
    f"""WITH {S.bars(True, valid=False)},\n{S.idx().replace('ln(close / lag(close) OVER w)', '0.0')},\n{MISSING},
    c AS (SELECT *, sum(step_ok) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 29 FOLLOWING) AS oks FROM idx),
    m AS (SELECT symbol, count(*) AS missing FROM missing GROUP BY 1)
    SELECT c.symbol, {b('count(*)', 'rows')}, {t('min(open_time)', 'date_start')}, {t('max(open_time)', 'date_end')},
    {b('0', 'timestamps_unparseable')}, {b('0', 'duplicate_timestamps')}, {b('coalesce(any_value(missing), 0)', 'missing_slot_count')},
    {b('count(*) FILTER (WHERE prev_time IS NOT NULL AND step_ok = 0)', 'gap_event_count')},
    {b('count(*) FILTER (WHERE low <= 0)', 'invalid_ohlc_rows')}, {b('30', 'window_size')},
    {b('count(*) FILTER (WHERE row_index <= max_index - 29)', 'candidate_windows')},
    {b('count(*) FILTER (WHERE row_index <= max_index - 29 AND oks = 29)', 'valid_windows')},
    {b('count(*) FILTER (WHERE row_index <= max_index - 29 AND oks <> 29)', 'skipped_windows')}
    FROM c LEFT JOIN m USING (symbol) GROUP BY c.symbol""",
)
def audit(spark, sf):
    return tidy(gaps.audit_candles(I.candles(spark, sf, True, valid=False), N))


@case("C5_valid_starts", f"{S.base(True, 'win')} SELECT symbol, {b('start_index')}, {t('start_time')} FROM win")
def valid_starts(spark, sf):
    return tidy(W.valid_starts(I.runs(spark, sf, True), N))


@case(
    "C6_windows",
    f"""{S.base(True, 'win')} SELECT symbol, sample_name, {b('start_index')}, {b('stop_index')}, {b('30', 'window_length')},
    {t('start_time')}, {t('stop_time')} FROM win""",
)
def windows(spark, sf):
    return tidy(I.windows(spark, sf, True))


FIRST_GAP = """bad AS (SELECT symbol, row_index, prev_time, open_time FROM idx WHERE step_ok = 0 AND prev_time IS NOT NULL),
gap AS (SELECT c.symbol, c.row_index, min(g.row_index) AS at FROM cand c JOIN bad g ON g.symbol = c.symbol
        AND g.row_index > c.row_index AND g.row_index <= c.row_index + 29 WHERE c.oks <> 29 GROUP BY ALL)"""


@case(
    "C6_skipped_windows",
    f"""{IDX_T},\n{S.cand()},\n{FIRST_GAP} SELECT c.symbol, 'sample_' || c.row_index || '_' || c.stop_index AS sample_name,
    {b('c.row_index', 'start_index')}, {b('c.stop_index', 'stop_index')}, {t('c.open_time', 'start_time')}, {t('c.stop_time', 'stop_time')},
    'timestamp_gap_inside_30_candle_window' AS reason, {t('b.prev_time', 'gap_after_time')}, {t('b.open_time', 'next_time')}
    FROM gap g JOIN cand c ON c.symbol = g.symbol AND c.row_index = g.row_index JOIN bad b ON b.symbol = g.symbol AND b.row_index = g.at""",
)
def skipped_windows(spark, sf):
    return tidy(W.skipped_windows(I.runs(spark, sf, True), N))


SPANS_SQL = f"{IDX_T},\n{S.cand(40, 'span')}"


@case(
    "C7_spans",
    f"""{SPANS_SQL} SELECT symbol, 'sample_' || row_index || '_' || (row_index + 29) AS sample_name,
    'sample_' || (row_index + 30) || '_' || stop_index AS target_sample_name,
    {b('row_index', 'input_start_index')}, {b('row_index + 29', 'input_stop_index')}, {b('row_index + 30', 'target_start_index')},
    {b('stop_index', 'target_stop_index')}, {t('open_time', 'input_start_time')}, {t("open_time + INTERVAL '29 hours'", 'input_stop_time')},
    {t("open_time + INTERVAL '30 hours'", 'target_start_time')}, {t('stop_time', 'target_stop_time')} FROM span WHERE oks = 39""",
)
def spans(spark, sf):
    return tidy(W.build_spans(I.runs(spark, sf, True), 30, 10))


@case(
    "C7_skipped_spans",
    f"""{SPANS_SQL} SELECT symbol, {b('row_index', 'input_start_index')}, {t('open_time', 'input_start_time')},
    'timestamp_gap_within_input_or_target' AS reason FROM span WHERE oks <> 39
    UNION ALL SELECT symbol, {b('row_index', 'input_start_index')}, {t('open_time', 'input_start_time')}, 'incomplete_40_candle_span'
    FROM idx WHERE row_index > max_index - 39""",
)
def skipped_spans(spark, sf):
    return tidy(W.skipped_spans(I.runs(spark, sf, True), 30, 10, with_tail=True))


@case(
    "C8_window_arrays",
    f"""{S.base(True, 'win')},\n{MEMBERS} SELECT symbol, {b('start_index')}, {b('position')}, {PRICES_SQL} FROM mem""",
)
def window_arrays(spark, sf):
    arrays = W.window_arrays(I.runs(spark, sf, True), N)
    zipped = F.arrays_zip("opens", "highs", "lows", "closes")
    rows = arrays.select("symbol", "start_index", F.posexplode(zipped).alias("position", "c"))
    return tidy(
        rows.select(
            "symbol", "start_index", "position", F.col("c.opens").alias("open"), F.col("c.highs").alias("high"),
            F.col("c.lows").alias("low"), F.col("c.closes").alias("close"),
        )
    )


@case(
    "C9_shape_features",
    f"""{S.base(True, 'win')},\n{MEMBERS}, long AS (
      SELECT *, position AS p, open AS x FROM mem UNION ALL SELECT *, position + 30, high FROM mem
      UNION ALL SELECT *, position + 60, low FROM mem UNION ALL SELECT *, position + 90, close FROM mem)
    SELECT symbol, {b('start_index')}, {b('p', 'position')}, {r('(x - bottom) / greatest(top - bottom, 1e-12)', 'value')} FROM long""",
)
def shape_features(spark, sf):
    arrays = W.window_arrays(I.runs(spark, sf, True), N)
    rows = W.shape_features(arrays).select("symbol", "start_index", F.posexplode("shape").alias("position", "value"))
    return tidy(rows)


@case(
    "C10_scale_features",
    f"""{S.base(True, 'win')} SELECT symbol, {b('start_index')}, {t('start_time')}, {r('log_return')}, {r('volatility')},
    {r('mean_abs_return')}, {r('(top - bottom) / last_close', 'range_ratio')} FROM win""",
)
def scale_features(spark, sf):
    return tidy(W.scale_features(I.runs(spark, sf, True), N))


@case("C11_chronological_rank", f"""{S.base(upto='parts')} SELECT pair_id, "partition", {b('chronological_rank')} FROM parts""")
def chronological_rank(spark, sf):
    return tidy(I.pairs(spark, sf).select("pair_id", "partition", "chronological_rank"))


SHUFFLE = "(chronological_rank * 7919 + 42 * 104729) % 1000003"


@case(
    "C12_shuffle_rank",
    f"""{S.base(upto='parts')} SELECT pair_id, "partition", {b('chronological_rank')},
    {b(f'row_number() OVER (PARTITION BY "partition" ORDER BY {SHUFFLE}, pair_id) - 1', 'shuffled_rank')} FROM parts""",
)
def shuffle_rank(spark, sf):
    rows = I.pairs(spark, sf).select("pair_id", "partition", "chronological_rank")
    return tidy(reports.with_shuffle_rank(rows, 42, rank_expr=F.expr(SHUFFLE)))


@case(
    "C13_monotonic",
    """SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE p > ts) = 0 AS monotonic, count(*) FILTER (WHERE p > ts) AS falls
    FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) GROUP BY 1""",
)
def monotonic(spark, sf):
    return ordering.is_monotonic(
        I.table(spark, sf, "events"), ["event_id"], id_block(F.col("event_id"), 1_000_000), "ts", ["event_type"]
    )
