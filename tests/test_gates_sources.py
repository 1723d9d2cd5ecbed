"""Gates, sources and sinks."""

import hashlib
import json
import struct
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from regimeweave.functions import predicates as P
from regimeweave.functions import timing
from regimeweave.operators import align, audits, lookups, quality, reports
from regimeweave.sources import candles as C
from regimeweave.sources import files as FS
from regimeweave.sources import manifests as M
from tests.helpers import candles


def test_coercion_turns_bad_values_into_null(spark):
    df = spark.createDataFrame([("1.5", "2024-01-01T00:00:00Z"), ("x", "soon"), ("NaN", None)], "n string, t string")
    rows = quality.coerce(df, ["t"], ["n"]).collect()
    assert [r.n for r in rows] == [1.5, None, None]
    assert rows[0].t.isoformat() == "2024-01-01T00:00:00" and rows[1].t is None


def test_offsets_are_converted_to_utc(spark):
    texts = [
        "2024-01-01T03:00:00+02:00", "2024-01-01 03:00:00.5 -0530", "2024-01-01T03:00Z", "2024-01-01", "2024-01-01 03:00:00 UTC",
        "2024-01-01 03:00:00+00:00", "later",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0].isoformat() if r[0] else None for r in df.orderBy("i").select(P.timestamp_utc(F.col("t"))).collect()]
    assert got == [
        "2024-01-01T01:00:00", "2024-01-01T08:30:00.500000", "2024-01-01T03:00:00", "2024-01-01T00:00:00",
        "2024-01-01T03:00:00", "2024-01-01T03:00:00", None,
    ]


def test_ohlc_rules(spark):
    rows = [(10.0, 12.0, 9.0, 11.0), (10.0, 9.0, 8.0, 9.5), (10.0, 12.0, 10.5, 11.0), (0.0, 1.0, 0.0, 1.0), (None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "open double, high double, low double, close double")
    assert [r[0] for r in df.select(P.ohlc_invalid()).collect()] == [False, True, True, True, True, True]


def test_gate_reports_count_and_examples(spark):
    df = spark.range(100)
    with pytest.raises(quality.GateError, match="20 rows.*0,.*5,"):
        quality.require_none(df, F.col("id") % 5 == 0, ["id"], "multiples")
    assert quality.require_none(df, F.col("id") < 0, ["id"], "negative") is df


def test_keep_first_and_reject_all(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "k int, i int, v string")
    assert sorted(r.v for r in quality.dedupe_first(df, ["k"], ["i"]).collect()) == ["a", "c"]
    with pytest.raises(quality.GateError):
        quality.require_unique(df, ["k"])
    assert quality.duplicated_keys(df, ["k"]).collect()[0].rows == 2


def test_drop_count_is_observed(spark):
    df = spark.createDataFrame([(1.0,), (None,), (None,)], "x double")
    kept, seen = quality.drop_invalid(df, ["x"])
    assert kept.count() == 1 and seen.get["dropped"] == 2


def test_flags(spark):
    df = spark.createDataFrame([(" True ",), ("0",), ("maybe",)], "s string")
    assert [r[0] for r in df.select(P.parsed_flag(F.col("s"))).collect()] == [True, False, None]
    with pytest.raises(Exception, match="not a boolean: maybe"):
        df.select(P.strict_flag(F.col("s"))).collect()


def test_path_column_is_canonicalised(spark):
    one = spark.createDataFrame([("a/b.jpg",)], "input_image_path string")
    assert quality.canonicalize(one).columns == ["input_image"]
    same = spark.createDataFrame([("a\\b.jpg", "a/b.jpg")], "input_image string, input_image_path string")
    assert quality.canonicalize(same).count() == 1
    other = spark.createDataFrame([("a/b.jpg", "a/c.jpg")], "input_image string, input_image_path string")
    with pytest.raises(quality.GateError):
        quality.canonicalize(other)


def test_domain_and_finite_gates(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 5, float("inf"))], "id int, c int, x double")
    with pytest.raises(quality.GateError):
        quality.require_domain(df, "c", [0, 1, 2], ["id"])
    with pytest.raises(quality.GateError):
        quality.require_finite(df, ["x"], ["id"])


def test_lookup_refuses_two_rows_for_a_class(spark):
    table = spark.createDataFrame([(0, 1.0), (0, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        lookups.with_lookup(spark.range(1), table, "k", "v", [0, 1], "x", "id").collect()


def test_kline_pages_keep_the_first_copy(spark, tmp_path):
    def row(ms, close):
        return [ms, "1.0", "2.0", "0.5", close, "9", ms + 1, "0", 3, "0", "0", "0"]

    (tmp_path / "p0.json").write_text(json.dumps([row(0, "1.5"), row(3_600_000, "bad")]) + "\n")
    (tmp_path / "p1.json").write_text(json.dumps([row(3_600_000, "7"), row(7_200_000, "8")]) + "\n")
    rows = C.read_kline_pages(spark, str(tmp_path)).orderBy("open_time").collect()
    assert [r.open_time.hour for r in rows] == [0, 1, 2]
    assert [r.close for r in rows] == [1.5, None, 8.0]


def test_csv_columns_by_alias_and_by_configuration(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,OPEN,High,low,Close,Settle\n2024-01-01 00:00:00+00:00,1,2,0.5,1.5,9\nnever,x,2,0.5,1.5,9\n")
    rows = C.read_ohlc(spark, str(tmp_path / "a.csv")).collect()
    assert rows[0].close == 1.5 and rows[1].open_time is None and rows[1].open is None
    named = C.read_ohlc(spark, str(tmp_path / "a.csv"), {"close": "settle"}).first()
    assert named.close == 9.0
    assert C.resolve_columns(["TIME", "open", "high", "low", "close"], {"open_time": "when"})["open_time"] == "TIME"
    with pytest.raises(quality.GateError):
        C.resolve_columns(["open_time", "open", "high", "low"])


def test_sources_stay_apart_or_merge(spark):
    a, b = candles(spark, [0, 1]).drop("symbol"), candles(spark, [1, 2], price=lambda i: 50.0).drop("symbol")
    assert C.union_sources({"a": a, "b": b}).count() == 4
    merged = C.union_sources({"a": a, "b": b}, merge=True).orderBy("open_time").collect()
    assert [r.source_id for r in merged] == ["a", "a", "b"]


def _pairs(spark):
    rows = [(f"p{i}", "train" if i < 6 else "test", i, i % 3) for i in range(9)]
    return spark.createDataFrame(rows, "pair_id string, partition string, chronological_rank bigint, target_cluster_id int")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_manifest_roundtrip_and_modes(spark, tmp_path, fmt):
    pairs, path = _pairs(spark), str(tmp_path / fmt)
    contract = M.Contract(pairs.schema, domains={"target_cluster_id": [0, 1, 2]}, finite=["chronological_rank"])
    M.write_manifests(pairs, path, fmt=fmt)
    if fmt == "parquet":
        assert sorted(M.read_manifest(spark, path, contract).collect()) == sorted(pairs.collect())
    with pytest.raises(AnalysisException):
        M.write_manifests(pairs, path, fmt=fmt)
    M.write_manifests(pairs.limit(1), path, mode="resume", fmt=fmt)
    assert spark.read.format(fmt).option("header", True).load(path).count() == 9
    M.write_manifests(pairs.limit(2), path, mode="overwrite", fmt=fmt)
    assert spark.read.format(fmt).option("header", True).load(path).count() == 2
    with pytest.raises(ValueError):
        M.save_mode("append")


def test_manifest_contract(spark):
    pairs = _pairs(spark)
    contract = M.Contract(pairs.schema, domains={"target_cluster_id": [0, 1]})
    for bad in (pairs, pairs.drop("partition"), pairs.limit(0), pairs.unionByName(pairs)):
        with pytest.raises(quality.GateError):
            M.check_manifest(bad, contract)


def test_manifest_csv_read_back(spark, tmp_path):
    pairs = _pairs(spark)
    pairs.write.option("header", True).csv(str(tmp_path / "m"))
    back = M.read_manifest(spark, str(tmp_path / "m"), M.Contract(pairs.schema), fmt="csv")
    assert sorted(back.collect()) == sorted(pairs.collect())


def test_report_and_skip_log(spark, tmp_path):
    record = reports.run_summary({"counts": _pairs(spark).groupBy("partition").count()})
    M.write_report(record.select(F.from_json("record", "counts array<struct<partition:string,count:bigint>>").alias("r")), str(tmp_path / "r"))
    text = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert {c["partition"]: c["count"] for c in text["r"]["counts"]} == {"train": 6, "test": 3}
    with pytest.raises(quality.GateError):
        M.write_report(_pairs(spark), str(tmp_path / "r2"))
    M.write_skips(_pairs(spark).limit(1), str(tmp_path / "s"))
    assert list(json.loads(spark.read.text(str(tmp_path / "s")).first()[0])) == sorted(_pairs(spark).columns)


def test_features_are_keyed_float_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    M.write_features(df, str(tmp_path / "f"), "id", ["v"])
    assert M.read_features(spark, str(tmp_path / "f")).schema["v"].dataType.simpleString() == "array<float>"
    with pytest.raises(quality.GateError):
        M.write_features(df, str(tmp_path / "g"), "key", ["v"])


def test_hashes_and_ledger(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    found = FS.hash_files(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert {r.path: r.sha256 for r in found.collect()}["a"] == hashlib.sha256(b"a").hexdigest()
    ledger = spark.createDataFrame([("a", hashlib.sha256(b"a").hexdigest()), ("b", "0"), ("c", "0")], "path string, sha256 string")
    assert {r.path: r.state for r in audits.verify_ledger(ledger, found).collect()} == {"a": "match", "b": "changed", "c": "absent"}


def _png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = (b"\0" + b"\x7f\x00\x7f" * width) * height
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_census(spark, tmp_path):
    (tmp_path / "ok1.png").write_bytes(_png(360, 360))
    (tmp_path / "ok2.png").write_bytes(_png(360, 360))
    (tmp_path / "small.png").write_bytes(_png(10, 20))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    images = FS.read_images(spark, str(tmp_path))
    census = {(r.height, r.width): r.images for r in FS.image_census(images).collect()}
    assert census == {(360, 360): 2, (20, 10): 1, (None, None): 1}
    assert sorted(r.path.rsplit("/", 1)[1] for r in FS.bad_images(images).collect()) == ["broken.png", "small.png"]


def test_sample_names(spark):
    df = spark.createDataFrame([("x/sample_3_32/images/c.jpg",), ("x/sample_3/c.jpg",), ("sample_4_33.jpg",)], "path string")
    assert sorted((r.start_index, r.window_length) for r in FS.samples_from_paths(df).collect()) == [(3, 30), (4, 30)]


def test_path_resolution_order(spark):
    files = spark.createDataFrame([("d/a.jpg",), ("d/images/a.jpg",), ("z/b.jpg",), ("y/b.jpg",)], "path string")
    manifest = spark.createDataFrame([("a.jpg",), ("q\\b.jpg",), ("c.jpg",)], "image_path string")
    got = {r.image_path: (r.resolved_path, r.ambiguous) for r in align.resolve_paths(manifest, files, "d").collect()}
    assert got == {"a.jpg": ("d/a.jpg", 0), "q\\b.jpg": ("y/b.jpg", 1), "c.jpg": (None, 0)}


def test_column_discovery(spark):
    df = spark.createDataFrame([("2024-01-01", "a.JPG ", "2024-02-01"), ("2024-01-02", "b.png", "x")], "t string, f string, u string")
    wanted = spark.createDataFrame([("2024-01-01T00:00:00Z",)], "input_start_time string")
    best = align.pick_time_column(df, wanted).first()
    assert best.column == "t" and best.hit_share == 0.5
    assert align.pick_image_column(df).first().column == "f"


def test_strict_label_join(spark):
    samples = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(quality.GateError):
        align.attach_labels(samples, spark.createDataFrame([(1, 0)], "k int, c int"), ["k"], "c")
    with pytest.raises(quality.GateError):
        align.attach_labels(samples, spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "k int, c int"), ["k"], "c")
    assert align.attach_labels(samples, spark.createDataFrame([(1, 0), (2, 1)], "k int, c int"), ["k"], "c").count() == 2


def test_unreadable_page_stops(spark, tmp_path):
    (tmp_path / "p.json").write_text('[["0", "1", "2", "0.5", "1"]]\n\nno page\n')
    with pytest.raises(Exception, match="unreadable page"):
        C.read_kline_pages(spark, str(tmp_path)).collect()


def test_merge_needs_one_corrected_row_per_symbol_and_time(spark):
    old = spark.createDataFrame([("train", "A", "2024-01-01 00:00:00"), ("train", "B", "2024-01-01 00:00:00")], "partition string, symbol string, input_start_time string")
    new = old.selectExpr("*", "if(symbol = 'A', 1, 2) AS label", "true AS training_eligible")
    merged = align.merge_labels(old, new, ["label", "training_eligible"])
    assert {(r.symbol, r.label) for r in merged.collect()} == {("A", 1), ("B", 2)}
    with pytest.raises(Exception, match="several corrected rows"):
        align.merge_labels(old, new.union(new), ["label", "training_eligible"])


def test_steps_are_whole_seconds():
    with pytest.raises(ValueError):
        timing.seconds(timedelta(milliseconds=500))


def test_csv_files_of_different_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,open,high,low,close\n2024-01-01T00:00:00Z,1,4,0,2\n2024-01-01T01:00:00Z,5,8,4,6\n")
    (tmp_path / "b.csv").write_text("Close,note,LOW,High,Open,timestamp\n12,x,10,14,11,2024-01-01T02:00:00Z\n")
    (tmp_path / "c.csv").write_text("date,open,high,low,close\n2024-01-01T03:00:00Z,21,24,20,22\n")
    rows = C.read_ohlc(spark, str(tmp_path)).orderBy("open_time").collect()
    assert [(r.open, r.high, r.low, r.close) for r in rows] == [(1, 4, 0, 2), (5, 8, 4, 6), (11, 14, 10, 12), (21, 24, 20, 22)]
    assert len(C.header_census(spark, str(tmp_path))) == 2
    (tmp_path / "d.csv").write_text("date,open,high,low\n2024-01-01T03:00:00Z,21,24,20\n")
    with pytest.raises(quality.GateError, match="no column for close"):
        C.read_ohlc(spark, str(tmp_path))


def test_rows_without_a_time_stop_the_numbering(spark):
    rows = spark.createDataFrame([("A", datetime(2024, 1, 1), "p"), ("A", None, "q")], "symbol string, open_time timestamp_ntz, pair_id string")
    with pytest.raises(Exception, match="without a time"):
        quality.with_row_index(rows).collect()
    assert quality.with_row_index(rows.where("open_time is not null")).first().row_index == 0


def test_packed_order_keeps_the_order(spark):
    rows = [(datetime(*d), i) for d in ((1969, 12, 31, 23, 59, 59), (1970, 1, 1), (2024, 5, 6, 7, 8, 9, 123456), (9999, 12, 31)) for i in (-(2**63), -1, 0, 7, 2**63 - 1)]
    made = spark.createDataFrame(rows, "ts timestamp_ntz, id bigint").withColumn("packed", timing.packed_order(F.col("ts"), F.col("id")))
    got = [(r.ts, r.id) for r in made.orderBy("packed").collect()]
    assert got == sorted(rows) and made.where("packed is null").count() == 0
    grouped = made.groupBy().agg(F.min_by("id", "packed"))
    assert "SortAggregate" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_merge_gates(spark):
    wanted = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T01:00:00Z",)], "input_start_time string")
    names = [("2024-01-01T00:00:00Z", "a.png"), ("2024-01-01T01:00:00Z", "b.jpg"), ("2024-02-01T00:00:00Z", "c.png")]
    df = spark.createDataFrame(names, "t string, f string")
    assert align.require_merge_columns(df, wanted) == ("t", "f")
    with pytest.raises(quality.GateError, match="no time column"):
        align.require_merge_columns(df, wanted, least=0.7)
    with pytest.raises(quality.GateError, match="no image column"):
        align.require_merge_columns(df.withColumn("f", F.lit("x")), wanted)
    rows = "partition string, training_eligible boolean"
    corrected = spark.createDataFrame([("train", True), ("train", False), ("test", False), ("test", False)], rows)
    merged = spark.createDataFrame([("train", True), ("test", False), ("test", False)], rows)
    assert align.require_match(merged, corrected).count() == 3
    with pytest.raises(quality.GateError, match="test 1 of 2"):
        align.require_match(merged.limit(2), corrected)
