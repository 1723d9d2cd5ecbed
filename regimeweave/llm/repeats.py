"""Bytes covered by a long string that starts at two places of the corpus, found by refining repeated intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.llm import common as C
from regimeweave.llm.common import stage, text_of

LENGTH = 400
GRAM, WINDOW = 16, 96
UNIT = 32
FAR = 2 * (WINDOW - 1)
#: From an anchor, the stretch that every string it owns holds.
CORE = (-(WINDOW - 1), LENGTH - FAR)
_SECOND = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE2 = 0xD1342543DE82EF95
_BASE2_INVERSE = pow(_BASE2, -1, 2**64)
KEYS = ["_i", "_t"]


def anchors(data: np.ndarray, bounds: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that their surroundings choose, and the number of the text of each.

    Of every ``WINDOW`` neighbouring places of a text, the one whose ``GRAM`` following bytes have the smallest hash is
    chosen (the first of equals). So places in equal strings are chosen alike, away from their
    ends, and neighbours are at most ``WINDOW`` apart.
    """
    n = len(data) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = C.mix64((prefix[GRAM:] - prefix[:-GRAM]) * C.powers(C._BASE_INVERSE, len(prefix))[:n])
    low = h & np.uint64(0xFFFFFFFFF0000000) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < WINDOW:
        more = min(step, WINDOW - step)
        low = np.minimum(low[:-more], low[more:])
        step += more
    size = np.diff(bounds)
    valid = np.maximum(0, size - (WINDOW + GRAM - 2))
    text = np.repeat(np.arange(len(size)), valid)
    first = np.repeat(bounds[:-1] - (np.cumsum(valid) - valid), valid) + np.arange(len(text))
    place = (low[first] & np.uint64(0xFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    return place[new], text[new]


class Owned:
    """Anchors with the starts they own: ``start + WINDOW - 1 <= anchor``, nearest first.

    Windows that choose an anchor at or beyond ``start + WINDOW - 1`` lie behind the start, and the nearest is at most
    ``FAR`` behind it, so equal strings have the same anchor. All strings of an anchor hold its ``CORE``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, prefix: np.ndarray) -> None:
        at, text = anchors(data, bounds, prefix)
        begin, end = bounds[text], bounds[text + 1]
        same = np.zeros(len(at), bool)
        same[1:] = text[1:] == text[:-1]
        before = np.where(same, np.r_[0, at[:-1]] if len(at) else at, begin - 1)
        self.lo = np.where(same, np.maximum(begin, before - (WINDOW - 2)), begin)
        self.hi = np.minimum(at - (WINDOW - 1), end - LENGTH)
        self.use = self.hi >= self.lo
        self.at, self.text, self.begin = at, text, begin


def second_prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_SECOND[data] * C.powers(_BASE2, len(data)), out=out[1:])
    return out


def second_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return C.mix64((prefix[end] - prefix[start]) * C.powers(_BASE2_INVERSE, len(prefix))[start])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _keys(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(k).take(pa.array(rows)) for k in range(2)]


def core_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each anchor: the hash of its core."""
    for batch in batches:
        for first, _, data, bounds in C.text_chunks(batch, "text"):
            prefix = C.prefix_hash(data)
            o = Owned(data, bounds, prefix)
            u = o.use
            core = C.span_hash(prefix, o.at[u] + CORE[0], o.at[u] + CORE[1])
            yield pa.RecordBatch.from_arrays([*_keys(batch, first + o.text[u]), pa.array((o.at - o.begin)[u].astype(np.int32)), _long(core)], [*KEYS, "at", "core"])


def stretch_rows(batches: Iterator[pa.RecordBatch], unit: int | None) -> Iterator[pa.RecordBatch]:
    """Owned starts of the anchors in ``places``, an anchor's together or in units of ``unit``: hashes of what all
    strings of a stretch share (``part``) and of what they cover together (``s1``, ``s2``)."""
    size = unit or FAR + 1
    for batch in batches:
        for first, last, data, bounds in C.text_chunks(batch, "text"):
            prefix, other = C.prefix_hash(data), second_prefix(data)
            o = Owned(data, bounds, prefix)
            wanted = batch.column(3).slice(first, last - first)
            rows = np.repeat(np.arange(last - first), np.array([len(x) for x in wanted], np.int64))
            marks = bounds[rows] + wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.flatnonzero(np.isin(o.at, marks) & o.use)
            nearest, farthest = (o.at[k] - o.hi[k]) // size, (o.at[k] - o.lo[k]) // size
            times = farthest - nearest + 1
            at, owner = np.repeat(o.at[k], times), np.repeat(k, times)
            j = np.repeat(nearest, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            lo = np.maximum(o.lo[owner], at - size * j - (size - 1))
            hi = np.minimum(o.hi[owner], at - size * j)
            middle = at - size * j
            ends = (middle, middle + LENGTH - size + 1) if unit else (at + CORE[0], at + CORE[1])
            part = C.span_hash(prefix, *ends) + j.astype(np.uint64)
            begin = o.begin[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    *_keys(batch, first + o.text[owner]),
                    *[pa.array((x - begin).astype(np.int32)) for x in (at, lo, hi)],
                    _long(C.span_hash(prefix, lo, hi + LENGTH)),
                    _long(second_hash(other, lo, hi + LENGTH)),
                    _long(part),
                ],
                [*KEYS, "at", "lo", "hi", "s1", "s2", "part"],
            )


def start_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each start of the ranges in ``places``: the hash of its whole string."""
    for batch in batches:
        for first, last, data, bounds in C.text_chunks(batch, "text"):
            prefix, other = C.prefix_hash(data), second_prefix(data)
            wanted = batch.column(3).slice(first, last - first)
            rows = np.repeat(np.arange(last - first), np.array([len(x) for x in wanted], np.int64))
            flat = wanted.flatten()
            lo, hi = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lo", "hi"))
            times = hi - lo + 1
            row = np.repeat(rows, times)
            place = np.repeat(lo, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            p = bounds[row] + place
            yield pa.RecordBatch.from_arrays(
                [*_keys(batch, first + row), pa.array(place.astype(np.int32)), _long(C.span_hash(prefix, p, p + LENGTH)), _long(second_hash(other, p, p + LENGTH))],
                [*KEYS, "at", "s1", "s2"],
            )


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``spans`` (merged ranges to remove) and the digest of what stays."""
    names = [*KEYS, "spans", "n_removed", "kept_sha256"]
    for batch in batches:
        for first, last, data, bounds in C.text_chunks(batch, "text"):
            raw, spans, removed, digests = data.tobytes(), [], [], []
            for r in range(last - first):
                text, out, kept, at = raw[bounds[r] : bounds[r + 1]], [], hashlib.sha256(), 0
                for a, b in sorted((x["lo"], x["hi"]) for x in batch.column(3)[first + r].as_py()):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                for a, b in out:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                spans.append([{"lo": a, "hi": b} for a, b in out])
                removed.append(sum(b - a for a, b in out))
                digests.append(kept.hexdigest())
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).slice(first, last - first) for k in range(2)], pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array(digests)], names
            )


def stretches(texts: DataFrame, places: DataFrame, unit: int | None) -> tuple[DataFrame, DataFrame]:
    """Stretches of ``places`` found twice as a whole, and those to be divided further.

    The latter share their ``part`` with one that is not found as a whole; of equal whole ones, one stands for all.
    """
    rows = C.map_arrow(texts.join(places, KEYS), lambda batches: stretch_rows(batches, unit), "_i bigint, _t int, at int, lo int, hi int, s1 bigint, s2 bigint, part bigint")
    rows = stage(rows)
    place = F.xxhash64(*KEYS, "lo")
    twice = rows.groupBy("s1", "s2").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").select("s1", "s2", "_first")
    marked = rows.join(twice, ["s1", "s2"], "left").select(*KEYS, "at", "lo", "hi", "part", F.col("_first").isNotNull().alias("_whole"), F.coalesce(place == F.col("_first"), F.lit(True)).alias("_stands"))
    marked = stage(marked)
    C.drop_stage(rows)
    unsure = marked.groupBy("part").agg(F.count("*").alias("_n"), F.count_if(~F.col("_whole")).alias("_open")).where("_n > 1 and _open > 0").select("part")
    return marked.where("_whole").select(*KEYS, "lo", "hi"), marked.where("_stands").join(unsure, "part", "left_semi")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row of ``docs``.

    A byte goes if a string of ``LENGTH`` bytes that covers it starts at another place too, in
    the same text or another; strings are judged on the input and never cross texts. A null or
    shorter text loses nothing. Rows that repeat an id are texts of their own.

    Four refinements, each counting hashes as partial aggregates and carrying on with the
    places whose hash occurs twice: cores of anchors (about one row for 48 bytes), all starts of an anchor
    together, units of ``UNIT`` starts, single starts. A stretch found twice as a whole is settled; it goes on only
    as the partner of one that is not, and of equal ones only the first does. A core or shared part that occurs once
    proves its starts unique; covered stretches and single starts are compared by 128-bit hashes. Texts are hashed once per step and
    no suffix is sorted; a string of any number of copies is one row of a count. Equal texts are
    one text here, and lose all their bytes if they are long enough and there are two of them. Tables of a step are
    dropped once the next is written.
    """
    keys = {"_i": F.xxhash64(text_of()), "_t": F.hash(text_of())}
    long = docs.select(*[v.alias(k) for k, v in keys.items()], text_of().alias("text")).where(F.octet_length("text") >= LENGTH)
    cores = stage(C.map_arrow(long, core_rows, "_i bigint, _t int, at int, core bigint"))
    place = F.xxhash64("_i", "at")
    twice = cores.groupBy("core").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a < _b").select("core")
    places = stage(cores.join(twice, "core", "left_semi").groupBy(*KEYS).agg(F.collect_set("at").alias("places")))
    C.drop_stage(cores)
    # copies become one before they are met, on both sides of the shuffle
    texts = stage(long.groupBy(*KEYS).agg(F.first("text").alias("text")).join(places.select(*KEYS), KEYS, "left_semi"))

    found, open_anchors = stretches(texts, places, None)
    places = open_anchors.groupBy(*KEYS).agg(F.collect_set("at").alias("places"))
    more, open_units = stretches(texts, places, UNIT)
    places = open_units.groupBy(*KEYS).agg(F.collect_list(F.struct("lo", "hi")).alias("places"))
    starts = stage(C.map_arrow(texts.join(places, KEYS), start_rows, "_i bigint, _t int, at int, s1 bigint, s2 bigint"))
    same = starts.groupBy("s1", "s2").agg(F.count("*").alias("_n")).where("_n > 1").select("s1", "s2")
    single = starts.join(same, ["s1", "s2"], "left_semi").select(*KEYS, F.col("at").alias("lo"), F.col("at").alias("hi"))
    ranges = found.unionByName(more).unionByName(single).groupBy(*KEYS).agg(F.collect_list(F.struct("lo", (F.col("hi") + LENGTH).alias("hi"))).alias("places"))
    cut = C.map_arrow(texts.join(ranges, KEYS), cut_rows, "_i bigint, _t int, spans array<struct<lo:int,hi:int>>, n_removed bigint, kept_sha256 string")
    cut = stage(cut)
    for table in (texts, starts):
        C.drop_stage(table)

    every = docs.select("doc_id", *[v.alias(k) for k, v in keys.items()], F.octet_length(text_of()).cast("bigint").alias("n_bytes"), F.sha2(text_of(), 256).alias("_sha"))
    every = stage(every)
    copies = every.where(F.col("n_bytes") >= LENGTH).groupBy(*KEYS).agg(F.count("*").alias("_n")).where("_n > 1").select(*KEYS, F.lit(True).alias("_copied"))
    copied = F.col("_copied").isNotNull()
    everything = F.array(F.struct(F.lit(0).alias("lo"), F.col("n_bytes").cast("int").alias("hi")))
    return every.join(cut, KEYS, "left").join(copies, KEYS, "left").withColumn("spans", F.when(copied, everything).otherwise(F.col("spans"))).select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
        "spans",
    )
