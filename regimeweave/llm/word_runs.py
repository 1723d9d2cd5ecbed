"""Periodic runs of words: branching tandem repeats of an enhanced suffix array, rotated and merged.

A suffix array of many texts is built at once in numpy; words carry the number of their text, so
nothing matches across texts. Its LCP intervals stand for the nodes of the suffix tree. A square of
period ``d`` starts at ``i`` and branches iff the suffixes ``i`` and ``i+d`` are in one interval of
depth ``d`` but in different children; one of the two is outside the largest child, so only the
smaller children's suffixes ask for ``i+d`` and ``i-d`` (in all ``n log n`` questions at most). Every
run ends with one such square; rotating that square to the left as far as the words agree gives
the run. Runs of one extent have the smallest of their periods.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.llm import common as C

MIN_LENGTH = 6
MIN_EXPONENT = 4
ASK = 1 << 20


@dataclass
class SuffixArray:
    order: np.ndarray  # suffixes, sorted
    rank: np.ndarray  # of every suffix
    levels: list[np.ndarray]  # class of the 2^k words from every place, k = 0, 1, ...
    lcp: np.ndarray  # of a suffix and the one before it; one more entry at the end


def suffix_array(symbols: np.ndarray) -> SuffixArray:
    """Prefix doubling; only suffixes that are not yet alone in their class are sorted again.

    Takes 4 bytes a word for each doubling up to the longest repeat.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    slots = np.arange(n)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    split = np.where(first, 0, 127).astype(np.int8)  # the doubling that told a suffix from the one before it
    levels = [rank.copy()]
    open_slots = slots[~(first & np.r_[first[1:], True])]
    while len(open_slots):
        width, members = 1 << (len(levels) - 1), order[open_slots]
        beyond = members + width
        key = rank[members].astype(np.int64) * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1) + 1
        by_key = np.argsort(key, kind="stable")
        key, members = key[by_key], members[by_key]
        order[open_slots] = members
        new = np.r_[True, key[1:] != key[:-1]]
        here = open_slots[new & (split[open_slots] == 127)]
        split[here] = len(levels)
        rank[members] = open_slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        levels.append(rank.copy())
        open_slots = open_slots[~(new & np.r_[new[1:], True])]
    lcp = np.zeros(n + 1, np.int32)
    for k in range(len(levels) - 2, -1, -1):
        at = np.flatnonzero(split > k)
        if not len(at):
            continue
        a, b = order[at - 1] + lcp[at], order[at] + lcp[at]
        inside = (a < n) & (b < n)
        at, a, b = at[inside], a[inside], b[inside]
        lcp[at[levels[k][a] == levels[k][b]]] += 1 << k
    lcp[[0, n]] = -1
    return SuffixArray(order, rank, levels, lcp)


def nearest_smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one to the left (``step`` -1) or right (1) with a smaller value."""
    near = np.arange(len(lcp), dtype=np.int64) + step
    todo = at
    while len(todo):
        there = near[todo]
        wrong = lcp[there] >= lcp[todo]
        todo, there = todo[wrong], there[wrong]
        near[todo] = near[there]
    return near[at]


def branching_squares(sa: SuffixArray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the squares that no longer run of the same period contains further right.

    A run of ``e`` periods puts ``e`` suffixes into its interval, so smaller intervals are not asked.
    """
    at = np.flatnonzero(sa.lcp >= 1)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    left, right = nearest_smaller(sa.lcp, at, -1), nearest_smaller(sa.lcp, at, 1)
    depth = sa.lcp[at].astype(np.int64)
    large = right - left >= np.maximum(min_exponent, min_length // depth)
    at, left, right, depth = at[large], left[large], right[large], depth[large]
    if not len(at):
        return none, none
    by_node = np.lexsort((at, depth, left))
    at, left, right, depth = at[by_node], left[by_node], right[by_node], depth[by_node]
    opens = np.r_[True, (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])]
    node = np.cumsum(opens) - 1
    # children: from the interval's left end to the first boundary, between boundaries, to its right end
    start = np.concatenate([left[opens], at])
    owner = np.concatenate([np.arange(node[-1] + 1), node])
    in_order = np.lexsort((start, owner))
    start, owner = start[in_order], owner[in_order]
    last = np.r_[owner[1:] != owner[:-1], True]
    end = np.where(last, right[opens][owner], np.r_[start[1:], 0])
    size = end - start
    heads = np.flatnonzero(np.r_[True, last[:-1]])
    largest = np.maximum.reduceat(size, heads)[owner] == size
    position = np.where(largest, np.arange(len(size)), len(size))
    small = np.arange(len(size)) != np.minimum.reduceat(position, heads)[owner]
    start, size, owner = start[small], size[small], owner[small]
    left, right, depth = left[opens], right[opens], depth[opens]

    symbols, n, found = sa.levels[0], len(sa.rank), []
    cut = np.r_[0, np.cumsum(size)]
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + ASK, "right")) - 1)
        which = np.repeat(np.arange(lo, hi), size[lo:hi])
        i = sa.order[start[which] + np.arange(cut[lo], cut[hi]) - cut[which]]
        of = owner[which]
        d, a, b = depth[of], left[of], right[of]
        for begin, other in ((i, i + d), (i - d, i - d)):
            fits = (begin >= 0) & (other < n)
            begin, other, period = begin[fits], other[fits], d[fits]
            place = sa.rank[other]
            member = (place >= a[fits]) & (place < b[fits])
            begin, period = begin[member], period[member]
            branches = symbols[begin + period] != symbols[begin + 2 * period]
            found.append(np.stack([begin[branches], period[branches]]))
        lo = hi
    squares = np.unique(np.concatenate(found, axis=1), axis=1)
    return squares[0], squares[1]


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, by start and period. The last symbol must be unique."""
    sa = suffix_array(symbols)
    begin, period = branching_squares(sa, min_length, min_exponent)
    end = begin + 2 * period
    start = begin.copy()
    for k in range(len(sa.levels) - 1, -1, -1):  # rotations, 2^k at a time
        before = start - (1 << k)
        level = sa.levels[k]
        agree = before >= 0
        agree[agree] = level[before[agree]] == level[before[agree] + period[agree]]
        start = np.where(agree, before, start)
    long = end - start >= np.maximum(min_length, min_exponent * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The spans one after another, each but a row's first behind a space."""
    lead = (~first).astype(np.int64)
    cut = np.r_[0, np.cumsum(size + lead)]
    out = np.full(cut[-1], 32, np.uint8)
    which = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    out[cut[which] + lead[which] + within] = data[start[which] + within]
    return out


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its periodic runs and its words without the repeats.

    A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical) of at least
    ``min_length`` words and ``min_exponent`` (two or more) periods that no neighbouring word extends. ``runs`` holds
    ``(start, length, period)`` by start and period, words numbered from 0; ``collapsed`` joins by one space the words
    that no run contains behind its first ``q`` words. Words are told apart by a 64-bit hash.

    Whole texts, no shuffle, repeated rows and ids each on their own; null and empty texts have no words, an
    empty ``collapsed`` and no runs. Other columns are not returned. Texts are taken a megabyte at a time; a
    longer one is taken alone, at about 150 bytes a word and 4 more for each doubling up to its longest repeat.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run repeats: min_exponent and min_length are 2 or more")
    kind_of_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text"):
                start, end, counts = C.words(data, bounds)
                n_rows, total = last - first, len(start)
                row = np.repeat(np.arange(n_rows), counts)
                # every text's words and one place of its own behind them
                place = np.arange(total) + row
                symbols = C.mix64(np.arange(total + n_rows, dtype=np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A))
                own = C.mix64(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                symbols[place] = C.mix64(C.span_hash(C.prefix_hash(data), start, end) ^ own)
                opens = np.r_[0, np.cumsum(counts + 1)]
                a, e, q = runs_of(symbols, min_length, min_exponent)
                dropped = np.zeros(total + n_rows + 1, np.int32)
                np.add.at(dropped, a + q, 1)
                np.add.at(dropped, e, -1)
                kept = np.flatnonzero(np.cumsum(dropped)[place] == 0)
                size = end[kept] - start[kept]
                leads = np.r_[True, row[kept][1:] != row[kept][:-1]][: len(kept)]
                out = _gather(data, start[kept], size, leads)
                width = np.bincount(row[kept], size + ~leads, n_rows).astype(np.int64)
                cut = np.r_[0, np.cumsum(width)]
                texts = pa.Array.from_buffers(
                    pa.large_string(), n_rows, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]
                ).cast(pa.string())
                of = np.searchsorted(opens, a, "right") - 1
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(n_rows + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(a - opens[of]), pa.array(e - a), pa.array(q)], ["start", "length", "period"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n_rows), pa.array(counts.astype(np.int64)), lists.cast(kind_of_runs), texts],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; a text whose h = crc32 of the id (null as '') is divisible by 10 repeats its own words.

    Of its n words, each word i >= a becomes word a + (i-a) % p, with g = floor(h/10), a = g % n and
    p = 1 + floor((n-a) / (3 + g%8)). Such a text's words are joined by one space.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(C.text_of(), F.lit(C.WORD), F.lit(0)))
    docs = docs.select("doc_id", "text", h.alias("_h"), words.alias("_w"))
    docs = docs.select("doc_id", "text", "_w", F.expr("_h div 10").alias("_g"), F.size("_w").alias("_n"))
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, F.expr("int(_g % _n)")))
    docs = docs.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    tail = F.expr("slice(flatten(array_repeat(slice(_w, _a + 1, _p), int((_n - _a + _p - 1) div _p))), 1, _n - _a)")
    repeated = F.concat_ws(" ", F.concat(F.expr("slice(_w, 1, _a)"), tail))
    return docs.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The longest run and the digests of ``find_runs`` over ``with_repeats``, per row."""
    found = find_runs(with_repeats(docs))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    found = found.select("doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), best.alias("_b"), lines.alias("_lines"), "collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("_b.s")).alias("start"),
        F.col("_b.l").alias("length"),
        (-F.col("_b.p")).alias("period"),
        F.expr("(1000 * _b.l) div (-_b.p)").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
