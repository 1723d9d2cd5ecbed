"""Phrase collocations: padded longest windows are counted, and a ROLLUP gives all shorter phrases.

Each word opens one window: itself and its lead words, up to four, padded where its piece ends. Every
occurrence of a phrase is the beginning of exactly one window, so the sums over the windows' prefixes,
which one ROLLUP gives, are the counts of all phrases of one to four words; no shorter n-gram is ever
exploded. Windows move packed to the block of their first pair, where equal ones become one before the ROLLUP. Before windows are built, tables of fixed size count hashed words and pairs, then the triples whose pairs
may be frequent, and so on. A bucket holds at least the count of each of its entries, so a window may end
where its next longer beginning lies in a bucket below the least count: no phrase that reaches so far can be
a candidate, nor part of one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.llm import common as C

LONGEST = 4
MIN_COUNT = 30
COVERED = 80  # percent
TOP = 2000
SCALE = 2_000_000
TABLE_BITS = 26
BLOCK_BITS = 16
CHUNK = 1 << 20
HELD = 1 << 20
BLOCK_BYTES = 1 << 26
TOP_PARTS = 64
NO_LANG = "und"

_KIND = np.zeros(256, np.uint8)  # 0 word, 1 between words, 2 between pieces
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, and whether the next word belongs to the same piece."""
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    np.equal(kind, 0, out=inside[1:-1])
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    row = np.searchsorted(bounds, start, "right") - 1
    breaks = np.r_[0, np.cumsum(kind == 2)]
    joined = np.zeros(len(start), bool)
    if len(start) > 1:
        joined[:-1] = (row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[end[:-1]])
    return start, end, row, joined


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Different languages, and the number of each row's."""
    coded = column.cast(pa.string()).fill_null(NO_LANG).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _hashes(data: np.ndarray, bounds: np.ndarray, names: list[str], lang: np.ndarray):
    """Words of some rows: bytes in lower case, spans, row, whether joined to the next, 64-bit hashes with the language."""
    data = _LOWER[data]
    start, end, row, joined = split_words(data, bounds)
    salt = np.array([C.span_hash(C.prefix_hash(raw), np.zeros(1, np.int64), np.full(1, len(raw)))[0] for raw in (np.frombuffer(n.encode(), np.uint8) for n in names)], np.uint64)
    own = C.mix64(C.span_hash(C.prefix_hash(data), start, end) ^ C.mix64(salt[lang[row]]))
    return data, start, end, row, joined, own


def _marks(own: np.ndarray) -> np.ndarray:
    """Keys that say in the table of triples that a word belongs to a pair that passed."""
    return C.mix64(own ^ np.uint64(0x2545F4914F6CDD1D))


class Grams:
    """Which n-grams of some rows may be frequent, by the tables of one and two words, of three, and so on."""

    def __init__(self, own: np.ndarray, joined: np.ndarray):
        self.own, self.joined, self.size = own, joined, 1
        self.key = own  # of the n-gram that starts at a word
        self.may = np.ones(len(own), bool)  # all its words belong to one piece and it passed so far

    def judge(self, table: np.ndarray, bits: int) -> None:
        bucket = (self.key[self.may] >> np.uint64(64 - bits)).astype(np.int64)
        self.may[self.may] = (table[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1

    def longer(self) -> None:
        """One more word: both shorter n-grams must have passed."""
        k, self.size = self.size, self.size + 1
        may = np.zeros(len(self.own), bool)
        may[:-k] = self.may[:-k] & self.may[1 : len(self.own) - k + 1] & self.joined[k - 1 : -1]
        key = self.key.copy()
        key[:-k] = C.mix64(self.key[:-k] * np.uint64(3) + self.own[k:])
        self.key, self.may = key, may

    def keys(self) -> np.ndarray:
        return self.key[self.may]


def _add_table(docs: DataFrame, shared: list, min_count: int, bits: int) -> bytes:
    """The next table: one bit for each bucket, whether it holds ``min_count`` or more n-grams.

    The first takes words and pairs, the next the triples, and so on, if the tables before let their parts
    pass; the triples' table also marks the words of the pairs that passed. A task counts its rows in ``2^bits`` bytes that stop at 255 and sends the places that are not zero, block by
    block and packed; blocks are added up as they arrive. The result has ``2^bits / 8`` bytes whatever the size of ``docs``.
    """
    block = 1 << min(BLOCK_BITS, bits)
    size = len(shared) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint8)
        masks = [np.frombuffer(m.value, np.uint8) for m in shared]
        for batch in batches:
            names, lang = _languages(batch.column(1))
            for first, last, data, bounds in C.text_chunks(batch, "text", CHUNK):
                *_, joined, own = _hashes(data, bounds, names, lang[first:last])
                if not len(own):
                    continue
                grams, found = Grams(own, joined), []
                if not masks:
                    found.append(grams.keys())
                else:
                    grams.judge(masks[0], bits)
                while grams.size < min(size, len(own)):
                    grams.longer()
                    if grams.size < size:
                        grams.judge(masks[grams.size - 2], bits)
                    if size == 3 and grams.size == 2:
                        pairs = np.flatnonzero(grams.may)
                        table[(_marks(np.unique(own[np.r_[pairs, pairs + 1]])) >> np.uint64(64 - bits)).astype(np.int64)] = 255
                if grams.size == size:
                    found.append(grams.keys())
                if found:
                    bucket, n = np.unique(np.concatenate(found) >> np.uint64(64 - bits), return_counts=True)
                    table[bucket.astype(np.int64)] = np.minimum(table[bucket.astype(np.int64)] + n, 255)
        blocks = table.reshape(-1, block)
        for at in np.flatnonzero(blocks.any(axis=1)).tolist():
            places = np.flatnonzero(blocks[at])
            steps = np.diff(places, prepend=0).astype("<u2")  # low bytes, then high bytes, then counts
            raw = steps.view(np.uint8).reshape(-1, 2).T.tobytes() + blocks[at][places].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(raw, 1)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = sums.setdefault(at, np.zeros(block, np.uint8))
                low, high, counts = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(3, -1)
                places = np.cumsum(low.astype(np.int64) + 256 * high.astype(np.int64))
                held[places] += np.minimum(counts, 255 - held[places])
        packed = [np.packbits(s >= min_count).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

    blocks = C.map_arrow(docs.select("text", "lang"), count, "block int, counts binary").repartition("block")
    out = bytearray(-(-(1 << bits) // 8))
    for r in blocks.mapInArrow(add, "block int, bits binary").collect():  # at most 2^bits / 8 bytes
        out[r.block * block // 8 : r.block * block // 8 + len(r.bits)] = r.bits
    return bytes(out)


def frequent_buckets(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, bits: int = TABLE_BITS) -> list[bytes]:
    """The tables of 1 and 2, of 3, ... and of ``longest`` words, each of ``2^bits`` bits."""
    if not 2 <= min_count <= 255 or longest < 2 or bits < 3:
        raise ValueError("min_count from 2 to 255, phrases of 2 words or more, 8 buckets or more")
    shared = []
    for _ in range(2, longest + 1):
        shared.append(docs.sparkSession.sparkContext.broadcast(_add_table(docs, shared, min_count, bits)))
    return [m.value for m in shared]


def _merge(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one, in the order of their columns, and the sums of ``n``."""
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.zeros(len(n), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n, first)


def _pack(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Rows in their order: steps of the first column, the others, counts; low bytes first, so that high ones take no room."""
    steps = [np.diff(columns[0], prepend=0), *columns[1:]]
    planes = [c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in steps] + [n.astype("<u8").view(np.uint8).reshape(-1, 8).T]
    return zlib.compress(np.concatenate(planes).tobytes(), 1)


def _unpack(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4 * width + 8, -1)
    columns = np.stack([np.ascontiguousarray(planes[4 * k : 4 * k + 4].T).view("<u4")[:, 0] for k in range(width)]).astype(np.int64)
    columns[0] = np.cumsum(columns[0])
    return columns, np.ascontiguousarray(planes[4 * width :].T).view("<u8")[:, 0].astype(np.int64)


def windows(docs: DataFrame, tables: list[bytes], blocks: int = 1, held: int = HELD) -> DataFrame:
    """``lang, block, words, codes``: padded windows and how often a task met them, packed by language and block of the first pair.

    ``words`` are the block's words by their bytes, each ended by a line feed; ``codes`` holds the windows as places in them
    from 1, where 0 pads, and their counts. The first word of a window is padded too where no pair of it may be frequent, so
    all windows of a language together are its words. A task packs whenever it holds ``held`` different windows.
    """
    bits, longest = (len(tables[0]) * 8).bit_length() - 1, len(tables) + 1
    shared = [docs.sparkSession.sparkContext.broadcast(t) for t in tables]  # 2^bits / 8 bytes each

    def chunk_windows(masks, data, bounds, names, lang):
        """Hashes and spelling of the words that windows of some rows hold, the windows as a language and places from 1, their counts."""
        data, start, end, row, joined, own = _hashes(data, bounds, names, lang)
        total = len(start)
        grams = Grams(own, joined)
        grams.judge(masks[0], bits)
        if longest > 2:  # a word without such a pair is part of no candidate
            useful = (_marks(own[grams.may]) >> np.uint64(64 - bits)).astype(np.int64)
            grams.may[grams.may] = (masks[1][useful >> 3] >> (7 - (useful & 7)).astype(np.uint8)) & 1 == 1
        present = np.flatnonzero(grams.may)
        hashes, example, code = np.unique(own[present], return_index=True, return_inverse=True)
        number = np.zeros(total, np.int64)
        number[present] = code + 1
        columns = [lang[row], number]
        for k in range(1, longest):
            ahead = np.zeros(total, np.int64)
            if k < total:
                grams.longer()
                grams.judge(masks[k - 1], bits)
                ahead[:-k] = np.where(grams.may[:-k], number[k:], 0)
            columns.append(ahead)
        which = present[example]
        return hashes, _spans(data, start[which], end[which]).slice(1), *_merge(columns, np.ones(total, np.int64))

    def packed(names: list[str], parts: list) -> Iterator[pa.RecordBatch]:
        hashes, example, code = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        words = pa.concat_arrays([p[1] for p in parts]).take(pa.array(example)).cast(pa.binary())
        order = pc.array_sort_indices(words).to_numpy()
        words, hashes = words.take(pa.array(order)), np.r_[np.uint64(0), hashes[order]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        ends, columns = np.cumsum([len(p[0]) for p in parts]), []
        for p, last in zip(parts, ends.tolist(), strict=True):
            own = np.r_[0, place[code[last - len(p[0]) : last]]]
            columns.append([p[2][0], *[own[c] for c in p[2][1:]]])
        columns, n = _merge([np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate([p[3] for p in parts]))
        block = (C.mix64(hashes[columns[1]] * np.uint64(3) + hashes[columns[2]]) % np.uint64(blocks)).astype(np.int64)
        group = columns[0] * blocks + block
        order = np.argsort(group, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            used, code = np.unique(np.stack([c[rows] for c in columns[1:]]), return_inverse=True)
            code = code.reshape(longest, -1) + (used[0] > 0)
            text = b"".join(w + b"\n" for w in words.take(pa.array(used[used > 0] - 1)).to_pylist())
            out = [[names[columns[0][rows[0]]]], [int(block[rows[0]])], [zlib.compress(text, 1)], [_pack(list(code), n[rows])]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "block", "words", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.frombuffer(m.value, np.uint8) for m in shared]
        known: dict[str, int] = {}
        parts, size = [], 0
        for batch in batches:
            names, lang = _languages(batch.column(1))
            numbers = np.array([known.setdefault(name, len(known)) for name in names], np.int64)
            for first, last, data, bounds in C.text_chunks(batch, "text", CHUNK):
                part = chunk_windows(masks, data, bounds, names, lang[first:last]) if len(data) else None
                if part is None or not len(part[3]):
                    continue
                part[2][0] = numbers[part[2][0]]
                parts.append(part)
                size += len(part[3])
                if size >= held:
                    yield from packed(list(known), parts)
                    parts, size = [], 0
        if parts:
            yield from packed(list(known), parts)

    return C.map_arrow(docs.select("text", "lang"), run, "lang string, block int, words binary, codes binary")


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The empty string, then the spans."""
    cut = np.r_[0, 0, np.cumsum(end - start)].astype(np.int64)
    index = np.repeat(start - cut[1:-1], end - start) + np.arange(cut[-1])
    raw = pa.py_buffer(data[index].tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(start) + 1, [None, pa.py_buffer(cut.tobytes()), raw]).cast(pa.string())


def merged_windows(table: pa.Table, longest: int, min_count: int) -> pa.Table:
    """``lang, w1, ..., n``: one block's windows and how often they occur, padded from where a beginning of two words or more
    occurs less than ``min_count`` times. All windows with the same first pair are here, so these counts are whole."""
    spelled, columns, counts, at = [], [], [], 0
    for words, codes in zip(table.column("words").to_pylist(), table.column("codes").to_pylist(), strict=True):
        raw = np.frombuffer(zlib.decompress(words), np.uint8)
        ends = np.flatnonzero(raw == 10)
        spelled.append(_spans(raw, np.r_[0, ends + 1][:-1], ends))
        found, n = _unpack(codes, longest)
        columns.append(found + at)
        counts.append(n)
        at += len(spelled[-1])
    coded = pa.concat_arrays(spelled).dictionary_encode()  # '' is the first of each, so 0 pads
    code = coded.indices.to_numpy()
    columns, n = _merge(list(code[np.concatenate(columns, axis=1)]), np.concatenate(counts))
    new = np.zeros(len(n), bool)
    new[0] = True
    rare = np.zeros(len(n), bool)
    for k, c in enumerate(columns):
        new[1:] |= c[1:] != c[:-1]
        if k:
            rare |= np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1] < min_count
            columns[k] = np.where(rare, 0, c)
    columns, n = _merge(columns, n)
    lang = pa.array([table.column("lang")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(n), np.int32)))
    return pa.table([lang, *[coded.dictionary.take(pa.array(c)) for c in columns], pa.array(n)], ["lang", *_lead(longest), "n"])


def _lead(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, bits: int = TABLE_BITS, blocks: int | None = None) -> DataFrame:
    """``lang, size, words, f``: every phrase of 2 to ``longest`` words that occurs ``min_count`` times, the words of such
    phrases, and per language its number of words, at size 0. Words count within pieces, overlaps included.

    Windows that begin with the same pair meet in one of ``blocks`` blocks of their language, by default one for each
    ``BLOCK_BYTES`` of text, so a task holds the windows of about so much text. The ROLLUP gets a block's different windows."""
    if blocks is None:
        blocks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    lead = _lead(longest)
    packed = windows(docs, frequent_buckets(docs, min_count, longest, bits), blocks)
    schema = "lang string, " + ", ".join(f"{w} string" for w in lead) + ", n bigint"
    longest_windows = packed.groupBy("lang", "block").applyInArrow(lambda table: merged_windows(table, longest, min_count), schema)
    sums = longest_windows.rollup("lang", *lead).agg(F.sum("n").alias("f"), F.grouping_id().alias("_open"))
    sums = sums.where(F.col("lang").isNotNull())
    # a prefix that ends in a pad is a shorter phrase once more; these conditions go before the sums, so such rows never move
    level = {k: F.col("_open") == 2 ** (longest - k) - 1 for k in range(longest + 1)}
    for k, w in enumerate(lead):
        sums = sums.where(~level[k + 1] | (F.col(w) != ""))
    size = F.coalesce(*[F.when(level[k], k) for k in range(longest + 1)])
    sums = sums.withColumn("size", size.cast("int")).where((F.col("size") == 0) | (F.col("f") >= min_count))
    return sums.select("lang", "size", F.slice(F.array(*lead), 1, F.col("size")).alias("words"), "f")


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, bits: int = TABLE_BITS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to ``longest`` words of every language.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; a null
    text is empty, a null language is ``und``. Repeated rows count as often as they occur; ids and other columns are not
    read. ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut with the lowest score floor(2000000 a / (l + r)),
    ties to the shorter first part. A phrase whose words lie inside a longer candidate with at least ``covered`` percent of
    its count goes. Order: score and ``a`` descending, phrase ascending by bytes. Products have 38 digits.

    Words are told apart by their text from the shuffle on, and by a 64-bit hash among the windows that a task packs together. The
    tasks exchange windows that they have counted; the tables of ``2^bits`` bits that are broadcast have that size for any
    corpus, and the first ``top`` of a language are found in parts before they meet. The texts are read once for each
    table, once for the windows and once for their size. Tables that fill up let more windows pass and change no result.
    """
    counts = C.stage(phrase_counts(docs, min_count, longest, bits))
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("size > 0").select("lang", "size", "words", F.concat_ws(" ", "words").alias("phrase"), "f")
    candidates = known.where("size > 1").withColumnRenamed("f", "a")

    cuts = candidates.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda begin, length: F.concat_ws(" ", F.slice("words", begin, length))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("_right"))
    f = known.select("lang", "phrase", "f")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
    cuts = cuts.withColumn("_a", _wide("a") * F.lit(SCALE).cast("decimal(10,0)")).withColumn("_b", _wide("l") + _wide("r"))
    cuts = cuts.withColumn("score", F.expr("_a div _b"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))

    inside = candidates.where("size > 2").withColumn("_m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inside = inside.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_m") + 1)))
    inside = inside.select("lang", part(F.col("_at"), F.col("_m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    free = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (_wide("_longer") * 100 < _wide("a") * covered)
    )
    rows = free.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    in_part = Window.partitionBy("lang", "_part").orderBy(*order)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))).withColumn("rank", F.row_number().over(in_part))
    rows = rows.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    rows = rows.where(F.col("rank") <= top).join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, s.k, unnest([array_to_string(w[i:i + s.k - 1], ' ') FOR i IN range(1, len(w) - s.k + 2)]) AS phrase
          FROM words, range(1, 5) AS s(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cand AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
parts AS (SELECT lang, phrase, a, s.k, array_to_string(w[1:s.k], ' ') AS left_part, array_to_string(w[s.k + 1:], ' ') AS right_part
          FROM cand, range(1, 4) AS s(k) WHERE s.k < size),
cuts AS (SELECT p.lang, p.phrase, p.a, p.k, x.f AS l, y.f AS r, (2000000::HUGEINT * p.a) // (x.f + y.f) AS score
         FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.left_part JOIN f y ON y.lang = p.lang AND y.phrase = p.right_part),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
             SELECT c.lang, c.a, array_to_string(c.w[i:i + m - 1], ' ') AS phrase
             FROM cand c, range(2, 4) AS s(m), range(1, 4) AS t(i) WHERE m < c.size AND i + m - 1 <= c.size) GROUP BY ALL),
free AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
         WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       (SELECT n FROM totals t WHERE t.lang = free.lang) AS n, score::BIGINT AS score
FROM free QUALIFY rank <= 2000
"""
