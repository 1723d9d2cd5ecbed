"""Near copies by Jaccard similarity of word shingles: MinHash LSH forest, then exact verification."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.llm import common as C
from regimeweave.llm.components import connected_components
from regimeweave.llm.common import stage

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
TARGET_RECALL = 0.9999
#: Rows and shingles of a block that one task compares with another block.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20


def prefix_lengths(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> list[int]:
    """Prefix lengths from the full depth down to the longest that reaches the target recall.

    A pair of similarity s agrees on k values of a tree with probability s^k, so a pair at the
    threshold shares a prefix of length k in some tree with probability 1-(1-t^k)^trees.
    """
    lengths = [depth]
    while lengths[-1] > 1 and 1 - (1 - threshold ** lengths[-1]) ** trees < target:
        lengths.append(lengths[-1] - 1)
    return lengths


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted, and their number per row.

    A text of fewer than ``size`` words but at least one is a single shingle.
    """
    start, end, counts = C.words(data, bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    word = C.span_hash(C.prefix_hash(data), start, end)
    n = max(0, len(word) - size + 1)
    gram = word[:n].copy()
    for j in range(1, size):
        gram = C.mix64(gram * np.uint64(5) + word[j : n + j])
    inside = rows[:n] == rows[size - 1 : n + size - 1] if n else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = np.zeros(len(short), np.uint64)
    first = np.r_[0, np.cumsum(counts)]
    for k, r in enumerate(short):
        h = np.uint64(int(counts[r]))
        for w in word[first[r] : first[r + 1]]:
            h = C.mix64(np.array([h], np.uint64) * np.uint64(5) + w)[0]
        extra[k] = h
    value = np.concatenate([gram[inside], extra])
    owner = np.concatenate([rows[:n][inside], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(counts))


def set_keys(value: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128-bit digest of the set of every row; null for an empty set."""
    key = np.zeros((len(counts), 2), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        cut = np.r_[0, np.cumsum(counts)][:-1][full]
        key[full, 0] = np.add.reduceat(C.mix64(value), cut)
        key[full, 1] = np.add.reduceat(C.mix64(value ^ np.uint64(0x2545F4914F6CDD1D)), cut)
    return [r.tobytes() if c else None for r, c in zip(key, counts, strict=True)]


def signatures(value: np.ndarray, counts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """MinHash values, one row per text with a shingle: (rows, trees * depth)."""
    rng = np.random.default_rng(5)
    factor = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)
    full = counts[counts > 0]
    cut = np.r_[0, np.cumsum(full)][:-1]
    out = np.empty((len(full), trees * depth), np.uint64)
    if len(full):
        for k in range(trees * depth):
            out[:, k] = np.minimum.reduceat(value * factor[k] + shift[k], cut)
    return out


def sketch(docs: DataFrame, trees: int, lengths: list[int], size: int) -> DataFrame:
    """``doc_id, text_key, set_key, n_shingles`` and, per prefix length, the hashes of every tree's prefix.

    ``set_key`` is a 128-bit digest of the set of shingles: equal keys are equal sets. ``text_key`` is a hash of the text.
    """
    depth = lengths[0]

    def run(batches):
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text", 1 << 19):
                value, counts = shingles(data, bounds, size)
                n, full = last - first, np.flatnonzero(counts)
                keys = set_keys(value, counts)
                sig = signatures(value, counts, trees, depth).reshape(len(full), trees, depth)
                columns = [*[batch.column(i).slice(first, n) for i in range(2)], pa.array(keys, pa.binary()), pa.array(counts.astype(np.int64))]
                running = np.zeros((len(full), trees), np.uint64)
                hashes = {}
                for d in range(depth):
                    running = C.mix64(running * np.uint64(7) + sig[:, :, d])
                    hashes[d + 1] = C.mix64(running + np.arange(trees, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                for d in lengths:
                    flat = np.zeros(n, np.int64)
                    flat[full] = trees
                    offsets = pa.array(np.r_[0, np.cumsum(flat)].astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(hashes[d].ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "text_key", "set_key", "n_shingles", *[f"p{d}" for d in lengths]]
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"p{d} array<bigint>" for d in lengths)
    return C.map_arrow(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run, f"doc_id {kind}, text_key bigint, set_key binary, n_shingles bigint, {kinds}")


def candidate_edges(sets: DataFrame, lengths: list[int]) -> DataFrame:
    """Edges (a, b) between sets that meet in a tree, found from the leaves of the tries upwards.

    At the full depth every prefix keeps its smallest set as its head and links the others to
    it; only heads go on to the next shorter prefix. So a prefix shared by very many sets is a
    partial aggregate and adds one edge per set.
    """
    zipped = F.arrays_zip(*[F.col(f"p{d}") for d in lengths])
    level = sets.select("set_id", F.explode(zipped).alias("z")).select("set_id", *[F.col(f"z.p{d}").alias(f"p{d}") for d in lengths])
    # one dealing by the shortest prefix serves all lengths
    edges = None
    for k, d in enumerate(lengths):
        keys = [f"p{x}" for x in lengths[k:]]
        heads = stage(level.groupBy(*keys).agg(F.min("set_id").alias("_head"), F.count("*").alias("_n")))
        grown = heads.where("_n > 1").select(f"p{d}", "_head")
        found = level.join(grown, f"p{d}").where("set_id != _head").select(F.col("set_id").alias("a"), F.col("_head").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        level = heads.select(F.col("_head").alias("set_id"), *keys[1:])
    return edges.distinct()


def compare(own: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Matrix of links between the sets of two blocks (or inside one block)."""
    one = other is None
    other = own if one else other
    a = np.repeat(np.arange(len(own)), [len(x) for x in own])
    b = np.repeat(np.arange(len(other)), [len(x) for x in other])
    va, vb = np.concatenate(own), np.concatenate(other)
    kinds, ia = np.unique(va, return_inverse=True)
    at = np.searchsorted(kinds, vb)
    at[at == len(kinds)] = 0
    shared = kinds[at] == vb if len(kinds) else np.zeros(len(vb), bool)
    b, ib = b[shared], at[shared]
    order_a, order_b = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    a, ia, b, ib = a[order_a], ia[order_a], b[order_b], ib[order_b]
    common = np.zeros((len(own), len(other)), np.int64)
    used = np.unique(ib)
    if one:
        used = used[np.bincount(ib, minlength=len(kinds))[used] > 1]
    for first in range(0, len(used), 2048):
        part = used[first : first + 2048]
        left, right = np.zeros((len(own), len(part)), np.float32), np.zeros((len(other), len(part)), np.float32)
        for matrix, rows, kind in ((left, a, ia), (right, b, ib)):
            lo, hi = np.searchsorted(kind, part[0], "left"), np.searchsorted(kind, part[-1], "right")
            slot = np.searchsorted(part, kind[lo:hi])
            good = part[np.minimum(slot, len(part) - 1)] == kind[lo:hi]
            matrix[rows[lo:hi][good], slot[good]] = 1
        common += (left @ right.T).astype(np.int64)  # at most 2048, exact as a float
    sizes_a = np.array([len(x) for x in own], np.int64)[:, None]
    sizes_b = np.array([len(x) for x in other], np.int64)[None, :]
    # common / (a + b - common) >= p / q in whole numbers
    share = Fraction(str(threshold))
    linked = common * (share.numerator + share.denominator) >= share.numerator * (sizes_a + sizes_b)
    if one:
        np.fill_diagonal(linked, False)
    return linked


def heads_of(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest set id of the connected part of each row and column."""
    head_a, head_b = ids_a.copy(), ids_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(head_a, np.where(linked, head_b[None, :], top).min(1, initial=top))
        new_b = np.minimum(head_b, np.where(linked, new_a[:, None], top).min(0, initial=top))
        if (new_a == head_a).all() and (new_b == head_b).all():
            return head_a, head_b
        head_a, head_b = new_a, new_b


def verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """``set_id, head, links`` per set and block pair; ``blocks`` (pair, side, set_id, shingles, weight)."""

    def run(keys, frame):
        import pandas as pd

        left = frame[frame.side == 0].sort_values("set_id")
        right = frame[frame.side == 1].sort_values("set_id")
        a = [np.frombuffer(x, np.uint64) for x in left.shingles]
        ids_a, weight_a = left.set_id.to_numpy(np.int64), left.weight.to_numpy(np.int64)
        if keys[1] == keys[2]:
            linked = compare(a, None, threshold)
            head, _ = heads_of(linked, ids_a, ids_a)
            return pd.DataFrame({"set_id": ids_a, "head": head, "links": linked @ weight_a})
        b = [np.frombuffer(x, np.uint64) for x in right.shingles]
        if not len(a) or not len(b):
            return pd.DataFrame({"set_id": [], "head": [], "links": []}).astype("int64")
        ids_b, weight_b = right.set_id.to_numpy(np.int64), right.weight.to_numpy(np.int64)
        linked = compare(a, b, threshold)
        head_a, head_b = heads_of(linked, ids_a, ids_b)
        return pd.DataFrame({"set_id": np.r_[ids_a, ids_b], "head": np.r_[head_a, head_b], "links": np.r_[linked @ weight_b, linked.T @ weight_a]})

    return blocks.groupBy("group", "x", "y").applyInPandas(run, "set_id bigint, head bigint, links bigint")


def shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text"):
                value, counts = shingles(data, bounds, size)
                cut = np.r_[0, np.cumsum(counts)]
                packed = [value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                own = [batch.column(i).slice(first, last - first) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(packed, pa.binary())], names)

    names = [*[c for c in docs.columns if c != "text"], "shingles"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*names[:-1]).schema)
    return C.map_arrow(docs.select(*names[:-1], "text"), run, f"{kinds}, shingles binary")


def row_order() -> Column:
    """Rows by id, null last, then by their text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))


def linked_rows(docs: DataFrame, threshold: float, size: int, trees: int, depth: int, target: float) -> DataFrame:
    """``doc_id, text_key, set_key, class_id, copies, links, group_id, keeper`` of every row of ``docs``.

    ``keeper`` is the first row (``row_order``) that links lead to; it is null for a text without a word.
    """
    lengths = prefix_lengths(trees, depth, threshold, target)
    marked = stage(sketch(docs, trees, lengths, size))
    columns = [f"p{d}" for d in lengths]
    full = marked.where("set_key is not null")
    sets = stage(
        full.groupBy("set_key")
        .agg(F.min("doc_id").alias("class_id"), F.min(row_order()).alias("_first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), *[F.max(c).alias(c) for c in columns])
        .withColumn("set_id", F.xxhash64("set_key"))
    )
    edges = stage(candidate_edges(sets, lengths))
    parts = connected_components(edges)  # node, component: smallest set_id
    members = sets.join(parts.withColumnRenamed("node", "set_id"), "set_id").select("set_id", "set_key", "copies", "n_shingles", F.col("component").alias("group"))
    members = stage(members)
    extent = members.groupBy("group").agg(F.count("*").alias("_rows"), F.sum("n_shingles").alias("_sum"))
    n_blocks = F.greatest(F.ceil(F.col("_rows") / BLOCK_ROWS), F.ceil(F.col("_sum") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(extent.select("group", n_blocks.alias("n")), "group").withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("n")).cast("int"))
    # one text per set, met by the id and hash of one of its rows; equal rows are one before they are met, so shingles move once
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = full.groupBy("set_key").agg(F.min(F.struct(name.alias("_id"), F.col("text_key").alias("_key"))).alias("_row"))
    chosen = placed.join(keyed, "set_key").select("_row._id", "_row._key", "set_id", F.col("copies").alias("weight"), "group", "block", "n")
    texts = docs.select(name.alias("_id"), F.xxhash64("text").alias("_key"), "text").dropDuplicates(["_id", "_key"]).join(chosen, ["_id", "_key"])
    rows = shingle_rows(texts, size)
    other = F.sequence(F.lit(0), F.col("n") - 1)
    pairs = rows.withColumn("o", F.explode(other)).select(
        "group", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), (F.col("block") > F.col("o")).cast("int").alias("side"), "set_id", "weight", "shingles"
    )
    checked = stage(verify(pairs, threshold))
    counts = checked.groupBy("set_id").agg(F.sum("links").alias("links"))
    groups = connected_components(checked.where("head != set_id").select(F.col("set_id").alias("a"), F.col("head").alias("b")).distinct())
    named = sets.select("set_key", "set_id", "class_id", "_first", "copies").join(counts, "set_id", "left").join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = stage(named.withColumn("component", F.coalesce("component", "set_id")))
    firsts = named.groupBy("component").agg(F.min("class_id").alias("group_id"), F.min("_first").alias("keeper"))
    named = named.join(firsts, "component").drop("set_id", "component", "_first")
    return marked.select("doc_id", "text_key", "set_key").join(named, "set_key", "left")


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """``doc_id, class_id, group_id, n_links, copies`` of every row of ``docs``.

    Shingles are sets of ``size`` words; two rows are linked at Jaccard ``threshold`` or more.
    ``class_id`` is the smallest doc_id of the rows with an equal set, ``copies`` their number,
    ``group_id`` the smallest doc_id that links lead to, ``n_links`` the number of other rows linked to
    this one, equal sets included. A text without a word is linked to nothing and is its own class;
    a null text is empty. Rows that repeat an id count as rows. A class of rows with null ids only
    has a null class_id.

    Equal sets become one node first. The forest proposes edges, never more than one per set,
    tree and prefix length; their connected parts are cut into blocks of bounded rows and
    shingles, and every pair of blocks of one part is compared exactly, so no link among
    candidates is lost and no pair of rows is ever written: tasks return counts and heads.
    """
    result = linked_rows(docs, threshold, size, trees, depth, target)
    return result.select(
        "doc_id",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
    )


def row_key(text_key: Column) -> list[Column]:
    """Id and text hash of a row as join keys that are never null."""
    return [F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), text_key.alias("_key")]


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with exactly one row of each group of linked rows: that with the smallest doc_id, null last.

    Rows that repeat the id are told apart by their text's hash, so a row goes only with its own
    group; among rows equal in both, the one with the smallest hash of the whole row stays, and
    one of those that are equal throughout. Texts without a word are in no group and all stay.
    """
    linked = linked_rows(docs, THRESHOLD, SHINGLE, TREES, DEPTH, TARGET_RECALL).where("keeper is not null")
    first = F.col("keeper") == row_order()
    # rows of one id and text share their group; only those of a set with several rows can be one too many
    shared = linked.where(~first | (F.col("copies") > 1))
    keys = shared.groupBy(*row_key(F.col("text_key"))).agg(F.bool_and(first).alias("_first"), F.count("*").alias("_n"))
    extra = stage(keys.where("not _first or _n > 1"))
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(carried, *row_key(F.xxhash64("text")))
    names = ["_none", "_id", "_key"]
    kept = keyed.join(extra.select(*names), names, "left_anti").select("doc.*")
    tied = extra.where("_first").select(*names)
    if tied.isEmpty():
        return kept
    whole = F.xxhash64(F.col("doc").cast("string"))  # as text, for a map has no hash
    one = keyed.join(tied, names, "left_semi").groupBy(*names).agg(F.min_by("doc", whole).alias("doc"))
    return kept.unionByName(one.select("doc.*"))
