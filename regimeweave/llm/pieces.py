"""N-best segmentation into pieces: forward Viterbi scores guide a backward A* search, exactly."""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.llm import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
#: An unknown character costs this much more than the worst piece, and is written as its bytes.
UNKNOWN_PENALTY = 10.0
SPACE, NEWLINE = 0x20, 0x0A
SLOT_BITS = 18
#: A longer chunk is segmented alone, in windows of as many bytes.
WINDOW = 1 << 15


@dataclass
class Vocabulary:
    """Pieces with the word mark as a space; ``surface`` also has the single bytes."""

    surface: list[bytes]
    scores: np.ndarray
    normal: np.ndarray  # ids that may cover text
    byte_ids: np.ndarray
    unknown: float

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Reads a model file of at most some ten thousand pieces, with byte pieces and word marks at the front of pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        surface, scores, normal, byte_ids = [], np.zeros(n), [], np.full(256, -1)
        for i in range(n):
            piece = model.id_to_piece(i)
            scores[i] = model.get_score(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                byte_ids[value] = i
                surface.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                surface.append(piece.replace("▁", " ").encode())
                normal.append(i)
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        if any(b"\n" in surface[i] or b" " in surface[i].lstrip(b" ") for i in normal):
            raise ValueError("a piece spans words")
        return Vocabulary(surface, scores, np.array(normal), byte_ids, float(scores[normal].min()) - UNKNOWN_PENALTY)


class Lattice:
    """Look-up of spans among the pieces, and segmentation of many chunks at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        data = np.frombuffer(b"".join(vocabulary.surface), np.uint8)
        length = np.array([len(s) for s in vocabulary.surface])
        end = np.cumsum(length)
        ids = vocabulary.normal
        key = C.span_hash(C.prefix_hash(data), end[ids] - length[ids], end[ids])
        if len(np.unique(key)) != len(key):
            raise ValueError("two pieces share a hash")
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.ids = np.full(1 << SLOT_BITS, -1, np.int32)
        self.probes = 1
        for k, i in zip(key.tolist(), ids.tolist(), strict=True):
            slot, n = k >> (64 - SLOT_BITS), 1
            while self.ids[slot] >= 0:
                slot, n = (slot + 1) & ((1 << SLOT_BITS) - 1), n + 1
            self.keys[slot], self.ids[slot] = k, i
            self.probes = max(self.probes, n)
        self.lengths = sorted({int(x) for x in length[ids]} | {1, 2, 3, 4})
        self.by_surface = {vocabulary.surface[i]: (i, float(vocabulary.scores[i])) for i in ids.tolist()}
        self.data, self.starts, self.sizes = data, end - length, length

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """Piece id of every hash, -1 where there is none."""
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == key, self.ids[slot], -1)
        left = np.flatnonzero((out < 0) & (self.ids[slot] >= 0))
        for n in range(1, self.probes):
            if not len(left):
                break
            at = (slot[left] + n) & ((1 << SLOT_BITS) - 1)
            hit = self.keys[at] == key[left]
            out[left[hit]] = self.ids[at[hit]]
            left = left[~hit & (self.ids[at] >= 0)]
        return out

    def segment(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best path of every chunk: ids of all chunks, ids per chunk, score, gap to the second path."""
        n = len(start)
        size = end - start
        score, gap, count = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        prefix = C.prefix_hash(data)
        padded = np.r_[data, np.zeros(int(size.max(initial=1)), np.uint8)]
        longest = np.maximum(3, np.ceil(np.log2(np.maximum(size, 1))).astype(int)) if n else size
        for step in np.unique(longest):
            group = np.flatnonzero((longest == step) & (size <= WINDOW))
            if not len(group):
                continue
            width = int(size[group].max())
            rows_at_once = max(1, (1 << 17) // width)
            for a in range(0, len(group), rows_at_once):
                rows = group[a : a + rows_at_once]
                ids, per_row, score[rows], gap[rows] = self._block(padded, prefix, start[rows], size[rows], width)
                count[rows] = per_row
                parts.append((rows, ids))
        for row in np.flatnonzero(size > WINDOW):
            ids, per_row, score[row : row + 1], gap[row : row + 1] = self._long(padded, prefix, int(start[row]), int(size[row]))
            count[row] = per_row[0]
            parts.append((np.array([row]), ids))
        first = np.r_[0, np.cumsum(count)]
        out = np.empty(first[-1], np.int32)
        for rows, ids in parts:
            out[spread(first[rows], count[rows])] = ids
        return out, count, score, gap

    def _block(self, data, prefix, start, size, width):
        """Chunks of at most ``width`` bytes side by side; arrays are (length of piece, place, chunk)."""
        m, lengths = len(start), np.array([x for x in self.lengths if x <= width])
        kinds, place, item = np.arange(len(lengths)), np.arange(width), np.arange(m)
        text = data[start[None, :] + place[:, None]]
        inside = place[:, None] < size[None, :]
        lead = np.where(text < 0x80, 1, np.where(text < 0xC0, 0, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))) * inside
        found = np.full((len(lengths), width, m), -1, np.int32)
        value = np.full((len(lengths), width, m), -np.inf)
        for k, x in enumerate(lengths.tolist()):
            p, c = np.nonzero((lead[: width - x + 1] > 0) & (place[: width - x + 1, None] + x <= size[None, :]))
            at = start[c] + p
            ids = self.look_up(C.span_hash(prefix, at, at + x))
            score = np.where(ids >= 0, self.v.scores[ids], self.v.unknown if x <= 4 else -np.inf)
            if x <= 4:
                score[(ids < 0) & (lead[p, c] != x)] = -np.inf
            found[k, p, c], value[k, p, c] = ids, score
        alpha = np.full((width + 1, m), -np.inf)
        alpha[0] = 0
        back = np.zeros((width + 1, m), np.int64)
        for j in range(1, width + 1):
            n = int(np.searchsorted(lengths, j, "right"))
            into = alpha[j - lengths[:n]] + value[kinds[:n], j - lengths[:n]]
            arg = into.argmax(0)
            alpha[j], back[j] = into[arg, item], arg
        beta = np.full((width + 1, m), -np.inf)
        beta[size, item] = 0
        for i in range(width - 1, -1, -1):
            n = int(np.searchsorted(lengths, width - i, "right"))
            np.maximum(beta[i], (beta[i + lengths[:n]] + value[:n, i]).max(0), out=beta[i])
        edge = np.full((m, width), -1)
        row, at = item, size.copy()
        while len(row):
            k = back[at, row]
            at = at - lengths[k]
            edge[row, at] = k
            keep = at > 0
            row, at = row[keep], at[keep]
        total = alpha[size, item]
        r, c = np.nonzero(edge >= 0)
        k = edge[r, c]
        ids = found[k, c, r]
        value[k, c, r] = -np.inf
        second = np.full(m, -np.inf)
        for q, x in enumerate(lengths.tolist()):
            n = width - x + 1
            np.maximum(second, (alpha[:n] + value[q, :n] + beta[x:]).max(0), out=second)
        times = np.where(ids < 0, lengths[k], 1)
        flat = np.repeat(ids, times)
        unknown = np.flatnonzero(flat < 0)
        if len(unknown):
            at = np.repeat(start[r] + c, times)[unknown] + (np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times))[unknown]
            flat[unknown] = self.v.byte_ids[data[at]]
        return flat, np.bincount(r, times, m).astype(np.int64), total, total - second

    def _long(self, data, prefix, start, n):
        """One chunk of any length, window by window: only the scores, one byte of way back and the path grow with it."""
        lengths = np.array([x for x in self.lengths if x <= n])
        reach = int(lengths[-1])
        alpha, beta = np.full(n + reach + 1, -np.inf), np.full(n + reach + 1, -np.inf)
        back = np.zeros(n + reach + 1, np.int8)
        alpha[0] = beta[n] = 0.0

        def window(a: int) -> tuple[np.ndarray, np.ndarray]:
            """Ids and scores by place and length of the pieces that start in the window."""
            place = np.arange(a, min(n, a + WINDOW))
            text = data[start + place]
            lead = np.where(text < 0x80, 1, np.where(text < 0xC0, 0, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4))))
            found = np.full((len(place), len(lengths)), -1, np.int32)
            value = np.full((len(place), len(lengths)), -np.inf)
            for k, x in enumerate(lengths.tolist()):
                p = np.flatnonzero((lead > 0) & (place + x <= n))
                at = start + place[p]
                ids = self.look_up(C.span_hash(prefix, at, at + x))
                found[p, k] = ids
                value[p, k] = np.where(ids >= 0, self.v.scores[ids], np.where(lead[p] == x, self.v.unknown, -np.inf))
            return found, value

        for a in range(0, n, WINDOW):
            _, value = window(a)
            for i, row in enumerate(value, a):
                if alpha[i] > -np.inf:
                    to = i + lengths
                    into = alpha[i] + row
                    better = np.flatnonzero((into >= alpha[to]) & (into > -np.inf))
                    alpha[to[better]] = into[better]
                    back[to[better]] = better
        on_path, at = np.full(n, -1, np.int8), n
        while at:
            k = back[at]
            at -= int(lengths[k])
            on_path[at] = k
        second, parts = -np.inf, []
        for a in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
            found, value = window(a)
            for i in range(len(value) - 1, -1, -1):
                beta[a + i] = (beta[a + i + lengths] + value[i]).max()
            path = np.flatnonzero(on_path[a : a + len(value)] >= 0)
            kinds = on_path[a + path]
            ids = found[path, kinds]
            value[path, kinds] = -np.inf
            place = np.arange(a, a + len(value))
            second = max(second, max(float((alpha[place] + value[:, k] + beta[place + x]).max()) for k, x in enumerate(lengths.tolist())))
            times = np.where(ids < 0, lengths[kinds], 1)
            flat = np.repeat(ids, times)
            unknown = np.flatnonzero(flat < 0)
            flat[unknown] = self.v.byte_ids[data[start + spread(a + path, times)[unknown]]]
            parts.append(flat)
        flat = np.concatenate(parts[::-1])
        return flat, np.array([len(flat)]), alpha[n : n + 1], alpha[n : n + 1] - second

    def nbest(self, chunk: bytes, k: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``k`` best segmentations, best first.

        The forward pass gives every position the exact score of the best way to reach it; a
        search from the end that orders partial paths by (own score + that score) therefore
        completes paths in the order of their total scores. Of equal ones, that nearest the start
        goes on first. Every open path completes to a path of its own with just that total, so no
        more of them are kept open than paths are still wanted: the search takes at most ``k``
        steps a position, however many paths tie.
        """
        n = len(chunk)
        alpha = array("d", [float("-inf")]) * (n + 1)
        alpha[0] = 0.0
        get, unknown, none = self.by_surface.get, (-1, self.v.unknown), float("-inf")
        for i in range(n):
            here = alpha[i]
            if here == none:
                continue
            b = chunk[i]
            char = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            for x in self.lengths:
                if i + x > n:
                    break
                piece = get(chunk[i : i + x]) or (unknown if x == char else None)
                if piece is not None and here + piece[1] > alpha[i + x]:
                    alpha[i + x] = here + piece[1]
        opened, serial, out = [(-alpha[n], n, 0, 0.0, None)], 1, []
        while opened and len(out) < k:
            f, at, _, score, tail = heapq.heappop(opened)
            if at == 0:
                ids, link = [], tail
                while link is not None:
                    a, b, i = link[0]
                    ids.extend([i] if i >= 0 else self.v.byte_ids[list(chunk[a:b])].tolist())
                    link = link[1]
                out.append((-f, tuple(ids)))
                continue
            for x in self.lengths:
                i = at - x
                if i < 0:
                    break
                if alpha[i] == none:
                    continue
                b = chunk[i]
                char = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                piece = get(chunk[i:at]) or (unknown if x == char else None)
                if piece is not None:
                    opened.append((-(score + piece[1] + alpha[i]), i, serial, score + piece[1], ((i, at, piece[0]), tail)))
                    serial += 1
            opened = heapq.nsmallest(k - len(out), opened)
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, in order."""
        return self.data[spread(self.starts[ids], self.sizes[ids])]


class Memory:
    """Best paths of chunks already met by this task, by the chunk's hash; at most ``limit`` of them."""

    def __init__(self, lattice: Lattice, limit: int = 400_000) -> None:
        self.lattice, self.limit = lattice, limit
        self.paths: dict[bytes, list] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.ids = np.zeros(0, np.int32)

    def look_up(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the sorted ``keys`` in the memory, which learns the ones it lacks."""
        if len(self.keys) + len(keys) > self.limit and len(self.keys):
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            ids, count, score, gap = self.lattice.segment(data, start[new], end[new])
            first = np.cumsum(count) - count + len(self.ids)
            place = at[new]
            self.keys = np.insert(self.keys, place, keys[new])
            for name, value in (("first", first), ("count", count), ("score", score), ("gap", gap)):
                setattr(self, name, np.insert(getattr(self, name), place, value))
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, keys)
        return at


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for ``count[0]`` places, then from first[1], and so on."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def chunk_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of chunks that no piece crosses: runs of spaces with what follows, and line ends."""
    cut = np.zeros(len(data) + 1, bool)
    space = data == SPACE
    cut[:-1] = space
    cut[1:-1] &= ~space[:-1]
    line = np.flatnonzero(data == NEWLINE)
    cut[line] = True
    cut[line + 1] = True
    cut[bounds] = True
    return np.flatnonzero(cut[:-1])


@dataclass
class Encoded:
    ids: np.ndarray
    counts: np.ndarray  # ids per row
    scores: list[list[float]]  # of the best paths, per row
    edits: list[list[list[tuple[int, int, list[int]]]]]  # per row and further path: (first id, ids, new ids)


def encode_texts(memory: Memory, data: np.ndarray, bounds: np.ndarray, k: int) -> Encoded:
    """Best path of every row and the scores and edits of the ``k`` best.

    A text is the product of its chunks, so its best path joins theirs, and its next paths
    change only the k-1 places with the smallest gap between a chunk's first and second path.
    """
    n = len(bounds) - 1
    # each text starts with one space
    marked = np.full(len(data) + n, SPACE, np.uint8)
    new_bounds = bounds + np.arange(n + 1)
    marked[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))] = data
    start = chunk_bounds(marked, new_bounds) if len(marked) else np.zeros(0, np.int64)
    end = np.r_[start[1:], len(marked)][: len(start)]
    key = C.span_hash(C.prefix_hash(marked), start, end)
    different, first, kind = np.unique(key, return_index=True, return_inverse=True)
    kind = memory.look_up(different, marked, start[first], end[first])[kind]
    count, score, gap = memory.count, memory.score, memory.gap
    out = memory.ids[spread(memory.first[kind], count[kind])]
    row = np.searchsorted(new_bounds, start, "right") - 1
    per_row = np.bincount(row, count[kind], n).astype(np.int64)
    best = np.bincount(row, score[kind], n)
    token = np.cumsum(count[kind]) - count[kind]
    row_token = np.r_[0, np.cumsum(per_row)]
    scores, edits = [[b] for b in best.tolist()], [[] for _ in range(n)]
    if k > 1 and len(kind):
        near = np.flatnonzero(np.isfinite(gap[kind]))
        near = near[np.lexsort((near, gap[kind[near]], row[near]))]
        rank = np.arange(len(near)) - np.searchsorted(row[near], row[near], "left")
        near = near[rank < k - 1]
        cut = np.searchsorted(row[near], np.arange(n + 1))
        raw = marked.tobytes()
        for r in range(n):
            paths = [(0.0, ())]
            for c in near[cut[r] : cut[r + 1]].tolist():
                chunk = raw[start[c] : end[c]]
                own = memory.paths.get(chunk)
                if own is None:
                    if len(memory.paths) > 200_000:
                        memory.paths.clear()
                    own = memory.paths[chunk] = memory.lattice.nbest(chunk, k)
                loss = [(own[0][0] - s, i) for s, i in own]
                paths = heapq.nsmallest(k, [(a + b, p + ((c, i),) if j else p) for a, p in paths for j, (b, i) in enumerate(loss)], key=lambda x: x[0])
            scores[r] = [best[r] - a for a, _ in paths]
            edits[r] = [[(int(token[c] - row_token[r]), int(count[kind[c]]), list(i)) for c, i in p] for _, p in paths[1:]]
    return Encoded(out, per_row, scores, edits)


def encode(docs: DataFrame, path: str = MODEL, k: int = NBEST) -> DataFrame:
    """``doc_id, ids, scores, edits`` of every row of ``docs``; whole texts, no shuffle.

    ``ids`` is the best segmentation, ``scores`` those of the ``k`` best (fewer if the text has
    fewer), ``edits`` turns ``ids`` into each further one: (first, count, new ids) per changed place.
    Characters without a piece become their bytes, so decoding returns the very text. A null
    text is encoded as the empty one: the single id of the leading space. Equal scores keep the order of the places. The
    model file is read on the driver and sent to the tasks.
    """
    vocabulary = Vocabulary.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(Lattice(vocabulary))
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text", 1 << 21):
                e = encode_texts(memory, data, bounds, k)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(e.counts)].astype(np.int32)), pa.array(e.ids))
                edits = [[[{"first": a, "count": b, "ids": i} for a, b, i in p] for p in paths] for paths in e.edits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), ids, pa.array(e.scores, pa.list_(pa.float64())), pa.array(edits, kind_of_edits)], ["doc_id", "ids", "scores", "edits"]
                )

    kind_of_edits = pa.list_(pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32()), ("ids", pa.list_(pa.int32()))])))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(docs.select("doc_id", "text"), 
        run, f"doc_id {kind}, ids array<int>, scores array<double>, edits array<array<struct<first:int,count:int,ids:array<int>>>>"
    )


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    vocabulary = Vocabulary.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = vocabulary.surface
        for batch in batches:
            texts = [None if i is None else b"".join([surface[x] for x in i])[1:].decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def digest(docs: DataFrame, path: str = MODEL, k: int = NBEST) -> DataFrame:
    """What ``encode`` and ``decode`` give for every row, without the ids: number of ids of the best path, its
    sha256 (ids as little-endian 32-bit integers), the scores, and whether decoding gives the text back."""
    vocabulary = Vocabulary.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(Lattice(vocabulary))
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text", 1 << 21):
                e = encode_texts(memory, data, bounds, k)
                cut = np.r_[0, np.cumsum(e.counts)]
                raw = e.ids.astype("<i4").tobytes()
                sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                back = memory.lattice.decode(e.ids)
                width = np.r_[0, np.cumsum(memory.lattice.sizes[e.ids])][cut]
                original, decoded = data.tobytes(), back.tobytes()
                same = [decoded[width[i] + 1 : width[i + 1]] == original[bounds[i] : bounds[i + 1]] for i in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(e.counts), pa.array(sha), pa.array(e.scores, pa.list_(pa.float64())), pa.array(same)],
                    ["doc_id", "n_ids", "ids_sha256", "scores", "round_trip"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = C.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_ids bigint, ids_sha256 string, scores array<double>, round_trip boolean")
    return out.withColumn("best_score", F.get("scores", F.lit(0)))
