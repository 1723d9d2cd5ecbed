"""Convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.llm import common as C
from regimeweave.llm import features

BITS = 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
MAX_ROWS = 12_000
EPOCHS = 6
RATE = 0.02
BATCH = 64
#: Least number of steps; a small sample is read in more epochs.
MIN_STEPS = 600
#: Candidate thresholds.
GRID = np.linspace(0.05, 0.95, 37)
#: Words of a training step, padding included; a longer text is a step of its own.
STEP_WORDS = 600 * BATCH
#: Bytes of labelled texts that the fit reads at most; their words take about twice as many on the driver.
MAX_BYTES = 1 << 26


def word_buckets(data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word (whole, first four and first five bytes) and words of each row.

    A-Z is lower-cased and marks at both ends of a word do not count.
    """
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    start, end, counts = C.words(low, bounds)
    for _ in range(3):
        if len(start):
            last = low[end - 1]
            mark = (end - start > 1) & ~(((last >= 97) & (last <= 122)) | (last >= 128) | ((last >= 48) & (last <= 57)))
            end = end - mark
            head = low[start]
            mark = (end - start > 1) & ~(((head >= 97) & (head <= 122)) | (head >= 128) | ((head >= 48) & (head <= 57)))
            start = start + mark
    prefix = C.prefix_hash(low)
    out = np.empty((len(start), 3), np.int32)
    for k, stop in enumerate((end, np.minimum(end, start + 4), np.minimum(end, start + 5))):
        out[:, k] = ((C.span_hash(prefix, start, stop) ^ np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)
    return out, counts


@dataclass
class Network:
    table: np.ndarray  # embeddings by bucket
    filters: list[np.ndarray]  # by width: (width * DIM, FILTERS)
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 7, bits: int = BITS) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.1, (1 << bits, DIM)),
            [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)) for w in WIDTHS],
            [np.zeros(FILTERS) for _ in WIDTHS],
            rng.normal(0, 0.1, len(WIDTHS) * FILTERS),
            0.0,
        )


def step_blocks(sizes: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """Texts of about equal length in blocks of at most ``BATCH`` texts and ``STEP_WORDS`` words; whole texts."""
    order = order[np.argsort(sizes[order] // 64, kind="stable")]
    blocks, first, widest = [], 0, 0
    for k, i in enumerate(order):
        wider = max(widest, sizes[i])
        if k > first and (k - first == BATCH or (k - first + 1) * wider > STEP_WORDS):
            blocks.append(order[first:k])
            first, wider = k, sizes[i]
        widest = wider
    return [*blocks, order[first:]] if len(order) else []


def forward(net: Network, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Probability of each whole text, and what the way back needs: pooled values, winning places and buckets.

    The maximum is over windows of words of the text alone; a text shorter than a filter gives it 0.
    Places are read in slices of ``STEP_WORDS`` words, so a long text needs no more than its buckets.
    """
    width = max(max(WIDTHS), max(len(t) for t in texts))
    ids = np.zeros((len(texts), width, 3), np.int32)
    size = np.array([len(t) for t in texts])
    for k, t in enumerate(texts):
        ids[k, : len(t)] = t
    tops = [np.full((len(texts), FILTERS), -np.inf) for _ in WIDTHS]
    picks = [np.zeros((len(texts), FILTERS), np.int64) for _ in WIDTHS]
    step = max(1, STEP_WORDS // len(texts))
    for a in range(0, width, step):
        emb = net.table[ids[:, a : a + step + max(WIDTHS) - 1]].sum(2)
        for k, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
            taps = f.reshape(w, DIM, FILTERS)
            n = min(step, emb.shape[1] - w + 1)
            if n <= 0:
                continue
            conv = sum(emb[:, j : n + j] @ taps[j] for j in range(w))
            conv[a + np.arange(n)[None, :] + w > size[:, None]] = -np.inf
            best = conv.argmax(1)
            top = np.take_along_axis(conv, best[:, None, :], 1)[:, 0]
            better = top > tops[k]
            tops[k][better], picks[k][better] = top[better], a + best[better]
    pooled = [np.where(np.isfinite(t), np.maximum(t + o, 0), 0) for t, o in zip(tops, net.offsets, strict=True)]
    hidden = np.concatenate(pooled, 1)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30))), hidden, picks, ids


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """AdaGrad on the logistic loss; each step takes whole texts as one padded block, and its gradient runs through the winning places."""
    net = Network.new(seed)
    rng = np.random.default_rng(seed)
    sums = {id(p): np.full(p.shape, 1e-3) for p in [net.table, *net.filters, *net.offsets, net.out]}
    bias_sum = 1e-3

    def descend(p: np.ndarray, g: np.ndarray) -> None:
        s = sums[id(p)]
        s += g * g
        p -= RATE * 5 * g / np.sqrt(s)

    weight = len(y) / 2 / np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    sizes = np.array([len(t) for t in texts])
    for _ in range(max(epochs, -(-MIN_STEPS * BATCH // max(1, len(y))))):
        blocks = step_blocks(sizes, rng.permutation(len(y)))
        for b in rng.permutation(len(blocks)):
            rows = blocks[b]
            p, hidden, picks, ids = forward(net, [texts[i] for i in rows])
            # every text weighs the same, however few share its block
            delta = (p - y[rows]) * weight[y[rows].astype(int)] / BATCH
            back = delta[:, None] * net.out[None, :] * (hidden > 0)
            descend(net.out, hidden.T @ delta)
            bias_sum += delta.sum() ** 2
            net.bias -= RATE * 5 * delta.sum() / np.sqrt(bias_sum)
            places, grads = [], []
            item = np.arange(len(rows))[:, None]
            for k, (w, f, o) in enumerate(zip(WIDTHS, net.filters, net.offsets, strict=True)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                df = np.empty((w, DIM, FILTERS))
                taps = f.reshape(w, DIM, FILTERS)
                on = np.nonzero(g)
                for j in range(w):
                    at = picks[k] + j
                    df[j] = np.einsum("bfd,bf->df", net.table[ids[item, at]].sum(2), g)
                    places.append(ids[on[0], at[on]])
                    grads.append(g[on][:, None] * taps[j].T[on[1]])
                descend(f, df.reshape(w * DIM, FILTERS))
                descend(o, g.sum(0))
            flat = np.concatenate(places).ravel()
            buckets, where = np.unique(flat, return_inverse=True)
            g = np.zeros((len(buckets), DIM))
            np.add.at(g, where, np.repeat(np.concatenate(grads), 3, axis=0))
            s = sums[id(net.table)]
            s[buckets] += g * g
            net.table[buckets] -= RATE * 5 * g / np.sqrt(s[buckets])
    return net


def tap_tables(net: Network) -> list[list[np.ndarray]]:
    """What each bucket adds to each filter at each place: the convolution becomes table look-ups."""
    return [[(net.table @ f.reshape(w, DIM, FILTERS)[j]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, net.filters, strict=True)]


def scores(net: Network, taps: list[list[np.ndarray]], ids: np.ndarray, counts: np.ndarray, step: int = 65_536) -> np.ndarray:
    """Probability of every row; whole texts, in slices of ``step`` words with the overlap of the widest filter."""
    n_rows = len(counts)
    hidden = np.zeros((n_rows, len(WIDTHS) * FILTERS))
    rows = np.repeat(np.arange(n_rows), counts)
    for k, w in enumerate(WIDTHS):
        top = np.full((n_rows, FILTERS), -np.inf, np.float32)
        for a in range(0, max(0, len(ids) - w + 1), step):
            b = min(len(ids) - w + 1, a + step)
            conv = np.zeros((b - a, FILTERS), np.float32)
            for j in range(w):
                for piece in range(ids.shape[1]):
                    conv += taps[k][j][ids[a + j : b + j, piece]]
            own = rows[a:b]
            inside = own == rows[a + w - 1 : b + w - 1]
            if not inside.all():
                conv, own = conv[inside], own[inside]
            if len(own):
                cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                best = np.maximum.reduceat(conv, cut, axis=0)
                top[own[cut]] = np.maximum(top[own[cut]], best)
        hidden[:, k * FILTERS : (k + 1) * FILTERS] = np.where(np.isfinite(top), np.maximum(top + net.offsets[k], 0), 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30)))


def bucket_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, y, ids`` of labelled texts."""

    def run(batches):
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text"):
                ids, counts = word_buckets(data, bounds)
                cut = np.r_[0, np.cumsum(counts)]
                packed = [ids[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(packed, pa.binary())], ["doc_id", "y", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(docs.select("doc_id", "text", F.col("y").cast("int").alias("y")), run, f"doc_id {kind}, y int, ids binary")


def best_threshold(counts: np.ndarray) -> float:
    """Threshold of the highest F1; among equals the one nearest to 0.5.

    ``counts`` (2, len(GRID) + 1) has the rows of each label by the number of thresholds their score reaches.
    """
    reach = counts[:, ::-1].cumsum(1)[:, ::-1]
    best, at = -1.0, 0.5
    for k, t in enumerate(GRID):
        f1 = 2 * reach[1, k + 1] / max(1, reach[:, k + 1].sum() + reach[1, 0])
        if f1 > best + 1e-12 or (abs(f1 - best) <= 1e-12 and abs(t - 0.5) < abs(at - 0.5)):
            best, at = f1, float(t)
    return at


def label_counts(docs: DataFrame, known: DataFrame, trained: DataFrame, net: Network) -> dict[str, np.ndarray]:
    """By language, rows of ``known`` (doc_id, y) by training (no, yes), label and number of thresholds reached.

    Scores are taken before the join, so no text is shuffled; null is the empty language.
    """
    scored = raw_scores(docs.where(F.col("doc_id").isNotNull() & ~features.held_out()), net)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in GRID]), lambda t: t <= F.col("score")))
    marked = known.join(trained.withColumn("_trained", F.lit(1)), "doc_id", "left")
    rows = scored.join(marked, "doc_id").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("_trained", F.lit(0)).alias("trained"), "y", reached.alias("reached")).count()
    out: dict[str, np.ndarray] = {}
    for r in rows.where("y in (0, 1)").collect():  # 4 * (len(GRID) + 1) rows a language at most
        out.setdefault(r["lang"], np.zeros((2, 2, len(GRID) + 1)))[r["trained"], r["y"], r["reached"]] = r["count"]
    return out


def calibrate(counts: dict[str, np.ndarray]) -> dict[str, float]:
    """Threshold of each language that has both labels.

    Only rows outside the training set count, each label weighted to its share in all labelled
    rows, for training takes more of the rare one. A language whose rows of one label were all
    trained on is read from all its rows.
    """
    out = {}
    for name, cells in sorted(counts.items()):
        every, new = cells.sum(0), cells[0]
        sizes, left = every.sum(1), new.sum(1)
        if sizes.all():
            out[name] = best_threshold(new * (sizes / left)[:, None] if left.all() else every)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Network:
    """Trains on four fifths of at most ``max_rows`` labelled rows of ``max_bytes`` together, half of each class, each read whole; all other labelled rows set the threshold of each language.

    Language is read for the thresholds only, never for a score. Without both classes every
    score is near 0.5.
    """
    sample = bucket_rows(features.labelled(docs, labels, label, max_rows, max_bytes)).toArrow().to_pydict()
    order = sorted(range(len(sample["y"])), key=lambda i: (str(sample["doc_id"][i]), sample["ids"][i]))
    texts = [np.frombuffer(sample["ids"][i], "<i4").reshape(-1, 3) for i in order]
    y = np.array([sample["y"][i] for i in order], float)
    if len(set(y)) < 2:
        return Network.new()
    # rows of one id are trained on together or not at all
    names = [sample["doc_id"][i] for i in order]
    place = {name: k for k, name in enumerate(dict.fromkeys(names))}
    rows = [i for i, name in enumerate(names) if place[name] % 5 != 4]
    net = train([texts[i] for i in rows], y[rows])
    kind = docs.schema["doc_id"].dataType.simpleString()
    trained = docs.sparkSession.createDataFrame([(name,) for name, k in place.items() if k % 5 != 4], f"doc_id {kind}")
    net.thresholds = calibrate(label_counts(docs, features.agreed(labels, label), trained, net))
    return net


def raw_scores(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, lang, score`` of every row; whole texts, no shuffle."""
    taps = tap_tables(net)

    def run(batches):
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text"):
                ids, counts = word_buckets(data, bounds)
                p = scores(net, taps, ids, counts)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p)], ["doc_id", "lang", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(docs.select("doc_id", "text", "lang"), run, f"doc_id {kind}, lang string, score double")


def score(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged`` of every row; whole texts, no shuffle.

    ``predicted`` uses ``threshold``; ``flagged`` that of the row's language, or ``threshold`` where a
    language has none; null is the empty language. An empty or null text has no word and gets the score of the bias.
    """
    scored = raw_scores(docs, net)
    limit = F.lit(threshold)
    for name, value in sorted(net.thresholds.items()):
        limit = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(value)).otherwise(limit)
    return scored.select("doc_id", features.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
