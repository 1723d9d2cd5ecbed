"""Classifiers: what they learn, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeweave.llm import features, quality_model, toxicity

WORDS = [f"w{i}" for i in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(WORDS, 30))
        bad = i % 3 == 0
        if bad:
            w[int(rng.integers(0, 30))] = "vile" + str(rng.choice(["ab", "cd", "ef", "gh"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "s"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (None, "w1", "en", "s"), (5, "again w2", "en", "s"), (1002, "w1 " * 50_000, "en", "s")]
    labels += [(5, 1, 0), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality_model, "quality"), (toxicity, "toxic")])
def test_learns_and_scores_everything(spark, docs, module, label):
    texts, labels = docs
    model = module.fit(texts, labels)
    scored = module.score(texts, model).cache()
    assert scored.count() == texts.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    known = scored.where("held_out").join(labels, "doc_id").where(F.col(label).isNotNull())
    right = known.where((F.col("score") >= 0.5).cast("int") == F.col(label)).count()
    assert right >= 0.9 * known.count()
    assert module.score(texts.limit(0), model).count() == 0


@pytest.mark.parametrize(("module", "label"), [(quality_model, "quality"), (toxicity, "toxic")])
def test_one_class_gives_even_scores(spark, docs, module, label):
    texts, labels = docs
    model = module.fit(texts, labels.where(F.col(label) == 1))
    assert module.score(texts.limit(5), model).where("abs(score - 0.5) > 0.3").count() == 0


def test_thresholds_count_every_untrained_row(spark, docs):
    """Of all 480 labelled rows outside the held-out fold, those not trained on set the thresholds, at their real shares."""
    texts, labels = docs
    net = toxicity.fit(texts, labels, max_rows=100)
    small = toxicity.label_counts(texts, features.agreed(labels, "toxic"), spark.range(0).toDF("doc_id"), net)
    known = features.agreed(labels, "toxic").join(texts, "doc_id")
    assert sum(c.sum() for c in small.values()) == known.count() > 400
    assert set(net.thresholds) == {"de", "en"}
    scored = {r.doc_id: r for r in toxicity.raw_scores(texts, net).join(features.agreed(labels, "toxic"), "doc_id").collect()}
    for name in ("de", "en"):
        p, y = np.array([(r.score, r.y) for r in scored.values() if r.lang == name]).T
        f1 = lambda t: 2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + (y == 1).sum())
        assert f1(net.thresholds[name]) >= max(map(f1, toxicity.GRID)) - 0.03


def test_threshold_weighs_labels_as_all_rows():
    """One language at 10 % toxic of which training took half, one whose toxic rows were all trained on, one without any."""
    n = len(toxicity.GRID) + 1
    cells = np.zeros((2, 2, n))
    cells[0, 0, 10], cells[0, 0, 25] = 800, 90
    cells[0, 1, 25], cells[0, 1, 35] = 20, 30
    cells[1, 1, 30], cells[1, 0, 5] = 50, 10
    rare = np.zeros((2, 2, n))
    rare[1, 1, 30], rare[0, 0, 8], rare[0, 0, 28] = 2, 50, 1
    clean = np.zeros((2, 2, n))
    clean[0, 0, 3] = 9
    got = toxicity.calibrate({"a": cells, "b": rare, "c": clean})
    weighted = cells[0] * (cells.sum((0, 2)) / cells[0].sum(1))[:, None]
    f1 = [2 * weighted[1, k + 1 :].sum() / (weighted[:, k + 1 :].sum() + weighted[1].sum()) for k in range(n - 1)]
    assert got["a"] == toxicity.GRID[[k for k in range(n - 1) if f1[k] >= max(f1) - 1e-12][0]] > 0.6
    assert toxicity.GRID[28] <= got["b"] <= toxicity.GRID[29] and "c" not in got


def test_dual_coordinates_reach_the_optimum():
    """No step along a dual coordinate improves the solution: projected gradients vanish."""
    rng = np.random.default_rng(3)
    y = np.array([0, 1] * 40, float)
    rows = [np.unique(np.r_[rng.integers(0, 30, 6), 30 + int(v)]) for v in y]
    values = np.linspace(0.5, 1.5, 32)
    w, bias = quality_model.dual_coordinate_descent(rows, values, y, 0.1, 400)
    x = np.zeros((80, 33))
    for i, r in enumerate(rows):
        x[i, r] = values[r] / np.linalg.norm(values[r])
    x[:, 32] = 1
    full, sign = np.r_[w, bias], np.where(y > 0, 1, -1)
    primal = lambda v: 0.5 * v @ v + 0.1 * np.maximum(0, 1 - sign * (x @ v)).sum()
    assert all(primal(full) <= primal(full + d) + 1e-3 for d in rng.normal(0, 0.05, (200, 33)))


def test_convolution_by_tables_is_the_convolution():
    net = toxicity.Network.new()
    text = b"one two three four five"
    ids, counts = toxicity.word_buckets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    emb = net.table[ids].sum(1)
    hidden = []
    for w, f in zip(toxicity.WIDTHS, net.filters):
        hidden.append(np.maximum(max((emb[i : i + w].ravel() @ f for i in range(len(emb) - w + 1)), key=lambda v: 0) * 0 + np.max([emb[i : i + w].ravel() @ f for i in range(len(emb) - w + 1)], 0), 0))
    p = 1 / (1 + np.exp(-(np.concatenate(hidden) @ net.out)))
    assert toxicity.scores(net, toxicity.tap_tables(net), ids, counts)[0] == pytest.approx(p, abs=1e-5)


def test_training_and_scoring_are_one_function(monkeypatch):
    """What a training step computes for whole texts, empty, short and long ones, is their score; slices and padding change nothing."""
    monkeypatch.setattr(toxicity, "MIN_STEPS", 5)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, n)) for n in (0, 1, 2, 3, 40, 700, 2_500)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    ids, counts = toxicity.word_buckets(raw, bounds)
    cut = np.r_[0, np.cumsum(counts)]
    net = toxicity.train([ids[a:b] for a, b in zip(cut[:-1], cut[1:])], np.array([0, 1, 0, 1, 0, 1, 0], float), epochs=3)
    net.offsets = [o + 0.3 for o in net.offsets]
    want = toxicity.scores(net, toxicity.tap_tables(net), ids, counts)
    for words in (toxicity.STEP_WORDS, 300):
        monkeypatch.setattr(toxicity, "STEP_WORDS", words)
        got = toxicity.forward(net, [ids[a:b] for a, b in zip(cut[:-1], cut[1:])])[0]
        assert np.abs(got - want).max() < 1e-5


def test_steps_hold_whole_texts():
    rng = np.random.default_rng(6)
    sizes = np.r_[rng.integers(0, 3_000, 500), 200_000, 50]
    blocks = toxicity.step_blocks(sizes, rng.permutation(len(sizes)))
    assert sorted(np.concatenate(blocks).tolist()) == list(range(len(sizes)))
    assert all(len(b) <= toxicity.BATCH and (len(b) == 1 or len(b) * sizes[b].max() <= toxicity.STEP_WORDS) for b in blocks)


def test_passage_far_inside_a_long_text_is_learnt(monkeypatch):
    """Toxic texts of 1,500 words with one telling word among them."""
    monkeypatch.setattr(toxicity, "MIN_STEPS", 120)
    rng = np.random.default_rng(7)
    texts = [rng.integers(100, 2_000, (1_500, 3)).astype(np.int32) for _ in range(80)]
    y = np.array([0, 1] * 40, float)
    for t, label in zip(texts, y, strict=True):
        if label:
            t[rng.integers(0, 1_500)] = 7
    net = toxicity.train(texts[:60], y[:60])
    p = toxicity.forward(net, texts[60:])[0]
    assert ((p >= 0.5) == (y[60:] > 0)).mean() >= 0.9


def test_sample_takes_whole_rows_within_bounds(spark, docs):
    """A row comes whole or not at all; rows and bytes are bounded for each label; repeated rows are one."""
    texts, labels = docs
    given = {(r.doc_id, r.text) for r in texts.collect()}
    repeated = texts.unionByName(texts.where("doc_id < 50"))
    every = features.labelled(repeated, labels, "quality", 10_000, 1 << 30).collect()
    assert len({(r.doc_id, r.text) for r in every}) == len(every) and {(r.doc_id, r.text) for r in every} <= given
    for rows, size in ((40, 1 << 30), (10_000, 20_000)):
        some = features.labelled(repeated, labels, "quality", rows, size).collect()
        assert {(r.doc_id, r.text) for r in some} <= {(r.doc_id, r.text) for r in every}
        for value in (0, 1):
            part = [r for r in some if r.y == value]
            assert 0 < len(part) <= rows // 2 and sum(len(r.text or "") for r in part) <= size // 2


@pytest.mark.parametrize(("module", "label"), [(quality_model, "quality"), (toxicity, "toxic")])
def test_clashing_columns(spark, docs, module, label):
    """Columns named like the results are not read and not carried."""
    texts, labels = docs
    odd = texts.withColumns({c: F.lit("x") for c in ("score", "predicted", "y", "held_out", "_text", "_size")})
    model = module.fit(odd, labels.withColumns({"text": F.lit("z"), "score": F.lit(1)}), max_rows=100)
    assert module.score(odd.limit(20), model).count() == 20
