import numpy as np
import pytest
from helpers import frame, odd_rows, prose
from pyspark.sql import functions as F

from canopy.llm import quality
from canopy.llm.queries import op1_quality


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 512, 513, 960, 961, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        c = quality.chunks(text)
        assert c.shape[1] == quality.CHUNK
        whole = np.zeros((len(c) - 1) * quality.HOP + quality.CHUNK, dtype=np.uint8)
        for i, row in enumerate(c):
            whole[i * quality.HOP : i * quality.HOP + quality.CHUNK] = row
        assert whole[:n].tobytes().decode() == text and not whole[n:].any()


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    found = op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() >= 0.95
    assert found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()


def trained():
    good, bad = [prose(i, 80) for i in range(40)], [" ".join(w + "###" for w in prose(i, 80).split()) for i in range(40)]
    return quality.train(good + bad, [1] * 40 + [0] * 40)


def test_scores(spark):
    net = trained()
    own = list(net.scores([prose(99, 90), " ".join(w + "###" for w in prose(98, 90).split())]))
    assert own[0] > 0.7 and own[1] < 0.3
    texts = [r[1] for r in odd_rows()]
    together, alone = list(net.scores(texts)), [next(iter(net.scores([t]))) for t in texts]
    assert np.allclose(together, alone, atol=2e-6) and together[3] == together[4]
    df = frame(spark, odd_rows(), True)
    assert np.allclose(sorted(r.s for r in df.select(quality.score(F.col("text"), net).alias("s")).collect()), sorted(together), atol=2e-6)
    assert df.limit(0).select(quality.score(F.col("text"), net).alias("s")).count() == 0


def test_one_class_or_none(spark):
    assert list(quality.train(["a", None], [1, 1]).scores([None, "x"])) == [0.75, 0.75]
    assert list(quality.train([], []).scores(["x"])) == [0.5]
    df = frame(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn(df, none).constant == 0.5


def test_sample_is_bounded(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    df, labels = df.union(df), df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    original, quality.train = quality.train, lambda t, y: seen.append(len(t)) or original([], [])
    try:
        quality.learn(df, labels, sample=200)
    finally:
        quality.train = original
    assert 120 <= seen[0] <= 280


def test_long_texts_are_learned_from(spark):
    good, bad = [prose(i, 400) for i in range(12)], [" ".join(w + "###" for w in prose(i, 400).split()) for i in range(12)]
    rows = [(i, t, i % 2) for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    seen = []
    original, quality.train = quality.train, lambda t, y: seen.append((t, y)) or original([], [])
    try:
        quality.learn(df.select("doc_id", "text"), df.select("doc_id", "quality"), train_chars=500)
    finally:
        quality.train = original
    (texts, labels), whole = seen[0], [t for _, t, _ in rows]
    assert labels == [q for *_, q in rows] and all(len(t) == 500 and t in w for t, w in zip(texts, whole, strict=True))
    assert sum(w.startswith(t) for t, w in zip(texts, whole, strict=True)) < 5


def test_naive_convolution():
    net = trained()
    for text in (prose(7, 200), "short", ""):
        data = text.encode()
        pooled = []
        for c in range(max(1, -(-max(0, len(data) - (quality.CHUNK - quality.HOP)) // quality.HOP))):
            row = data[c * quality.HOP : c * quality.HOP + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            best = [0.0] * quality.FILTERS
            for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                window = np.concatenate([net.vectors[b] for b in row[at : at + quality.WIDTH]])
                for k in range(quality.FILTERS):
                    best[k] = max(best[k], float(window @ net.filters[:, k]) + float(net.bias[k]))
            pooled.append(best)
        z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ net.weights + net.offset
        assert next(iter(net.scores([text]))) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_numeric_gradients():
    rng = np.random.default_rng(0)
    net = quality.ByteConv(rng.normal(0, 0.5, (256, quality.VECTOR)), rng.normal(0, 0.2, (quality.WIDTH * quality.VECTOR, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.3, 2 * quality.FILTERS), 0.1)
    rows = [quality.chunks(prose(i, n)) for i, n in enumerate((30, 200, 90))]
    data, size = np.concatenate(rows), np.array([len(r) for r in rows])
    y, weigh = np.array([1.0, 0.0, 1.0]), np.array([0.75, 1.5, 0.75])
    _, grads = quality.gradients(net, data, size, y, weigh)
    used = int(data[0, 0])
    for name, at in (("weights", 3), ("weights", 30), ("bias", 5), ("filters", (4, 2)), ("filters", (9, 11)), ("vectors", (used, 1)), ("vectors", (ord("t"), 2))):
        values, step = getattr(net, name), 1e-6
        old, ends = values[at], []
        for sign in (1, -1):
            values[at] = old + sign * step
            ends.append(quality.gradients(net, data, size, y, weigh)[0])
        values[at] = old
        decay = 1e-4 * old if name == "weights" else 0
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / (2 * step) + decay, rel=1e-3, abs=1e-6), name
