"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a text are cut into overlapping chunks that cover all of it.  Each
byte has a learned vector; learned filters over ``WIDTH`` successive bytes run
over every chunk and are max-pooled within it.  The mean and the maximum of the
chunks' pooled values are combined into one probability.

It is trained on the driver from a bounded sample: about ``sample`` labelled
documents, chosen by a hash of the id; of a text over ``train_chars`` characters
as many successive ones, from a place chosen by a hash of the id and the text.  Scoring covers whole texts of any length, ``BATCH`` chunks at a time.

Defined results: a null or empty text is one chunk of padding and gets that
score.  If only one class is learned from, or none, every score is the smoothed
share of label 1.  Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.session import ship_code

#: Labelled documents trained on, in expectation, and the most characters of one.
SAMPLE = 4000
TRAIN_CHARS = 16_000
CHUNK, HOP = 512, 448
WIDTH, STRIDE, VECTOR, FILTERS = 8, 2, 4, 24
#: Chunks worked on at a time.
BATCH = 256


def chunks(text: str | None) -> np.ndarray:
    """A row of ``CHUNK`` bytes for each chunk; the last is padded with zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-max(0, len(data) - (CHUNK - HOP)) // HOP))
    padded = np.zeros((n - 1) * HOP + CHUNK, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (HOP, 1))


@dataclass
class ByteConv:
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    offset: float
    constant: float | None = None

    def windows(self, rows: np.ndarray) -> np.ndarray:
        x = self.vectors[rows]
        n, step = rows.shape[0], x.strides[1]
        count = (CHUNK - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(x, (n, count, WIDTH * VECTOR), (x.strides[0], STRIDE * step, x.itemsize))

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The filters' maxima for each chunk."""
        w = self.windows(rows)
        flat = np.ascontiguousarray(w).reshape(-1, w.shape[2]) @ self.filters
        return np.maximum(flat.reshape(w.shape[0], w.shape[1], -1).max(axis=1) + self.bias, 0)

    def combine(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = np.concatenate([mean, most], axis=-1) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, texts) -> Iterator[float]:
        if self.constant is not None:
            yield from (self.constant for _ in texts)
            return
        texts = list(texts)
        todo: list[np.ndarray] = []
        owner: list[int] = []
        total, most, count = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))

        def work() -> None:
            rows = np.concatenate(todo)
            p, o = self.pooled(rows), np.repeat(owner, [len(x) for x in todo])
            np.add.at(total, o, p)
            np.maximum.at(most, o, p)
            np.add.at(count, o, 1)
            todo.clear()
            owner.clear()

        waiting = 0
        for i, t in enumerate(texts):
            c = chunks(t)
            for a in range(0, len(c), BATCH):
                todo.append(c[a : a + BATCH])
                owner.append(i)
                waiting += len(todo[-1])
                if waiting >= BATCH:
                    work()
                    waiting = 0
        if todo:
            work()
        yield from self.combine(total / np.maximum(count, 1)[:, None], most).round(6).tolist()  # sums differ in the last digits with the batch


def gradients(net: ByteConv, data: np.ndarray, size: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean weighted cross entropy of documents of ``size`` chunks each in ``data``, and its gradients, which pass through the windows that the maxima come from."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.ascontiguousarray(net.windows(data))
    act = (flat.reshape(-1, WIDTH * VECTOR) @ net.filters).reshape(flat.shape[0], flat.shape[1], FILTERS)
    at = act.argmax(axis=1)
    raw = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0] + net.bias
    pool = np.maximum(raw, 0)
    mean, most = np.add.reduceat(pool, start) / size[:, None], np.maximum.reduceat(pool, start)
    feature = np.concatenate([mean, most], axis=1)
    p = net.combine(mean, most)
    loss = -float((weigh * np.where(y == 1, np.log(p), np.log(1 - p))).mean())
    dz = ((p - y) * weigh / len(y)).astype(net.weights.dtype)
    grads = {"weights": feature.T @ dz + 1e-4 * net.weights, "offset": dz.sum(keepdims=True)}
    df = dz[:, None] * net.weights
    owner = np.repeat(np.arange(len(y)), size)
    top = pool == most[owner]  # neighbouring chunks share bytes, so a maximum may be in two
    dpool = (df[:, :FILTERS] / size[:, None])[owner] + np.where(top, (df[:, FILTERS:] / np.add.reduceat(top, start, dtype=np.int64))[owner], 0)
    draw = np.where(raw > 0, dpool, 0).astype(net.weights.dtype)
    grads["bias"] = draw.sum(axis=0)
    picked = flat[np.arange(len(data))[:, None], at]  # chunk x filter x input
    grads["filters"] = np.einsum("cf,cfi->if", draw, picked)
    back = (draw[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, VECTOR)
    where = data[np.arange(len(data))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1, WIDTH)
    grads["vectors"] = np.stack([np.bincount(where.ravel(), weights=back[:, :, k].ravel(), minlength=256) for k in range(VECTOR)], axis=1).astype(net.vectors.dtype)
    return loss, grads


def train(texts: list[str | None], labels: list[int], rounds: int = 8, rate: float = 0.01, batch: int = 32, seed: int = 5) -> ByteConv:
    """Adam on the cross entropy, the classes weighing the same."""
    y = np.array(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(WIDTH * VECTOR)
    net = ByteConv(
        rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32), rng.normal(0, scale, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0,
    )
    if len(set(labels)) < 2:
        net.constant = float((y.sum() + 1) / (len(y) + 2))
        return net
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rows = [chunks(t) for t in texts]
    params = {"vectors": net.vectors, "filters": net.filters, "bias": net.bias, "weights": net.weights, "offset": np.zeros(1, np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    steps = rounds * -(-len(y) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            data = np.concatenate([rows[i] for i in own])
            size = np.array([len(rows[i]) for i in own])
            _, grads = gradients(net, data, size, y[own], weigh[own])
            step += 1
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.offset = float(params["offset"][0])
    return net


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, train_chars: int = TRAIN_CHARS, seed: int = 11) -> ByteConv:
    """A network for the labels of ``docs``.  The labelled ids in the sample are few and bounded; a text of each, or a bounded piece of it, comes to the driver, the least where an id is repeated."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)").groupBy("__id").agg(F.min("label").alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("__id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < min(1.0, sample / max(n, 1)))
    bare = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    room = F.greatest(F.length("text") - train_chars, F.lit(0))
    start = F.pmod(F.xxhash64("__id", "text", F.lit(seed)), (room + 1).cast("long")).cast("int") + 1
    bare = bare.join(F.broadcast(picked), "__id").select("__id", "label", F.when(room > 0, F.substring("text", start, F.lit(train_chars))).otherwise(F.col("text")).alias("text"))
    rows = bare.groupBy("__id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["__id"], r["text"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def score(text: Column, net: ByteConv) -> Column:
    """The probability of label 1 for each text."""

    ship_code()

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(net.scores(texts)), dtype="float64")

    return of(text)
