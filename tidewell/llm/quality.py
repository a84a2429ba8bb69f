"""Operator 10, quality classifier: a byte-level convolutional network in numpy.

Filters four bytes wide run over every byte of a text in overlapping chunks; each filter's largest response in a chunk
is kept, a hidden layer turns these into the chunk's evidence, and the mean evidence of all chunks gives one
probability. A filter's response is read from two tables over byte pairs, made from the learned byte tables, so that a
position costs two look-ups whatever the number of filters.

Trained on a bounded sample (`max_rows` labelled rows, all of their texts' chunks); applied to every byte of every text.

Defined results: a null text counts as empty, an empty text is one chunk of padding and is scored like any other;
without labelled rows every score is 0.5. Repeated rows each get a row; an empty table
gives no rows. Columns other than doc_id and text aren't read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import id_mod, labelled_sample, table

CHUNK, STEP, WIDTH = 256, 192, 4
FILTERS, HIDDEN = 24, 16
#: Positions whose responses are held at once.
BLOCK = 1 << 16


def codes(text) -> np.ndarray:
    """The text's bytes, at least WIDTH of them; 0 pads."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return raw if len(raw) >= WIDTH else np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])


def chunk_starts(n: int) -> np.ndarray:
    """Starts of overlapping chunks that cover all n bytes."""
    return np.arange(0, max(1, n - (CHUNK - STEP)), STEP)


def pair_tables(taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WIDTH, 256, FILTERS) byte tables as two tables over pairs of bytes."""
    a = (taps[0][:, None, :] + taps[1][None, :, :]).reshape(65536, -1)
    b = (taps[2][:, None, :] + taps[3][None, :, :]).reshape(65536, -1)
    return np.ascontiguousarray(a, np.float32), np.ascontiguousarray(b, np.float32)


def chunk_maxima(raw: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Each filter's largest response in each chunk of one text; memory holds BLOCK positions at a time."""
    pairs = raw[:-1].astype(np.uint16) * np.uint16(256) + raw[1:]
    starts = chunk_starts(len(raw))
    last = len(raw) - WIDTH  # the last position a filter can stand at
    out = np.empty((len(starts), first.shape[1]), np.float32)
    per = max(1, BLOCK // STEP)
    for i in range(0, len(starts), per):
        own = starts[i : i + per]
        lo, hi = own[0], min(last + 1, own[-1] + CHUNK - WIDTH + 1)
        response = first[pairs[lo:hi]]
        response += second[pairs[lo + 2 : hi + 2]]
        # a chunk is STEP positions of its own and the beginning of the next: reduce between all these borders at once
        heads = np.minimum(own - lo, hi - lo - 1)
        ends = np.minimum(own - lo + CHUNK - WIDTH + 1, hi - lo)
        edges = np.stack([heads, ends], 1).ravel()
        padded = np.concatenate([response, np.full((1, response.shape[1]), -np.inf, np.float32)])
        out[i : i + per] = np.maximum.reduceat(padded, edges, axis=0)[::2]
    return out


class Net:
    """Byte filters, max pooling, one hidden layer, mean over chunks."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.taps = r.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.w1 = r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    def parts(self):
        return [self.taps, self.w1, self.b1, self.w2, self.b2]

    def fit(self, texts: list, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01) -> "Net":
        if not len(y):
            return self
        self.b2[0] = float(np.log((y.mean() + 1e-2) / (1 - y.mean() + 1e-2)))
        padded, starts, at = [], [], 0
        for t in texts:
            raw = codes(t)
            own = chunk_starts(len(raw))
            padded.append(np.pad(raw, (0, own[-1] + CHUNK - len(raw))))
            starts.append(at + own)
            at += len(padded[-1])
        x = np.lib.stride_tricks.sliding_window_view(np.concatenate(padded), CHUNK)  # a view: chunks are copied a block at a time
        bounds, starts = np.cumsum([0, *map(len, starts)]), np.concatenate(starts)
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) ** 0.5
        r = np.random.default_rng(11)
        m = [np.zeros_like(p) for p in self.parts()]
        v = [np.zeros_like(p) for p in self.parts()]
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), batch):
                docs = order[i : i + batch]
                take = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
                n = bounds[docs + 1] - bounds[docs]
                edge = np.concatenate([[0], np.cumsum(n)[:-1]])
                grads = self._gradients(x, starts[take], edge, n, y[docs], weight[docs])
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for p, g, a, b in zip(self.parts(), grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradients(self, x, starts, edge, n, y, weight):
        k = CHUNK - WIDTH + 1
        pooled = np.empty((len(starts), FILTERS), np.float32)
        picked = np.empty((WIDTH, len(starts), FILTERS), np.uint8)
        for i in range(0, len(starts), BLOCK // CHUNK):
            own = x[starts[i : i + BLOCK // CHUNK]]
            response = self.taps[0][own[:, :k]]
            for j in range(1, WIDTH):
                response += self.taps[j][own[:, j : j + k]]
            at = response.argmax(1)
            pooled[i : i + len(own)] = np.take_along_axis(response, at[:, None], 1)[:, 0]
            for j in range(WIDTH):
                picked[j, i : i + len(own)] = np.take_along_axis(own, at + j, 1)
        h = np.maximum(pooled, 0) @ self.w1 + self.b1
        z = np.maximum(h, 0)
        chunk = z @ self.w2
        logit = np.add.reduceat(chunk, edge) / n + self.b2[0]
        d = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
        dchunk = np.repeat(d / n, n).astype(np.float32)
        dz = dchunk[:, None] * self.w2
        dh = dz * (h > 0)
        dp = (dh @ self.w1.T) * (pooled > 0)
        gt = np.zeros_like(self.taps)
        f = np.broadcast_to(np.arange(FILTERS), pooled.shape)
        for j in range(WIDTH):
            np.add.at(gt[j], (picked[j], f), dp)
        return [gt, np.maximum(pooled, 0).T @ dh, dh.sum(0), z.T @ dchunk, np.array([d.sum()], np.float32)]

    def state(self) -> tuple:
        return (*pair_tables(self.taps), self.w1, self.b1, self.w2, self.b2)


def probability(text, state: tuple) -> float:
    first, second, w1, b1, w2, b2 = state
    pooled = chunk_maxima(codes(text), first, second)
    chunk = np.maximum(np.maximum(pooled, 0) @ w1 + b1, 0) @ w2
    return float(1 / (1 + np.exp(-np.clip(chunk.mean() + b2[0], -30, 30))))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Net | None:
    sample = labelled_sample(spark, docs, labels, "quality", max_rows).toPandas().sort_values(["doc_id", "text"])
    return Net().fit(list(sample["text"]), sample["y"].to_numpy(np.float32)) if len(sample) else None


def score(spark: SparkSession, docs: DataFrame, net: Net | None) -> DataFrame:
    """docs with a column `score`, which replaces one of docs."""
    if net is None:
        return docs.withColumn("score", F.lit(0.5))
    sent = spark.sparkContext.broadcast(net.state())

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([probability(t, sent.value) for t in texts], dtype="float64")

    return docs.withColumn("score", apply(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(spark, docs, table(spark, sf_dir, "labels"))
    held = (id_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return score(spark, docs, net).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
