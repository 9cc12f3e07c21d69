"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Filters of WIDTH bytes slide over a text by STRIDE; their rectified responses are averaged in chunks
of CHUNK positions that overlap by half and cover the whole text; the largest chunk average of each
filter goes into one logistic unit. Training is plain back-propagation with Adam on a bounded sample.

Defined results: null and empty texts get the score of the bias alone; every other text is read to
its last byte; with no labelled rows at all the score is 0.5 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDTH, STRIDE, FILTERS = 4, 2, 16
#: Positions of half a chunk: a chunk is two neighbouring halves, 256 bytes.
HALF = 64
#: Bounds of the fit: labelled documents, characters of each, and steps of BATCH documents.
FIT_DOCS, FIT_CHARS, STEPS, BATCH, FIT_BYTES = 3000, 20_000, 500, 32, 2048
THRESHOLD = 0.3


@dataclass
class Net:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    shift: float


def _bytes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return data


def _positions(data: np.ndarray) -> int:
    return max(1, -(-(len(data) - WIDTH) // STRIDE) + 1) if len(data) else 0


def _responses(net: Net, data: np.ndarray) -> np.ndarray:
    """(positions, FILTERS), rectified; bytes beyond the end read as 0."""
    n = _positions(data)
    padded = np.zeros((n - 1) * STRIDE + WIDTH, np.uint8)
    padded[: len(data)] = data
    r = np.take(net.table[0], padded[0 : (n - 1) * STRIDE + 1 : STRIDE], axis=0)
    for o in range(1, WIDTH):
        r += np.take(net.table[o], padded[o : o + (n - 1) * STRIDE + 1 : STRIDE], axis=0)
    r += net.bias
    return np.maximum(r, 0, out=r)


def _chunks(r: np.ndarray) -> np.ndarray:
    """(chunks, FILTERS): means over chunks that overlap by half and leave no position out."""
    n = len(r)
    edges = np.arange(0, n, HALF)
    sums = np.add.reduceat(r, edges, axis=0)
    counts = np.diff(np.append(edges, n)).astype(r.dtype)
    if len(edges) > 1:
        sums, counts = sums[:-1] + sums[1:], counts[:-1] + counts[1:]
    return sums / counts[:, None]


def score(net: Net, text: str | None) -> float:
    data = _bytes(text)
    top = np.zeros(FILTERS, np.float32)
    for lo in range(0, len(data), 1 << 20):  # long texts in slices that share a chunk
        top = np.maximum(top, _chunks(_responses(net, data[lo : lo + (1 << 20) + 4 * HALF])).max(axis=0))
    return float(1 / (1 + np.exp(-np.clip(float(top @ net.out) + net.shift, -30, 30))))


def fit(sample: list[tuple[str, int]], seed: int = 11) -> Net:
    """Trains on (text, 0 or 1) pairs; the classes weigh alike in a step's draw."""
    rng = np.random.default_rng(seed)
    net = Net((rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.standard_normal(FILTERS) * 0.5).astype(np.float32), 0.0)
    data = [(_bytes(t), y) for t, y in sample]
    groups = [g for g in ([d for d, y in data if y == 0 and len(d)], [d for d, y in data if y == 1 and len(d)])]
    if not all(groups):
        ones = sum(y for _, y in sample)
        return Net(net.table * 0, net.bias, net.out * 0, 0.0 if not sample else float(np.log((ones + 1) / (len(sample) - ones + 1))))
    params = [net.table, net.bias, net.out, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        grads = [np.zeros_like(p) for p in params]
        for k in range(BATCH):
            y = k % 2
            d = groups[y][rng.integers(len(groups[y]))]
            lo = int(rng.integers(max(1, len(d) - FIT_BYTES + 1)))
            d = d[lo : lo + FIT_BYTES]
            r = _responses(net, d)
            c = _chunks(r)
            arg = c.argmax(axis=0)
            top = c[arg, np.arange(FILTERS)]
            p = 1 / (1 + np.exp(-np.clip(float(top @ net.out + params[3][0]), -30, 30)))
            g = p - y
            grads[3][0] += g
            grads[2] += g * top
            n = len(r)
            padded = np.zeros((n - 1) * STRIDE + WIDTH, np.uint8)
            padded[: len(d)] = d
            for f in range(FILTERS):  # only the winning chunk of a filter learns
                a, b = int(arg[f]) * HALF, min(n, (int(arg[f]) + 2) * HALF)
                live = np.flatnonzero(r[a:b, f] > 0) + a
                if len(live):
                    w = g * net.out[f] / (b - a)
                    grads[1][f] += w * len(live)
                    for o in range(WIDTH):
                        grads[0][o, :, f] += np.bincount(padded[live * STRIDE + o], minlength=256).astype(np.float32) * w
        rate = 0.02 * (1 - step / (STEPS + 1))
        for p_, g_, (m, v) in zip(params, grads, moments):
            g_ /= BATCH
            m *= 0.9
            m += 0.1 * g_
            v *= 0.99
            v += 0.01 * g_ * g_
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.shift = float(params[3][0])
    # the draw was balanced: put the sample's own odds back
    net.shift += float(np.log(len(groups[1]) / len(groups[0])))
    return net


def classify(docs: DataFrame, net: Net, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with quality_score and quality_pred; nothing but the text is read for them."""
    bundle = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size, whatever the input
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("quality_score", T.DoubleType()), T.StructField("quality_pred", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = bundle.value
        for b in batches:
            s = np.array([score(own, t) for t in b["__text"]], float)
            yield b[list(keep)].assign(quality_score=s, quality_pred=(s >= THRESHOLD).astype(np.int32))

    return docs.select(*keep, docs[text].alias("__text")).mapInPandas(run, schema)
