"""Language identification with a convolutional network over bytes, trained in numpy.

A text is cut into windows of WINDOW bytes, all of it, the last one padded. The network: a vector for each
byte, filters of several widths over them, the maximum of each filter over the window (ReLU), one linear layer,
softmax. The windows' log-probabilities, weighed by their bytes, add up to the text's.

Training uses a bounded sample of labelled texts: PER_LANG texts of each language (by order of a hash of their
id), WINDOWS windows spread over each. Languages are all those of the labels; the network has FILTERS filters of
each width, and one more for every second language beyond twice as many.

Result of ``identified``: one row for each row of the input: doc_id, lang_pred, confidence (probability of
lang_pred), windows.

Defined cases: a null, empty or blank text (white space alone, line ends and tabs too) has lang_pred null, confidence 0 and no windows; without labelled
texts all have; a null doc_id stays null; rows are judged one by one, repeated rows alike; of equal
probabilities the alphabetically first language wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_map, table
from ._text import buffers

WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
#: Bounds of the training sample: texts of each language, windows of each text.
PER_LANG, WINDOWS = 300, 4
BROADCAST_ROWS = 200_000
EPOCHS, BATCH, RATE = 6, 32, 4e-3
_WIDE = max(WIDTHS)
#: A text that isn't blank: white space is Unicode's.
SOMETHING = r"(?U)\S"
#: Windows that go through the network at once.
AT_ONCE = 64


class Net:
    """Weights: E (256 x DIM), K (all filters, padded to the widest, as one matrix), b, U (filters x languages), c."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        each = max(FILTERS, len(languages) // 2)
        n = each * len(WIDTHS)
        self.languages = languages
        self.E = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.E[0] = 0
        self.mask = np.zeros((_WIDE * DIM, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * DIM, k * each : (k + 1) * each] = 1
        self.K = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.b = np.zeros(n, np.float32)
        self.U = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The vectors of each place's next bytes in a row: windows x places x (widest * DIM)."""
        v = self.E[x].reshape(len(x), -1)
        places = x.shape[1] - _WIDE + 1
        s = v.strides
        return np.lib.stride_tricks.as_strided(v, (len(x), places, _WIDE * DIM), (s[0], DIM * s[1], s[1]))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = np.ascontiguousarray(self.columns(x))
        z = cols.reshape(-1, _WIDE * DIM) @ self.K
        z = z.reshape(len(x), -1, z.shape[1])
        top = z.argmax(axis=1)
        return np.take_along_axis(z, top[:, None, :], 1)[:, 0] + self.b, top, cols

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Of each window (rows of bytes), the log-probability of each language."""
        cols = np.ascontiguousarray(self.columns(x))
        z = (cols.reshape(-1, _WIDE * DIM) @ self.K).reshape(len(x), -1, self.K.shape[1]).max(axis=1) + self.b
        y = np.maximum(z, 0) @ self.U + self.c
        y = y - y.max(axis=1, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=1, keepdims=True))

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for one batch."""
        z, top, cols = self.pooled(x)
        a = np.maximum(z, 0)
        s = a @ self.U + self.c
        s = s - s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        n = len(x)
        loss = float(-np.log(p[np.arange(n), y] + 1e-12).mean())
        p[np.arange(n), y] -= 1
        p /= n
        g = {"U": a.T @ p, "c": p.sum(0)}
        dz = (p @ self.U.T) * (z > 0)
        g["b"] = dz.sum(0)
        picked = cols[np.arange(n)[:, None], top]  # windows x filters x (widest * DIM)
        g["K"] = np.einsum("nf,nfd->df", dz, picked) * self.mask
        back = (dz[:, :, None] * self.K.T[None]).reshape(n, len(self.b), _WIDE, DIM)
        at = x[np.arange(n)[:, None, None], top[:, :, None] + np.arange(_WIDE)]
        g["E"] = np.zeros_like(self.E)
        np.add.at(g["E"], at.ravel(), back.reshape(-1, DIM))
        g["E"][0] = 0
        return loss, g


def train_net(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 0) -> Net:
    """Adam on the windows ``x`` with language numbers ``y``; classes count alike."""
    net, rng = Net(languages, seed), np.random.default_rng(seed)
    names = ["E", "K", "b", "U", "c"]
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    share = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)[y]
    t = 0
    for _ in range(epochs):
        order = rng.choice(len(x), len(x), p=share / share.sum())
        for s in range(0, len(order), BATCH):
            rows = order[s : s + BATCH]
            _, g = net.step(x[rows], y[rows])
            t += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                setattr(net, k, (getattr(net, k) - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
    return net


def windows(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the windows that cover all bytes of all texts."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), many)
    start = offsets[:-1][text] + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    return start, np.minimum(WINDOW, offsets[1:][text] - start), text


def matrix(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    x = raw[np.minimum(at, len(raw) - 1)]
    x[np.arange(WINDOW) >= length[:, None]] = 0
    return x


def _predict(net: Net | None):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = buffers(batch.column("text"))
        n = batch.num_rows
        blank = np.array([not t for t in batch.column("blank_free").to_pylist()])
        total, count = np.zeros((n, len(net.languages) if net else 0)), np.zeros(n, np.int64)
        if net:
            start, length, text = windows(offsets, raw)
            keep = ~blank[text]
            start, length, text = start[keep], length[keep], text[keep]
            np.add.at(count, text, 1)
            for s in range(0, len(start), AT_ONCE):
                part = slice(s, s + AT_ONCE)
                lp = net.log_probs(matrix(raw, start[part], length[part]))
                np.add.at(total, text[part], lp * (length[part] / WINDOW)[:, None])
        some = count > 0
        best = total.argmax(axis=1) if net else np.zeros(n, int)
        p = np.exp(total - total.max(axis=1, keepdims=True)) if net else total
        conf = np.where(some, 1 / np.maximum(p.sum(axis=1), 1e-12) if net else 0.0, 0.0)
        pred = [net.languages[b] if ok else None for b, ok in zip(best, some)] if net else [None] * n
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.round(conf, 6)), pa.array(count.astype(np.int32))], ["doc_id", "lang_pred", "confidence", "windows"])

    return run


def train(docs: DataFrame) -> Net | None:
    """A network for the labelled texts (column lang), or None without any."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)).alias("h"))
    rows = rows.filter("lang is not null and text is not null").filter(F.col("text").rlike(SOMETHING))
    ids = rows.select("lang", "h").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(f"k <= {PER_LANG}").select("lang", "h")
    piece = WINDOW * WINDOWS
    # the sample's keys are broadcast where their number, PER_LANG for each language at most, is small
    few = rows.select("lang").distinct().count() * PER_LANG <= BROADCAST_ROWS
    got = rows.join(F.broadcast(ids) if few else ids, ["lang", "h"], "left_semi").select("lang", "h", F.concat(*[F.substring("text", F.greatest(F.lit(1), F.floor(F.length("text") * (k / WINDOWS)) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS)]).substr(1, piece).alias("text"))
    sample = got.orderBy("lang", "h").collect()
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    off, raw = buffers(pa.array([r.text for r in sample]))
    start, length, text = windows(off, raw)
    keep = length >= 16
    if keep.any():
        start, length, text = start[keep], length[keep], text[keep]
    y = np.array([languages.index(r.lang) for r in sample])[text]
    return train_net(matrix(raw, start, length), y, languages)


def identified(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    net = train(docs if labelled is None else labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("blank_free", F.coalesce(F.col("text").rlike(SOMETHING), F.lit(False)))
    return arrow_map(rows, _predict(net), "doc_id long, lang_pred string, confidence double, windows int")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
