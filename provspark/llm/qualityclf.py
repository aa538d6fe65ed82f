"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import bounded_batches, each_text, materialize

FILTERS, WIDTH, CHUNK = 8, 4, 512
#: Labelled rows that a model is fitted on, at most, for each class.
SAMPLE = 1000


def chunk_starts(n: int, chunk: int = CHUNK) -> np.ndarray:
    """Starts of chunks of ``chunk`` windows that cover all windows; they overlap by half."""
    return np.arange(0, max(n, 1), chunk // 2)


@dataclass
class Network:
    """filters (F, WIDTH, 256), bias (F,), out (2 F + 1,): a logistic layer on the chunks' mean and largest activations."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each pair of filter places, the summed weight of every byte pair: (65536, F)."""
        pairs = [self.filters[:, k, :, None] + self.filters[:, k + 1, None, :] for k in range(0, WIDTH, 2)]
        return [np.ascontiguousarray(p.transpose(2, 1, 0).reshape(65536, -1), np.float32) for p in pairs]


def pad(raw: bytes | None) -> np.ndarray:
    data = np.frombuffer(raw or b"", np.uint8)
    return np.concatenate([data, np.zeros(max(WIDTH - len(data), WIDTH - 1), np.uint8)])


def activations(data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """The filters' responses at every window of WIDTH bytes: (windows, F)."""
    pairs = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8))
    n = len(data) - WIDTH + 1
    total = tables[0][pairs[:n]]
    for k in range(1, WIDTH // 2):
        total += tables[k][pairs[2 * k : 2 * k + n]]
    return total


def features(raw: bytes | None, tables: list[np.ndarray], bias: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Mean and largest pooled activation over all chunks of the whole text, and 1. Long texts go block by block."""
    data, parts = pad(raw), []
    for at in range(0, len(data) - WIDTH + 1, block):
        parts.append(np.maximum.reduceat(t := activations(data[at : at + block + WIDTH - 1], tables), chunk_starts(len(t)), axis=0))
    halves = np.concatenate(parts)
    acts = np.tanh(np.maximum(halves, np.concatenate([halves[1:], halves[-1:]])) + bias)
    return np.concatenate([acts.mean(axis=0), acts.max(axis=0), [1.0]])


def probability(raw: bytes | None, net: Network, tables: list[np.ndarray]) -> float:
    z = float(features(raw, tables, net.bias) @ net.out)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: Iterable[bytes | None], labels: list[int], epochs: int = 16, rate: float = 0.02, batch: int = 32, seed: int = 7) -> Network:
    """Adam on the log loss of the whole network, gradients through the pooling to each chunk's winning windows.

    ``texts`` gives the whole texts anew, in the order of ``labels``, for each epoch; one batch is held at a time.
    Both classes weigh the same. One class or no rows: a constant network (0.5, or near the one class).
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.15, (FILTERS, WIDTH, 256)), np.zeros(FILTERS), np.concatenate([rng.normal(0, 0.5, 2 * FILTERS), [0.0]]))
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        net.out[:] = 0
        net.out[-1] = 0 if len(y) == 0 else (3 if y[0] else -3)
        return net
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    values = [net.filters, net.bias, net.out]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        rows = zip(texts, y, share)
        while chosen := list(islice(rows, batch)):
            tables, grads = net.tables(), [np.zeros_like(v) for v in values]
            for raw, label, weight in chosen:
                _backward(pad(raw), label, weight / len(chosen), net, tables, grads)
            step += 1
            for k, (v, g) in enumerate(zip(values, grads)):
                g = g + 1e-4 * v
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                v -= rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def winners(x: np.ndarray, tables: list[np.ndarray], block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Of each half chunk of a whole padded text, block by block: each filter's largest response, and the window that has it."""
    width, top, at = CHUNK // 2, [], []
    for lo in range(0, len(x) - WIDTH + 1, block):
        total = activations(x[lo : lo + block + WIDTH - 1], tables)
        n = -(-len(total) // width)
        cells = np.full((n * width, FILTERS), -np.inf, np.float32)
        cells[: len(total)] = total
        best = cells.reshape(n, width, FILTERS).argmax(axis=1) + chunk_starts(len(total))[:, None]
        top.append(np.take_along_axis(total, best, axis=0))
        at.append(best + lo)
    return np.concatenate(top), np.concatenate(at)


def _backward(x: np.ndarray, y: float, weight: float, net: Network, tables: list, grads: list) -> None:
    halves, win = winners(x, tables)
    n, cols = len(halves), np.arange(FILTERS)
    after = np.concatenate([halves[1:], halves[-1:]])
    win = np.where(after > halves, np.concatenate([win[1:], win[-1:]]), win)
    acts = np.tanh(np.maximum(halves, after) + net.bias)
    feats = np.concatenate([acts.mean(axis=0), acts.max(axis=0), [1.0]])
    p = 1 / (1 + np.exp(-np.clip(feats @ net.out, -30, 30)))
    d = weight * (p - y)
    grads[2] += d * feats
    d_acts = np.repeat((d * net.out[:FILTERS] / n)[None], n, axis=0)
    d_acts[acts.argmax(axis=0), cols] += d * net.out[FILTERS : 2 * FILTERS]
    d_pre = d_acts * (1 - acts * acts)
    grads[1] += d_pre.sum(axis=0)
    for k in range(WIDTH):
        np.add.at(grads[0][:, k, :], (np.broadcast_to(cols, win.shape), x[win + k]), d_pre)


def held_out(column: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """True where crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


class Sample:
    """The whole texts of a fit, in one order, as often as they are asked for.

    Up to ``most`` bytes are kept in the driver; beyond that every epoch reads them again from their table in the
    shared folder, a small partition at a time. Both ways give the same texts in the same order.
    """

    def __init__(self, rows: DataFrame, most: int = 100_000_000):
        held = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
        self.rows = rows
        self.kept = [bytes(r.raw or b"") for r in rows.orderBy("h", "doc_id").select("raw").toLocalIterator()] if held <= most else None

    def __iter__(self) -> Iterator[bytes]:
        if self.kept is not None:
            return iter(self.kept)
        return (bytes(r.raw or b"") for r in self.rows.repartitionByRange(200, "h").sortWithinPartitions("h", "doc_id").select("raw").toLocalIterator())


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Network:
    """Fit on at most ``per_class`` labelled rows of each class that are not held out, chosen by a hash of the id.

    Null labels or ids take no part; an id with several labels counts as its smallest one, an id with several texts
    by its smallest one. Rows are bounded, texts are not: the fit sees all of each text.
    """
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    own = own.where(~held_out()).withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    parts = [own.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    rows = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")  # at most 2 * per_class ids
    rows = materialize(rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("h").alias("h"), F.min("raw").alias("raw")), "clf-sample")
    return fit(Sample(rows), [r.y for r in rows.select("y", "h", "doc_id").orderBy("h", "doc_id").collect()])


def score(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; a null or empty text is scored as no bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch in batches:
            p = np.array([probability(x, net, tables) for x in each_text(batch.column(1))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text the classifier accepts, whatever their id; a row's own text decides, without a shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch in batches:
            yield batch.filter(pa.array([probability(x, net, tables) >= threshold for x in each_text(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
