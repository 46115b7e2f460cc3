"""Document quality by a factorisation machine.

A text is a sparse vector: hashed words with logarithmic counts, scaled to length one, and
structure statistics (shares of symbols, capitals, digits and so on, size, repetition), each as a
number and as one of ten steps. The score is a logistic factorisation machine: a weight for each
feature and, for each pair of features, the product of their rank-8 vectors. The sum over all
pairs is had in linear time as half the square of the sum minus the sum of the squares.

The model is fitted on a bounded sample of labelled rows (``max_rows``) in one task; its size is
fixed (hash buckets x (1 + rank) numbers), and every text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave.llm import textbytes
from auditweave.llm.tables import least_hashes, small_batches
from auditweave.session import send_with_tasks

send_with_tasks(__name__)
send_with_tasks(textbytes.__name__)

BUCKETS, RANK, STEPS = 1 << 14, 8, 10
STATISTICS = ("symbols", "capitals", "digits", "stops", "marks", "word length", "same word again", "distinct words",
              "same line again", "size", "lines")
WIDTH = BUCKETS + len(STATISTICS) * (STEPS + 1)


def _class_of_bytes(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(members)] = 1
    return out


_CLASSES = (b"#*$%&|<>@^~_={}[]\\/+", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"!?")
_CLASSES = tuple(_class_of_bytes(c) for c in _CLASSES)


def _statistics(texts: textbytes.Texts) -> np.ndarray:
    """One row of numbers in [0, 1] per text."""
    bounds, wb, n = texts.bounds, texts.word_bounds, len(texts)
    size, words = np.diff(bounds), np.diff(wb)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)

    def total(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(values))[at])

    shares = [total(c[texts.data], bounds) for c in _CLASSES]
    same = np.append(False, texts.hashes[1:] == texts.hashes[:-1])[:len(texts.hashes)]
    owner = np.repeat(np.arange(n), words)
    order = np.lexsort((texts.hashes, owner))
    new = np.append(True, (texts.hashes[order][1:] != texts.hashes[order][:-1]) | (owner[1:] != owner[:-1]))[:len(owner)]
    lines = np.empty((n, 2))
    for i in range(n):
        found = [x for x in texts.data[bounds[i]:bounds[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i] = len(found), len(found) - len(set(found))
    columns = [s / per_byte * f for s, f in zip(shares, (5, 2, 5, 5, 10), strict=True)]
    columns += [total(texts.last - texts.first, wb) / per_word / 20, total(same, wb) / per_word, total(new, wb) / per_word,
                lines[:, 1] / np.maximum(lines[:, 0], 1), np.log1p(words) / 12, np.log1p(lines[:, 0]) / 8]
    return np.clip(np.stack(columns, axis=1), 0, 1)


def features(texts: textbytes.Texts, lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in compressed form: row bounds, feature numbers, values. ``lowered``: word hashes without case."""
    n = len(texts)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(texts.word_bounds))
    cell, count = np.unique(owner * BUCKETS + (lowered % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, value = cell // BUCKETS, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / norm[row]
    numbers = _statistics(texts)
    width = len(STATISTICS)
    at = BUCKETS + np.arange(width) * (STEPS + 1)
    step = at + 1 + np.minimum((numbers * STEPS).astype(np.int64), STEPS - 1)
    extra = np.concatenate([np.tile(at, (n, 1)), step], axis=1)
    values = np.concatenate([numbers, np.full((n, width), 0.5)], axis=1)
    rows = np.concatenate([row, np.repeat(np.arange(n), 2 * width)])
    order = np.argsort(rows, kind="stable")
    index = np.concatenate([cell % BUCKETS, extra.ravel()])[order]
    return np.searchsorted(rows[order], np.arange(n + 1)), index, np.concatenate([value, values.ravel()])[order]


class Machine:
    def __init__(self, packed: np.ndarray | None = None):
        if packed is None:
            packed = np.zeros(1 + WIDTH * (1 + RANK), np.float32)
        self.bias, self.weights, self.vectors = packed[0], packed[1:1 + WIDTH], packed[1 + WIDTH:].reshape(WIDTH, RANK)

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.bias], self.weights, self.vectors.ravel()]).astype(np.float32)

    def raw(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums and products the gradient uses. No row is empty."""
        product = self.vectors[index] * value[:, None]
        sums = np.add.reduceat(product, bounds[:-1])
        pairs = (sums * sums - np.add.reduceat(product * product, bounds[:-1])).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.weights[index] * value, bounds[:-1]) + pairs, sums, product


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 128,
        rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Adaptive gradient steps on the logistic loss, in a fixed shuffled order."""
    random = np.random.default_rng(11)
    machine = Machine()
    machine.vectors = random.normal(0, 0.01, (WIDTH, RANK)).astype(np.float32)
    machine.weights = machine.weights.copy()
    seen = [1e-6, np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, RANK), 1e-6, np.float32)]
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            chosen = order[start:start + batch]
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            bounds = np.append(0, np.cumsum([len(rows[i][0]) for i in chosen]))
            score, sums, product = machine.raw(bounds, index, value)
            error = (sigmoid(score) - labels[chosen]) / len(chosen)
            wide = np.repeat(error, np.diff(bounds))
            touched, local = np.unique(index, return_inverse=True)
            down = np.zeros(len(touched), np.float32)
            np.add.at(down, local, wide * value)
            down += decay * machine.weights[touched]
            deep = np.zeros((len(touched), RANK), np.float32)
            np.add.at(deep, local, (wide * value)[:, None] * (np.repeat(sums, np.diff(bounds), axis=0) - product))
            deep += decay * machine.vectors[touched]
            seen[0] += error.sum() ** 2
            machine.bias = machine.bias - rate * error.sum() / np.sqrt(seen[0])
            seen[1][touched] += down ** 2
            machine.weights[touched] -= rate * down / np.sqrt(seen[1][touched])
            seen[2][touched] += deep ** 2
            machine.vectors[touched] -= rate * deep / np.sqrt(seen[2][touched])
    return machine


def _of_batch(batch: pa.RecordBatch, column: str):
    for rows, texts in textbytes.columns_of(batch, column):
        lowered = textbytes.Texts(textbytes._LOWER[texts.data], texts.bounds, False).hashes
        yield rows, features(texts, lowered)


def _featurise(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("index", pa.binary()), ("value", pa.binary())])
    for batch in batches:
        for rows, (bounds, index, value) in _of_batch(batch, "text"):
            index, value = index.astype(np.int32), value.astype(np.float32)
            cut = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id")[rows], batch.column("label")[rows],
                pa.array([index[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([value[a:b].tobytes() for a, b in cut], pa.binary())], schema=schema)


def _train(batches):
    ids, labels, rows = [], [], []
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        labels += batch.column("label").to_pylist()
        rows += [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32))
                 for i, v in zip(batch.column("index").to_pylist(), batch.column("value").to_pylist(), strict=True)]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], len(rows[i][0])))
    machine = fit([rows[i] for i in order], np.array([labels[i] for i in order], np.float32)) if rows else Machine()
    yield pa.RecordBatch.from_arrays([pa.array([machine.packed().tobytes()], pa.binary())], names=["model"])


def _score(packed: bytes):
    model = {}

    def run(batches):
        if not model:
            model["m"] = Machine(np.frombuffer(packed, np.float32))
        for batch in batches:
            scores = [sigmoid(model["m"].raw(*x)[0]) for _, x in _of_batch(batch, "text")]
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; false for a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> bytes:
    """Fit on at most ``max_rows`` labelled rows, those of least id hash; the model's size is fixed.

    Rows that share an id are bounded with the others, by a hash of id, label and text. Learned from: rows of ``labels`` (doc_id, quality) that are not :func:`held_out`, with their text in
    ``docs``. NULL labels and ids are left out. Without any row every score is 0.5.
    """
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select(
        F.col("doc_id").cast("bigint").alias("__id"), F.col("quality").cast("int").alias("label")).distinct()
    usable = usable.withColumn("__h", F.shiftrightunsigned(F.xxhash64("__id", "label"), 4))
    chosen = usable.join(F.broadcast(least_hashes(usable.select("__h"), "__h", max_rows)), "__h").drop("__h")
    # At most max_rows pairs of numbers.
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(
        "doc_id", "label", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "label", "text"), 4).alias("h"))
    # An id may have any number of rows, so the rows themselves are bounded again; equal ones count once.
    least = F.broadcast(least_hashes(rows.select("h"), "h", max_rows))
    rows = rows.join(least, "h").dropDuplicates(["h"]).select("doc_id", "label", "text")
    sample = rows.mapInArrow(_featurise, "doc_id bigint, label int, index binary, value binary")
    return bytes(sample.repartition(1).mapInArrow(_train, "model binary").collect()[0]["model"])


def with_score(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with ``score``: the probability of a good text.

    NULL text: as the empty one, which has a score too. Every row is scored, repeated ones alike. An
    input column named ``score`` is replaced. Empty table: no row.
    """
    docs = small_batches(docs).drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_score(model), schema)
