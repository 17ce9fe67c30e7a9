"""Quality classifier: a convolutional network over bytes, in numpy.

A filter looks at ``WIDTH`` bytes and adds a learned weight for each. Documents are cut into chunks of
512 bytes that overlap by 64, through to their last byte. In each chunk every filter keeps its largest
response; the mean and the maximum of these over all chunks make one logistic probability.

Training takes a bounded sample: for either label ``sample`` rows in the order of a hash of their ids, of
which those of at most ``longest`` bytes count, so the driver's share does not grow with the data. Scoring needs no
shuffle: weights are broadcast (fixed size), every row is scored where it is, whole. Weights of two
neighbouring bytes are added up beforehand, so a filter costs two look-ups for four bytes.

Defined results: null and empty texts have no chunk and get the score of all-zero responses; without rows
of both labels to learn from, every score is the share of label 1 (0.5 without any rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 4
BLOCK, BLOCKS, STEP = 64, 8, 7  # a chunk is 8 blocks of 64 bytes; the next one starts 7 blocks later
MOST_BYTES_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the training."""

    sample: int = 1500
    longest: int = 20_000
    filters: int = 16
    rounds: int = 6
    rate: float = 0.02
    batch: int = 16
    seed: int = 7


@dataclass
class Network:
    weights: np.ndarray  # WIDTH x 256 x filters
    bias: np.ndarray  # filters
    mean: np.ndarray  # filters
    peak: np.ndarray  # filters
    offset: float

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of two neighbouring bytes together, for the first and the last two bytes."""
        first, second, third, fourth = self.weights
        filters = len(self.bias)
        front = (first[:, None] + second[None] + self.bias).reshape(-1, filters)
        return front, (third[:, None] + fourth[None]).reshape(-1, filters)

    def probability(self, mean: np.ndarray, peak: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(mean @ self.mean + peak @ self.peak + self.offset, -30, 30)))


def _padded(text: bytes) -> np.ndarray:
    """The bytes, with zeros up to a whole filter and a whole block."""
    size = max(len(text), WIDTH)
    whole = -(-(size - WIDTH + 1) // BLOCK) * BLOCK + WIDTH - 1
    data = np.zeros(whole, np.int32)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return data


def block_peaks(text: bytes, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Largest response of each filter in each block, for texts of any length."""
    front, back = tables
    data = _padded(text)
    pair = data[:-1] * 256 + data[1:]
    parts = []
    for start in range(0, len(data) - WIDTH + 1, MOST_BYTES_AT_ONCE):
        stop = min(start + MOST_BYTES_AT_ONCE, len(data) - WIDTH + 1)
        response = front[pair[start:stop]] + back[pair[start + 2 : stop + 2]]
        parts.append(response.reshape(-1, BLOCK, response.shape[1]).max(axis=1))
    return np.maximum(np.concatenate(parts), 0)


def chunk_bounds(blocks: int) -> list[tuple[int, int]]:
    starts = range(0, max(1, blocks - (BLOCKS - STEP)), STEP)
    return [(s, min(s + BLOCKS, blocks)) for s in starts]


def responses(text: bytes, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum over all chunks of each filter's largest response."""
    if not text:
        zero = np.zeros(tables[0].shape[1], np.float32)
        return zero, zero
    peaks = block_peaks(text, tables)
    chunks = np.array([peaks[a:b].max(axis=0) for a, b in chunk_bounds(len(peaks))])
    return chunks.mean(axis=0), chunks.max(axis=0)


class _Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= scale * m / (np.sqrt(v) + 1e-8)


def train(texts: list[bytes], labels: list[int], settings: Training = Training()) -> Network:
    """Gradient descent on the log loss; a filter learns from the places where it responded most."""
    random = np.random.default_rng(settings.seed)
    filters = settings.filters
    weights = random.normal(0, 0.1, (WIDTH, 256, filters)).astype(np.float32)
    bias = np.zeros(filters, np.float32)
    mean = random.normal(0, 0.3, filters).astype(np.float32)
    peak = random.normal(0, 0.1, filters).astype(np.float32)
    offset = np.zeros(1, np.float32)
    share = float(np.mean(labels)) if labels else 0.5
    if not 0 < share < 1:
        zero = np.zeros(filters, np.float32)
        return Network(weights, bias, zero, zero, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    network = Network(weights, bias, mean, peak, 0.0)
    adam = _Adam([weights, bias, mean, peak, offset], settings.rate)
    column = np.arange(filters)
    for _ in range(settings.rounds):
        order = random.permutation(len(texts))
        for first in range(0, len(order), settings.batch):
            gradients = [np.zeros_like(p) for p in adam.parameters]
            chosen = order[first : first + settings.batch]
            for i in chosen:
                data = _padded(texts[i])
                n = len(data) - WIDTH + 1
                response = bias + sum(weights[k][data[k : k + n]] for k in range(WIDTH))
                blocks = response.reshape(-1, BLOCK, filters)
                place = blocks.argmax(axis=1) + np.arange(len(blocks))[:, None] * BLOCK
                value = np.take_along_axis(response, place, axis=0)
                bounds = chunk_bounds(len(blocks))
                best = np.array([a + value[a:b].argmax(axis=0) for a, b in bounds])
                chunk = np.maximum(value[best, column], 0)
                top = chunk.argmax(axis=0)
                average, highest = chunk.mean(axis=0), chunk[top, column]
                p = 1 / (1 + np.exp(-np.clip(average @ mean + highest @ peak + offset[0], -30, 30)))
                error = (p - labels[i]) / len(chosen)
                gradients[2] += error * average
                gradients[3] += error * highest
                gradients[4] += error
                back = np.tile(error * mean / len(bounds), (len(bounds), 1)).astype(np.float32)
                back[top, column] += error * peak
                back *= chunk > 0
                at = place[best, column]
                gradients[1] += back.sum(axis=0)
                for k in range(WIDTH):
                    np.add.at(gradients[0][k], (data[at + k], column[None, :]), back)
            for g, p in zip(gradients, adam.parameters, strict=True):
                g += 1e-5 * p
            adam.update(gradients)
    network.offset = float(offset[0])
    return network


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, settings: Training = Training()) -> DataFrame:
    """(text, quality) of the bounded sample; ``usable`` is a condition on ``doc_id``."""
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality").where(usable)
    picked = [
        known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
        for label in (0, 1)
    ]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * settings.sample rows
    fits = F.octet_length("text").between(1, settings.longest)
    return docs.select("doc_id", "text").where(fits).join(chosen, "doc_id").select("text", "quality").limit(2 * settings.sample)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, settings: Training = Training()) -> Network:
    rows = training_rows(docs, labels, usable, settings).collect()  # at most 2 * settings.sample rows
    rows.sort(key=lambda r: (r["text"], r["quality"]))  # rows come in any order, the training goes by one
    return train([r["text"].encode() for r in rows], [r["quality"] for r in rows], settings)


def score(docs: DataFrame, network: Network, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (*network.pairs(), network.mean, network.peak, network.offset)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front, back, mean, peak, offset = shared.value
        for batch in batches:
            found = [responses(t.encode() if t else b"", (front, back)) for t in batch["text"]]
            logits = [float(m @ mean + p @ peak + offset) for m, p in found]
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -30, 30)))
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "score": scores})

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "id long, score double").withColumnRenamed("id", id)
