"""Language identification by a small byte convolutional network, trained in numpy.

Texts are cut into windows of fixed length that overlap by the widest filter less one byte, so the
windows cover every byte n-gram of a text.  Per window: byte embedding, filters of several widths,
maximum over the positions, softmax layer.  A text's logits are the mean over its windows, weighted
by their bytes.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import map_texts

WIDTHS = (2, 3, 4)
FILTERS = 10
EMBEDDING = 8
WINDOW = 256
PAD = 256
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Windows scored at once: small enough for a core's cache.
BLOCK = 64


@dataclass
class ByteCNN:
    """Weights: embedding (257, E), filters (4 E, all filters), their bias, output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, languages: list[str], seed: int) -> ByteCNN:
        rng = np.random.default_rng(seed)
        total = FILTERS * len(WIDTHS)
        scale = 1 / np.sqrt(EMBEDDING * max(WIDTHS))
        net = cls(
            languages, rng.normal(0, 1, (PAD + 1, EMBEDDING)), rng.normal(0, scale, (max(WIDTHS) * EMBEDDING, total)),
            np.zeros(total), rng.normal(0, 1 / np.sqrt(total), (total, len(languages))), np.zeros(len(languages)),
        )
        net.filters *= filter_mask()
        net.embedding[PAD] = 0
        return net

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages), embedding=self.embedding, filters=self.filters,
                 bias=self.bias, out=self.out, out_bias=self.out_bias)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ByteCNN:
        with np.load(io.BytesIO(data)) as z:
            return cls([str(x) for x in z["languages"]], z["embedding"], z["filters"], z["bias"], z["out"], z["out_bias"])

    def tables(self) -> list[np.ndarray]:
        """For each offset in a filter, what each byte adds to the filters that are that wide.

        The filters are ordered by width, so those at least ``offset + 1`` wide are the last ones.
        """
        found = []
        for offset in range(max(WIDTHS)):
            first = FILTERS * sum(w <= offset for w in WIDTHS)
            rows = self.filters[offset * EMBEDDING : (offset + 1) * EMBEDDING, first:]
            found.append(np.ascontiguousarray(self.embedding @ rows, dtype=np.float32))
        return found


def filter_mask() -> np.ndarray:
    """Zero where a filter is narrower than the widest one."""
    mask = np.zeros((max(WIDTHS), EMBEDDING, len(WIDTHS), FILTERS))
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k] = 1
    return mask.reshape(max(WIDTHS) * EMBEDDING, -1)


def train(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 8, per_text: int = 2) -> ByteCNN:
    """Adam on random crops of 8 to WINDOW bytes, so that short texts are known too."""
    languages = sorted(set(labels))
    net, rng = ByteCNN.start(languages, seed), np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    weights = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    mask, width = filter_mask(), max(WIDTHS)
    for _ in range(epochs):
        order = rng.permutation(np.repeat(np.arange(len(data)), per_text))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            x = np.full((len(chosen), WINDOW), PAD, np.int64)
            for row, k in enumerate(chosen):
                size = min(len(data[k]), WINDOW if rng.random() < 0.5 else int(rng.integers(8, WINDOW + 1)))
                start = int(rng.integers(0, len(data[k]) - size + 1))
                x[row, :size] = data[k][start : start + size]
            e = net.embedding[x]
            wide = np.concatenate([e[:, k : WINDOW - width + 1 + k] for k in range(width)], axis=2)
            answers = wide @ net.filters
            where = answers.argmax(axis=1)
            peak = np.take_along_axis(answers, where[:, None, :], 1)[:, 0] + net.bias
            hidden = np.maximum(peak, 0)
            p = softmax(hidden @ net.out + net.out_bias)
            p[np.arange(len(chosen)), target[chosen]] -= 1
            p /= len(chosen)
            d_hidden = (p @ net.out.T) * (peak > 0)
            seen = wide[np.arange(len(chosen))[:, None], where]
            d_filters = np.einsum("bf,bfk->kf", d_hidden, seen) * mask
            d_seen = d_hidden[:, :, None] * net.filters.T[None]
            d_embedding = np.zeros_like(net.embedding)
            for k in range(width):
                symbols = np.take_along_axis(x, where + k, 1)
                np.add.at(d_embedding, symbols.ravel(), d_seen[:, :, k * EMBEDDING : (k + 1) * EMBEDDING].reshape(-1, EMBEDDING))
            d_embedding[PAD] = 0
            step += 1
            grads = [d_embedding, d_filters, d_hidden.sum(0), hidden.T @ p, p.sum(0)]
            for w, g, a, b in zip(weights, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with the texts padded, the windows' starts in it, their texts and their bytes."""
    stride = WINDOW - max(WIDTHS) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + WINDOW)])
    buffer = np.full(begins[-1], PAD, np.int16)
    for t, begin in zip(texts, begins):
        buffer[begin : begin + len(t)] = np.frombuffer(t, np.uint8)
    counts = np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // stride))
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begins[owner] + place * stride
    return buffer, starts, owner, np.minimum(WINDOW, sizes[owner] - place * stride)


class Scorer:
    """Applies a network to whole texts."""

    def __init__(self, net: ByteCNN):
        self.net, self.tables = net, net.tables()

    def logits(self, texts: list[bytes]) -> np.ndarray:
        buffer, starts, owner, held = windows_of(texts)
        width, total = max(WIDTHS), self.net.bias.size
        positions = WINDOW - width + 1
        peaks = np.empty((len(starts), total), np.float32)
        for at in range(0, len(starts), BLOCK):
            x = buffer[starts[at : at + BLOCK, None] + np.arange(WINDOW)]
            answers = self.tables[0][x[:, :positions].ravel()].reshape(len(x), positions, total)
            for offset in range(1, width):
                part = self.tables[offset]
                answers[:, :, total - part.shape[1] :] += part[x[:, offset : offset + positions].ravel()].reshape(len(x), positions, -1)
            answers.max(axis=1, out=peaks[at : at + BLOCK])
        scores = np.maximum(peaks + self.net.bias, 0) @ self.net.out + self.net.out_bias
        weight = np.maximum(held, 1).astype(float)
        found = np.zeros((len(texts), scores.shape[1]))
        np.add.at(found, owner, scores * weight[:, None])
        return found / np.maximum(np.bincount(owner, weight, len(texts)), 1)[:, None]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        if rows:
            p = softmax(self.logits([texts[k].encode() for k in rows]))
            for k, best, row in zip(rows, p.argmax(axis=1), p):
                names[k], scores[k] = self.net.languages[best], float(row[best])
        return names, scores


def fit(df: DataFrame, text: str, label: str, learn: Column, key: str, per_language: int = 2000, crop: int = 600) -> bytes | None:
    """Train on a bounded sample; None where nothing can be learned from.

    The sample: of each language the ``per_language`` rows with the least hash of the key, and of
    each of these texts ``crop`` characters at a place that follows from the hash.  One task trains.
    """
    mixed = F.xxhash64(F.lit("language"), key)
    labelled = df.filter(learn & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    size = F.length(text)
    start = F.lit(1) + F.pmod(mixed, F.greatest(size - crop + 1, F.lit(1)))
    counts = labelled.groupBy(F.col(label).alias("language")).agg(F.count("*").alias("all"))
    part = F.pmod(F.xxhash64(F.lit("part"), key), F.lit(1_000_000_007))  # few more rows than wanted are ranked
    # a row per language, as the network's output layer has
    labelled = labelled.join(F.broadcast(counts), F.col(label) == F.col("language")).filter(part <= F.lit(4.0 * per_language * 1_000_000_007) / F.col("all"))
    rows = labelled.select(
        F.col(label).alias("label"), mixed.alias("mixed"), F.substring(text, start.cast("int"), F.lit(crop)).alias("crop"),
    )
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("mixed", "crop")))
    sample = ranked.filter(F.col("place") <= per_language).select("label", "crop", "mixed")

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["mixed"], r["crop"], r["label"]) for b in batches for r in b.to_pylist())
        if found:
            net = train([x[1] for x in found], [x[2] for x in found])
            yield pa.RecordBatch.from_arrays([pa.array([net.dump()], pa.binary())], names=["net"])

    rows = sample.repartition(1).mapInArrow(learn_all, "net binary").collect()
    return bytes(rows[0]["net"]) if rows else None


def identify(df: DataFrame, net: bytes | None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with lang_pred and score, one row per input row, from the whole text.

    ``und`` with score 0 where the text is null, empty or without a letter, or where ``net`` is None
    (nothing to learn from).  Repeated rows stay; ties between languages go to the first by name; an
    empty table gives an empty table; a kept column named like a result gives way to it.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)  # some 30 KB, whatever the corpus

    def make() -> Callable[[list[str | None]], Sequence]:
        if shared.value is None:
            return lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return Scorer(ByteCNN.load(shared.value))

    return map_texts(df, keep, text, "lang_pred string, score double", make)
