"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score of a text: logistic of ``w0 + sum(w x) + 1/2 sum_f((sum(v_f x))^2 - sum(v_f^2 x^2))``; the
pairwise part is linear in the features that a text has (sum-of-squares identity).
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.common import byte_groups

WORD_BUCKETS = 1 << 16
FACTORS = 8
#: Quantile bins per statistic; each bin is a feature of its own.
BINS = 12
REMEMBERED = 1_000_000

_CLASSES = np.zeros((6, 256))
_CLASSES[0, 65:91] = 1
_CLASSES[1, 48:58] = 1
_CLASSES[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1
_CLASSES[3, [ord(c) for c in "#$%&*+<=>@^_~{}[]\\/!"]] = 1
_CLASSES[4, ord("|")] = 1
_CLASSES[5, [9, 10, 11, 12, 13, 32]] = 1


class Features:
    """Word buckets with their counts, and statistics, of whole texts."""

    def __init__(self, remembered: int = REMEMBERED):
        self.buckets: dict[str, int] = {}
        self.remembered = remembered

    def _bucket(self, word: str) -> int:
        return zlib.crc32(word.encode()) % WORD_BUCKETS

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = (text or "").encode()
        words = (text or "").lower().split()
        if len(self.buckets) > self.remembered:
            self.buckets.clear()
        known = self.buckets
        try:
            ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        except KeyError:
            for word in set(words).difference(known):
                known[word] = self._bucket(word)
            ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        ids, counts = np.unique(ids, return_counts=True)
        return ids, counts, self._statistics(data, len(words), ids, counts)

    def _statistics(self, data: bytes, n_words: int, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sizes, shares of byte classes, repetition of words and lines, longest line, last character."""
        histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        size, words = max(1, len(data)), max(1, n_words)
        lines = [x for x in data.split(b"\n") if x]
        upper, digits, punctuation, symbols, pipes, spaces = (_CLASSES @ histogram).tolist()
        return np.array([
            np.log1p(len(data)), np.log1p(n_words), np.log1p(len(lines)), len(data) / words, upper / size,
            digits / size, punctuation / size, symbols / size, pipes / words, spaces / size,
            histogram[128:].sum() / size, len(ids) / words, len(set(lines)) / max(1, len(lines)),
            max(map(len, lines), default=0) / size, (counts.max() if len(counts) else 0) / words,
            float(data.rstrip()[-1:] in (b".", b"!", b"?")),
        ])


@dataclass
class Machine:
    """Features: word buckets, then a bin for each statistic, then a bin for each metadata column."""

    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, edges=self.edges, w0=self.w0, w=self.w.astype(np.float32), v=self.v.astype(np.float32))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Machine:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["edges"], float(z["w0"]), z["w"].astype(float), z["v"].astype(float))

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        index, value, starts = flat(rows)
        return 1 / (1 + np.exp(-np.clip(raw(index, value, starts, self.w0, self.w, self.v)[0], -60, 60)))


def vector(ids: np.ndarray, counts: np.ndarray, numbers: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words scaled to length one, and one bin per number (a NaN has a bin of its own)."""
    value = np.sqrt(counts.astype(float))
    value /= max(1e-9, np.sqrt((value**2).sum()))
    bins = [BINS if np.isnan(x) else int(np.searchsorted(e, x, side="right")) for x, e in zip(numbers, edges)]
    place = WORD_BUCKETS + np.arange(len(numbers)) * (BINS + 1) + bins
    return np.concatenate([ids, place]).astype(np.int64), np.concatenate([value, np.full(len(numbers), 0.5)])


def flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r[0]) for r in rows])
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes


def raw(index, value, starts, w0, w, v):
    """Logits and, for training, the sums per factor."""
    scaled = v[index] * value[:, None]
    sums = np.add.reduceat(scaled, starts, axis=0)
    squares = np.add.reduceat(scaled * scaled, starts, axis=0)
    return w0 + np.add.reduceat(w[index] * value, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums


def train(rows: list[tuple], labels: np.ndarray, seed: int = 7, epochs: int = 12) -> Machine:
    """AdaGrad on the logistic loss in small batches; bins from the sample's quantiles."""
    numbers = np.array([r[2] for r in rows])
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.array([np.quantile(c[~np.isnan(c)], steps) if (~np.isnan(c)).any() else np.zeros(len(steps)) for c in numbers.T])
    vectors = [vector(*r, edges) for r in rows]
    rng, size = np.random.default_rng(seed), WORD_BUCKETS + numbers.shape[1] * (BINS + 1)
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))
    gw, gv, w0, g0 = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 0.0, 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 32):
            chosen = order[at : at + 32]
            index, value, starts = flat([vectors[k] for k in chosen])
            logit, sums = raw(index, value, starts, w0, w, v)
            error = 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[chosen]
            owner = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(index))))
            pull = error[owner] * value
            used, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, pull) + 1e-5 * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, where, pull[:, None] * (sums[owner] - v[index] * value[:, None]))
            dv += 1e-4 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += error.sum() ** 2
            w[used] -= 0.1 * dw / np.sqrt(gw[used])
            v[used] -= 0.05 * dv / np.sqrt(gv[used])
            w0 -= 0.1 * error.sum() / np.sqrt(g0)
    return Machine(edges, w0, w, v)


def fit(
    df: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", label: str = "quality", text: str = "text",
    metadata: Sequence[str] = ("n_chars",), max_rows: int = 8000,
) -> bytes | None:
    """Train on a bounded sample of labelled rows; None where there is none.

    The sample: the ``max_rows`` labels with the least hash of the key among those that ``learn``
    keeps; so the side that is broadcast to the texts is bounded too.  The texts' features, not the
    texts, meet in the one task that trains.
    """
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull())
    chosen = known.select(key, F.col(label).cast("int").alias("__label")).orderBy(F.xxhash64(F.lit("quality"), key), key, "__label").limit(max_rows)
    joined = df.select(key, F.col(text).alias("__text"), *[F.col(m).cast("double").alias(f"__m{k}") for k, m in enumerate(metadata)]).join(F.broadcast(chosen), key)
    fields = "ids binary, counts binary, numbers binary, label int"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in byte_groups(batch, 1, 4 << 20):
                out = []
                for row in part.to_pylist():
                    ids, counts, numbers = features(row["__text"])
                    extra = [np.nan if row[f"__m{k}"] is None else row[f"__m{k}"] for k in range(len(metadata))]
                    out.append((ids.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), np.append(numbers, extra).tobytes(), row["__label"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.binary()] * 3 + [pa.int32()])], names=["ids", "counts", "numbers", "label"])

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["numbers"], r["ids"], r["counts"], r["label"]) for b in batches for r in b.to_pylist())
        if found:
            rows = [(np.frombuffer(i, np.int32), np.frombuffer(c, np.int32), np.frombuffer(n)) for n, i, c, _ in found]
            machine = train(rows, np.array([float(x[3] > 0) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array([machine.dump()], pa.binary())], names=["machine"])

    rows = joined.mapInArrow(describe, fields).repartition(1).mapInArrow(learn_all, "machine binary").collect()
    return bytes(rows[0]["machine"]) if rows else None


def score(
    df: DataFrame, machine: bytes | None, keep: Sequence[str] = ("doc_id",), text: str = "text",
    metadata: Sequence[str] = ("n_chars",), threshold: float = 0.3,
) -> DataFrame:
    """``keep`` with score (0 to 1) and predicted (1 where score >= threshold), one row per input row.

    A null text scores as an empty one: by its statistics and metadata.  Null metadata has a feature of its own.
    Without a machine (no labels) the score is 0.5.  Repeated rows stay; an empty table gives an empty
    table; a kept column named like a result gives way to it.
    """
    shared = df.sparkSession.sparkContext.broadcast(machine)  # below 5 MB, set by the parameters
    numbers = [f"__m{k}" for k in range(len(metadata))]
    keep = [c for c in keep if c not in ("score", "predicted")]
    extra = [F.col(m).cast("double").alias(n) for n, m in zip(numbers, metadata)]
    source = df.select(*keep, *extra, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, known = Features(), Machine.load(shared.value) if shared.value else None
        for batch in batches:
            for part in byte_groups(batch, len(keep) + len(numbers), 1 << 20):
                found = [0.5] * len(part)
                if known:
                    rest = zip(*[part.column(len(keep) + k).to_pylist() for k in range(len(numbers))]) if numbers else [()] * len(part)
                    rows = []
                    for t, values in zip(part.column(len(keep) + len(numbers)).to_pylist(), rest):
                        ids, counts, own = features(t)
                        rows.append(vector(ids, counts, np.append(own, [np.nan if x is None else x for x in values]), known.edges))
                    found = known.score(rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
