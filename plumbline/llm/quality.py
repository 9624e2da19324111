"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated scores.

Every word (letters and digits, or a run of other signs) falls into one of ``WORDS`` hashed slots. A slot has a sparse
random index vector; its context vector is the sum of the index vectors of its neighbours over the whole corpus. Spark sums
them: each task adds up its own documents and sends one row per slot. A document is the mean of its words' context and index
vectors with their lengths. The network is trained with numpy on at most ``SAMPLE_ROWS`` labelled documents; a part of them
is kept aside to find the temperature that calibrates the probabilities.

The model has a fixed size (``WORDS`` x ``DIMENSIONS``), whatever the size of the corpus.

Defined results: null and empty texts have no words and get the network's score for an empty document; repeated
documents get equal scores; without labels of both kinds every score is the share of label 1 (0.5 without labels); an
empty table gives an empty result; further columns are ignored (train, score) or kept (keep_good).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.llm.common import as_bytes, blocks, map_blocks, pick

WORDS = 1 << 14
DIMENSIONS = 64
NONZERO = 8
REACH = 2
SAMPLE_ROWS = 12_000
HIDDEN = 32
PIECE = 100_000
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


def index_vectors(seed: int = 7) -> np.ndarray:
    """One sparse vector of +1 and -1 per slot, and a zero vector for the gaps between documents."""
    random = np.random.default_rng(seed)
    vectors = np.zeros((WORDS + 1, DIMENSIONS), np.int8)
    places = random.random((WORDS, DIMENSIONS)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(vectors[:WORDS], places, random.choice(np.array([-1, 1], np.int8), (WORDS, NONZERO)), axis=1)
    return vectors


def slots(text: bytes | None) -> np.ndarray:
    found = TOKEN.findall(text or b"")
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & (WORDS - 1)


def context_sums(docs: DataFrame, text_col: str) -> DataFrame:
    """Per slot: how often it occurs (``n``) and the sum of its neighbours' index vectors (``d0``, ``d1``, ...)."""
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())]
                          + [T.StructField(f"d{k}", T.LongType()) for k in range(DIMENSIONS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        sums = np.zeros((WORDS + 1, DIMENSIONS), np.int64)
        counts = np.zeros(WORDS + 1, np.int64)
        gap = np.full(REACH, WORDS)
        for block in blocks(batches, 0):
            held = [part for t in as_bytes(block.column(0)) for part in (slots(t), gap)]
            words = np.concatenate([gap, *held]) if held else gap
            for start in range(0, len(words), PIECE):
                # each piece sees its neighbours on both sides
                ids = words[max(0, start - REACH):start + PIECE + REACH]
                skip, size = min(start, REACH), min(PIECE, len(words) - start)
                near = index[ids]
                around = np.zeros_like(near)
                for step in range(1, REACH + 1):
                    around[step:] += near[:-step]
                    around[:-step] += near[step:]
                own, around = ids[skip:skip + size], around[skip:skip + size]
                order = np.argsort(own, kind="stable")
                which, first = np.unique(own[order], return_index=True)
                sums[which] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
                counts += np.bincount(own, minlength=WORDS + 1)
        used = np.flatnonzero(counts[:WORDS])
        columns = {"slot": pa.array(used.astype(np.int32)), "n": pa.array(counts[used])}
        yield pa.record_batch(columns | {f"d{k}": pa.array(sums[used, k]) for k in range(DIMENSIONS)})

    parts = map_blocks(pick(docs, text=text_col), run, schema)
    return parts.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIMENSIONS)))


def word_table(sums: DataFrame) -> np.ndarray:
    """Context vectors of length one beside index vectors: one row per slot (a table of fixed size).

    It comes as Arrow columns: as rows it would be a million Python numbers, whose room the driver keeps.
    """
    rows = sums.toArrow()
    context = np.zeros((WORDS, DIMENSIONS), np.float32)
    vectors = np.empty((rows.num_rows, DIMENSIONS))
    for k in range(DIMENSIONS):
        vectors[:, k] = rows[f"d{k}"].to_numpy()
    context[rows["slot"].to_numpy()] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return np.hstack([context, index_vectors()[:WORDS].astype(np.float32) / np.sqrt(NONZERO)])


def pooled(texts: list[bytes | None], table: np.ndarray) -> np.ndarray:
    """One row per text: mean vector of its words, the lengths of its two halves, and the log of the number of words."""
    out = np.zeros((len(texts), table.shape[1] + 3), np.float32)
    half = table.shape[1] // 2
    for row, text in enumerate(texts):
        ids = slots(text)
        if not len(ids):
            continue
        total = np.zeros(table.shape[1], np.float32)
        for start in range(0, len(ids), PIECE):
            total += table[ids[start:start + PIECE]].sum(axis=0)
        mean = total / len(ids)
        out[row, :-3] = mean
        out[row, -3:] = np.linalg.norm(mean[:half]), np.linalg.norm(mean[half:]), np.log1p(len(ids))
    return out


class Network:
    """Two layers: rectified hidden units, one logistic output; inputs standardised; output divided by a temperature."""

    def __init__(self, prior: float):
        self.prior, self.weights = prior, None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 2e-3, seed: int = 11) -> Network:
        random = np.random.default_rng(seed)
        aside = np.arange(len(x)) % 5 == 0  # rows come in random order
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        weights = [random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                   random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(0.0)]
        weights = [w.astype(np.float32) for w in weights]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        rows, step = np.flatnonzero(~aside), 0
        for _ in range(epochs):
            random.shuffle(rows)
            for at in range(0, len(rows), batch):
                part = rows[at:at + batch]
                hidden = np.maximum(x[part] @ weights[0] + weights[1], 0)
                error = (_logistic(hidden @ weights[2] + weights[3]) - y[part]) / len(part)
                back = np.outer(error, weights[2]) * (hidden > 0)
                slopes = [x[part].T @ back + 2e-3 * weights[0], back.sum(axis=0), hidden.T @ error + 2e-3 * weights[2], error.sum()]
                step += 1
                for k, slope in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope * slope
                    weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = weights, 1.0
        raw, truth = self._raw(x[aside]), y[aside]
        losses = {t: -np.mean(np.log(np.where(truth > 0, _logistic(raw / t), 1 - _logistic(raw / t)) + 1e-9)) for t in np.geomspace(0.25, 8, 61)}
        self.temperature = min(losses, key=losses.get)
        return self

    def _raw(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return _logistic(self._raw((x - self.mean) / self.scale) / self.temperature).astype(np.float64)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(labels: DataFrame, label: str, learn: Column, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids in a random but repeatable order; an id labelled twice counts with its larger label."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("float").alias("label"))
    return known.orderBy(F.xxhash64("id"), "id").limit(rows)


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Word vectors from all of ``docs``, a network from its labelled rows. ``learn``: condition on ``labels`` for the rows to learn from."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(word_table(context_sums(docs, text_col)))
    sample = session.materialize(labelled_sample(labels, label, learn, id_col, sample_rows), "quality-sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 0):
            x = pooled(as_bytes(block.column(0)), table.value)
            yield pa.record_batch({"x": pa.array([r.tobytes() for r in x], pa.binary()), "label": block.column(1), "id": block.column(2)})

    rows = pick(docs, id=id_col, text=text_col)
    chosen = rows.join(F.broadcast(sample), "id").select("text", "label", F.xxhash64("id", "text").alias("id"))
    learned = map_blocks(chosen, features, "x binary, label float, id long").orderBy("id", "x").limit(sample_rows).toArrow()
    y = learned["label"].to_numpy()
    net = Network(float(y.mean()) if len(y) else 0.5)
    if 0 < y.sum() < len(y):
        net.fit(np.frombuffer(b"".join(learned["x"].to_pylist()), np.float32).reshape(len(y), -1), y)
    return Model(table, spark.sparkContext.broadcast(net.__dict__))


class Model:
    """A trained classifier: broadcast word vectors and network, both of fixed size."""

    def __init__(self, table, net):
        self.table, self.net = table, net

    def score(self, docs: DataFrame, doc: Column, text_col: str = "text") -> DataFrame:
        """``doc`` (any column of ``docs``) and ``score`` for every row."""
        table, fitted = self.table, self.net

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = Network(0.5)
            net.__dict__.update(fitted.value)
            for block in blocks(batches, 1):
                scores = net.score(pooled(as_bytes(block.column(1)), table.value))
                yield pa.record_batch({"doc": block.column(0), "score": pa.array(scores, pa.float64())})

        rows = docs.select(doc.alias("doc"), docs[text_col].alias("text"))
        return map_blocks(rows, judge, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``threshold``."""
    scored = model.score(docs, F.struct(*(docs[c] for c in docs.columns)), text_col)
    return scored.where(F.col("score") >= threshold).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
