"""Toxicity: a convolutional text classifier trained with numpy on all labelled documents.

A word's embedding is the sum of the embeddings of its hashed features: the word and its first 5, 6 and 7 bytes. Features that
occur in at least ``LEAST_DOCS`` training documents have a row, found by a hash of ``FEATURE_BITS`` bits (so the model never
outgrows that); all others count nothing. Filters of width 1, 2 and 3 slide over the whole text, the maximum of each over all
positions goes into a logistic output. One dimension of the embeddings starts from the feature's shrunken log-odds in the
training documents; everything is then trained together. A part of the labelled documents is kept aside to calibrate the scores
(0.7 is the best cut) and one threshold per language.

Feature counts are aggregations over all training documents. These are dealt by hash into as many groups of about ``SAMPLE_ROWS``
documents or ``SAMPLE_BYTES`` as there are; every group trains the common network in a task of its own, and the result is the
mean of theirs (for a feature, of the groups that hold it). Means are taken of whole numbers, so that they do not depend on the
order of tasks. A single group goes through its documents ``EPOCHS`` times, many groups ``LEAST_EPOCHS`` times each. Scores of the documents kept aside are counted by value
(``STEPS`` to a unit), kind and language.

Defined results: null and empty texts get the score of a text without known words; without labels of both kinds every score is
the share of label 1 (0.5 without labels); repeated rows get equal results; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.llm.common import as_bytes, blocks, map_blocks, pick
from plumbline.llm.decontaminate import NORMAL

#: What one group holds, about; there are as many groups as all labelled documents need.
SAMPLE_ROWS = 10_000
SAMPLE_BYTES = 40 << 20
#: How often a group goes through its documents: alone, and at least.
EPOCHS, LEAST_EPOCHS = 6, 2
#: Bits of a feature's hash.
FEATURE_BITS = 18
#: Whole numbers to a unit in means of weights, and in counts of raw scores.
FINE, STEPS = 1 << 20, 1 << 10
#: Every so-manieth labelled document is kept aside.
ASIDE = 5
LEAST_DOCS = 3
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (5, 6, 7)
PAD = max(WIDTHS) - 1
GROUP = 200_000
#: Score from which a document counts as toxic, unless its language has a threshold of its own.
CUT = 0.7


def features(word: bytes) -> tuple[int, ...]:
    """Hashes of the word itself and of its beginnings (short words are padded)."""
    named = (word, *(b"%d" % k + word[:k].ljust(k, b"\0") for k in PREFIXES))
    return tuple(xxhash.xxh3_64_intdigest(x) >> (64 - FEATURE_BITS) for x in named)


def numbered(texts: list[bytes | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text as numbers of its words (from 1), and the words."""
    words: dict[bytes, int] = {}
    ids = [np.array([words.setdefault(w, len(words) + 1) for w in (t or b"").translate(NORMAL).split()], np.int32) for t in texts]
    return ids, list(words)


def count_features(texts: list[bytes | None], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, the number of texts each occurs in, and how many of these are of label 1."""
    ids, words = numbered(texts)
    hashes = np.array([features(w) for w in words], np.uint64).reshape(-1, 1 + len(PREFIXES))
    keys, which = np.unique(hashes, return_inverse=True)
    which = which.reshape(hashes.shape)
    total, positive = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for some, label in zip(ids, y):
        own = np.unique(which[np.unique(some) - 1]) if len(some) else []
        total[own] += 1
        positive[own] += int(label > 0)
    return keys, total, positive


class Convolution:
    """Embeddings, filters and output weights; plain arrays, so that it can be broadcast."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.out, self.scale, self.shift = prior, None, 1.0, 0.0

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row of each feature of each word; row 0 is the unknown one. The first line stands for the gap between texts."""
        found = np.zeros((len(words) + 1, 1 + len(PREFIXES)), np.int64)
        if words and len(self.keys):
            hashes = np.array([features(w) for w in words], np.uint64)
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            found[1:] = np.where(self.keys[at] == hashes, at + 1, 0)
        return found

    def pooled(self, ids: list[np.ndarray], vectors: np.ndarray, places: bool = False):
        """Largest value of each filter in each text (and where)."""
        gap = np.zeros(PAD, np.int32)
        line = np.concatenate([part for some in ids for part in (some, gap)] + [gap])
        starts = np.cumsum([0] + [len(some) + PAD for some in ids])
        size = int(starts[-1])
        values, at = [], []
        for filters, bias in zip(self.filters, self.biases):
            moved = bias + sum((vectors @ filters[j])[line[j:size + j]] for j in range(len(filters)))
            moved[line[:size] == 0] = 0  # what starts in a gap may reach into the next text
            values.append(np.maximum(np.maximum.reduceat(moved, starts[:-1], axis=0), 0))
            if places:
                at.append(np.array([moved[s:e].argmax(axis=0) + s for s, e in zip(starts[:-1], starts[1:])]))
        return np.hstack(values), (np.hstack(at) if places else None), line

    def raw(self, texts: list[bytes | None]) -> np.ndarray:
        ids, words = numbered(texts)
        vectors = self.embeddings[self.rows(words)].sum(axis=1)
        out, group, held = [], [], 0
        for some in [*ids, None]:
            if group and (some is None or held + len(some) > GROUP):
                out.append(self.pooled(group, vectors)[0] @ self.out + self.bias)
                group, held = [], 0
            if some is not None:
                group.append(some)
                held += len(some)
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.out is None:
            return np.full(len(texts), self.prior)
        return self.rated(self.raw(texts).astype(np.float64))

    def rated(self, raw: np.ndarray) -> np.ndarray:
        return _logistic(raw * self.scale + self.shift)

    def begin(self, keys: np.ndarray, total: np.ndarray, positive: np.ndarray, prior: float, seed: int = 5) -> None:
        """The network before training, from the counts of features (ascending) and the share of label 1."""
        random = np.random.default_rng(seed)
        kept = np.flatnonzero(total >= LEAST_DOCS)
        self.keys = keys[kept]
        share = (positive[kept] + 8 * prior) / (total[kept] + 8)
        odds = np.log(share / (1 - share)) - np.log(prior / (1 - prior))
        self.embeddings = random.normal(0, 0.05, (len(kept) + 1, DIMENSIONS)).astype(np.float32)
        self.embeddings[0] = 0
        self.embeddings[1:, 0] = odds / 4
        self.filters = [random.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for filters in self.filters:
            filters[0, 0, : FILTERS // 2] = 1.0
        self.biases = [np.linspace(-1, 0, FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.bias = np.float32(np.log(prior / (1 - prior)))

    def fit(self, texts: list[bytes], y: np.ndarray) -> Convolution:
        """Training on a single group."""
        aside = np.arange(len(texts)) % ASIDE == 0
        train = [texts[k] for k in np.flatnonzero(~aside)]
        self.begin(*count_features(train, y[~aside]), y[~aside].mean())
        self.learn(train, y[~aside])
        self._calibrate(self.raw([texts[k] for k in np.flatnonzero(aside)]).astype(np.float64), y[aside])
        return self

    def plain_weights(self) -> np.ndarray:
        """All weights but embeddings, in lines as wide as an embedding."""
        flat = np.concatenate([np.ravel(x) for x in (*self.filters, *self.biases, self.out, self.bias)])
        return np.pad(flat, (0, -len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)

    def set_plain_weights(self, lines: np.ndarray) -> None:
        shapes = [np.shape(x) for x in (*self.filters, *self.biases, self.out, self.bias)]
        ends = np.cumsum([0] + [int(np.prod(shape)) for shape in shapes])
        parts = [lines.ravel()[s:e].reshape(shape).astype(np.float32) for s, e, shape in zip(ends[:-1], ends[1:], shapes)]
        n = len(WIDTHS)
        self.filters, self.biases, self.out, self.bias = parts[:n], parts[n:2 * n], parts[-2], np.float32(parts[-1])

    def learn(self, texts: list[bytes | None], truth: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.02, seed: int = 5) -> np.ndarray:
        """Train with these texts; returns the rows of the features they hold."""
        random = np.random.default_rng(seed)
        ids, words = numbered(texts)
        rows = self.rows(words)
        seen = [np.full_like(x, 1e-3) for x in (self.embeddings, *self.filters, *self.biases, self.out)] + [1e-3]

        def step(value, slope, k):
            seen[k] = seen[k] + slope * slope
            return value - rate * slope / np.sqrt(seen[k])

        order = np.arange(len(texts))
        for _ in range(epochs):
            random.shuffle(order)
            for start in range(0, len(order), batch):
                part = order[start:start + batch]
                own, local = np.unique(np.concatenate([np.zeros(1, np.int32), *(ids[k] for k in part)]), return_inverse=True)
                cuts = np.cumsum([1] + [len(ids[k]) for k in part])
                texts_ = [local[s:e].astype(np.int32) for s, e in zip(cuts[:-1], cuts[1:])]
                vectors = self.embeddings[rows[own]].sum(axis=1)
                values, at, line = self.pooled(texts_, vectors, places=True)
                error = (_logistic(values @ self.out + self.bias) - truth[part]) / len(part)
                back = error[:, None] * self.out * (values > 0)
                slope_vectors = np.zeros_like(vectors)
                slopes = []
                for n, filters in enumerate(self.filters):
                    span = slice(n * FILTERS, (n + 1) * FILTERS)
                    slope = np.zeros_like(filters)
                    for j in range(len(filters)):
                        word = line[at[:, span] + j]
                        slope[j] = np.einsum("bfd,bf->df", vectors[word], back[:, span])
                        np.add.at(slope_vectors, word.ravel(), (back[:, span, None] * filters[j].T[None]).reshape(-1, DIMENSIONS))
                    slopes.append((slope + 1e-4 * filters, back[:, span].sum(axis=0)))
                slope_out = values.T @ error + 1e-4 * self.out
                for n, (slope, slope_bias) in enumerate(slopes):
                    self.filters[n] = step(self.filters[n], slope, 1 + n).astype(np.float32)
                    self.biases[n] = step(self.biases[n], slope_bias, 1 + len(WIDTHS) + n).astype(np.float32)
                self.out = step(self.out, slope_out, 1 + 2 * len(WIDTHS)).astype(np.float32)
                self.bias = np.float32(step(self.bias, error.sum(), 2 + 2 * len(WIDTHS)))
                touched = rows[own].ravel()
                changed, inverse = np.unique(touched, return_inverse=True)
                slope = np.zeros((len(changed), DIMENSIONS), np.float32)
                np.add.at(slope, inverse, np.repeat(slope_vectors, rows.shape[1], axis=0))
                seen[0][changed] += slope * slope
                self.embeddings[changed] -= rate * slope / np.sqrt(seen[0][changed])
                self.embeddings[0] = 0
        return np.unique(rows)

    def _calibrate(self, raw: np.ndarray, truth: np.ndarray, n: np.ndarray | float = 1.0) -> None:
        """Scale of the output that fits the labels kept aside; the shift puts their best cut (by F1) at ``CUT``."""
        scale, shift, n = 1.0, 0.0, np.broadcast_to(n, raw.shape)
        for _ in range(200):
            p = _logistic(raw * scale + shift)
            weight, off = n * (p * (1 - p) + 1e-6), n * (p - truth)
            slope = np.array([(off * raw).sum() + 0.1 * (scale - 1), off.sum() + 0.1 * shift])
            curve = np.array([[(weight * raw * raw).sum() + 0.1, (weight * raw).sum()], [(weight * raw).sum(), weight.sum() + 0.1]])
            move = np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
            scale, shift = max(0.05, scale - move[0]), shift - move[1]
        self.scale, self.shift = float(scale), float(shift)
        if 0 < truth.sum() < len(truth):
            order = np.argsort(-raw)
            hits = np.cumsum((n * truth)[order])
            f1 = 2 * hits / (np.cumsum(n[order]) + (n * truth).sum())
            f1[:-1][np.diff(raw[order]) == 0] = 0  # no cut between equal scores
            best = int(f1.argmax())
            low = raw[order][min(best + 1, len(raw) - 1)]
            self.shift = float(np.log(CUT / (1 - CUT)) - (raw[order][best] + low) / 2 * self.scale)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _threshold(scores: np.ndarray, truth: np.ndarray, n: np.ndarray, fallback: float = CUT) -> float:
    """Cut with the best F1; the fallback where there is nothing to choose from."""
    if not truth.any() or truth.all():
        return fallback
    cuts = np.linspace(0.05, 0.95, 19)
    f1 = [2 * n[(scores >= c) & (truth > 0)].sum() / max(1, n[scores >= c].sum() + n[truth > 0].sum()) for c in cuts]
    best = np.flatnonzero(np.isclose(f1, max(f1)))
    return float(cuts[best[len(best) // 2]])


class Model:
    def __init__(self, network: Convolution, thresholds: dict[str | None, float]):
        self.network, self.thresholds = network, thresholds

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
        """``doc`` and ``score`` for every row; with ``lang_col`` also ``flagged``, by the threshold of its language. The score knows no language."""
        shared = docs.sparkSession.sparkContext.broadcast(self.network.__dict__)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            network = Convolution()
            network.__dict__.update(shared.value)
            for block in blocks(batches, 1):
                scores = pa.array(network.score(as_bytes(block.column(1))), pa.float64())
                yield pa.record_batch({"doc": block.column(0), "score": scores, "lang": block.column(2)})

        lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
        rows = pick(docs, doc=id_col, text=text_col, lang=lang)
        schema = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType()), T.StructField("lang", T.StringType())])
        found = map_blocks(rows, judge, schema)
        flagged = [self.flag(F.col("score"), F.col("lang")).alias("flagged")] if lang_col else []
        return found.select("doc", "score", *flagged)

    def flag(self, score: Column, lang: Column) -> Column:
        """Whether a score reaches the threshold of its language (the common one for languages not met in training)."""
        known = {k: v for k, v in self.thresholds.items() if k is not None}
        cut = F.lit(self.thresholds[None])
        if known:
            cut = F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[lang], cut)
        return score >= cut


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    lang_col: str | None = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Learn from all labelled rows that meet ``learn`` (a condition on ``labels``); an id labelled twice counts with its larger
    label. Languages only set thresholds. ``sample_rows`` and ``sample_bytes`` tell how large a group is, about.
    """
    known = labels.where(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = session.materialize(known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("float").alias("label")), "toxicity-labels")
    few = session.bounded(known, known.count(), session.NARROW_BROADCAST_ROWS)
    lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    rows = pick(docs, id=id_col, text=text_col, lang=lang).join(few, "id")
    rows = rows.select("text", "label", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("id", "text").alias("ticket"))
    rows = session.materialize(rows.withColumn("aside", F.pmod("ticket", F.lit(ASIDE)) == 0), "toxicity-learned")
    kinds = {r["aside"]: r for r in rows.groupBy("aside").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("positive"), F.sum("label").alias("sum"), F.sum("size").alias("size")).collect()}
    n, positive = sum(r["n"] for r in kinds.values()), sum(r["positive"] for r in kinds.values())
    network = Convolution(sum(r["sum"] for r in kinds.values()) / n if n else 0.5)
    if not 0 < positive < n:
        return Model(network, {None: CUT})
    train_rows, aside_rows = rows.where("not aside"), rows.where("aside")
    part = [kinds[False]] if False in kinds and 0 < kinds[False]["positive"] < kinds[False]["n"] else list(kinds.values())
    if len(part) > 1 or False not in kinds:  # too few to keep any aside
        train_rows = aside_rows = rows
    n, positive, size = (sum(r[c] for r in part) for c in ("n", "positive", "size"))
    network.begin(*_counted(train_rows), positive / n)
    groups = max(1, -(-n // sample_rows), -(-size // sample_bytes))
    dealt = train_rows.select("text", "label", "ticket", F.pmod(F.xxhash64("ticket"), F.lit(groups)).alias("group"))
    _learn(network, dealt, max(LEAST_EPOCHS, EPOCHS // groups))
    raw, truth, held, langs = _scored(network, aside_rows)
    network._calibrate(raw, truth, held)
    scores = network.rated(raw)
    thresholds: dict[str | None, float] = {None: _threshold(scores, truth, held)}
    thresholds |= {k: _threshold(scores[langs == k], truth[langs == k], held[langs == k]) for k in set(langs) - {None}}
    return Model(network, thresholds)


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of enough texts (ascending), with the number of texts they occur in and how many of these are of label 1."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 0):
            keys, total, positive = count_features(as_bytes(block.column(0)), block.column(1).to_numpy(zero_copy_only=False))
            yield pa.record_batch({"key": pa.array(keys.astype(np.int64)), "total": pa.array(total), "positive": pa.array(positive)})

    counted = map_blocks(rows.select("text", "label"), count, "key long, total long, positive long")
    counted = counted.groupBy("key").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    found = counted.where(F.col("total") >= LEAST_DOCS).toArrow()
    order = np.argsort(found.column("key").to_numpy())
    keys, total, positive = (found.column(c).to_numpy()[order] for c in ("key", "total", "positive"))
    return keys.astype(np.uint64), total, positive


def _learn(network: Convolution, dealt: DataFrame, epochs: int) -> None:
    """Every group trains the network on its own; it becomes the mean of what they make of it."""
    shared = dealt.sparkSession.sparkContext.broadcast(network.__dict__)
    names = [f"w{k}" for k in range(DIMENSIONS)]

    def learn(group: pa.Table) -> pa.Table:
        own = Convolution()
        own.__dict__.update(copy.deepcopy(shared.value))
        texts = [t or b"" for t in as_bytes(group.column("text").combine_chunks())]
        tickets, y = group.column("ticket").to_numpy(), group.column("label").to_numpy()
        order = sorted(range(len(texts)), key=lambda k: (tickets[k], texts[k]))
        rows = own.learn([texts[k] for k in order], y[order], epochs)
        lines = own.plain_weights()
        values = np.vstack([own.embeddings[rows], lines])
        at = np.concatenate([rows, -1 - np.arange(len(lines))])
        whole = np.rint(values.astype(np.float64) * FINE).astype(np.int64)
        return pa.table({"row": pa.array(at.astype(np.int64)), **{name: pa.array(whole[:, k]) for k, name in enumerate(names)}})

    made = dealt.groupBy("group").applyInArrow(learn, ", ".join(["row long", *(f"{name} long" for name in names)]))
    means = made.groupBy("row").agg(*[(F.sum(name) / F.count(F.lit(1)) / FINE).alias(name) for name in names]).toArrow()
    at = means.column("row").to_numpy()
    values = np.column_stack([means.column(name).to_numpy() for name in names])
    rows = at >= 0
    network.embeddings[at[rows]] = values[rows]
    network.set_plain_weights(values[~rows][np.argsort(-at[~rows])])
    shared.unpersist()


def _scored(network: Convolution, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Raw scores of the rows to a step, labels, how many rows have both, and their language."""
    shared = rows.sparkSession.sparkContext.broadcast(network.__dict__)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Convolution()
        own.__dict__.update(shared.value)
        for block in blocks(batches, 0):
            steps = np.rint(np.clip(own.raw(as_bytes(block.column(0))), -30, 30) * STEPS).astype(np.int64)
            yield pa.record_batch({"step": pa.array(steps), "label": block.column(1), "lang": block.column(2)})

    found = map_blocks(rows.select("text", "label", "lang"), judge, "step long, label float, lang string")
    found = found.groupBy("step", "label", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy("step", "label", "lang").toArrow()
    shared.unpersist()
    langs = np.array(found.column("lang").to_pylist(), object)
    return (found.column("step").to_numpy() / STEPS, found.column("label").to_numpy().astype(np.float64), found.column("n").to_numpy().astype(np.float64), langs)
