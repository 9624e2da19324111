"""Word vectors and forward pass of the quality classifier against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality

TEXTS = ["good clean prose, with words", "bad bad bad!!", None, "", "one", "über straße — naïve", "words with prose " * 40, "!!! ???", "bad words"]


def plain_context(texts):
    """Per slot its occurrences and the sum of the index vectors up to REACH words to either side in the same text."""
    index, n, sums = quality.index_vectors().astype(np.int64), {}, {}
    for text in texts:
        words = [int(s) for s in quality.slots(text.encode() if text else None)]
        for at, slot in enumerate(words):
            n[slot] = n.get(slot, 0) + 1
            near = words[max(0, at - quality.REACH):at] + words[at + 1:at + 1 + quality.REACH]
            total = sums.setdefault(slot, np.zeros(quality.DIMENSIONS, np.int64))
            for other in near:
                total += index[other]
    return {slot: (n[slot], *sums[slot].tolist()) for slot in n}


def plain_score(text, table, net):
    words = quality.slots(text.encode() if text else None)
    half = table.shape[1] // 2
    x = [0.0] * (table.shape[1] + 3)
    if len(words):
        mean = [sum(float(table[s, k]) for s in words) / len(words) for k in range(table.shape[1])]
        lengths = [math.sqrt(sum(v * v for v in part)) for part in (mean[:half], mean[half:])]
        x = mean + lengths + [math.log(1 + len(words))]
    x = [(v - float(m)) / float(s) for v, m, s in zip(x, net["mean"], net["scale"])]
    first, bias, second, last = net["weights"]
    hidden = [max(0.0, sum(v * float(first[i, j]) for i, v in enumerate(x)) + float(bias[j])) for j in range(quality.HIDDEN)]
    raw = sum(h * float(w) for h, w in zip(hidden, second)) + float(last)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw / net["temperature"]))))


def test_context_sums_equal_a_plain_loop(spark):
    """With a text that is worked on in two pieces."""
    texts = [*TEXTS, " ".join(f"w{i * i % 97}" for i in range(quality.PIECE + 5)), "after it"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r["slot"]: tuple(r)[1:] for r in quality.context_sums(docs, "text").collect()}
    assert got == plain_context(texts)


def test_scores_equal_a_plain_loop(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i < 9 else f"{'good clean' if i % 2 else 'bad !!'} number{i % 7} words {'x ' * (i % 5)}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # a third of the labels is turned round, so that scores are not all 0 or 1
    labels = docs.select("doc_id", ((F.col("doc_id") + (F.col("doc_id") % 3 == 0).cast("int")) % 2).cast("int").alias("quality"))
    model = quality.train(docs, labels, F.col("doc_id") >= 9)
    got = {r["doc"]: r["score"] for r in model.score(docs, docs["doc_id"]).collect()}
    net, table = model.net.value, model.table.value
    assert net["weights"] is not None and len({round(s, 6) for s in got.values()}) > 10
    assert all(got[i] == pytest.approx(plain_score(t, table, net), abs=1e-4) for i, t in rows)


def test_training_collects_no_rows(spark, monkeypatch):
    """Word vectors and learning rows reach the driver as Arrow columns, not as a Python object for each number."""
    docs = spark.createDataFrame([(k, "good words only " * (1 + k % 5) if k % 2 else "$$ bad ## words $$ " * (1 + k % 3)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    sums = quality.context_sums(docs, "text")
    rows = np.array([tuple(r) for r in sums.collect()], np.float64)
    monkeypatch.setattr(type(docs), "collect", lambda self: pytest.fail("collected as rows"))
    table = quality.word_table(sums)
    lengths = np.linalg.norm(rows[:, 2:], axis=1, keepdims=True)
    assert np.allclose(table[rows[:, 0].astype(int), :quality.DIMENSIONS], rows[:, 2:] / np.maximum(lengths, 1e-9), atol=1e-6)
    model = quality.train(docs, labels, F.lit(True))
    assert model.net.value["weights"] is not None
    monkeypatch.undo()
    scores = {r["doc"]: r["score"] for r in model.score(docs, docs["doc_id"]).collect()}
    assert min(v for k, v in scores.items() if k % 2) > max(v for k, v in scores.items() if not k % 2)
    assert not quality.word_table(sums.limit(0))[:, :quality.DIMENSIONS].any()
