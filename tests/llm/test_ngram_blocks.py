"""Shingles of whole blocks of texts against a plain loop; components that are found write no further tables."""

import types

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from plumbline import session
from plumbline.llm import ngram_join

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TEXTS = [
    None, "", " ", "\n\t", "a", "A  b", "a b c d e", " x y  z\tq\nw \x0b\x0c t ", "É é\x1c e\x85 \x00 Straße", "to be or not to be " * 9,
    "".join(chr(c) + "x" for c in range(1, 400)), "one two three four five six", "one two three four five six seven",
]


def plain(text, n):
    words = (text or "").encode().translate(LOWER).split()
    found, width = set(), min(n, len(words))
    for at in range(len(words) - width + 1 if words else 0):
        mixed = width
        for word in words[at:at + width]:
            mixed = (mixed ^ xxhash.xxh3_64_intdigest(word)) * 0x9E3779B97F4A7C15 % 2**64
            mixed ^= mixed >> 29
        mixed = mixed * 0xBF58476D1CE4E5B9 % 2**64
        found.add(mixed ^ mixed >> 32)
    return sorted(found)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_shingles_of_a_block(n):
    whole = pa.array(TEXTS, pa.string())
    for block in (whole, whole.slice(3, 6), whole.slice(0, 1), whole.slice(0, 0), whole.cast(pa.large_string())):
        sets = ngram_join.shingles(block, n)
        assert [s.tolist() for s in sets] == [plain(t, n) for t in block.to_pylist()]
        assert ngram_join._bins(sets).tolist() == [np.bincount(s >> np.uint64(57), minlength=128).tolist() for s in map(lambda s: s.astype(np.uint64), sets)]


def test_a_word_is_hashed_once_a_block(monkeypatch):
    asked = []
    monkeypatch.setattr(ngram_join, "xxhash", types.SimpleNamespace(xxh3_64_intdigest=lambda w: asked.append(w) or xxhash.xxh3_64_intdigest(w)))
    ngram_join.shingles(pa.array(["to be or not to be", "Be or be not", "to be"] * 50), 2)
    assert sorted(asked) == [b"be", b"not", b"or", b"to"]


@pytest.mark.parametrize("crowded", [1, 2, 3, 99])
def test_crowded_grams_of_a_block(monkeypatch, crowded):
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    sets = ngram_join.shingles(pa.array(["a b c d", "a b c d e", "a b x y", "q", None, "a b c d"]), 1)
    grams, nodes, places, many, told = ngram_join._block_entries(sets, ngram_join._nodes(sets), 80)
    counts = {g: int((grams == g).sum()) for g in grams.tolist()}
    assert told.tolist() == sorted(g for g, c in counts.items() if c >= crowded)
    assert many.tolist() == [counts[g] >= crowded for g in grams.tolist()]
    assert len(set(nodes.tolist())) == 4 and len(places) == len(grams)


def test_finished_components_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(session, "materialize", lambda df, label, write=session.materialize: written.append(label) or write(df, label))
    stars = [(k, 0) for k in range(1, 30)] + [(50, 40), (40, 51), (60, 60)]
    assert dict(ngram_join.components(spark.createDataFrame(stars, "a long, b long")).collect()) == {**{k: 0 for k in range(30)}, 40: 40, 50: 40, 51: 40}
    assert written == ["stars"]
    written.clear()
    assert dict(ngram_join.components(spark.createDataFrame([(1, 3), (2, 3)], "a long, b long")).collect()) == {1: 1, 2: 1, 3: 1}
    assert written == ["stars"] * 3  # one round; a second one only told before that nothing was left
