"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one suffix automaton. Every document streams through it
word by word; the state and the length of the longest match say, at each word, whether a window
of ``min_words`` item words ends there (shorter items count as a whole).

The automaton is built from shards of at most about ``SHARD_CHARS`` characters of items, so its size is
bounded whatever the size of the benchmark. Up to ``SHARDS_PER_PASS`` shards are broadcast at a time;
a larger benchmark takes several passes, each written to the shared folder.

Defined results: a null or empty text has no words and no hit; repeated documents are judged each for
itself; repeated or empty items are allowed, an item with a null id hits but is not listed; with no items
nothing is hit; further columns of either table are ignored (find_matches) or kept (decontaminate).
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.common import as_bytes, blocks, map_blocks, pick

SHARD_CHARS = 600_000
SHARDS_PER_PASS = 4
#: A-Z become a-z; digits, letters and everything beyond ASCII stay; all else separates words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def build_automaton(items: list[tuple[str | None, bytes | None]], min_words: int) -> dict:
    """Suffix automaton over the words of all items, with the items that own each window."""
    vocabulary: dict[bytes, int] = {}
    sequences = []
    for item_id, text in items:
        words = (text or b"").translate(NORMAL).split()
        if words:
            sequences.append((item_id, [vocabulary.setdefault(w, len(vocabulary)) for w in words]))

    edges: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]

    def split(source: int, word: int, target: int) -> int:
        copy = len(edges)
        edges.append(dict(edges[target]))
        link.append(link[target])
        longest.append(longest[source] + 1)
        link[target] = copy
        while source >= 0 and edges[source].get(word) == target:
            edges[source][word] = copy
            source = link[source]
        return copy

    def extend(last: int, word: int) -> int:
        there = edges[last].get(word)
        if there is not None:
            return there if longest[there] == longest[last] + 1 else split(last, word, there)
        new = len(edges)
        edges.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at >= 0 and word not in edges[at]:
            edges[at][word] = new
            at = link[at]
        if at >= 0:
            target = edges[at][word]
            link[new] = target if longest[target] == longest[at] + 1 else split(at, word, target)
        return new

    for _, sequence in sequences:
        state = 0
        for word in sequence:
            state = extend(state, word)

    def holder(state: int, length: int) -> int:
        """The state on the suffix path that stands for the last ``length`` words."""
        while longest[link[state]] >= length:
            state = link[state]
        return state

    owners: dict[int, set[int]] = {}
    short: dict[int, list[tuple[int, int]]] = {}
    for number, (_, sequence) in enumerate(sequences):
        state = 0
        for at, word in enumerate(sequence, 1):
            state = edges[state][word]
            if at >= min_words:
                owners.setdefault(holder(state, min_words), set()).add(number)
        if len(sequence) < min_words:
            short.setdefault(holder(state, len(sequence)), []).append((len(sequence), number))

    order = sorted(range(len(edges)), key=longest.__getitem__)
    anchor, near = [0] * len(edges), [0] * len(edges)
    for state in order[1:]:
        up = link[state]
        if longest[state] >= min_words:
            anchor[state] = state if longest[up] < min_words else anchor[up]
        near[state] = state if state in short else near[up]
    base = len(vocabulary) + 1
    return {
        "vocabulary": vocabulary, "base": base, "link": link, "longest": longest, "anchor": anchor, "near": near,
        "next": {state * base + word: target for state, out in enumerate(edges) for word, target in out.items()},
        "owners": {state: tuple(own) for state, own in owners.items()}, "short": short,
        "ids": [item_id for item_id, _ in sequences], "window": min_words,
        "shortest": min((min(len(s), min_words) for _, s in sequences), default=0),
    }


def match_words(words: list[bytes], a: dict) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word spans that are hit, and the numbers of the items whose windows occur."""
    if not a["shortest"] or len(words) < a["shortest"]:
        return [], set()
    get = a["vocabulary"].get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
    starts, ends = known[::2], known[1::2]
    long_enough = ends - starts >= a["shortest"]
    step, link, longest, anchor, near = a["next"].get, a["link"], a["longest"], a["anchor"], a["near"]
    base, window, owners, short = a["base"], a["window"], a["owners"], a["short"]
    spans: list[tuple[int, int]] = []
    found: set[int] = set()

    def hit(start: int, end: int) -> None:
        while spans and start <= spans[-1][1]:
            before = spans.pop()
            start, end = min(start, before[0]), max(end, before[1])
        spans.append((start, end))

    for start, end in zip(starts[long_enough].tolist(), ends[long_enough].tolist()):
        state = length = 0
        for at, word in enumerate(ids[start:end].tolist(), start + 1):
            target = step(state * base + word)
            while target is None and state:
                state = link[state]
                length = longest[state]
                target = step(state * base + word)
            if target is None:
                state = length = 0
                continue
            state, length = target, length + 1
            if length >= window:
                hit(at - window, at)
                found.update(owners[anchor[state]])
            ending = near[state]
            while ending:
                for size, number in short[ending]:
                    if size <= length:
                        hit(at - size, at)
                        found.add(number)
                ending = near[link[ending]]
    return spans, found


def _automata(items: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    rows = pick(items, item=items[id_col].cast("string"), text=text_col)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-total // SHARD_CHARS) or 1

    def build(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("item").to_pylist(), as_bytes(table.column("text").combine_chunks())))
        return pa.table({"shard": table.column("shard").slice(0, 1).cast(pa.int64()), "automaton": [pickle.dumps(build_automaton(rows, min_words))]})

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    return session.materialize(sharded.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata")


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the merged spans."""
    places = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last:places[start][0]])
        last = places[end - 1][1]
    return b"".join([*kept, text[last:]])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _passes(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, min_words: int, scan) -> DataFrame:
    """Run ``scan(block, automata, last)`` with a few shards at a time; each pass adds to the spans of the one before."""
    automata = _automata(items, item_id, item_text, min_words)
    shards = sorted(r[0] for r in automata.select("shard").collect())
    rounds = [shards[i:i + SHARDS_PER_PASS] for i in range(0, len(shards), SHARDS_PER_PASS)] or [[]]
    for number, some in enumerate(rounds):
        blobs = [r[0] for r in automata.where(F.col("shard").isin(some)).select("automaton").collect()] if some else []
        shared = docs.sparkSession.sparkContext.broadcast([bytes(b) for b in blobs])

        def run(batches, shared=shared, last=number + 1 == len(rounds)):
            loaded = [pickle.loads(b) for b in shared.value] if len(shared.value) == 1 else None
            for block in blocks(batches, 1):
                yield from scan(block, loaded or (pickle.loads(b) for b in shared.value), last)

        docs = map_blocks(docs, run, docs.schema)
        if number + 1 < len(rounds):
            docs = session.materialize(docs, "matched")
    return docs


def find_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", min_words: int = 10,
) -> DataFrame:
    """Per document: ``doc``, ``n_words``, the hit word ``spans`` (start, end) and the ``items`` found in it."""

    def scan(block: pa.RecordBatch, automata, last: bool) -> Iterator[pa.RecordBatch]:
        words = [(t or b"").translate(NORMAL).split() for t in as_bytes(block.column(1))]
        spans = [[(s["start"], s["end"]) for s in old] for old in block.column(2).to_pylist()]
        items = [set(old) for old in block.column(3).to_pylist()]
        for a in automata:
            for at, some in enumerate(words):
                more, found = match_words(some, a)
                if more:
                    spans[at] = _merge(spans[at] + more)
                    items[at].update(a["ids"][n] for n in found if a["ids"][n] is not None)
        yield pa.record_batch({
            "doc": block.column(0), "text": block.column(1),
            "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
            "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            "n_words": pa.array([len(w) for w in words], pa.int64()),
        })

    rows = pick(docs, doc=id_col, text=text_col).select(
        "doc", "text", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("n_words"))
    return _passes(rows, items, item_id, item_text, min_words, scan).drop("text")


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_words: int = 10, max_coverage: float = 0.5,
) -> DataFrame:
    """``docs`` without the spans that occur in items; documents with more than ``max_coverage`` of their words in such spans go."""
    columns = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), docs[text_col].alias("text"),
                       F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"),
                       F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"))

    def scan(block: pa.RecordBatch, automata, last: bool) -> Iterator[pa.RecordBatch]:
        """Spans are gathered on the uncut text; the last pass cuts them out."""
        texts = as_bytes(block.column(1))
        words = [(t or b"").translate(NORMAL).split() for t in texts]
        spans = [[(s["start"], s["end"]) for s in old] for old in block.column(2).to_pylist()]
        for a in automata:
            for at, some in enumerate(words):
                more, _ = match_words(some, a)
                if more:
                    spans[at] = _merge(spans[at] + more)
        out = [_cut(t, x) if last and x else t for t, x in zip(texts, spans)]
        yield pa.record_batch({
            "row": block.column(0), "text": pa.array([None if t is None else t.decode() for t in out], pa.string()),
            "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
            "n_words": pa.array([len(w) for w in words], pa.int64()),
            "n_hit": pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
        })

    done = _passes(rows, items, item_id, item_text, min_words, scan)
    clean = done.where(F.col("n_hit") <= F.col("n_words") * max_coverage)
    return clean.select(*((F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in columns))
