"""Exact removal of repeated passages with sorted suffixes.

Every byte goes that lies in a string of ``DEPTH`` bytes that also starts anywhere else in the corpus.

*Which suffixes meet.* Each string of DEPTH bytes is owned by an anchor: its 32-byte gram with the least hash (the first of
equals). Equal strings have equal anchors, so only strings under one gram have to be compared, and an anchor whose gram is
nowhere else owns nothing that repeats. The strings an anchor owns lie in one stretch of text. Equal stretches under one gram
repeat as a whole (128 bits of hash say so); one of each kind goes on, with its text, to be sorted against the others.

*Sorting.* The suffixes in the stretches of a gram are ordered by multikey quicksort, eight bytes at a step, to ``SHALLOW`` bytes;
groups that are still equal go into a blind trie, which compares a new suffix with one leaf and branches
where they differ. Suffixes that agree on DEPTH bytes are repeats.

*Crowded grams.* Where ``CROWDED`` different stretches of one gram meet in a block of text, its anchors are marked there and
then, and never sent to one place. A gram with more than ``CHUNK`` stretches is taken apart: strings that begin ``STEP`` or fewer
bytes from each other share a core, and only strings with equal cores are sorted together. Where more than ``CHUNK`` pieces still
have one core, they are sorted in chunks, and strings that are single in their chunk are matched across chunks by 128-bit hash.

Defined results: null text is empty; texts shorter than DEPTH bytes stay whole; rows with equal id and text are repeats of each
other like any others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.llm.common import as_bytes, blocks, kept_in_worker, map_blocks, pick

DEPTH = 200
GRAM = 32
SHALLOW = 32
CROWDED = 16
CHUNK = 1024
STEP = 16
TEXT_AT_ONCE = 2 << 20
SORTED_AT_ONCE = 2 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
_POSITION = (1 << 31) - 1


class Powers:
    """Random values of bytes, and powers of the multiplier and of its inverse modulo 2**64."""

    def __init__(self):
        self.values = np.frombuffer(b"".join(hashlib.sha256(bytes([c])).digest()[:8] for c in range(256)), np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            size = max(size, 2 * len(self.up))
            raised = lambda base: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))))
            self.up, self.down = raised(MULTIPLIER), raised(pow(MULTIPLIER, -1, 1 << 64))
        return self.up, self.down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from running minima of blocks in both directions."""
    size = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:size], forward[width - 1:width - 1 + size])


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All anchors: ``text`` number, ``nth`` in the text, ``gram`` and ``stretch`` hashes, ``at``, and the ``first`` and ``last`` string owned (offsets in the text)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    size = int(ends[-1]) if len(texts) else 0
    empty = np.zeros(0, np.int64)
    valid = np.zeros(max(0, size - DEPTH + 1), bool)
    for start, end in zip(starts[lengths >= DEPTH].tolist(), ends[lengths >= DEPTH].tolist()):
        valid[start:end - DEPTH + 1] = True
    places = np.flatnonzero(valid)
    if not len(places):
        return {"text": empty, "nth": empty, "gram": empty, "stretch": empty, "at": empty, "first": empty, "last": empty}
    powers = kept_in_worker("suffix_powers", Powers)
    up, down = powers.to(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(powers.values[np.frombuffer(b"".join(texts), np.uint8)] * up[:size], out=sums[1:])
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: size - GRAM + 1])
    ranked = ((grams >> np.uint64(31)) << np.uint64(31)) | np.arange(len(grams), dtype=np.uint64)
    owner = (_least_in_windows(ranked, DEPTH - GRAM + 1)[places] & np.uint64(_POSITION)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    at, first = owner[new], places[new]
    last = places[np.concatenate((new[1:], [len(places)])) - 1]
    text = np.searchsorted(ends, at, side="right")
    nth = np.arange(len(text)) - np.searchsorted(text, text)
    stretch = (sums[last + DEPTH] - sums[first]) * down[first]
    shape = (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (last - first).astype(np.uint64)
    return {"text": text, "nth": nth, "gram": grams[at].view(np.int64), "stretch": _mixed(stretch ^ _mixed(shape)).view(np.int64),
            "at": at - starts[text], "first": first - starts[text], "last": last - starts[text]}


def _keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number of the same order."""
    key = np.zeros(len(at), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | data[at + k]
    return key


def blind_trie(buffer: bytes, starts: list[int], depth: int = DEPTH) -> list[list[int]]:
    """Numbers of the suffixes in order; those that agree on ``depth`` bytes together.

    An inner node is [position of the byte it branches on, {byte: node}], a leaf [None, numbers].
    """
    root = [None, [0]]
    for number in range(1, len(starts)):
        start = starts[number]
        node = root
        while node[0] is not None:
            node = node[1].get(buffer[start + node[0]]) or next(iter(node[1].values()))
        there = starts[node[1][0]]
        own, other = buffer[start:start + depth], buffer[there:there + depth]
        if own == other:
            node[1].append(number)
            continue
        differ = int.from_bytes(own, "big") ^ int.from_bytes(other, "big")
        common = depth - (differ.bit_length() + 7) // 8
        above, node = None, root
        while node[0] is not None and node[0] < common:
            above, node = node, node[1][buffer[start + node[0]]]
        leaf = [None, [number]]
        if node[0] == common:
            node[1][buffer[start + common]] = leaf
            continue
        branch = [common, {other[common]: node, own[common]: leaf}]
        if above is None:
            root = branch
        else:
            above[1][buffer[start + above[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out.append(node[1])
        else:
            stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
    return out


def sort_suffixes(buffer: bytes, starts: np.ndarray, depth: int = DEPTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and whether each one agrees with the one before on ``depth`` bytes."""
    data = np.frombuffer(buffer + bytes(8), np.uint8)
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))  # places in the order whose group has several members
    for step in range(0, shallow, 8):
        if not len(open_):
            break
        key = _keys(data, starts[order[open_]] + step)
        moved = np.lexsort((key, group[open_]))
        order[open_] = order[open_][moved]
        key, own = key[moved], group[open_]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        open_ = open_[~alone]
    same = np.zeros(len(starts), bool)
    if len(open_):
        heads = np.flatnonzero(np.concatenate(([True], group[open_][1:] != group[open_][:-1])))
        for head, end in zip(heads.tolist(), [*heads[1:].tolist(), len(open_)]):
            span = open_[head:end]
            numbers = order[span]
            at = starts[numbers].tolist()
            if len(at) == 2:
                own, other = buffer[at[0]:at[0] + depth], buffer[at[1]:at[1] + depth]
                classes = [[0, 1]] if own == other else [[0], [1]] if own < other else [[1], [0]]
            else:
                classes = blind_trie(buffer, at, depth)
            order[span] = numbers[[n for some in classes for n in some]]
            same[span] = [n > 0 for some in classes for n in range(len(some))]
    return order, same


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """One row per gram and stretch of each block of text.

    ``kind``: 0 an anchor; 1 an anchor whose stretch is in the block already; 2 an anchor of a crowded gram; 3 tells of a crowded gram.
    """
    schema = T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType), T.StructField("h", T.LongType()), T.StructField("nth", T.IntegerType()),
        T.StructField("gram", T.LongType()), T.StructField("stretch", T.LongType()), T.StructField("n", T.LongType()), T.StructField("kind", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2, TEXT_AT_ONCE):
            a = anchors([t or b"" for t in as_bytes(block.column(2))])
            if not len(a["gram"]):
                continue
            order = np.lexsort((a["stretch"], a["gram"]))
            gram, stretch = a["gram"][order], a["stretch"][order]
            new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
            new = new_gram | np.concatenate(([True], stretch[1:] != stretch[:-1]))
            heads = np.flatnonzero(new)
            n = np.zeros(len(order), np.int64)
            n[heads] = np.diff(np.concatenate((heads, [len(order)])))
            which = np.cumsum(new_gram) - 1
            stretches = np.bincount(which, new)
            crowded = (stretches >= CROWDED)[which]
            kind = np.where(~new, 1, np.where(crowded, 2, 0)).astype(np.int32)
            text = a["text"][order]
            told = gram[new_gram][stretches >= CROWDED]
            yield pa.record_batch({
                "doc": block.column(0).take(pa.array(text)), "h": block.column(1).take(pa.array(text)), "nth": pa.array(a["nth"][order].astype(np.int32)),
                "gram": pa.array(gram), "stretch": pa.array(stretch), "n": pa.array(n), "kind": pa.array(kind)})
            yield pa.record_batch({
                "doc": pa.nulls(len(told), block.column(0).type), "h": pa.nulls(len(told), pa.int64()), "nth": pa.nulls(len(told), pa.int32()),
                "gram": pa.array(told), "stretch": pa.nulls(len(told), pa.int64()), "n": pa.array(np.zeros(len(told), np.int64)), "kind": pa.array(np.full(len(told), 3, np.int32))})

    return map_blocks(rows.select("doc", "h", "text"), run, schema)


def _candidates(rows: DataFrame) -> DataFrame:
    """``doc, h, nth`` of the anchors whose gram is elsewhere too: ``repeated`` as a whole, or to be ``sorted`` with others of its ``gram``, which may be ``big``."""
    found = _anchor_rows(rows)
    early = session.materialize(found.where("kind in (1, 2)"), "crowded")
    by_gram, by_stretch = Window.partitionBy("gram"), Window.partitionBy("gram", "stretch")
    nth = F.row_number().over(by_stretch.orderBy("doc", "h", "nth"))
    seen = found.where("kind in (0, 3)").select(
        "doc", "h", "nth", "gram", "stretch", "n", "kind", (F.max("kind").over(by_gram) == 3).alias("told"), F.sum("n").over(by_gram).alias("total"),
        F.count(F.lit(1)).over(by_gram).alias("members"), (F.min("stretch").over(by_gram) != F.max("stretch").over(by_gram)).alias("varied"),
        F.sum("n").over(by_stretch).alias("equal"), nth.alias("place"))
    seen = session.materialize(seen.where("kind = 0 and (told or total >= 2)").drop("kind", "total"), "seen")
    few = seen.where("not told").select("doc", "h", "nth", "gram", "stretch", (F.col("equal") >= 2).alias("repeated"),
                                        (F.col("varied") & (F.col("place") == 1)).alias("sorted"), "members")
    plain = ("doc", "h", "nth", "gram", "stretch", "n")
    many = seen.where("told").select(*plain).union(early.where("kind = 2").select(*plain)).select(
        "doc", "h", "nth", "gram", "stretch", (F.sum("n").over(by_stretch) >= 2).alias("repeated"), (nth == 1).alias("sorted"))
    many = session.materialize(many, "many")
    members = many.where("sorted").groupBy(F.col("gram").alias("of")).agg(F.count(F.lit(1)).alias("members"))
    many = many.join(members, F.col("gram") == F.col("of")).drop("of")
    again = early.where("kind = 1").select("doc", "h", "nth", "gram", "stretch", F.lit(True).alias("repeated"), F.lit(False).alias("sorted"), F.lit(1).cast("long").alias("members"))
    return few.union(many).union(again).where("repeated or sorted").select(
        "doc", "h", "nth", "gram", "repeated", "sorted", (F.col("members") > CHUNK).alias("big"))


_RANGES = "array<struct<start: int, end: int>>"
_RANGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _pieces(text: bytes, at: int, first: int, last: int) -> list[tuple[int, int, bytes]]:
    """A stretch in pieces: (hash of the core that its strings share, first string, bytes). Equal strings lie equally far before their anchor."""
    out = []
    for step in range((at - last) // STEP, (at - first) // STEP + 1):
        start, end = max(first, at - STEP * step - STEP + 1), min(last, at - STEP * step)
        core = xxhash.xxh3_64_intdigest(text[at - STEP * step:at - STEP * (step + 1) + 1 + DEPTH], step)
        out.append(((core & ((1 << 63) - 1)) or 1, start, text[start:end + DEPTH]))
    return out


def _opened(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per row: its ranges that repeat as a whole, and its stretches to be sorted; the text only where there are any."""
    lists = candidates.groupBy(F.col("doc").alias("of"), F.col("h").alias("of_h")).agg(
        F.collect_set(F.struct("nth", "repeated", "sorted", "gram", "big")).alias("marks"))
    joined = rows.join(lists, rows["doc"].eqNullSafe(lists["of"]) & (rows["h"] == lists["of_h"]), "left").select("doc", "h", "text", "marks")
    stretch = T.StructType([
        T.StructField("gram", T.LongType()), T.StructField("core", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("bytes", T.BinaryType())])
    schema = T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType), T.StructField("h", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("sha256", T.StringType()), T.StructField("text", T.BinaryType()),
        T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("stretches", T.ArrayType(stretch))])
    arrow_stretch = pa.list_(pa.struct([("gram", pa.int64()), ("core", pa.int64()), ("first", pa.int32()), ("bytes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2, TEXT_AT_ONCE):
            texts = [t or b"" for t in as_bytes(block.column(2))]
            marks = block.column(3).to_pylist()
            ranges, stretches = [None] * len(texts), [None] * len(texts)
            with_marks = [k for k, m in enumerate(marks) if m]
            a = anchors([texts[k] for k in with_marks])
            base = np.searchsorted(a["text"], np.arange(len(with_marks)))
            for k, offset in zip(with_marks, base.tolist()):
                whole, parts = [], []
                for m in marks[k]:
                    first, last = int(a["first"][offset + m["nth"]]), int(a["last"][offset + m["nth"]])
                    if m["repeated"]:
                        whole.append((first, last + DEPTH))
                    if m["sorted"]:
                        pieces = _pieces(texts[k], int(a["at"][offset + m["nth"]]), first, last) if m["big"] else [(0, first, texts[k][first:last + DEPTH])]
                        parts += [{"gram": m["gram"], "core": core, "first": at, "bytes": piece} for core, at, piece in pieces]
                ranges[k] = [{"start": s, "end": e} for s, e in _merged(whole)]
                stretches[k] = parts
            yield pa.record_batch({
                "doc": block.column(0), "h": block.column(1), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "sha256": pa.array([None if m else hashlib.sha256(t).hexdigest() for t, m in zip(texts, marks)], pa.string()),
                "text": pa.array([t if m else None for t, m in zip(texts, marks)], pa.binary()),
                "ranges": pa.array(ranges, _RANGE), "stretches": pa.array(stretches, arrow_stretch)})

    return session.materialize(map_blocks(joined, run, schema), "opened")


def _sorted_repeats(opened: DataFrame) -> DataFrame:
    """``doc, h, start, end`` of repeats found by sorting; with ``high, low`` (a string's hash) where other chunks have to be asked."""
    stretches = opened.where("sha256 is null").select("doc", "h", F.explode("stretches").alias("s")).select("doc", "h", "s.*")
    crowds = session.materialize(stretches.where("core <> 0").groupBy(F.col("gram").alias("of"), F.col("core").alias("of_core")).agg(
        F.count(F.lit(1)).alias("pieces")).where(F.col("pieces") > CHUNK), "crowds")
    counted = stretches.join(session.bounded(crowds, crowds.count()), (F.col("gram") == F.col("of")) & (F.col("core") == F.col("of_core")), "left")
    chunks = F.coalesce(F.ceil(F.col("pieces") / CHUNK), F.lit(1))
    stretches = counted.select("doc", "h", "gram", "core", F.pmod(F.xxhash64("doc", "h", "first"), chunks).alias("chunk"), chunks.alias("chunks"), "first", "bytes")
    schema = T.StructType([
        T.StructField("doc", opened.schema["doc"].dataType), T.StructField("h", T.LongType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: list[tuple] = []
        size = 0

        def judge() -> pa.RecordBatch:
            buffer = b"".join(r[7] for r in held)
            counts = np.array([len(r[7]) - DEPTH + 1 for r in held])
            offsets = np.cumsum([0] + [len(r[7]) for r in held[:-1]])
            stretch = np.repeat(np.arange(len(held)), counts)
            inside = np.arange(len(stretch)) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = offsets[stretch] + inside
            order, same = sort_suffixes(buffer, starts)
            next_same = np.concatenate((same[1:], [False]))
            repeated = np.zeros(len(starts), bool)
            repeated[order] = same | next_same
            # runs of repeated strings, cut where a stretch ends
            flags = repeated & np.concatenate(([True], ~repeated[:-1] | (stretch[1:] != stretch[:-1])))
            run_start = np.flatnonzero(flags)
            closing = repeated & np.concatenate((~repeated[1:] | (stretch[1:] != stretch[:-1]), [True]))
            run_end = np.flatnonzero(closing)
            out = [(held[stretch[s]][0], held[stretch[s]][1], held[stretch[s]][6] + int(inside[s]), held[stretch[s]][6] + int(inside[e]) + DEPTH, None, None)
                   for s, e in zip(run_start.tolist(), run_end.tolist())]
            chunked = np.array([r[5] > 1 for r in held])
            if chunked.any():
                for n, alone in zip(order[~same].tolist(), (~next_same)[~same].tolist()):
                    if chunked[stretch[n]]:
                        row = held[stretch[n]]
                        code = xxhash.xxh3_128_digest(buffer[starts[n]:starts[n] + DEPTH])
                        at = row[6] + int(inside[n])
                        out.append((row[0] if alone else None, row[1] if alone else None, at if alone else None, at + DEPTH if alone else None,
                                    int.from_bytes(code[:8], "big", signed=True), int.from_bytes(code[8:], "big", signed=True)))
            columns = list(zip(*out)) if out else [[] for _ in range(6)]
            return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], (
                pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())))], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if size >= SORTED_AT_ONCE and row[2:5] != held[-1][2:5]:
                    yield judge()
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield judge()

    return session.materialize(map_blocks(stretches.repartition("gram", "core", "chunk").sortWithinPartitions("gram", "core", "chunk"), run, schema), "repeats")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc``, ``n_bytes``, the ``removed`` byte ranges, and ``kept_sha256`` of the bytes that remain."""
    rows = pick(docs, doc=id_col, text=F.coalesce(docs[text_col], F.lit(""))).withColumn("h", F.xxhash64("text"))
    opened = _opened(rows, _candidates(rows))
    repeats = _sorted_repeats(opened)
    across = repeats.where("high is not null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("high", "low"))).where("n >= 2 and start is not null")
    ranges = repeats.where("high is null").select("doc", "h", "start", "end").union(across.select("doc", "h", "start", "end"))
    ranges = ranges.groupBy(F.col("doc").alias("of"), F.col("h").alias("of_h")).agg(F.collect_list(F.struct("start", "end")).alias("more"))
    schema = T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2):
            spans, kept = [], []
            for text, whole, more in zip(*(block.column(c).to_pylist() for c in (2, 3, 4))):
                own = _merged([(r["start"], r["end"]) for r in (whole or []) + (more or [])])
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(hashlib.sha256(cut(text, own)).hexdigest())
            yield pa.record_batch({"doc": block.column(0), "n_bytes": block.column(1), "removed": pa.array(spans, _RANGE), "kept_sha256": pa.array(kept, pa.string())})

    touched = opened.where("sha256 is null")
    touched = touched.join(ranges, touched["doc"].eqNullSafe(ranges["of"]) & (touched["h"] == ranges["of_h"]), "left")
    done = opened.where("sha256 is not null").select("doc", "n_bytes", F.expr(f"cast(array() as {_RANGES})").alias("removed"), F.col("sha256").alias("kept_sha256"))
    return map_blocks(touched.select("doc", "n_bytes", "text", "ranges", "more"), run, schema).union(done)


def cut(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    """What is left of a text without the (merged, ordered) ranges."""
    edges = [0, *(x for span in removed for x in span), len(text)]
    return b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2]))
