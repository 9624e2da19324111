"""Document fingerprints by consistent weighted sampling.

A text is a bag of its adjacent word pairs (a single word stands alone; in place of a word longer than 24 bytes stand all
its runs of 8 code points, so that an insertion changes only the terms around it, in writing without spaces too), weighted by
how often they occur. For each of ``SAMPLES`` samples every term draws, from its hash alone, two Gamma(2, 1) values r, c and a uniform b; with weight w it gets the level t = floor(ln w / r + b) and the value ln c - r (t - b + 1). The term
with the least value is the sample, together with its level. Two texts share a sample with a chance equal to the generalised
Jaccard similarity of their bags, so the share of equal samples estimates it.

Neighbours by id are found without one global order in one task: ids are cut into blocks of about ``BLOCK_CHARS`` characters, the
first row of each block is also sent to the block before it, and each block is walked through in order.

Defined results: null text is empty; texts without words have the fingerprint of nothing, which is like itself (1) and like nothing
else (0); equal ids follow each other in order of their texts; null ids come first; a single row is its own neighbour; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import blocks, kept_in_worker, map_blocks, pick

#: Only A-Z change; bytes.split() then cuts at exactly the white space that the contract names.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SAMPLES = 128
BLOCK_CHARS = 1_000_000
MOST_BLOCKS = 20_000
DRAWN_PER_BLOCK = 20
#: Their draws for all samples fit into a core's cache.
TERMS_AT_ONCE = 512
LONG_WORD, PIECE = 24, 8
EACH = np.arange(SAMPLES)


class Draws:
    """Tables of Gamma(2, 1) quantiles, so that one hash gives r, c and b of a term for one sample."""

    def __init__(self):
        grid = np.linspace(0, 40, 2_000_001)
        chance = 1 - np.exp(-grid) * (1 + grid)
        quantiles = lambda bits: np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), chance, grid)
        self.r = quantiles(14).astype(np.float32)
        self.log_c = np.log(quantiles(18)).astype(np.float32)
        self.seeds = np.array([xxhash.xxh3_64_intdigest(b"sample %d" % k) for k in range(SAMPLES)], np.uint64)

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and b with one row per sample and one column per term."""
        mixed = terms ^ self.seeds[:, None]
        other = np.empty_like(mixed)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= np.right_shift(mixed, np.uint64(31), out=other)
        mixed *= np.uint64(0x94D049BB133111EB)
        # bits 0 to 13 of the two halves' difference say r, 14 to 31 c, the upper half b
        b = mixed.view("<u4")[:, 1::2].astype(np.float32)
        b *= np.float32(2.0**-32)
        mixed ^= np.right_shift(mixed, np.uint64(32), out=other)
        r = self.r.take(np.bitwise_and(mixed, np.uint64(0x3FFF), out=other).view(np.intp), mode="clip")
        np.right_shift(mixed, np.uint64(14), out=other)
        other &= np.uint64(0x3FFFF)
        log_c = self.log_c.take(other.view(np.intp), mode="clip")
        return r, log_c, b

    def least(self, terms: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per sample the least value among sorted ``terms`` (of weight 1 unless given), its term and level; of equal values that of the first term."""
        lowest, chosen, levels = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
        for start in range(0, len(terms), TERMS_AT_ONCE):
            part = terms[start:start + TERMS_AT_ONCE]
            r, log_c, b = self.of(part)
            level = None
            if weights is None:
                np.subtract(1, b, out=b)
            else:
                level = np.floor(np.log(weights[start:start + TERMS_AT_ONCE]).astype(np.float32) / r + b)
                np.add(np.subtract(level, b, out=b), 1, out=b)
            value = np.subtract(log_c, np.multiply(r, b, out=r), out=log_c)
            first = value.argmin(axis=1)
            low = value[EACH, first]
            better = low < lowest
            lowest, chosen = np.where(better, low, lowest), np.where(better, part[first], chosen)
            if level is not None:
                levels = np.where(better, level[EACH, first], levels)
        return lowest, chosen, levels


def pieces(word: str) -> list[str]:
    """All runs of ``PIECE`` code points of a long word."""
    return [word[k:k + PIECE] for k in range(max(1, len(word) - PIECE + 1))]


def terms_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms of a text, and their weights."""
    words = text.translate(LOWER).split()
    if max(map(len, words), default=0) > LONG_WORD:
        words = [p for w in words for p in ([w] if len(w) <= LONG_WORD else pieces(w.decode()))]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(hashes) > 1:
        hashes = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] + np.uint64(0x7F4A7C15))
    return np.unique(hashes, return_counts=True)


def _finish(terms: np.ndarray, levels: np.ndarray) -> np.ndarray:
    mixed = (terms ^ (levels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(48)).astype("<u2")


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], draws: Draws) -> list[np.ndarray]:
    """One signature per bag of (terms, weights), for one or two bags. Terms that both hold once are drawn and compared once."""
    once = [terms[weights == 1] for terms, weights in bags]
    parts = [(once[0], (0,))]
    if len(bags) == 2:
        both = np.intersect1d(*once, assume_unique=True)
        alone = [own[both.take(np.searchsorted(both, own), mode="clip") != own] if len(both) else own for own in once]
        parts = [(both, (0, 1)), (alone[0], (0,)), (alone[1], (1,))]
    found = [(draws.least(terms), holders) for terms, holders in parts]
    for n, (terms, weights) in enumerate(bags):
        many = weights > 1
        found.append((draws.least(terms[many], weights[many]), (n,)))
    best = []
    for n, (terms, _) in enumerate(bags):
        (lowest, chosen, levels), *more = (one for one, holders in found if n in holders)
        for low, term, level in more:
            # of equal values that of the smaller term, whatever the parts were
            better = (low < lowest) | (low == lowest) & (term < chosen)
            lowest, chosen, levels = np.where(better, low, lowest), np.where(better, term, chosen), np.where(better, level, levels)
        best.append(_finish(chosen, levels) if len(terms) else np.zeros(SAMPLES, "<u2"))
    return best


def _written(signature: np.ndarray) -> str:
    """Sixteen bits a sample, in base 64."""
    return base64.b64encode(signature.tobytes()).decode()


def likeness(one: np.ndarray, one_empty: bool, other: np.ndarray, other_empty: bool) -> float:
    if one_empty or other_empty:
        return float(one_empty and other_empty)
    return float((one == other).mean())


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many code points from the start of the next text."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _blocks(rows: DataFrame) -> DataFrame:
    """``block, ahead`` beside ``doc, text``: the block of each row, and once more, marked, the first row of the next block."""
    facts = rows.agg(F.count(F.lit(1)), F.sum(F.length("text")), F.min("doc"), F.count_if(F.col("doc").isNull())).first()
    count, chars, least, nulls = facts[0], facts[1] or 0, facts[2], facts[3]
    wanted = max(1, min(MOST_BLOCKS, -(-chars // BLOCK_CHARS)))
    drawn = rows.where("doc is not null").select("doc").where(F.pmod(F.xxhash64("doc"), F.lit(max(1, count))) < wanted * DRAWN_PER_BLOCK)
    ids = sorted({r[0] for r in drawn.select("doc").distinct().limit(4 * wanted * DRAWN_PER_BLOCK).collect()})
    splits = rows.sparkSession.sparkContext.broadcast(ids[DRAWN_PER_BLOCK // 2::DRAWN_PER_BLOCK])

    @F.arrow_udf("array<int>")
    def places(docs: pa.Array) -> pa.Array:
        """The block of each id; before it, for an id that starts a block, the block ahead of it (as -1 - block)."""
        from bisect import bisect_left, bisect_right

        cuts, out = splits.value, []
        for doc in docs.to_pylist():
            block = 0 if doc is None else bisect_right(cuts, doc)
            out.append([block])
            if doc is not None and block and cuts[block - 1] == doc and bisect_left(cuts, doc) == block - 1:
                out[-1].append(-block)
            if (doc is None) if nulls else (doc == least):
                out[-1].append(-1 - len(cuts))
        return pa.array(out, pa.list_(pa.int32()))

    placed = rows.select("doc", "text", F.explode(places("doc")).alias("place"))
    return placed.select("doc", "text", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("block"), (F.col("place") < 0).alias("ahead"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of its text and of its edited text, and their likeness to each other and to the next row's."""
    rows = pick(docs, doc=id_col, text=F.coalesce(docs[text_col], F.lit("")))
    schema = T.StructType([
        rows.schema["doc"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def judge(block: list[tuple]) -> pa.RecordBatch:
        """Rows of a block with the row after each (doc, text, next text). A text and its edit are drawn together, once per row."""
        draws = kept_in_worker("cws_draws", Draws)
        out = []
        signed = []
        for doc, text, following in block:
            changed = edited(text, following)
            bags = [terms_of(t.encode()) for t in ((text,) if changed == text else (text, changed))]
            pair = [(signature, not len(terms)) for (terms, _), signature in zip(bags, signatures(bags, draws))]
            signed.append((pair[0], pair[-1], changed))
        for at, (doc, text, following) in enumerate(block):
            own, other, changed = signed[at]
            if at + 1 < len(block) and block[at + 1][1] == following:
                after = signed[at + 1][0]
            elif following == text:
                after = own
            else:
                bag = terms_of(following.encode())
                after = signatures([bag], draws)[0], not len(bag[0])
            out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), _written(own[0]), _written(other[0]),
                        likeness(*own, *other), likeness(*own, *after)))
        columns = list(zip(*out))
        return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], (
            pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())))], names=schema.names)

    kind = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind
        before, closed, held = None, None, []
        for batch in blocks(batches, 1):
            kind = batch.column(0).type
            for doc, text, block, ahead in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if before is not None and before[2] == block:
                    held.append((before[0], before[1], text))
                    before = None
                if ahead:
                    before, closed = None, block
                elif block != closed:
                    before = (doc, text, block)
            if held:
                yield judge(held)
                held = []

    dealt = _blocks(rows).repartition("block").sortWithinPartitions("block", "ahead", F.col("doc").asc_nulls_first(), "text")
    return map_blocks(dealt, run, schema)
