"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word with the two words after it in its piece, padded with nulls at the
piece's end. Blocks of text lay them out as lead columns (the word column shifted by 1, 2, ...) and add up equal windows before
the one large shuffle. A phrase's count is the sum over the windows that begin with it, which Spark's ROLLUP gives
for all shorter prefixes at once; no other n-gram is ever exploded. What comes after a window's first words (``head``) is
folded into the padding where it is too rare to be reported, in the tasks that hold a whole head, so that ROLLUP reads
little more than the words. Windows are dealt out by language and head; a head that holds a large share of all
windows (found on a sample; this steers the dealing only) is split by its last word, into parts of about ``1 / PARTS`` of all rows.

Scores are whole numbers from decimals of 38 digits.

Defined results: null or empty texts have no words; a null language is ``und``; repeated rows count again; an empty table gives an
empty result; further columns are ignored; ties are ordered by phrase. Texts of any length are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.common import as_bytes, blocks, map_blocks, pick

BLOCK_BYTES = 12 << 20
#: A head with more than ``1 / PARTS`` of the sampled windows is split; so at most ``PARTS`` heads are.
PARTS = 1000
SAMPLE_TEXTS = 64
WINDOWS = "lang string, head string, w3 string, n long"
NAMES = ["w1", "w2", "w3"]
HEAD = ["lang", "head"]

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: One byte for one byte: lower case, piece ends to line feeds, tabs to blanks.
PLAIN = bytes(10 if b in PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def lead_windows(langs: list[bytes | None], texts: list[bytes | None]) -> pa.RecordBatch:
    """Distinct (lang, head, w3) of some texts with their counts, in order; the head is "w1 w2", or "w1" at the end of a piece."""
    flat = np.frombuffer(b"\n".join(t or b"" for t in texts).translate(PLAIN), np.uint8)
    in_word = (flat != 32) & (flat != 10)
    edges = np.flatnonzero(np.diff(in_word, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    # a word's piece is told by the line feeds before it, its text by where the texts end
    piece = np.cumsum(np.bincount(np.searchsorted(starts, np.flatnonzero(flat == 10)), minlength=len(starts) + 1), dtype=np.int32)[:len(starts)]
    ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
    names, lang_of_text = np.unique(np.array([b"und" if v is None else v for v in langs], dtype=object), return_inverse=True)
    lang = lang_of_text[np.searchsorted(ends, starts, side="right")].astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[in_word])])
    coded = words.dictionary_encode()
    del flat, in_word, edges, starts, lengths, offsets, words
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)  # 0 is the padding
    first = rank[coded.indices.to_numpy()]
    columns = [lang, first]
    for lead in range(1, len(NAMES)):
        shifted = np.zeros_like(first)
        shifted[:-lead] = np.where(piece[lead:] == piece[:-lead], first[lead:], 0)
        columns.append(shifted)
    columns, counts = distinct_rows(columns, [len(names), *[len(order) + 1] * len(NAMES)])
    text_of = coded.dictionary.take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
    w1, w2, w3 = (text_of.take(pa.array(c - 1, mask=c == 0)) for c in columns[1:])
    lang = pa.array(list(names), pa.binary()).cast(pa.string()).take(pa.array(columns[0]))
    head = pc.binary_join_element_wise(w1, w2, " ", null_handling="skip")
    return pa.record_batch([lang, head, w3, pa.array(counts, pa.int64())], ["lang", "head", "w3", "n"])


def distinct_rows(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of whole numbers below ``sizes``, in order, and how often each occurs."""
    if prod(sizes) < 1 << 62:
        key = columns[0]
        for column, size in zip(columns[1:], sizes[1:]):
            key = key * size + column
        key, counts = np.unique(key, return_counts=True)
        out = []
        for size in sizes[:0:-1]:
            out.append(key % size)
            key = key // size
        return [key, *out[::-1]], counts
    table = np.stack(columns)[:, np.lexsort(columns[::-1])]
    begins = np.flatnonzero(np.concatenate(([True], (table[:, 1:] != table[:, :-1]).any(axis=0))))
    return list(table[:, begins]), np.diff(np.append(begins, table.shape[1]))


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 1, BLOCK_BYTES):
        counted = lead_windows(as_bytes(block.column(0)), as_bytes(block.column(1)))
        for start in range(0, counted.num_rows, 50_000):
            yield counted.slice(start, 50_000)


def _crowded(texts: DataFrame) -> DataFrame:
    """Heads that hold a large share of all windows on a sample of the texts (at most ``PARTS`` rows): ``lang``, ``head``, ``slices``."""
    sample = map_blocks(texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE_TEXTS)) == 0).select("lang", "text"), _count_blocks, WINDOWS)
    by_head = sample.groupBy(*HEAD).agg(F.count(F.lit(1)).alias("rows"))
    by_head = session.materialize(by_head, "heads")
    rows = by_head.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return by_head.where(F.col("rows") * PARTS > rows).select(*HEAD, F.ceil(F.col("rows") * PARTS / F.lit(max(1, rows))).alias("slices"))


def count_phrases(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``lang``, ``w1``, ``w2``, ``w3``, ``n``, ``size``: phrases of 1 to 3 words with at least ``least`` occurrences; size 0 counts all words of a language."""
    texts = pick(docs, lang=lang_col, text=text_col, id=id_col)
    windows = map_blocks(texts.select("lang", "text"), _count_blocks, WINDOWS)
    crowded = F.broadcast(_crowded(texts))
    dealt = windows.join(crowded, HEAD, "left").select(
        *HEAD, "w3", "n", F.coalesce(F.pmod(F.xxhash64("w3"), F.col("slices")), F.lit(-1)).alias("slice")).repartition(*HEAD, "slice")
    # a head and slice is in one task from here on; what is too rare to be reported goes into the padding
    whole = dealt.groupBy(*HEAD, "slice", "w3").agg(F.sum("n").alias("n"))
    folded = whole.groupBy(*HEAD, "slice", F.when(F.col("n") >= least, F.col("w3")).alias("w3")).agg(F.sum("n").alias("n"))
    in_head = F.sum("n").over(Window.partitionBy(*HEAD, "slice"))
    pair = F.split("head", " ")
    folded = folded.withColumn("in_head", in_head).select(
        "lang", pair[0].alias("w1"), F.when((F.col("in_head") >= least) | (F.col("slice") >= 0), F.get(pair, F.lit(1))).alias("w2"), "w3", "n")
    summed = folded.rollup("lang", *NAMES).agg(F.sum("n").alias("n"), F.grouping_id().alias("rolled"))
    size = F.when(F.col("rolled") == 0, 3).when(F.col("rolled") == 1, 2).when(F.col("rolled") == 3, 1).when(F.col("rolled") == 7, 0)
    last = F.when(F.col("size") == 3, F.col("w3")).when(F.col("size") == 2, F.col("w2")).otherwise(F.lit(""))
    return summed.withColumn("size", size).where(F.col("size").isNotNull() & last.isNotNull() & ((F.col("n") >= least) | (F.col("size") == 0))).drop("rolled")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact for counts of up to 15 digits."""
    whole = lambda c: c.cast("decimal(15,0)")
    over = F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a))
    return F.call_function("div", over, whole(left) * whole(right)).cast("long")


def mine(
    docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``words``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's first ``top`` phrases of 2 and 3 words.

    A pair goes if a triple around it has at least ``share`` percent of its occurrences.
    """
    counts = session.materialize(count_phrases(docs, least, text_col, lang_col, id_col), "phrases")
    many = {r["size"]: r["count"] for r in counts.groupBy("size").count().collect()}
    of = lambda size: counts.where(F.col("size") == size)

    def counted(size: int, *names: str) -> DataFrame:
        """Counts of the phrases of ``size`` words, under the names of the words they are joined on and of the count."""
        picked = of(size).select("lang", *(F.col(w).alias(name) for w, name in zip(NAMES[:size], names)), F.col("n").alias(names[size]))
        return session.bounded(picked, many.get(size, 0))

    pairs = of(2).select("lang", "w1", "w2", F.col("n").alias("a"))
    triples = of(3).select("lang", *NAMES, F.col("n").alias("a"))
    around = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    around = around.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longest"))
    pairs = pairs.join(around, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longest") < share * F.col("a"), F.lit(True)))
    pairs = pairs.join(counted(1, "w1", "l"), ["lang", "w1"]).join(counted(1, "w2", "r"), ["lang", "w2"])
    cut = lambda k, left, right: F.struct(
        score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    scored_pairs = pairs.select("lang", F.array("w1", "w2").alias("words"), "a", cut(1, F.col("l"), F.col("r")).alias("cut"))
    triples = triples.join(counted(1, "w1", "l1"), ["lang", "w1"]).join(counted(2, "w2", "w3", "r1"), ["lang", "w2", "w3"])
    triples = triples.join(counted(2, "w1", "w2", "l2"), ["lang", "w1", "w2"]).join(counted(1, "w3", "r2"), ["lang", "w3"])
    lowest = F.least(cut(1, F.col("l1"), F.col("r1")), cut(2, F.col("l2"), F.col("r2")))
    scored = scored_pairs.union(triples.select("lang", F.array(*NAMES).alias("words"), "a", lowest.alias("cut")))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", "cut.l", "cut.r", "cut.score")
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(by_score).cast("long")).where(F.col("rank") <= top)
    totals = of(0).select("lang", "n")
    return ranked.join(session.bounded(totals, many.get(0, 0)), "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")
