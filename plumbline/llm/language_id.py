"""Language identification with bit-sliced Bloom filters over letter n-grams.

Trigrams around a letter (exact, 63 bits; words padded with a blank) and single letters are counted by language over all
documents to learn from. A language's filter holds its most frequent n-grams that make up ``COVERAGE`` of all
occurrences (those counted alike come in together), at most ``MOST_GRAMS`` of them; so a language with any letter has a filter. All filters have
room for the language with the most n-grams and lie bit by bit beside each other: one probe returns the set of languages
that hold an n-gram, as a bit mask. A document counts the bits per language, corrects them for the false positives of
each filter's fill, and takes the largest count. Single letters count ``LETTER_WEIGHT`` as much: they decide where a script has so many letters that
trigrams are seldom met again.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal counts go to the first language by
name; a text of letters that no language knows gets the language with the most letters to learn from, with score 0; without anything to learn
from everything is ``und``; repeated rows get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.llm.common import blocks, kept_in_worker, map_blocks, pick

COVERAGE = 0.99
#: Bound on the n-grams of a language's filter (beyond it only where a single size class is larger); at 16 bits each, the filters of 64 languages take 32 MB.
MOST_GRAMS = 200_000
LETTER_WEIGHT = 0.1
PROBES = 3
BITS_PER_GRAM = 16
HELD_GRAMS = 1_000_000
BLANK = 32
#: Bytes of text whose trigrams are in memory at a time (some 40 bytes each).
TEXT_AT_ONCE = 2 << 20


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank."""
    table = np.full(0x110000, BLANK, np.uint32)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            low = sign.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All trigrams around a letter, those letters alone, and the number of them in each text."""
    table = kept_in_worker("letters", _letters)
    joined = "\n".join(["", *(t or "" for t in texts), ""])
    points = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    middle = points[1:-1] != BLANK
    grams = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    upto = np.concatenate(([0], np.cumsum(middle)))[ends - 1] if texts else np.zeros(0, np.int64)
    return grams[middle], points[1:-1][middle], np.diff(np.concatenate(([0], upto)))


def count_grams(docs: DataFrame, learn: Column, lang_col: str, text_col: str) -> DataFrame:
    """``lang, gram, n`` over the rows to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (grams, counts) in held.items():
                yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(counts.astype(np.int64))})
            held.clear()

        for block in blocks(batches, 1, TEXT_AT_ONCE):
            langs = np.array(block.column(0).to_pylist(), object)
            texts = block.column(1).to_pylist()
            for lang in set(langs):
                found = ngrams([t for t, own in zip(texts, langs) if own == lang])
                grams, counts = np.unique(np.concatenate(found[:2]), return_counts=True)
                if lang in held:
                    grams, inverse = np.unique(np.concatenate([held[lang][0], grams]), return_inverse=True)
                    counts = np.bincount(inverse, np.concatenate([held[lang][1], counts]), len(grams))
                held[lang] = grams, counts
            if sum(len(g) for g, _ in held.values()) > HELD_GRAMS:
                yield from flush()
        yield from flush()

    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return map_blocks(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def owned(counts: DataFrame) -> DataFrame:
    """``lang, gram, total``: what each language's filter holds, and the language's letters in all.

    Counts are looked at by size class (sixteen to a doubling), of which a language has a few hundred, from the largest on.
    """
    kind, level = (F.col("gram") < 1 << 21).alias("letter"), F.floor(F.log2("n") * 16).alias("level")
    levels = counts.groupBy("lang", kind, level).agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("n"))
    larger = Window.partitionBy("lang", "letter").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.sum(c).over(larger) - F.col(c)
    whole = Window.partitionBy("lang", "letter")
    held = levels.select("lang", "letter", "level", before("n").alias("covered"), F.sum("grams").over(larger).alias("upto"), F.sum("n").over(whole).alias("total"))
    held = held.where((F.col("covered") < COVERAGE * F.col("total")) & ((F.col("upto") <= MOST_GRAMS) | (F.col("covered") == 0)))
    lowest = held.groupBy(F.col("lang").alias("of"), F.col("letter").alias("kind")).agg(F.min("level").alias("least"), F.first("total").alias("total"))
    rows = counts.select("lang", "gram", kind, level)
    return rows.join(lowest, (F.col("lang") == F.col("of")) & (F.col("letter") == F.col("kind")) & (F.col("level") >= F.col("least"))).select("lang", "gram", "total")


class Filters:
    """One Bloom filter per language, sliced: row ``i`` holds bit ``i`` of every filter."""

    def __init__(self, langs: list[str], size: int):
        self.langs, self.size = langs, size
        self.rows = np.zeros((size, max(1, -(-len(langs) // 64))), np.uint64)
        self.usual = 0

    def places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        mixed = grams * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        for _ in range(PROBES):
            yield (mixed & np.uint64(self.size - 1)).astype(np.int64)
            mixed = mixed + step

    def add(self, grams: np.ndarray, langs: np.ndarray) -> None:
        for at in self.places(grams):
            np.bitwise_or.at(self.rows, (at, langs // 64), np.uint64(1) << (langs % 64).astype(np.uint64))

    def close(self) -> Filters:
        """Chance of a false positive of each language, from how full its filter is."""
        fill = np.array([((self.rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.langs))])
        self.false = fill ** PROBES
        return self

    def counts(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Corrected number of trigrams of each text that each language owns."""
        masks = None
        for at in self.places(grams):
            masks = self.rows[at] if masks is None else masks & self.rows[at]
        starts = np.cumsum(sizes) - sizes
        some = sizes > 0
        out = np.zeros((len(sizes), len(self.langs)))
        for k, false in enumerate(self.false):
            hits = ((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64)
            if some.any():
                out[some, k] = np.add.reduceat(hits, starts[some])
            out[:, k] = np.maximum(0, (out[:, k] - sizes * false) / (1 - min(false, 0.999)))
        return out


def train(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters from all rows that meet ``learn`` and have a language."""
    table = owned(session.materialize(count_grams(docs, learn, lang_col, text_col), "gram-counts")).toArrow()
    names = np.array(table.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    grams = table.column("gram").to_numpy().view(np.uint64)
    owners = np.searchsorted(langs, names) if langs else np.zeros(0, np.int64)
    size = 1 << max(10, (BITS_PER_GRAM * int(np.bincount(owners).max(initial=0))).bit_length())
    filters = Filters(langs, size)
    filters.add(grams, owners)
    totals = dict(zip(owners.tolist(), table.column("total").to_pylist()))
    filters.usual = max(totals, key=lambda k: (totals[k], -k), default=0)
    return filters.close()


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc``, ``lang`` and ``score``, the winner's share of all corrected counts."""
    shared = docs.sparkSession.sparkContext.broadcast(filters.__dict__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters([], 1)
        filters.__dict__.update(shared.value)
        for block in blocks(batches, 1, TEXT_AT_ONCE):
            grams, letters, sizes = ngrams(block.column(1).to_pylist())
            langs, scores = ["und"] * len(sizes), np.zeros(len(sizes))
            if filters.langs:
                counts = filters.counts(grams, sizes) + LETTER_WEIGHT * filters.counts(letters, sizes)
                total = counts.sum(axis=1)
                best = np.where(total > 0, counts.argmax(axis=1), filters.usual)
                langs = [filters.langs[b] if n else "und" for b, n in zip(best, sizes)]
                scores = np.where((sizes > 0) & (total > 0), counts.max(axis=1) / np.maximum(total, 1e-12), 0.0)
            yield pa.record_batch({"doc": block.column(0), "lang": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    rows = pick(docs, doc=id_col, text=text_col)
    return map_blocks(rows, run, T.StructType([rows.schema["doc"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
