"""Token ids in binary segments, with document boundaries as Elias-Fano sequences.

Documents are range partitioned and sorted by id, encoded, and written as a table of segments. A segment holds
the concatenated ids of consecutive documents (little-endian, 16 bits where the vocabulary allows, else 32) and
their start offsets as an Elias-Fano sequence: low bits packed, high bits in unary, with the bit position of every
``SAMPLE``-th one as select structure. An offset takes about 2 + log2(ids / documents) bits and is found without
decoding the others.

Words between plain white space are encoded once per worker and looked up afterwards. The vocabularies used here
never merge across white space, so the ids are those of the whole text (tests compare the two).

Defined results: null text is empty (its ids are the end id alone); equal ids stand next to each other, ordered by
their texts; null ids come first; an empty table gives files without segments; further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.llm.common import as_bytes, blocks, kept_in_worker, map_blocks, pick

SEGMENT_IDS = 1 << 19
SAMPLE = 64
CACHED_WORDS = 400_000
#: Words handed to the tokenizer as one text; where their ends cannot be told apart, fewer, then each alone.
TOGETHER = 1000
END_ID = 1
#: Plain punctuation, in tails of at most so many bytes; longer ones stay with their words.
IS_MARK = np.isin(np.arange(256), list(b",.;:!?"))
LONGEST_TAIL = 8
#: Code points that UTF-8 writes in one or two bytes.
SHORT = 1 << 11
#: Plain white space, which words are cut at, as blanks.
BLANKS = bytes(32 if b in b"\t\n\r" else b for b in range(256))
HEAD = "<4sBQQI"
MAGIC = b"EFS1"


class EliasFano:
    """A non-decreasing sequence of whole numbers in near-minimal space."""

    def __init__(self, data: bytes):
        magic, self.low_bits, self.count, _, samples = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano sequence")
        at = struct.calcsize(HEAD)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        size = -(-self.count * self.low_bits // 8)
        self.low = np.frombuffer(data, np.uint8, size, at)
        self.high = np.frombuffer(data, np.uint8, -1, at + size)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = values.astype(np.int64)
        count, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, count)).bit_length() - 1)
        low = np.packbits((values[:, None] >> np.arange(low_bits) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(count)
        high = np.zeros(int(ones[-1]) + 1 if count else 0, np.uint8)
        high[ones] = 1
        samples = ones[::SAMPLE].astype("<u4")
        return (struct.pack(HEAD, MAGIC, low_bits, count, top, len(samples)) + samples.tobytes() + low.tobytes()
                + np.packbits(high, bitorder="little").tobytes())

    def select(self, n: int) -> int:
        """Bit position of the n-th one: from the sample before it, then by counting bits."""
        at, seen = int(self.samples[n // SAMPLE]), n - n % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while seen + word.bit_count() <= n:
            seen += word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(n - seen):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, n: int) -> int:
        bits, first = self.low_bits, n * self.low_bits
        chunk = int.from_bytes(self.low[first // 8:(first + bits + 7) // 8].tobytes(), "little") >> first % 8
        return self.select(n) - n << bits | chunk & (1 << bits) - 1

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return (ones - np.arange(self.count) << self.low_bits) | low


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of the words of texts. Words met before are found in an Arrow array of known words, whose ids stand in one
    flat array; when too many are known, those not met for longest are forgotten.

    A word is told apart from plain punctuation that follows its last letter, where every tokenizer of words divides, too.
    Words of letters only are handed to the tokenizer many at a time: each is one unit to it, and ends where an id
    with the end-of-word mark stands. All others are encoded alone.
    """

    END_MARK = "</w>"

    def __init__(self, described: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_str(described), kind
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[n for word, n in vocabulary.items() if word.endswith(self.END_MARK)]] = True
        # letters that a comma is divided from; not "İ", say, which becomes a letter and a sign in lower case
        letters = [c for c in map(chr, range(SHORT)) if c.isalpha()]
        alone, followed, comma = (
            [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)] for some in (letters, [c + "," for c in letters], [","]))
        self.letters = np.zeros(SHORT, bool)
        self.letters[[ord(c) for c, a, b in zip(letters, alone, followed) if a + comma[0] == b]] = True
        self.words = pa.array([], pa.large_binary())
        self.ids, self.bounds = np.zeros(0, kind), np.zeros(1, np.int64)
        self.met, self.calls = np.zeros(0, np.int64), 0

    def _alone(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids side by side, and how many each word has."""
        for at in range(0, len(words), 10_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[at:at + 10_000], add_special_tokens=False)]
            yield np.array(list(itertools.chain.from_iterable(found)), self.kind), np.array(list(map(len, found)), np.int64)

    def _together(self, words: list[str], size: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts = [words[at:at + size] for at in range(0, len(words), size)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                yield ids, np.diff(cuts, prepend=0)
            elif size > 50:  # not a vocabulary that marks the ends of words, or an odd word among them
                yield from self._together(part, size // 10)
            else:
                yield from self._alone(part)

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.met, kind="stable")[: CACHED_WORDS // 2])
        lengths = np.diff(self.bounds)[kept]
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        self.ids = self.ids[np.arange(bounds[-1]) + np.repeat(self.bounds[kept] - bounds[:-1], lengths)]
        self.words, self.bounds, self.met = self.words.take(pa.array(kept)), bounds, self.met[kept]

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among the known ones; new ones are encoded and become known."""
        if len(self.words) > CACHED_WORDS:
            self._forget()
        self.calls += 1
        found = pc.index_in(words, value_set=self.words)
        at, fresh = found.fill_null(-1).to_numpy().astype(np.int64), np.flatnonzero(found.is_null())
        new = words.take(pa.array(fresh))
        as_text = new.cast(pa.large_string()).to_pylist()
        plain = np.fromiter(map(str.isalpha, as_text), bool, len(as_text))
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        coded = [*self._together(list(itertools.compress(as_text, plain))), *self._alone(list(itertools.compress(as_text, ~plain)))]
        at[fresh[order]] = len(self.words) + np.arange(len(order))
        self.words = pa.concat_arrays([self.words, new.take(pa.array(order))])
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in coded)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in coded)]))])
        self.met = np.concatenate((self.met, np.zeros(len(order), np.int64)))
        self.met[at] = self.calls
        return at

    def encode(self, texts: list[bytes | None], end: bytes) -> list[bytes]:
        """Ids of every text, each followed by ``end``. Distinct words are looked up, then all places are filled side by side."""
        if not texts:
            return []
        texts = [(t or b"").translate(BLANKS) for t in texts]
        flat = np.frombuffer(b"\n".join(texts), np.uint8)
        in_word = (flat != 32) & (flat != 10)
        edges = np.flatnonzero(np.diff(in_word, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        tails = tail_lengths(flat, starts, ends, self.letters)
        # a word and its tail, if it has one, stand side by side among the pieces
        upto = np.cumsum(ends - starts)
        pieces = np.stack((upto - tails, upto), axis=1)[np.stack((np.ones(len(tails), bool), tails > 0), axis=1)]
        cut = pa.Array.from_buffers(
            pa.large_binary(), len(pieces), [None, pa.py_buffer(np.concatenate(([0], pieces)).astype(np.int64)), pa.py_buffer(flat[in_word])])
        coded = cut.dictionary_encode()
        at = self._look_up(coded.dictionary)
        # the end id is one more word, behind the pieces of each text
        text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        before = np.concatenate(([0], np.cumsum(1 + (tails > 0))))[np.searchsorted(starts, text_ends)]
        codes = np.insert(coded.indices.to_numpy(), before, len(at))
        begins = np.append(self.bounds[at], len(self.ids))
        lengths = np.append(self.bounds[at + 1] - self.bounds[at], 1)[codes]
        behind = np.cumsum(lengths)
        source = np.append(self.ids, np.frombuffer(end, self.kind))
        data = source[np.arange(behind[-1]) + np.repeat(begins[codes] - behind + lengths, lengths)].tobytes()
        bounds = (np.concatenate(([0], behind[before + np.arange(len(texts))])) * np.dtype(self.kind).itemsize).tolist()
        return [data[start:stop] for start, stop in zip(bounds, bounds[1:])]


def tail_lengths(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bytes of plain punctuation at the end of each word, behind one of ``letters``; 0 for more than ``LONGEST_TAIL``."""
    tails = np.zeros(len(ends), np.int64)
    open_ = np.flatnonzero(IS_MARK[flat[ends - 1]])
    for length in range(1, LONGEST_TAIL + 1):
        last = ends[open_] - length - 1
        inside = last >= starts[open_]
        open_, last = open_[inside], last[inside]
        byte, ahead = flat[last].astype(np.int64), flat[np.maximum(last - 1, 0)].astype(np.int64)
        two = (byte >> 6 == 2) & (ahead >> 5 == 6)
        letter = np.where(two, letters[(ahead & 31) << 6 | byte & 63], (byte < 128) & letters[byte])
        tails[open_[letter]] = length
        open_ = open_[IS_MARK[flat[last]]]
    return tails


def write(
    docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Write the segments below ``path`` (default: a new folder in the shared one) and return it."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or session.scratch_path(spark, "token-files")
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:
        described = file.read()
    width = 4 if max(Tokenizer.from_str(described).get_vocab_size(), end_id + 1) > 1 << 16 else 2
    kind = f"<u{width}"
    shared = spark.sparkContext.broadcast(described)
    name = f"tokenizer_{zlib.crc32(described.encode()):08x}"
    rows = pick(docs, doc=id_col, text=text_col)
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_ids", T.LongType()),
        T.StructField("width", T.IntegerType()), T.StructField("docs", T.ArrayType(rows.schema["doc"].dataType)),
        T.StructField("ids", T.BinaryType()), T.StructField("boundaries", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(name, lambda: WordEncoder(shared.value, kind))
        end = np.array([end_id], kind).tobytes()
        part, segment, held, docs, ids, doc_type = TaskContext.get().partitionId(), 0, 0, [], [], pa.null()

        def flush() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum([len(x) // width for x in ids])))
            return pa.record_batch({
                "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_ids": pa.array([int(starts[-1])], pa.int64()),
                "width": pa.array([width], pa.int32()), "docs": pa.array([docs], pa.list_(doc_type)),
                "ids": pa.array([b"".join(ids)], pa.binary()), "boundaries": pa.array([EliasFano.encode(starts)], pa.binary()),
            })

        for block in blocks(batches, 1):
            doc_type = block.column(0).type
            for doc, some in zip(block.column(0).to_pylist(), encoder.encode(as_bytes(block.column(1)), end)):
                if held and held + len(some) > SEGMENT_IDS * width:
                    yield flush()
                    segment, held, docs, ids = segment + 1, 0, [], []
                docs.append(doc)
                ids.append(some)
                held += len(some)
        if docs:
            yield flush()

    # the texts are put in order, not the ids: the range partitioner reads its input twice
    map_blocks(rows.repartitionByRange("doc").sortWithinPartitions("doc", "text"), run, schema).write.parquet(path)
    return path


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``."""
    files = spark.read.parquet(path)
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = by_part.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = files.select("part", "segment", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("within"))
    bases = inside.join(parts, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("base"))
    id_type = files.schema["docs"].dataType.elementType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("doc_id", id_type),
        T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, segment, width, docs, ids, boundaries = (batch.column(c)[row] for c in range(6))
                starts = EliasFano(boundaries.as_py()).decode()
                tokens = np.frombuffer(ids.as_buffer(), "<u2" if width.as_py() == 2 else "<u4")
                sums = [zlib.crc32(tokens[s:e].astype("<u4").tobytes()) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
                n = len(sums)
                yield pa.record_batch({
                    "part": pa.array([part.as_py()] * n, pa.int32()), "segment": pa.array([segment.as_py()] * n, pa.int32()), "doc_id": docs.values,
                    "offset": pa.array(starts[:-1]), "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array(sums, pa.int64()),
                })

    rows = map_blocks(files.select("part", "segment", "width", "docs", "ids", "boundaries"), run, schema)
    return rows.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc) -> list[list[int]]:
    """The token ids of every document with this id, by random access into their segments."""
    found = []
    for row in spark.read.parquet(path).where(F.array_contains("docs", F.lit(doc))).collect():
        starts = EliasFano(bytes(row["boundaries"]))
        tokens = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4")
        found += [tokens[starts[n]:starts[n + 1]].tolist() for n, d in enumerate(row["docs"]) if d == doc]
    return found
