"""Tasks get their rows in batches of bounded size, so that neither the JVM nor Python workers hold more than a few at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, decontaminate, fingerprint, ngram_join, quality, token_files
from conftest_corpus import awkward  # noqa: F401  a fixture

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset(LIMIT)
    rows = spark.range(0, 9000, 1, 1).select(F.struct("id", F.repeat(F.lit("word "), 200).alias("text")).alias("row"), F.repeat(F.lit("word "), 200).alias("text"))
    sizes = [r[0] for r in common.map_blocks(rows, lambda batches: (pa.record_batch({"size": [b.nbytes]}) for b in batches), "size long").collect()]
    assert sum(sizes) > 4 * common.BLOCK_BYTES
    assert max(sizes) < 1.1 * common.BLOCK_BYTES


@pytest.mark.parametrize("step", [
    lambda docs: quality.context_sums(docs, "text"),
    lambda docs: ngram_join.keep_one(docs),
    lambda docs: decontaminate.decontaminate(docs, docs, item_id="doc_id"),
    lambda docs: token_files.write(docs),
    lambda docs: fingerprint.fingerprint_edits(docs),
])
def test_steps_ask_for_bounded_batches(spark, awkward, step):
    spark.conf.unset(LIMIT)
    step(awkward)
    assert spark.conf.get(LIMIT) == str(common.BLOCK_BYTES)


def test_blocks_are_cut_evenly():
    batch = pa.record_batch({"text": ["x" * 1000] * 1050})
    cut = lambda size: [b.num_rows for b in common.blocks([batch], 0, size)]
    assert cut(1 << 20) == [1050]  # not a full block and a crumb
    assert len(cut(100_000)) == 11 and max(cut(100_000)) <= 100
    assert cut(1) == [1] * 1050
    assert list(common.blocks([batch.slice(0, 0)], 0)) == []


def test_workers_drop_what_other_operators_kept(spark):
    def keeping(name, owner):
        def run(batches):
            for b in batches:
                yield pa.record_batch({"kept": [len(common.kept_in_worker(name, lambda: "x" * 10))], "names": [",".join(sorted(set(common._shelf().__dict__) & {"one", "two"}))]})

        run.__module__ = owner
        return sorted({tuple(r) for r in common.map_blocks(spark.range(0, 50, 1, 1), run, "kept long, names string").collect()})

    for name, owner in (("one", "plumbline.llm.a"), ("two", "plumbline.llm.b"), ("one", "plumbline.llm.a")):
        assert keeping(name, owner) == [(10, name)]
