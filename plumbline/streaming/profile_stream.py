"""Profiles of a file stream. State covers the whole input; there is no event time.

``profile_stream`` keeps counters in the state store. ``StreamProfile`` is the whole profile: each batch adds its own
counts of values to a table in the shared folder, and the finished profile is worked out from their sum by the same code
as a table's, so that it is equal to it, quantiles, lists and personal data included.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.functions import text
from plumbline.operators.frequency import ColumnSet, FrequencyTable, add_counts, count_cells, describe_values, long_texts, text_of
from plumbline.operators.stats import inferred_type, row_digests
from plumbline.plans.profile import ALL_PARTS, finished

#: After so many batches their counts are added up into one table, so that readers never meet more parts than that.
ADDED_UP_AFTER = 32


def read_stream(spark: SparkSession, folder: str, schema, form: str = "parquet", glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(form).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def read_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream: a folder of files, or a single file (whose folder is then read for its name alone)."""
    df = spark.read.parquet(path)
    place = PurePosixPath(path)
    files = [PurePosixPath(f) for f in df.inputFiles()]
    if len(files) == 1 and files[0].name == quote(place.name) and files[0].parent.name != quote(place.name):
        return read_stream(spark, str(place.parent), df.schema, glob=place.name, files_per_batch=files_per_batch)
    return read_stream(spark, path, df.schema, files_per_batch=files_per_batch)


def _text_cells(df: DataFrame) -> DataFrame:
    stacked = [F.lit(len(df.columns))]
    for c in df.columns:
        stacked += [F.lit(c), text.clean(text_of(df[text.quoted(c)], df.schema[c].dataType))]
    return df.select(F.stack(*stacked).alias("column", "cell"))


def profile_stream(stream: DataFrame) -> DataFrame:
    """Running column profile: counters, types, lengths, moments and an estimated distinct count."""
    cells = _text_cells(stream)
    cell = F.col("cell")
    valid = ~text.is_missing_text(cell)
    marked = cells.select(
        "column", valid.alias("valid"), F.when(valid, cell).alias("cell"),
        F.when(valid, text.number_of_text(cell)).alias("num"),
    )
    numeric = text.is_numeric_text(cell)
    boolean = text.is_boolean_text(cell) & ~numeric
    grouped = marked.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(~F.col("valid")).alias("missing"),
        F.count_if("valid").alias("total_valid"),
        F.count_if(text.is_integer_text(cell)).alias("integer_count"),
        F.count_if(numeric).alias("numeric_count"),
        F.count_if(boolean).alias("boolean_count"),
        F.count_if(text.is_date_text(cell) & ~numeric & ~boolean).alias("date_count"),
        F.min(F.octet_length(cell)).cast("bigint").alias("min_length"),
        F.max(F.octet_length(cell)).cast("bigint").alias("max_length"),
        F.count("num").alias("num_count"),
        F.min("num").alias("min"), F.max("num").alias("max"), F.sum("num").alias("sum"),
        F.avg("num").alias("mean"),
        F.stddev_samp("num").alias("std_dev"),
        F.skewness("num").alias("skewness"), F.kurtosis("num").alias("kurtosis"),
        F.approx_count_distinct(cell, 0.016).alias("distinct_estimate"),
    )
    return grouped.withColumn("inferred_type", inferred_type())


@dataclass(frozen=True)
class StreamProfile:
    """The whole profile of a stream, kept below ``place`` in the shared folder.

    * ``counts/batch=k``: how often each column held each value in batch k, and the first row it was seen in;
    * ``sums/upto=k``: the sum of all batches up to k, written every ``ADDED_UP_AFTER`` batches;
    * ``texts/batch=k``: the texts above 256 bytes that batch k counted by digest, each once;
    * ``progress``: the stream's checkpoint. A batch that is run again replaces what its first try has written, so a lost
      executor, a stopped driver or a second run go on without counting anything twice.

    ``row_order`` names the column that orders rows (for the sample values); else rows count as they arrive.
    """

    spark: SparkSession
    place: str
    schema: T.StructType
    columns: tuple[str, ...]
    row_order: str | None = None

    @classmethod
    def of(cls, stream: DataFrame, place: str | None = None, columns: Sequence[str] | None = None, row_order: str | None = None) -> StreamProfile:
        place = place or session.scratch_path(stream.sparkSession, "stream-profile")
        return cls(stream.sparkSession, place, stream.schema, tuple(columns or stream.columns), row_order)

    @property
    def picked(self) -> ColumnSet:
        return ColumnSet(self.columns, tuple(self.schema[c].dataType for c in self.columns))

    def run(self, stream: DataFrame) -> StreamProfile:
        """Process everything that is there and not yet counted, in batches."""
        query = (
            stream.writeStream.foreachBatch(self._count).option("checkpointLocation", f"{self.place}/progress")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return self

    def _count(self, batch: DataFrame, number: int) -> None:
        order = self.row_order or "_row"
        if self.row_order is None:
            batch = batch.withColumn(order, F.struct(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row")))
        rows = session.spread(batch.select(*[text.quoted(c) for c in dict.fromkeys([order, *self.columns])]))
        count_cells(rows, self.picked, row_order=order).write.mode("overwrite").parquet(f"{self.place}/counts/batch={number}")
        texts = long_texts(rows, self.picked)
        if texts is not None:
            texts.groupBy("ordinal", "digest").agg(F.any_value("full").alias("full")).write.mode("overwrite").parquet(f"{self.place}/texts/batch={number}")
        if number % ADDED_UP_AFTER == ADDED_UP_AFTER - 1:
            self.counts(number).write.mode("overwrite").parquet(f"{self.place}/sums/upto={number}")

    def _parts(self, name: str) -> DataFrame | None:
        """A table of parts; None if none is written. Parts still being written do not show."""
        try:
            return self.spark.read.option("basePath", f"{self.place}/{name}").parquet(f"{self.place}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def counts(self, upto: int | None = None) -> DataFrame:
        """Counts of all batches (up to a number): the last sum before it, and the batches since."""
        parts, sums = self._parts("counts"), self._parts("sums")
        if parts is None:
            order = T.StructType().add("batch", "long").add("row", "long") if self.row_order is None else self.schema[self.row_order].dataType
            empty = self.spark.createDataFrame([], self.schema.add("_row", order) if self.row_order is None else self.schema)
            return count_cells(empty, self.picked, row_order=self.row_order or "_row")
        if upto is not None:
            parts = parts.where(F.col("batch") <= upto)
            sums = None if sums is None else sums.where(F.col("upto") < upto)
        last = None if sums is None else sums.agg(F.max("upto")).first()[0]
        if last is not None:
            parts = parts.where(F.col("batch") > last).drop("batch").unionByName(sums.where(F.col("upto") == last).drop("upto"))
        return add_counts(parts.drop("batch"))

    def frequency(self) -> FrequencyTable:
        counted = session.materialize(describe_values(self.counts(), self.picked), "frequency")
        texts = self._parts("texts")
        if texts is None:
            texts = self.spark.createDataFrame([], "ordinal int, digest string, full string")
        return FrequencyTable(counted, self.picked, texts=texts.select("ordinal", "digest", "full"))

    def profile(self, parts: Collection[str] = ALL_PARTS) -> DataFrame:
        """The profile of everything counted so far; also while the stream goes on."""
        return finished(self.frequency(), parts)


def frequency_stream(stream: DataFrame) -> DataFrame:
    """Running count of every value of every column. The state holds each distinct value once, whatever its length."""
    cells = _text_cells(stream).filter(~text.is_missing_text(F.col("cell")))
    return cells.groupBy("column", F.col("cell").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def duplicates_stream(stream: DataFrame) -> DataFrame:
    """Running count of every distinct row."""
    return row_digests(stream).groupBy("row_digest").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(running: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    """Process everything that is there, in batches, and return the final state as a table.

    A small state is written anew after each batch. With ``keys`` only the rows a batch
    changed are written, and the last state of each key is picked when the table is read,
    so a large state is never rewritten. Progress and state live in the shared folder: a
    lost executor or a restarted driver goes on from the last batch.
    """
    spark = running.sparkSession
    place = session.scratch_path(spark, label)
    result = f"{place}/result"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what its first try has written
        target = f"{result}/batch={number}" if keys else result
        batch.write.mode("overwrite").parquet(target)

    query = (
        running.writeStream.outputMode("update" if keys else "complete").foreachBatch(keep)
        .option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    try:
        if not keys:
            return spark.read.schema(running.schema).parquet(result)
        states = spark.read.schema(T.StructType([*running.schema, T.StructField("batch", T.IntegerType())])).option("basePath", result).parquet(result)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], running.schema)  # nothing has come
    rest = [c for c in running.columns if c not in keys]
    return states.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
