"""Per-column statistics from a frequency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions import text
from plumbline.functions.numeric import share
from plumbline.functions.text import finite
from plumbline.operators.frequency import LEAD, FrequencyTable, long_texts, text_of

# Limits of the number of histogram bins, and of the plain histogram.
MIN_BINS, MAX_BINS, PLAIN_BINS = 5, 50, 10
# Reported quantiles.
QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
# Lengths of the reported lists.
TOP_VALUES, SAMPLE_VALUES = 10, 5

#: Slices each histogram bin is divided into when looking for quantiles.
SLICES = 64
#: Slices a span is divided into when it is still too full to be put in order.
FINE_SLICES = 1024
#: Distinct values one task may put in order.
ORDERED_ROWS = 1_000_000


def inferred_type() -> Column:
    """Type of a column from its counters."""
    valid = F.col("total_valid")
    return (
        F.when(valid == 0, "Null")
        .when(F.col("integer_count") == valid, "Integer")
        .when(F.col("numeric_count") == valid, "Numeric")
        .when(F.col("boolean_count") == valid, "Boolean")
        .when(F.col("date_count") == valid, "Date")
        .otherwise("String")
    )


def base_stats(ft: FrequencyTable) -> DataFrame:
    """One row per column: counts, type counters, inferred type, lengths and number bounds; distinct values where they are counted."""
    n, valid = F.col("n"), ~F.col("missing")

    def counted(flag: Column) -> Column:
        return F.sum(F.when(flag, n).otherwise(F.lit(0))).cast("bigint")

    has_num = F.col("num").isNotNull()
    return (
        ft.df.groupBy(*ft.labelled)
        .agg(
            F.sum(n).alias("count"),
            counted(F.col("missing")).alias("missing"),
            (F.count(F.when(valid, 1)) if ft.counted else F.first(F.lit(None).cast("bigint"))).alias("distinct"),
            counted(valid).alias("total_valid"),
            counted(valid & F.col("is_integer")).alias("integer_count"),
            counted(valid & F.col("is_numeric")).alias("numeric_count"),
            counted(valid & F.col("is_boolean")).alias("boolean_count"),
            counted(valid & F.col("is_date")).alias("date_count"),
            F.min(F.when(valid, F.col("bytes"))).alias("min_length"),
            F.max(F.when(valid, F.col("bytes"))).alias("max_length"),
            counted(has_num).alias("num_count"),
            F.min("num").alias("min"),
            F.max("num").alias("max"),
            F.sum(F.col("num") * n).alias("sum"),
        )
        .withColumn("mean", F.when(F.col("num_count") > 0, F.col("sum") / F.col("num_count")))
        .withColumn("inferred_type", inferred_type())
        .withColumn(
            "notes",
            F.when(
                (F.col("inferred_type") == "String")
                & (share(F.col("numeric_count"), F.col("total_valid"), 0.0) > 0.5),
                F.array(F.lit("Potentially numeric with exceptions")),
            ).otherwise(F.array().cast("array<string>")),
        )
        .withColumn("unique_count", F.col("distinct").cast("bigint"))
    )


def bin_count(n: Column) -> Column:
    """Number of equal-width bins for ``n`` values."""
    wanted = F.ceil(F.log2(n.cast("double")) + 1)
    return F.least(F.greatest(wanted, F.lit(MIN_BINS)), F.lit(MAX_BINS)).cast("int")


def slices(ft: FrequencyTable, base: DataFrame, fixed_bins: int | None = None) -> DataFrame:
    """Numbers grouped into thin equal-width slices, each with its share of the moments.

    At most ``MAX_BINS * SLICES`` rows per column; moments, histogram and the first
    step of the quantile search all come from this one pass.
    """
    facts = base.filter(F.col("num_count") > 0).select(
        *ft.keys, "min", "max", "mean", "num_count",
        (F.lit(fixed_bins) if fixed_bins else bin_count(F.col("num_count"))).alias("bins"),
    ).withColumn("width", (F.col("max") - F.col("min")) / F.col("bins"))
    x = F.col("num")
    rows = ft.with_facts(facts).filter(x.isNotNull())
    place = F.when(F.col("width") > 0, (x - F.col("min")) / F.col("width")).otherwise(F.lit(0.0))
    bin_ = F.least(F.floor(place).cast("int"), F.col("bins") - 1)
    part = F.least(F.floor((place - F.col("bin")) * SLICES).cast("int"), F.lit(SLICES - 1))
    off = x - F.col("mean")
    moment = {k: F.sum(F.pow(off, k) * F.col("n")).alias(f"m{k}") for k in (2, 3, 4)}
    return (
        rows.withColumn("place", place)
        .withColumn("bin", bin_)
        .withColumn("slice", F.col("bin") * SLICES + part)
        .groupBy(*ft.labelled, "bins", "width", F.col("min").alias("low"), F.col("max").alias("high"),
                 "num_count", "bin", "slice")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"),
             F.min("num").alias("first"), F.max("num").alias("last"), *moment.values())
    )


def moments(ft: FrequencyTable, base: DataFrame, sliced: DataFrame | None = None) -> DataFrame:
    """min, max, mean, sum, count, sample spread and shape of the finite numbers of each column."""
    sliced = slices(ft, base) if sliced is None else sliced
    central = sliced.groupBy(*ft.keys).agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in (2, 3, 4)])
    n = F.col("num_count").cast("double")
    spread = F.col("max") > F.col("min")
    variance = F.when(spread & (n > 1), F.col("m2") / (n - 1)).otherwise(F.lit(0.0))
    return (
        base.filter(F.col("num_count") > 0)
        .join(session.bounded(central, ft.max_profiles), ft.keys)
        .select(
            *ft.labelled, "min", "max", "mean", "sum", F.col("num_count").alias("num_count"),
            variance.alias("variance"),
            F.sqrt(variance).alias("std_dev"),
            F.when(spread, F.sqrt(n) * F.col("m3") / F.pow("m2", F.lit(1.5))).otherwise(0.0).alias("skewness"),
            F.when(spread, n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3).otherwise(0.0).alias("kurtosis"),
            F.when(spread, F.col("m2") / n).otherwise(0.0).alias("variance_pop"),
            F.sqrt(F.when(spread, F.col("m2") / n).otherwise(0.0)).alias("std_dev_pop"),
        )
    )


def histogram(ft: FrequencyTable, base: DataFrame, sliced: DataFrame | None = None,
              fixed_bins: int | None = None) -> DataFrame:
    """One row per bin, empty bins included; none for a column without spread.

    With ``fixed_bins`` a column without spread gets bins of width one.
    """
    sliced = slices(ft, base, fixed_bins) if sliced is None else sliced
    filled = sliced.groupBy(*ft.keys, "bin").agg(F.sum("n").alias("n"))
    frame = base.filter(F.col("num_count") > 0)
    if fixed_bins:
        width = F.when(F.col("max") > F.col("min"), (F.col("max") - F.col("min")) / fixed_bins).otherwise(1.0)
        bins = F.lit(fixed_bins)
    else:
        frame = frame.filter(F.col("max") > F.col("min"))
        bins = bin_count(F.col("num_count"))
        width = (F.col("max") - F.col("min")) / bins
    frame = frame.select(
        *ft.labelled, "min", width.alias("bin_width"), F.explode(F.sequence(F.lit(0), bins - 1)).alias("bin")
    )
    return frame.join(filled, [*ft.keys, "bin"], "left").select(
        *ft.labelled, "bin",
        (F.col("min") + F.col("bin") * F.col("bin_width")).alias("start"),
        (F.col("min") + (F.col("bin") + 1) * F.col("bin_width")).alias("end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "bin_width",
    )


def _ranks(ft: FrequencyTable, sliced: DataFrame) -> DataFrame:
    """0-based ranks of the two values each quantile lies between."""
    asked = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(q).alias("q")) for k, q in QUANTILES.items()])
    spot = F.col("asked.q") * (F.col("num_count") - 1)
    low = F.floor(spot)
    return (
        sliced.select(*ft.labelled, "num_count").distinct()
        .withColumn("asked", F.explode(asked))
        .select(
            *ft.labelled, F.col("asked.name").alias("quantile"), (spot - low).alias("part"),
            F.explode(F.array(
                F.struct(F.lit(0).alias("side"), low.alias("rank")),
                F.struct(F.lit(1).alias("side"), F.ceil(spot).alias("rank")),
            )).alias("at"),
        )
        .select(*ft.labelled, "quantile", "part", "at.side", "at.rank", F.lit(0).cast("bigint").alias("below"))
    )


def _locate(ranked: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Narrow each wanted rank to the slice holding it.

    ``below`` becomes the number of values under the slice, ``held`` the rows in it.
    """
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("first"))
    bounds = ranked.select(*keys, "first", "last", "held", "n", (upto - F.col("n")).alias("before"))
    local = F.col("rank") - F.col("below")
    return (
        bounds.join(wanted, keys)
        .filter((local >= F.col("before")) & (local < F.col("before") + F.col("n")))
        .withColumn("below", F.col("below") + F.col("before"))
        .withColumnsRenamed({"first": "low", "last": "high"})
        .drop("n", "before")
    )


def _inside(ft: FrequencyTable, spans: DataFrame, per_profile: int) -> DataFrame:
    """The numbers within the spans still being looked at."""
    hit = spans.select(*ft.keys, "low", "high").distinct()
    return ft.with_facts(hit, per_profile).filter(
        (F.col("num") >= F.col("low")) & (F.col("num") <= F.col("high"))
    )


def _narrow(ft: FrequencyTable, spans: DataFrame, per_profile: int, logarithmic: bool) -> DataFrame:
    """Divide each span again and keep only the part holding its rank."""
    def scaled(c: str) -> Column:
        return F.signum(c) * F.log1p(F.abs(c)) if logarithmic else F.col(c)

    place = (scaled("num") - scaled("low")) / (scaled("high") - scaled("low")) * (FINE_SLICES - 1)
    fine = F.when(scaled("high") > scaled("low"), F.floor(place)).otherwise(F.lit(0)).cast("int")
    inside = (
        _inside(ft, spans, per_profile)
        .withColumn("fine", fine)
        .groupBy(*ft.keys, "low", "fine")
        .agg(F.sum("n").alias("n"), F.min("num").alias("first"), F.max("num").alias("last"),
             F.count(F.lit(1)).alias("held"))
        .withColumnRenamed("low", "span")
    )
    wanted = spans.drop("high", "held").withColumnRenamed("low", "span")
    return _locate(inside, session.bounded(wanted, ft.max_profiles * per_profile), [*ft.keys, "span"]).drop("span")


def quantiles(ft: FrequencyTable, base: DataFrame, sliced: DataFrame | None = None) -> DataFrame:
    """Exact quantiles, linear between neighbours, without sorting a whole column anywhere.

    Slice counts tell which slice holds each wanted rank. While such a slice still
    holds more than ``ORDERED_ROWS`` distinct values it is divided again, on a linear
    and a logarithmic scale in turn, so long tails and tight clusters both come apart.
    Only the last, small slices are put in order.
    """
    sliced = session.materialize(slices(ft, base), "slices") if sliced is None else sliced
    keys = ft.keys
    per_profile = len(QUANTILES) * 2
    most = ft.max_profiles * per_profile
    spans = _locate(sliced, session.bounded(_ranks(ft, sliced), most), keys)
    logarithmic = True
    while (spans.agg(F.max(F.when(F.col("high") > F.col("low"), F.col("held")))).head()[0] or 0) > ORDERED_ROWS:
        spans = session.materialize(_narrow(ft, spans, per_profile, logarithmic), "spans")
        logarithmic = not logarithmic
    # equal numbers may have different texts in a text column: one row per number
    numbers = _inside(ft, spans, per_profile).groupBy(*keys, "low", "num").agg(F.sum("n").alias("n"))
    till = F.sum("n").over(Window.partitionBy(*keys, "low").orderBy("num"))
    sought = session.bounded(spans.withColumn("local", F.col("rank") - F.col("below")), most)
    found = numbers.withColumn("till", till).join(sought, [*keys, "low"]).filter(
        (F.col("local") < F.col("till")) & (F.col("local") >= F.col("till") - F.col("n"))
    )
    lower = F.max(F.when(F.col("side") == 0, F.col("num")))
    upper = F.max(F.when(F.col("side") == 1, F.col("num")))
    return found.groupBy(*ft.labelled, "quantile").agg(
        (lower + (upper - lower) * F.max("part")).alias("value")
    )


def quantiles_wide(ft: FrequencyTable, base: DataFrame, sliced: DataFrame | None = None) -> DataFrame:
    tall = quantiles(ft, base, sliced)
    return tall.groupBy(*ft.labelled).agg(
        *[F.max(F.when(F.col("quantile") == k, F.col("value"))).alias(k) for k in QUANTILES]
    )


def quantiles_estimate(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """Estimated quantiles straight from the rows, for callers that ask for speed over exactness."""
    stacked = [F.lit(len(columns))]
    for c in columns:
        stacked += [F.lit(c), finite(df[text.quoted(c)].cast("double"))]
    tall = df.select(F.stack(*stacked).alias("column", "num"))
    asked = [float(q) for q in QUANTILES.values()]
    out = tall.groupBy("column").agg(F.percentile_approx("num", asked, accuracy).alias("q"))
    return out.select("column", *[F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)])


def top_values(ft: FrequencyTable, base: DataFrame, source: DataFrame | None = None,
               size: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of each column, ties by value, with their share of the valid cells.

    Ranking runs as a per-task limit before the shuffle, and keeps at most ``size`` short and ``size`` long values of a column,
    however many are equally frequent. Short values are ranked as they stand. Long ones are known by digest; those
    that are certain to be listed, or that win a tie as whole texts, get their text back.
    """
    labels = [*ft.labelled, "value", "digest", "n"]
    short = Window.partitionBy(*ft.keys).orderBy(F.desc("n"), "value")
    best = ft.valid.filter(F.col("digest").isNull()).select(*labels).withColumn("near", F.row_number().over(short)).filter(F.col("near") <= size)
    if ft.columns.of_kind("text", "container"):
        best = best.drop("near").unionByName(_top_long(ft, source, size))
    order = Window.partitionBy(*ft.keys).orderBy(F.desc("n"), "value")
    best = best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= size)
    valid = session.bounded(base.select(*ft.keys, "total_valid"), ft.max_profiles)
    return best.join(valid, ft.keys).select(
        *ft.labelled, "position", "value", F.col("n"),
        (F.col("n") / F.col("total_valid") * 100).alias("percentage"),
    )


def _top_long(ft: FrequencyTable, source: DataFrame | None, size: int) -> DataFrame:
    """The ``size`` most frequent long values of each column, ties by text, with their texts.

    Where the last place is a tie, the texts decide that the digests do not show: the ``size`` least texts of that
    count are found by a limit inside each task, among the texts alone.
    """
    labels = [*ft.labelled, "value", "digest", "n"]
    by_count = Window.partitionBy(*ft.keys).orderBy(F.desc("n"), "digest")
    first = ft.valid.filter(F.col("digest").isNotNull()).select(*labels).withColumn("near", F.row_number().over(by_count)).filter(F.col("near") <= size + 1)
    first = session.materialize(first, "long-values")
    # the count at which a column's list ends, where one more value has it
    edge = first.groupBy(*ft.keys).agg(
        F.max(F.when(F.col("near") == size, F.col("n"))).alias("edge"), F.max(F.when(F.col("near") == size + 1, F.col("n"))).alias("beyond"))
    edge = session.materialize(edge.where("edge = beyond").drop("beyond"), "edges")
    if not edge.head(1):
        return restore_long_texts(ft, first.filter(F.col("near") <= size), source, size).select(*labels)
    tied = session.attach(ft.valid.filter(F.col("digest").isNotNull()).select(*labels), edge, ft.keys, ft.max_profiles, ["digest"]).where("n = edge").drop("edge")
    # those that begin late are out already; of the others every text once, and of them the least of each column
    early = Window.partitionBy(*ft.keys).orderBy(F.substring("digest", 1, LEAD))
    tied = tied.withColumn("near", F.rank().over(early)).filter(F.col("near") <= size).drop("near")
    texts = ft.texts if ft.texts is not None else long_texts(ft.source if source is None else source, ft.columns)
    wanted = tied.select("ordinal", "digest").distinct()
    texts = texts.join(wanted, ["ordinal", "digest"], "left_semi").groupBy("ordinal", "digest").agg(F.any_value("full").alias("full"))
    whole = tied.join(texts, ["ordinal", "digest"]).withColumn("value", F.col("full")).select(*labels)
    by_text = Window.partitionBy(*ft.keys).orderBy("value")
    least = whole.withColumn("near", F.row_number().over(by_text)).filter(F.col("near") <= size).select(*labels)
    above = session.attach(first.filter(F.col("near") <= size).drop("near"), edge, ft.keys, ft.max_profiles, ["digest"], "left").where("edge is null or n > edge").drop("edge")
    return restore_long_texts(ft, above, source, size).select(*labels).unionByName(least)


def restore_long_texts(ft: FrequencyTable, best: DataFrame, source: DataFrame | None, size: int) -> DataFrame:
    """Give the few chosen values that travelled as digests (at most ``size`` for each column) their texts back."""
    found = ft.texts
    if found is None:
        found = long_texts(ft.source if source is None else source, ft.columns)
    if found is None:
        return best
    sought = best.filter(F.col("digest").isNotNull()).select("ordinal", "digest").distinct()
    full = (
        session.attach(found, sought, ["ordinal", "digest"], ft.max_profiles * size, spread=["digest"])
        .groupBy("ordinal", "digest").agg(F.any_value("full").alias("full"))
    )
    return best.join(full, ["ordinal", "digest"], "left").withColumn("value", F.coalesce("value", "full")).drop("full")


def sample_values(ft: FrequencyTable, source: DataFrame | None = None, size: int = SAMPLE_VALUES) -> DataFrame:
    """The first distinct values of each column in row order."""
    order = Window.partitionBy(*ft.keys).orderBy("first_row", F.coalesce("value", "digest"))
    first = (
        ft.valid.select(*ft.labelled, "value", "digest", "first_row")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= size)
    )
    return restore_long_texts(ft, first, source, size).select(
        *ft.labelled, "position", F.coalesce("value", "digest").alias("value")
    )


def value_sample(df: DataFrame, columns: list[str], key: str, size: int = 1000, seed: int = 0) -> DataFrame:
    """A repeatable sample of the finite numbers of each column: the ``size`` smallest hashes of the row key."""
    stacked = [F.lit(len(columns))]
    for c in columns:
        stacked += [F.lit(c), df[text.quoted(c)].cast("double")]
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    order = Window.partitionBy("column").orderBy("rank", key)
    return (
        df.select(key, rank.alias("rank"), F.stack(*stacked).alias("column", "num"))
        .filter(finite(F.col("num")).isNotNull())
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= size)
        .select("column", key, "num")
    )


def distinct_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values of each column as they stand, without text rules."""
    stacked = [F.lit(len(columns))]
    for c in columns:
        stacked += [F.lit(c), df[text.quoted(c)].cast("string")]
    tall = df.select(F.stack(*stacked).alias("column", "value"))
    return tall.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(
        F.count("value").alias("distinct")
    )


def distinct_estimate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Estimated distinct valid values, in one pass and without a shuffle of values (sketch of 2^12 registers)."""
    stacked = [F.lit(len(columns))]
    for c in columns:
        stacked += [F.lit(c), text.clean(text_of(df[text.quoted(c)], df.schema[c].dataType))]
    cells = df.select(F.stack(*stacked).alias("column", "cell")).filter(~text.is_missing_text(F.col("cell")))
    return cells.groupBy("column").agg(F.approx_count_distinct("cell", 0.016).alias("distinct"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row: one summary row.

    Rows are told apart by a 128-bit digest of all their cells, each cell preceded by its
    length so that no two different rows read the same. Copies meet in partial
    aggregation, so a row repeated billions of times is one record per task.
    """
    return duplicate_summary(row_digests(df, columns).groupBy("row_digest").agg(F.count(F.lit(1)).alias("n")))


def row_digests(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    pieces = []
    for c in columns or df.columns:
        cell = text_of(df[text.quoted(c)], df.schema[c].dataType)
        pieces.append(F.coalesce(F.concat(F.octet_length(cell).cast("string"), F.lit(":"), cell), F.lit("~")))
    return df.select(F.unhex(F.md5(F.concat(*pieces))).alias("row_digest"))


def duplicate_summary(groups: DataFrame) -> DataFrame:
    out = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return out.withColumn(
        "duplicate_pct", share(F.col("duplicate_rows"), F.col("total_rows"), 0.0) * 100
    )
