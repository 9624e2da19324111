"""Mixing sources to target weights by weighted fair queueing.

Every document is shuffled within its source (by a seeded hash of its id) and gets a virtual finish time:
words of its source up to and including it, divided by the source's target. A source that has to be
repeated goes round again, up to ``max_rounds`` times. All copies are ordered by finish time (range
partitioned over the cluster) and cut where the total budget is reached.

No source is ever ordered in one task: its documents are dealt to slices of the hash range, as many as the square root of
its rows, so that a task that sums up one slice, or the totals of all, sees no more than that root. DataFrame operations only.

Defined results: null text counts 0 words and is never taken; null sources are a source of their own,
ordered last; equal ids or wholly equal rows are separate documents; an empty table gives an empty result;
further columns are ignored (schedule) or kept (mix).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.common import pick

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(totals: DataFrame, weights: Sequence[float], max_rounds: int, budget: float) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``words``): budget by weight, at most ``max_rounds`` times the words.

    Sources by the room they have for their weight: the ones at the front are full, and the rest share what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_room), F.lit(0.0))
    ranked = (
        totals.withColumn("weight", weight)
        .withColumn("most", F.col("words").cast("double") * max_rounds)
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("full_before", before("most"))
        .withColumn("weight_left", F.sum("weight").over(Window.partitionBy()) - before("weight"))
        .withColumn("full", F.col("most") * F.col("weight_left") <= F.col("weight") * (F.lit(float(budget)) - F.col("full_before")))
    )
    everyone = Window.partitionBy()
    left = F.lit(float(budget)) - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everyone), F.lit(0.0))
    weight_left = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    return ranked.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(left * F.col("weight") / weight_left)).select(
        "source", F.col("words").alias("source_words"), "rows", "target")


def schedule(
    docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_rounds: int = 3, budget: int | None = None, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per document: ``doc``, ``source``, ``size``, ``source_words``, ``target``, and ``finishes``, the virtual finish time of each copy taken.

    ``key`` is a hash of the whole row's id, source and text. The budget is all words unless it is given.
    """
    sized = session.materialize(pick(docs, doc=id_col, text=text_col, source=source_col).select(
        "doc", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64("doc", "source", "text").alias("key"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc").cast("string"), F.lit("")))), 1, 12), 16, 10)
         .cast("double") / float(1 << 48)).alias("place"),
    ), "sized")
    totals = session.materialize(sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "totals")
    words = totals.agg(F.sum("words")).first()[0] or 0
    budget = words if budget is None else budget
    sources = session.materialize(shares(totals, weights, max_rounds, budget), "shares")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    facts = sources.withColumnRenamed("source", "of")
    sliced = sized.join(facts, sized["source"].eqNullSafe(facts["of"])).drop("of").withColumn(
        "slice", F.floor(F.col("place") * F.ceil(F.sqrt("rows"))))
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    offsets = sums.select("source", "slice", (F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice")) - F.col("in_slice")).alias("before"))
    offsets = session.materialize(offsets, "offsets").withColumnRenamed("slice", "at")
    within = Window.partitionBy("source", "slice").orderBy("place", "doc", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    queued = sliced.join(offsets, same(sliced, offsets) & (sliced["slice"] == offsets["at"])).drop(offsets["source"]).withColumn(
        "reached", F.col("before") + F.sum("size").over(within))
    finish = lambda n: (n * F.col("source_words") + F.col("reached")) / F.col("target")
    queued = session.materialize(queued.select(
        "doc", "source", "size", "key", "place", "source_words", "target",
        F.when((F.col("size") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.lit(max_rounds - 1)), finish)).alias("finishes"),
    ), "queued")
    last = _last_taken(queued, budget)
    if last is None:
        taken = F.expr("cast(array() as array<double>)")
    else:
        names = ("a", "b", "c", "d")
        cut = (F.lit(last["source"] or ""), F.lit(last["source"] is None), F.lit(last["place"]), F.lit(last["size"]).cast("long"))
        own = (F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), F.col("place"), F.col("size"))
        tie = F.struct(*(c.alias(n) for c, n in zip(own, names))) <= F.struct(*(c.alias(n) for c, n in zip(cut, names)))
        taken = F.filter("finishes", lambda f: (f < last["finish"]) | ((f == last["finish"]) & tie))
    return queued.withColumn("finishes", F.coalesce(taken, F.expr("cast(array() as array<double>)"))).drop("place")


def _last_taken(queued: DataFrame, budget: float):
    """The last copy, in order of finish time, with which the words taken stay within the budget.

    Words are counted by bin of finish time; copies are put in order within the one bin where the budget ends.
    """
    copies = queued.where(F.col("finishes").isNotNull()).select("source", "place", "size", F.explode("finishes").alias("finish"))
    bins = max(1, isqrt(queued.count()))
    copies = copies.withColumn("bin", F.floor(F.col("finish") * bins))
    counted = session.materialize(copies.groupBy("bin").agg(F.sum("size").alias("words")), "bins")
    running = counted.select("bin", F.sum("words").over(Window.orderBy("bin")).alias("upto"), "words")
    over = running.where(F.col("upto") > budget).orderBy("bin").first()
    order = [F.col("finish"), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), F.col("place"), F.col("size")]
    if over is not None:
        inside = copies.where(F.col("bin") == over["bin"]).withColumn(
            "upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(over["upto"] - over["words"]))
        last = inside.where(F.col("upto") <= budget).orderBy(*(c.desc() for c in order)).first()
        if last is not None:
            return last
        copies = copies.where(F.col("bin") < over["bin"])
    return copies.orderBy(*(c.desc() for c in order)).first()


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture: rows of ``docs``, each as often as it is taken, in order of virtual finish time."""
    plan = schedule(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = plan.groupBy(F.col("key").alias("of")).agg(
        F.flatten(F.collect_list("finishes")).alias("finishes"), F.count(F.lit(1)).alias("rows")).where(F.size("finishes") > 0)
    # the caller's row travels as one struct, so that its names cannot meet those used here
    keyed = docs.select(F.struct(*(docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row"), docs[id_col].alias("id"),
                        F.xxhash64(docs[id_col], docs[source_col], docs[text_col]).alias("key"))
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    # wholly equal rows share the copies out among themselves
    own = F.filter("finishes", lambda f, i: i % F.col("rows") == F.col("nth") - 1)
    mixed = keyed.join(copies, F.col("key") == F.col("of")).select("row", "key", F.explode(own).alias("finish"))
    return mixed.orderBy("finish", "key").select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))
