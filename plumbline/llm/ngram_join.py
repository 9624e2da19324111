"""Similarity self-join of documents on word n-grams: rare-first prefix filtering, exact Jaccard.

A document is the set of its distinct n-grams, as 64-bit hashes. Documents with equal sets are one node. Two
nodes link when 100 * intersection >= percent * union.

*Prefix filter.* N-grams have one global order: those that are not frequent first, the frequent ones behind, by hash
within each. Linked nodes share one of their first n - ceil(t n) + 1 n-grams in that order. Each node emits
its first n-grams by hash, with ``MARGIN`` of its size to spare; one shuffle by n-gram counts them, and every frequent
one is replaced by the next rare one in the margin. Nodes whose margin runs out, because much of them is frequent, are
compared among themselves by their whole sets, in exact order of frequency there; for the comparison with the other nodes their
prefixes are completed from the whole sets, and the others' entries of those n-grams are looked up. So no link is lost. An n-gram that ``CROWDED`` nodes of one block
hold is known to be frequent there and then: it is not sent to one place to be counted.

*Pairs.* An n-gram held by many nodes does not give all pairs. First every node of a list is compared with two leaders
of the list; what links is one component from then on. Only then pairs are listed, and only between different components.
A pair is dropped by length, by position (what can still overlap behind the first common prefix n-gram) and by suffix
(histograms over hash ranges bound the overlap), and is verified once on the whole sets.

Defined results: null, empty and blank texts have no n-grams and link with nothing; fewer words than n are one n-gram;
rows with equal texts are linked, also with equal ids; a component's id is its smallest non-null document id; an empty
table gives an empty result; further columns are ignored (link) or kept (keep_one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.llm.common import blocks, map_blocks

FREQUENT = 64
MARGIN = 0.1
CROWDED = 16
BINS = 128


def _mixed(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, from the hashes of the words."""
    count = max(0, len(words) - width + 1)
    mixed = np.full(count, width, np.uint64)
    for k in range(width):
        mixed ^= words[k:k + count]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text of a block; a distinct word of the block is hashed once.

    Arrow's ASCII functions change only A-Z and cut at exactly the white space that the contract names.
    """
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string() if wide else pa.string())))
    words = split.flatten().dictionary_encode()
    known = words.dictionary.view(pa.large_binary() if wide else pa.binary())
    # one joined value that Python cuts again: much faster than a Python object made of each Arrow value
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(known)], known), pa.scalar(b" ", known.type))[0].as_py()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, joined.split(b" ") if len(known) else ()), np.uint64, len(known))
    codes = words.indices.to_numpy(zero_copy_only=False)
    # white space at either end of a text leaves an empty word there
    full = codes != pc.index(known, pa.scalar(b"", known.type)).as_py()
    lengths = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(full)))[np.concatenate(([0], np.cumsum(lengths)))]
    hashed = hashes[codes[full]]
    mixed = _mixed(hashed, n)
    return [_distinct(mixed[a:b - n + 1] if b - a >= n else _mixed(hashed[a:b], b - a) if b > a else mixed[:0])
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _distinct(values: np.ndarray) -> np.ndarray:
    """``np.unique``, which takes five times as long for a text's hashes."""
    ordered = np.sort(values)
    return ordered[np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))]


def prefix_length(n: int | np.ndarray, percent: int):
    """n-grams of which linked documents share at least one: n - ceil(percent * n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, sets), np.uint64, len(sets)).view(np.int64)


def _block_entries(sets: list[np.ndarray], nodes: np.ndarray, percent: int):
    """Prefix entries of one block: ``gram``, ``node``, ``place`` (size and rank in one number), which are crowded, and the crowded grams."""
    own = {}
    for node, some in zip(nodes.tolist(), sets):
        if len(some) and node not in own:
            own[node] = len(some), some[:prefix_length(len(some), percent) + int(len(some) * MARGIN)].view(np.int64)
    lengths = np.array([len(g) for _, g in own.values()], np.int64)
    grams = np.concatenate([np.zeros(0, np.int64), *(g for _, g in own.values())])
    holders = np.repeat(np.fromiter(own, np.int64, len(own)), lengths)
    ranks = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    places = np.repeat(np.array([size for size, _ in own.values()], np.int64), lengths) << 32 | ranks
    ordered = np.sort(grams)
    told = _distinct(ordered[CROWDED - 1:][ordered[CROWDED - 1:] == ordered[:len(ordered) - CROWDED + 1]]) if len(ordered) >= CROWDED else ordered[:0]
    return grams, holders, places, _among(grams, told), told


def _among(grams: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which ``grams`` are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(grams), bool)
    return ordered[np.minimum(np.searchsorted(ordered, grams), len(ordered) - 1)] == grams


def _lists_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), kind))


def _bins(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set: how many of its hashes are in each of ``BINS`` equal ranges."""
    where = np.concatenate([np.zeros(0, np.uint64), *sets]) // np.uint64((1 << 64) // BINS)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return np.bincount(rows * BINS + where.astype(np.int64), minlength=len(sets) * BINS).reshape(len(sets), BINS)


def _scan(rows: DataFrame, percent: int, n: int) -> DataFrame:
    """Per row ``doc, node, size, bins`` (the n-grams counted by hash range); and ``gram, node, place`` of the crowded entries."""
    schema = T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType), T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()),
        T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("gram", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            sets = shingles(block.column(1), n)
            nodes = _nodes(sets)
            sizes = np.array([len(s) for s in sets], np.int32)
            yield pa.record_batch({
                "doc": block.column(0), "node": pa.array(nodes, mask=sizes == 0),
                "size": pa.array(sizes), "bins": _lists_of(list(_bins(sets)), pa.int32()),
                "gram": pa.nulls(len(sets), pa.int64()), "place": pa.nulls(len(sets), pa.int64())})
            grams, holders, places, crowded, _ = _block_entries(sets, nodes, percent)
            count = int(crowded.sum())
            yield pa.record_batch({
                "doc": pa.nulls(count, block.column(0).type), "node": pa.array(holders[crowded]), "size": pa.nulls(count, pa.int32()),
                "bins": pa.nulls(count, pa.list_(pa.int32())), "gram": pa.array(grams[crowded]), "place": pa.array(places[crowded])})

    return map_blocks(rows, run, schema)


def _entries(rows: DataFrame, percent: int, n: int, all_of: bool = False, wanted=None) -> DataFrame:
    """``gram, node, place`` of the entries that are not crowded; and one entry without a node for each crowded gram of each block.

    With ``all_of`` crowded entries are among them and nothing else; ``wanted`` is a broadcast sorted array of the grams to keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            sets = shingles(block.column(1), n)
            grams, nodes, places, crowded, told = _block_entries(sets, _nodes(sets), percent)
            kept = np.ones(len(grams), bool) if all_of else ~crowded
            if wanted is not None:
                kept &= _among(grams, wanted.value)
            yield pa.record_batch({"gram": pa.array(grams[kept]), "node": pa.array(nodes[kept]), "place": pa.array(places[kept])})
            if all_of:
                continue
            yield pa.record_batch({"gram": pa.array(told), "node": pa.nulls(len(told), pa.int64()), "place": pa.nulls(len(told), pa.int64())})

    return map_blocks(rows, run, "gram long, node long, place long")


def _sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, grams`` (all of them) for the nodes in ``wanted`` (``node``, ``doc``).

    The texts stay where they are while the list of wanted rows is small enough to be sent around; beyond that they are joined.
    """
    wanted = session.materialize(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 0):
            sets = shingles(block.column(0), n)
            same = (_nodes(sets) == block.column(1).to_numpy(zero_copy_only=False)) & np.array([len(s) > 0 for s in sets], bool)
            yield pa.record_batch({
                "node": block.column(1).filter(pa.array(same)),
                "grams": _lists_of([s.view(np.int64) for s, ok in zip(sets, same) if ok], pa.int64()),
            })

    few = session.bounded(wanted.withColumnRenamed("doc", "of"), wanted.count())
    texts = rows.join(few, rows["doc"] == F.col("of")).select("text", "node")
    return session.materialize(map_blocks(texts, run, "node long, grams array<bigint>"), "sets").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` for distinct pairs of nodes, from their whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", (100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).alias("linked"))


def _prune(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: nodes whose histograms over hash ranges differ too much cannot overlap enough."""
    left = facts.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("bins").alias("bins_a"))
    right = facts.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("bins").alias("bins_b"))
    common = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return pairs.join(left, "a").join(right, "b").where(
        100 * common >= percent * (F.col("size_a") + F.col("size_b") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``); root is the smallest node of the component.

    Alternating star contractions: every node hands its larger, then its smaller neighbours on to its smallest one, until
    all that is left are stars. Each step is a partial aggregation and a join; no component is ever collected.
    """
    def least_first(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def done(e: DataFrame) -> bool:
        """All that is left are stars: no node hangs on two others, or on one and has nodes that hang on it."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        held = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return held.where("up > 1 or up = 1 and down = 1").isEmpty()

    stars = session.materialize(least_first(edges), "stars")
    while not done(stars):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
        large = both.join(small, both["a"] == small["at"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # nodes that are their own smallest keep their direct edges through the same rule
        large = session.materialize(least_first(large), "stars")
        small = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "at")
        handed = large.join(small, large["a"] == small["at"])
        stars = session.materialize(least_first(
            handed.select(F.col("b").alias("a"), F.col("m").alias("b")).union(handed.select("a", F.col("m").alias("b")))), "stars")
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


RARE, ADDED, WHOLE = 0, 1, 2


def _need(size: Column, percent: int) -> Column:
    return size - F.ceil(size * percent / 100) + 1


def _lists(rows: DataFrame, crowded: DataFrame, percent: int, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prefix entries of rare grams that several nodes hold; what each node has to skip; the frequent grams (``gram``).

    Entries: ``gram, kind, node, size, at, lead`` (its margin ran out), with two leaders of each list (``first``, ``last``).
    Skipped: ``of`` (node), ``skipped`` ranks, ``exhausted``.
    """
    entries = _entries(rows, percent, n)
    by_gram = Window.partitionBy("gram")
    ticket = F.when(F.col("node").isNotNull(), F.struct(F.xxhash64("node").alias("ticket"), F.col("node").alias("node")))
    counted = entries.select(
        "gram", "node", "place", (F.count(F.lit(1)).over(by_gram) > FREQUENT).alias("many"), F.max(F.col("node").isNull()).over(by_gram).alias("told"),
        F.min(ticket).over(by_gram).alias("first"), F.max(ticket).over(by_gram).alias("last"))
    few = counted.where("node is not null and (told or first.node <> last.node)").select(
        "gram", "node", "place", (F.col("many") | F.col("told")).alias("frequent"), F.col("first.node").alias("first"), F.col("last.node").alias("last"))
    nobody = F.lit(None).cast("long")
    crowded = crowded.select("gram", "node", "place", F.lit(True).alias("frequent"), nobody.alias("first"), nobody.alias("last"))
    lists = session.materialize(few.union(crowded), "lists")

    size, rank = F.shiftright("place", 32), F.col("place").bitwiseAND(0xFFFFFFFF)
    skipped = lists.where("frequent").groupBy(F.col("node").alias("of")).agg(F.sort_array(F.collect_set(rank)).alias("skipped"), F.max(size).alias("own"))
    skipped = session.materialize(skipped.select("of", "skipped", (F.floor(F.col("own") * MARGIN) < F.size("skipped")).alias("exhausted")), "skipped")
    marked = lists.join(skipped, F.col("node") == F.col("of"), "left").select(
        "gram", "node", size.alias("size"), rank.alias("rank"), "frequent", "first", "last", F.coalesce("exhausted", F.lit(False)).alias("lead"),
        (rank - F.coalesce(F.size(F.filter("skipped", lambda r: r < F.col("place").bitwiseAND(0xFFFFFFFF))), F.lit(0))).alias("at"))
    marked = session.materialize(marked, "marked")
    rare = marked.where(~F.col("frequent") & (F.col("at") < _need(F.col("size"), percent)))
    kept = rare.select("gram", F.lit(RARE).alias("kind"), "node", "size", "at", "lead", "first", "last").distinct()
    return kept, skipped, lists.where("frequent").select("gram").distinct()


def _added_lists(rows: DataFrame, sets: DataFrame, skipped: DataFrame, frequent: DataFrame, percent: int, n: int) -> DataFrame:
    """The rest of the prefixes of nodes whose margin ran out (``lead``), with the entries other nodes have for the same grams."""
    size = F.size("grams")
    emitted = _need(size, percent) + F.floor(size * MARGIN)
    grams = sets.select("node", size.alias("size"), emitted.alias("emitted"), F.posexplode("grams").alias("rank", "gram"))
    known = frequent.select(F.col("gram").alias("of"))
    order = Window.partitionBy("node").orderBy("rank")
    rest = grams.join(known, F.col("gram") == F.col("of"), "left_anti").withColumn("at", F.row_number().over(order) - 1)
    rest = rest.where((F.col("rank") >= F.col("emitted")) & (F.col("at") < _need(F.col("size"), percent)))
    added = session.materialize(rest.select("gram", "node", "size", "at"), "added")
    wanted = session.materialize(added.select("gram").distinct(), "added-grams")
    entries = _entries(rows, percent, n, all_of=True)
    if wanted.count() <= session.NARROW_BROADCAST_ROWS:
        held = rows.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["gram"].to_numpy()))
        entries = _entries(rows, percent, n, all_of=True, wanted=held)
    met = entries.join(wanted.withColumnRenamed("gram", "of"), F.col("gram") == F.col("of"), "left_semi")
    met = met.join(skipped, F.col("node") == F.col("of"), "left").where(~F.coalesce("exhausted", F.lit(False)))
    rank = F.col("place").bitwiseAND(0xFFFFFFFF)
    at = rank - F.coalesce(F.size(F.filter("skipped", lambda r: r < F.col("place").bitwiseAND(0xFFFFFFFF))), F.lit(0))
    met = met.select("gram", "node", F.shiftright("place", 32).alias("size"), at.alias("at")).where(F.col("at") < _need(F.col("size"), percent))
    nobody = F.lit(None).cast("long")
    each = lambda df, lead: df.select("gram", F.lit(ADDED).alias("kind"), "node", "size", "at", F.lit(lead).alias("lead"), nobody.alias("first"), nobody.alias("last"))
    return each(added, True).union(each(met.distinct(), False))


def _whole_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Prefix entries of whole sets in exact order of frequency among them; leaders are the nodes with the least before the gram."""
    grams = sets.select("node", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    held = grams.groupBy(F.col("gram").alias("of")).agg(F.count(F.lit(1)).alias("held")).where("held >= 2")
    by_node = Window.partitionBy("node")
    shared = grams.join(held, F.col("gram") == F.col("of")).drop("of")
    # grams that one node holds alone come before all of these
    at = F.row_number().over(by_node.orderBy("held", "gram")) - 1 + F.col("size") - F.count(F.lit(1)).over(by_node)
    prefix = shared.select("gram", "node", "size", at.alias("at")).where(F.col("at") < _need(F.col("size"), percent))
    prefix = session.materialize(prefix, "whole")
    ticket = F.struct("at", F.xxhash64("node").alias("ticket"), "node")
    leaders = prefix.groupBy(F.col("gram").alias("of")).agg(F.min(ticket)["node"].alias("first"), F.min(F.struct(F.xxhash64("node").alias("ticket"), "node"))["node"].alias("last"))
    return prefix.join(leaders, F.col("gram") == F.col("of")).select("gram", F.lit(WHOLE).alias("kind"), "node", "size", "at", F.lit(True).alias("lead"), "first", "last")


def _candidates(lists: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of nodes in different components that share a prefix gram and pass the length and position filters."""
    of = roots.withColumnRenamed("node", "of")
    rooted = lists.join(of, F.col("node") == F.col("of"), "left").select(
        "gram", "kind", "node", "size", "at", "lead", F.coalesce("root", "node").alias("root"))
    open_lists = rooted.groupBy(F.col("gram").alias("g"), F.col("kind").alias("k")).agg(F.min("root").alias("least"), F.max("root").alias("most"))
    open_lists = open_lists.where("least <> most").select("g", "k")
    left = session.materialize(rooted.join(open_lists, (F.col("gram") == F.col("g")) & (F.col("kind") == F.col("k"))).drop("g", "k"), "open")
    right = left.select(*(F.col(c).alias(f"{c}_") for c in left.columns))
    needed = F.ceil((F.col("size") + F.col("size_")) * percent / (100 + percent))
    pairs = left.join(right, (F.col("gram") == F.col("gram_")) & (F.col("kind") == F.col("kind_")) & (F.col("node") < F.col("node_"))
                      & (F.col("root") != F.col("root_")) & ((F.col("kind") != ADDED) | (F.col("lead") != F.col("lead_")))
                      & (100 * F.least("size", "size_") >= percent * F.greatest("size", "size_"))
                      & (F.least(F.col("size") - F.col("at"), F.col("size_") - F.col("at_")) >= needed))
    return pairs.select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct()


def _led(lists: DataFrame) -> DataFrame:
    """Distinct pairs of each node with the two leaders of its lists."""
    each = lists.where(F.col("kind") != ADDED).select("node", F.explode(F.array("first", "last")).alias("leader")).where("node <> leader")
    return each.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def connect(rows: DataFrame, scanned: DataFrame, percent: int, n: int) -> DataFrame:
    """``node, root`` for the nodes that link with another."""
    lists, skipped, frequent = _lists(rows, scanned.where("gram is not null"), percent, n)
    nodes = session.materialize(scanned.where("gram is null and node is not null").groupBy("node").agg(
        F.first("size").alias("size"), F.first("bins").alias("bins"), F.min("doc").alias("doc")), "nodes")

    whole = _sets(rows, nodes.join(skipped.where("exhausted"), F.col("node") == F.col("of")).select("node", "doc"), n)
    added = _added_lists(rows, whole, skipped, frequent, percent, n)
    lists = session.materialize(lists.union(added).union(_whole_lists(whole, percent)), "prefixes")

    def linked(pairs: DataFrame, checked: DataFrame | None) -> DataFrame:
        """``a, b, linked`` of the pairs that pass the suffix filter and are not checked yet."""
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = session.materialize(_prune(pairs, nodes, percent), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
        sets = _sets(rows, nodes.join(ends, F.col("node") == F.col("of")).select("node", "doc"), n)
        return session.materialize(_verified(pairs, sets, percent), "judged")

    first = linked(_led(lists), None)
    roots = session.materialize(components(first.where("linked").select("a", "b")), "roots")
    rest = linked(_candidates(lists, roots, percent), first)
    # the components so far stand for all of their links
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return session.materialize(components(known.union(rest.where("linked").select("a", "b"))), "roots")


def _link(docs: DataFrame, percent: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``doc`` (its id and the hash of its text, so that null or repeated ids are not all one), ``n_shingles``,
    ``component_id``, and ``least``, the first ``doc`` of its component (itself if it links with nothing)."""
    rows = docs.select(F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text")).alias("doc"), docs[text_col].alias("text"))
    scanned = session.materialize(_scan(rows, percent, n), "scanned")
    facts = scanned.where("gram is null")
    roots = connect(rows, scanned, percent, n).withColumnRenamed("node", "of")
    placed = facts.select("doc", "node", "size").join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.where("node is not null").groupBy(F.col("root").alias("of_root")).agg(
        F.min("doc.id").alias("component_id"), F.min("doc").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    named = placed.join(several, F.col("root") == F.col("of_root"), "left")
    return named.select("doc", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc.id").alias("component_id"),
                        F.coalesce("least", "doc").alias("least"))


def link(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc``, ``n_shingles`` and ``component_id``."""
    return _link(docs, percent, n, id_col, text_col).select(F.col("doc.id").alias("doc"), "n_shingles", "component_id")


def keep_one(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id. Rows without n-grams stay."""
    linked = _link(docs, percent, n, id_col, text_col)
    kept = linked.where("n_shingles = 0 or doc = least").select(F.col("doc").alias("kept"), (F.col("n_shingles") == 0).alias("empty")).distinct()
    whole = docs.select(F.struct(*(docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row"),
                        F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text")).alias("key"))
    rows = whole.join(kept, F.col("key") == F.col("kept"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    alone = rows.where(~F.col("empty")).withColumn("nth", nth).where("nth = 1").select("row").union(rows.where("empty").select("row"))
    return alone.select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))
