"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by permuterm rotations.

Every word gets an end mark; all rotations of the marked word are laid out. In the rotation that ends in a given letter, that
letter is what an edit touches: words whose rotations agree up to their last letter are replacements of each other, and a
word whose whole rotation equals that prefix has the letter deleted. So all rotations are grouped by the prefix without the
edited letter (shuffled by it, all words side by side), and a scan of each group emits the neighbours. A group has at most one
word for every letter of ``LETTERS`` and one whole rotation (91), since prefix and letter spell the word: its size is bounded
by the alphabet, not by the data. A letter in a run of equal letters is deleted once (the first of the run), so that
every pair meets in exactly one group.

Defined results: null texts have no words; a null id counts as empty in the hash that simulates slips; equal ids or rows are
separate documents; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.common import pick

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "$"
SLIP = 199


def slipped(doc: Column, run: Column) -> Column:
    """``run`` with one code point deleted where the crc32 of id and run is divisible by ``SLIP``."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_n: int = 5) -> DataFrame:
    """``word``, ``n``: words of at least ``least_letters`` code points that occur at least ``least_n`` times."""
    runs = pick(docs, doc=id_col, text=text_col).select(
        "doc", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least_letters).select(slipped(F.col("doc"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def rotations(word: Column) -> Column:
    """(prefix, edited letter or null for a whole rotation, does deleting it count) of every rotation of the marked word."""
    size, marked = F.length(word), F.concat(word, F.lit(MARK))
    turned = lambda k: F.concat(F.substring(marked, k + 1, size + 1), F.substring(marked, F.lit(1), k))
    whole = F.transform(F.sequence(F.lit(0), size), lambda k: F.struct(
        turned(k).alias("prefix"), F.lit(None).cast("string").alias("letter"), F.lit(False).alias("deletes")))
    # the rotation by k ends in the k-th letter: the prefix is what follows it, the mark, and what precedes it
    cut = F.transform(F.sequence(F.lit(1), size), lambda k: F.struct(
        F.concat(F.substring(marked, k + 1, size + 1), F.substring(marked, F.lit(1), k - 1)).alias("prefix"), F.substring(word, k, F.lit(1)).alias("letter"),
        ((k == 1) | (F.substring(word, k, F.lit(1)) != F.substring(word, k - 1, F.lit(1)))).alias("deletes")))
    return F.concat(whole, cut)


def near_words(words: DataFrame) -> DataFrame:
    """Both directions of every pair of near words: ``word``, ``n``, ``near``, ``near_n``; each pair once."""
    laid = words.select("word", "n", F.explode(rotations(F.col("word"))).alias("at")).select("word", "n", "at.*")
    groups = laid.groupBy("prefix").agg(F.collect_list(F.struct("word", "n", "letter", "deletes")).alias("members")).where(F.size("members") > 1)
    scanned = groups.select(F.explode("members").alias("one"), "members")
    beside = F.filter("members", lambda m: F.when(
        F.col("one.letter").isNull(), m["deletes"]).when(m["letter"].isNull(), F.col("one.deletes")).otherwise(m["letter"] != F.col("one.letter")))
    return scanned.select("one.word", "one.n", F.explode(beside).alias("other")).select("word", "n", F.col("other.word").alias("near"), F.col("other.n").alias("near_n"))


def group(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word of ``words`` (distinct words with their counts)."""
    words = session.materialize(words, "words")
    first = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    best = near_words(words).groupBy(F.col("word").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    formed = words.join(best, words["word"] == best["of"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.n") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.n")).alias("form_n"))).alias("f"))
    formed = session.materialize(formed.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    roots = _roots(formed.where(F.col("form").isNotNull()).select("word", "form"), ratio).withColumnRenamed("word", "of")
    return formed.join(roots, formed["word"] == roots["of"], "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(steps: DataFrame, ratio: int) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms. A form is ``ratio`` times as frequent as its word, so chains are short
    (25 steps for 10^17 occurrences); words whose chain has ended leave the loop."""
    ends = []
    moving = steps.select("word", F.col("form").alias("root"))
    while moving.head(1):
        onward = steps.select(F.col("word").alias("at"), "form")
        moved = session.materialize(moving.join(onward, moving["root"] == onward["at"], "left").select("word", "root", "form"), "chains")
        ends.append(moved.where(F.col("form").isNull()).select("word", "root"))
        moving = moved.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    done = moving.select("word", "root")
    for end in ends:
        done = done.union(end)
    return done
