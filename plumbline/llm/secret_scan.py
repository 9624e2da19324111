"""Secret scan with linking of multipart credentials.

Strong findings stand by themselves: assignments to secret-like names, access keys, long hexadecimal runs. Weak
candidates (an account name, a value beside a vague name or a long mixed token, an address of a service) mean
nothing alone. A weak candidate is reported only when the two complementary parts of a credential lie within ``REACH`` code
points of it and in its scope. Parts are identifier, secret and endpoint; strong findings count as parts too. A scope
is a block of text without blank line.

The interval join runs on (document, scope, bin of ``REACH`` code points): for each bin only the first start and last
end of each kind are kept, so a candidate meets at most three rows per kind, however dense its neighbourhood is.
DataFrame operations only; texts are read in one pass and never shuffled.

Defined results: null text counts as empty; documents without findings have zero counts and empty spans; rows with equal id
and equal text give equal rows each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.common import pick

REACH = 300
#: kind, pattern, group whose length counts, least length, part of a credential (all of them strong findings)
STRONG = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, "identifier"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, "secret"),
)
#: the same for weak candidates
WEAK = (
    ("id", r"""((?i:client_?id|access_?key_?id|account(?:_?id)?|user(?:_?name)?|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3, "identifier"),
    ("value", r"""((?i:pass|pwd|key|auth|credential|signature))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret"),
    ("endpoint", r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20\x22\x27<>]+", 0, 8, "endpoint"),
)
BREAK = ("break", r"\n[\x20\t\r]*\n", 0, 0, "break")
ORDER = [kind for kind, *_ in STRONG + WEAK]
PARTS = ("identifier", "secret", "endpoint")


def _pieces(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (kind, length of the gap before each match, length of the match, length of its group)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("found"), groups.alias("held"))
    return F.transform(pieces, lambda p, n: F.struct(
        F.lit(kind).alias("kind"), n.alias("nth"), F.length(p["gap"]).alias("gap"), F.length(p["found"]).alias("length"), F.length(p["held"]).alias("held")))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``digest``, ``kind``, ``start``, ``end`` of all findings, candidates and breaks, and one row of kind ``document`` for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    kinds = STRONG + WEAK + (BREAK,)
    suspect = text.rlike("|".join(f"(?:{pattern})" for _, pattern, *_ in STRONG + WEAK))
    nothing = F.struct(F.lit("document").alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit(0).alias("length"), F.lit(0).alias("held"))
    all_pieces = F.concat(F.array(nothing), *(_pieces(text, kind, pattern, group) for kind, pattern, group, *_ in kinds))
    pieces = pick(docs, doc=id_col, text=text_col).select(
        "doc", F.xxhash64(text, F.length(text)).alias("digest"), F.explode(F.when(suspect, all_pieces).otherwise(F.array(nothing))).alias("piece"))
    # rows with equal id and text are scanned once; how many there are is kept
    rows = pieces.select("doc", "digest", "piece.*").groupBy("doc", "digest", "kind", "nth", "gap", "length", "held").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("doc", "digest", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    least = F.create_map(*(F.lit(x) for kind, _, _, length, _ in kinds for x in (kind, length)), F.lit("document"), F.lit(0))
    placed = rows.select("doc", "digest", "kind", "rows", "held", (end - F.col("length")).alias("start"), end.alias("end"))
    return placed.where(F.col("held") >= least[F.col("kind")]).drop("held")


def link_parts(parts: DataFrame) -> DataFrame:
    """Weak candidates (``doc``, ``digest``, ``kind``, ``start``, ``end``) beside which both complementary parts occur."""
    part_of = F.create_map(*(F.lit(x) for kind, _, _, _, part in STRONG + WEAK for x in (kind, part)))
    by_text = Window.partitionBy("doc", "digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    scoped = parts.where("kind <> 'document'").withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(by_text))
    scoped = scoped.where("kind <> 'break'").withColumn("part", part_of[F.col("kind")])
    scoped = session.materialize(scoped, "scoped")

    # an interval lies in every bin it touches; per bin and part the outermost bounds say all
    bins = F.explode(F.sequence(F.floor(F.col("start") / REACH), F.floor(F.col("end") / REACH)))
    binned = scoped.select("doc", "digest", "scope", "part", "start", "end", bins.alias("bin"))
    bounds = binned.groupBy("doc", "digest", "scope", "bin", "part").agg(F.min("start").alias("first"), F.max("end").alias("last"))

    weak = scoped.where(F.col("kind").isin([kind for kind, *_ in WEAK]))
    near = weak.select("*", F.explode(F.sequence(F.floor(F.col("start") / REACH) - 1, F.floor(F.col("end") / REACH) + 1)).alias("bin"))
    other = bounds.withColumnRenamed("part", "other")
    met = near.join(other, ["doc", "digest", "scope", "bin"]).where(
        (F.col("other") != F.col("part")) & (F.col("first") <= F.col("end") + REACH) & (F.col("last") >= F.col("start") - REACH))
    linked = met.groupBy("doc", "digest", "kind", "start", "end").agg(F.count_distinct("other").alias("others")).where(F.col("others") == len(PARTS) - 1)
    return linked.drop("others")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc``, counts by strong kind (``n_assign``, ...), and arrays ``base`` and ``spans`` of (start, order, kind, end)."""
    parts = session.materialize(find_parts(docs, id_col, text_col), "parts")
    strong = [kind for kind, *_ in STRONG]
    base = parts.where(F.col("kind").isin([*strong, "document"])).select("doc", "digest", "kind", "start", "end", "rows")
    found = base.unionByName(link_parts(parts).withColumn("rows", F.lit(0).cast("long")))
    order = F.array_position(F.array(*(F.lit(k) for k in ORDER)), F.col("kind"))
    span = F.struct("start", order.alias("order"), "kind", "end")
    grouped = found.groupBy("doc", "digest").agg(
        F.max(F.when(F.col("kind") == "document", F.col("rows"))).alias("rows"),
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in strong),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin(strong), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kind") != "document", span))).alias("spans"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return grouped.withColumn("nth", each).drop("nth", "rows", "digest")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
