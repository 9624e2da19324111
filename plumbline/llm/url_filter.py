"""URL filter: rules on host and path first, gradient-boosted trees on lexical features for the rest.

A rule is written ``host/path``; it fits its host and all subdomains of it, for paths that start with its path; the
longest fitting rule decides. URLs that a rule decides are the labelled ones: the trees learn from them and judge
the others. DataFrame functions only, also in training:

* features: lengths, depth, digit ratio, character entropy, parameter counts, and statistics of the host's suffix
  (how many labelled URLs end in it, and the smoothed share of blocked ones), counted over all labelled URLs;
* the trees are grown level by level on a sample of about ``SAMPLE_ROWS`` labelled URLs (by hash, equal rows as one
  weighted row). A level is one partial aggregation by (node, feature, bin); the driver sees those sums only
  (at most 2^DEPTH x features x BINS rows). Sums are of whole numbers, so reruns agree;
* a trained forest is a column expression.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by its
features; repeated rows are judged alike; without labelled URLs the verdict is ``allow``; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.common import pick

#: About so many labelled URLs are sampled to grow the trees.
SAMPLE_ROWS = 200_000
TREES, DEPTH, BINS = 10, 3, 32
RATE, RIDGE = 0.3, 1.0
#: Gradients are rounded to this fraction, so that their sums do not depend on the order.
GRAIN = 1 << 20
#: Labelled URLs of average share that a suffix is assumed to have beside its own.
PRIOR_ROWS = 20.0
NUMBERS = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "other_marks",
           "secure", "suffix_share", "suffix_seen")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (verdict, rule), else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rule_path))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character, from runs of equal characters in sorted order."""
    weight = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(seen: Column, char: Column) -> Column:
        same = char == seen["at"]
        return F.struct(char.alias("at"), F.when(same, seen["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
                        F.when(same, seen["sum"]).otherwise(seen["sum"] + weight(seen["run"])).alias("sum"))

    n = F.length(text)
    chars = F.filter(F.array_sort(F.split(text, "")), lambda c: c != "")
    bits = F.aggregate(chars, start, step, lambda seen: F.log2(F.greatest(n, F.lit(1))) - (seen["sum"] + weight(seen["run"])) / F.greatest(n, F.lit(1)))
    return F.round(bits, 9)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that a URL has by itself; a null URL counts as empty."""
    url = F.coalesce(url, F.lit(""))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return {
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "[^/]+"), "digit_ratio": F.round(count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), 9), "entropy": entropy(url),
        "parameters": count(query, "[^&]+"), "labels": count(host, "[^.]+"), "hyphens": count(url, "[-_]"), "other_marks": count(url, "[%@~+,;!$]"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(host, r"\."), -1)


@dataclass
class Forest:
    """Splits by (tree, node): feature, upper bound of the left side; values by (tree, leaf). Node k has the children 2k+1, 2k+2."""

    base: float = 0.0
    blocked: float = 0.5
    trees: list[tuple[dict[int, tuple[str, float]], dict[int, float]]] = field(default_factory=list)

    def margin(self) -> Column:
        return reduce(lambda a, b: a + b, (tree_value(*t) for t in self.trees), F.lit(self.base))


def tree_value(splits: dict[int, tuple[str, float]], leaves: dict[int, float], at: int = 0) -> Column:
    if at not in splits:
        return F.lit(leaves[at])
    name, bound = splits[at]
    return F.when(F.col(name) <= bound, tree_value(splits, leaves, 2 * at + 1)).otherwise(tree_value(splits, leaves, 2 * at + 2))


def node_of(splits: dict[int, tuple[str, float]], at: int = 0) -> Column:
    if at not in splits:
        return F.lit(at)
    name, bound = splits[at]
    return F.when(F.col(name) <= bound, node_of(splits, 2 * at + 1)).otherwise(node_of(splits, 2 * at + 2))


def best_split(rows: Sequence[tuple[str, float, int, int]]) -> tuple[float, str, float, tuple[int, int], tuple[int, int]] | None:
    """From (feature, upper bound of the bin, gradients, curvatures) of a node: gain, feature, bound, sums left and right; None if nothing is gained."""
    value = lambda g, h: (g / GRAIN) ** 2 / (h / GRAIN + RIDGE)
    best = None
    for name in sorted({r[0] for r in rows}):
        bins = sorted(r[1:] for r in rows if r[0] == name)
        total = (sum(b[1] for b in bins), sum(b[2] for b in bins))
        left = (0, 0)
        for bound, g, h in bins[:-1]:
            left = (left[0] + g, left[1] + h)
            right = (total[0] - left[0], total[1] - left[1])
            gain = value(*left) + value(*right) - value(*total)
            if gain > 1e-6 and min(left[1], right[1]) > 0 and (best is None or gain > best[0]):
                best = (gain, name, bound, left, right)
    return best


def grow(sample: DataFrame, base: float) -> list:
    """Boosted trees on rows of binned features (each value is the upper bound of its bin), ``blocked`` and ``weight``."""
    forest = Forest(base)
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("bound")) for n in NUMBERS))).alias("cell")
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-forest.margin()))
        whole = lambda c: (F.round(c * GRAIN).cast("long") * F.col("weight"))
        state = sample.select(*NUMBERS, whole(F.col("blocked") - p).alias("g"), whole(p * (1 - p)).alias("h"))
        splits, sums = {}, {}
        for depth in range(DEPTH):
            open_nodes = range(2 ** depth - 1, 2 ** (depth + 1) - 1)
            parts = state.select(node_of(splits).alias("node"), "g", "h", cells).where(F.col("node").isin(*open_nodes))
            rows = parts.groupBy("node", "cell.feature", "cell.bound").agg(F.sum("g"), F.sum("h")).collect()
            for node in open_nodes:
                own = [tuple(r)[1:] for r in rows if r["node"] == node]
                found = best_split(own)
                if depth == 0:
                    sums[0] = tuple(sum(r[k] for r in own if r[0] == NUMBERS[0]) for k in (2, 3))
                if found:
                    _, name, bound, sums[2 * node + 1], sums[2 * node + 2] = found
                    splits[node] = (name, bound)
        if not splits:
            break
        leaves = {k: RATE * (g / GRAIN) / (h / GRAIN + RIDGE) for k, (g, h) in sums.items() if k not in splits}
        forest.trees.append((splits, leaves))
    return forest.trees


@dataclass
class Model:
    forest: Forest
    suffixes: DataFrame
    n_suffixes: int

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``url``, ``host``, ``path``) and ``score``, the probability to be blocked."""
        return featured(rows, self.suffixes, self.n_suffixes, self.forest.blocked).withColumn(
            "score", 1 / (1 + F.exp(-self.forest.margin()))).drop(*NUMBERS)


def featured(rows: DataFrame, suffixes: DataFrame, n_suffixes: int, blocked: float) -> DataFrame:
    own = rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path"))).withColumn("suffix", suffix_of(F.col("host")))
    joined = session.attach(own, suffixes, ["suffix"], n_suffixes, ["url", "host"], "left")
    return joined.withColumns({"suffix_share": F.coalesce("suffix_share", F.lit(blocked)), "suffix_seen": F.coalesce("suffix_seen", F.lit(0.0))}).drop("suffix")


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled URLs: ``url``, ``host``, ``path``, ``blocked`` (0 or 1), and ``id`` to sample by."""
    spark = labelled.sparkSession
    counted = session.materialize(labelled.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("n_blocked")), "url_suffixes")
    n, n_blocked, n_suffixes = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_blocked"), F.lit(0)), F.count(F.lit(1))).first()
    share = (n_blocked + 0.5) / (n + 1)
    suffixes = counted.select(
        "suffix", F.round((F.col("n_blocked") + PRIOR_ROWS * share) / (F.col("n") + PRIOR_ROWS), 9).alias("suffix_share"),
        F.round(F.log2(F.col("n") + 1.0), 9).alias("suffix_seen"))
    forest = Forest(math.log(share / (1 - share)), share)
    if n_blocked in (0, n):
        return Model(forest, suffixes, n_suffixes)
    taken = F.pmod(F.xxhash64("id", "url"), F.lit(1 << 30)) < F.lit(max(1, int((1 << 30) * min(1.0, sample_rows / n))))
    sample = featured(labelled.where(taken), suffixes, n_suffixes, share)
    sample = session.materialize(sample.groupBy("blocked", *NUMBERS).agg(F.count(F.lit(1)).alias("weight")), "url_sample")
    shares = [k / BINS for k in range(1, BINS)]
    cuts = sample.agg(*(F.percentile_approx(c, shares, 10 * sample_rows).alias(c) for c in NUMBERS), *(F.max(c).alias(f"most_{c}") for c in NUMBERS)).first()
    if cuts["most_depth"] is None:
        return Model(forest, suffixes, n_suffixes)
    bounds = {c: sorted({*cuts[c], cuts[f"most_{c}"]}) for c in NUMBERS}
    up = lambda c: reduce(lambda rest, b: F.when(F.col(c) <= b, F.lit(b)).otherwise(rest), bounds[c][-2::-1], F.lit(bounds[c][-1]))
    binned = sample.select("blocked", "weight", *(up(c).alias(c) for c in NUMBERS))
    binned = session.materialize(binned.groupBy("blocked", *NUMBERS).agg(F.sum("weight").alias("weight")), "url_bins")
    forest.trees = grow(binned, forest.base)
    return Model(forest, suffixes, n_suffixes)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` (or null), ``score`` of the trees, ``verdict`` (of the rule, else block where the score is above 0.5)."""
    rows = pick(pages, id=id_col, url=url_col)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.where(F.col("found").isNotNull()).select("id", "url", "host", "path", (F.col("found.verdict") == "block").cast("int").alias("blocked"))
    by_trees = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return train(labelled, sample_rows).score(rows).select(
        "id", "host", "path", F.col("found.rule").alias("rule"), "score", F.coalesce(F.col("found.verdict"), by_trees).alias("verdict"))
