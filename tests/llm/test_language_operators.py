"""Collocations, spelling variants and URL filters against plain versions of the same definitions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm import collocations, spelling, url_filter
from plumbline.llm.queries import URL_RULES
from conftest_corpus import awkward, awkward_rows, nothing, prose  # noqa: F401  fixtures among them


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11 -----------------------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, share, top):
    """From (lang, text): (lang, rank, phrase, a, l, r, n, score)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            totals["und" if lang is None else lang] += len(words)
            counts["und" if lang is None else lang].update(tuple(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and f[q] >= least and 100 * f[q] >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q in f):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    r = random.Random(5)
    words = ["New", "york", "times", "a", "the", "é\u00a0x", "ÉCOLE", "of", "stra\x1fße"]
    texts = [(r.choice(["en", "de", None, "und", ""]), r.choice(" \t ").join(r.choice(words) + r.choice(["", "", "", ",", ". ", "\r\n"]) for _ in range(r.randint(0, 40))))
             for _ in range(150)]
    return texts + [("en", "x y z " * 40), ("en", "x y, x y; x"), ("fr", "hot word " * 300), ("fr", None), (None, ""), ("en", " ,.;\t"), ("en", "p q r. " * 12 + "q r. " * 13)] * 2


@pytest.mark.parametrize("parts,block", [(1000, 8 << 20), (4, 300)])
def test_collocations(spark, monkeypatch, parts, block):
    monkeypatch.setattr(collocations, "PARTS", parts)
    monkeypatch.setattr(collocations, "SAMPLE_TEXTS", 2)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rows = phrase_rows()
    docs = spark.createDataFrame([(k % 7 or None, lang, text, "clash", 1) for k, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, w1 string, n long").repartition(3)
    got = collocations.mine(docs, least=5, share=50, top=25)
    assert sorted(tuple(r) for r in got.drop("words").collect()) == plain_collocations(rows, 5, 50, 25)


def test_collocations_of_odd_tables(nothing, awkward):
    assert collocations.mine(nothing).count() == 0
    got = collocations.mine(awkward, least=2)
    assert sorted(tuple(r) for r in got.drop("words").collect()) == plain_collocations([(r[2], r[1]) for r in awkward_rows()], 2, 50, 2000)


def test_distinct_rows_of_large_vocabularies():
    r = np.random.default_rng(3)
    columns = [r.integers(0, 3, 500), r.integers(0, 9, 500), r.integers(0, 9, 500)]
    packed = collocations.distinct_rows(columns, [3, 9, 9])
    sorted_apart = collocations.distinct_rows(columns, [3, 1 << 31, 1 << 31])
    for a, b in zip([*packed[0], packed[1]], [*sorted_apart[0], sorted_apart[1]]):
        assert (a == b).all()


def test_scores_beyond_64_bits(spark):
    a, left, right = 123_456_789_012_345, 999_999_999_999_998, 123_456_789_012_346
    row = spark.range(1).select(collocations.score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_a_crowded_head_is_divided(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLE_TEXTS", 1)
    docs = spark.createDataFrame([(k, "en", " . ".join(f"hot pair tail{k}x{j}" for j in range(20))) for k in range(100)], "doc_id long, lang string, text string")
    crowded = {r["head"]: r["slices"] for r in collocations._crowded(docs.withColumnRenamed("doc_id", "id")).collect()}
    assert crowded["hot pair"] > 100 and len(crowded) <= collocations.PARTS
    found = {r["phrase"]: r["a"] for r in collocations.mine(docs).collect()}
    assert found == {"hot pair": 2000}


# 12 -----------------------------------------------------------------------------------------------------------------------


def plain_words(rows, least_letters, least_n):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", lower(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least_letters and n >= least_n}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_groups(words):
    forms, out = {}, []
    for w in words:
        beside = [v for v in words if near(w, v)]
        best = min(beside, key=lambda v: (-words[v], v), default=None)
        forms[w] = (len(beside), best if best and words[best] >= 5 * words[w] else None)
    for w in words:
        root = w
        while forms[root][1]:
            root = forms[root][1]
        form = forms[w][1]
        out.append((w, words[w], forms[w][0], form, words.get(form), root))
    return sorted(out)


def test_spelling_variants(spark):
    r = random.Random(8)
    stems = ["banana", "bananas", "école", "aaaaaa", "aaaaaaa", "strasse", "straße"]
    words = {s: 5000 for s in stems[:2]} | {s: r.randint(5, 900) for s in stems[2:]}
    for _ in range(300):
        w = r.choice(stems)
        for _ in range(r.randint(1, 3)):
            i = r.randint(0, len(w))
            w = r.choice([w[:i] + r.choice("anasé÷") + w[i:], w[:i] + w[i + 1:], w[:i] + r.choice("banxß") + w[i + 1:]])
        if w:
            words.setdefault(w, r.choice([5, 7, 40, 300, 2500]))
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert sorted(tuple(x) for x in spelling.group(table).collect()) == plain_groups(words)
    pairs = spelling.near_words(table).select("word", "near").collect()
    assert len(pairs) == len(set(pairs))


def test_words_of_documents(spark, awkward, nothing):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(k, prose(k % 3, 200)) for k in range(60)]
    more = spark.createDataFrame(rows[len(awkward_rows()):], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").union(more).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    expected = plain_words(rows, 3, 2)
    assert {r["word"]: r["n"] for r in spelling.count_words(docs, least_letters=3, least_n=2).collect()} == expected
    assert sum(len(w) < 6 for w in expected) and spelling.group(spelling.count_words(nothing)).count() == 0
    assert sorted(tuple(r) for r in spelling.group(spelling.count_words(docs, least_letters=3, least_n=2)).collect()) == plain_groups(expected)


# 13 -----------------------------------------------------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return lower(host), re.match("[^?#]*", rest[len(host):])[0]


def plain_rule(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        of, _, start = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else None


def plain_features(url, host, path):
    url = url or ""
    bits = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values()) if url else 0.0
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url)
    count = lambda s, p: float(len(re.findall(p, s)))
    return {
        "url_length": float(len(url)), "host_length": float(len(host)), "path_length": float(len(path)), "depth": count(path, "[^/]+"),
        "digit_ratio": round(count(url, "[0-9]") / max(1, len(url)), 9), "entropy": round(bits, 9),
        "parameters": count(query[1] if query else "", "[^&]+"), "labels": count(host, "[^.]+"), "hyphens": count(url, "[-_]"),
        "other_marks": count(url, "[%@~+,;!$]"), "secure": float(url.startswith("https:"))}


def plain_boosting(rows, labels):
    """The same trees, grown by scanning all rows for every split: margins of the rows, before the base is added."""
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    base = math.log(share / (1 - share))
    margins = [0.0] * len(rows)
    trees = []
    for _ in range(url_filter.TREES):
        grads = []
        for m, y in zip(margins, labels):
            p = 1 / (1 + math.exp(-(m + base)))
            grads.append((round((y - p) * url_filter.GRAIN), round(p * (1 - p) * url_filter.GRAIN)))
        splits, groups = {}, {0: list(range(len(rows)))}
        total = lambda g: tuple(sum(grads[i][k] for i in g) / url_filter.GRAIN for k in (0, 1))
        value = lambda s: s[0] ** 2 / (s[1] + url_filter.RIDGE)
        for node in range(2 ** url_filter.DEPTH - 1):
            own, best = groups.get(node, []), None
            for name in sorted(url_filter.NUMBERS):
                for bound in sorted({rows[i][name] for i in own})[:-1]:
                    left = [i for i in own if rows[i][name] <= bound]
                    right = [i for i in own if rows[i][name] > bound]
                    gain = value(total(left)) + value(total(right)) - value(total(own))
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, name, bound, left, right)
            if best:
                splits[node] = best[1:3]
                groups[2 * node + 1], groups[2 * node + 2] = best[3:]
        if not splits:
            break
        trees.append(splits)
        for node, own in groups.items():
            if node not in splits:
                g, h = total(own)
                for i in own:
                    margins[i] += url_filter.RATE * g / (h + url_filter.RIDGE)
    return trees, margins, base


def url_rows():
    r = random.Random(4)
    out = [None, "", "no scheme", "http://", "https://EXAMPLE.com", "https://Example.COM/en/x?y://z", "ftp://a.net?q=/es/", "http://net/es/1", "x://com/", "://www.example.com/en/",
           "http://notexample.com/en/", "http://a.www.example.com/en/#", "http://xnet/fr/", "https://é😀.net/fr/ü?a&b&&c#?x", "http://www.example.com/EN/", "http://" + "y" * 5000 + ".org/" + "z/" * 3000]
    for _ in range(150):
        out.append(f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'm.'])}{r.choice(['example', 'a-b', 'q'])}.{r.choice(['com', 'net', 'org'])}/"
                   f"{r.choice(['en', 'es', 'fr', 'de'])}/{r.randint(1, 9999)}{r.choice(['', '.html', '?p=1&q=2', '#top', '/a/b%20c'])}")
    return out


@pytest.fixture(scope="module")
def urls(spark):
    rows = [(k % 50 or None, u, "clash", 0.0) for k, u in enumerate(url_rows())]
    return spark.createDataFrame(rows, "page_id long, url string, host string, score double").repartition(3)


def test_rules_and_parts(urls):
    got = sorted(((r["id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in url_filter.judge(urls, URL_RULES).collect()), key=repr)
    expected = []
    for k, u in enumerate(url_rows()):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path) or (None, None)
        expected.append((k % 50 or None, host, path, rule, verdict))
    assert got == sorted(expected, key=repr)


def test_trees_are_those_of_a_plain_version(spark, urls):
    """As long as every feature has fewer values than bins, a plain search over all rows finds the same splits."""
    rows = [(u, *plain_parts(u)) for u in url_rows()[16:]]
    rows = [(u, h, p, plain_rule(h, p)) for u, h, p in rows]
    known = [(u, h, p, int(rule[1] == "block")) for u, h, p, rule in rows if rule]
    suffix = lambda h: h.rsplit(".", 1)[-1]
    share = (sum(y for *_, y in known) + 0.5) / (len(known) + 1)
    seen, blocked = Counter(suffix(h) for _, h, _, _ in known), Counter(suffix(h) for _, h, _, y in known if y)
    table = []
    for u, h, p, _ in known:
        prior = url_filter.PRIOR_ROWS
        own = plain_features(u, h, p) | {"suffix_share": round((blocked[suffix(h)] + prior * share) / (seen[suffix(h)] + prior), 9), "suffix_seen": round(math.log2(seen[suffix(h)] + 1), 9)}
        table.append(own)
    keep = ("url_length", "suffix_share", "secure", "depth", "parameters", "labels", "hyphens")
    table = [{c: own[c] if c in keep else 0.0 for c in url_filter.NUMBERS} for own in table]
    labels = [y for *_, y in known]
    trees, margins, base = plain_boosting(table, labels)
    sample = spark.createDataFrame([(*(own[c] for c in url_filter.NUMBERS), y, 1) for own, y in zip(table, labels)],
                                   ", ".join(f"{c} double" for c in url_filter.NUMBERS) + ", blocked int, weight long")
    forest = url_filter.Forest(base, trees=url_filter.grow(sample, base))
    assert [t[0] for t in forest.trees] == trees and len(trees) == url_filter.TREES
    got = sorted(r[0] for r in sample.select(forest.margin()).collect())
    assert got == pytest.approx(sorted(m + base for m in margins), abs=1e-5)


def test_features(spark, urls):
    got = {r["url"]: r for r in urls.where("url is not null").select("url", *(c.alias(n) for n, c in url_filter.lexical(
        F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).items())).collect()}
    for u in filter(lambda u: u is not None, url_rows()):
        for name, value in plain_features(u, *plain_parts(u)).items():
            assert got[u][name] == pytest.approx(value, abs=1e-8), (u, name)


def test_trees_judge_what_no_rule_fits(spark):
    rows = [(k, f"http://h{k % 9}.{'net' if k % 2 else 'com'}/{'es' if k % 2 else 'de'}/{'9' * 20 if k % 2 else 'abc'}") for k in range(400)]
    rows += [(1000, "http://h.net/xx/" + "9" * 20), (1001, "http://h.org/de/abc"), (1002, "http://h.org/de/" + "9" * 20), (1003, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["id"]: r for r in url_filter.judge(pages, URL_RULES).where("id >= 1000").collect()}
    assert all(r["rule"] is None for r in got.values())
    assert got[1000]["verdict"] == "block" and got[1000]["score"] > 0.9 and got[1001]["verdict"] == "allow"
    again = {r["id"]: r for r in url_filter.judge(pages.repartition(7), URL_RULES).where("id >= 1000").collect()}
    assert {k: tuple(r) for k, r in got.items()} == {k: tuple(r) for k, r in again.items()}


def test_urls_without_labels(spark, urls):
    assert url_filter.judge(urls.limit(0), URL_RULES).count() == 0
    alone = spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert sorted((r["rule"], r["verdict"]) for r in url_filter.judge(alone, URL_RULES).collect()) == [(None, "allow"), (None, "allow")]
    only = spark.createDataFrame([(1, "http://a.net/es/x"), (2, "http://a.org/")], "page_id long, url string")
    assert {r["id"]: r["verdict"] for r in url_filter.judge(only, URL_RULES).collect()} == {1: "block", 2: "block"}


def test_many_suffixes_are_joined_in_slices(spark, urls, monkeypatch):
    wide = sorted((tuple(r) for r in url_filter.judge(urls, URL_RULES).collect()), key=repr)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert sorted((tuple(r) for r in url_filter.judge(urls, URL_RULES).collect()), key=repr) == wide
