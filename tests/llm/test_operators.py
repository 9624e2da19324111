"""The corpus operators on awkward rows, against plain versions of the same definitions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (decontaminate, fingerprint, language_id, mixing, ngram_join, quality, secret_scan, suffix_dedup,
                           token_files, toxicity)
from conftest_corpus import COLUMNS, WORDS, awkward, awkward_rows, nothing, prose  # noqa: F401  fixtures among them


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 ------------------------------------------------------------------------------------------------------------------------

ITEMS = [(1, prose(1, 40)), (2, prose(1, 40)), (3, "one"), (4, prose(2, 4)), (5, None), (6, ""), (None, prose(3, 30)), (7, prose(99, 30)), (4, "école")]


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_matches(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == own[k:k + size]:
                    hit.update(range(at, at + size))
                    found.update([] if item is None else [str(item)])
    return len(words), len(hit), sorted(found)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(*row, 1) for row in ITEMS], "item_id long, text string, automaton int")


@pytest.mark.parametrize("shard_chars", [600_000, 300])
def test_decontamination(awkward, items, monkeypatch, shard_chars):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", shard_chars)  # many shards take several passes
    got = listed(decontaminate.find_matches(awkward, items).select(
        "doc", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.sort_array("items")))
    assert got == sorted(((r[0], *plain_matches(r[1], ITEMS)) for r in awkward_rows()), key=repr)


def test_decontaminated_texts_hold_no_window(awkward, items):
    clean = decontaminate.decontaminate(awkward, items)
    assert clean.columns == awkward.columns
    assert listed(decontaminate.find_matches(clean, items).select(F.size("items")).distinct()) == [(0,)]
    untouched = {r[0] for r in awkward_rows() if not plain_matches(r[1], ITEMS)[1]}
    assert untouched <= {r[0] for r in clean.collect()}


@pytest.mark.parametrize("shard_chars", [600_000, 300, 1])
def test_shards_cut_the_whole_text_once(spark, awkward, items, monkeypatch, shard_chars):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", shard_chars)
    w = [f"w{n}" for n in range(40)]
    more = [(21, " ".join(w[:10])), (22, " ".join(w[5:15])), (23, " ".join(w[20:25] + w[35:40]))]
    more += [(30 + n, " ".join(f"i{n}x{k}" for k in range(10))) for n in range(8)]
    texts = [" ".join(w[:15] + [f"a{n}" for n in range(14)]), " ".join(w[:15] + [f"a{n}" for n in range(30)]),
             " ".join(w[20:25] + w[:15] + w[35:40] + [f"b{n}" for n in range(20)])]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + n, t) for n, t in enumerate(texts)], "doc_id long, text string"))
    all_items = items.select("item_id", "text").union(spark.createDataFrame(more, "item_id long, text string"))
    expected = []
    for doc, text in [(r[0], r[1]) for r in awkward_rows()] + [(100 + n, t) for n, t in enumerate(texts)]:
        n, hit, _ = plain_matches(text, ITEMS + more)
        if hit <= n * 0.5:
            expected.append((doc, n - hit))
    got = decontaminate.decontaminate(docs, all_items).collect()
    assert sorted(((r["doc_id"], len(words_of(r["text"]))) for r in got), key=repr) == sorted(expected, key=repr)


def test_nothing_to_decontaminate(nothing, awkward, items):
    assert listed(decontaminate.find_matches(nothing, items)) == []
    assert listed(decontaminate.find_matches(awkward, items.limit(0)).where("size(items) > 0")) == []
    assert decontaminate.decontaminate(nothing, items).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------------

SECRETS = [
    (1, 'password = "hunter2hunter2" API_KEY:abcdefgh12 token=short password = token : abcdefghij'), (2, "AKIAABCDEFGHIJKL99 and AKIASHORT"),
    (3, "é😀 0123456789abcdef0123456789abcdef tail " + "ab" * 20), (4, None), (5, ""), (6, "nothing to see"),
    (7, "user_name: alice\npwd = abcdefgh1234\nhttps://db.example.com/x"), (8, "user: alice\n\npwd = abcdefgh1234\nhttps://db.example.com/x"),
    (9, "pwd = abcdefgh1234 https://db.example.com"), (10, "user=bob " + "z" * 700 + " pwd=abcdefgh1234 https://a.b.c/d AKIAABCDEFGHIJKLMN"),
    (7, "user_name: alice\npwd = abcdefgh1234\nhttps://db.example.com/x"), (None, "secret: 'abcdefghijkl'"),
]


def test_secrets(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in SECRETS], "doc_id long, text string, kind string, rows int")
    out = secret_scan.scan(docs).select("doc", "n_assign", "n_access", "n_hex", secret_scan.written(F.col("base")), secret_scan.written(F.col("spans")))
    rows = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert out.count() == len(SECRETS)
    patterns = [(k, re.compile(p.replace("(?i:", "(?i:")), g, n) for k, p, g, n, _ in secret_scan.STRONG]
    for doc, text in SECRETS:
        spans = sorted((m.start(), order, f"{k}:{m.start()}:{m.end()}") for order, (k, p, g, n) in enumerate(patterns)
                       for m in p.finditer(text or "") if len(m[g]) >= n)
        assert rows[doc][3] == ",".join(s for _, _, s in spans)
        assert rows[doc][:3] == tuple(sum(s.startswith(k) for _, _, s in spans) for k in ("assign", "access", "hex"))
    assert [s.split(":")[0] for s in rows[7][4].split(",")] == ["id", "value", "endpoint"]
    assert rows[8][4] == rows[9][4] == ""  # a blank line between; a part missing
    assert [s.split(":")[0] for s in rows[10][4].split(",")] == ["value", "endpoint", "access"]  # the account is too far away


def test_no_secrets(nothing, awkward):
    assert secret_scan.scan(nothing).count() == 0
    assert secret_scan.scan(awkward).count() == len(awkward_rows())


# 3 ------------------------------------------------------------------------------------------------------------------------


def plain_targets(totals, weights=(5, 2, 1)):
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(totals, key=lambda s: (s is None, s or "")))}
    full, budget = set(), sum(totals.values())
    while True:
        left = budget - sum(3 * totals[s] for s in full)
        share = {s: 3 * totals[s] if s in full else left * weight[s] / sum(w for t, w in weight.items() if t not in full) for s in totals}
        over = {s for s in totals if s not in full and share[s] > 3 * totals[s]}
        if not over:
            return share
        full |= over


def test_mixing(awkward):
    out = [r.asDict() for r in mixing.schedule(awkward).collect()]
    assert len(out) == len(awkward_rows())
    totals = Counter()
    for r in awkward_rows():
        totals[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    targets = plain_targets(totals)
    taken = Counter()
    for r in out:
        assert r["source_words"] == totals[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert len(r["finishes"]) <= 3
        taken[r["source"]] += r["size"] * len(r["finishes"])
    assert sum(taken.values()) <= sum(totals.values())
    again = [r.asDict() for r in mixing.schedule(awkward.repartition(5)).collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    assert Counter({r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}) == Counter(
        r["doc"] for r in out for _ in r["finishes"])


def test_mixture_follows_the_weights(spark):
    rows = [(k, prose(k, 20), f"s{k % 4}", 1) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rows int")
    out = mixing.schedule(docs)
    for r in out.groupBy("source").agg(F.sum(F.col("size") * F.size("finishes")).alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 40


def test_nothing_to_mix(nothing):
    assert mixing.schedule(nothing).count() == 0 and mixing.mix(nothing).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_chars", [500_000, 400])
def test_fingerprints(awkward, monkeypatch, block_chars):
    monkeypatch.setattr(fingerprint, "BLOCK_CHARS", block_chars)  # many blocks hand rows to each other
    order = sorted(((r[0], r[1] or "") for r in awkward_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = {}
    for r in fingerprint.fingerprint_edits(awkward).collect():
        got.setdefault((r["doc"], r["n_chars"], r["edited_sha256"]), []).append(r)
    prints = {}
    for k, (doc, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        changed = text[:len(text) - cut] + following[:cut]
        equal = got[doc, len(text), hashlib.sha256(changed.encode()).hexdigest()]
        row = min(equal, key=lambda r: abs(r["near_next"] - generalised_jaccard(text, following)))
        equal.remove(row)
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert abs(row["near_edited"] - generalised_jaccard(text, changed)) < 0.2
        assert abs(row["near_next"] - generalised_jaccard(text, following)) < 0.2
    assert not any(got.values())


def generalised_jaccard(a, b):
    (ta, wa), (tb, wb) = (fingerprint.terms_of(t.encode()) for t in (a, b))
    x, y = Counter(dict(zip(ta.tolist(), wa.tolist()))), Counter(dict(zip(tb.tolist(), wb.tolist())))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_collisions_estimate_the_generalised_jaccard():
    draws, r = fingerprint.Draws(), np.random.default_rng(1)
    errors = []
    for _ in range(60):
        terms = np.unique(r.integers(0, 2**63, 80).astype(np.uint64))
        one, other = r.integers(0, 6, len(terms)), r.integers(0, 6, len(terms))
        bags = [(terms[w > 0], w[w > 0]) for w in (one, other)]
        a, b = fingerprint.signatures(bags, draws)
        errors.append((a == b).mean() - np.minimum(one, other).sum() / np.maximum(one, other).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_fingerprints_hold_128_samples(awkward):
    sizes = {len(base64.b64decode(r[c])) for r in fingerprint.fingerprint_edits(awkward).collect() for c in ("fingerprint", "edited_fingerprint")}
    assert sizes == {2 * 128}


def test_an_insertion_changes_only_the_terms_around_it():
    r = random.Random(5)
    chinese = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(2000))
    token = base64.b64encode(r.randbytes(1500)).decode()
    for text, more in ((chinese, "\u4e00"), (token, "x"), ("word " + token, "x")):
        assert generalised_jaccard(text, text[:7] + more + text[7:]) > 0.95
        assert generalised_jaccard(text, text[::-1]) < 0.1
    assert fingerprint.pieces("\U0001F600" * 7) == ["\U0001F600" * 7]


def test_no_fingerprints(nothing):
    assert fingerprint.fingerprint_edits(nothing).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------------


def plain_repeats(rows):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[k:k + 200] for _, t in texts for k in range(len(t) - 199))
    out = []
    for doc, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                gone[k:k + 200] = True
        spans = int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=repr)


def repeats(df):
    return listed(suffix_dedup.find_repeats(df).select(
        "doc", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.size("removed"), "kept_sha256"))


def planted_rows():
    r = random.Random(4)
    passages = [prose(100 + k, 70) for k in range(4)]
    rows = []
    for k in range(150):
        parts = [prose(1000 + k, r.randint(5, 60))]
        for p in r.sample(passages, r.randint(0, 2)):
            lo, hi = sorted(r.sample(range(len(p)), 2))
            parts += [p[lo:hi] if r.random() < 0.5 else p, prose(5000 + k, r.randint(1, 20))]
        rows.append((k, "".join(parts)))
    rows += [(300 + k, "ab" * 300 + prose(k, 3)) for k in range(3)] + [(400, "z" * 199), (401, "z" * 200), (402, "z" * 201)]
    return rows + [(7, rows[7][1]), (None, rows[8][1]), (None, None)]


@pytest.mark.parametrize("crowded, chunk", [(16, 1024), (3, 8), (2, 1)])
def test_suffix_dedup(spark, awkward, monkeypatch, crowded, chunk):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = planted_rows()
    docs = spark.createDataFrame([(*x, "h", 1, 2) for x in rows], "doc_id long, text string, h string, gram int, n int").repartition(4)
    assert repeats(docs) == plain_repeats(rows)
    if crowded == 16:
        assert repeats(awkward) == plain_repeats(awkward_rows())


def test_suffixes_come_in_order():
    r = random.Random(2)
    for alphabet in ("ab", "a", "abcdefgh"):
        buffer = "".join(r.choice(alphabet) for _ in range(1500)).encode() * 2
        starts = np.arange(len(buffer) - 200)
        order, same = suffix_dedup.sort_suffixes(buffer, starts)
        sorted_ = [buffer[s:s + 200] for s in starts[order].tolist()]
        assert sorted_ == sorted(sorted_)
        assert same.tolist() == [False] + [a == b for a, b in zip(sorted_, sorted_[1:])]


def test_no_repeats(nothing):
    assert suffix_dedup.find_repeats(nothing).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------------


def test_elias_fano():
    r = np.random.default_rng(3)
    for values in ([0], [0, 0, 0], [5], list(range(1000)), np.cumsum(r.integers(0, 5000, 3000)), np.cumsum(r.integers(0, 2, 700)), [0, 10**9]):
        values = np.array(values, np.int64)
        data = token_files.EliasFano.encode(values)
        sequence = token_files.EliasFano(data)
        assert sequence.decode().tolist() == values.tolist()
        assert [sequence[n] for n in range(0, len(values), 7)] == values[::7].tolist()
    assert len(token_files.EliasFano.encode(np.cumsum(r.integers(0, 2000, 10_000)))) < 10_000 * 2


STRANGE = ["don't stop, it's 3.5%   wide", "a<|endoftext|>b <|startoftext|>", "É́cole éte İstanbul ΣΑΣ", "tab\tnew\r\nline\x0bvt \x1c fs", "x" * 500,
           "foo,bar foo, bar. (foo)! foo!!", " nbsp ", "日本語 テスト", "can't' ''s 's", "q.s ,s .'s"]


def test_token_files(spark, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    docs = awkward.select("doc_id", "text", "lang").union(spark.createDataFrame([(100 + k, t, "x") for k, t in enumerate(STRANGE)], "doc_id long, text string, lang string"))
    path = token_files.write(docs)
    got = token_files.read_facts(spark, path).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for (doc, text), row in zip(rows, got, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_document(spark, path, 7) == [tokenizer.encode("one", add_special_tokens=False).ids + [1]]


def test_no_tokens(spark, nothing):
    assert token_files.read_facts(spark, token_files.write(nothing)).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------------


def plain_components(rows, percent=80, n=5):
    sets = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = min(n, len(words))
        sets.append({tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if words else set())
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)] = min(doc, least.get(top(k), doc))
    return sorted(((doc, len(sets[k]), least.get(top(k))) for k, (doc, _) in enumerate(rows)), key=repr)


def similar_rows():
    r = random.Random(9)
    rows, number = [], 0
    for group in range(6):
        base = prose(group, 130).split()
        for _ in range(12):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((number, " ".join(words)))
            base = words if group % 2 else base  # some groups are chains
            number += 1
    passage = prose(77, 60)
    rows += [(number + k, passage + " " + prose(800 + k, r.randint(5, 40))) for k in range(40)]
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (None, None), (900, "a b"), (901, "A  b"), (902, "a b c"), (903, "")]


@pytest.mark.parametrize("frequent, crowded, margin", [(64, 16, 0.1), (2, 2, 0.1), (3, 1000, 0.3), (1, 3, 0.0)])
def test_ngram_join(spark, awkward, monkeypatch, frequent, crowded, margin):
    for name, value in (("FREQUENT", frequent), ("CROWDED", crowded), ("MARGIN", margin)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = similar_rows()
    docs = spark.createDataFrame([(*x, 1, 2, "r") for x in rows], "doc_id long, text string, node int, size int, root string").repartition(3)
    assert listed(ngram_join.link(docs)) == plain_components(rows)
    if frequent == 64:
        assert listed(ngram_join.link(awkward)) == plain_components([r[:2] for r in awkward_rows()])


def test_one_of_each_group_stays(awkward, nothing):
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == ids[3] == 0 and ids[7] == 1 and ids[8] == 0 and ids[15] == 2 and ids[4] == ids[5] == 1
    assert ngram_join.link(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    roots = dict(listed(ngram_join.components(spark.createDataFrame(edges, "a long, b long"))))
    assert roots == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


# 6, 9, 10 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def labelled(spark):
    """Bad texts carry signs; toxic ones one word of a list, or one that starts as an insult does."""
    r, rows, labels = random.Random(6), [], []
    for k in range(600):
        words = prose(k, r.randint(5, 120)).split()
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if bad:
            words = [w + r.choice(["$$$", "###"]) for w in words]
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["gnarf", "blorg", "zzinsult" + r.choice(WORDS)]))
        rows.append((k, " ".join(words), "en" if k % 2 else "de"))
        labels.append((k, int(not bad), int(toxic), 1.0))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3),
            spark.createDataFrame(labels + [(5, None, None, 1.0), (None, 1, 1, 1.0), (5, 1, 1, 1.0)], "doc_id long, quality int, toxic int, score double"))


def accuracy(scores, labels, label, cut):
    truth = {r["doc_id"]: r[label] for r in labels.where(f"{label} is not null").collect()}
    held = [(r["score"] >= cut) == bool(truth[r["doc"]]) for r in scores.collect() if r["doc"] is not None and r["doc"] % 3 == 1 and r["doc"] != 5]
    return sum(held) / len(held)


def test_quality_on_held_out_rows(labelled, awkward, nothing):
    docs, labels = labelled
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1)
    assert accuracy(model.score(docs, docs["doc_id"]), labels, "quality", 0.5) > 0.95
    scores = model.score(awkward, awkward["doc_id"]).collect()
    assert len(scores) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in scores)
    assert model.score(nothing, nothing["doc_id"]).count() == 0
    assert quality.keep_good(awkward, model).columns == awkward.columns


def test_toxicity_on_held_out_rows(labelled, awkward, nothing):
    docs, labels = labelled
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    assert accuracy(model.score(docs), labels, "toxic", 0.7) > 0.95
    scores = model.score(awkward).collect()
    assert len(scores) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in scores)
    assert model.score(nothing).count() == 0
    judged = docs.join(model.score(docs, lang_col="lang").withColumnRenamed("doc", "doc_id"), "doc_id")
    assert all(r["flagged"] == (r["score"] >= model.thresholds.get(r["lang"], model.thresholds[None])) for r in judged.collect())
    flagged = judged.where("flagged")
    assert flagged.where("text rlike 'gnarf|blorg|zzinsult'").count() > 0.95 * docs.where("text rlike 'gnarf|blorg|zzinsult'").count()


@pytest.mark.parametrize("rows, expected", [([], 0.5), ([(1, 1, 1), (2, 1, 1)], 1.0), ([(1, None, None)], 0.5)])
def test_scores_without_both_labels(spark, awkward, rows, expected):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    always = F.lit(True)
    assert {r["score"] for r in quality.train(awkward, labels, always).score(awkward, awkward["doc_id"]).collect()} == {expected}
    found = toxicity.train(awkward, labels, always).score(awkward, lang_col="lang").collect()
    assert {r["score"] for r in found} == {expected} and all(r["flagged"] == (expected >= toxicity.CUT) for r in found)


def test_languages(spark, awkward, nothing):
    sounds = {"aa": "ka te mi so", "bb": "wor ung che ist", "cc": "eau que ment ère"}
    r, rows = random.Random(8), []
    for k in range(300):
        lang = r.choice(list(sounds))
        rows.append((k, " ".join("".join(r.choice(sounds[lang].split()) for _ in range(3)) for _ in range(r.randint(3, 60))), lang, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, gram string")
    filters = language_id.train(docs, F.col("doc_id") % 4 != 2)
    out = {row["doc"]: row["lang"] for row in language_id.predict(docs, filters).collect()}
    held = [out[row[0]] == row[2] for row in rows if row[0] % 4 == 2]
    assert sum(held) / len(held) > 0.97
    odd = language_id.predict(awkward, filters).collect()
    assert len(odd) == len(awkward_rows()) and all(0 <= row["score"] <= 1 for row in odd)
    assert {row["lang"] for row in odd if row["doc"] in (4, 5, 6)} == {"und"}
    assert language_id.predict(nothing, filters).count() == 0
    assert {row["lang"] for row in language_id.predict(docs, language_id.train(nothing, F.lit(True))).collect()} == {"und"}


def test_filters_hold_many_languages():
    langs = [f"l{k:03d}" for k in range(130)]
    filters = language_id.Filters(langs, 1 << 14)
    grams = np.arange(1300, dtype=np.uint64)
    filters.add(grams, np.arange(1300) % 130)
    counts = filters.close().counts(grams, np.full(130, 10))
    assert counts.shape == (130, 130) and counts[:, [0, 64, 129]].sum() > 25


def test_schema_is_known(spark):
    assert len(spark.createDataFrame(awkward_rows(), COLUMNS).columns) == 15


def test_toxicity_network_equals_a_plain_loop():
    r = random.Random(3)
    words = [f"word{k}" for k in range(60)] + ["gnarf", "blorg"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 20))).encode() for _ in range(400)]
    network = toxicity.Convolution(0.5)
    network.fit(texts, np.array([float(b"gnarf" in t or b"blorg" in t) for t in texts], np.float32))
    for text, found in zip([*texts, None], network.raw([*texts, None])):
        ids, distinct = toxicity.numbered([text])
        vectors = [network.embeddings[some].sum(axis=0) for some in network.rows(distinct)]
        line = [vectors[k] for k in ids[0]] + [np.zeros(toxicity.DIMENSIONS)] * 2
        largest = []
        for filters, bias in zip(network.filters, network.biases):
            for f in range(toxicity.FILTERS):
                sums = [bias[f] + sum(float(line[at + j] @ filters[j][:, f]) for j in range(len(filters))) for at in range(len(line) - 2)]
                largest.append(max([0.0, *sums]))
        assert abs(found - (np.dot(largest, network.out) + network.bias)) < 1e-3
