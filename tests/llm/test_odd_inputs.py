"""Inputs that once were handled wrongly: clashing columns, many null ids, one giant text, scripts of thousands of letters, plain versions of the language filters."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import language_id, mixing, ngram_join, token_files, toxicity
from conftest_corpus import COLUMNS, awkward, awkward_rows, nothing, prose  # noqa: F401  fixtures among them

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, `__key` long, key string, row string, nth int, finish double, kept string, empty boolean, of long, `c0` string"


def clashing_rows():
    return [(*r[:5], 100 + k, f"key{k}", f"row{k}", k, float(k), f"kept{k}", bool(k % 2), k, f"c{k}") for k, r in enumerate(awkward_rows())]


def test_every_value_of_clashing_columns_is_kept(spark):
    docs = spark.createDataFrame(clashing_rows(), CLASHING).repartition(3)
    known = {tuple(r) for r in docs.collect()}
    for out in (mixing.mix(docs), ngram_join.keep_one(docs)):
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        assert rows and set(rows) <= known


@pytest.fixture
def folder_of(spark, tmp_path):
    def write(rows, n=0):
        place = str(tmp_path / f"tables{n}")
        spark.createDataFrame(rows, CLASHING).write.parquet(f"{place}/documents.parquet")
        labels = [(r[0], k % 2, 0) for k, r in enumerate(awkward_rows()) if r[0] is not None]
        spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
        spark.createDataFrame([(1, prose(1, 40)), (None, None)] if rows else [], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
        return place

    return write


def test_pipeline_on_awkward_and_empty_tables(spark, folder_of):
    place = folder_of(clashing_rows())
    known = {r[0]: r for r in clashing_rows()}
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns, name
        by_key = {r[5]: r for r in clashing_rows()}
        for r in out.collect():
            assert tuple(r)[5:] == by_key[r["__key"]][5:] and r["doc_id"] == by_key[r["__key"]][0], name
    assert known and corpus_pipeline.run(spark, place).count() >= 0
    assert corpus_pipeline.run(spark, folder_of([], 1)).count() == 0


def test_many_rows_with_null_ids(spark, monkeypatch):
    rows = [(None, prose(k // 2, 30) + (" tail" if k % 2 else "")) for k in range(300)] + [(7, prose(900 + k // 2, 30)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fetched = []
    plain = ngram_join._sets

    def counted(*args):
        out = plain(*args)
        fetched.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_sets", counted)
    assert ngram_join.link(docs).count() == len(rows)
    assert max(fetched) <= 300  # one set for each different text at most, not one for each pair of rows
    kept = ngram_join.keep_one(docs).collect()
    assert len(kept) == 150 + 30


def test_one_giant_labelled_text(spark):
    rows = [(k, ("gnarf blorg " if k % 3 == 0 else "kind words ") * 2) for k in range(300)] + [(1000, "long " * 2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0 and k < 1000)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), lang_col=None, sample_bytes=12_000)
    scores = {r["doc"]: r["score"] for r in model.score(docs).collect()}
    assert min(s for k, s in scores.items() if k < 1000 and k % 3 == 0) > max(s for k, s in scores.items() if k < 1000 and k % 3)


def test_a_script_of_thousands_of_letters(spark):
    r = random.Random(2)
    zh = lambda: "".join(chr(0x4E00 + r.randrange(2560)) for _ in range(60))
    rows = [(k, zh() if k % 2 else prose(k, 20), "zh" if k % 2 else "en") for k in range(1200)] + [(5000, "бвг", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    filters = language_id.train(docs, F.col("doc_id") < 800)
    assert filters.langs == ["en", "zh"]
    out = {x["doc"]: (x["lang"], x["score"]) for x in language_id.predict(docs, filters).collect()}
    assert all(out[k][0] == lang for k, _, lang in rows[800:-1])
    assert out[5000][0] in filters.langs


def plain_ngrams(text):
    shown = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "") + " "
    middles = [i for i in range(1, len(shown) - 1) if shown[i] != " "]
    return [shown[i - 1:i + 2] for i in middles], [shown[i] for i in middles]


def plain_languages(rows, learn):
    """Exact sets in place of the filters: language of every text."""
    counts = defaultdict(Counter)
    for doc, text, lang in rows:
        if learn(doc) and lang is not None:
            for grams in plain_ngrams(text):
                counts[lang].update(grams)
    held = {}
    for lang, found in counts.items():
        held[lang] = set()
        for size in (1, 3):
            own = {g: n for g, n in found.items() if len(g) == size}
            levels = Counter()
            for n in own.values():
                levels[math.floor(math.log2(n) * 16)] += n
            covered = 0
            for level in sorted(levels, reverse=True):
                if covered >= language_id.COVERAGE * sum(own.values()):
                    break
                covered += levels[level]
                held[lang] |= {g for g, n in own.items() if math.floor(math.log2(n) * 16) == level}
    out = {}
    for doc, text, _ in rows:
        grams, letters = plain_ngrams(text)
        tally = {lang: sum(g in held[lang] for g in grams) + language_id.LETTER_WEIGHT * sum(c in held[lang] for c in letters) for lang in sorted(held)}
        out[doc] = max(tally, key=tally.get) if grams else "und"
    return out


def test_languages_equal_exact_sets(spark):
    sounds = {"aa": "ka te mi so", "bb": "wor ung che ist", "cc": "eau que ment ère"}
    r, rows = random.Random(9), []
    for k in range(300):
        lang = r.choice(list(sounds))
        rows.append((k, " ".join("".join(r.choice(sounds[r.choice([lang, lang, lang, "aa"])].split()) for _ in range(3)) for _ in range(r.randint(1, 40))), lang))
    rows += [(400, None, "aa"), (401, "12 ,", "bb"), (402, "İıẞ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc"]: x["lang"] for x in language_id.predict(docs, language_id.train(docs, F.col("doc_id") % 4 != 2)).collect()}
    expected = plain_languages(rows, lambda d: d % 4 != 2)
    assert sum(got[k] == expected[k] for k in got) >= len(got) - 2  # the filters' false positives
    assert got[400] == got[401] == "und"


def test_forgotten_words_are_encoded_alike(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 20)
    with open(token_files.default_tokenizer(), encoding="utf-8") as file:
        encoder = token_files.WordEncoder(file.read(), "<u2")
    texts = [prose(k % 4, 40) + f" word{k}, x" for k in range(30)]
    # letters that become a letter and a sign, letters of two and three bytes, and signs that belong to what follows them
    texts += ["İ,İ. é,É. ñ!? ж; слово, 中, a…, x×, ÷.", "x" + "," * 50, ",.;:!?", "it's, 's. <|endoftext|>, e\u0301, a1. 2²,", "", "ß" * 9 + ".,"]
    for some in (texts[:3], texts[3:9], texts[9:10], texts[10:]):
        for text, found in zip(some, encoder.encode([t.encode() for t in some], b"\x01\x00")):
            ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert list(memoryview(found).cast("H")) == [*ids, 1]
    assert len(encoder.words) < 400


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Eighty signs, each in a few texts: groups of 300 rows must all count, in the features as in the thresholds."""
    r = random.Random(4)
    signs = ["zq" + "".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(80)]
    rows = [(k, prose(k, 12) + (" " + signs[k // 3 % 80] if k % 3 == 0 else ""), "xx" if k < 1800 else "yy") for k in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), sample_rows=300)
    assert (model.network.rows([s.encode() for s in signs])[1:, 0] > 0).all()
    assert set(model.thresholds) == {None, "xx", "yy"}
    scores = {x["doc"]: x["score"] for x in model.score(docs).collect()}
    assert sum((s >= toxicity.CUT) == (k % 3 == 0) for k, s in scores.items()) > 0.97 * len(rows)
    again = toxicity.train(docs.repartition(5), labels, F.lit(True), sample_rows=300)
    assert (again.network.embeddings == model.network.embeddings).all() and again.thresholds == model.thresholds
