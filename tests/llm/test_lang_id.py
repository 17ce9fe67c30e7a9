import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import lang_id

SYLLABLES = {
    "en": ["th", "ing", "er", "wh", "ou"],
    "de": ["sch", "ung", "ein", "keit", "ü"],
    "el": ["λο", "γος", "και", "τη"],
    "ru": ["при", "ство", "ник", "ого"],
    "sr": ["љу", "ђе", "ство", "ица"],
}


def text_in(lang, words, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def training(spark):
    rows = [(i, text_in(lang, 60, i), lang) for lang in SYLLABLES for i in range(20)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "und hier", None), (503, "12 34", "xx"), (None, "wh" * 30, "zz")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(training):
    return lang_id.learn(training, F.col("doc_id").isNotNull())


def labelled(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for _, r in sorted((r["doc_id"], r) for r in lang_id.label(df, model).collect())]


def test_counts_are_those_of_the_letters(training, model):
    counts = lang_id.feature_counts(training, F.lit(True)).toPandas()
    letters = {}
    for r in training.where("lang IS NOT NULL AND text IS NOT NULL").collect():
        letters[r["lang"]] = letters.get(r["lang"], 0) + sum(c.isalpha() for c in r["text"])
    for part in (counts[counts["bucket"] < lang_id.BUCKETS], counts[counts["bucket"] >= lang_id.BUCKETS]):
        assert part.groupby("lang")["n"].sum().to_dict() == {k: v for k, v in letters.items() if v}
    assert sorted(model.langs) == sorted(SYLLABLES)


def test_spans_of_mixed_texts(spark, model):
    parts = [("en", 30), ("de", 25), ("el", 12), ("sr", 20), ("ru", 20), ("en", 9)]
    pieces = [text_in(lang, n, 999) for lang, n in parts]
    (row,) = labelled(spark, model, ["7 " + ". ".join(pieces)])
    at, expected = 2, []
    for (lang, _), piece in zip(parts, pieces, strict=True):
        expected.append((lang, at, at + len(piece)))
        at += len(piece) + 2
    assert [tuple(s) for s in row["spans"]] == expected
    assert row["lang_pred"] == "en" and 0 < row["score"] < 1


def test_one_foreign_word_is_no_span_of_its_own(spark, model):
    (row,) = labelled(spark, model, [text_in("en", 20, 5) + " und " + text_in("en", 20, 6)])
    assert len(row["spans"]) == 1 and row["lang_pred"] == "en" and row["score"] > 0.99


def test_scripts_narrow_the_candidates(spark, model):
    of = {name: set(model.langs[k] for k in model.candidates[s + 1]) for s, (name, _) in enumerate(lang_id.SCRIPTS)}
    assert of["latin"] == {"en", "de"} and of["greek"] == {"el"} and of["cyrillic"] == {"ru", "sr"} and not of["hebrew"]
    rows = labelled(spark, model, ["ολα", "שלום עולם", "שלום " + text_in("ru", 9, 1)])
    assert [r["lang_pred"] for r in rows] == ["el", model.langs[0], "ru"]
    assert len(rows[2]["spans"]) == 1


def plain_best(scores, penalty):
    """The best path of a few words by trying all."""
    langs = range(scores.shape[1])
    value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in itertools.product(langs, repeat=len(scores)))


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(3)
    count = np.array([4, 0, 1, 6, 3, 0, 6, 2])
    first = np.cumsum(count) - count
    for penalty in (0.0, 1.0, 4.0):
        scores = rng.normal(0, 3, (count.sum(), 3))
        labels = lang_id.best_labels(scores, first, count, penalty)
        for a, n in zip(first, count, strict=True):
            own, path = scores[a : a + n], labels[a : a + n]
            got = own[np.arange(n), path].sum() - penalty * (np.diff(path) != 0).sum()
            assert n == 0 or math.isclose(got, plain_best(own, penalty))
    assert not len(lang_id.best_labels(np.zeros((0, 3)), np.zeros(2, int), np.zeros(2, int), 1.0))


def test_word_scores_are_sums_over_the_letters(model):
    texts = ["Thing ΛΌΓΟΣ", None, "ein-Schung1wh"]
    tables = lang_id.letter_tables()
    letters = lang_id.Letters(texts, tables)
    words = ["thing", "λόγος", "ein", "schung", "wh"]
    assert letters.words.tolist() == [2, 0, 3]
    single = [lang_id.word_scores(lang_id.Letters([w], tables), model)[0] for w in words]
    single[1] = lang_id.word_scores(lang_id.Letters(["λόγοσ"], tables), model)[0]  # capitals know no final form
    assert np.allclose(lang_id.word_scores(letters, model), single)


def test_awkward_rows(awkward, nothing, training, model, monkeypatch):
    rows = {r["doc_id"]: r for r in lang_id.label(awkward, model).collect()}
    assert len(rows) == awkward.count()
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {0, 1, 2, 14}
    assert all(r["score"] == 0 and not r["spans"] for r in rows.values() if r["lang_pred"] == "und")
    assert rows[5][1:] == rows[6][1:] and rows[11][1:] == rows[12][1:] and rows[10]["spans"][0]["end"] == 60_000
    assert lang_id.label(nothing, model).count() == 0
    monkeypatch.setattr(lang_id, "CHUNK", 1 << 18)
    again = {r["doc_id"]: r for r in lang_id.label(awkward, model).collect()}
    assert again == rows
    none = lang_id.learn(training, F.lit(False))
    assert {r["lang_pred"] for r in lang_id.label(awkward, none).collect()} == {"und"}
    nulls = awkward.withColumn("doc_id", F.lit(None).cast("string"))
    assert lang_id.label(nulls, model).where("doc_id IS NULL").count() == awkward.count()


def test_held_out_documents(spark):
    from ledgerlake.llm.queries import op12_language_id

    sf = "/root/testdata/sf0.001"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in op12_language_id(spark, sf).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows)
    assert len(rows) > 20 and right >= 0.95 * len(rows)
