import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlake.llm import collocations
from ledgerlake.llm.collocations import Mining


def plain_counts(rows, longest=5):
    """{(lang, phrase): f} and {lang: n} by splitting and counting."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, " ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return counts, totals


def plain_collocations(rows, support, top):
    counts, totals = plain_counts(rows)
    frequent = {k: f for k, f in counts.items() if f >= support}
    covers = Counter()
    for (lang, phrase), f in frequent.items():
        words = phrase.split(" ")
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = lang, " ".join(words[i : i + k])
                covers[part] = max(covers[part], f)
    found = []
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        if len(words) < 2 or covers[lang, phrase] >= a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, phrase, a, left, right, totals[lang], score))
    found.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place = Counter()
    ranked = []
    for lang, *rest in found:
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], *rest))
    return ranked


def mined(df, mining, top):
    out = collocations.collocations(collocations.count_phrases(df, mining), top, mining)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def sentences(seed, n):
    rng = random.Random(seed)
    words = ["river", "Stone", "of", "the", "ÉTÉ", "new", "york", "city", "hall"]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(30)):
            text.append(rng.choice(words) if rng.random() < 0.8 else "New York City Hall")
            text.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " "]))
        out.append((rng.choice(["en", "fr", None, "", "und"]), "".join(text)))
    return out


def test_equals_counting_everything(spark):
    rows = sentences(1, 600) + [("en", "a b c d e f")] * 40 + [("en", None), (None, ""), ("fr", " \t.")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    for support, shards, top in ((12, 3, 15), (40, 8, 2000), (1, 20, 4)):
        got = mined(df, Mining(support=support, shards=shards), top)
        assert got == sorted(plain_collocations(rows, support, top)), (support, shards)


def test_phrases_spread_over_all_shards_are_found(spark):
    """Each task has too few of them to matter; together they just reach the support."""
    rows = [("en", f"alpha beta gamma w{i} x{i}") for i in range(100)] + [("en", f"delta eta w{i}") for i in range(99)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(50)
    assert [r[2:4] for r in mined(df, Mining(), 10)] == [("alpha beta gamma", 100)]


def test_scores_beyond_64_bits_are_exact(spark):
    rows = [("en", "", 0, 10**13), ("en", "a", 1, 4 * 10**11 + 7), ("en", "b", 1, 3 * 10**11 + 1), ("en", "a b", 2, 3 * 10**11)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words long, f long")
    (row,) = collocations.collocations(counts, 5).collect()
    assert row["score"] == 1000 * (3 * 10**11) * 10**13 // ((4 * 10**11 + 7) * (3 * 10**11 + 1))


def test_awkward_rows_and_clashing_columns(frame, awkward_rows, nothing):
    extra = frame(awkward_rows).withColumns({c: F.lit(1) for c in ("phrase", "words", "f", "n", "gram", "shard")})
    assert mined(extra, Mining(support=2, shards=4), 50) == sorted(plain_collocations([("en", t) for _, t in awkward_rows], 2, 50))
    assert mined(nothing, Mining(), 10) == []


def test_a_long_word_and_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 500)
    monkeypatch.setattr(collocations, "HELD", 800)
    rows = sentences(3, 60) + [("en", "z" * 600_000 + " of the " + "z" * 600_000 + " of the")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert mined(df, Mining(support=4, shards=2), 40) == sorted(plain_collocations(rows, 4, 40))
