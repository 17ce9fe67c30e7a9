import random
import re

from pyspark.sql import functions as F

from ledgerlake.llm import quality_rules as Q

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words, text = WORD.findall(text or ""), text or ""
    seen, repeated = {}, [False] * len(words)
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                repeated[i : i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, again = len(words), sum(repeated)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), again, n < 10 or 100 * again > 20 * n)


def assessed(df, references):
    rows = df.select("doc_id", Q.assess(F.col("text"), F.col("lang"), references).alias("q")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return {r["doc_id"]: (tuple(r["q"][n] for n in names), r["q"]["kept"]) for r in rows}


def test_base_figures_of_awkward_and_random_texts(frame, awkward_rows):
    rng = random.Random(5)
    more = ["".join(rng.choice("ab \n#$") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = awkward_rows + list(enumerate(more, 100))
    got = assessed(frame(rows), {})
    assert {i: g[0] for i, g in got.items()} == {i: base(t) for i, t in rows}
    assert all(kept == (not figures[-1]) for figures, kept in got.values())  # no reference: the base rules decide


def test_divergent_texts_go_and_plain_ones_stay(frame):
    rng = random.Random(8)
    common = Q.COMMON_WORDS["en"]
    made = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]

    def plain():
        return " ".join(rng.choice(common if rng.random() < 0.3 else made) for _ in range(250)) + "."

    symbols = " ".join(w + "$$$" for w in plain().split())
    loud = plain().upper()
    bare = " ".join(rng.choice(made) for _ in range(300))
    rows = list(enumerate([plain() for _ in range(40)] + [symbols, loud, bare]))
    kept = sorted(r["doc_id"] for r in Q.keep_good(frame(rows)).collect())
    assert kept == list(range(40))


def test_unknown_languages_meet_every_reference(frame):
    rows = [(i, prose(i, 120)) for i in range(6)]
    references = Q.learn_references(frame(rows))
    assert set(references) == {"en"}
    for lang in ("en", None, "xx"):
        assert all(kept for _, kept in assessed(frame(rows, lang), references).values())


def test_each_language_is_judged_by_its_own_characters_or_not_at_all(frame):
    rng = random.Random(9)
    letters = {"ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "ar": range(0x627, 0x64B), "nl": range(97, 123)}

    def plain(lang):
        words = ["".join(chr(rng.choice(letters[lang])) for _ in range(rng.randrange(2, 9))) for _ in range(150)]
        return " ".join(words) + "."

    docs = frame([(i, prose(i, 120)) for i in range(6)])
    for k, lang in enumerate(letters):
        first = 100 * k + 100
        docs = docs.unionByName(frame([(first + i, plain(lang)) for i in range(12)], lang))
    docs = docs.unionByName(frame([(600, plain("ru")), (601, plain("nl"))], None))
    docs = docs.unionByName(frame([(700, " ".join(w + "$$$" for w in plain("ru").split())), (701, "$ " * 8)], "ru"))
    kept = {r["doc_id"] for r in Q.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - {700, 701}


def test_empty_table_and_all_columns(nothing, awkward):
    assert Q.learn_references(nothing) == {}
    assert Q.keep_good(nothing).count() == 0
    assert Q.keep_good(awkward).columns == awkward.columns
