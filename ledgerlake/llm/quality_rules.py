"""Quality rules: base counts, and the divergence of a document from its language's reference.

Everything is one native column expression per document. The only other job is the one that learns
the references: means per language, one row for each language that the corpus holds. This table is
stored, counted and joined back; as long as it is small enough to be broadcast, no document moves.

Defined results: a null text counts as empty; an empty text has no words and fails the base rules.
Characters are compared with the reference of the document's own language, whichever that is; common
words only where the language has a list. What a language has no list or reference for (no language,
an empty table, or no document long enough) is not judged, so that the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import WORD, let, store

# Frequent function words of each language.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with", "as", "be", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist", "im", "dem", "ein"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "su"),
}
# Character classes, each counted among what the earlier ones have left.
CHARACTER_CLASSES: tuple[tuple[str, str], ...] = (
    ("lower", r"[a-z]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("other_script", r"[^\x00-\x7F]+"),
    ("upper", r"[A-Z]+"),
    ("stop", r"[.,;:?'\"()-]+"),
    ("symbol", r"[#*$%&|<>]+"),
    ("digit", r"[0-9]+"),
)
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """The method's parameters: distances beyond which a document goes, and the lengths they need.

    A Jensen-Shannon distance is the root of the divergence in bits, from 0 to 1. Small samples lie
    far from any reference by chance, so a histogram only counts from so many words on.
    """

    max_character_distance: float = 0.3
    max_word_distance: float = 0.27
    min_words_for_characters: int = 40
    min_words_for_common: int = 100


Reference = tuple[list[float], list[float]]  # shares of the character classes, of the common words


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _class_counts(text: Column) -> Column:
    """Characters in each class, then the rest. Each class is cut out before the next is counted."""

    def after(left: Column, classes: Sequence[tuple[str, str]], counts: list[Column]) -> Column:
        if not classes:
            return F.array(*counts, F.length(left))
        return let(
            F.regexp_replace(left, F.lit(classes[0][1]), F.lit("")),
            lambda rest: after(rest, classes[1:], [*counts, F.length(left) - F.length(rest)]),
        )

    return after(text, CHARACTER_CLASSES, [])


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a window of five words which the text has at least twice.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Sorting (hash, place) puts
    equal windows side by side, so the work is n log n however often a text repeats itself.
    """
    size = F.size(words)

    def covered(windows: Column) -> Column:
        return let(
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.aggregate(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)),
                        ),
                        lambda x: x["i"],
                    )
                ),
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct(
                    (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")
                ),
                lambda a: a["n"],
            ),
        )

    repeated = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(
            F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
            ),
            lambda windows: F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
                covered(windows)
            ),
        ),
    )
    return F.when(size < WINDOW, F.lit(0)).otherwise(repeated)


def _measures(text: Column, common: Column, limits: Limits) -> Column:
    """All that is counted in a text, in one go: the base figures, characters by class, common words."""

    def counted(t: Column, words: Column, classes: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        names = [name for name, _ in CHARACTER_CLASSES]
        frequent = F.when((F.size(words) >= limits.min_words_for_common) & common.isNotNull(), _common_counts(words, common))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(t) - classes[names.index("space")]).cast("long").alias("word_chars"),
            classes[names.index("symbol")].cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_window_words(words).cast("long").alias("n_repeat_words"),
            F.when(F.size(words) >= limits.min_words_for_characters, classes).alias("classes"),
            frequent.alias("frequent"),
        )

    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(_words(t), lambda w: let(_class_counts(t), lambda classes: counted(t, w, classes))),
    )


def _shares(counts: Column) -> Column:
    return let(
        F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x),
        lambda total: F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))),
    )


def _common_counts(words: Column, common: Column) -> Column:
    """How often each common word occurs, then all other words."""
    return let(
        F.filter(F.transform(words, F.lower), lambda w: F.array_contains(common, w)),
        lambda hits: F.concat(
            F.transform(common, lambda c: F.size(F.filter(hits, lambda w: w == c)).cast("long")),
            F.array((F.size(words) - F.size(hits)).cast("long")),
        ),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, in bits."""

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    total = F.aggregate(
        F.zip_with(p, q, lambda a, b: let((a + b) / 2, lambda m: (term(a, m) + term(b, m)) / 2)),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _literal(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _own_words(lang: Column, languages: Mapping[str, Sequence[str]]) -> Column:
    """The language's common words; null where it has no list."""
    return reduce(
        lambda rest, name: F.when(lang == name, _literal(languages[name])).otherwise(rest),
        languages,
        F.lit(None).cast("array<string>"),
    )


def measured(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    languages: Mapping[str, Sequence[str]] = COMMON_WORDS,
    limits: Limits = Limits(),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (the columns in ``keep``; all by default), ``own`` (its language) and ``m`` (``_measures``) of each document."""
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)])
    own = F.col(lang)
    return docs.select(row.alias("row"), own.alias("own"), _measures(F.col(text), _own_words(own, languages), limits).alias("m"))


def references_of(counted: DataFrame, languages: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """Mean shares over every long enough document of each language present: language, characters, frequent.

    Partial sums; each document weighs the same. ``frequent`` is null for languages without a list, and either
    is null where no document is long enough.
    """
    shares = counted.where("own IS NOT NULL").select("own", _shares(F.col("m.classes")).alias("c"), _shares(F.col("m.frequent")).alias("w"))
    longest = max(map(len, languages.values()), default=0) + 1
    means = shares.groupBy(F.col("own").alias("language")).agg(
        F.array(*[F.avg(F.get("c", F.lit(i))) for i in range(len(CHARACTER_CLASSES) + 1)]).alias("c"),
        F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(longest)]).alias("w"),
    )

    def learned(found: str) -> Column:
        return F.when(F.get(found, F.lit(0)).isNotNull(), F.filter(found, lambda x: x.isNotNull()))

    return means.select("language", learned("c").alias("characters"), learned("w").alias("frequent"))


def reference_table(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    languages: Mapping[str, Sequence[str]] = COMMON_WORDS,
    limits: Limits = Limits(),
) -> DataFrame:
    return references_of(measured(docs, text, lang, languages, limits, keep=[lang]), languages)


def learn_references(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    languages: Mapping[str, Sequence[str]] = COMMON_WORDS,
    limits: Limits = Limits(),
) -> dict[str, Reference]:
    """The references of the given languages, as many as the corpus holds."""
    listed = docs.where(F.col(lang).isin(*languages))
    rows = reference_table(listed, text, lang, languages, limits).collect()  # at most one row for each given language
    return {row["language"]: (row["characters"] or [], row["frequent"] or []) for row in rows}


def _divergent(m: Column, reference: tuple[Column, Column], limits: Limits) -> Column:
    characters, frequent = reference
    by_characters = js_distance(_shares(m["classes"]), characters) > limits.max_character_distance
    by_words = js_distance(_shares(m["frequent"]), frequent) > limits.max_word_distance
    return (
        F.when(m["classes"].isNotNull() & characters.isNotNull(), by_characters).otherwise(F.lit(False))
        | F.when(m["frequent"].isNotNull() & frequent.isNotNull(), by_words).otherwise(F.lit(False))
    )


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(measures: Column, reference: tuple[Column, Column], limits: Limits) -> Column:
    return let(
        measures,
        lambda m: let(
            F.struct(
                ((m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])).alias("failed"),
                _divergent(m, reference, limits).alias("divergent"),
            ),
            lambda v: F.struct(
                *[m[n].alias(n) for n in FIGURES],
                v["failed"].alias("base_failed"),
                v["divergent"].alias("divergent"),
                (~v["failed"] & ~v["divergent"]).alias("kept"),
            ),
        ),
    )


def assess(
    text: Column,
    lang: Column,
    references: Mapping[str, Reference],
    languages: Mapping[str, Sequence[str]] = COMMON_WORDS,
    limits: Limits = Limits(),
) -> Column:
    """A struct for each document, by given references: the base counts, base_failed, divergent, kept."""

    def own(part: int) -> Column:
        known = [name for name, reference in references.items() if reference[part]]
        return reduce(
            lambda rest, name: F.when(lang == name, _literal(references[name][part])).otherwise(rest),
            known,
            F.lit(None).cast("array<double>"),
        )

    return _judged(_measures(text, _own_words(lang, languages), limits), (own(0), own(1)), limits)


def assessed(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    languages: Mapping[str, Sequence[str]] = COMMON_WORDS,
    limits: Limits = Limits(),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Documents as one column, ``row``, beside their assessment ``q`` by the references that they teach.

    Every text is worked through once: what was counted is stored with the columns to ``keep``, teaches the
    references, and is judged by them.
    """
    counted = store(measured(docs, text, lang, languages, limits, keep))
    references = store(references_of(counted, languages))
    references = broadcast_if_small(references, references.count())
    rows = counted.join(references, F.col("own") == F.col("language"), "left")
    return rows.select("row", _judged(F.col("m"), (F.col("characters"), F.col("frequent")), limits).alias("q"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return assessed(docs, text, lang, **options).where("q.kept").select("row.*")
