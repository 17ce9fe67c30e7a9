"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed text.

**Words** are runs of letters of one script. Each letter with its two neighbours in the word (0 at the ends)
is a feature, hashed to one of 65,536 buckets.

**Learning** counts features and scripts of each language over all usable documents; a task sends its sums,
so the model has at most 65,536 counts and some scripts for each language, however large the corpus is. A
feature's probability is its share, mixed with a little of the uniform one, so that what a language has never
shown costs the same in all of them.

**Labelling.** A word's script leaves the languages that write at least ``MIN_SCRIPT`` of their letters in it
(any that ever used it, if none does); only these are scored, others get less than the worst of them. Viterbi
then finds the labels of all words of a text with the largest sum of scores, less ``PENALTY`` for each change.
It goes through all texts of a portion at once, word by word; portions have a bounded number of letters, and
texts are labelled whole where they are, without a shuffle.

Defined results: a text that is null or without letters has no spans, ``und`` and score 0, and so has every
text if nothing was learned; letters of a script that no language has used leave the choice to their
neighbours, and alone go to the language with the most letters in training; ties go to that order, then to the
name. Rows with a null id and repeated rows are labelled like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import batches_of, mixed

BUCKETS = 1 << 16
UNSEEN = 0.01  # share of the uniform distribution in a feature's probability
PENALTY = 15.0  # of a change of language, in nats
MIN_SCRIPT = 0.01
OUTSIDE = 10.0  # how far below its worst candidate a language outside a word's script is
CHUNK = 1 << 24  # scores of words that a task holds at once: letters times languages

# Unicode code point ranges of scripts, first and last. Other letters are one more script.
SCRIPTS = (
    ("latin", ((0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x0530, 0x058F),)),
    ("hebrew", ((0x0590, 0x05FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x0900, 0x097F), (0xA8E0, 0xA8FF))),
    ("bengali", ((0x0980, 0x09FF),)),
    ("gurmukhi", ((0x0A00, 0x0A7F),)),
    ("gujarati", ((0x0A80, 0x0AFF),)),
    ("tamil", ((0x0B80, 0x0BFF),)),
    ("telugu", ((0x0C00, 0x0C7F),)),
    ("kannada", ((0x0C80, 0x0CFF),)),
    ("malayalam", ((0x0D00, 0x0D7F),)),
    ("sinhala", ((0x0D80, 0x0DFF),)),
    ("thai", ((0x0E00, 0x0E7F),)),
    ("lao", ((0x0E80, 0x0EFF),)),
    ("myanmar", ((0x1000, 0x109F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("ethiopic", ((0x1200, 0x139F), (0x2D80, 0x2DDF))),
    ("khmer", ((0x1780, 0x17FF),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
)


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (0 if it is no letter) and its script (0 if it is no letter)."""
    points = 0x110000
    letter = np.fromiter((chr(c).isalpha() for c in range(points)), bool, points)
    folded = np.where(letter, np.arange(points, dtype=np.uint32), np.uint32(0))
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            folded[c] = ord(low)
    script = np.where(letter, np.uint8(len(SCRIPTS) + 1), np.uint8(0))
    for k, (_, ranges) in enumerate(SCRIPTS):
        for first, last in ranges:
            script[first : last + 1][letter[first : last + 1]] = k + 1
    return folded, script


class Letters:
    """The letters of some texts, their features, and the words that they make."""

    def __init__(self, texts: list[str | None], tables: tuple[np.ndarray, np.ndarray]):
        folded, scripts = tables
        points = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
        script = scripts[points]
        change = np.diff(script, prepend=np.uint8(0), append=np.uint8(0)) != 0
        begins, ends = change[:-1] & (script > 0), change[1:] & (script > 0)
        at = np.flatnonzero(script)
        letter = folded[points[at]].astype(np.uint64)
        before, after = np.roll(letter, 1), np.roll(letter, -1)
        before[begins[at]] = 0
        after[ends[at]] = 0
        key = before << np.uint64(42) | letter << np.uint64(21) | after
        self.bucket = (mixed(key) >> np.uint64(48)).astype(np.int64)
        self.script = script[at]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.word_script = script[self.start]
        sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
        self.text_start = np.cumsum(sizes) - sizes
        bounds = np.searchsorted(self.start, np.append(self.text_start, len(points) + 1))
        self.first_word, self.words = bounds[:-1], np.diff(bounds)


@dataclass
class Model:
    """Languages, most letters first; log probabilities (feature x language); languages of each script."""

    langs: list[str]
    logs: np.ndarray
    candidates: dict[int, np.ndarray]


COUNTS = "lang string, bucket int, n long"


def feature_counts(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): features, and letters of each script at ``BUCKETS`` + script."""
    shared = docs.sparkSession.sparkContext.broadcast(letter_tables())
    width = BUCKETS + len(SCRIPTS) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for name, counts in sums.items():
                there = np.flatnonzero(counts)
                columns = [pa.array([name] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(counts[there])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

        for batch in batches:
            rows: dict[str, list[str | None]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.setdefault(name, []).append(value)
            for name, own in rows.items():
                total = sums.setdefault(name, np.zeros(width, np.int64))
                for first, last in batches_of(own, 1 << 20):
                    letters = Letters(own[first:last], shared.value)
                    total[:BUCKETS] += np.bincount(letters.bucket, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(letters.script, minlength=width - BUCKETS)
                if len(sums) >= 64:
                    yield from send()
                    sums = {}
        yield from send()

    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = known.select(F.col(lang).cast("string"), F.col(text))
    return rows.mapInArrow(run, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows with ``usable`` and a language; at most 65,563 counts a language reach the driver."""
    counts = feature_counts(docs, usable, text, lang).toPandas()
    whole = counts[counts["bucket"] < BUCKETS].groupby("lang")["n"].sum()
    langs = [name for name, _ in sorted(whole.items(), key=lambda x: (-x[1], x[0]))]
    table = np.zeros((BUCKETS + len(SCRIPTS) + 2, len(langs)))
    column = counts["lang"].map({name: k for k, name in enumerate(langs)})
    kept = column.notna()
    table[counts["bucket"][kept], column[kept].astype(int)] = counts["n"][kept]
    share = table[:BUCKETS] / table[:BUCKETS].sum(axis=0)
    written = table[BUCKETS:] / table[BUCKETS:].sum(axis=0)
    candidates = {}
    for script, row in enumerate(written):
        chosen = np.flatnonzero(row >= MIN_SCRIPT)
        candidates[script] = chosen if len(chosen) else np.flatnonzero(row)
    return Model(langs, np.log((1 - UNSEEN) * share + UNSEEN / BUCKETS), candidates)


def word_scores(letters: Letters, model: Model) -> np.ndarray:
    """Score of each word in each language; only the candidates of its script are looked up."""
    scores = np.zeros((len(letters.start), len(model.langs)))
    for script in np.unique(letters.word_script).tolist():
        chosen = model.candidates[script]
        if not len(chosen):
            continue
        own = np.flatnonzero(letters.word_script == script)
        found = model.logs[letters.bucket[letters.script == script][:, None], chosen]
        sizes = letters.end[own] - letters.start[own]
        sums = np.add.reduceat(found, np.cumsum(sizes) - sizes, axis=0)
        scores[own] = sums.min(axis=1, keepdims=True) - OUTSIDE
        scores[own[:, None], chosen] = sums
    return scores


def best_labels(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of all words; text i has ``count[i]`` words from row ``first[i]`` of ``scores`` on.

    All texts go on by one word at a time, the longest first, so those still going are always in front.
    """
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    order = np.argsort(-count, kind="stable")
    count, first = count[order], first[order]
    going = np.searchsorted(-count, -np.arange(int(count[0])), side="left")  # texts with more than t words
    came, moved = np.zeros(len(scores), np.int64), np.zeros(scores.shape, bool)
    value = scores[first[: going[0]]]
    for t in range(1, len(going)):
        n = going[t]
        at, before = first[:n] + t, value[:n]
        top = before.argmax(axis=1)
        switch = before[np.arange(n), top][:, None] - penalty
        moved[at] = before < switch
        came[at] = top
        value[:n] = np.maximum(before, switch) + scores[at]
    state = value.argmax(axis=1)
    for t in range(len(going) - 1, -1, -1):
        n = going[t]
        at, now = first[:n] + t, state[:n]
        labels[at] = now
        state[:n] = np.where(moved[at, now], came[at], now)
    return labels


def _spans(letters: Letters, labels: np.ndarray, texts: int) -> tuple[np.ndarray, ...]:
    """(text, label, start, end) of the runs of words with one label, in code points of their texts."""
    text = np.repeat(np.arange(texts), letters.words)
    new = np.ones(len(labels), bool)
    new[1:] = (np.diff(labels) != 0) | (np.diff(text) != 0)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(labels))[: len(begin)] - 1
    offset = letters.text_start[text[begin]]
    return text[begin], labels[begin], letters.start[begin] - offset, letters.end[last] - offset


def _verdicts(letters: Letters, scores: np.ndarray, labels: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language with the most letters (-1 without letters) and a score for it.

    The score is that language's share of the letters, times its probability against the next best
    language on the words that it labels.
    """
    langs = scores.shape[1]
    text = np.repeat(np.arange(texts), letters.words)
    size = letters.end - letters.start
    share = np.bincount(text * langs + labels, size, texts * langs).reshape(texts, langs)
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    own = labels == best[text]
    lead = np.zeros((texts, langs))
    for k in range(langs):
        lead[:, k] = np.bincount(text[own], scores[own, k], texts)
    winner = lead[np.arange(texts), best]
    lead[np.arange(texts), best] = -np.inf
    odds = winner - lead.max(axis=1) if langs > 1 else np.full(texts, 40.0)
    score = share[np.arange(texts), best] / np.maximum(total, 1) / (1 + np.exp(-np.clip(odds, -40, 40)))
    return np.where(total > 0, best, -1), score


SPAN = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def label(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and ``spans`` (lang, start, end in code points) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((letter_tables(), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, learned = shared.value
        names = np.array([*learned.langs, "und"], object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not learned.langs:
                n = len(texts)
                empty = pa.array([[]] * n, pa.list_(SPAN))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und"] * n, pa.string()), pa.array([0.0] * n, pa.float64()), empty], NAMES)
                continue
            for first, last in batches_of(texts, max(1 << 16, CHUNK // max(4, len(learned.langs)))):
                n = last - first
                letters = Letters(texts[first:last], tables)
                scores = word_scores(letters, learned)
                labels = best_labels(scores, letters.first_word, letters.words, PENALTY)
                best, score = _verdicts(letters, scores, labels, n)
                where, which, start, end = _spans(letters, labels, n)
                fields = [pa.array(names[which], pa.string()), pa.array(start), pa.array(end)]
                offsets = np.searchsorted(where, np.arange(n + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(SPAN)))
                ids = batch.column(0).slice(first, n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(names[best], pa.string()), pa.array(score), spans], NAMES)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)


NAMES = ["id", "lang_pred", "score", "spans"]
