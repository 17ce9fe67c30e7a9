"""Phrase collocations, mined by partitions: locally frequent phrases are candidates, then counted exactly.

**Shards.** The tasks that scan the documents are dealt to a fixed number of shards. A phrase seen ``support``
times in a language is seen at least ``ceil(support / shards)`` times in one of them, however uneven they are:
with fewer everywhere it would have at most ``shards * (ceil(support / shards) - 1) < support`` occurrences.
Each shard is mined completely at that local support, words and pairs first. Longer phrases are only counted
where every pair in them is locally frequent in some shard, which holds for all that can reach the support.

**Candidates** are the union over shards. They come to the counting tasks as a bitmap of fixed size, whose
false hits cost time and no results: phrases are counted by their texts, over all documents, and those below
``support`` are dropped.

Tasks add up 64-bit hashes in numpy and send one row for each distinct phrase of some millions of places, so
a common phrase or one hot language is summed before any shuffle. Memory is bounded by the longest text.

**Scores.** All parts of a frequent phrase are frequent, so their counts are in the same table. Products are
decimals of 38 digits, exact up to 10^17 words a language.

Defined results: null texts are empty; a null language is ``und``; equal rows count as often as they are
there; texts without words count nothing; no candidates give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import FILTER_BITS, partitions, store
from .shingles import SEGMENT, Powers, batches_of, gram_hashes, mixed

BREAK, BLANK = 10, 32
_BREAKS = b".,;:!?\n\x0b\x0c\r"
# Bytes of a text: A-Z in lower case, one byte for all that ends a piece, one for blanks.
TABLE = bytes(BREAK if c in _BREAKS else BLANK if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = 1 << 20  # characters that are cut into words at once
HELD = 1 << 22  # phrases that a task adds up before it sends them on
ROWS = 1 << 16


@dataclass(frozen=True)
class Mining:
    """``support`` occurrences in a language make a phrase of ``shortest`` to ``longest`` words a candidate."""

    support: int = 100
    shortest: int = 2
    longest: int = 5
    shards: int = 8

    @property
    def local_support(self) -> int:
        return -(-self.support // self.shards)


class Words:
    """Words of some texts in order: where they are, their hashes, and the piece that each is in."""

    def __init__(self, texts: list[str | None], powers: Powers, seed: int):
        data = np.frombuffer(b"\n".join(t.encode() if t else b"" for t in texts).translate(TABLE), np.uint8)
        blank = data == BLANK
        data = self.data = data[~(blank & np.append(False, blank[:-1]))] if len(data) else data  # one blank between words
        inside = (data != BREAK) & (data != BLANK)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(data == BREAK), self.start)
        self.seed = np.uint64(seed)
        self.hash = np.empty(len(self.start), np.uint64)
        first = 0
        while first < len(self.start):  # running sums over some 256 kB, or over one longer word
            stop = max(first + 1, int(np.searchsorted(self.end, self.start[first] + SEGMENT)))
            at, to = int(self.start[first]), int(self.end[stop - 1])
            up, down = powers.reach(to - at + 1)
            sums = np.zeros(to - at + 1, np.uint64)
            np.cumsum((data[at:to].astype(np.uint64) + np.uint64(1)) * up[: to - at], out=sums[1:])
            a, b = self.start[first:stop] - at, self.end[first:stop] - at
            self.hash[first:stop] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            first = stop

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``size`` words within a piece."""
        if len(self.hash) < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.piece[: len(self.piece) - size + 1] == self.piece[size - 1 :])
        return at, mixed(gram_hashes(self.hash, size)[at] ^ self.seed)

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """Texts of the runs of ``size`` words that begin at words ``at``."""
        first, length = self.start[at], self.end[at + size - 1] - self.start[at]
        offsets = np.append(0, np.cumsum(length))
        places = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], length)
        buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[places])]
        return pa.Array.from_buffers(pa.string(), len(at), buffers)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


def _chunks(batch: pa.RecordBatch, powers: Powers) -> Iterator[tuple[str, Words]]:
    """The texts of a batch, by language and in bounded portions."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    rows: dict[str, list[str | None]] = {}
    for lang, text in zip(langs, texts, strict=True):
        rows.setdefault(lang, []).append(text)
    for lang, own in rows.items():
        for first, last in batches_of(own, CHUNK):
            yield lang, Words(own[first:last], powers, _seed(lang))


class Filter:
    """A bitmap of hashes: two bits for each, from its lowest and its highest digits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        both = np.ones(len(hashes), bool)
        for bit in (hashes & np.uint64(FILTER_BITS - 1), hashes >> np.uint64(64 - FILTER_BITS.bit_length() + 1)):
            both &= (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return both


def _bitmap(grams: DataFrame) -> np.ndarray:
    """The filter of a column ``gram``; 8 MB come to the driver, whatever the number of rows."""
    low = F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("gram", 64 - FILTER_BITS.bit_length() + 1)
    blocks = (
        grams.select(F.explode(F.array(low, high)).alias("bit"))
        .groupBy(F.floor(F.col("bit") / 32768).alias("block"))
        .agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    )
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in blocks.collect():
        whole[row["block"] * 4096 : row["block"] * 4096 + 4096] = np.frombuffer(row["bits"], np.uint8)
    return whole


def _distinct(held: list[np.ndarray], shard: int) -> Iterator[pa.RecordBatch]:
    grams, counts = np.unique(np.concatenate(held), return_counts=True)
    for a in range(0, len(grams), ROWS):
        part = grams[a : a + ROWS].view(np.int64)
        columns = [pa.array(np.full(len(part), shard)), pa.array(part), pa.array(counts[a : a + ROWS])]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "gram", "n"])


def _later(flags: np.ndarray, by: int) -> np.ndarray:
    """What is true ``by`` places further on."""
    return np.append(flags[by:], np.zeros(min(by, len(flags)), bool))


def _shard_counts(rows: DataFrame, mining: Mining, places: Callable[[Words], Iterator[np.ndarray]]) -> DataFrame:
    """(gram): hashes of all phrases that are locally frequent in a shard, among those at ``places``."""
    shards = mining.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, powers = TaskContext.get().partitionId() % shards, Powers()
        held, size = [], 0
        for batch in batches:
            for _, words in _chunks(batch, powers):
                for grams in places(words):
                    held.append(grams)
                    size += len(grams)
                if size >= HELD:
                    yield from _distinct(held, shard)
                    held, size = [], 0
        if held:
            yield from _distinct(held, shard)

    counts = rows.mapInArrow(run, "shard long, gram long, n long").groupBy("shard", "gram").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= mining.local_support).select("gram")


def _phrase_counts(rows: DataFrame, mining: Mining, shared) -> DataFrame:
    """Exact counts by text of the phrases that the filter lets through; the phrase '' counts all words.

    A task holds one portion of its texts at a time and sends what it counted there; the sums over a task's
    portions and then over tasks are the engine's.
    """

    def counted(lang: str, phrases: pa.Array, words: int, f: np.ndarray) -> pa.RecordBatch:
        same = [pa.array([value]).take(pa.array(np.zeros(len(phrases), np.int32))) for value in (lang, words)]
        return pa.RecordBatch.from_arrays([same[0], phrases, same[1], pa.array(f)], ["lang", "phrase", "words", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, wanted = Powers(), Filter(shared.value)
        for batch in batches:
            for lang, words in _chunks(batch, powers):
                if len(words.hash):
                    yield counted(lang, pa.array([""]), 0, np.array([len(words.hash)]))
                before = None
                for size in range(1, mining.longest + 1):
                    at, grams = words.grams(size)
                    hit = wanted.has(grams)
                    if before is not None:  # both shorter phrases have to be there
                        hit &= before[at] & before[at + 1]
                    before = np.zeros(len(words.hash) + 1, bool)
                    before[at[hit]] = True
                    _, where, f = np.unique(grams[hit], return_index=True, return_counts=True)
                    if len(f):
                        yield counted(lang, words.phrases(at[hit][where], size), size, f)

    parts = rows.mapInArrow(run, "lang string, phrase string, words long, f long")
    total = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return total.where((F.col("f") >= mining.support) | (F.col("words") == 0))


def count_phrases(docs: DataFrame, mining: Mining = Mining(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words with the support, stored.

    The row with the empty phrase and 0 words holds the number of all words of its language.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def short(words: Words) -> Iterator[np.ndarray]:
        for size in (1, 2):
            yield words.grams(size)[1]

    found = store(_shard_counts(rows, mining, short).distinct())
    if mining.longest > 2:
        pairs = context.broadcast(_bitmap(found))

        def long(words: Words) -> Iterator[np.ndarray]:
            at, grams = words.grams(2)
            pair = np.zeros(len(words.hash) + 1, bool)
            pair[at[Filter(pairs.value).has(grams)]] = True
            all_pairs = pair
            for size in range(3, mining.longest + 1):
                all_pairs = all_pairs & _later(pair, size - 2)
                at, grams = words.grams(size)
                yield grams[all_pairs[at]]

        found = found.unionByName(store(_shard_counts(rows, mining, long).distinct()))
    return store(_phrase_counts(rows, mining, context.broadcast(_bitmap(found))))


def _best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]


def _top(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, ranked; a language's rows are thinned in portions before they meet."""
    portion = F.pmod(F.xxhash64("phrase"), F.lit(partitions(scored))).alias("portion")
    near = Window.partitionBy("lang", "portion").orderBy(*_best_first())
    kept = scored.withColumn("portion", portion).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*_best_first())
    return kept.drop("portion").withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)


def collocations(counts: DataFrame, top: int, mining: Mining = Mining()) -> DataFrame:
    """Each language's ``top`` phrases of ``count_phrases`` by the score of their weakest cut.

    A phrase that is nowhere outside one that is a word longer is left out (by counts, a phrase within a
    longer one that is as frequent is within one of one word more that is so too).
    """
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("words > 0")
    words = F.split("phrase", " ")
    part = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    candidates = known.where(F.col("words") >= mining.shortest).select("lang", "phrase", "words", F.col("f").alias("a"))
    longer = candidates.where(F.col("words") > mining.shortest).select(
        "lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "a"
    )
    covers = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    open_ = candidates.join(covers, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("a")))
    cuts = open_.drop("within").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cuts = cuts.join(broadcast_if_small(totals, totals.count()), "lang")
    whole = lambda name: F.col(name).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n"))
    cuts = cuts.withColumn("under", whole("l") * whole("r")).withColumn("score", F.expr("over div under"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    return _top(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
