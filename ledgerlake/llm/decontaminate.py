"""Benchmark decontamination by latent semantic retrieval.

**Space.** Words are hashed to a fixed number of features and weighted by inverse document frequency. A passage is
the weighted sum of its words. The leading right singular vectors of all passages of the corpus come from a
randomised SVD: each task multiplies its passages with a fixed random matrix and back (Y = A'A Omega), the tasks'
matrices of fixed size are added up, and an orthonormal basis of Y spans the space.

**Search.** Passages have about an item's length and start every sixth of it, so one of them lies within a
twelfth of any copy. Passages that cannot leak are skipped: a leak lacks at most a fixed number of the item's words,
so it holds at least so many of any larger set of them, and an inverted index of the items' rarest words gives the
places where that many lie within a passage's reach. All other passages are compared with the item by cosine, and
those of at least ``COSINE`` are its candidates. Sums of words between two places are differences of running sums, so
overlapping passages cost no more than words do.

**Checks.** A candidate is a leak if the longest common subsequence of the item's words and the passage's (and a few
words around it) has 80 % of the item, or 60 % with the item's answer, its last sentence, word for word.

Items are broadcast in blocks of a fixed number; all statistics cover all documents. No document leaves its task.

Defined results: null and empty texts and items leak nothing; an item with fewer than ``LEAST_WORDS`` words is too
short to tell and is never reported; items that repeat are all reported; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, store, without
from .shingles import Powers, batches_of, hashed_words

FEATURES = 1 << 14
RANK = 32
WHITENING = 1.5  # power of the singular values that axes are divided by, so that frequent words do not rule
SLICES = 64
SEED = 20
LEAST_WORDS = 8
PASSAGE = 40  # words of the passages that the space is learned from
LENGTHS = (*range(8, 21), 22, 24, 27, 30, 34, 38, 43, 49, 56, 64, 74, 86, 104, 125)
MOST_WORDS = 128  # longer items are searched for in parts
COSINE = 0.4
SHARE, SHARE_WITH_ANSWER = 0.8, 0.6
RARE_WORDS = 4  # of an item's rarest words that a passage must hold to be compared at all
BLOCK_ITEMS = 10_000
WORDS_AT_ONCE = 50_000
CHARACTERS_AT_ONCE = 50_000

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Letters and digits only, A-Z in lower case; other ASCII characters part words."""
    return text.encode().translate(_PLAIN).split() if text else []


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FEATURES - 1)).astype(np.int64)


def _blocks(texts: list[str | None], powers: Powers) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The rows with words and their words' hashes, some at a time; a long document is a block of its own."""
    for first, last in batches_of(texts, CHARACTERS_AT_ONCE):
        hashes = hashed_words(texts[first:last], powers, _PLAIN)
        rows = [i for i, h in enumerate(hashes) if len(h)]
        if rows:
            yield [first + i for i in rows], [hashes[i] for i in rows]


def _passages(hashes: list[np.ndarray]) -> np.ndarray:
    """Starts, in the documents' joined words, of passages that follow one another."""
    begins = np.cumsum([0, *map(len, hashes[:-1])])
    return np.concatenate([np.arange(b, b + len(h), PASSAGE) for b, h in zip(begins, hashes, strict=True)])


def latent_space(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """FEATURES x RANK: each feature's weight times its row of an orthonormal basis, axes of small
    singular values stretched; and the weights.

    One pass. With A the passages (rows of word counts, of unit length) and W the features' weights, the weighted
    passages are AW. Y = W A'(A Omega) samples the range of (AW)', with A Omega as the test matrix, so the weights
    can be counted in the same pass and applied to the sum.
    """
    random = np.random.default_rng(SEED).standard_normal((FEATURES, RANK)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(random)
    height = FEATURES // SLICES

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, powers = shared.value, Powers()
        total = np.zeros((FEATURES, RANK + 2))  # the product, then document frequencies, then documents
        for batch in batches:
            for _, hashes in _blocks(batch.column(0).to_pylist(), powers):
                feature = _features(np.concatenate(hashes))
                starts = _passages(hashes)
                sizes = np.diff(np.append(starts, len(feature)))
                product = np.add.reduceat(omega[feature], starts, axis=0) / sizes[:, None].astype(np.float32)
                order = np.argsort(feature.astype(np.uint16), kind="stable")
                ordered = feature[order]
                changes = np.diff(ordered, prepend=-1) != 0
                first = np.flatnonzero(changes)
                passage = np.repeat(np.arange(len(starts)), sizes)[order]
                document = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
                once = changes | (np.diff(document, prepend=-1) != 0)
                total[ordered[first], :RANK] += np.add.reduceat(product[passage], first, axis=0)
                total[ordered[first], RANK] += np.add.reduceat(once, first, dtype=np.int64)
                total[0, RANK + 1] += len(hashes)
        parts = total.reshape(SLICES, -1).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["slice", "part"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "part"]
        )

    schema = "slice int, part binary"
    added = docs.select(text).mapInArrow(multiply, schema).repartition("slice").mapInArrow(add, schema)
    total = np.zeros((FEATURES, RANK + 2))
    for row in added.collect():  # SLICES rows of a fixed size
        total[row["slice"] * height : (row["slice"] + 1) * height] = np.frombuffer(row["part"]).reshape(height, -1)
    weights = np.log((1 + total[0, -1]) / (1 + total[:, RANK])) + 1e-3
    basis, values, _ = np.linalg.svd(total[:, :RANK] * weights[:, None] + 1e-9 * random, full_matrices=False)
    return (basis * (values[0] / values) ** WHITENING * weights[:, None]).astype(np.float32), weights


def longest_common_subsequence(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, with a bit for each of the item's words."""
    at: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        at[word] = at.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    state = full
    for word in passage.tolist():
        hit = state & at.get(word, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(item) - state.bit_count()


def answer_words(text: str) -> list[bytes]:
    """The words of an item's last sentence, if there are others before it."""
    sentences = [words for part in re.split(r"[.?!\n]+", text) if (words := plain_words(part))]
    return sentences[-1] if len(sentences) > 1 else []


def _contains(passage: np.ndarray, part: np.ndarray) -> bool:
    if not len(part) or len(part) > len(passage):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(passage, len(part)) == part).all(axis=1).any())


def _hashes(text: str | None, powers: Powers) -> np.ndarray:
    return hashed_words([text], powers, _PLAIN)[0]


def _queries(items: Sequence[tuple[int, str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item, word hashes, answer's word hashes) of each part of each item that is long enough."""
    powers, found = Powers(), []
    for item, text in items:
        hashes = _hashes(text, powers)
        if len(hashes) < LEAST_WORDS:
            continue
        answer = _hashes(b" ".join(answer_words(text)).decode(), powers)
        parts = -(-len(hashes) // MOST_WORDS)
        found += [(item, part, answer) for part in np.array_split(hashes, parts)]
    return found


LEAK = "id long, hash long, item_id long, first_word long, n_words long, cosine double, share double, answer boolean"


def _needed(query: tuple[int, np.ndarray, np.ndarray]) -> int:
    """The fewest of the query's words that a reported passage can hold."""
    _, words, answer = query
    least = SHARE_WITH_ANSWER if len(answer) else SHARE
    return next(k for k in range(len(words) + 1) if k / len(words) >= least)


class _Group:
    """The queries of about one length: their directions in the space, and which features each has."""

    def __init__(self, length: int, queries: list[tuple[int, np.ndarray, np.ndarray]], space: np.ndarray):
        self.length, self.step, self.queries = length, max(1, length // 6), queries
        self.around = length // 8 + 2
        features = [_features(words) for _, words, _ in queries]
        vectors = np.array([space[f].sum(axis=0) for f in features])
        self.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).T.copy()
        self.needed = np.array([_needed(query) for query in queries])
        table = np.zeros((len(queries), FEATURES), bool)
        for row, f in zip(table, features, strict=True):
            row[f] = True
        self.members = np.packbits(table, axis=1, bitorder="little")

    def passages(self, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of all passages; the last one of a document ends with it."""
        starts = [
            np.append(np.arange(b, max(b + 1, e - self.length), self.step), max(b, e - self.length))
            for b, e in zip(begins.tolist(), ends.tolist(), strict=True)
        ]
        doc = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        start = np.concatenate(starts)
        return start, np.minimum(start + self.length, ends[doc]), doc

    def around_runs(
        self, runs: np.ndarray, starts: np.ndarray, docs: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Passages, in order, and queries whose runs lie in the passage and the words around it."""
        query, first, last = runs
        doc = np.searchsorted(ends, first, side="right")
        low = np.searchsorted(starts, last + 1 - self.length - self.around)
        high = np.searchsorted(starts, first + self.around, side="right")
        low = np.maximum(low, np.searchsorted(docs, doc))
        high = np.minimum(high, np.searchsorted(docs, doc, side="right"))
        sizes = np.where(last < ends[doc], np.maximum(high - low, 0), 0)
        passage = np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
        pairs = np.unique(passage * len(self.queries) + np.repeat(query, sizes))
        return pairs // len(self.queries), pairs % len(self.queries)

    def candidates(
        self, sums: np.ndarray, runs: np.ndarray, feature: np.ndarray, begins: np.ndarray, ends: np.ndarray
    ) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, query, first word, end, cosine) where enough of the query's features stand."""
        starts, stops, docs = self.passages(begins, ends)
        around = self.around
        rare, rare_query = self.around_runs(runs, starts, docs, ends)
        for low in range(0, len(rare), 100_000):
            at, query = rare[low : low + 100_000], rare_query[low : low + 100_000]
            start, stop, doc = starts[at], stops[at], docs[at]
            passage = sums[stop] - sums[start]
            passage /= np.maximum(np.sqrt(np.einsum("ij,ij->i", passage, passage)), 1e-9)[:, None]
            cosine = np.einsum("ij,ij->i", passage, self.vectors.T[query])
            near = np.flatnonzero(cosine >= COSINE)
            query, cosine = query[near], cosine[near]
            # Words in the passage that the query has at all bound the common subsequence from above.
            first = np.maximum(start[near] - around, begins[doc[near]])
            last = np.minimum(stop[near] + around, ends[doc[near]])
            enough = np.zeros(len(near), bool)
            for part in range(0, len(near), 20_000):
                cut = slice(part, part + 20_000)
                at = first[cut, None] + np.arange(self.length + 2 * around)
                inside = at < last[cut, None]
                f = feature[np.minimum(at, len(feature) - 1)]
                bit = (self.members[query[cut, None], f >> 3] >> (f & 7).astype(np.uint8)) & 1
                enough[cut] = (bit.astype(bool) & inside).sum(axis=1) >= self.needed[query[cut]]
            for i in np.flatnonzero(enough):
                yield int(doc[near[i]]), int(query[i]), int(first[i]), int(last[i]), float(cosine[i])


class _RareWords:
    """An inverted index of the rarest words of all groups' queries, by feature."""

    def __init__(self, groups: Sequence[_Group], weights: np.ndarray):
        least, reach, owners, found = [], [], [], []
        for group in groups:
            for query, needed in zip(group.queries, group.needed.tolist(), strict=True):
                feature = _features(query[1])
                least.append(min(needed, RARE_WORDS))
                rarest = np.argsort(-weights[feature], kind="stable")[: len(feature) - needed + least[-1]]
                found.append(np.unique(feature[rarest]))
                owners.append(np.full(len(found[-1]), len(reach)))
                reach.append(group.length + 2 * group.around)
        self.offsets = np.cumsum([0, *(len(group.queries) for group in groups)])
        self.least, self.reach = np.array(least, np.int64), np.array(reach, np.int64)
        joined = np.concatenate([np.empty(0, np.int64), *found])
        order = np.argsort(joined, kind="stable")
        self.owners = np.concatenate([np.empty(0, np.int64), *owners])[order].astype(np.min_scalar_type(len(reach)))
        self.sizes = np.bincount(joined, minlength=FEATURES)
        self.first = np.cumsum(self.sizes) - self.sizes

    def _runs(self, feature: np.ndarray) -> np.ndarray:
        place = np.flatnonzero(self.sizes[feature])
        sizes = self.sizes[feature[place]]
        skipped = self.first[feature[place]] - np.cumsum(sizes) + sizes
        query = self.owners[np.arange(sizes.sum()) + np.repeat(skipped, sizes)]
        order = np.argsort(query, kind="stable")
        query, place = query[order], np.repeat(place, sizes)[order]
        last = np.arange(len(query)) + self.least[query] - 1
        inside = np.flatnonzero(last < len(query))
        last = last[inside]
        run = (query[last] == query[inside]) & (place[last] - place[inside] < self.reach[query[inside]])
        return np.stack([query[inside[run]].astype(np.int64), place[inside[run]], place[last[run]]])

    def runs(self, feature: np.ndarray) -> list[np.ndarray]:
        """For each group: queries, and the first and last place of as many rare words as a leak holds at least."""
        most = int(self.reach.max(initial=0))
        parts = [
            self._runs(feature[low : low + WORDS_AT_ONCE + most]) + np.array([[0], [low], [low]])
            for low in range(0, len(feature), WORDS_AT_ONCE)
        ]
        found = np.concatenate(parts, axis=1)
        own = [found[:, (found[0] >= a) & (found[0] < b)] for a, b in zip(self.offsets, self.offsets[1:], strict=False)]
        return [runs - np.array([[a], [0], [0]]) for a, runs in zip(self.offsets, own, strict=False)]


def _search(
    docs: DataFrame, items: Sequence[tuple[int, str]], space: tuple[np.ndarray, np.ndarray], id: str, text: str
) -> DataFrame:
    queries = _queries(items)
    by_length: dict[int, list] = {}
    for query in queries:
        by_length.setdefault(min(LENGTHS, key=lambda n: abs(n - len(query[1]))), []).append(query)
    groups = [(length, own) for length, own in sorted(by_length.items())]
    shared = docs.sparkSession.sparkContext.broadcast((*space, groups))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        latent, weights, groups = shared.value
        searched, powers = [_Group(length, own, latent) for length, own in groups], Powers()
        rare = _RareWords(searched, weights)
        for batch in batches:
            ids, marks, leaks = batch["id"].tolist(), batch["hash"].tolist(), []
            for rows, hashes in _blocks(batch["text"].tolist(), powers):
                words = np.concatenate(hashes)
                feature = _features(words)
                sums = np.zeros((len(words) + 1, RANK), np.float32)
                np.cumsum(latent[feature], axis=0, out=sums[1:])
                ends = np.cumsum([len(h) for h in hashes])
                begins = ends - [len(h) for h in hashes]
                for group, runs in zip(searched, rare.runs(feature), strict=True):
                    for doc, query, first, last, cosine in group.candidates(sums, runs, feature, begins, ends):
                        item, wanted, answer = group.queries[query]
                        share = longest_common_subsequence(wanted, words[first:last]) / len(wanted)
                        told = share >= SHARE_WITH_ANSWER and _contains(words[first:last], answer)
                        if share >= SHARE or told:
                            place = int(first - begins[doc])
                            leaks.append((ids[rows[doc]], marks[rows[doc]], item, place, last - first, cosine, share, told))
            if leaks:
                found = pd.DataFrame(leaks, columns=[c.split()[0] for c in LEAK.split(", ")])
                yield found.astype({"id": "Int64", "item_id": "Int64"})

    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    return rows.mapInPandas(run, LEAK)


def _all_leaks(docs: DataFrame, benchmark: DataFrame, id: str, text: str) -> DataFrame:
    """Every passage that leaks an item, with its row's id and the hash of its text."""
    space = latent_space(docs, text)
    found = None
    items: list[tuple[int, str]] = []
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator()
    for row in rows:
        items.append((row["item_id"], row["text"]))
        if len(items) == BLOCK_ITEMS:
            part = store(_search(docs, items, space, id, text))
            found, items = part if found is None else found.unionByName(part), []
    if items or found is None:
        part = _search(docs, items, space, id, text)
        found = part if found is None else found.unionByName(part)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The best passage for each leaked (document, item): where it is, its cosine, its share, whether with the answer."""
    best = F.max_by(F.struct("first_word", "n_words", "cosine", "share", "answer"), F.struct("share", "cosine", -F.col("first_word")))
    found = _all_leaks(docs, benchmark, id, text).groupBy("id", "item_id").agg(best.alias("best"))
    return found.select(F.col("id").alias(id), "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns.

    Rows are told apart by id and the hash of their text, so a clean row stays beside a leaked one of its id, and
    a leaked row without an id goes.
    """

    def keys(own: Column, hash: Column) -> dict[str, Column]:
        return {"id": F.coalesce(own, F.lit(0)), "nil": own.isNull(), "hash": hash}

    found = _all_leaks(docs, benchmark, id, text)
    leaked = store(found.select(*[c.alias(n) for n, c in keys(F.col("id"), F.col("hash")).items()]).distinct())
    own = keys(docs[id].cast("long"), F.xxhash64(docs[text]))
    return without(packed(docs, **own), leaked, list(own))
