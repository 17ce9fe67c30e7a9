"""Language-model scores: a Katz backoff model of word pairs with Good-Turing discounts.

**Model.** The lowest order is p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), with one share for all unknown words. After a
word h, p(w|h) = d(c) c(h w) / c(h) for pairs seen c times, and a(h) p(w) for all others, with d from Good-Turing
estimates for counts up to five and a(h) such that everything after h adds up to exactly one. Where a context's
pairs are all too frequent to be discounted, its total is taken as one larger, which leaves room for unseen words.
A text starts after a start mark and ends with an end mark, which is a token.

**Tables.** Texts are dealt to *blocks* by a hash. A block sends its distinct words, then its distinct pairs, to
*shards* that own ranges of hashes; a shard adds up what all blocks sent and answers each block in the order in which
it asked. So each distinct pair of a block that training can have seen travels once, as a few bytes in a packed table of one row for each
(block, shard), and the answer needs a count for each. A token's probability is then looked up in its block: pair,
else context weight times word.

Nothing is hot: a word or pair comes at most once from each block, and the pairs of very frequent contexts (a bounded
list: each has a shard's share of all tokens) are spread over all shards by their second word; blocks add up the
shards' parts of what those contexts need. Texts are shuffled once and read three times from the same exchange.

Defined results: null text is empty and scores its end mark alone; nothing to learn from leaves the unknown word's
share for all tokens; rows with the same id are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .shingles import Powers, batches_of, hashed_words

ADDED = 0.1
DISCOUNTED = 5  # counts up to this are discounted
BLOCK_BYTES = 12_000_000
SLICE = 500  # texts of a block that are taken apart at once
START, END = np.uint64(1), np.uint64(2)  # no word has these hashes but by a chance of 2 ** -64


def _tokens(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text and its end mark."""
    powers, end = Powers(), np.array([END])
    return [np.append(h, end) for a, b in batches_of(texts) for h in hashed_words(texts[a:b], powers)]


@dataclass(frozen=True)
class Setting:
    """What all tasks know: sizes of the training text, the shards, the very frequent contexts."""

    tokens: int
    types: int
    texts: int
    bits: int
    hot: np.ndarray

    @property
    def kind(self) -> type:
        """Type of words' numbers and counts: four bytes as long as they do."""
        return np.uint32 if max(self.types * 2, self.tokens) < 1 << 31 else np.uint64

    @property
    def last(self) -> int:
        return int(np.iinfo(self.kind).max)

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def share(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADDED) / (self.tokens + ADDED * (self.types + 1))


class Block:
    """The distinct words and pairs of a block of texts, in an order that every pass finds again."""

    def __init__(self, table: pa.Table, setting: Setting):
        self.train = np.array(table.column("train").to_pylist(), bool)
        self.setting = setting
        sizes, words, places = [], [], []
        for at in range(0, table.num_rows, SLICE):
            tokens = _tokens(table.column("text").slice(at, SLICE).to_pylist())
            sizes += [len(t) for t in tokens]
            own, place = np.unique(np.concatenate(tokens), return_inverse=True)
            words.append(own)
            places.append(place.astype(np.int32))  # a block's tokens stay far below 2 ** 31
        self.sizes = np.array(sizes)
        self.words = np.unique(np.concatenate(words))
        self.word = np.concatenate(
            [np.searchsorted(self.words, own).astype(np.int32)[place] for own, place in zip(words, places, strict=True)]
        )

    def word_slices(self) -> list[np.ndarray]:
        """Distinct words by shard; shards own ranges, so the slices follow one another."""
        cuts = np.searchsorted(self.setting.shard(self.words), np.arange(1, 1 << self.setting.bits))
        return np.split(self.words, cuts)

    def pairs(self, counts: np.ndarray) -> None:
        """Distinct pairs by (context, word), places in ``words``; and by shard those that training can have seen."""
        starts = np.cumsum(self.sizes) - self.sizes
        first = len(self.words)  # the place of the start mark
        key = np.empty(len(self.word), np.int64)
        key[1:] = self.word[:-1]
        key[starts] = first
        key *= first + 1
        key += self.word
        order = np.argsort(key)
        key.sort()
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        key = key[fresh]
        self.pair = np.empty(len(fresh), np.int32)
        self.pair[order] = np.cumsum(fresh, dtype=np.int32) - 1
        del order, fresh
        learnt = np.repeat(self.train, self.sizes)
        self.count = np.bincount(self.pair[learnt], minlength=len(key)).astype(np.int32)
        self.context = (key // (first + 1)).astype(np.int32)
        self.second = (key % (first + 1)).astype(np.int32)
        del key, learnt
        heads, hot = np.append(self.words, START), self.setting.hot
        place = np.minimum(np.searchsorted(hot, heads), len(hot) - 1)
        self.hot = np.where(hot[place] == heads, place, -1)  # of each context, its place among the frequent ones
        owner = self.setting.shard(heads).astype(np.int32)[self.context]
        is_hot = self.hot[self.context] >= 0
        owner[is_hot] = self.setting.shard(self.words)[self.second[is_hot]]
        seen = np.append(counts, 1) > 0
        known = np.flatnonzero(seen[self.context] & (counts[self.second] > 0)).astype(np.int32)
        owner = owner[known]
        self.order = known[np.argsort(owner, kind="stable")]  # contexts stay together in a shard
        shards = np.arange((1 << self.setting.bits) + 1)
        self.cuts = np.append(0, np.cumsum(np.bincount(owner, minlength=len(shards) - 1)))
        # What follows a context matters to its weight even if the block has it before unknown words only.
        own = np.unique(self.context)
        own = own[seen[own] & (self.hot[own] < 0)]
        by = np.argsort(self.setting.shard(heads[own]), kind="stable")
        self.contexts, self.context_cuts = own[by], np.searchsorted(self.setting.shard(heads[own[by]]), shards)

    def asked(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that a shard is asked for, its contexts, and how many of the pairs each of them has."""
        mine = self.order[self.cuts[shard] : self.cuts[shard + 1]]
        context = self.context[mine]
        own = np.union1d(self.contexts[self.context_cuts[shard] : self.context_cuts[shard + 1]], context)
        return mine, own, np.bincount(np.searchsorted(own, context), minlength=len(own))


def _packed(*arrays: np.ndarray) -> bytes:
    """Bytes of one significance together: most numbers are small, and those compress better."""
    return b"".join(a.reshape(-1, 1).view(np.uint8).T.tobytes() for a in arrays)


def _whole(blob: bytes, kind: type, size: int, at: int = 0) -> np.ndarray:
    """An array of ``_packed``."""
    width = np.dtype(kind).itemsize
    if not size:
        return np.empty(0, kind)
    return np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size).T.copy().view(kind).ravel()


def _ask_words(setting: Setting):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        slices = Block(table, setting).word_slices()
        return pa.table(
            {
                "shard": pa.array(range(len(slices)), pa.int32()),
                "block": pa.array([key[0].as_py()] * len(slices), pa.int32()),
                "words": pa.array([_packed(s) for s in slices], pa.binary()),
            }
        )

    return run


def _answer_words(setting: Setting):
    def run(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        """Counts, and numbers that name the words in four bytes instead of eight."""
        words = known.column("w").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, counts = words[order], known.column("c").to_numpy()[order]
        names, answers = [], []
        for blob in asked.column("words").to_pylist():
            wanted = _whole(blob, np.uint64, len(blob) // 8)
            at = np.minimum(np.searchsorted(words, wanted), max(len(words) - 1, 0))
            found = words[at] == wanted if len(words) else np.zeros(len(wanted), bool)
            count = np.where(found, counts[at], 0) if len(words) else np.zeros(len(wanted))
            names.append(_packed(((at << setting.bits) + (key[0].as_py() or 0)).astype(setting.kind)))
            answers.append(_packed(count.astype(setting.kind)))
        return pa.table(
            {
                "block": asked.column("block"),
                "shard": asked.column("shard"),
                "kind": pa.array([0] * len(answers), pa.int32()),
                "answer": pa.array(answers, pa.binary()),
                "names": pa.array(names, pa.binary()),
            }
        )

    return run


def _by_shard(answers: pa.Table, kind: int, column: str) -> list[tuple[int, bytes]]:
    rows = zip(*(answers.column(c).to_pylist() for c in ("shard", "kind", column)), strict=True)
    return sorted((s, a) for s, k, a in rows if k == kind)


def _numbers(answers: pa.Table, column: str, setting: Setting) -> np.ndarray:
    width = np.dtype(setting.kind).itemsize
    parts = [_whole(a, setting.kind, len(a) // width) for _, a in _by_shard(answers, 0, column)]
    return np.concatenate(parts).astype(np.int64)


def _ask_pairs(setting: Setting):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, kind = Block(table, setting), setting.kind
        counts, names = (_numbers(answers, c, setting) for c in ("answer", "names"))
        block.pairs(counts)
        # Frequent contexts are named by their place, from the top.
        heads = np.where(block.hot >= 0, setting.last - block.hot, np.append(names, 0))
        rows = []
        for shard in range(1 << setting.bits):
            mine, own, lengths = block.asked(shard)
            second = block.second[mine]
            # Columns of one kind together: they compress better than rows.
            rows.append(
                np.array([len(mine), len(own)], np.int64).tobytes()
                + _packed(
                    heads[own].astype(kind),
                    lengths.astype(np.uint32),
                    names[second].astype(kind),
                    counts[second].astype(kind),
                    block.count[mine].astype(np.uint32),
                )
            )
        return pa.table(
            {
                "shard": pa.array(range(len(rows)), pa.int32()),
                "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "pairs": pa.array(rows, pa.binary()),
            }
        )

    return run


def _unpacked(blob: bytes, kind: type) -> tuple[np.ndarray, ...]:
    n, m = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at, out = 16, []
    for size, each in ((m, kind), (m, np.uint32), (n, kind), (n, kind), (n, np.uint32)):
        out.append(_whole(blob, each, size, at))
        at += size * np.dtype(each).itemsize
    heads, lengths, words, counts, seen = out
    return np.repeat(heads, lengths), words, counts, seen, heads


def _merged(asked: pa.Table, kind: type) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all blocks' pairs: how many each block sent, and its contexts; for each pair its distinct pair; the distinct
    pairs' contexts, words' counts, totals."""
    parts = [_unpacked(b.as_py(), kind) for b in asked.column("pairs")]
    sent = [(len(p[0]), p[4]) for p in parts]
    heads, words, counts, seen = (np.concatenate([p[k] for p in parts]) for k in range(4))
    del parts
    order = np.lexsort((words, heads))
    fresh = np.zeros(len(order), bool)
    for column in (heads, words):
        line = column[order]
        fresh[1:] |= line[1:] != line[:-1]
    del words, line
    fresh[:1] = True
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    del order, fresh
    totals = np.bincount(which, weights=seen, minlength=len(first)).astype(np.int64)
    return sent, which, heads[first], counts[first].astype(np.int64), totals


def _count_of_counts(setting: Setting):
    def run(key: tuple, asked: pa.Table) -> pa.Table:
        *_, totals = _merged(asked, setting.kind)
        n = np.bincount(np.minimum(totals, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
        return pa.table({f"n{r}": pa.array([int(n[r])], pa.int64()) for r in range(1, DISCOUNTED + 2)})

    return run


def _answer_pairs(setting: Setting):
    def run(key: tuple, asked: pa.Table) -> pa.Table:
        parts, which, heads, counts, totals = _merged(asked, setting.kind)
        hot = (setting.last - np.arange(len(setting.hot))).astype(setting.kind)
        known = totals > 0
        wanted = [own for _, own in parts]
        context, place = np.unique(np.concatenate([heads, hot, *wanted]), return_inverse=True)
        place = place[: len(heads)]
        stats = np.zeros((len(context), DISCOUNTED + 1))
        for r in range(1, DISCOUNTED + 1):
            stats[:, r - 1] = np.bincount(place[totals == r], minlength=len(context))
        shares = setting.share(counts)
        stats[:, DISCOUNTED] = np.bincount(place[known], weights=shares[known], minlength=len(context))
        hot_stats = stats[np.searchsorted(context, hot)]
        answers, at = [], 0
        for size, contexts in parts:
            own = stats[np.searchsorted(context, contexts)]
            few = own[:, :DISCOUNTED].astype(np.uint32)
            total = totals[which[at : at + size]].astype(np.uint32)
            answers.append(hot_stats.tobytes() + _packed(few.T.copy(), own[:, DISCOUNTED].copy(), total))
            at += size
        return pa.table(
            {
                "block": asked.column("block"),
                "shard": asked.column("shard"),
                "kind": pa.array([1] * len(answers), pa.int32()),
                "answer": pa.array(answers, pa.binary()),
            }
        )

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0 (unused) to DISCOUNTED, from the numbers of pairs seen 1, 2, ... times.

    Good-Turing estimates, renormalised so that counts beyond stay as they are. Where the estimates of a
    corpus are no factors between 0 and 1, all of them are replaced by an absolute discount.
    """
    factors = np.ones(DISCOUNTED + 1)
    if n[0] and all(n[:DISCOUNTED]):
        common = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
        for r in range(1, DISCOUNTED + 1):
            estimate = (r + 1) * n[r] / n[r - 1]
            factors[r] = (estimate / r - common) / (1 - common) if common < 1 else 2.0
        if ((factors[1:] > 0) & (factors[1:] < 1)).all():
            return factors
    less = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    factors[1:] = 1 - less / np.arange(1, DISCOUNTED + 1)
    return factors


def _score(setting: Setting):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, setting)
        counts = _numbers(answers, "answer", setting)
        block.pairs(counts)
        totals = np.zeros(len(block.count), np.int64)
        stats = np.zeros((len(block.words) + 1, DISCOUNTED + 1))
        hot_stats = np.zeros((len(setting.hot), DISCOUNTED + 1))
        for shard, blob in _by_shard(answers, 1, "answer"):
            mine, own, _ = block.asked(shard)
            at = hot_stats.size * 8
            hot_stats += np.frombuffer(blob, np.float64, hot_stats.size).reshape(hot_stats.shape)
            few = _whole(blob, np.uint32, DISCOUNTED * len(own), at).reshape(DISCOUNTED, len(own))
            at += few.nbytes
            seen = _whole(blob, np.float64, len(own), at)
            at += seen.nbytes
            stats[own, :DISCOUNTED] = few.T
            stats[own, DISCOUNTED] = seen
            totals[mine] = _whole(blob, np.uint32, len(mine), at)
        stats[block.hot >= 0] = hot_stats[block.hot[block.hot >= 0]]
        factor = discounts([int(answers.column(f"n{r}")[0].as_py() or 0) for r in range(1, DISCOUNTED + 2)])
        word = setting.share(counts)
        total = np.append(counts, setting.texts).astype(np.float64)  # of each context
        saved = stats[:, :DISCOUNTED] @ (np.arange(1, DISCOUNTED + 1) * (1 - factor[1:]))
        total += (saved == 0) & (total > 0)
        left = np.where(saved > 0, saved, 1.0) / np.maximum(total, 1)
        weight = np.where(total > 0, left / np.maximum(1 - stats[:, DISCOUNTED], 1e-300), 1.0)
        seen = factor[np.minimum(totals, DISCOUNTED)]
        seen[totals > DISCOUNTED] = 1.0
        pair = np.where(
            totals > 0,
            seen * totals / np.maximum(total[block.context], 1),
            weight[block.context] * word[block.second],
        )
        starts = np.cumsum(block.sizes) - block.sizes
        known = counts[block.word] > 0
        return pa.table(
            {
                "id": table.column("id"),
                "train": table.column("train"),
                "n_tokens": pa.array(block.sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat(known, starts, dtype=np.int64), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10(word)[block.word], starts), pa.float64()),
                "score": pa.array(np.add.reduceat(np.log10(pair)[block.pair], starts), pa.float64()),
            }
        )

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c) of all words and end marks of the training rows; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(0).to_pylist())
            words, counts = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.empty(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["w", "c"]
            )

    found = docs.where("train").select("text").mapInArrow(run, "w long, c long")
    return found.groupBy("w").agg(F.sum("c").alias("c"))


ANSWER = "block int, shard int, kind int, answer binary"


def score(
    docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Scores of every row, learned from the rows where ``learn`` holds.

    Columns: ``id``, train, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    rows = docs.select(
        F.col(id).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("train"), F.col(text).alias("text")
    )
    counts = store(word_counts(rows))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    texts = rows.where("train").count()
    bits = max(0, int(np.ceil(np.log2(max(1, size / block_bytes)))))  # a shard gets no more than a block sends
    shards, dealt = 1 << bits, max(1, -(-size // block_bytes))
    # At most ``shards`` words can be that frequent, and the start mark.
    frequent = counts.where((F.col("c") >= tokens / shards) & (F.col("w") != int(END))).select("w").collect()
    hot = np.sort(np.array([START, *[np.int64(r["w"]).view(np.uint64) for r in frequent]], np.uint64))
    setting = Setting(tokens, types, texts, bits, hot)

    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(dealt)).cast("int"))
    by_block = blocks.groupBy("block")
    owner = F.shiftrightunsigned("w", 64 - bits).cast("int") if bits else F.lit(0)
    owned = counts.withColumn("shard", owner)
    asked = by_block.applyInArrow(_ask_words(setting), "shard int, block int, words binary")
    words = asked.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(
        _answer_words(setting), f"{ANSWER}, names binary"
    )
    pairs = by_block.cogroup(words.groupBy("block")).applyInArrow(
        _ask_pairs(setting), "shard int, block int, pairs binary"
    )
    names = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
    rare = pairs.groupBy("shard").applyInArrow(_count_of_counts(setting), ", ".join(f"{n} long" for n in names))
    rare = rare.agg(*[F.sum(n).alias(n) for n in names])  # one row
    totals = pairs.groupBy("shard").applyInArrow(_answer_pairs(setting), ANSWER)
    answers = words.drop("names").unionByName(totals).crossJoin(F.broadcast(rare))
    scored = by_block.cogroup(answers.groupBy("block")).applyInArrow(
        _score(setting), "id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(id), "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
