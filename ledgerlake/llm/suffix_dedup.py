"""Repeated strings of 400 bytes, found by sorting a sparse set of suffixes.

**Which suffixes.** Sorting every suffix would move each byte hundreds of times. Instead, each text's
*anchors* are kept: in every window of 400 bytes, the leftmost position whose 128-byte gram has the
smallest hash. The choice depends on the window's bytes alone, so two equal windows have their anchors at
the same place, and an equal pair of windows can be found at a pair of equal grams.

**Filtering.** Grams are counted with the hash of all bytes that a window around the anchor can reach
(its *context*). Grams that occur once go. Equal contexts repeat each other wholly: they are resolved by
the count. Only one of them, and the contexts that are alone but share their gram, are sorted.

**Sorting.** Suffixes (gram, then right context) are range-partitioned by their leading gram, by splitters
that the engine samples; buckets are sorted by multikey quicksort on 8-byte keys, to the right of the gram
and, reversed, to the left. Common prefixes of neighbours then give, for each of the 273 windows that
contain an anchor, which members have equal windows. A bucket boundary is never inside a gram, so equal
suffixes meet in one bucket; for a gram with more contexts than ``MAX_GROUP``, the windows themselves are
compared instead, by the hashes of their bytes, counted over all tasks.

Defined results: null text is empty; texts under 400 bytes lose nothing; equal rows are copies of each other;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, store
from .shingles import mixed

LENGTH = 400
GRAM = 128
REACH = LENGTH - GRAM  # bytes of context on each side
MAX_GROUP = 20_000
CHUNK = 1 << 19
BATCH_ROWS = 4_000
PLACE_BITS = np.uint64(20)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Hasher:
    """Hashes of any part of a byte array, from sums that are computed once."""

    up = _powers(BASE, CHUNK + 4 * LENGTH)
    down = _powers(INVERSE, CHUNK + 4 * LENGTH)

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all_parts(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    least, done = h, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = width - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, their grams' hashes, their contexts' hashes."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    found = []
    for first in range(0, n - LENGTH + 1, CHUNK):
        last = min(first + CHUNK, n - LENGTH + 1)  # windows [first, last)
        low, high = max(0, first - REACH), min(n, last - 1 + LENGTH + REACH)
        hasher = Hasher(data[low:high])
        grams = hasher.all_parts(GRAM)[first - low : last - low + REACH]
        placed = ((grams >> PLACE_BITS) << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        least = _least_in_windows(placed, REACH + 1)
        at = np.unique((least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64))
        place = at + first
        start, end = np.maximum(place - REACH, 0), np.minimum(place + LENGTH, n)
        context = hasher.part(start - low, end - low)
        clipped = ((place - start) * 1024 + (end - place)).astype(np.uint64)
        found.append((place, grams[at], mixed(context + clipped * np.uint64(BASE))))
    place, gram, context = (np.concatenate(x) for x in zip(*found, strict=True))
    place, once = np.unique(place, return_index=True)
    return place, gram[once], context[once]


def _bytes(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for text in batch.column(column):
        raw = text.as_buffer()
        yield np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)


ANCHOR = "gram long, context long, id long, h int, at int"


def anchor_table(texts: DataFrame) -> DataFrame:
    """All anchors of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [anchors(data) for data in _bytes(batch, 2)]
            sizes = [len(r[0]) for r in rows]
            index = pa.array(np.repeat(np.arange(len(rows)), sizes))
            place, gram, context = (
                np.concatenate([r[k] for r in rows]) if rows else np.empty(0, t)
                for k, t in enumerate((np.int64, np.uint64, np.uint64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)),
                    pa.array(context.view(np.int64)),
                    batch.column(0).take(index),
                    batch.column(1).take(index),
                    pa.array(place.astype(np.int32)),
                ],
                ["gram", "context", "id", "h", "at"],
            )

    return texts.select("id", "h", "text").mapInArrow(run, ANCHOR)


def contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around the wanted anchors: lead (the gram), left (reversed) and right."""
    places = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("at", "hot")).alias("places"))
    places = store(places)
    near = among(texts, places, ["id", "h"]).where("_hit").drop("_hit")
    joined = near.join(places.toDF("_i", "_h", "places"), near["id"].eqNullSafe(F.col("_i")) & (near["h"] == F.col("_h")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, h, text, found in zip(batch["id"], batch["h"], batch["text"], batch["places"], strict=True):
                data = text.encode()
                for p in found:
                    a = p["at"]
                    left = data[max(0, a - REACH) : a][::-1]
                    rows.append((key, h, a, p["hot"], data[a : a + GRAM], left, data[a + GRAM : a + LENGTH]))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=CONTEXT_NAMES).astype({"id": "Int64"})
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=CONTEXT_NAMES).astype({"id": "Int64"})

    return joined.select("id", "h", "text", "places").mapInPandas(
        run, "id long, h int, at int, hot boolean, lead binary, left binary, right binary"
    )


CONTEXT_NAMES = ["id", "h", "at", "hot", "lead", "left", "right"]


def multikey_order(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order by group, then by the rows' bytes: one 8-byte key at a time, among rows still equal."""
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.empty(len(group), np.int64)  # place of the first row that is equal so far
    rank[order] = np.repeat(starts, np.diff(np.append(starts, len(group))))
    keys = rows.view(">u8").astype(np.uint64)
    for k in range(keys.shape[1]):
        count = np.bincount(rank, minlength=len(rank))
        open_ = np.flatnonzero(count[rank] > 1)
        if not len(open_):
            break
        key, old = keys[open_, k], rank[open_]
        by = np.lexsort((key, old))
        key, old = key[by], old[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), np.arange(len(by)), 0))
        inside = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0)) - head
        rank[open_[by]] = old + inside
    return np.argsort(rank, kind="stable")


def _equal_prefixes(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row and length, a number that rows of a group share if they agree so far."""
    order = multikey_order(group, rows)
    sorted_rows = rows[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(sizes[order][1:], sizes[order][:-1]))
    common[group[order][1:] != group[order][:-1]] = -1
    common = np.append(-1, common)
    classes = np.empty((len(group), REACH + 1), np.int32)
    classes[order] = np.cumsum(common[:, None] < np.arange(REACH + 1)[None, :], axis=0)
    return classes


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    padded = b"".join(p.ljust(REACH, b"\0") for p in parts)
    return np.frombuffer(padded, np.uint8).reshape(len(parts), REACH), sizes


def repeated_offsets(group: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each member the largest and smallest distance of a repeated window's start from its anchor
    (-1 if no window that holds the anchor is repeated)."""
    n = len(group)
    rows, left_size = _matrix(left)
    before = _equal_prefixes(group, rows, left_size)
    rows, right_size = _matrix(right)
    after = _equal_prefixes(group, rows, right_size)
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for o in range(REACH + 1):
        there = np.flatnonzero((left_size >= o) & (right_size >= REACH - o))
        key = before[there, o].astype(np.int64) * (n + 1) + after[there, REACH - o]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(there), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hits = there[by[twice]]
        most[hits] = o
        least[hits[least[hits] < 0]] = o
    return most, least


SPAN = "id long, h int, start int, end int"


def _spans_of(frame: pd.DataFrame) -> pd.DataFrame:
    group = pd.factorize(frame["lead"])[0]
    most, least = repeated_offsets(group, frame["left"].tolist(), frame["right"].tolist())
    hit = most >= 0
    found = frame.loc[hit, ["id", "h"]].copy()
    found["start"] = frame.loc[hit, "at"] - most[hit]
    found["end"] = frame.loc[hit, "at"] - least[hit] + LENGTH
    return found


def spans_in_buckets(rows: DataFrame) -> DataFrame:
    """Repeated windows of ordinary grams: range buckets of suffixes, sorted and compared in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < BATCH_ROWS:
                continue
            whole = pd.concat(held, ignore_index=True)
            open_ = whole["lead"] == whole["lead"].iloc[-1]  # the last gram may go on in the next batch
            if not open_.all():
                yield _spans_of(whole[~open_].reset_index(drop=True))
            held = [whole[open_]]
        if held:
            yield _spans_of(pd.concat(held, ignore_index=True))

    return rows.repartitionByRange("lead").sortWithinPartitions("lead").mapInPandas(run, SPAN)


def spans_by_windows(rows: DataFrame) -> DataFrame:
    """Repeated windows of very frequent grams: each window's hash is counted over all tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = np.arange(REACH + 1)
        for batch in batches:
            for row in batch.itertuples(index=False):
                data = np.frombuffer(row.left[::-1] + row.lead + row.right, np.uint8)
                a = len(row.left)
                o = offsets[(offsets <= a) & (a - offsets + LENGTH <= len(data))]
                windows = Hasher(data).part(a - o, a - o + LENGTH).view(np.int64)
                yield pd.DataFrame({"id": pd.array([row.id] * len(o), "Int64"), "h": row.h, "at": row.at, "o": o, "w": windows})

    windows = rows.mapInPandas(run, "id long, h int, at int, o int, w long")
    again = windows.groupBy("o", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("o", "w")
    hits = windows.join(again, ["o", "w"]).groupBy("id", "h", "at").agg(F.max("o").alias("most"), F.min("o").alias("least"))
    return hits.selectExpr("id", "h", "at - most as start", f"at - least + {LENGTH} as end")


def repeated_spans(texts: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Spans (not yet merged) that repeated windows cover."""
    found = anchor_table(texts)
    counted = found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "at")).alias("one"))
    counted = store(counted)
    grams = counted.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
    whole = counted.where("n > 1").select("gram", "context")
    copies = (
        among(found, whole, ["gram", "context"]).where("_hit").join(whole, ["gram", "context"]).select("id", "h", "at")
    )
    # A context is clipped at its text's ends, so what equal contexts cover ends there too.
    copies = copies.selectExpr("id", "h", f"greatest(at - {REACH}, 0) as start", f"at + {LENGTH} as end")
    shared = grams.where("contexts > 1").select("gram", (F.col("contexts") > max_group).alias("hot"))
    wanted = counted.join(shared, "gram").select("one.id", "one.h", "one.at", "hot")
    around = store(contexts(texts, wanted))
    return copies.unionByName(spans_in_buckets(around.where("NOT hot"))).unionByName(
        spans_by_windows(around.where("hot"))
    )


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """For each row: ``id``, ``n_bytes``, ``spans`` removed (start, end; merged, in order), ``kept`` bytes."""
    texts = docs.select(
        F.col(id).cast("long").alias("id"),
        F.hash(F.col(text)).alias("h"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    spans = store(repeated_spans(texts, max_group))
    by_row = store(spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("found")))
    marked = among(texts, by_row, ["id", "h"])
    none = F.array().cast("array<struct<start:int,end:int>>")
    clean = marked.where("NOT _hit").select("id", "text", none.alias("found"))
    hit = marked.where("_hit")
    dirty = hit.join(
        by_row.toDF("_i", "_h", "found"), hit["id"].eqNullSafe(F.col("_i")) & (hit["h"] == F.col("_h")), "left"
    ).select("id", "text", F.coalesce("found", none).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, content, found in zip(batch["id"], batch["text"], batch["found"], strict=True):
                data = content.encode()
                merged: list[list[int]] = []
                for start, end in sorted((s["start"], min(s["end"], len(data))) for s in found):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                kept, at = [], 0
                for start, end in merged:
                    kept.append(data[at:start])
                    at = end
                kept.append(data[at:])
                rows.append((key, len(data), [{"start": s, "end": e} for s, e in merged], b"".join(kept)))
            frame = pd.DataFrame(rows, columns=["id", "n_bytes", "spans", "kept"])
            yield frame.astype({"id": "Int64"})

    result = "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    cut = dirty.mapInPandas(run, result)
    whole = clean.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("found").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return whole.unionByName(cut).withColumnRenamed("id", id)
