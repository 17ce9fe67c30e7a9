import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import katz as K

from .conftest import prose


def model(rows, learn):
    """Token lists, the base probability and the backoff probability, from plain dictionaries."""
    tokens = [(i, (t or "").encode().lower().split() + ["end"]) for i, t in rows]
    single, pairs = collections.Counter(), collections.Counter()
    for i, w in tokens:
        if learn(i):
            single.update(w)
            pairs.update(zip(["start", *w[:-1]], w, strict=True))
    n, v = sum(single.values()), len(single)
    factor = K.discounts([collections.Counter(pairs.values())[k] for k in range(1, 7)])

    def base(w):
        return (single[w] + 0.1) / (n + 0.1 * (v + 1))

    after = collections.defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def backoff(h, w):
        seen = after.get(h)
        if not seen:
            return base(w)
        saved = sum(c * (1 - factor[c]) for c in seen.values() if c <= 5)
        total = sum(seen.values()) + (saved == 0)
        if w in seen:
            return (factor[seen[w]] if seen[w] <= 5 else 1) * seen[w] / total
        return (saved or 1) / total / (1 - sum(map(base, seen))) * base(w)

    return tokens, single, n, base, backoff


@pytest.mark.parametrize("block_bytes", [10**9, 20_000])
def test_scores_equal_plain_dictionaries(frame, awkward_rows, block_bytes):
    rows = awkward_rows + [(100 + k, prose(k, 150)) for k in range(60)] + [(100, prose(0, 150)), (100, "again other")]
    tokens, single, n, base, backoff = model(rows, lambda i: i % 4 != 0)
    want = sorted(
        (
            i,
            i % 4 != 0,
            len(w),
            sum(single[x] > 0 for x in w),
            round(sum(math.log10(base(x)) for x in w), 6),
            round(sum(math.log10(backoff(h, x)) for h, x in zip(["start", *w[:-1]], w, strict=True)), 6),
        )
        for i, w in tokens
    )
    got = K.score(frame(rows), F.col("doc_id") % 4 != 0, block_bytes=block_bytes).collect()
    assert {r["train_tokens"] for r in got} == {n}
    names = ("doc_id", "train", "n_tokens", "n_known", "base_score", "score")
    rounded = sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in names) for r in got)
    assert all(a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-5) for a, b in zip(rounded, want, strict=True))
    for h in ("start", b"the", b"river"):  # everything after a context adds up to one
        total = sum(backoff(h, w) for w in single) + backoff(h, "never seen")
        assert total == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_and_nothing_at_all(frame, nothing):
    rows = K.score(frame([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == r["score"] == 0.0 for r in rows)
    assert K.score(nothing, F.lit(True)).count() == 0


def test_discounts_are_factors():
    assert K.discounts([100, 30, 14, 8, 5, 3])[0] == 1
    for n in ([100, 30, 14, 8, 5, 3], [0] * 6, [5, 0, 0, 0, 0, 0], [1, 50, 2, 9, 1, 7]):
        assert all(0 < f < 1 for f in K.discounts(n)[1:])


def test_small_numbers_take_little_room_in_the_exchange():
    """Tables of counts come back as they were, and compress to little more than the bytes that differ."""
    import zlib

    from ledgerlake.llm.katz import _packed, _whole

    counts = np.random.default_rng(1).integers(0, 60_000, 20_000)
    for kind in (np.uint32, np.uint64, np.float64):
        blob = _packed(counts.astype(kind), counts[:0].astype(kind), counts[:7].astype(kind))
        assert (_whole(blob, kind, 20_000) == counts).all()
        assert len(_whole(blob, kind, 0, 20_000)) == 0
        assert (_whole(blob, kind, 7, 20_000 * np.dtype(kind).itemsize) == counts[:7]).all()
    assert len(zlib.compress(_packed(counts.astype(np.uint32)), 1)) < 2.1 * len(counts)


def test_a_shard_holds_no_more_text_than_a_block(frame, monkeypatch):
    """Pairs of a shard come from as many bytes of text as a block has, at most."""
    made = []
    setting = K.Setting
    monkeypatch.setattr(K, "Setting", lambda *a: made.append(setting(*a)) or made[-1])
    rows = [(k, prose(k, 100)) for k in range(40)]
    size = sum(len(t) for _, t in rows)
    K.score(frame(rows), F.lit(True), block_bytes=size // 3)
    assert size / (1 << made[0].bits) <= size // 3
