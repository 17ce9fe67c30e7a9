import collections
import random

import numpy as np
import pytest

from ledgerlake.llm import suffix_dedup as S

from .conftest import prose


def brute(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(d[k : k + 400] for d in data for k in range(len(d) - 399))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((i, len(d), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def cut(df, **options):
    rows = S.remove_repeats(df, **options).collect()
    return sorted(((r[0], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows), key=str)


@pytest.fixture(scope="module")
def rows(awkward_rows):
    rng = random.Random(6)
    passage, other = prose(50, 110), prose(51, 75)
    rows = [(i, t) for i, t in awkward_rows if i != 10]
    rows += [(100 + k, f"{prose(200 + k, 30)} {passage} {prose(300 + k, 20)}") for k in range(25)]
    rows += [(200 + k, other[k : k + 401] + rng.choice("xyz") * k) for k in range(12)]
    rows += [(300, "é" * 900), (301, "ab" * 600), (302, prose(60, 60) * 3), (303, prose(1, 300)[3:]), (304, prose(1, 300)[:399])]
    return [*rows, rows[3], rows[5], (None, passage), (None, prose(61, 100))]


@pytest.mark.parametrize("max_group", [20_000, 3])
def test_removed_bytes_equal_brute_force(frame, rows, max_group):
    assert cut(frame(rows), max_group=max_group) == brute(rows)


def test_empty_table_and_names(nothing):
    df = S.remove_repeats(nothing)
    assert df.count() == 0 and df.columns == ["doc_id", "n_bytes", "spans", "kept"]


def test_anchors_are_the_same_in_equal_windows_across_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    data[5000:6500] = data[1000:2500]
    whole = S.anchors(data)
    monkeypatch.setattr(S, "CHUNK", 700)
    for a, b in zip(whole, S.anchors(data), strict=True):
        assert (a == b).all()
    place = set(whole[0].tolist())
    for start in range(1000, 2100):
        inside = {p - start for p in place if start <= p <= start + S.REACH}
        there = {p - start - 4000 for p in place if start + 4000 <= p <= start + 4000 + S.REACH}
        assert inside & there


def test_multikey_order_sorts_groups_by_bytes():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (500, S.REACH)).astype(np.uint8)
    rows[:, 3:200] = 7
    group = rng.integers(0, 5, 500)
    order = S.multikey_order(group, rows).tolist()
    assert [(int(group[i]), rows[i].tobytes()) for i in order] == sorted((int(g), r.tobytes()) for g, r in zip(group, rows, strict=True))
