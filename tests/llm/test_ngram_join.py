import collections
import random

import numpy as np

from ledgerlake.llm import ngram_join as J
from ledgerlake.llm.graph import components
from ledgerlake.llm.shingles import Powers, hashed_words, shingle_sets

from .conftest import prose


def brute(rows):
    """(shingles, component) by comparing every pair."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)), key=lambda k: rows[k][0])
                parent[y] = x
    return {i: (len(s), rows[root(k)][0]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}


def edited(text, rng, share):
    words = text.split()
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def many_rows(awkward_rows):
    rng = random.Random(11)
    passage = prose(77, 25)
    rows = list(awkward_rows)
    for group in range(6):
        text = prose(100 + group, rng.randrange(30, 200))
        rows += [(1000 + 50 * group + k, edited(text, rng, share)) for k, share in enumerate([0, 0, 0.004, 0.01, 0.02, 0.03, 0.05])]
    rows += [(2000 + k, f"{passage} {prose(300 + k, 10)}") for k in range(30)]  # one passage in many documents
    rows += [(3000 + k, passage + f" tail{k}") for k in range(12)]  # documents that are little but the passage
    rng.shuffle(rows)
    return rows


def test_components_equal_all_pairs(frame, awkward_rows):
    rows = many_rows(awkward_rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_groups(frame(rows)).collect()}
    assert got == brute(rows)


def test_one_of_each_group_stays(frame, awkward, awkward_rows, nothing):
    kept = J.one_of_each(awkward)
    want = {i for i, (_, c) in brute(awkward_rows).items() if c == i}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == awkward.columns
    assert J.one_of_each(nothing).count() == 0
    same = prose(5, 50)
    odd = frame([(None, same), (None, prose(6, 50)), (5, same), (5, prose(7, 50)), (3, same)])
    left = sorted(((r["doc_id"], r["text"]) for r in J.one_of_each(odd).collect()), key=str)
    assert left == sorted([(None, same), (None, prose(6, 50)), (5, prose(7, 50)), (3, same)], key=str)


def test_only_rows_that_meet_get_bitmaps(frame, monkeypatch):
    """One passage in many different documents makes tiles, but no row of it may be linked to another."""
    passage = prose(77, 25)
    rows = [(k, f"{passage} {prose(300 + k, 100)}") for k in range(30)]
    meeting, met = J._meeting, []
    monkeypatch.setattr(J, "_meeting", lambda *sides: met.append((sides[:2], meeting(*sides))) or met[0][1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_groups(frame(rows)).collect()}
    assert got == brute(rows)
    (before, after), = met
    assert all("bitmap" not in side.columns for side in before)
    assert [side.count() for side in after] == [0, 0]


def test_texts_travel_and_not_their_sets(frame):
    texts = J._texts(frame([(1, prose(1, 200)), (2, None), (3, prose(3, 4))]), "doc_id", "text")
    sent = J.keyed_texts(texts, texts.select("id"))
    assert sent.columns == ["k1", "k2", "text"]
    assert {r["text"] for r in sent.collect()} == {prose(1, 200), prose(3, 4)}


def test_chains_and_stars_of_links(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, *range(200, 250))}


def test_word_hashes_do_not_depend_on_neighbours_or_length():
    texts = ["b a", None, "", "A\tb\x0bC", "x" * 700_000 + " a", "a " * 300_000]
    parts = hashed_words(texts, Powers())
    a, b = parts[0][1], parts[0][0]
    assert [len(p) for p in parts] == [2, 0, 0, 3, 2, 300_000]
    assert parts[3][0] == a and parts[3][1] == b and parts[4][1] == a and set(parts[5].tolist()) == {int(a)}
    words = [f"{k:x}" for k in range(50_000)]
    assert len(np.unique(hashed_words([" ".join(words)], Powers())[0])) == 50_000
    sizes = [len(s) for s in shingle_sets(["a b c d e f", "a b", "a a a a a a a a"], Powers())]
    assert sizes == [2, 1, 1]


def test_prefixes_and_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = x[rng.random(len(x)) > rng.random() * 0.15]
        y = np.unique(np.append(keep, rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)))
        common = len(np.intersect1d(x, y))
        if len(y) and 9 * common >= 4 * (len(x) + len(y)):
            assert np.intersect1d(x[: J.prefix_length(len(x))], y[: J.prefix_length(len(y))]).size
            p, q = sorted((J.bitmap(x), J.bitmap(y)), key=len)
            while len(q) > len(p):
                q = q[: len(q) // 2] | q[len(q) // 2 :]
            for s, o, size in ((J.bitmap(x), J.bitmap(y), len(x)), (J.bitmap(y), J.bitmap(x), len(y))):
                s, o = (v if len(v) == len(p) else q for v in (s, o))
                assert size - int(np.bitwise_count((s & ~o).view(np.uint64)).sum()) >= common
    assert collections.Counter(J.prefix_length(n) for n in range(1, 6)) == {1: 4, 2: 1}
