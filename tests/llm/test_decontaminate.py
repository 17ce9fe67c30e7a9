import random

import numpy as np

from ledgerlake.llm import decontaminate as D

from .conftest import WORDS, prose


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
            last = keep
    return row[-1]


def test_bitwise_subsequence_equals_the_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert D.longest_common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == subsequence(a, b)


def item(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_copies_and_paraphrases_are_found_and_nothing_else(spark, frame, awkward_rows):
    items = [(k, item(k, n)) for k, n in enumerate((9, 14, 22, 31, 45, 70, 200))]
    items += [(50, item(90, 24) + ". " + item(91, 6) + "."), (51, "too short"), (52, None), (53, items[3][1])]
    docs = [(1000 + k, f"{item(500 + k, 60)}, {t.upper()}! {item(600 + k, 40)}") for k, t in items if k < 7]
    words = items[4][1].split()
    words[5:8] = ["other", "new"]
    docs += [(1100, f"{item(700, 30)} {' '.join(words)} {item(701, 30)}")]  # 42 of 45 words
    body, answer, _ = items[7][1].split(".")
    half = [w for k, w in enumerate(body.split()) if k % 3]  # two thirds of the question, whole answer
    docs += [(1101, f"{' '.join(half)}. {answer}."), (1102, " ".join(half)), (1103, item(800, 400))]
    rows = awkward_rows + docs
    leaks = D.find_leaks(frame(rows), benchmark(spark, items)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in leaks}
    assert found == {(1000 + k, k) for k in range(7)} | {(1003, 53), (1100, 4), (1101, 50)}
    assert next(r for r in leaks if r["doc_id"] == 1101)["answer"]
    kept = D.clean(frame(rows), benchmark(spark, items))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in found}
    assert "_hit" in kept.columns


def edited(words, keep, seed):
    """So many of the words as they are, each of the others replaced."""
    rng = random.Random(seed)
    stay = set(rng.sample(range(len(words)), keep))
    return [w if k in stay else f"new{rng.randrange(10**6)}" for k, w in enumerate(words)]


def test_every_copy_that_passes_the_checks_is_found_however_edited(spark, frame):
    rng = random.Random(4)
    vocabulary = [item(5000 + k, 1) for k in range(2000)]

    def text(n):  # every third word is one of few, as in any language
        return [rng.choice(WORDS if rng.random() < 0.35 else vocabulary) for _ in range(n)]

    items, rows, wanted = [], [], set()
    for k in range(24):
        body, answer = text(rng.randrange(12, 50)), text(6)
        items.append((k, f"{' '.join(body)}. {' '.join(answer)}."))
        n = len(body) + len(answer)
        for percent in (100, 90, 80, 70, 60):
            keep = -(-n * percent // 100)
            copy = edited(body, max(0, keep - len(answer)), 1000 * k + percent) + answer
            if percent >= 80:  # found by its share, so the answer may be edited as well
                copy = edited(body + answer, keep, 1000 * k + percent)
            rows.append((1000 * k + percent, " ".join(text(200) + copy + text(300))))
            wanted.add((rows[-1][0], k))
    found = D.find_leaks(frame(rows), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted


def test_edited_copies_of_items_around_the_longest_part_are_found(spark, frame):
    items, rows = [], []
    for k, n in enumerate((128, 129, 150, 170, 191, 192, 250)):
        words = item(40 + k, n).split()
        items.append((k, " ".join(words)))
        rows.append((k, f"{item(300 + k, 150)} {' '.join(edited(words, n - n * 15 // 100, k))} {item(400 + k, 150)}"))
    found = D.find_leaks(frame(rows), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k, _ in items}


def test_empty_tables(spark, frame, nothing):
    assert D.find_leaks(nothing, benchmark(spark, [(1, item(1, 20))])).count() == 0
    assert D.clean(frame([(1, prose(1, 50))]), benchmark(spark, [])).count() == 1


def test_rows_are_removed_by_id_and_text(spark, frame):
    leak = item(1, 30)
    rows = [(1, f"{prose(1, 40)} {leak} {prose(2, 40)}"), (1, prose(3, 90)), (None, f"{prose(4, 40)} {leak}"), (None, prose(5, 60)), (None, None)]
    kept = D.clean(frame(rows), benchmark(spark, [(7, leak)])).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == sorted([(1, prose(3, 90)), (-1, prose(5, 60)), (-1, "")])


def test_the_cosine_decides(spark, frame, monkeypatch):
    leak = item(2, 30)
    rows = frame([(1, f"{prose(1, 40)} {leak} {prose(2, 40)}"), (2, prose(3, 400))])
    assert [r["doc_id"] for r in D.find_leaks(rows, benchmark(spark, [(7, leak)])).collect()] == [1]
    monkeypatch.setattr(D, "COSINE", 2.0)
    assert D.find_leaks(rows, benchmark(spark, [(7, leak)])).count() == 0
