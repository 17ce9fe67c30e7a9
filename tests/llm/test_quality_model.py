import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import quality_model as M

from .conftest import prose


def test_held_out_accuracy_and_awkward_rows(spark, frame, awkward_rows, nothing):
    good = [(k, prose(k, 60 + k)) for k in range(100, 220)]
    bad = [(k, " ".join(w + "$$$" for w in prose(k, 50).split())) for k in range(300, 360)]
    bad += [(k, prose(k, 50).upper().replace(" ", "!! ")) for k in range(400, 460)]
    docs = frame(awkward_rows + good + bad)
    labels = spark.createDataFrame(
        [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(999, None)], "doc_id long, quality int"
    )
    network = M.fit(docs, labels, F.col("doc_id") % 3 != 1)
    scores = {r["doc_id"]: r["score"] for r in M.score(docs, network).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    held_out = [(scores[i] >= 0.5) == (i < 300) for i, _ in good + bad if i % 3 == 1]
    assert np.mean(held_out) >= 0.95
    assert scores[0] == scores[1]  # null and empty
    assert M.score(nothing, network).count() == 0
    assert M.train([], []).probability(np.zeros(16), np.zeros(16)) == 0.5


def test_the_last_byte_counts_and_blocks_equal_a_plain_loop():
    network = M.train([b"ab" * 300, b"zz" * 300, b"ab" * 90, b"zq" * 90], [1, 0, 1, 0], M.Training(rounds=2))
    tables = network.pairs()
    for text in (b"a", b"abc", b"x" * 63, b"ab" * 400 + b"Z", bytes(range(256)) * 9):
        data = text + bytes(max(0, 4 - len(text)))
        got = M.block_peaks(text, tables).max(axis=0)
        each = [sum(network.weights[k][data[p + k]] for k in range(4)) + network.bias for p in range(len(data) - 3)]
        wanted = np.maximum(np.max(each, axis=0), 0)
        assert (got >= wanted - 1e-4).all()  # padding may add windows, never hide one
    assert M.chunk_bounds(1) == [(0, 1)] and M.chunk_bounds(9) == [(0, 8), (7, 9)] and M.chunk_bounds(8) == [(0, 8)]
