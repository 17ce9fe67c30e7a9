import corpus_pipeline
from ledgerlake.llm.common import store

from .conftest import prose
from .test_decontaminate import item


def test_each_stage_decides_and_keeps_columns(spark, tmp_path, frame, awkward_rows):
    leak = item(3, 40)
    rows = [(i, t) for i, t in awkward_rows if i != 10]
    rows += [(100 + k, prose(100 + k, 120)) for k in range(12)]
    rows += [(200, f"{prose(200, 60)} {leak} {prose(201, 60)}"), (201, f"{prose(202, 80)} write to a@b.com now")]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = frame(rows), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, str(tmp_path)))
        left[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    ids = [set(x) for x in left.values()]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert not ids[0] & {0, 1, 2, 3, 4} and {5, 6, 7} <= ids[0]
    assert ids[0] - ids[1] == {6, 7, 12} & ids[0]
    assert ids[1] - ids[2] == {200}
    assert "<EMAIL>" in left["PII"][201]["text"] and left["PII"][201]["n_chars"] == len(left["PII"][201]["text"])
    assert ids[4] == ids[2] and all(r["round_trip"] for r in left["BPE encoding and decoding"].values())


def test_empty_documents_pass_every_stage(spark, tmp_path, nothing):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, str(tmp_path)))
    assert docs.count() == 0
