"""Workers keep one model for all their tasks, and get few bytes of rows at once."""

import pyarrow as pa

import corpus_pipeline
from panelspan.llm import sentencepieces


def test_tasks_of_a_worker_share_one_model(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    runs, kind = [], type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema, *a, **b: runs.append(run) or spark.createDataFrame([], schema))
    sentencepieces.encode(docs, columns=["doc_id"])
    made, pieces = [], sentencepieces.Pieces
    monkeypatch.setattr(sentencepieces, "Pieces", lambda model: made.append(1) or pieces(model))
    rows = pa.RecordBatch.from_pydict({"row": pa.array([{"doc_id": 1}]), "text": pa.array(["a line of words"])})
    found = [out.to_pylist() for _ in range(4) for out in runs[0](iter([rows]))]
    assert len(found) == 4 and all(x == found[0] for x in found) and found[0][0]["round_trip"]
    # Before, each task made its own, and the last ones stayed until Python collected its garbage.
    assert len(made) <= 1


def test_batches_of_long_rows_are_small(spark):
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 40000) AS text")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    corpus_pipeline.tokens(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    # Before, all 40 rows were one batch of 17 MB.
    assert sum(r.rows for r in found) == 40 and max(r.bytes for r in found) < 6e6
