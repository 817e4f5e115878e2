"""Benchmark rows without an item_id: their words are hit and cut, they have no name."""

from panelspan.llm import decontaminate


def test_items_without_an_id_count(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing here")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passage), (7, "eight nine ten eleven after")], "item_id long, text string")
    for size in (8 << 20, 20):
        got = {r.doc_id: r for r in decontaminate.scan(docs, benchmark, cut=True, block_bytes=size).collect()}
        assert (got[1].n_hit, got[1].items, got[1].text.split()) == (12, ["7"], ["before"])
        assert (got[2].n_hit, got[2].items, got[2].text) == (0, [], "nothing here")
