"""The passage stage of the pipeline keeps a user's columns, whatever their names."""

import corpus_pipeline


def test_passage_stage_keeps_columns_of_any_name(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one {passage}", "mine", 7), (2, f"two {passage}", "yours", 8), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, n_words long")
    out = corpus_pipeline.drop_repeated_passages(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert got[1] == rows[0] and got[3] == rows[2]
    assert got[2][0] == 2 and got[2][1].split() == ["two"] and got[2][2:] == ("yours", 8)
    sized = docs.selectExpr("doc_id", "text", "cast(length(text) as int) as n_chars", "removed as removed_words")
    out = corpus_pipeline.drop_repeated_passages(spark, sized, "")
    assert out.schema["n_chars"].dataType == sized.schema["n_chars"].dataType
    assert {r["doc_id"]: r["n_chars"] for r in out.collect()}[2] == len(got[2][1])
