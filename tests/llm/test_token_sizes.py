from cairnfold.llm.token_sizes import encoding, token_sizes


def test_whole_texts_are_counted(spark):
    texts = [None, "", "hello world", "naïve — 日本", "<|endoftext|>", "word " * 40_000, "x" * 5000]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, extra string")
    got = {x.doc_id: x.n_tokens for x in token_sizes(df, "text", ["doc_id"]).collect()}
    enc = encoding()
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert got[4] > 1
    assert [x.text for x in token_sizes(df, "text", ["text"]).collect()] == texts
