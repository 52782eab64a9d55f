"""Languages beyond the most frequent ones."""

from tidemark.llm import language


def test_every_language_is_learned(spark):
    word = lambda k: "".join(chr(0x4E00 + 3 * k + i) for i in range(3))
    rows = [(k * 10 + i, word(k), f"l{k:03}") for k in range(230) for i in range(1 if k >= 215 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(docs)
    assert len(profiles) == 230
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_documents(docs, profiles).collect()}
    assert got == {i: lang for i, _, lang in rows}
