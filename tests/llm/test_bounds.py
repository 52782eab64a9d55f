"""Nothing is cut off: many terms, long keys, one id on many rows."""

from pyspark.sql import functions as F

from tidemark.llm import common, language, quality, secrets, toxicity


def test_secrets_link_parts_of_any_length():
    key = "q9Xv2LmT7rKd4WzP8nBy" * 10
    ident = "user-" + "z" * 300
    scheme = "svc" + "+x" * 40
    text = f"client_id = {ident} then {key} at {scheme}://h.example.com/x"
    _, more = secrets.scan(text)
    got = {k: text[s:e] for s, e, k in more}
    assert got == {"ident": ident, "key": key, "endpoint": f"{scheme}://h.example.com/x"}


def test_endpoints_start_at_a_letter_of_a_new_word():
    found = lambda t: [t[s:e] for s, e, _ in secrets.endpoints(t)]
    assert found("see Foo.http://x.y/z, 1ftp://a b://c") == ["http://x.y/z"]
    assert found("a." * 50_000 + "//x") == [] and len(found("a." * 50_000 + "b://x")[0]) == 100_005


def test_more_terms_than_two_thousand_are_learned(spark):
    words = lambda k: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(k * 60, k * 60 + 60))
    rows = [(40 * k + j, words(k) if j < 12 else "plain text of no harm " * 3) for k in range(36) for j in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not t.startswith("plain"))) for i, t in rows], "doc_id long, toxic int")
    assert len(toxicity.learn(docs, labels).terms) > 2_000


def test_one_id_on_many_rows_teaches_once(spark):
    docs = spark.range(5_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word number "), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(8, "you vile scum")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 0, 1), (8, 1, 0)], "doc_id long, toxic int, quality int")
    lexicon = toxicity.learn(docs, labels)
    assert lexicon.terms == {} and abs(lexicon.score((0.0, 0.0, 0.0)) - 0.5) < 0.01
    assert quality.fit(docs, labels, "doc_id", "text", "quality", None, 100) is not None


def test_rows_without_an_id_teach_languages_by_their_share(spark):
    rows = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("abc "), F.repeat(F.lit("x"), (F.col("id") % 50 + 1).cast("int")), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    assert language.learn(rows, max_train=400)["xx"]


def test_words_of_other_scripts_stay_apart():
    assert toxicity.fold("Größe 漢字 слово — привет’s") == ["grosse", "漢字", *toxicity.fold("слово"), *toxicity.fold("приветs")]


def test_sites_join_alike_by_broadcast_and_by_shuffle(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 30), ("b", 20)], "k string, w int")
    got = [sorted(map(str, common.join_sites(left, right, ["k"], rows).collect())) for rows in (3, 10**9)]
    assert got[0] == got[1] and len(got[0]) == 4
