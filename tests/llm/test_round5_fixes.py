"""All trusted documents count."""

from labelforge.llm import quality


# ---- op3

def test_every_trusted_document_is_counted(spark):
    n = 20_400
    docs = spark.createDataFrame([(i, f"w{i}x y{i % 97} some words") for i in range(n)], "doc_id long, text string").repartition(8)
    # what is trusted whole differs from the corpus in nothing
    got = quality.judge(docs, docs.select("doc_id"), pairs=True).where("abs(score) > 1e-9").count()
    assert got == 0


def test_trusted_ids_count_once(spark, docs):
    trusted = spark.createDataFrame([(i,) for i in [*range(30), *range(10), None]], "doc_id long")
    once = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    order = lambda ids: sorted(map(str, quality.judge(docs, ids).select("doc_id", "text", "n_words", "score").collect()))
    assert order(trusted) == order(once)
