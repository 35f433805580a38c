from pyspark.sql import functions as F

from strata.llm import ppm


def test_the_fifth_byte_before_counts(spark):
    rows = [(i, ("abcdex", "zbcdey")[i % 2], True) for i in range(20)] + [(100, "abcdex", False), (101, "abcdey", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learned boolean")
    score = {r["doc_id"]: r["score"] for r in ppm.score_documents(docs, F.col("learned")).collect()}
    assert score[100] > score[101] + 0.5
