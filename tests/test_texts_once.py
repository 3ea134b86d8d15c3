"""Texts are made comparable once for each document."""

from pyspark.sql import functions as F

from folioscan.operators import report


def test_comparable_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(report, "comparable", F.udf(counted, "string"))
    docs = spark.createDataFrame([(i, "ab" * (20 + i), "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    got = report.text_report(report.text_distances(docs)).first()
    assert (got["measured"], got["too_short"], got["worst"]) == (49, 0, 2 / 42)
    assert seen.value == 50  # 100 before: once for the sample of the ranges
