"""Boxes, points and positions of pages against the forms that take characters as rows, without a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import spans
from folioscan.plans import registry

MARKS = ["a", "b", "ﬁ", "é", "𝄞", " ", "\t", "\n", "\r\n", " ", " ", "​", "\x00", "ﬃ"]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(MARKS) for _ in range(rng.choice((1, 3, 20, 90)))) for _ in range(150)] + ["".join(rng.choice("ab \n") for _ in range(60)) for _ in range(30)] + ["", None, " ", "\n\n", "\n a", "x\n" * 40]
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page int, text string").cache()


def rows(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=str)


def test_forms_agree(pages):
    chars = spans.characters(pages).cache()
    boxes = spans.line_boxes(chars).cache()
    assert rows(spans.page_line_boxes(pages)) == rows(boxes)
    hits = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(n).alias("count")) for a, n in ((0, 200), (1, 1), (2, 9), (5, 30), (70, 3))))
    asked = pages.withColumn("hits", hits)
    found = asked.select("doc_id", "page", F.explode("hits").alias("h")).select("doc_id", "page", "h.*")
    for most in (16, 2):
        assert rows(spans.page_hit_boxes(asked, most)) == rows(spans.hit_boxes(found, chars, most))
    totals = chars.groupBy("doc_id", "page").agg((F.max("word") + 1).alias("words"), (F.max("line") + 1).alias("lines"), F.count("*").alias("chars"), F.round(F.sum("x0"), 6).alias("x"), F.sum("y1").alias("y"), F.sum(F.col("pos").cast("long") * F.col("word")).alias("w"))
    assert rows(spans.page_totals(pages).withColumn("x", F.round("x", 6))) == rows(totals)
    lists = spans.words(pages.withColumn("text", F.replace("text", F.lit("\x00"), F.lit("")))).where("not word_text rlike '[ﬁﬃ]'")
    pairs = lists.alias("a").join(lists.alias("b"), F.expr("a.doc_id = b.doc_id AND b.word = a.word + 1")).select("a.doc_id", "a.page", "a.first", (F.col("b.last") - F.col("a.first") + 1).alias("count"))
    plain = pages.where("text is null or not text rlike '[ﬁﬃ]'").select("doc_id")
    assert rows(spans.page_word_boxes(pages, 2).join(plain, "doc_id")) == rows(spans.hit_boxes(pairs.join(plain, "doc_id"), chars))
    points = F.array(*(F.struct(F.lit(i).alias("point"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(((0.2, 5.0), (3.5, 20.0), (1e5, 1e5), (-1.0, -1.0), (2.0, 11.0)))))
    asked = pages.withColumn("points", points)
    given = asked.select("doc_id", "page", F.explode("points").alias("p")).select("doc_id", "page", "p.*")
    assert rows(spans.page_nearest_lines(asked)) == rows(spans.nearest_lines(given, boxes))
    assert rows(spans.page_carets(asked)) == rows(spans.carets(given, boxes, chars))
    asked = pages.withColumn("positions", F.sequence(F.lit(-1), F.lit(95)))
    given = asked.select("doc_id", "page", F.explode("positions").alias("pos"))
    for number, found in (("word", spans.words(pages)), ("line", spans.lines(pages))):
        assert rows(spans.page_around(asked, number)) == rows(spans.around(found, pages, given, number))


@pytest.mark.parametrize("name", ["search_hit_boxes", "span_characters", "span_carets", "span_nearest_lines", "span_line_boxes", "span_word_around", "span_line_around"])
def test_nothing_is_shuffled(name, spark):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
