"""Chains of chosen spans that overlap."""

from pyspark.sql import functions as F

from sievespark.llm import pii


class Every:
    def selects(self, c):
        return F.lit(True)


def test_a_span_behind_a_dropped_one_stays(spark, monkeypatch):
    def chain(text):
        return F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit("").alias("value"), F.lit("").alias("left"), F.lit("").alias("right")) for k, s, e in ((3, 0, 10), (2, 8, 20), (3, 18, 30))]).cast(pii.SPAN)

    monkeypatch.setattr(pii, "proposals", chain)
    table = spark.createDataFrame([(1, "x" * 40)], "doc_id bigint, text string")
    assert [(c.start, c.end) for c in pii.find(table, Every()).first().added] == [(0, 10), (18, 30)]
