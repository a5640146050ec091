"""A document tree is walked once."""

from pyspark.sql import functions as F

from sievespark.functions import documents


def test_the_plan_folds_a_tree_once(spark):
    rows = spark.createDataFrame([('{"type":"paragraph","content":[{"type":"text","text":"a  b"}]}',)], "j string")
    found = rows.select(documents.document_text(F.try_parse_json("j")).alias("text"))
    assert [r.text for r in found.collect()] == ["a b"]
    plan = str(found._jdf.queryExecution().optimizedPlan().toString())
    assert plan.count("reduce(") + plan.count("aggregate(") == 1
