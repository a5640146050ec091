"""Rules in order over one pass: later ones see earlier ones, counts come with the pass; maps of counts added."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from sievespark.operators import finalize, rounds


def steps():
    return [
        rounds.Step("free", F.col("held"), {"held": F.lit(False)}),
        rounds.Step("late", ~F.col("held") & (F.col("n") > 2), {"n": F.col("n") * 10}),
        rounds.Step("gone", F.col("n") >= 40, drop=True),
        rounds.Step("after", F.col("n").isNotNull(), {"n": F.col("n") + 1}),
    ]


def test_each_step_sees_the_last_one(spark):
    rows = spark.createDataFrame([(1, True), (3, True), (4, False), (2, None), (None, False)], "n int, held boolean")
    counts = Observation()
    found = rounds.run(rows, steps(), counts)
    got = sorted(((r.n, r.held, r.done) for r in found.collect()), key=str)
    assert got == sorted([(2, False, ["free", "after"]), (31, False, ["free", "late", "after"]), (3, None, ["after"]), (None, False, [])], key=str)
    assert counts.get == {"free": 2, "late": 2, "gone": 1, "after": 3}


def test_the_table_is_read_once(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as int) as n", "id % 2 = 0 as held").write.parquet(f"{tmp_path}/t")
    plan = rounds.run(spark.read.parquet(f"{tmp_path}/t"), steps())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_no_steps(spark):
    assert rounds.run(spark.range(2), []).collect()[0].done == []


def test_maps_of_known_names_take_one_shuffle(spark):
    rows = spark.createDataFrame([("x", {"a": 1, "b": None}), ("x", {"a": 2}), ("x", None), ("y", None), ("z", {})], "k string, m map<string,bigint>")
    for names in (None, ["a", "b", "c"]):
        found = finalize.map_sums(rows, "k", "m", names)
        assert {r.k: r.m for r in found.collect()} == {"x": {"a": 3, "b": 0}, "y": {}, "z": {}}
    again = finalize.map_sums(rows, "k", "m", names)._jdf.queryExecution().executedPlan().toString()
    assert again.count("Exchange hashpartitioning") == 1


def test_adding_has_an_identity(spark):
    none, one = F.lit(None).cast("map<string,bigint>"), F.create_map(F.lit("a"), F.lit(1).cast("bigint"))
    row = spark.range(1).select(finalize.added(none, one).alias("x"), finalize.added(one, none).alias("y"), finalize.added(one, one).alias("z")).first()
    assert (row.x, row.y, row.z) == ({"a": 1}, {"a": 1}, {"a": 2})
