"""Busy findings: nothing is gathered that is not asked for."""

from pyspark.sql import functions as F

from sievespark.operators import outbox


def test_a_busy_finding_is_ranked_before_it_is_gathered(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") < 4_000, 1).otherwise(2).alias("finding_id"), F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(1_000))).alias("occurred_at"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind"))
    got = {r.finding_id: [(a.occurred_at, a.kind) for a in r.actions] for r in outbox.first_actions(rows).collect()}
    want = {}
    for r in rows.collect():
        want.setdefault(r.finding_id, []).append((r.occurred_at, r.kind))
    assert got == {k: sorted(v)[:10] for k, v in want.items()}
    plan = outbox.first_actions(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.index("_n") and "WindowGroupLimit" in plan
