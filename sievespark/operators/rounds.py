"""The beat of the finding table: rules in order, each seeing what those before it have done, in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import route


@dataclass(frozen=True)
class Step:
    """Rows for which ``when`` holds get the values of ``put``, or go if ``drop``; both see the steps before."""

    name: str
    when: Column
    put: dict[str, Column] = field(default_factory=dict)
    drop: bool = False


def run(state: DataFrame, steps: list[Step], counts: Observation | None = None) -> DataFrame:
    """The table after all steps, with a row's steps as ``done``. Rows that a step drops meet no later one and are left out.

    Every step is a projection of the one before, so the table is read once however many there are. ``counts``
    observes how many rows each step touched, in the same pass.
    """
    rows, hits = state.withColumn("_gone", F.lit(False)), []
    for i, step in enumerate(steps):
        hit = f"_hit{i}"
        rows = rows.withColumn(hit, ~F.col("_gone") & F.coalesce(step.when, F.lit(False)))
        changed = {c: F.when(F.col(hit), v).otherwise(F.col(c)) for c, v in step.put.items()}
        rows = rows.withColumns(changed | ({"_gone": F.col("_gone") | F.col(hit)} if step.drop else {}))
        hits.append(F.when(F.col(hit), F.lit(step.name)))
    rows = rows.withColumn("done", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"))
    if counts is not None:
        rows = rows.observe(counts, *[F.count_if(F.col(f"_hit{i}")).alias(s.name) for i, s in enumerate(steps)])
    return rows.where(~F.col("_gone")).select(*state.columns, "done")


def beat(as_of: Column, correlation: Column, retain_days: int) -> list[Step]:
    """The steps of a beat over findings joined with ``lapsed`` (their suppression has expired or is gone).

    Lapsed suppressions release their findings; what is then overdue is escalated once; missing correlation ids are
    filled; and what was resolved by absence goes after its days, unless it is suppressed.
    """
    resolved = (F.col("state") == "resolved") & (F.col("resolution") == "auto") & F.col("suppressed_at").isNull()
    nothing = F.lit(None)
    return [
        Step("released", F.col("suppressed_at").isNotNull() & F.col("lapsed"), {"suppressed_at": nothing.cast("timestamp"), "suppressed_by_id": nothing.cast("string")}),
        Step("escalated", route.overdue(as_of) & F.col("escalated_at").isNull(), {"escalated_at": as_of}),
        Step("correlated", F.col("correlation_id").isNull(), {"correlation_id": correlation}),
        Step("purged", resolved & (F.unix_timestamp("updated_at") < F.unix_timestamp(as_of) - retain_days * 86_400), drop=True),
    ]
