"""Long histories and busy findings: nothing is cut in silence, nothing is gathered that is not asked for."""

from sievespark.sources import units


def test_history_is_read_past_a_thousand_entries(spark):
    rows = [(1, i, "f", f"from{i}", f"to{i}") for i in range(1_200)] + [(2, 0, "f", None, "x")]
    changes = spark.createDataFrame(rows, "issue_id int, entry int, field string, from_text string, to_text string")
    found = {r.text for r in units.field_history(changes).where("issue_id = 1").collect()}
    assert found == {"from0"} | {f"to{i}" for i in range(1_200)}
    assert [tuple(r) for r in units.history_gaps(changes, 1_000).collect()] == [("scope_gap", "1", "unreported")]
