"""Jobs that run once across drivers, and what they do to stored edges."""

import pytest

from kairoscope.operators import temporal
from kairoscope.storage import ledger, maintenance

HOUR = 3_600_000_000


def test_one_of_two_drivers_runs_a_job(spark, tmp_path):
    one, two = (ledger.JobLedger(spark, str(tmp_path / "jobs"), interval_us=HOUR) for _ in range(2))
    ran = []
    jobs = {"a": lambda slot: ran.append(("a", slot)), "b": lambda slot: ran.append(("b", slot))}
    assert one.run_due(jobs, 5) == {"a": "done", "b": "done"} == two.run_due(jobs, 7) and ran == [("a", 0), ("b", 0)]
    assert two.run_due({"a": jobs["a"]}, HOUR + 1) == {"a": "done"} and ran[2:] == [("a", 1)]
    # Both look before either claims: one rename wins.
    first = one.claim("c", 9)
    assert first is not None and two.status("c", 10) == "running" and two.claim("c", 10) is None
    assert one.finish("c", first, 11, True) and one.status("c", 12) == "done"


def test_leases_breakers_and_budgets(spark, tmp_path):
    jobs = ledger.JobLedger(spark, str(tmp_path / "jobs"), interval_us=HOUR, lease_us=100, failures=3, reset_us=1_000, runs_per_day=6)
    lost = jobs.claim("x", 0)
    assert jobs.claim("x", 50) is None
    again = jobs.claim("x", 200)  # the first driver is gone
    assert again is not None and not jobs.finish("x", lost, 210, True) and jobs.finish("x", again, 220, False)

    def fails(slot):
        raise RuntimeError("no")

    assert jobs.run_due({"x": fails}, 300) == {"x": "failed: no"}  # with the lost one the third in a row
    assert jobs.run_due({"x": fails}, 400) == {"x": "breaker"}
    assert jobs.run_due({"x": fails}, 1_400) == {"x": "failed: no"} and jobs.run_due({"x": fails}, 1_500) == {"x": "breaker"}
    done = []
    assert jobs.run_due({"x": done.append}, 3_000) == {"x": "done"} == jobs.run_due({"x": done.append}, 3_100) and done == [0]
    assert jobs.run_due({"x": fails}, HOUR) == {"x": "failed: no"}
    assert jobs.run_due({"x": done.append}, 2 * HOUR) == {"x": "budget"}
    assert jobs.run_due({"x": done.append}, ledger.DAY_US) == {"x": "done"} and done == [0, 24]


def test_maintenance_of_stored_edges(spark, tmp_path):
    schema = "project_id string, subject string, predicate string, object string, valid_from long, valid_to long, confidence double, relevance double, support long, first_seen long, last_seen long, contradictions int, seq long, op string"
    now = 1_000 * HOUR
    rows = [("p", "s", "r", f"o{i}", i * HOUR, None if i % 3 else (i + 1) * HOUR, 0.9, 0.8, 3 if i == 1 else 1, 0, now - (i % 2) * 168 * HOUR, i % 2, 0, "insert") for i in range(8)]
    seen = [("p", "s", "r", "o1", i * 30 * HOUR, None, 0.9, 0) for i in range(5)]
    observations = spark.createDataFrame(seen, "project_id string, subject string, predicate string, object string, valid_from long, valid_to long, confidence double, observed_at long")
    tables = maintenance.edge_tables(spark, str(tmp_path / "tables"), 2)
    jobs = ledger.JobLedger(spark, str(tmp_path / "jobs"))
    assert jobs.run_due(maintenance.jobs(tables, now, observations), 0) == dict.fromkeys(maintenance.JOBS, "done")  # nothing is stored yet
    tables.merge({"edges": spark.createDataFrame(rows, schema)}, 0)
    assert jobs.run_due(maintenance.jobs(tables, now, observations), ledger.DAY_US) == dict.fromkeys(maintenance.JOBS, "done")
    edges, archive = (tables.snapshot()[n].collect() for n in ("edges", "archive"))
    left = temporal.split_expired(temporal.decay(spark.createDataFrame(rows, schema), now), now)[0]
    want = {(x.object, round(x.relevance, 9)) for x in temporal.mdl_prune(left, observations).where("NOT archived").collect()}
    assert {(x.object, round(x.relevance, 9)) for x in edges} == want
    assert {x.object for x in archive} == {f"o{i}" for i in range(8)} - {o for o, _ in want} and {"expired_interval", "mdl_prune"} == {x.reason for x in archive}
    assert jobs.run_due(maintenance.jobs(tables, now, observations), ledger.DAY_US + 5) == dict.fromkeys(maintenance.JOBS, "done") and tables.batch() == 3
    with pytest.raises(ValueError, match="unknown"):
        maintenance.changes_of("other", tables.snapshot()["edges"], now, 9)
