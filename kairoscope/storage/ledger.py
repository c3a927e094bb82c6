"""Recurring jobs that run once for each of their times, however many drivers ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from kairoscope.storage.manifest import ConflictError, Manifest

DAY_US = 24 * 3_600_000_000
#: A day between runs, failures in a row that open the breaker, and the time until it is tried again.
INTERVAL_US, FAILURES, RESET_US = DAY_US, 5, 300_000_000
LEASE_US = 3_600_000_000


class JobLedger:
    """``path``/<job>/versions: what happened to a job, each step put in place by a rename that one driver wins.

    Time is cut in slots of ``interval_us``; a job is due once a slot. A claim lasts ``lease_us``: a driver that is gone by
    then loses it. A job that failed is due again in its slot, until ``failures`` failures in a row open its breaker for
    ``reset_us``; then one more try is let through. ``runs_per_day`` bounds the runs that a day begins. All moments are
    arguments.
    """

    def __init__(self, spark: SparkSession, path: str, interval_us: int = INTERVAL_US, lease_us: int = LEASE_US, runs_per_day: int | None = None, failures: int = FAILURES, reset_us: int = RESET_US):
        self.spark, self.path = spark, path.rstrip("/")
        self.interval, self.lease, self.runs_per_day, self.failures, self.reset = interval_us, lease_us, runs_per_day, failures, reset_us

    def _steps(self, job: str) -> Manifest:
        return Manifest(self.spark, f"{self.path}/{job}")

    def status(self, job: str, now_us: int) -> str:
        """due, done, running, breaker or budget."""
        last = self._steps(job).state()
        if last is None:
            return "due"
        if last["status"] == "running" and now_us - last["at"] < self.lease:
            return "running"
        if last["status"] == "done" and last["slot"] >= now_us // self.interval:
            return "done"
        if last["failures"] >= self.failures and now_us - last["at"] < self.reset:
            return "breaker"
        if self.runs_per_day is not None and last["day"] == now_us // DAY_US and last["runs"] >= self.runs_per_day:
            return "budget"
        return "due"

    def claim(self, job: str, now_us: int) -> int | None:
        """The number of a claim; none where the job is not due, or another driver has it."""
        if self.status(job, now_us) != "due":
            return None
        steps = self._steps(job)
        number, last = steps.last() + 1, steps.state() or {"failures": 0, "day": -1, "runs": 0}
        runs = last["runs"] if last["day"] == now_us // DAY_US else 0
        # A claim whose driver is gone counts as a failure.
        lost = 1 if last.get("status") == "running" else 0
        claim = {"status": "running", "slot": now_us // self.interval, "at": now_us, "failures": last["failures"] + lost, "day": now_us // DAY_US, "runs": runs + 1}
        try:
            steps.commit(number, claim)
        except ConflictError:
            return None
        return number

    def finish(self, job: str, claim: int, now_us: int, ok: bool) -> bool:
        """Notes the end of a run; false where its claim was lost meanwhile."""
        steps = self._steps(job)
        state = steps.state(claim)
        end = state | {"status": "done" if ok else "failed", "at": now_us, "failures": 0 if ok else state["failures"] + 1}
        try:
            steps.commit(claim + 1, end)
        except ConflictError:
            return False
        steps.forget(keep=8)
        return True

    def run_due(self, jobs: dict[str, Callable[[int], None]], now_us: int, clock: Callable[[], int] | None = None) -> dict[str, str]:
        """Runs every job that is due with the number of its slot; what became of each. ``clock`` tells when a run ends."""
        out = {}
        for name, job in jobs.items():
            claim = self.claim(name, now_us)
            if claim is None:
                out[name] = self.status(name, now_us)
                continue
            try:
                job(now_us // self.interval)
                out[name] = "done"
            except Exception as e:  # a job's failure is its status; others go on
                out[name] = f"failed: {e}"
            self.finish(name, claim, clock() if clock else now_us, out[name] == "done")
        return out
