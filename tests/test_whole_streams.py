"""The stream of job states has every job."""

import os

import pytest

from tidewell.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_steps_of_all_jobs(spark):
    status = {"signup": "pending", "view": "running", "click": "running", "purchase": "completed"}
    allowed = {None: {"pending"}, "pending": {"running", "failed"}, "running": {"completed", "failed", "pending"}}
    now, steps = {}, {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts", "event_id").collect():
        s = status.get(r.event_type, "failed")
        if s in allowed.get(now.get(r.user_id), ()):
            now[r.user_id], steps[r.user_id] = s, steps.get(r.user_id, 0) + 1
    assert {r.job: r.steps for r in QUERIES["q166_state_stream"](spark, DATA).collect()} == steps
