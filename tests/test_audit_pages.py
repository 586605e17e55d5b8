import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docketflow.operators import audit_pages as AP
from docketflow.operators import events as E

SCHEMA = "id long, round_id long, submission_id long, action string, created_at timestamp"
T0 = datetime(2024, 3, 1, 22)
NAMES = ["evaluation.submitted", "evaluation.kept", "submission.uploaded", "review.opened"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A log of two days appended in two parts, with ties in time and one crowded second."""
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 2]), rng.choice([4, 5, None]), rng.choice(NAMES), T0 + timedelta(minutes=rng.randint(0, 600))) for i in range(400)]
    rows += [(400 + i, 1, 4, NAMES[0], T0 + timedelta(hours=3, microseconds=i // 3)) for i in range(200)]
    folder = tmp_path_factory.mktemp("log")
    for number, part in enumerate((rows[0::2], rows[1::2])):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{folder}/part{number}")
        AP.append_with_index(spark.read.parquet(f"{folder}/part{number}"), f"{folder}/events", f"{folder}/index")
    return spark.read.parquet(f"{folder}/events"), spark.read.parquet(f"{folder}/index")


def ids(page):
    return [r.id for r in page.select("id").collect()]


@pytest.mark.parametrize("fine", [10_000, 5])
def test_deep_pages_equal_sorted_ones(stored, monkeypatch, fine):
    monkeypatch.setattr(AP, "FINE", fine)
    events, index = stored
    for filters in ({}, {"submission_id": 4, "action": "evaluation"}):
        for offset in (0, 37, 250, 10_000):
            assert ids(AP.deep_page(events, index, 1, limit=30, offset=offset, **filters)) == ids(E.audit_page(events, 1, limit=30, offset=offset, **filters))


def test_only_the_days_of_the_page_are_read(stored):
    events, index = stored
    plan = AP.deep_page(events, index, 1, limit=10, offset=5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [day" in plan


def test_cursors_walk_the_whole_log(stored):
    events, index = stored
    whole = ids(E.audit_page(events, 2, limit=200))
    after, seen = None, []
    while page := AP.next_page(events, index, 2, after, limit=60).select("id", F.unix_micros("created_at").alias("at")).collect():
        seen += [r.id for r in page]
        after = (page[-1]["at"], page[-1]["id"])
    assert seen == whole and len(seen) > 100


def test_bounds(stored):
    events, index = stored
    with pytest.raises(ValueError):
        AP.deep_page(events, index, 1, limit=0)
    assert ids(AP.deep_page(events, index, 9)) == [] and ids(AP.next_page(events, index, 9, None)) == []
