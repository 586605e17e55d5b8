import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docketflow.operators import events as E
from docketflow.streaming import live, stateful

SCHEMA = "id long, round_id long, submission_id long, actor_id long, action string, entity_type string, entity_id long, created_at timestamp"
T0 = datetime(2024, 1, 1, 9)
NAMES = ["assignment.created", "review.opened", "evaluation.submitted", "ai.revealed", "finding.responded", "evaluation.kept", "evaluation.revised"]


@pytest.fixture(autouse=True)
def state_store(spark):
    before = spark.conf.get(stateful.STATE_STORE[0])
    spark.conf.set(*stateful.STATE_STORE)
    yield
    spark.conf.set(stateful.STATE_STORE[0], before)


def event(i, minutes, action, of):
    return (i, 1, 5, 3, action, "assignment", of, T0 + timedelta(minutes=minutes))


def arrivals(spark, folder, batches):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).start()
    q.processAllAvailable()
    progress = [p for p in q.recentProgress]
    q.stop()
    return df.sparkSession.table(name), progress


def histories(rng, n):
    """Events of assignments with steps left out, repeated and out of order, within a few hours."""
    rows = []
    for of in range(n):
        minute = 0
        for name in sorted(rng.choices(NAMES, k=rng.randint(2, 9)), key=lambda x: NAMES.index(x) + rng.choice([0, 0, 0, 2, -2])):
            minute += rng.randint(0, 20)
            rows.append(event(len(rows) + 1, minute, name, of))
    return rows


def test_guarded_lifecycle_equals_the_batch_rules_on_a_disordered_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = histories(rng, 25)
    log = spark.createDataFrame(rows, SCHEMA)
    mixed = rows + rng.sample(rows, 30)  # some come twice
    rng.shuffle(mixed)
    end = [event(10**6, 10**5, "assignment.created", 10**6)]
    stream = arrivals(spark, str(tmp_path / "log"), [mixed[i::4] for i in range(4)] + [end])
    table, progress = drain(stateful.guarded_lifecycle(stream, "1 day", 400, 400), "guard", str(tmp_path / "ck"))
    decisions = table.cache()
    refused = {(r.assignment_id, r.event_id, r.action, r.reason) for r in decisions.filter("reason is not null").collect()}
    assert refused == {(r.assignment_id, r.event_id, r.action, r.reason) for r in E.lifecycle_violations(log).collect()} and refused
    assert decisions.count() == len(rows)
    columns = ["assignment_id", "status", "opened_at", "submitted_at", "completed_at"]
    assert {tuple(r) for r in stateful.states_of(decisions).select(columns).collect()} == {
        tuple(r) for r in E.assignment_states(log).select(columns).collect()}


class Calls:
    """A state store that counts the calls that reach it."""

    def __init__(self):
        self.n, self.timers, self.rows, self.value = 0, [], [], None

    def getValueState(self, name, schema):  # noqa: N802
        return self.of(get=lambda: self.value, exists=lambda: self.value is not None, update=lambda v: setattr(self, "value", v))

    def getListState(self, name, schema):  # noqa: N802
        return self.of(get=lambda: iter(list(self.rows)), appendList=self.rows.extend, put=lambda v: setattr(self, "rows", v), clear=self.rows.clear)

    def getMapState(self, name, key, value):  # noqa: N802
        kept = {}
        return self.of(updateValue=kept.__setitem__, iterator=lambda: iter(list(kept.items())), keys=lambda: iter(list(kept)), removeKey=kept.pop)

    def registerTimer(self, at):  # noqa: N802
        self.n += 1
        self.timers.append(at)

    def of(self, **calls):
        def counted(call):
            def one(*args):
                self.n += 1
                return call(*args)
            return staticmethod(one)
        return type("State", (), {name: counted(call) for name, call in calls.items()})()


def test_guard_calls_the_store_a_few_times_whatever_comes_together():
    """A hundred events of one assignment, some twice, cost the state store as many calls as ten."""
    calls = {}
    for size in (10, 100):
        store, guard = Calls(), stateful.LifecycleGuard(10**12, 10**12)
        guard.init(store)
        came = [Row(id=i, action=NAMES[i % 7], created_at=T0 + timedelta(seconds=i)) for i in [*range(size), *range(0, size, 3)]]
        list(guard.handleInputRows((1,), iter(came), None))
        now = type("Times", (), {"getCurrentWatermarkInMs": lambda self: stateful._micros(T0 + timedelta(days=1)) // 1000})()
        sent = [row for at in list(store.timers) for row in guard.handleExpiredTimer((1,), now, at)]
        assert [r.event_id for r in sent] == list(range(size))
        calls[size] = store.n
    assert calls[100] == calls[10] < 12


def test_state_goes_after_the_finish_and_unfinished_reviews_expire(spark, tmp_path):
    day = 24 * 60
    steps = ["assignment.created", "review.opened", "evaluation.submitted", "ai.revealed", "evaluation.kept"]
    done = [event(i, i, name, 1) for i, name in enumerate(steps)]
    left = [event(10 + i, i, name, 2) for i, name in enumerate(steps[:2])]
    clock = [[event(100 + i, days * day, "assignment.created", 100 + i)] for i, days in enumerate((5, 20, 60, 130, 135))]
    stream = arrivals(spark, str(tmp_path / "log"), [done + left, *clock])
    table, progress = drain(stateful.guarded_lifecycle(stream, "1 hour", 30, 100), "ends", str(tmp_path / "ck"))
    expired = [(r.assignment_id, r.status) for r in table.filter(F.col("action") == stateful.EXPIRED).collect()]
    assert (2, "in_progress") in expired and 1 not in {a for a, _ in expired}
    assert {r.status for r in table.filter("assignment_id = 1").orderBy("event_id").collect()} == {"assigned", "in_progress", "submitted", "completed"}
    assert sum(p.stateOperators[0].numRowsRemoved for p in progress) > 0


def test_reviews_by_a_join_of_streams_lose_nothing(spark, tmp_path):
    day = 24 * 60
    first = [event(1, 0, "review.opened", 1), event(2, 5, "review.opened", 2), event(3, 9, "review.opened", 3), event(4, 30, "evaluation.submitted", 1)]
    second = [event(5, 2 * day, "evaluation.submitted", 2), event(6, 2 * day, "review.opened", 4), event(7, 2 * day + 60, "review.opened", 1)]
    late = [event(8, 20, "evaluation.submitted", 3), event(9, 1, "review.opened", 2)]  # when the join has forgotten both
    batches = [first, second, [event(20, 40 * day, "review.opened", 9)], late, [event(21, 90 * day, "review.opened", 10)]]
    path = str(tmp_path / "log")
    stream = arrivals(spark, path, batches)
    table, _ = drain(stateful.joined_reviews(stream, "1 hour", "30 days"), "joined", str(tmp_path / "ck"))
    joined = table.cache()
    alone = [r.assignment_id for r in joined.filter("submitted_at is null").collect()]
    assert len(alone) == len(set(alone)) and {3, 4} <= set(alone)  # each sent once
    store = str(tmp_path / "store")
    q = stateful.late_events(arrivals(spark, path, []), store, str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    kept = stateful.read_late(spark, store, SCHEMA)
    assert sorted(r.id for r in kept.collect()) == [8, 9]
    columns = ["assignment_id", "opened_at", "submitted_at", "review_minutes"]
    everything = spark.createDataFrame([e for b in batches for e in b], SCHEMA)
    want = {tuple(r) for r in live.review_durations(everything).select(columns).collect()}
    assert {tuple(r) for r in stateful.review_minutes(joined, kept).select(columns).collect()} == want and len(want) == 3


def test_first_uploads_survive_a_failure_in_the_middle(spark, tmp_path):
    schema = "path string, round_id long, content binary, modificationTime timestamp"

    def arrive(number, rows):
        spark.createDataFrame([(f"f{p}", r, c.encode(), T0 + timedelta(hours=h)) for p, r, c, h in rows], schema).coalesce(1).write.parquet(
            str(tmp_path / f"in/{number:03d}"))

    for i, batch in enumerate([[(1, 1, "same", 0), (2, 1, "other", 1)], [(3, 1, "same", 2), (4, 2, "same", 2)], [(5, 1, "other", 3), (6, 1, "new", 3)],
                               [(7, 1, "far", 100)], [(8, 1, "far too", 101)], [(9, 1, "same", 102)]]):
        arrive(i, batch)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, failed = str(tmp_path / "out"), []

    def store(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the write, before the commit")

    for _ in range(2):
        q = stateful.first_uploads(stream()).writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        except Exception:  # noqa: BLE001
            assert failed
        q.stop()
    paths = sorted(r.path for r in spark.read.parquet(out).collect())
    assert failed and paths == ["f1", "f2", "f4", "f6", "f7", "f8", "f9"]  # "same" is new again after four days
