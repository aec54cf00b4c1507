"""Streaming jobs on small logs."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from gaugeleaf.plans import streams
from gaugeleaf.sources import store
from gaugeleaf.sources.domain import Tables
from gaugeleaf.streaming import events, jobs, stateful

AT = dt.datetime(2024, 1, 1)


def finish(stream, tmp_path, mode="complete"):
    job = stream.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    return stream.sparkSession.table("out").collect()


def test_job_status_drops_repeats(spark, tmp_path):
    rows = [(1, "j", "parse", "done", AT), (1, "j", "parse", "done", AT + dt.timedelta(seconds=5)), (2, "j", "match", "running", AT + dt.timedelta(seconds=9)), (3, "k", "parse", "failed", AT)]
    df = spark.createDataFrame(rows, "event_id long, job_id string, stage string, status string, at timestamp")
    df.write.parquet(str(tmp_path / "log"))
    fresh = finish(jobs.fresh_events(store.log_source(spark, str(tmp_path / "log"), df.schema)), tmp_path, "append")
    got = jobs.job_status(spark.createDataFrame(fresh, df.schema))
    assert sorted((r.job_id, r.stage, r.status, r.n_events) for r in got.collect()) == [("j", "match", "running", 2), ("k", "parse", "failed", 1)]
    later = spark.createDataFrame([("j", "done", "ok", AT + dt.timedelta(minutes=1), 1), ("k", "scan", "ok", AT - dt.timedelta(minutes=1), 2)], got.schema)
    assert sorted((r.job_id, r.stage, r.n_events) for r in jobs.merged_status(got, later).collect()) == [("j", "done", 3), ("k", "parse", 3)]


def test_dead_letters(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, None), (3, "bad")], "id long, status string")
    df.write.parquet(str(tmp_path / "log"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    source = store.log_source(spark, str(tmp_path / "log"), df.schema)
    source.writeStream.foreachBatch(jobs.with_dead_letters(good, bad, F.col("status") == "ok")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.id for r in spark.read.parquet(good).collect()] == [1]
    assert sorted(r.id for r in spark.read.parquet(bad).collect()) == [2, 3]


def test_log_round_trip_and_progress(spark, tmp_path):
    rows = [("a", "done", AT), ("a", "open", AT), ("b", "done", AT), ("a", "done", AT + dt.timedelta(minutes=59)), ("a", "done", AT + dt.timedelta(hours=3)), ("c", "done", AT + dt.timedelta(hours=9))]
    df = spark.createDataFrame(rows, "job string, status string, at timestamp")
    df.write.parquet(str(tmp_path / "log"))
    store.log_sink(store.log_source(spark, str(tmp_path / "log"), df.schema), str(tmp_path / "copy"), str(tmp_path / "cp1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 6
    got = finish(jobs.progress(store.log_source(spark, str(tmp_path / "copy"), df.schema), "job"), tmp_path, "append")
    assert sorted((r.job, r.done) for r in got) == [("a", 1), ("a", 2), ("b", 1)]  # c is still open


LATER = dt.datetime(2030, 1, 1)


def staged(spark, tmp_path, schema, start, *chunks):
    """The rows a job has emitted after each chunk of its log."""
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    got = []
    with stateful.with_timers(spark):
        for chunk in chunks:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
            stream = start(store.log_source(spark, path, spark.createDataFrame([], schema).schema))
            job = stream.writeStream.outputMode("update" if "push" in stream.columns else "append")
            job = job.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            job.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
            got.append(sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{out}/batch=*").collect()))
    return got


def test_mastery_in_event_time_with_late_answers_and_forgetting(spark, tmp_path):
    day = lambda n: AT + dt.timedelta(days=n)
    schema = "student_id long, submission_id long, answer_no int, is_correct boolean, answered_at timestamp"
    first = [(7, 1, 1, True, day(0)), (7, 1, 3, True, day(2)), (7, 1, 4, None, day(2)), (8, 5, 1, True, day(2))]
    second = [(7, 1, 2, False, day(1.5)), (7, 0, 9, True, day(-9)), (7, 2, 1, True, day(60))]  # late, too late, after the forgetting
    run = lambda log: stateful.streaming_mastery(log, delay="1 day", forget="30 days")
    early, _, end = staged(spark, tmp_path, schema, run, first, second, [(-1, 0, 0, True, LATER)])
    assert early == [(7, 1, 1, 1, 1, "learning")]
    assert [r for r in end if r[0] > 0] == [(7, 1, 1, 1, 1, "learning"), (7, 1, 2, 2, 0, "learning"), (7, 1, 3, 3, 1, "practicing"), (7, 2, 1, 1, 1, "learning"), (8, 5, 1, 1, 1, "learning")]


def test_retries_wait_longer_and_end(spark, tmp_path):
    at = lambda s: AT + dt.timedelta(seconds=s)
    schema = "task_id long, kind string, event string, at timestamp"
    sent = [(k, "textbook" if k == 4 else "exam", "submitted", at(0)) for k in (1, 2, 3, 4, 6)]
    told = [(1, "exam", "done", at(75)), (2, "exam", "error", at(0)), (6, "exam", "done", at(331)), (5, "exam", "done", at(9)), (1, "exam", "submitted", at(80))]
    _, end = staged(spark, tmp_path, schema, lambda log: stateful.retried(log), sent + told, [(-1, "", "tick", LATER)])
    by = {}
    for task, attempt, when, outcome in end:
        by.setdefault(task, []).append((attempt, (when - AT).total_seconds(), outcome))
    assert by[1] == [(0, 0, "waiting"), (1, 30, "waiting"), (2, 60, "waiting"), (3, 90, "done")]
    assert by[2] == [(0, 0, "error")] and 5 not in by
    assert by[6][-2:] == [(10, 300, "waiting"), (11, 360, "done")]
    assert by[3][-1] == (60, 30 * 10 + 60 * 10 + 120 * 40, "dead") and by[4][-1] == (120, 30 * 10 + 60 * 10 + 120 * 100, "dead")
    assert [len(by[k]) for k in (3, 4)] == [61, 121]


def test_jobs_finish_once(spark, tmp_path):
    at = lambda m: AT + dt.timedelta(minutes=m)
    schema = "job_id string, batch long, expected int, n long, total long, at timestamp"
    rows = lambda *r: [(j, b, e, 1, 10, at(m)) for j, b, e, m in r]
    first = rows(("a", 0, 2, 0), ("a", 0, 2, 1), ("b", 0, 3, 0), ("b", 2, 3, 5), ("c", 0, 1, 0))
    second = rows(("a", 1, 2, 8), ("a", 1, 2, 9), ("c", 0, 1, 30))  # doubled, after the end
    third = rows(("b", 1, 3, 90), ("z", 0, 1, 70))  # behind the patience of b
    fourth = rows(("c", 0, 1, 500))  # forgotten by then: a new job
    early, done, _, late = staged(spark, tmp_path, schema, lambda log: stateful.finished_jobs(log), first, second, third, fourth)
    assert early == [("c", "complete", 1, 0, 1, 10)]
    assert done == [("a", "complete", 2, 0, 2, 20), ("c", "complete", 1, 0, 1, 10)]
    assert [r for r in late if r[0] == "b"] == [("b", "timed out", 2, 1, 2, 20)] and len([r for r in late if r[0] == "c"]) == 2


def test_boards_are_sent_for_touched_classes(spark, tmp_path):
    schema = "submission_id long, student_id long, class_id long, assignment_id string, state string, score double, submitted_at timestamp"
    at = lambda m: AT + dt.timedelta(minutes=m)
    chosen = spark.createDataFrame([(1, "x"), (2, "y")], "class_id long, assignment_id string")
    counts = spark.createDataFrame([(10, 4)], "submission_id long, submitted long")
    first = [(10, 100, 1, "x", "submitted", None, at(0)), (11, 101, 1, "x", "graded", 9.0, at(0)), (12, 102, 2, "other", "graded", 9.0, at(0))]
    second = [(13, 100, 1, "x", "graded", 7.0, at(-5)), (14, 102, 2, "y", "submitted", None, at(5))]  # an older one changes nothing
    third = [(15, 100, 1, "x", "graded", 8.0, at(9))]
    boards = staged(spark, tmp_path, schema, lambda log: stateful.live_boards(log, chosen, counts), first, second, third)
    pushes = [sorted({r[:2] for r in b}) for b in boards]
    assert pushes == [[(1, 1)], [(1, 1), (2, 1)], [(1, 1), (1, 2), (2, 1)]]
    assert [(r[2], r[4], r[5], r[6], r[7]) for r in boards[2] if r[:2] == (1, 2)] == [(100, 15, 0, 8.0, "graded"), (101, 11, 0, 9.0, "graded")]


def test_bounded_log_drops_segments(spark, tmp_path):
    path = str(tmp_path / "kept")
    write = jobs.bounded_log(path, 10)
    batch = lambda lo, hi: spark.range(lo, hi).toDF("id")
    for n in range(30):
        write(batch(4 * n, 4 * n + 4), n)
        held = sum(rows for _, _, rows in jobs.segments(spark, path))
        assert min(10, 4 * n + 4) <= held < 14
    write(batch(116, 119), 29)  # run again with fewer rows
    write(batch(0, 0), 30)
    assert sorted(r.id for r in jobs.newest(spark.read.parquet(path), ["id"], 10).collect()) == list(range(109, 119))


def test_replace_children(spark, tmp_path):
    path = str(tmp_path / "children")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "parent int, v string")
    store.replace_children(first, path, "parent")
    store.replace_children(spark.createDataFrame([(1, "z")], first.schema), path, "parent")
    assert sorted((r.parent, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


def test_upserts_touch_one_day(spark, tmp_path):
    path = str(tmp_path / "days")
    write = events.upsert_batches(path, "day", lambda old, new: old.unionByName(new).groupBy("id", "day").agg(F.sum("n").cast("int").alias("n")))
    rows = lambda *r: spark.createDataFrame(r, "id int, day string, n int")
    write(rows((1, "mon", 1), (2, "mon", 1), (1, "tue", 1)), 0)
    tuesday = sorted(p.name for p in (tmp_path / "days" / "day=tue").glob("part-*"))
    for _ in range(2):  # the second is a rerun
        write(rows((1, "mon", 5)), 1)
    write(rows((1, "mon", 2), (9, "wed", 4)), 2)
    assert sorted(tuple(r) for r in events.current(spark, path).select("id", "day", "n").collect()) == [(1, "mon", 8), (1, "tue", 1), (2, "mon", 1), (9, "wed", 4)]
    assert sorted(p.name for p in (tmp_path / "days" / "day=tue").glob("part-*")) == tuesday


def test_jobs_of_many_batches_are_complete(spark, tmp_path):
    spark.range(1, 6802).selectExpr("id AS p_partkey", "concat('Brand#1', CAST(1 + id % 2 AS STRING)) AS p_brand", "'a b' AS p_name", "'T' AS p_type", "CAST(1 AS INT) AS p_size", "1.0D AS p_retailprice").repartition(3).write.parquet(str(tmp_path / "part.parquet"))
    got = streams.l10(Tables(spark, str(tmp_path))).collect()
    assert sorted((r.job_id, r.outcome, r.arrived, r.missing, r.n, r.total) for r in got) == [("Brand#11", "complete", 68, 0, 3400, 10200), ("Brand#12", "timed out", 68, 1, 3400, 10200)]


def test_dead_letters_are_counted_beyond_the_log(spark, tmp_path):
    good, bad, counts = (str(tmp_path / name) for name in ("good", "bad", "counts"))
    write = jobs.with_dead_letters(good, bad, F.col("id") % 2 == 0, most=10, counts_path=counts)
    for n in range(4):
        write(spark.range(40 * n, 40 * n + 40), n)
    write(spark.range(120, 158), 3)  # run again with fewer rows
    assert spark.read.schema("n long").parquet(counts).agg(F.sum("n")).first()[0] == 79
    assert spark.read.parquet(bad).count() < 79


def test_dead_letters_query_counts_all(spark, tmp_path):
    at = "timestamp_seconds(1704067200 + id) AS ts"
    events = spark.range(3000).selectExpr("id AS event_id", "id % 7 AS user_id", at, "'click' AS event_type", "CASE WHEN id % 5 <> 0 THEN CAST(1 + 5 * (id % 2) AS DOUBLE) END AS value", "'' AS props")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert {r.n for r in streams.a15(Tables(spark, str(tmp_path))).collect()} == {1200}


class CountedState:
    """Stands for a state of any kind; counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def call(self, result=None):
        self.calls += 1
        return result

    def exists(self):
        return self.call(bool(self.held))

    def clear(self):
        self.held = self.call({})

    def get(self):
        return self.call(self.held.get("value", self.held.get("list")))

    def update(self, value):
        self.held = self.call({"value": value})

    def put(self, rows):
        self.held = self.call({"list": list(rows)})

    def appendValue(self, row):
        self.call(self.held.setdefault("list", []).append(row))

    def containsKey(self, key):
        return self.call(key in self.held)

    def getValue(self, key):
        return self.call(self.held[key])

    def updateValue(self, key, value):
        self.call(self.held.update({key: value}))

    def iterator(self):
        return self.call(iter(list(self.held.items())))


class CountedHandle:
    def __init__(self):
        self.states, self.timers = [], []

    def state(self, *_):
        self.states.append(CountedState())
        return self.states[-1]

    getListState = getValueState = getMapState = state

    def registerTimer(self, at):
        self.timers.append(at)

    def calls(self):
        return sum(s.calls for s in self.states) + len(self.timers)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_mastery_calls_the_state_once_for_a_bucket():
    fold = stateful.EventTimeFold("student_id", ["at_us", "submission_id", "answer_no", "is_correct"], (0, 0), stateful.mastery_step(3), ["submission_id", "answer_no", "attempt", "streak", "state"])
    handle = CountedHandle()
    fold.init(handle)
    rows = pd.DataFrame([(s, 1000 * (5 - n), s, n, s % 2 == 0) for s in range(500) for n in range(5)], columns=["student_id", "at_us", "submission_id", "answer_no", "is_correct"])
    list(fold.handleInputRows((0,), iter([rows]), None))
    early = pd.concat(fold.handleExpiredTimer((0,), Watermark(3), None))
    late = pd.concat(fold.handleExpiredTimer((0,), Watermark(9), None))
    assert (len(early), len(late)) == (1500, 1000) and handle.calls() < 20
    assert late[late["student_id"] == 4][["answer_no", "attempt", "streak", "state"]].values.tolist() == [[1, 4, 4, "mastered"], [0, 5, 5, "mastered"]]


def test_retries_call_the_state_once_for_a_bucket():
    handle, retries = CountedHandle(), stateful.Retries(stateful.POLL_DELAYS, stateful.MOST_POLLS, 86_400_000_000)
    retries.init(handle)
    rows = [(k, "submitted", "exam", 1_000_000) for k in range(400)] + [(k, "done", "exam", 62_000_000) for k in range(0, 400, 2)]
    list(retries.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["task_id", "event", "kind", "at_us"])]), None))
    first = pd.concat(retries.handleExpiredTimer((0,), Watermark(40_000), None))
    rest = pd.concat(retries.handleExpiredTimer((0,), Watermark(10**9), None))
    assert len(first) == 800 and handle.calls() < 20
    assert rest[rest["task_id"] == 6].values.tolist() == [[6, 2, 61_000_000, "waiting"], [6, 3, 91_000_000, "done"]]
    assert rest[rest["task_id"] == 7].values.tolist()[-1] == [7, 60, 1_000_000 + 1_000_000 * (300 + 600 + 4800), "dead"]
    assert len(rest) == 200 * 2 + 200 * 59 and not handle.states[0].held


def test_a_board_calls_the_state_for_its_parts():
    handle, board = CountedHandle(), stateful.Board()
    board.init(handle)
    rows = pd.DataFrame([(s, 10 * n, s + n, n, None, "graded") for s in range(1000) for n in range(3)], columns=["student_id", "at_us", "submission_id", "submitted", "score", "state"])
    sent = pd.concat(board.handleInputRows((1,), iter([rows]), None))
    assert len(sent) == 1000 and set(sent["at_us"]) == {20} and handle.calls() <= 2 * stateful.BOARD_PARTS + 5
    assert not list(board.handleInputRows((1,), iter([rows]), None))  # nothing new
