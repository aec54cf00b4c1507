"""Stateful operators with event-time timers: ordered folds, retries, barriers and live status of classes.

Each keeps, for a key, a bounded state in the state store and acts when the watermark has passed a time.
Times come in and go out as microseconds since 1970 (at_us), so that no session time zone enters.  They
need a watermark on the stream's event time and the RocksDB state store (with_timers).  A call of the state
store costs far more than a step, so keys share theirs in buckets of some hundred, given by their hash.
"""

from __future__ import annotations

import contextlib
import itertools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -1


@contextlib.contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need; the setting is put back at the end."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def tuples(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [row for frame in frames for row in frame[columns].itertuples(index=False, name=None)]


def after(at_us: int) -> int:
    """The timer that fires once the watermark has passed a time."""
    return at_us // 1000 + 1


#: Keys of a bucket where their number is known, and the number of buckets where it is not.
KEYS_A_BUCKET, BUCKETS = 256, 1024


def buckets_for(keys: int) -> int:
    """The number of buckets for so many keys; a running stream must keep its own."""
    return max(64, -(-keys // KEYS_A_BUCKET))


def in_buckets(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))


class EventTimeFold(StatefulProcessor):
    """Folds the rows of each key of a bucket in the order of their event time, however they arrive.

    Rows wait until the watermark has passed them; then fold(state, row) gives the next state and a row to
    emit.  Rows later than the watermark allows never reach it.  A state that has had no row for forget_us
    is dropped, and the key begins anew.
    """

    def __init__(self, key: str, reads: list[str], begin: tuple, fold: Callable, emits: list[str], forget_us: int | None = None):
        self.key, self.reads, self.begin, self.fold, self.emits, self.forget_us = key, reads, begin, fold, emits, forget_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # (key, at_us, ...) of all arrivals
        self.folded = handle.getValueState("folded", "states binary")  # (last_us, state) by key

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = tuples(rows, [self.key, *self.reads])
        self.waiting.appendValue((pickle.dumps(arrived),))
        self.handle.registerTimer(after(min(r[1] for r in arrived)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [row for r in self.waiting.get() for row in pickle.loads(r[0])] if self.waiting.exists() else []
        due, later = sorted(r for r in held if r[1] <= now), [r for r in held if r[1] > now]
        states = pickle.loads(self.folded.get()[0]) if self.folded.exists() else {}
        out = []
        for own, rows in itertools.groupby(due, key=lambda r: r[0]):
            last, state = states.get(own, (NEVER, self.begin))
            for _, *row in rows:
                if self.forget_us is not None and last != NEVER and row[0] - last >= self.forget_us:
                    state = self.begin
                state, made = self.fold(state, row)
                last = row[0]
                out.append((own, *made))
            states[own] = last, state
        forgotten = [own for own, (last, _) in states.items() if self.forget_us is not None and last + self.forget_us <= now]
        for own in forgotten:
            del states[own]
        if due or forgotten:
            self.folded.update((pickle.dumps(states),)) if states else self.folded.clear()
            if states and self.forget_us is not None:
                self.handle.registerTimer(after(min(last for last, _ in states.values()) + self.forget_us))
        if due and later:
            self.waiting.put([(pickle.dumps(later),)])
            self.handle.registerTimer(after(min(r[1] for r in later)))
        elif due:
            self.waiting.clear()
        for at in range(0, len(out), 100_000):
            yield pd.DataFrame(out[at : at + 100_000], columns=[self.key, *self.emits])

    def close(self) -> None:
        pass


def mastery_step(run: int) -> Callable:
    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        attempts, streak = state
        _, submission_id, answer_no, right = row
        attempts, streak = attempts + 1, streak + 1 if right else 0
        return (attempts, streak), (submission_id, answer_no, attempts, streak, "mastered" if streak >= run else "practicing" if attempts >= 3 else "learning")

    return step


def streaming_mastery(answers: DataFrame, delay: str = "1 day", run: int = 3, forget: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """submission_id, answer_no, attempt, streak and state after each answer of a student, in the order of answered_at.

    Needs student_id, submission_id, answer_no, is_correct (null: not graded, passed over) and answered_at.
    Answers up to delay late still come in their place.
    """
    timed = answers.where("is_correct is not null").withWatermark("answered_at", delay).withColumn("at_us", F.unix_micros("answered_at"))
    idle = None if forget is None else micros(answers.sparkSession, forget)
    fold = EventTimeFold("student_id", ["at_us", "submission_id", "answer_no", "is_correct"], (0, 0), mastery_step(run), ["submission_id", "answer_no", "attempt", "streak", "state"], idle)
    schema = "student_id long, submission_id long, answer_no int, attempt int, streak int, state string"
    return in_buckets(timed, "student_id", buckets).groupBy("bucket").transformWithStateInPandas(fold, schema, "Append", "EventTime")


def streak_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    current, longest, last = state
    _, day = row
    if day != last:
        current = current + 1 if day == last + 1 else 1
    longest = max(longest, current)
    return (current, longest, day), (day, current, longest)


def streaming_streaks(events: DataFrame, at: str, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """student_id, day (days since 1970), current and longest run of days after each event of a student, in the order of event time."""
    timed = events.withWatermark(at, delay).select("student_id", at, F.unix_micros(at).alias("at_us"), F.datediff(F.col(at), F.lit("1970-01-01")).cast("long").alias("day"))
    fold = EventTimeFold("student_id", ["at_us", "day"], (0, 0, -2), streak_step, ["day", "current", "longest"])
    return in_buckets(timed, "student_id", buckets).groupBy("bucket").transformWithStateInPandas(fold, "student_id long, day long, current long, longest long", "Append", "EventTime")


def micros(spark: SparkSession, interval: str) -> int:
    """The length of an interval such as '30 days', by Spark's own reading of it."""
    zero = F.timestamp_seconds(F.lit(0))
    return spark.range(1).select((F.unix_micros(zero + F.expr(f"interval {interval}")) - F.unix_micros(zero)).alias("n")).first().n


class Retries(StatefulProcessor):
    """Asks for the outcome of the tasks of a bucket again and again, later each time, until it is there or the attempts are used up.

    An attempt is made at submission and after each delay; at its time it sees the events that have
    happened by then.  Emits a row for each attempt: waiting, done, error, or dead at the last one.
    What is known of a task goes with its outcome; events of a task that is never submitted go after keep_us.
    """

    def __init__(self, delays: tuple[tuple[int, int], ...], most: dict[str, int], keep_us: int):
        self.most, self.keep_us = most, keep_us
        each = [next((seconds for below, seconds in delays if k < below), delays[-1][1]) for k in range(max(most.values()) + 1)]
        self.passed = 1_000_000 * np.cumsum([0, *each])  # from submission to the attempt of each number

    def init(self, handle) -> None:
        self.handle = handle
        self.tasks = handle.getValueState("tasks", "tasks binary")  # kind, attempt, due_us, done_us, error_us and until_us by task

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tasks = pickle.loads(self.tasks.get()[0]) if self.tasks.exists() else {}
        first = None
        for task, event, name, at in tuples(rows, ["task_id", "event", "kind", "at_us"]):
            kind, attempt, due, done, error, until = tasks.get(task, ("", 0, NEVER, NEVER, NEVER, NEVER))
            wake = None
            if event == "submitted" and due == NEVER:
                kind, due, wake = name, at, at
            elif event == "done":
                done = at if done == NEVER else min(done, at)
            elif event == "error":
                error = at if error == NEVER else min(error, at)
            if due == NEVER:
                until = wake = at + self.keep_us if until == NEVER else min(until, at + self.keep_us)
            tasks[task] = kind, attempt, due, done, error, until
            first = wake if first is None else first if wake is None else min(first, wake)
        if first is not None:
            self.handle.registerTimer(after(first))
        self.tasks.update((pickle.dumps(tasks),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.tasks.exists():
            return
        tasks = pickle.loads(self.tasks.get()[0])
        now = timerValues.getCurrentWatermarkInMs() * 1000
        gone = [task for task, (_, _, due, _, _, until) in tasks.items() if due == NEVER and after(until) * 1000 <= now]
        for task in gone:
            del tasks[task]
        asked = [(task, *state) for task, state in tasks.items() if NEVER != state[2] <= now]
        if asked:
            yield self.attempts(asked, tasks, now)
        if asked or gone:
            self.tasks.update((pickle.dumps(tasks),)) if tasks else self.tasks.clear()
        if tasks:
            self.handle.registerTimer(after(max(now, min(until if due == NEVER else due for _, _, due, _, _, until in tasks.values()))))

    def attempts(self, asked: list[tuple], tasks: dict, now: int) -> pd.DataFrame:
        """The attempts of the asked tasks until now; tasks gets what is left of them."""
        ids, kinds, *numbers = zip(*asked, strict=True)
        attempt, due, done, error, _ = (np.array(n, dtype=np.int64) for n in numbers)
        begun, never = due - self.passed[attempt], np.iinfo(np.int64).max
        done, error = (np.where(at == NEVER, never, at) for at in (done, error))
        told = np.minimum(done, error)
        fewest = min(self.most.values())
        dead = np.maximum(attempt, [self.most.get(kind, fewest) for kind in kinds])
        heard = np.where(told == never, len(self.passed), np.searchsorted(self.passed, np.where(told == never, 0, told - begun)))
        end = np.minimum(np.maximum(heard, attempt), dead)
        last = np.minimum(end, np.searchsorted(self.passed, now - begun, side="right") - 1)
        n = last - attempt + 1
        row = np.repeat(np.arange(len(n)), n)
        number = attempt[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = begun[row] + self.passed[number]
        outcome = np.full(len(row), "waiting", dtype=object)
        closing = number == end[row]
        outcome[closing] = np.select([done[row] <= at, error[row] <= at], ["done", "error"], "dead")[closing]
        for k, task in enumerate(ids):
            if last[k] == end[k]:
                del tasks[task]
            else:
                kind, _, _, *known = tasks[task]
                following = int(last[k]) + 1
                tasks[task] = (kind, following, int(begun[k] + self.passed[following]), *known)
        return pd.DataFrame({"task_id": np.array(ids)[row], "attempt": number.astype(np.int32), "at_us": at, "outcome": outcome})

    def close(self) -> None:
        pass


# Seconds to the next attempt by the number made so far, and the number of the last attempt of an exam and of a textbook.
POLL_DELAYS = ((10, 30), (20, 60), (120, 120))
MOST_POLLS = {"exam": 60, "textbook": 120}


def retried(events: DataFrame, delay: str = "1 minute", keep: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """task_id, attempt, at and outcome of every attempt at a task, from events (task_id, kind, event: submitted, done or error, at).

    done and error count from the moment they happen; an error is not tried again.
    """
    timed = events.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    processor = Retries(POLL_DELAYS, MOST_POLLS, micros(events.sparkSession, keep))
    out = in_buckets(timed, "task_id", buckets).groupBy("bucket").transformWithStateInPandas(processor, "task_id long, attempt int, at_us long, outcome string", "Append", "EventTime")
    return out.select("task_id", "attempt", F.timestamp_micros("at_us").alias("at"), "outcome")


class Barrier(StatefulProcessor):
    """Waits for all batches of a job and finishes the job once.

    A batch that comes again is passed over, also after the end, for keep_us.  A job whose batches are not
    all there patience_us after its first one is finished without them, once, and says how many are missing.
    """

    emits = ["job_id", "outcome", "arrived", "missing", "n", "total"]

    def __init__(self, patience_us: int, keep_us: int):
        self.patience_us, self.keep_us = patience_us, keep_us

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "batch long", "n long")
        self.job = handle.getValueState("job", "forgotten_us long, arrived int, expected int, n long, total long, first_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        forgotten, arrived, expected, n, total, first = tuple(self.job.get()) if self.job.exists() else (NEVER, 0, 0, 0, 0, NEVER)
        out = []
        for at, batch, of, size, value in sorted(tuples(rows, ["at_us", "batch", "expected", "n", "total"])):
            if forgotten != NEVER or self.seen.containsKey((batch,)) or first != NEVER and at > first + self.patience_us:
                continue
            if first == NEVER:
                first = at
                self.handle.registerTimer(after(at + self.patience_us))
            self.seen.updateValue((batch,), (size,))
            arrived, expected, n, total = arrived + 1, of, n + size, total + value
            if arrived == expected:
                forgotten = max(at, first) + self.keep_us
                self.handle.registerTimer(after(forgotten))
                out.append((key[0], "complete", arrived, 0, n, total))
        self.job.update((forgotten, arrived, expected, n, total, first))
        if out:
            yield pd.DataFrame(out, columns=self.emits)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        forgotten, arrived, expected, n, total, first = tuple(self.job.get())
        if forgotten == NEVER:
            forgotten = first + self.patience_us + self.keep_us
            self.job.update((forgotten, arrived, expected, n, total, first))
            self.handle.registerTimer(after(forgotten))
            yield pd.DataFrame([(key[0], "timed out", arrived, expected - arrived, n, total)], columns=self.emits)
        elif forgotten <= now and expiredTimerInfo.getExpiryTimeInMs() == after(forgotten):
            self.job.clear()
            self.seen.clear()

    def close(self) -> None:
        pass


def finished_jobs(results: DataFrame, patience: str = "1 hour", keep: str = "1 hour", delay: str = "1 minute") -> DataFrame:
    """One row for each job: job_id, outcome (complete, timed out), arrived, missing, n and total, from batch results (job_id, batch, expected, n, total, at)."""
    timed = results.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    spark = results.sparkSession
    processor = Barrier(micros(spark, patience), micros(spark, keep))
    return timed.groupBy("job_id").transformWithStateInPandas(processor, "job_id string, outcome string, arrived int, missing int, n long, total long", "Append", "EventTime")


#: Parts of a class's board, each an entry of the state that is read and written whole.
BOARD_PARTS = 64


class Board(StatefulProcessor):
    """The latest submission of each student of a class, sent whole whenever one of them changes."""

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "part long", "rows binary")  # (at_us, submission_id, submitted, score, state) by student
        self.pushes = handle.getValueState("pushes", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, changed = {}, False
        for student, *row in tuples(rows, ["student_id", "at_us", "submission_id", "submitted", "score", "state"]):
            row[3] = None if pd.isna(row[3]) else row[3]
            held = newest.setdefault(student % BOARD_PARTS, {})
            if student not in held or tuple(row[:2]) > held[student][:2]:
                held[student] = tuple(row)
        for part, arrived in newest.items():
            held = pickle.loads(self.latest.getValue((part,))[0]) if self.latest.containsKey((part,)) else {}
            later = {student: row for student, row in arrived.items() if student not in held or row[:2] > held[student][:2]}
            if later:
                self.latest.updateValue((part,), (pickle.dumps(held | later),))
                changed = True
        if changed:
            push = (self.pushes.get()[0] if self.pushes.exists() else 0) + 1
            self.pushes.update((push,))
            for _, held in self.latest.iterator():
                yield pd.DataFrame([(key[0], push, student, *row) for student, row in pickle.loads(held[0]).items()], columns=["class_id", "push", "student_id", "at_us", "submission_id", "submitted", "score", "state"])

    def close(self) -> None:
        pass


def live_boards(submissions: DataFrame, chosen: DataFrame, counts: DataFrame) -> DataFrame:
    """For each class touched by a batch its whole board: class_id, push (from 1), student_id, at, submission_id, submitted, score and state.

    submissions is the stream (submission_id, student_id, class_id, assignment_id, state, score, submitted_at);
    chosen the assignment that each class shows; counts the answers of a submission.  The state of a class is
    a row for each of its students, and only touched classes are computed.
    """
    shown = submissions.join(chosen, ["class_id", "assignment_id"]).join(counts, "submission_id", "left")
    rows = shown.select("class_id", "student_id", F.unix_micros("submitted_at").alias("at_us"), "submission_id", F.coalesce("submitted", F.lit(0)).cast("long").alias("submitted"), "score", "state")
    schema = "class_id long, push long, student_id long, at_us long, submission_id long, submitted long, score double, state string"
    out = rows.groupBy("class_id").transformWithStateInPandas(Board(), schema, "Update", "None")
    return out.select("class_id", "push", "student_id", F.timestamp_micros("at_us").alias("at"), "submission_id", "submitted", "score", "state")
