"""Runs over a set of items in committed waves: each wave is answered by the executors, written, and then committed with the run's state, so a run can stop at a limit and go on later.

A folder holds ``rows/`` (a folder per wave, JSON) and ``state/`` (`Versions`: a document per wave, and one per start and end of a run). A wave counts once its document is there; rows without one are never
read. A wave that was committed is not done again when it comes again, whoever asks. Every document has the next number, so of two writers at most one goes on: the other's commit finds the number taken, and is
refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators.ranks import with_rank
from veritally.operators.runlog import pending, stale
from veritally.storage import written
from veritally.versions import Versions

# What ends a run, and the kinds of errors that do.
RUNNING, COMPLETE, QUOTA, AUTH, ERRORS, BUDGET = "running", "complete", "quota_exhausted", "auth_error", "too_many_errors", "budget"
DENIED = (401, 403)


class Refused(RuntimeError):
    """The run may not start, or not go on."""


@dataclass(frozen=True)
class Limits:
    """``wave`` items are answered between two looks at the limits; the spend is looked at after ``warmup`` answers."""

    wave: int = 256
    max_usd: float | None = None
    warmup: int = 5
    fail_streak: int = 8


@dataclass(frozen=True)
class State:
    """After a wave: totals of the run (not of the runs before it), the failures in a row at its end, and what has ended it."""

    writer: str
    wave: int = 0
    status: str = RUNNING
    message: str = ""
    attempted: int = 0
    completed: int = 0
    errors: int = 0
    streak: int = 0
    calls: int = 0
    spent_usd: float = 0.0
    projected_usd: float | None = None
    remaining: int = 0
    reset_at: float | None = None
    rows: str | None = None


class Waves:
    """The run log in a folder. ``schema`` is that of answers: at least ``id_``, error, error_kind strings, retriable boolean, status_code int, config_hash string, reset_at double."""

    def __init__(self, spark: SparkSession, path: str, schema: str, id_: str = "id"):
        self.spark, self.path, self.schema, self.id = spark, path.rstrip("/"), schema, id_
        self.versions = Versions(spark, f"{self.path}/state")

    def state(self) -> State | None:
        """The latest; None before the first run."""
        last = self.versions.latest()
        return State(**json.loads(self.versions.read(last))) if last else None

    def rows(self) -> DataFrame:
        """The committed answers with ``wave`` and ``pos``, the order of writing. Calls that a quota refused were never sent and aren't in it."""
        numbers = self.versions.numbers()
        folders = []
        if numbers:
            states = self.spark.read.schema("rows string").json([f"{self.path}/state/{n:010d}.json" for n in numbers])
            folders = [r["rows"] for r in states.where("rows IS NOT NULL").collect()]  # as many as waves
        whole = f"wave long, pos long, {self.schema}"
        log = self.spark.read.schema(whole).json([f"{self.path}/rows/{f}" for f in folders]) if folders else self.spark.createDataFrame([], whole)
        return log.where(~F.col("error_kind").eqNullSafe(QUOTA))

    def _put(self, state: State, after: int) -> State:
        if not self.versions.put(after + 1, json.dumps(asdict(state))):
            raise Refused(f"{self.path}: another writer has gone on from here")
        return state

    def start(self, remaining: int, resume: bool, last: int | None = None) -> State:
        """The first document of a run, after document ``last``. Without ``resume`` the folder must not hold a run; with it, a run that still goes on is refused from here on."""
        last = self.versions.latest() if last is None else last
        if last and not resume:
            raise Refused(f"{self.path} holds a run; resume it or take another folder")
        wave = json.loads(self.versions.read(last))["wave"] if last else 0
        return self._put(State(uuid.uuid4().hex[:12], wave, remaining=remaining), last)

    def commit(self, items: DataFrame, answer: Callable, wave: int, mine: State, limits: Limits, cost: Column | None = None) -> State:
        """Answers ``items`` (with ``pos``, at most ``limits.wave``) as this wave and commits it; the state after it. A wave that is committed already is left as it is."""
        last, now = self.versions.latest(), self.state()
        if now.writer != mine.writer:
            raise Refused(f"{self.path}: another writer has gone on from here")
        if now.wave >= wave or now.status != RUNNING:
            return now
        folder = f"{wave:08d}-{uuid.uuid4().hex[:12]}"
        place = self.spark.range(1).select(F.lit(wave).cast("long").alias("wave"))
        answers = items.mapInArrow(answer, f"pos long, {self.schema}").crossJoin(F.broadcast(place))
        answers.write.json(f"{self.path}/rows/{folder}")
        got = self.spark.read.schema(f"wave long, pos long, {self.schema}").json(f"{self.path}/rows/{folder}")
        return self._put(self._after(now, got, limits, cost, wave, folder), last)

    def _after(self, now: State, got: DataFrame, limits: Limits, cost: Column | None, wave: int, folder: str) -> State:
        quota = F.col("error_kind").eqNullSafe(QUOTA)
        failed = F.col("error").isNotNull()
        step = F.struct("pos", failed.alias("failed"))
        # failures in a row, over a wave's rows in order: at the end, and at most
        run = F.struct(F.lit(now.streak).alias("now"), F.lit(now.streak).alias("most"))
        grown = lambda a, x: F.struct(F.when(x["failed"], a["now"] + 1).otherwise(F.lit(0)).alias("now"), F.greatest(a["most"], F.when(x["failed"], a["now"] + 1).otherwise(F.lit(0))).alias("most"))
        streak = F.aggregate(F.array_sort(F.collect_list(F.when(~quota, step))), run, grown)
        spent = F.coalesce(F.sum(F.when(~quota & ~failed, cost)), F.lit(0.0)) if cost is not None else F.lit(0.0)
        r = got.agg(
            F.count_if(~quota).alias("n"), F.count_if(~quota & ~failed).alias("ok"), F.count_if(quota).alias("refused"), F.max(F.when(quota, F.col("reset_at"))).alias("reset_at"), F.count_if(F.col("status_code").isin(*DENIED)).alias("denied"),
            streak.alias("streak"), F.max_by(F.when(failed, F.substring("error", 1, 120)), F.when(failed & ~quota, F.col("pos"))).alias("last"), spent.alias("spent"),
        ).first()
        calls, total = now.calls + (r["ok"] if cost is not None else 0), now.spent_usd + r["spent"]
        remaining = max(0, now.remaining - r["n"])
        projected = total + total / calls * remaining if calls else None
        status, message = RUNNING, ""
        if r["refused"]:
            status, message = QUOTA, f"{r['refused']} calls were refused by a quota"
        elif r["denied"]:
            status, message = AUTH, r["last"]
        elif r["streak"]["most"] >= limits.fail_streak:
            status, message = ERRORS, f"{limits.fail_streak} failures in a row; last: {r['last']}"
        elif limits.max_usd is not None and calls and (total >= limits.max_usd or calls >= limits.warmup and projected > limits.max_usd):
            status, message = BUDGET, f"projected ${projected:.4f} of ${limits.max_usd:.4f}"
        return replace(now, wave=wave, status=status, message=message, attempted=now.attempted + r["n"], completed=now.completed + r["ok"], errors=now.errors + r["n"] - r["ok"], streak=r["streak"]["now"], calls=calls, spent_usd=total, projected_usd=projected, remaining=remaining, reset_at=r["reset_at"], rows=folder)

    def run(self, items: DataFrame, answer: Callable, order: list[Column], limits: Limits = Limits(), cost: Column | None = None, estimate: Column | None = None, config_hash: str | None = None, resume: bool = False) -> State:
        """Answers the items without a final row, wave by wave in ``order``, until all are answered or a limit is met; the last state.

        ``answer`` maps Arrow batches of items with ``pos`` to batches of pos and `schema`. ``cost`` is a column of answers in USD; ``estimate`` one of items, whose sum must not pass ``limits.max_usd``. Rows of
        another configuration are refused.
        """
        if limits.max_usd is not None and cost is None:
            raise Refused("a limit in USD needs a cost")
        last = self.versions.latest()
        log = self.rows()
        if config_hash is not None and (other := stale(log, config_hash).select("config_hash").first()):
            raise Refused(f"{self.path} holds rows of configuration {other[0][:12]}")
        final = log.withColumn("failed", F.col("error").isNotNull()).withColumn("retriable", F.coalesce("retriable", F.lit(True)))
        todo = written(with_rank(pending(items, final, self.id), order, name="_turn"), "waves-todo")
        n = todo.count()
        if limits.max_usd is not None and estimate is not None:
            likely = todo.agg(F.coalesce(F.sum(estimate), F.lit(0.0))).first()[0]
            if likely > limits.max_usd:
                raise Refused(f"projected ${likely:.4f} for {n} calls exceeds ${limits.max_usd:.4f}")
        state = self.start(n, resume, last)
        first = state.wave
        for k in range(-(-n // limits.wave)):
            part = todo.where(F.col("_turn").between(k * limits.wave + 1, (k + 1) * limits.wave))
            state = self.commit(self._placed(part, first + k + 1, F.col("_turn")), answer, first + k + 1, state, limits, cost)
            if state.status != RUNNING:
                return state
        return self._put(replace(state, status=COMPLETE, rows=None), self.versions.latest())

    @staticmethod
    def _placed(part: DataFrame, wave: int, turn: Column) -> DataFrame:
        return part.withColumn("pos", F.lit(wave << 32) + turn).drop("_turn")

    def follow(self, items: DataFrame, answer: Callable, order: list[Column], checkpoint: str, limits: Limits = Limits(), cost: Column | None = None) -> State:
        """The same for a stream of items, in a folder of its own: each micro-batch is a wave, whose number is the batch's, so a batch that Spark gives out again after a failure is not answered again. Ends when the
        stream's input is worked off or a limit is met; the caller bounds micro-batches (``maxFilesPerTrigger``). What remains isn't known, so the projection is the spend."""
        state = self.start(0, resume=self.versions.latest() > 0)

        def wave(batch: DataFrame, number: int) -> None:
            nonlocal state
            turned = with_rank(batch, order, name="_turn")
            state = self.commit(self._placed(turned, number + 1, F.col("_turn")), answer, number + 1, state, limits, cost)
            if state.status != RUNNING:
                raise Refused(state.message)

        query = items.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if state.status == RUNNING:
                raise
            return state
        return self._put(replace(state, status=COMPLETE, rows=None), self.versions.latest())
