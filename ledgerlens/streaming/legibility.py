"""Runs that pause for a reviewer and go on by their decision (STR-6).

A run whose package needs review waits; it goes on only if the package is still the one that the reviewer saw, which
a hash of its contents tells. Events of a run come in order of `seq`; the same rule is applied to a stream, with the
waiting runs as keyed state, and to a table of events, with windows.

events: run_id, seq, kind ("start", "package" or "decision"), snapshot (of a start or package event), needs_review and
reasons (of a start), action, actor and note (of a decision). A package event says that the package is now another one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

AWAITING, RUNNING, FAILED, REJECTED, OVERDUE = "awaiting_legibility_review", "running", "failed", "rejected", "overdue"
ACTIONS = ("proceed", "reupload")
UNKNOWN, ABSENT, CLOSED, CHANGED, TWICE = "unknown action", "run not found", "not awaiting review", "package changed since the pause", "already started"

EVENTS = "run_id string, seq long, kind string, snapshot string, needs_review boolean, reasons array<string>, action string, actor string, note string"
#: What a run says of itself: seq is the event's (null of an overdue run), detail the reasons, the note or the error.
OUTCOMES = "run_id string, seq long, status string, actor string, detail string"


def snapshot_hash(documents: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """FN-47: keys and snapshot, a SHA-256 of the package's documents whatever their order: of their rows' hashes, sorted."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return documents.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ","), 256).alias("snapshot"))


def reasons(issues: Column) -> Column:
    """Why a package needs review: "kind: message" of its issues (array of kind, message), or that it says so itself."""
    each = F.transform(issues, lambda i: F.concat_ws(": ", i["kind"], i["message"]))
    return F.when(F.size(issues) > 0, each).otherwise(F.array(F.lit("package is marked as needing review")))


# ---------------------------------------------------------------- tables
def replayed(events: DataFrame) -> DataFrame:
    """OUTCOMES of a table of events: what became of each start and decision. A run is one window, as long as its events are many."""
    w = Window.partitionBy("run_id").orderBy("seq")
    so_far, first = w.rowsBetween(Window.unboundedPreceding, 0), F.col("kind") == "start"
    nth = F.count_if(first).over(so_far)
    opened = first & (nth == 1)
    one = lambda c: F.first(F.when(opened, F.col(c)), ignorenulls=True).over(so_far)
    e = events.withColumn("nth", nth).withColumn("opened", opened)
    e = e.withColumns({"wants": one("needs_review"), "seen": one("snapshot"), "now": F.last(F.when((F.col("kind") == "package") | F.col("opened"), F.col("snapshot")), ignorenulls=True).over(so_far)})
    decision = F.col("kind") == "decision"
    own = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), UNKNOWN)
        .when(F.col("nth") == 0, ABSENT)
        .when(~F.coalesce("wants", F.lit(False)), CLOSED)
        .when((F.col("action") == "proceed") & F.col("seen").isNotNull() & ~F.col("seen").eqNullSafe(F.col("now")), CHANGED)
    )
    e = e.withColumn("wrong", F.when(decision, own)).withColumn("good", decision & F.col("wrong").isNull())
    before = F.count_if("good").over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    wrong = F.when(known & (F.coalesce(before, F.lit(0)) > 0) & (F.col("nth") > 0), CLOSED).otherwise(F.col("wrong"))
    e = e.withColumn("wrong", F.when(decision, wrong)).where("kind <> 'package'")
    status = (
        F.when(first & (F.col("nth") > 1), REJECTED)
        .when(first, F.when(F.coalesce("needs_review", F.lit(False)), AWAITING).otherwise(RUNNING))
        .when(F.col("wrong").isNotNull(), REJECTED)
        .otherwise(F.when(F.col("action") == "proceed", RUNNING).otherwise(FAILED))
    )
    detail = F.when(first, F.when(F.col("nth") > 1, TWICE).otherwise(F.array_join(F.when(F.coalesce("needs_review", F.lit(False)), F.col("reasons")), "; "))).otherwise(F.coalesce("wrong", "note"))
    return e.select("run_id", "seq", status.alias("status"), F.when(decision, F.col("actor")).alias("actor"), detail.alias("detail"))


# ---------------------------------------------------------------- streams
class Gate(StatefulProcessor):
    """A run's state: whether it waits, the snapshot that it paused with, and the package's now; a timer while it waits."""

    def __init__(self, patience_ms: int | None) -> None:
        self.patience = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "waits boolean, seen string, now string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: r["seq"]):
            state = self.run.get() if self.run.exists() else None
            if r["kind"] == "package":
                if state:
                    self.run.update((state[0], state[1], r["snapshot"] or state[2]))
                continue
            status, detail = self._start(r, state) if r["kind"] == "start" else self._decision(r, state)
            if status == AWAITING and self.patience is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
            yield Row(run_id=key[0], seq=r["seq"], status=status, actor=r["actor"] if r["kind"] == "decision" else None, detail=detail)

    def _start(self, r: Row, state) -> tuple[str, str | None]:
        if state:
            return REJECTED, TWICE
        self.run.update((bool(r["needs_review"]), r["snapshot"], r["snapshot"]))
        return (AWAITING, "; ".join(r["reasons"]) if r["reasons"] is not None else None) if r["needs_review"] else (RUNNING, None)

    def _decision(self, r: Row, state) -> tuple[str, str | None]:
        changed = state and r["action"] == "proceed" and state[1] is not None and state[1] != state[2]
        wrong = UNKNOWN if r["action"] not in ACTIONS else ABSENT if not state else CLOSED if not state[0] else CHANGED if changed else None
        if wrong:
            return REJECTED, wrong
        self.run.update((False, state[1], state[2]))
        if self.patience is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        return (RUNNING if r["action"] == "proceed" else FAILED), r["note"]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.run.exists() and self.run.get()[0]:
            yield Row(run_id=key[0], seq=None, status=OVERDUE, actor=None, detail=None)

    def close(self) -> None:
        pass


def gated(events: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """STR-6: OUTCOMES of a stream of events. Runs stay in state, so a restart from the checkpoint goes on where it stood.

    A run that has waited patience_ms is said to be overdue once, and goes on waiting; timers want a query with a
    processing-time trigger, as one that stops once all is read never does with them. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). A run's events of one micro-batch are put in order by seq.
    """
    mode = "processingTime" if patience_ms is not None else "none"
    return events.groupBy("run_id").transformWithState(statefulProcessor=Gate(patience_ms), outputStructType=OUTCOMES, outputMode="append", timeMode=mode)
