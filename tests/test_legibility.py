"""STR-6: a stream that pauses, restarts from its checkpoint, resumes, and refuses changed packages; tables by the same rule."""

import random
import time

from ledgerlens.streaming import legibility as L

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event(run, seq, kind, **more):
    return (run, seq, kind, *(more.get(k) for k in ("snapshot", "needs_review", "reasons", "action", "actor", "note")))


def random_events(rnd, runs=150):
    out = []
    for i in range(runs):
        for seq in range(rnd.randint(1, 9)):
            kind = rnd.choice(["start", "package", "decision", "decision"]) if seq else rnd.choice(["start", "start", "start", "decision", "package"])
            if kind == "decision":
                out.append(event(f"r{i}", seq, kind, action=rnd.choice(["proceed", "proceed", "reupload", "bogus", None]), actor=rnd.choice("ab"), note=rnd.choice([None, "note"])))
            elif kind == "package":
                out.append(event(f"r{i}", seq, kind, snapshot=rnd.choice(["h1", "h2", "h2", None])))
            else:
                out.append(event(f"r{i}", seq, kind, snapshot=rnd.choice(["h1", "h1", None]), needs_review=rnd.choice([True, True, True, False, None]), reasons=rnd.choice([["a: b", "c"], [], None])))
    return out


class Stream:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, events):
        self.spark.createDataFrame(events, L.EVENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        """A new query each time: all it knows of the past is in the checkpoint."""
        out = L.gated(self.spark.readStream.schema(L.EVENTS).parquet(f"{self.folder}/in"))
        out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(map(tuple, self.spark.read.schema(L.OUTCOMES).parquet(f"{self.folder}/out").collect()), key=str)


def test_pause_restart_resume_and_changed_package(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    s = Stream(spark, tmp_path)
    s.add([event(r, 0, "start", snapshot="h1", needs_review=r != "clean", reasons=["unclassified_file: mystery.pdf"]) for r in ("keep", "edited", "again", "clean")])
    first = s.run()
    assert [(r[0], r[2]) for r in first] == [("again", L.AWAITING), ("clean", L.RUNNING), ("edited", L.AWAITING), ("keep", L.AWAITING)] and first[0][4] == "unclassified_file: mystery.pdf"
    s.add([event("edited", 1, "package", snapshot="h2"), event("keep", 1, "decision", action="proceed", actor="qa"), event("clean", 1, "decision", action="proceed"), event("nope", 0, "decision", action="proceed"), event("again", 1, "decision", action="bogus")])
    s.add([event("edited", 2, "decision", action="proceed", actor="qa"), event("keep", 2, "decision", action="reupload"), event("again", 2, "decision", action="reupload", actor="qa", note="unreadable")])
    got = {(r[0], r[1]): r[2:] for r in s.run()}
    assert got["keep", 1] == (L.RUNNING, "qa", None) and got["keep", 2] == (L.REJECTED, None, L.CLOSED)
    assert got["edited", 2] == (L.REJECTED, "qa", L.CHANGED) and got["again", 2] == (L.FAILED, "qa", "unreadable")
    assert got["clean", 1][2] == L.CLOSED and got["nope", 0][2] == L.ABSENT and got["again", 1][2] == L.UNKNOWN
    # The package is as it was again: the run still waits, and now goes on.
    s.add([event("edited", 3, "package", snapshot="h1"), event("edited", 4, "decision", action="proceed")])
    assert ("edited", 4, L.RUNNING, None, None) in s.run()


def test_streams_agree_with_tables(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    events = random_events(random.Random(2))
    s = Stream(spark, tmp_path)
    for half in ([e for e in events if e[1] < 4], [e for e in events if e[1] >= 4]):
        s.add(half)
        rows = s.run()
    want = sorted(map(tuple, L.replayed(spark.createDataFrame(events, L.EVENTS)).collect()), key=str)
    assert rows == want and {r[2] for r in want} == {L.AWAITING, L.RUNNING, L.FAILED, L.REJECTED} and {L.UNKNOWN, L.ABSENT, L.CLOSED, L.CHANGED, L.TWICE} <= {r[4] for r in want}


def test_overdue(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    s = Stream(spark, tmp_path)
    s.add([event("a", 0, "start", needs_review=True), event("b", 0, "start", needs_review=True), event("b", 1, "decision", action="proceed")])
    out = L.gated(spark.readStream.schema(L.EVENTS).parquet(f"{tmp_path}/in"), patience_ms=0)
    q = out.writeStream.format("memory").queryName("overdue").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            rows = spark.table("overdue").where(f"status = '{L.OVERDUE}'").collect()
            if rows:
                break
            time.sleep(0.5)
        time.sleep(1)
    finally:
        q.stop()
    assert [r["run_id"] for r in spark.table("overdue").where(f"status = '{L.OVERDUE}'").collect()] == ["a"]


def test_snapshots(spark):
    rows = [("p", "a", 1), ("p", "b", None), ("q", "b", None), ("q", "a", 1), ("r", "a", 1), ("s", "a", 1), ("s", "a", 1)]
    got = {r["k"]: r["snapshot"] for r in L.snapshot_hash(spark.createDataFrame(rows, "k string, d string, n int"), ["k"], ["d", "n"]).collect()}
    assert got["p"] == got["q"] and len(set(got.values())) == 3
    issues = spark.createDataFrame([([("unclassified_file", "x.pdf")],), ([],)], "i array<struct<kind:string,message:string>>")
    assert [r[0] for r in issues.select(L.reasons(L.F.col("i"))).collect()] == [["unclassified_file: x.pdf"], ["package is marked as needing review"]]
