"""Requirements by division, topics with places, and batch requests, held against plain loops and failures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import requirements as R
from ledgerlens.sources import batches as B
from ledgerlens.streaming.topics import Topics

SECTIONS = "doc_id string, section_id string, section_type string, document_type string"
REGISTRY = [
    R.Requirement("usage", ("manufacturing operations",), ("material_dispensing",), "used"),
    R.Requirement("sample", ("manufacturing_operations", "sampling"), ("qc_report", "coa"), "present"),
    R.Requirement("self", ("coa",), ("COA",), "same"),
]


def fold(x):
    out = "".join(c if c.isascii() and c.isalnum() else "_" for c in (x or "").lower())
    return "_".join(p for p in out.split("_") if p)


def random_sections(rnd, docs=80):
    types = ["Manufacturing Operations", "material-dispensing", "sampling", "qc_report", "COA", "other", "", None]
    return [(f"d{d}", f"s{i}", rnd.choice(types), rnd.choice(["Batch Record", "coa", None, ""])) for d in range(docs) for i in range(rnd.randint(1, 6))]


def test_named(spark):
    rows = random_sections(random.Random(1))
    df = spark.createDataFrame(rows, SECTIONS)
    docs = sorted({r[0] for r in rows}) + ["empty"]
    asked = spark.createDataFrame([(d, q) for d in docs for q in ("usage", "sample", "self", "nope")], "doc_id string, requirement_id string")
    resolved = R.resolve_named(df, asked, REGISTRY)
    got = {(r["doc_id"], r["requirement_id"]): r for r in resolved.collect()}
    pairs = {}
    for r in R.matched_pairs(resolved).collect():
        pairs.setdefault((r["doc_id"], r["requirement_id"]), set()).add((r["source_id"], r["target_id"]))
    assert len(got) == 4 * len(docs)
    for d in docs:
        own = [r for r in rows if r[0] == d]
        for q in REGISTRY:
            ids = {s: sorted({r[1] for r in own if fold(r[2]) in map(fold, getattr(q, s))}) for s in R.SIDES}
            gone = sorted({f"{s}:{fold(t)}" for s in R.SIDES for t in getattr(q, s) if fold(t) not in {fold(r[2]) for r in own}})
            r = got[d, q.id]
            both = {(a, b) for a in ids["source"] for b in ids["target"] if a != b}
            assert (r["source_ids"], r["target_ids"], r["missing"]) == (ids["source"], ids["target"], gone)
            assert r["applicable"] == bool(ids["source"] and ids["target"]) and r["complete"] == (not gone) and r["pairs"] == len(both) and pairs.get((d, q.id), set()) == both
            if not r["applicable"]:
                assert r["reason"] == "missing " + ", ".join(gone)
        assert not got[d, "nope"]["applicable"] and got[d, "nope"]["comparator"] == "unknown" and "nope" in got[d, "nope"]["reason"]
    with pytest.raises(ValueError, match="one id"):
        R.resolve_named(df, asked, [*REGISTRY, REGISTRY[0]])


def test_inline(spark):
    rows = random_sections(random.Random(2))
    wants = [("COA", "coa"), ("coa", ""), (None, "batch record"), ("sampling", "Batch-Record"), ("", None), ("qc_report", "never"), ("", "never")]
    docs = sorted({r[0] for r in rows})
    asked = spark.createDataFrame([(d, *w) for d in docs for w in wants], "doc_id string, section_type string, in_document_type string")
    got = {(r["doc_id"], r["section_type"], r["in_document_type"]): r for r in R.resolve_inline(spark.createDataFrame(rows, SECTIONS), asked).collect()}
    for d in docs:
        own = [(r[1], fold(r[2]), fold(r[3])) for r in rows if r[0] == d]
        for w in wants:
            kind, doc = map(fold, w)
            if not kind and not doc:
                ids = []
            elif not doc:
                ids = [s for s, k, _ in own if k == kind]
            elif doc in {x for *_, x in own}:
                ids = [s for s, k, x in own if x == doc and (not kind or k == kind)]
            else:
                ids = [s for s, k, x in own if x == "" and k == kind]
            assert (got[d, *w]["section_ids"], got[d, *w]["applicable"]) == (sorted(ids), bool(ids))
    assert {r["name"] for r in got.values()} >= {"coa.coa", "*.coa", "batch_record.*", "*.*"}


# ---------------------------------------------------------------- topics
def test_a_slow_subscriber_loses_the_oldest(spark, tmp_path):
    rnd = random.Random(3)
    t, kept, seen, lost = Topics(spark, str(tmp_path)), {}, {"slow": {}, "fast": {}}, {}
    for batch in range(6):
        rows = [(rnd.choice(["a", "b", None]), i, f"{batch}-{i}") for i in range(rnd.choice([0, 5, 30]))]
        df = spark.createDataFrame(rows, "topic string, seq int, payload string")
        assert t.publish(df, batch) and not t.publish(df, batch)
        for topic, _, p in rows:
            if topic:
                kept.setdefault(topic, []).append(p)
        for who in ("slow", "fast"):
            if who == "fast" or batch in (2, 5):
                polled = t.poll(who, bound=12 if who == "slow" else 1000)
                again = Topics(spark, str(tmp_path)).poll(who, bound=12 if who == "slow" else 1000)  # a subscriber that died before it committed
                assert sorted(map(tuple, polled.collect())) == sorted(map(tuple, again.collect()))
                for r in sorted(polled.collect(), key=lambda r: r["offset"]):
                    seen[who].setdefault(r["topic"], []).append(r["payload"])
                    lost[who, r["topic"], batch] = r["lost"]
                t.commit(who, polled)
    assert seen["fast"] == kept and sum(v for (w, *_), v in lost.items() if w == "fast") == 0
    for topic, events in kept.items():
        assert len(seen["slow"][topic]) + sum(v for (w, x, _), v in lost.items() if (w, x) == ("slow", topic)) == len(events)
        assert seen["slow"][topic][-12:] == events[-12:] and [e for e in events if e in set(seen["slow"][topic])] == seen["slow"][topic]
    assert sum(v for (w, *_), v in lost.items() if w == "slow") > 0


def test_a_stream_publishes_each_batch_once(spark, tmp_path):
    t = Topics(spark, f"{tmp_path}/topics")
    for n in range(2):
        spark.createDataFrame([("a", i, f"{n}{i}") for i in range(3)], "topic string, seq int, payload string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("topic string, seq int, payload string").parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(t.writer()).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(60)
    assert [r["payload"] for r in t.log().orderBy("offset").collect()] == ["00", "01", "02", "10", "11", "12"]


# ---------------------------------------------------------------- batches
def lines_of(spark, n, first=0):
    rows = [(f"r{i}", [("system", 'say "x"'), ("user", f"é {i}\nline")]) for i in range(first, first + n)]
    return B.request_lines(spark.createDataFrame(rows, "custom_id string, messages array<struct<role:string,content:string>>").repartition(3), "m", schema={"type": "object", "title": "T", "properties": {"a": {"$ref": "#/$defs/A"}}, "$defs": {"A": {"type": "string", "default": "x"}}})


def test_lines(spark):
    rows = {r["custom_id"]: json.loads(r["line"]) for r in lines_of(spark, 3).collect()}
    assert rows["r1"] == {
        "custom_id": "r1", "method": "POST", "url": "/v1/chat/completions",
        "body": {
            "model": "m", "messages": [{"role": "system", "content": 'say "x"'}, {"role": "user", "content": "é 1\nline"}], "temperature": 0.1,
            "response_format": {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": {"additionalProperties": False, "type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}}},
        },
    }


def test_shards_and_failed_tasks(spark, tmp_path):
    path = str(tmp_path / "batch")
    B.write_requests(lines_of(spark, 25), path, 4)
    rows = B.read_requests(spark, path).collect()
    assert sorted(r["custom_id"] for r in rows) == sorted(f"r{i}" for i in range(25)) and len({r["shard"] for r in rows}) >= 7
    before = B.shards(path)

    broken = lines_of(spark, 10, 100).withColumn("line", F.when(F.col("custom_id") == "r105", F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        B.write_requests(broken, path, 2)
    assert B.shards(path) == before and len(B.read_requests(spark, path).collect()) == 25

    # An attempt whose task is run again has written shards that nobody lists.
    writer = B._Writer(path, 2, False)
    once = [{"line": r["line"]} for r in lines_of(spark, 5, 200).collect()]
    writer.write(iter(once))
    writer.commit([writer.write(iter(once)), None])
    got = [r["custom_id"] for r in B.read_requests(spark, path).collect()]
    assert len(got) == len(set(got)) == 30
    B.write_requests(lines_of(spark, 2), path, mode="overwrite")
    assert sorted(r["custom_id"] for r in B.read_requests(spark, path).collect()) == ["r0", "r1"]
    assert B.read_requests(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on_from_the_last_shard(spark, tmp_path):
    path = str(tmp_path / "batch")
    for n in range(2):
        B.write_requests(lines_of(spark, 6, 10 * n), path, 2)
        q = B.stream_requests(spark, path).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="100 milliseconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = [r["custom_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert len(got) == len(set(got)) == 6 * (n + 1)


def test_results(spark):
    good = json.dumps({"custom_id": "a", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "yes"}}]}}, "error": None})
    lines = [good, good, "", "{", '{"response": {}}', json.dumps({"custom_id": "b", "error": {"code": "x"}}), json.dumps({"custom_id": "c", "response": {"status_code": 429}})]
    got = sorted((tuple(r) for r in B.results(spark.createDataFrame([(x,) for x in lines], "value string")).collect()), key=str)
    assert got == sorted([("a", 200, "yes", None, False)] * 2 + [("b", 500, None, '{"code":"x"}', False), ("c", 429, None, None, False)] + [(None, None, None, None, True)] * 2, key=str)
    asked = spark.createDataFrame([(x,) for x in "abcd"], "custom_id string")
    rows = {r["custom_id"]: (r["status_code"], r["error"]) for r in B.answered(asked, B.results(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    assert rows == {"a": (200, None), "b": (500, '{"code":"x"}'), "c": (429, None), "d": (None, "no result")}
