import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (
    cuts, decontaminate, graph, html_extract, jaccard_join, language_id, license_scan, line_dedup, mixing, sharding, substring_dedup, topk,
)

from . import brute


@pytest.fixture(scope="module")
def rows():
    return brute.awkward()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, brute.SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- 1
def test_language_id(spark, docs, none, rows):
    rng = random.Random(3)
    en, de = ["the", "and", "with", "this", "that", "which"], ["und", "nicht", "schön", "über", "eine", "wäre"]
    made = [(i, " ".join(rng.choices(en if i % 2 else de, k=30)), "en" if i % 2 else "de", f"h{i % 4}.de") for i in range(200)]
    made += [(900, " ".join(rng.choices(de, k=30)), "en", "h0.de"), (901, "ъъъщщщ ыыы жжж ъыъ " * 40, None, "h1.de"), (902, None, "en", None), (903, " 12 34 ", None, None)]
    out = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()}
    right = sum(out[i]["lang"] == ("en" if i % 2 else "de") for i in range(200))
    assert right >= 198 and out[900]["lang"] == "de" and out[900]["accepted"]
    assert not any(out[i]["accepted"] for i in (901, 902, 903)) and out[902]["posterior"] == 1.0
    assert language_id.identify(docs).count() == len(rows) and language_id.identify(none).count() == 0


def test_language_id_held_out(spark):
    """Texts whose declaration is hidden get their language from the others."""
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    hidden = data.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang"))).select("doc_id", "text", "lang", "source")
    j = language_id.identify(hidden).where("doc_id % 5 = 0").join(data.select("doc_id", F.col("lang").alias("true")), "doc_id")
    n, right = j.agg(F.count("*"), F.count_if(F.col("lang") == F.col("true"))).first()
    assert n > 100 and right >= 0.97 * n


def test_language_id_of_other_columns(spark):
    made = [(i, f"the and with {i}", "en", "a.com") for i in range(5)]
    out = language_id.identify(spark.createDataFrame(made, "doc_id long, text string, tag string, address string"), declared="tag", host="address")
    assert {r["lang"] for r in out.collect()} == {"en"}


def test_language_stage_keeps_columns(spark, docs):
    kept = language_id.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0


# ---------------------------------------------------------------- 2
def test_substring_dedup_finds_passages_and_paragraphs(docs, none, rows):
    out = substring_dedup.repeats(docs.select("doc_id", "text", "key")).collect()
    found = {r["doc_id"] for r in out}
    windows = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            w = brute.words(line)
            for i in range(len(w) - 49):
                windows[tuple(w[i : i + 50])].add(r[0])
    shared = {d for s in windows.values() if len(s) > 1 for d in s}
    assert shared and shared <= found
    clean = [r[0] for r in rows[10:60]]
    assert not found & (set(clean) - shared)
    stays = Counter(r["class_id"] for r in out if r["kind"] == "paragraph" and not r["removed"])
    assert stays and all(n == 1 for n in stays.values())
    assert substring_dedup.repeats(none).count() == 0


def test_paragraphs_of_similarity(spark):
    rng = random.Random(5)
    base = brute.text(rng, 80).split()
    made = [(0, "\n".join([brute.text(rng, 40), " ".join(base)]))]
    for i in range(1, 30):
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"z{i}"
        made.append((i, "\n".join([brute.text(rng, 40), " ".join(w)])))
    out = substring_dedup.repeats(spark.createDataFrame(made, "doc_id long, text string")).where("kind = 'paragraph'").collect()
    sets = {i: brute.shingles(t.split("\n")[1]) for i, t in made}
    linked = {i for i in sets if any(i != j and brute.jaccard(sets[i], sets[j]) for j in sets)}
    assert {r["doc_id"] for r in out} == linked and all(r["line"] == 1 for r in out)


def test_passages_over_line_breaks(spark):
    """A passage of 60 words, wrapped otherwise in each text, or broken once; spans hold words of the passage only."""
    rng = random.Random(9)
    passage = brute.text(rng, 60).split()

    def wrapped(words, n):
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    made = [(i, wrapped(brute.text(rng, 37 + i).split() + passage + brute.text(rng, 30).split(), n)) for i, n in enumerate((7, 11, 24, 45))]
    made += [(4, "\n\n ..\n" + brute.text(rng, 30) + " " + " ".join(passage[:30]) + "\n\n" + " ".join(passage[30:]) + " " + brute.text(rng, 30)), (5, wrapped(brute.text(rng, 200).split(), 8))]
    out = substring_dedup.repeats(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {0, 1, 2, 3, 4} and {r["class_id"] for r in out} == {0}
    texts, covered = dict(made), Counter()
    for r in out:
        line = brute.words(texts[r["doc_id"]].split("\n")[r["line"]])
        span = line[r["first_word"] : r["first_word"] + r["n_words"]]
        assert len(span) == r["n_words"] > 0 and " ".join(span) in " ".join(passage) and r["removed"] == (r["doc_id"] > 0)
        covered[r["doc_id"]] += len(span)
    assert all(covered[i] >= substring_dedup.PASSAGE for i in range(5))


# ---------------------------------------------------------------- 3
def test_license_scan(spark, docs, none, rows):
    made = [
        (0, "Licensed under CC BY-NC 4.0."), (1, "x General  Public\nLicense, all rights reserved; ALL RIGHTS RESERVED cc-by"), (2, None), (3, ""),
        (4, "permission is hereby granted free of very charge to any person obtaining a copy of this software"), (5, "cc xx by general public"), (6, "cc by " * 3000),
        (1, "x General  Public\nLicense, all rights reserved; ALL RIGHTS RESERVED cc-by"), (None, "cc by"),
    ]
    out = license_scan.digest(license_scan.scan(spark.createDataFrame(made, "doc_id long, text string")))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}

    def plain(d, t):
        w, starts, labels = brute.words(t), [], set()
        for label, p in phrases.items():
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        return d, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))

    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got(out, *names) == sorted((plain(*r) for r in made), key=repr)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in out.collect()}
    assert "mit" in labels[4][0] and 0.75 <= labels[4][1] < 1 and labels[5] == ("", 0.0)
    assert "cc-by-nc" in labels[0][0]
    full = license_scan.digest(license_scan.scan(docs))
    assert got(full, *names) == sorted((plain(r[0], r[1]) for r in rows), key=repr)
    assert license_scan.scan(none).count() == 0


def test_license_scan_clashing_columns(spark):
    df = spark.createDataFrame([(1, "cc by", "x", "y", "z", "q")], ["doc_id", "text", "scan_words", "spans", "a.b", "own"])
    found = license_scan.scan(df)
    assert sorted(found.columns) == ["__rid", "a.b", "doc_id", "own", "scan_words", "spans"] and license_scan.digest(found).first()["n_words"] == 2


# ---------------------------------------------------------------- 4
@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination(spark, docs, rows, none, block):
    bench = [(1, " ".join(rows[7][1].split()[3:30])), (2, " ".join(rows[8][1].split()[:8])), (2, rows[9][1]), (None, rows[11][1]), (3, None), (4, ""), (5, "tok tok")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    n_hit, contaminated = decontaminate.verdict()
    out = decontaminate.scan(docs, table, block_bytes=block).select(
        "doc_id", F.col("decontam.n_words").alias("n"), n_hit.alias("hit"), F.size("decontam.items").alias("i"),
        F.sha2(F.array_join("decontam.items", ","), 256).alias("sha"), contaminated.alias("c"), "text", F.col("decontam.chars").alias("chars"), F.col("decontam.runs").alias("runs"),
    )
    want = sorted(brute.decontaminated([(r[0], r[1]) for r in rows], bench), key=repr)
    assert got(out, "doc_id", "n", "hit", "i", "sha", "c") == want and any(w[2] for w in want)
    for r in out.collect():
        for c, run in zip(r["chars"], r["runs"], strict=True):
            assert brute.words(r["text"][c["start"] : c["end"]]) == brute.words(r["text"])[run["first"] : run["past"]]
    assert decontaminate.scan(none, table, block_bytes=block).count() == 0
    assert decontaminate.scan(docs, table.where("false")).where(F.size("decontam.items") > 0).count() == 0


# ---------------------------------------------------------------- 5
def test_sharding(spark, docs, none, rows):
    with_id = docs.withColumn("__rid", F.monotonically_increasing_id())
    out = sharding.assign(with_id, 7).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == sorted(brute.sizes(rows), key=repr)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(7))
    assert sharding.assign(none.withColumn("__rid", F.lit(0).cast("long"))).count() == 0


def test_sharding_is_even_with_a_hot_group(spark):
    made = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * (i % 40), "en", "hot" if i % 3 else "s") for i in range(6000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").withColumn("__rid", F.monotonically_increasing_id())
    by = [r["s"] for r in sharding.assign(docs, 40).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(by) == 40 and max(by) - min(by) < 0.05 * sum(by) / 40


def test_sharding_keeps_copies_together(spark):
    """A text's copies from all sources stand in one shard, but for those that a cut runs through; shards are off by less than a document."""
    made = [(i, f"text {i % 300} " * (5 + i % 7), ["en", "de"][i % 2], f"s{i % 11}") for i in range(3000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").withColumn("__rid", F.monotonically_increasing_id())
    out, by, shards = sharding.assign(docs, 40).collect(), Counter(), defaultdict(set)
    for r in out:
        by[r["shard"]] += r["size"]
        shards[r["text_crc32"], r["size"]].add(r["shard"])
    mean = sum(by.values()) / 40
    assert sum(len(x) - 1 for x in shards.values()) <= 39 and all(abs(x - mean) <= max(r["size"] for r in out) for x in by.values())


def test_cuts_by_brute_force(spark):
    rng = random.Random(2)
    made = [(rng.randrange(3), rng.randrange(1, 50), float(rng.choice([1, 1, 1, 2, 5, rng.random()])), float(rng.randrange(4)), float(i)) for i in range(3000)]
    df = spark.createDataFrame(made, "node int, w long, a double, b double, c double")
    want = {0: 5000.0, 1: 1.0, 2: 10**9}
    for few in (3, 400):
        for n, cut in cuts.find(df, ["a", "b", "c"], want, bins=8, few=few).items():
            own, below, best = sorted((r[2:], r[1]) for r in made if r[0] == n), 0, 0
            sums = [0]
            for _, w in own:
                below += w
                sums.append(below)
            assert abs(cut.weight - want[n]) == min(abs(s - want[n]) for s in sums)
            left = sum(w for k, w in own if cut.key is None or k < cut.key or cut.inclusive and k == cut.key)
            assert left == cut.weight


# ---------------------------------------------------------------- 6
def test_jaccard_join(docs, none, rows):
    out = jaccard_join.join(docs).collect()
    component, links = brute.classes(rows)
    lowest = defaultdict(list)
    for i, c in enumerate(component):
        lowest[c].append(rows[i][0])
    want = []
    for i, r in enumerate(rows):
        ids = [d for d in lowest[component[i]] if d is not None]
        want.append((r[0], min(ids) if ids else None, links[i]))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out), key=repr) == sorted(want, key=repr)
    assert jaccard_join.join(none).count() == 0


def test_jaccard_join_large_group_and_recall(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    rng = random.Random(4)
    base, made = brute.text(rng, 150).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    for i in range(150, 300):
        made.append((i, brute.text(rng, 60) + " " + " ".join(base[:40])))
    out = {r["doc_id"]: r for r in jaccard_join.join(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    component, links = brute.classes(made)
    true, have = sum(links.values()), sum(r["n_links"] for r in out.values())
    assert have <= true and have >= 0.99 * true
    assert all(out[i]["class_id"] == component[i] for i in range(150, 300))


def test_large_bucket_members_leave_with_their_partners_joined():
    """Excerpts of 70 to 95 % of a pivot: who has no edge stays, and who leaves has no partner without an edge."""
    rng, lost = np.random.default_rng(7), 0
    for _ in range(40):
        pivot = np.unique(rng.integers(0, 2**64, 1000, np.uint64))
        order = rng.permutation(pivot)
        sets = [np.sort(order[: len(pivot) * share // 100]) for share in range(70, 96)]  # nested: similarity is the ratio of sizes
        batch = pa.RecordBatch.from_pydict({
            "key": pa.array([9] * len(sets), pa.int64()), "node": pa.array(range(1, len(sets) + 1), pa.int64()),
            "size": pa.array([len(s) for s in sets], pa.int32()), "sketch": [jaccard_join.sketch(s) for s in sets],
            "pivot": pa.array([0] * len(sets), pa.int64()), "pivot_size": pa.array([len(pivot)] * len(sets), pa.int32()),
            "pivot_sketch": [jaccard_join.sketch(pivot)] * len(sets),
        })
        out = next(jaccard_join._pivoted(iter([batch]))).to_pylist()
        edge, stays = [r["a"] == 0 for r in out], [bool(r["keys"]) for r in out]
        assert all(e or s for e, s in zip(edge, stays, strict=True))
        n = range(len(sets))
        lost += sum(not stays[i] and not edge[j] for i in n for j in n if len(sets[j]) >= 0.8 * len(sets[i]))
    assert lost == 0


def test_jaccard_join_excerpts_in_a_large_group(spark):
    """A group of over BUCKET near copies with excerpts of 75 to 80 % of them, and excerpts of those."""
    rng = random.Random(12)
    base, made = brute.text(rng, 400).split(), []
    for i in range(240):
        w = list(base) if i % 2 else base[: 4 * (75 + i % 6)]
        w[rng.randrange(len(w))] = f"e{i}"
        made.append((i, " ".join(w)))
    out = {r["doc_id"]: r for r in jaccard_join.join(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    component, links = brute.classes(made)
    assert all(out[i]["class_id"] == component[i] and out[i]["n_links"] == links[i] for i in range(len(made)))


def _twins(n):
    """Pairs of equal sketches, unlike every other, all under one key."""
    rng, made = np.random.default_rng(3), []
    for i in range(n):
        own = rng.integers(0, 2**16, jaccard_join.BINS, np.uint16)
        made += [(2 * i, 500, [1], own.tobytes()), (2 * i + 1, 500, [1], own.tobytes())]
    return made


@pytest.mark.parametrize("splits", [0, 6])
def test_large_buckets(spark, monkeypatch, splits):
    """Pairs unlike the pivot are found, whether levels make their bucket small or it is searched whole in pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 20)
    monkeypatch.setattr(jaccard_join, "SPLITS", splits)
    sets = spark.createDataFrame(_twins(100), "node long, size int, keys array<long>, sketch binary")
    found = {r["node"]: r["component"] for r in jaccard_join.candidate_groups(sets, 1, 1).collect()}
    assert all(found[2 * i] == found[2 * i + 1] == 2 * i for i in range(100))


def test_bucket_that_needs_many_splits(spark, monkeypatch):
    """Sketches that agree but for a few bins, so that each split sheds little: recall of likely pairs against brute force."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 16)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**16, jaccard_join.BINS, np.uint16)
    sketches = []
    for _ in range(40):
        own = base.copy()
        own[rng.permutation(jaccard_join.BINS)[:30]] = rng.integers(0, 2**16, 30, np.uint16)
        for _ in range(4):
            near = own.copy()
            near[rng.permutation(jaccard_join.BINS)[:6]] = rng.integers(0, 2**16, 6, np.uint16)
            sketches.append(near)
    made = [(i, 500, [1, 2, 3], x.tobytes()) for i, x in enumerate(sketches)]
    found = {r["node"]: r["component"] for r in jaccard_join.candidate_groups(spark.createDataFrame(made, "node long, size int, keys array<long>, sketch binary"), 1, 3).collect()}
    n = range(len(sketches))
    near = [(i, j) for i in n for j in range(i) if (sketches[i] == sketches[j]).mean() >= 0.7]
    assert len(near) > 100 and sum(found.get(i, -1) == found.get(j, -2) for i, j in near) >= 0.98 * len(near)


def test_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(2)
    base = brute.text(rng, 120).split()
    made = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    _, links = brute.classes(made)
    from ledgerlens.llm.common import written

    texts = spark.createDataFrame([(0, i, 1, t) for i, t in made], "component long, node long, copies long, text string")
    out = jaccard_join.verified(written(texts, "test")).where("other IS NULL").groupBy("node").agg(F.sum("links").alias("n")).collect()
    assert {r["node"]: r["n"] for r in out} == {i: links[i] for i in range(90)}


def test_jaccard_stage_keeps_one_of_each_class(spark, docs, rows):
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    component, _ = brute.classes(rows)
    blank = sum(1 for r in rows if not brute.words(r[1]))
    full = {c for i, c in enumerate(component) if brute.words(rows[i][1])}
    assert kept.count() == len(full) + blank


# ---------------------------------------------------------------- 7
def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(6)
    made = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(700)]
    made += [(700 + i, made[i % 5][1]) for i in range(300)]
    made += [(1000, None), (1100, [float("nan")] * 8), (1200, [None] * 8), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1400, []), (None, [0.0] * 8), (1303, [float("inf"), 1.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(df)
    out = got(topk.search(vectors, topk.index(vectors, 256, 16), F.col("vec_id") % 100 == 0, block=3), "query_id", "rank", "vec_id", "score")
    held = {r["vec_id"]: r["v"] for r in vectors.collect()}
    want = []
    for q in (x for x in held if x % 100 == 0):
        s = sorted((-sum(a * b for a, b in zip(held[q], v, strict=True)), i) for i, v in held.items() if i != q and len(v) == len(held[q]))
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:10])]
    assert out == sorted(want, key=repr)
    tree = topk.build(np.arange(2000), np.random.default_rng(1).integers(-500, 500, (2000, 3)), 16)
    near = topk.Search(np.asarray([-1]), np.asarray([[900, 5, -3]]), 10, {})
    assert len(next(near.best(tree, False))[1]) == 10 and near.visited < len(tree["nodes"]) / 2
    big = spark.createDataFrame([(0, [2.0**31 + 1, 1.0]), (1, [2.0**31 + 3, 1.0]), (2, [2.0**31 + 3, 2.0])], "vec_id long, embedding array<double>")
    whole = topk.integer_vectors(big, 1)
    assert got(topk.search(whole, topk.index(whole), F.col("vec_id") == 0, k=2), "rank", "vec_id", "score") == [(1, 2, (2**31 + 1) * (2**31 + 3) + 2), (2, 1, (2**31 + 1) * (2**31 + 3) + 1)]
    for wrong in (topk.integer_vectors(big), topk.integer_vectors(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"))):
        with pytest.raises(Exception, match="leaves the range of long"):
            topk.search(wrong, topk.index(wrong), F.col("vec_id") == 0).collect()
    empty = topk.integer_vectors(df.where("false"))
    assert topk.search(empty, topk.index(empty), F.lit(True)).count() == 0


# ---------------------------------------------------------------- 8
def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": pytest.approx(250 / 3), "c": pytest.approx(500 / 3)}
    out = mixing.targets({"b": 0, "a": 10, None: 5, "é": 1000})
    assert list(out) == ["a", "b", "é", None] and out["a"] == 20 and out["b"] == 0 and sum(out.values()) == pytest.approx(1.5 * 1015)
    assert mixing.targets({}) == {}


def test_mixing(spark, docs, none, rows):
    made = [(i, "w " * (i * 37 % 90), None if i % 7 == 0 else f"s{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("__rid", F.monotonically_increasing_id())
    out = mixing.copies(df).collect()
    sums, goal, size = Counter(), {}, {}
    for r in out:
        assert 0 <= r["copies"] <= 2
        sums[r["source"]] += r["copies"] * r["size"]
        goal[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert goal == mixing.targets(size) and all(abs(sums[s] - goal[s]) <= 90 for s in goal)
    again = mixing.copies(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in out)
    odd = mixing.copies(docs.withColumn("__rid", F.monotonically_increasing_id())).collect()
    assert sorted(r["size"] for r in odd) == sorted(len((r[1] or "").encode().split()) for r in rows)
    assert mixing.copies(none.withColumn("__rid", F.lit(0).cast("long"))).count() == 0
    assert mixing.stage(spark, docs, "").columns == docs.columns
    clash = docs.withColumn("__rid", F.lit("x")).withColumn("__copy", F.lit("y")).withColumn("h", F.lit("z")).withColumn("a.b", F.lit("w"))
    mixed = mixing.stage(spark, clash, "")
    assert mixed.columns == clash.columns and {(r["__rid"], r["__copy"], r["h"], r["a.b"]) for r in mixed.collect()} == {("x", "y", "z", "w")}
    assert mixing.stage(spark, none, "").count() == 0


# ---------------------------------------------------------------- 9
def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_html_articles(spark):
    made = [
        (0, "http://a.com/1", page("<nav><ul><li>menu<li>more</ul></nav><header>top</header><article><h1>T &amp; U</h1><p><b>bold<br>next\n\n line<p>a<b>b</b>c<div class='share-box'>no</div><aside>no</aside><script>x='<p>no</p>'</script><form>no</form><section id=comments><p>no</p></section></article><footer>end</footer>")),
        (1, None, None), (2, "not a url", ""), (3, "http://a.com/2", page("<article><p>&lt;p&gt; &#233;&nbsp;x &hellip;</article>")),
        (4, "http://a.com/3", "<article>open <i>never closed"), (5, "x", "<p>loose<!-- <p>no</p> --> text</p>"), (5, "x", "<p>loose<!-- <p>no</p> --> text</p>"),
        (None, "http://a.com/4", page("<article>" + "<div>" * 500 + "deep" + "</article>")), (6, "http://b.com", page("<article><p>" + "long " * 50000 + "</p></article>")),
    ]
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_extract.extract(df.withColumn("text", F.lit("clash"))).collect()}
    assert out[0]["text"] == "T & U bold next line abc" and out[1]["text"] == "" and out[2]["text"] == ""
    assert out[3]["text"] == "<p> é x …" and out[4]["text"] == "open never closed" and out[5]["text"] == "loose text"
    assert out[None]["text"] == "deep" and len(out[6]["text"]) == 250000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert html_extract.extract(df).count() == len(made) and html_extract.extract(df.where("false")).count() == 0


def test_html_wrapper(spark):
    """Without articles, what a host repeats is template and what varies is content."""
    body = "<div><div>Site of things</div><div><p>Story {0} begins.</p><p>It goes on {0}.</p></div><div>About us and terms</div></div>"
    made = [(i, f"http://h.org/{i}", page(body.format(i))) for i in range(9)] + [(100, "http://one.org/", page(body.format(1)))]
    out = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Story {i} begins. It goes on {i}." for i in range(9))
    assert out[100].startswith("Site of things Story 1 begins.")


def test_tree_matching():
    s = html_extract.Slot
    a = s("d", [], [s("p", []), s("x", []), s("p", [])])
    b = s("d", [], [s("p", []), s("p", []), s("y", [])])
    assert html_extract.match(a, b) == 3 and html_extract.match(a, a) == 4 and html_extract.match(a, s("e", [])) == 0


def test_tree_matching_by_brute_force():
    """Kinds, equal ends and halved tables find what the plain recursion finds, and pairs that keep order and parents."""

    def plain(a, b):
        if a.tag != b.tag:
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(x, y))
        return best[-1][-1] + 1

    rng = random.Random(9)

    def tree(depth):
        return html_extract.Slot(rng.choice("pqr"), [], [tree(depth - 1) for _ in range(rng.randrange(5) if depth else 0)])

    for cells in (1 << 20, 2):
        html_extract.CELLS, before = cells, html_extract.CELLS
        try:
            for _ in range(150):
                a, b = tree(3), tree(3)
                b.tag = a.tag
                pairs = list(html_extract.Matching().pairs(a, b))
                assert len(pairs) == html_extract.match(a, b) == plain(a, b)
                assert all(x.tag == y.tag and places == sorted(places) and len({i for i, _ in places}) == len(places) for x, y, places in pairs)
                whole = html_extract._slots(html_extract._bare(a))
                html_extract.merge(whole, html_extract._slots(html_extract._bare(b)))
                assert html_extract.match(whole, a) == len(html_extract._preorder(a)) and html_extract.match(whole, b) == len(html_extract._preorder(b))
                assert len(html_extract._preorder(whole)) == len(html_extract._preorder(a)) + len(html_extract._preorder(b)) - len(pairs)
        finally:
            html_extract.CELLS = before


def test_html_wrapper_of_all_pages(spark, monkeypatch):
    """A host's wrapper needs no good first page, holds blocks that it lacks, and outlives copies and several rounds of merging."""
    monkeypatch.setattr(html_extract, "MERGED", 3)
    made = [(0, "http://h.org/0", None), (1, "http://h.org/1", page("<p>Error"))]
    for i in range(2, 24):
        notice = "<section><ul><li>Offer of the week</ul></section>" if i % 4 else ""
        body = f"<div>{notice}<div><h2>Story {i}</h2>" + f"<p>It goes on {i}.</p><ul><li>and on {i}</ul>" * (i % 5) + f"</div><div><ol><li>About us {{0}}</ol></div></div>"
        made.append((i, f"http://h.org/{i}", page(body.format("and terms"))))
    made += [(100 + i, "http://copies.org/", page("<div><p>One story.</p></div><div><ol><li>One end</ol></div>")) for i in range(9)]
    out = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert out[0] == "" and out[1] == "Error"
    assert all(out[i] == " ".join([f"Story {i}"] + [f"It goes on {i}. and on {i}"] * (i % 5)) for i in range(2, 24))
    assert all(out[100 + i] == "One story. One end" for i in range(9))


def test_html_deep_and_wide_pages():
    deep = "<div>" * 3000 + "<aside>no</aside><article>yes <div><nav>no</nav>and</div></article>" + "</div>" * 3000 + "<p>after"
    assert html_extract.extract_page(page(deep), None, {}) == "yes and"
    plain = "<div>" * 3000 + "<aside>no</aside>in" + "</div>" * 3000 + "<p>after"
    tree = html_extract.shape(html_extract.parse(page(plain)))
    assert html_extract.extract_page(page(plain), html_extract._bare(tree), {}) == "in after"
    assert html_extract.extract_page(page("<p>no<b><article>yes</article>"), None, {}) == "yes"
    wide = [page("".join(f"<p>{i}</p><ul><li>{i}</li></ul>" + "<h2>x</h2>" * (i % k == 0) for i in range(3000))) for k in (3, 7)]
    a, b = (html_extract.shape(html_extract.parse(w)) for w in wide)
    assert html_extract.match(a, b) > 6000


# ---------------------------------------------------------------- 10
def test_line_dedup(spark, docs, none, rows):
    long = "This line has at least forty code points, yes"
    made = [(i, f"head {i}\n  {long.upper() if i % 2 else long}\t\nend\n{long}") for i in range(6)] + [(9, "é" * 39), (10, "é" * 40), (None, long), (2, None), (3, ""), (11, long[:39])]
    made += [(20 + i, "é" * 40 + "\r") for i in range(4)] + [(30, "x" * 50)] * 6
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    for fanout in (2, 4):
        out = line_dedup.dedup(df.drop("n_lines"), fanout=fanout).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256))
        assert got(out, "doc_id", "n_lines", "n_dropped", "sha") == sorted(brute.line_dedup(made), key=repr)
    out = line_dedup.dedup(docs).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert got(out, "doc_id", "n_lines", "n_dropped", "sha") == sorted(brute.line_dedup([r[:2] for r in rows]), key=repr)
    assert line_dedup.dedup(none).count() == 0 and line_dedup.dedup(df).count() == len(made)


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, 2)
    for b in range(5):
        batch = spark.createDataFrame([(bytes([k]), b) for k in range(b, b + 3)], "key binary, doc_id long")
        unseen = sorted(r["key"][0] for r in runs.unseen(batch).collect())
        assert unseen == (list(range(3)) if b == 0 else [b + 2])
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r["key"][0]: (r["n"], r["last"]) for r in runs.all().collect()}[2] == (3, 2)


# ---------------------------------------------------------------- shared
def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: root(x) for x in up}
