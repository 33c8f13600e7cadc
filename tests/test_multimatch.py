"""Many patterns in one pass, held against each pattern alone; no plan of theirs has a nested loop."""

import fnmatch
import random

from ledgerlens.operators import classify as C
from ledgerlens.operators import multimatch as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_globs(spark):
    rnd = random.Random(1)
    pieces = ["*", "?", "ab", "B", "[ac]", "x.PDF", "é", "", ".", "[!b]"]
    globs = [(f"r{rnd.randint(0, 9)}", "".join(rnd.choices(pieces, k=rnd.randint(0, 4)))) for _ in range(300)] + [("all", "*")]
    names = [None, "", *("".join(rnd.choices(["a", "B", "ab", "x.pdf", "É", ".", "[ac]"], k=rnd.randint(1, 4))) for _ in range(150))]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id int, name string")
    table = spark.createDataFrame(globs, "role string, glob string")
    want = {(i, r) for i, n in enumerate(names) if n is not None for r, g in globs if fnmatch.fnmatchcase(n.lower(), g.lower().replace("[", "[[]"))}
    df = C.filename_scores(docs, table, "name")
    got = [(r["doc_id"], r["role"]) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want and "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_words(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abAB é", k=rnd.randint(1, 4)))
    words = [(f"r{rnd.randint(0, 9)}", word()) for _ in range(400)] + [("r0", "")]
    texts = [None, "", *("".join(rnd.choices("abABÉ ", k=rnd.randint(1, 40))) for _ in range(150))]
    docs = spark.createDataFrame([(i % 90, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {}
    for i, t in enumerate(texts):
        for r, w in words:
            if t and w and w.lower() in t.lower():
                found.setdefault((i % 90, r), set()).add(w)
    df = C.header_scores(docs, spark.createDataFrame(words, "role string, word string"), "text", enough=5)
    assert {(r["doc_id"], r["role"]): r["score"] for r in df.collect()} == {k: min(1.0, len(v) / 5) for k, v in found.items()}
    assert "NestedLoop" not in plan(df)


def plain_family(text, words, fallback):
    t = " ".join((text or "").lower().split())
    if not t:
        return fallback, 0.0, "empty"
    best = (fallback, 0.0, 0)
    for f in dict.fromkeys(f for f, _ in words):
        score = matched = 0
        for g, w in words:
            w = " ".join(w.lower().split())
            if g == f and w:
                part = 100 if w in t else 45 if len(set(w.split()) & set(t.split())) >= max(1, len(set(w.split())) // 2) else 0
                score, matched = score + part, matched + (part > 0)
        if score / 100 > best[1]:
            best = (f, score / 100, matched)
    return (best[0], round(min(1.0, best[1] / 2.5), 3), f"matched:{best[2]}") if best[1] else (fallback, 0.2, "fallback")


def test_families(spark):
    rnd = random.Random(3)
    vocabulary = ["raw", "Material", "issue", "log", "é", "of"]
    words = [(f"f{o}", o, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 3)))) for o in range(6) for _ in range(3)]
    texts = [None, "", "  ", "nothing", *("  ".join(rnd.choices([*vocabulary, "rawmaterial", "x"], k=rnd.randint(1, 5))) for _ in range(120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    shuffled = rnd.sample(words, k=len(words))
    df = C.resolve_family(docs, spark.createDataFrame(shuffled, "family string, ordinal int, word string"), "doc_id", "text", "generic")
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    assert got == {i: plain_family(t, [(f, w) for f, _, w in words], "generic") for i, t in enumerate(texts)}
    assert "NestedLoop" not in plan(df) and "Exchange" not in plan(df)


def test_cardinality_has_no_nested_loop(spark):
    docs = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "b")], "package string, role string")
    roles = spark.createDataFrame([("a", "exactly_one"), ("b", "at_least_one"), ("c", "zero_or_more")], "role string, cardinality string")
    df = C.cardinality(roles, docs, "package")
    assert sorted(map(tuple, df.collect())) == [("p", "a", 2, "TOO_MANY"), ("p", "b", 0, "MISSING"), ("q", "a", 0, "MISSING")]
    assert "NestedLoop" not in plan(df)


def test_literals():
    assert M.literals("a*b?c[xy]d") == ["a", "b", "c[xy]d"] and M.literals("*") == []
