"""Quality scores, vector codes and the filter audit: brute force, held-out accuracy and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import filter_audit as A
from ledgerlens.llm import quality as Q
from ledgerlens.llm import vector_codes as V

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


# ---------------------------------------------------------------- filter audit
def plain_audit(docs, labels):
    """(part, order, step) -> counts, one document and one order at a time."""
    text = lambda d: d["text"] or ""
    smallest = {}
    for d in docs:
        if d["doc_id"] is not None:
            smallest[text(d)] = min(d["doc_id"], smallest.get(text(d), d["doc_id"]))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for d in docs:
        t, i = text(d), d["doc_id"]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > smallest[t],
        }
        rows.append((d["lang"] or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for p in permutations("ABCDE"):
            left = own
            for n, x in enumerate(p):
                here, rest = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                failing = sum(x in r[1] for r in own)
                out[part, "".join(p), n + 1] = [len(rest), len(here), failing - len(here), sum(r[1] == {x} for r in own), sum(r[2] for r in here), sum(r[3] for r in here), x]
                total[x] += len(here)
                left = rest
        for k, v in out.items():
            if k[0] == part and isinstance(v[-1], str):
                v[-1] = total[v[-1]]
    return out


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def some_documents(rnd, n):
    words = ["one", "Two", "THREE", "four#", "é", "𝄞x", "six", "seven|", "VIII"]
    texts = [None, "", " \t\n", "A", "a" * 50, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "x y  z"]
    texts += ["\x0b".join(rnd.choices(words, k=rnd.choice([3, 150, 260]))) for _ in range(25)]
    texts += [" ".join(f"{rnd.choice(words)}{i}" for i in range(rnd.choice([10, 300]))) for _ in range(10)]
    return [{"doc_id": rnd.choice([None, *range(n)]) if rnd.random() < 0.1 else i, "text": rnd.choice(texts), "lang": rnd.choice([None, "", "en", "de"])} for i in range(n)]


def test_audit_by_brute_force(spark):
    rnd = random.Random(1)
    docs = some_documents(rnd, 400)
    docs += docs[:20]
    labels = [(rnd.choice([None, *range(400)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(300)]
    # Further columns bear the names that the operator uses itself.
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], 1, "m", "d", 5, "f", 0) for d in docs], "doc_id long, text string, lang string, part int, mask string, digest string, n int, first string, good int")
    known = spark.createDataFrame([(*x, "p") for x in labels], LABELS + ", part string")
    want = plain_audit(docs, labels)
    assert len(want) == 3 * 600 and audit_rows(A.audit(df, known)) == want


def test_audit_of_the_test_table_sums_up(spark):
    rows = A.op13_filter_interaction_audit(spark, SF).collect()
    n = {r["lang"]: r["n"] for r in spark.read.parquet(f"{SF}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert len(rows) == 600 * len(n)
    last = [r for r in rows if r["step"] == 5]
    for part, of in n.items():
        own = [r for r in last if r["part"] == part]
        removed = {r["kept"] for r in own}
        assert len(removed) == 1
        shapley = {(r["filter_order"][r["step"] - 1]): r["shapley"] for r in rows if r["part"] == part}
        assert sum(shapley.values()) == 120 * (of - removed.pop())


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert A.audit(empty, spark.createDataFrame([], LABELS)).count() == 0
    one = A.audit(spark.createDataFrame([(None, None, None, None, None)], DOCS), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and {tuple(r) for r in one.where("step = 1").select("part", "kept", "removed").collect()} == {("", 0, 1), ("", 1, 0)}


# ---------------------------------------------------------------- vector codes
def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, np.floor(np.array(v, np.float32).astype(np.float64) * 256).astype(int).tolist()) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, _, v in kept:
        if i is not None and len(v) % parts == 0:
            first[i] = min(first.get(i, v), v)
    if first:
        dim = len(first[min(first)])
        starts = [first[i] for i in sorted(first) if len(first[i]) == dim][:entries]
    else:
        dim, starts = 0, []
    w = dim // parts
    books = [[s[p * w : (p + 1) * w] for s in starts] for p in range(parts)]
    fit = [(n, v) for n, (_, _, v) in enumerate(kept) if starts and len(v) == dim]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for r in range(rounds + 1):
        codes = {n: [nearest(p, v[p * w : (p + 1) * w]) for p in range(parts)] for n, v in fit}
        if r == rounds:
            break
        new = [list(b) for b in books]
        for p in range(parts):
            for k in range(len(starts)):
                own = [v[p * w : (p + 1) * w] for n, v in fit if codes[n][p][1] == k]
                if own:
                    new[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = new
    errors = {n: sum(d for d, _ in c) for n, c in codes.items()}
    by = Counter()
    for n, e in errors.items():
        by[kept[n][1]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    labelled = {kept[n][1] for n in errors}
    return sorted(
        (str(kept[n][0]), "".join(f"{k:02x}" for _, k in codes[n]) if n in codes else None, errors.get(n), by[kept[n][1]] if kept[n][1] in labelled else None, sha) for n in range(len(kept))
    ), books


def code_rows(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def vectors_of(rnd, n, dim):
    spots = [[rnd.gauss(0, 0.3) for _ in range(dim)] for _ in range(7)]
    out = []
    for i in range(n):
        v = [x + rnd.choice([0, 0, rnd.gauss(0, 0.05)]) for x in rnd.choice(spots)]
        kind = rnd.random()
        if kind < 0.03:
            v[rnd.randrange(dim)] = rnd.choice([None, float("nan"), float("inf"), float("-inf")])
        elif kind < 0.05:
            v = rnd.choice([None, [], v[:-1], v + v])
        out.append((i, v, rnd.choice([None, 0, 1, 2])))
    return out


@pytest.mark.parametrize("dim,entries,rounds", [(32, 64, 2), (64, 9, 3), (16, 200, 1)])
def test_codes_by_brute_force(spark, dim, entries, rounds):
    rnd = random.Random(dim)
    rows = vectors_of(rnd, 220, dim)
    rows += [(None, [0.1] * dim, None), (3, [0.2] * dim, 1), (3, [0.2] * dim, 1), (500, [5.0] * dim, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int, part int")
    want, books = plain_codes(rows, entries=entries, rounds=rounds)
    assert code_rows(V.compressed(df, entries=entries, rounds=rounds)) == want
    got = V.trained(V.kept_vectors(df), entries=entries, rounds=rounds)
    assert got.entries.tolist() == books
    code = next(r for r in want if r[1])
    assert got.decoded([code[1]]).tolist() == [[x for p in range(16) for x in books[p][int(code[1][2 * p : 2 * p + 2], 16)]]]


def test_codes_of_the_test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert code_rows(V.op12_vector_codes(spark, SF)) == plain_codes(rows)[0]


def test_annuli_are_exact_and_prune():
    rng = np.random.default_rng(2)
    for scale, k, d, share in ((5, 64, 4, 0.9), (400, 64, 4, 0.9), (100000, 17, 1, 0.9), (3, 256, 2, 0.9)):
        entries, x = rng.integers(-scale, scale, (k, d)), rng.integers(-scale, scale, (2000, d))
        a = V.Annuli(entries)
        index, best = a.nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (best == every.min(1)).all() and (index == every.argmin(1)).all()
        assert a.looked_at < len(x) * k * share, a.looked_at / len(x) / k
    index, best = V.Annuli(np.array([[3, 4], [0, 5], [5, 0]])).nearest(np.array([[0, 0], [4, 3]]))
    assert index.tolist() == [0, 0] and best.tolist() == [25, 2]
    assert [len(x) for x in V.Annuli(np.array([[1, 1]])).nearest(np.empty((0, 2), np.int64))] == [0, 0]


def test_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert V.compressed(spark.createDataFrame([], schema)).count() == 0
    rows = V.compressed(spark.createDataFrame([(None, [1.0] * 16, 1), (None, None, 1), (1, [1.0] * 15, 2)], schema)).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in sorted(rows, key=lambda r: str(r["vec_id"]))] == [(1, None, None), (None, None, None)]
    with pytest.raises(Exception, match="reaches"):
        V.compressed(spark.createDataFrame([(1, [70000.0] * 16, 1)], schema)).count()


# ---------------------------------------------------------------- quality
def test_quality_on_held_out_rows(spark):
    scores = Q.op11_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = scores.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == r["quality"] for r in out) / len(out)
    good = [r["score"] for r in out if r["quality"] == 1]
    bad = [r["score"] for r in out if r["quality"] == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert right >= 0.9 and auc >= 0.93
    assert scores.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def junk(rnd, good):
    word = lambda: "".join(rnd.choices("aeioumnrst", k=rnd.randint(2, 7)))
    return " ".join(word() + ("" if good else rnd.choice(["###", "$$$", "%%%"])) for _ in range(rnd.randint(20, 120)))


def test_scores_see_no_labels_of_held_out_rows(spark):
    rnd = random.Random(6)
    rows = [(i, junk(rnd, i % 3 > 0), None, None, None) for i in range(240)]
    rows += [(240, None, None, None, None), (241, "", None, None, None), (5, "twice", None, None, None), (None, "no id", None, None, None), (242, "word " * 400_000, None, None, None)]
    docs = spark.createDataFrame([(*r, 0.5, 1, True) for r in rows], DOCS + ", score double, size int, held_out boolean")
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    first = [(i, int(i % 3 > 0), 0) for i in range(240)]
    other = [(i, 1 - q if i in held else q, 1) for i, q, _ in first] + [(7777, 1, 0), (None, 0, 0), (3, None, 0), (4, 7, 0)]
    scored = [sorted(map(tuple, Q.classified(docs, spark.createDataFrame(x, LABELS)).collect()), key=str) for x in (first, other)]
    assert scored[0] == scored[1] and len(scored[0]) == len(rows)
    by = {r[0]: r for r in scored[0] if r[0] not in (None, 5)}
    assert all(by[i][3] == int(i % 3 > 0) for i in held if i != 5) and by[240][2:] == by[241][2:]
    assert [r[1] for r in scored[0] if r[0] is None] == [False]


def test_sizes_are_of_whole_texts(spark):
    rnd = random.Random(7)
    good, bad = (Q.dictionary([junk(rnd, g).encode() for _ in range(200)]) for g in (True, False))
    texts = [None, "", "é" * 5000, junk(rnd, True), junk(rnd, False) * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["size_good"], r["size_bad"], r["size"]) for r in Q.sizes(df, good, bad).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pieces = [raw[k : k + Q.BLOCK] for k in range(0, len(raw), Q.BLOCK)] or [b""]
        assert got[i] == (*(sum(len(Q.compressor(d).compress(p)) for p in pieces) for d in (good, bad)), len(raw))
    assert got[3][0] < got[3][1] and got[4][1] < got[4][0]


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(i, f"text {i}", None, None, None) for i in range(8)], DOCS)
    fit = [i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2]
    for labels, want in (([], 0.5), ([(i, 1, 0) for i in fit], (len(fit) + 1) / (len(fit) + 2)), ([(i, 0, 0) for i in fit[:2]], 0.25)):
        assert {r["score"] for r in Q.classified(docs, spark.createDataFrame(labels, LABELS)).collect()} == {want}
    two = Q.classified(docs, spark.createDataFrame([(fit[0], 1, 0), (fit[1], 0, 0)], LABELS)).collect()
    assert len(two) == 8 and all(0 <= r["score"] <= 1 for r in two)
    assert Q.classified(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    empty = spark.createDataFrame([(i, None, None, None, None) for i in range(8)], DOCS)
    assert Q.classified(empty, spark.createDataFrame([(i, i % 2, 0) for i in range(8)], LABELS)).count() == 8


def test_regression_is_calibrated():
    rng = np.random.default_rng(3)
    x = np.c_[np.ones(4000), rng.normal(size=(4000, 2))]
    p = 1 / (1 + np.exp(-(x @ [0.5, 2.0, -1.0])))
    w = Q.fitted(x, (rng.random(4000) < p).astype(float), np.ones(4000))
    assert np.abs(w - [0.5, 2.0, -1.0]).max() < 0.25
    separable = Q.fitted(np.c_[np.ones(4), [-2.0, -1, 1, 2]], np.array([0.0, 0, 1, 1]), np.ones(4))
    assert np.isfinite(separable).all() and separable[1] > 0


# ---------------------------------------------------------------- HTML: tags as the standard reads them
@pytest.mark.parametrize(
    "source,text",
    [
        ("<article><p title=it's>Hello, don't stop</p><p>next</p></article>", "Hello, don't stop next"),
        ("<article><form action=/search/>SEARCH FORM</form>x</article>", "x"),
        ('<article>a <a title="foo>link</a> b</article>', "a link b"),
        ('<div class="article-alert side"><article><p>text</p></article></div>', "text"),
        ('<article>t<div class="related"><article>teaser</article></div></article>', "t"),
        ('<article>a<br/>b<img src=/a/b/ />c<p class = "x" id=y/>d</article>', "a b c d"),
        ("<aside class=x><article>teaser</article></aside><article>real</article>", "real"),
        ("<article>1 < 2 <b =x a='>'>c</b> 3 > 2</article>", "1 < 2 c 3 > 2"),
        ('<article><p a="b>c\'d">x</p>' + '<p a="' * 3000 + "</article>", "x"),
    ],
)
def test_tags(source, text):
    from ledgerlens.llm.html_extract import extract_page

    assert extract_page(source, None, {}) == text
