"""FN-36 and FN-43: cells, layers one by one, idempotence, splices and pages, held against values by hand and plain loops."""

import random

import pytest

from ledgerlens.functions import edits as E
from ledgerlens.functions import signatures as G

COLUMNS = ["Done by", "checked  BY", "sign"]
PAGES = "page int, text string, has_signature boolean, has_handwriting boolean"


def table(*cells):
    return "before\n| Step | Done by | Remark |\n|---|:--|---|\n" + "\n".join(f"| 1 |{c}| JK |" for c in cells) + "\nafter"


def one(spark, cell, signature=False, handwriting=False, **how):
    df = spark.createDataFrame([(1, table(cell), signature, handwriting)], PAGES)
    r = G.enriched(df, COLUMNS, **how).collect()[0]
    got = {k: v for k, v in r["counts"].items() if v}
    return r["enriched"], got, r["injected"]


LAYERS = [
    # cell, page evidence, its layer, the cell afterwards
    (" <p>Image: signature</p> 01/02/2025 ", (), "L_IMG_PLACEHOLDER", " [Signature] 01/02/2025 "),
    (" <p> image : Signature </p> ", (), "L_IMG_PLACEHOLDER", " [Signature] "),
    (' <img data-bbox="1 2 3 4" src="h.jpg"/> ', (), "L_IMG", ' [Signature] <img data-bbox="1 2 3 4" src="h.jpg"/> '),
    (" 03/10/2025 ", ("signature",), "L2", " [Signature] 03/10/2025 "),
    (" 03-10-25 ", ("handwriting",), "L3", " [Signature] 03-10-25 "),
    (" 03-10-25 ", ("signature", "handwriting"), "L2", " [Signature] 03-10-25 "),
    (" <br>27/11/2025 -- ", (), "L4", " [Signature] <br>27/11/2025 -- "),
    (" <i>FE</i><br>22/11/2025 ", ("signature",), "L_HWTEXT", " [Signature] <i>FE</i><br>22/11/2025 "),
    (" R. K. Jha ", ("signature",), "L_TEXT", " [Signature] R. K. Jha "),
    (" OK ", ("signature",), "verdict", " OK "),
    (" <i>n/a</i> ", (), "verdict", " <i>n/a</i> "),
    (" Sampled by the quality team of the second shift ", (), "long", " Sampled by the quality team of the second shift "),
    (" [signature] 1/1/25 ", ("signature",), "marked", " [signature] 1/1/25 "),
    ("", ("signature",), None, ""),
    (" ---- ", ("signature",), None, " ---- "),
    (" <b>__</b> ", ("handwriting",), None, " <b>__</b> "),
]


@pytest.mark.parametrize("cell,evidence,layer,after", LAYERS)
def test_layers(spark, cell, evidence, layer, after):
    text, counts, injected = one(spark, cell, **dict.fromkeys(evidence, True))
    assert text == table(after)
    counts.pop("L1", None)
    assert counts == ({layer: 1} if layer else {}) and injected == (layer in G.CONFIDENCE)


def test_placeholders_of_marked_cells_go(spark):
    text, counts, injected = one(spark, " [Signature] <p>Image: signature</p> x ")
    assert text == table(" [Signature] x ") and counts == {"L1": 1, "L_IMG_PLACEHOLDER": 1} and injected == 0


def test_strict_pages_and_switches(spark):
    assert one(spark, " 03/10/2025 ", aggressive=False)[0] == table(" 03/10/2025 ")
    image = ' <img data-bbox="1" src="x"> '
    assert one(spark, image, aggressive=False)[1] == {"L_IMG": 1}
    text, counts, _ = one(spark, image, enabled=False)
    assert text == table(image) and counts == {}
    df = spark.createDataFrame([(1, "<!-- block_type: signature -->\n" + table(" AB "), None, None), (2, None, True, True), (3, "", True, True)], PAGES)
    rows = {r["page"]: r for r in G.enriched(df, []).collect()}
    assert rows[1]["enriched"] == "<!-- block_type: signature -->\n" + table(" AB ") and rows[1]["counts"]["L0"] == 1
    rows = {r["page"]: r for r in G.enriched(df, COLUMNS).collect()}
    assert rows[2]["enriched"] is None and rows[3]["enriched"] == "" and rows[1]["injected"] == 1


def random_page(rnd):
    cells = [c for c, *_ in LAYERS] + [r" a \| b ", "x|y"]
    out = []
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.random()
        if kind < 0.3:
            out.append(rnd.choice(["", "text | with a bar", "| no rule here | Done by |", "é€ 𝄞"]))
            continue
        head = rnd.choices(["Step", "Done by", "Checked by", "SIGN  here", "Remark"], k=rnd.randint(1, 4))
        lines = ["|" + "|".join(head) + "|", "|" + "---|" * len(head)]
        lines += [rnd.choice(["|", " |"]) + "|".join(rnd.choices(cells, k=rnd.randint(1, 5))) + rnd.choice(["|", "", "| "]) for _ in range(rnd.randint(0, 4))]
        out += lines
    return "\n".join(out)


def test_twice_changes_nothing(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, random_page(rnd), rnd.random() < 0.3, rnd.random() < 0.3) for i in range(300)], PAGES)
    for how in ({}, {"aggressive": False}):
        once = G.enriched(df, COLUMNS, **how).select("page", G.F.col("enriched").alias("text"), "has_signature", "has_handwriting", "injected")
        twice = {r["page"]: r for r in G.enriched(once.drop("injected"), COLUMNS, **how).collect()}
        rows = once.collect()
        assert sum(r["injected"] for r in rows) > 50
        for r in rows:
            assert twice[r["page"]]["enriched"] == r["text"] and twice[r["page"]]["injected"] == 0


def test_cells_stand_where_they_say():
    rnd = random.Random(4)
    for _ in range(300):
        text = random_page(rnd)
        for c in G.cells_in(text):
            assert text[c["start"] : c["end"]] == c["text"] and "\n" not in c["text"]
    got = [(c["table"], c["row"], c["column"], c["header"], c["text"]) for c in G.cells_in("|a|b|\n|--|--|\n|1|x\\|y|\n|2|\n\n|q|\n\n | h |\n |-|\n | v |z|")]
    assert got == [(0, 0, 0, None, "a"), (0, 0, 1, None, "b"), (0, 2, 0, "a", "1"), (0, 2, 1, "b", "x\\|y"), (0, 3, 0, "a", "2"), (1, 0, 0, None, " h "), (1, 2, 0, " h ", " v "), (1, 2, 1, None, "z")]


# ---------------------------------------------------------------- FN-43
def reverse_splice(text, edits):
    for e in sorted(edits, key=lambda e: -e["start"]):
        text = text[: e["start"]] + e["text"] + text[e["end"] :]
    return text


def test_splices_equal_reverse_splices(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(200):
        text = "".join(rnd.choices("abc é€𝄞\n", k=rnd.randint(0, 60)))
        cuts = sorted(rnd.sample(range(len(text) + 1), k=min(len(text) + 1, 2 * rnd.randint(0, 6)) // 2 * 2))
        edits = [{"start": a, "end": b, "text": rnd.choice(["", "X", "longer text"])} for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        rnd.shuffle(edits)
        rows.append((i, text, edits))
    df = spark.createDataFrame(rows, f"id int, text string, edits {E.EDITS}")
    got = {r["id"]: r["x"] for r in df.select("id", E.spliced(df["text"], df["edits"]).alias("x")).collect()}
    assert got == {i: reverse_splice(t, es) for i, t, es in rows}


def test_splices_at_the_edges():
    assert E.splice(None, []) is None and E.splice("ab", None) == "ab" and E.splice("", [{"start": 0, "end": 0, "text": "x"}]) == "x"
    assert E.splice("abcdef", [{"start": 2, "end": 4, "text": "-"}, {"start": 3, "end": 5, "text": "lost"}, {"start": 4, "end": 9, "text": "!"}]) == "ab-!"
    assert E.splice("ab", [{"start": -3, "end": 1, "text": "x"}, {"start": 5, "end": 7, "text": "lost"}]) == "xb"


def plain_pages(content, pages, tables):
    out = {}
    for p, a, b in pages:
        if a < b:
            cut = content[a:b]
            own = [(max(s, a) - a, min(e, b) - a, h or "") for of, s, e, h in tables if of == p and s < b and e > a and s < e]
            out[p] = reverse_splice(cut, [{"start": s, "end": e, "text": h} for s, e, h in own]).strip(" ")
    return out


def test_page_texts(spark):
    rnd = random.Random(9)
    docs, pages, tables, want = [], [], [], {}
    for d in range(40):
        content = "".join(rnd.choices("ab 𝄞\n", k=rnd.randint(1, 200)))
        cuts = [0, *sorted(rnd.sample(range(len(content)), k=min(len(content) // 10, 5))), len(content)]
        own_pages = [(p + 1, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        spans = sorted(rnd.sample(range(len(content) + 1), k=min(len(content), 4) // 2 * 2))
        own = [(p, s, e, rnd.choice(["<t>", "", None])) for s, e in zip(spans[::2], spans[1::2], strict=True) for p, a, b in own_pages if s < b and e > a]
        docs.append((d, content))
        pages += [(d, *x) for x in own_pages]
        tables += [(d, *x) for x in own]
        want |= {(d, p): t for p, t in plain_pages(content, own_pages, own).items()}
    got = E.page_texts(
        spark.createDataFrame(docs, "doc_id int, content string"),
        spark.createDataFrame(pages, "doc_id int, page int, start int, end int"),
        spark.createDataFrame(tables, "doc_id int, page int, start int, end int, html string"),
    ).collect()
    assert {(r["doc_id"], r["page"]): r["text"] for r in got} == want


def test_grid_html(spark):
    cells = [
        {"r": 0, "c": 0, "text": "A&B", "kind": "columnHeader", "cs": 2},
        {"r": 1, "c": 0, "text": "r", "kind": "rowHeader", "pages": [1]},
        {"r": 1, "c": 1, "text": "x", "rs": 2, "pages": [1]},
        {"r": 2, "c": 1, "text": "late", "pages": [2]},
        {"r": 2, "c": 7, "text": "outside", "pages": [2]},
    ]
    flat = lambda t: t.replace("\n", "")
    assert flat(E.grid_html(cells, 2, page=1)) == '<table><thead><tr><th colspan="2">A&amp;B</th></tr></thead><tbody><tr><th scope="row">r</th><td>x</td></tr></tbody></table>'
    assert flat(E.grid_html(cells, 2, page=2)) == '<table><thead><tr><th colspan="2">A&amp;B</th></tr></thead><tbody><tr><td></td><td>late</td></tr></tbody></table>'
    assert E.grid_html([]) == "" and flat(E.grid_html([{"r": 0, "c": 0, "text": 1}], caption="<c>")) == "<table><caption>&lt;c&gt;</caption><tbody><tr><td>1</td></tr></tbody></table>"
    rows = [tuple(x.get(k) for k in ("r", "c", "text", "rs", "cs", "kind", "pages")) for x in cells]
    df = spark.createDataFrame([(rows, 1), (rows, 2), (None, 1)], f"cells {E.CELLS}, page int")
    got = [r[0] for r in df.select(E.grid_tables(df["cells"], df["page"])).collect()]
    assert got == [E.grid_html(cells, page=1), E.grid_html(cells, page=2), None]
