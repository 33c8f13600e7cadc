"""WIN-3: packets cut into sections, held against a plain walk over their pages."""

import random
import re

from ledgerlens.operators import sequences as W

COUNTER = re.compile(r"\bpage\s+(\d+)\s+of\s+(\d+)\b", re.I)


def clean(line):
    return re.sub(r"[^A-Za-z0-9:/.-]+", " ", re.sub("<[^>]+>", " ", line)).strip().lower()


def walk(pages):
    """(start, end, confidence, why, name) of one packet's pages {page: text}."""
    out, last, header = [], None, set()
    for n, (page, text) in enumerate(sorted(pages.items())):
        text = text or ""
        m = COUNTER.search(text)
        counter = (int(m[1]), int(m[2])) if m else None
        lines = [x for x in map(clean, text.split("\n")[:24]) if x and not COUNTER.search(x) and not x.startswith(("format no", "printed by", "printed on", "this document is electronically issued"))][:3]
        words = {w for x in lines for w in x.split() if len(w) > 2}
        alike = len(words & header) / len(words | header) if words | header else 1.0
        why = None
        if n == 0:
            why = ("initial_section", 1.0)
        elif counter and last and counter[0] == 1 and (last[0] > 1 or counter[1] != last[1]):
            why = ("page_counter_reset", 0.92)
        elif alike < 0.22 and len(words) >= 3:
            why = ("header_signature_shift", 0.76)
        if why:
            if out:
                out[-1][1] = page - 1
            heads = [x.strip() for x in text.split("\n")[:20] if x.strip().startswith("#")]
            name = (clean(heads[0]) if heads else "") or (lines[0] if lines else f"section_{len(out) + 1:03d}")
            out.append([page, page, why[1], why[0], name[:120]])
        out[-1][1] = page
        last, header = counter or last, words if lines else header
    return [tuple(x) for x in out]


def test_packets(spark):
    rnd = random.Random(4)
    lines = ["# Batch <b>Record</b> Alpha", "Batch Record Alpha", "Packing material request", "packing material request no. 7", "Page 1 of 3", "page 2 of 3", "Page 1 of 1", "Page  3 of 9", "Printed by: me", "a b", "", "éé", "# ", "x" * 200]
    packets = {f"d{d}": {p: rnd.choice([None, *["\n".join(rnd.choices(lines, k=rnd.randint(0, 5)))] * 6]) for p in rnd.sample(range(1, 15), k=rnd.randint(1, 9))} for d in range(200)}
    df = spark.createDataFrame([(d, p, t) for d, ps in packets.items() for p, t in ps.items()], "doc_id string, page int, text string")
    got = {}
    for r in W.packet_sections(df, ["doc_id"]).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], (r["start_page"], r["end_page"], r["confidence"], r["why"], r["name"])))
    assert {d: [x for _, x in sorted(v)] for d, v in got.items()} == {d: walk(ps) for d, ps in packets.items()}
    assert {x[3] for ps in packets.values() for x in walk(ps)} == {"initial_section", "page_counter_reset", "header_signature_shift"}
