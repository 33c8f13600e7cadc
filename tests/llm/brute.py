"""Plain versions of the operators' results, and a fixture of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, c0 string, size int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def jaccard(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) if a and b else False


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=1):
    """Nulls, empties, blanks, long texts, copies, near copies, repeated rows, odd characters, shared passages."""
    rng = random.Random(seed)
    texts = [text(rng, rng.randrange(20, 120)) for _ in range(60)]
    near = []
    for _ in range(12):
        w = texts[0].split() if rng.random() < 0.7 else texts[1].split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    passage = text(rng, 60)
    shared = [f"{text(rng, 30)} {passage} {text(rng, 20)}" for _ in range(4)]
    odd = [None, "", " \n\t", "one", "Zwei Wörter", "KELVIN K sign İ", "a b \U0001f600 c", "x\0y", "....", "tok " * 5000, text(rng, 6000)]
    everything = texts + [texts[2]] * 5 + near + shared + odd
    rows = []
    for i, t in enumerate(everything):
        lang = ["en", "de", None, "EN-gb"][i % 4]
        rows.append((i, t, lang, [f"s{i % 3}", None, "", "hot", "hot"][i % 5], None, "k", "n", "c", 7))
    rows.append(rows[5])
    rows.append((None, texts[3], None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


def classes(rows):
    """Components of Jaccard links over row numbers, and links by row."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))], links


def decontaminated(docs, bench, window=13):
    keys = defaultdict(set)
    for item, t in bench:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n and item is not None else ():
            keys[tuple(w[i : i + n])].add(str(item))
    lengths = {len(k) for k in keys}
    out = []
    for d, t in docs:
        w = words(t)
        hit, items = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if who := keys.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= who
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def line_dedup(docs):
    blank = " \t\n\r\x0b\x0c"
    key = lambda x: x.strip(blank).translate(LOWER)
    held = defaultdict(list)
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(d)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= 5}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x)) is None or (d is not None and d >= last[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def sizes(rows):
    return [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows]
