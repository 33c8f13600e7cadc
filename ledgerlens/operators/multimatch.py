"""Many patterns, one pass: words and file-name globs found in texts by an automaton, not by joining texts to patterns."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Patterns of one manifest, which every task holds; more are an error, as they are no manifest's.
MOST = 200_000

HITS = "array<struct<name:string,pattern:string>>"


def small_batches(docs: DataFrame) -> None:
    """Keeps what a Python worker holds of its input to a few megabytes, whatever the length of texts: sets the session's
    Arrow batch limits where it has none of its own."""
    conf = docs.sparkSession.conf
    for name, few in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", "4m")):
        name = f"spark.sql.execution.arrow.{name}"
        if conf.get(name, None) is None:
            conf.set(name, few)


def manifest(patterns: DataFrame, *columns: str) -> list[Row]:
    """The rows of a table that a person has written, on the driver, in order; a ValueError if it is none."""
    rows = patterns.select(*columns).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} patterns")
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


def automaton(words: Iterator[tuple[str, object]]) -> ahocorasick.Automaton | None:
    """An automaton from word to the list of what it stands for; without words none."""
    out = ahocorasick.Automaton()
    for word, value in words:
        if word in out:
            out.get(word).append(value)
        else:
            out.add_word(word, [value])
    if not len(out):
        return None
    out.make_automaton()
    return out


def _hit(found: ahocorasick.Automaton | None, text: str) -> set:
    return {x for _, xs in found.iter(text) for x in xs} if found else set()


def words_found(text: Column, words: list[tuple[str, str]]) -> Column:
    """CLS-2: the (name, word) pairs whose word a text holds, case aside, in order; words: (name, word). Empty words are found nowhere."""

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton((w.lower(), i) for i, (_, w) in enumerate(words) if w)
        for texts in parts:
            yield pd.Series([[{"name": words[i][0], "pattern": words[i][1]} for i in sorted(_hit(a, t.lower()))] if t else [] for t in texts], dtype=object)

    return F.pandas_udf(each, HITS)(text)


def literals(glob: str) -> list[str]:
    """The runs of plain characters that whatever a glob matches must hold; brackets are plain characters."""
    return [x for x in re.split(r"[*?]", glob) if x]


def globs_found(name: Column, globs: list[tuple[str, str]]) -> Column:
    """CLS-1: the (name, glob) pairs whose glob (of * and ?) matches all of a file name, case aside, in order; globs: (name, glob).

    The automaton holds each glob's longest literal; only globs whose literal occurs are tried, and those without any.
    """

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        low = [g.lower() for _, g in globs]
        longest = [max(literals(g), key=len, default="") for g in low]
        a = automaton((x, i) for i, x in enumerate(longest) if x)
        always = {i for i, x in enumerate(longest) if not x}
        tests = [re.compile(fnmatch.translate(g.replace("[", "[[]"))) for g in low]
        for names in parts:
            out = []
            for n in names:
                hits = [] if n is None else sorted(i for i in _hit(a, n.lower()) | always if tests[i].match(n.lower()))
                out.append([{"name": globs[i][0], "pattern": globs[i][1]} for i in hits])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(each, HITS)(name)


def best_family(text: Column, words: list[tuple[str, str]], fallback: str | None) -> Column:
    """CLS-10: struct(family, score, matched) of the family whose keywords fit a name best; words: (family, keyword), families in order.

    A keyword that the name holds scores 1; else one of which the name has half the words (rounded down, one at
    least) scores .45. The highest score wins, the first declared of equal ones, the fallback where none scores.
    matched: the keywords that score. Case and white space are folded.
    """
    folded = lambda x: " ".join((x or "").lower().split())

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        families = list(dict.fromkeys(f for f, _ in words))
        keys = [(families.index(f), folded(w)) for f, w in words if folded(w)]
        whole = automaton((w, i) for i, (_, w) in enumerate(keys))
        tokens = [set(w.split()) for _, w in keys]
        holding: dict[str, list[int]] = {}
        for i, ts in enumerate(tokens):
            for x in ts:
                holding.setdefault(x, []).append(i)
        for texts in parts:
            rows = []
            for t in map(folded, texts):
                full = _hit(whole, t)
                shared: dict[int, int] = {}
                for x in set(t.split()):
                    for i in holding.get(x, ()):
                        shared[i] = shared.get(i, 0) + 1
                half = {i for i, n in shared.items() if i not in full and n >= max(1, len(tokens[i]) // 2)}
                score: dict[int, list] = {}
                for i in sorted(full | half):
                    s = score.setdefault(keys[i][0], [0, 0])
                    s[0] += 100 if i in full else 45
                    s[1] += 1
                f = min(score, key=lambda f: (-score[f][0], f), default=None)
                rows.append((fallback, 0.0, 0) if f is None else (families[f], score[f][0] / 100, score[f][1]))
            yield pd.DataFrame(rows, columns=["family", "score", "matched"])

    return F.pandas_udf(each, "family string, score double, matched int")(text)
