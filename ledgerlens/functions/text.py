"""Text, identifier, date and number normalisation as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A plain decimal numeral: Spark's casts also take "1d", DuckDB's take "1_0".
NUMERAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def fold_spaces(text: Column) -> Column:
    """White space of any kind, no-break spaces included, becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def normalise_name(text: Column, ignore_case: bool = True, strip: str = "") -> Column:
    """FN-1: strip characters become spaces, spaces fold, case folds on request."""
    out = F.translate(text, strip, " " * len(strip)) if strip else text
    out = fold_spaces(out)
    return F.lower(out) if ignore_case else out


def slug(text: Column) -> Column:
    """FN-2: lower case, runs of anything but a-z and 0-9 become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalise_date(text: Column) -> Column:
    """FN-3: day/month/year with / - or . between, or ISO year-month-day, as dd/MM/yyyy; null if neither."""
    t = F.trim(text)
    forms = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d"]
    parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])
    return F.date_format(parsed, "dd/MM/yyyy")


def normalise_identifier(text: Column) -> Column:
    """FN-4: upper case, spaces folded, none around - and /."""
    return F.regexp_replace(F.upper(fold_spaces(text)), r"\s*([-/])\s*", "$1")


def to_number(text: Column) -> Column:
    """FN-8: what is left of digits, point and minus sign, as a double; null if that is no numeral."""
    left = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(left.rlike(NUMERAL), left.try_cast("double"))


def numeral(text: Column) -> Column:
    """A string as a double only if all of it is a plain decimal numeral."""
    return F.when(text.rlike(NUMERAL), F.trim(text).try_cast("double"))


def normalise_field(field: Column, value: Column) -> Column:
    """FN-5, FN-7: struct(value, reasons): date, then identifier, then unit rewrites, as the field's name suggests."""
    name = F.lower(field)
    is_date, is_id = name.contains("date"), name.rlike("batch|code|number|_no$|_id$|^id$|key")
    dated = F.when(is_date, F.coalesce(normalise_date(value), value)).otherwise(value)
    named = F.when(is_id, normalise_identifier(dated)).otherwise(dated)
    units = F.regexp_replace(F.regexp_replace(named, r"(?i)\b(kilograms?|kgs)\b", "kg"), r"(?i)\b(litres?|liters?)\b", "L")
    reasons = F.array_compact(F.array(F.when(dated != value, "date"), F.when(named != dated, "identifier"), F.when(units != named, "unit")))
    return F.struct(units.alias("value"), reasons.alias("reasons"))


def placeholder(value: Column, words: list[str], allowed: list[str]) -> Column:
    """FN-6: struct(is_placeholder, allowed)."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    is_ = (v == "") | v.isin([w.lower() for w in words])
    return F.struct(is_.alias("is_placeholder"), (is_ & v.isin([w.lower() for w in allowed])).alias("allowed"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it: a lambda's variable can't be inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _step(state: Column, change: Callable[[Column], Column], tag: str) -> Column:
    """struct(text, tags) after a change of the text; the tag is added where it changed something."""
    changed = lambda s: lambda after: F.struct(after.alias("text"), F.when(after != s["text"], F.array_append(s["tags"], F.lit(tag))).otherwise(s["tags"]).alias("tags"))
    return let(state, lambda s: let(change(s["text"]), changed(s)))


def sanitise(text: Column, repairs: list[tuple[str, str, str]]) -> Column:
    """FN-17: ordered (tag, pattern, replacement) repairs, folded over the text; struct(text, tags of those that changed something)."""
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("tags"))
    for tag, pattern, to in repairs:
        state = _step(state, lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, to), tag)
    return state


def repair_severity(tags: Column, heavy: list[str], middle: list[str], weights=(40, 18, 8)) -> Column:
    """FN-18: struct(score, level) of repair tags; every other tag weighs least; at most 100.

    Any heavy tag, or 55 and more, is high; any middle one, or 25 and more, medium.
    """
    lit = lambda x: F.array(*map(F.lit, x))
    h, m = F.size(F.array_intersect(tags, lit(heavy))), F.size(F.array_intersect(tags, lit(middle)))
    score = F.least(F.lit(100), h * weights[0] + m * weights[1] + (F.size(tags) - h - m) * weights[2])
    return F.struct(score.alias("score"), F.when((h > 0) | (score >= 55), "high").when((m > 0) | (score >= 25), "medium").when(score > 0, "low").otherwise("none").alias("level"))


def edit_criticality(before: Column, after: Column) -> Column:
    """FN-19: how grave a correction is: from or to nothing, or between dates, critical; up to two edits minor; else major."""
    date = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"
    b, a = F.trim(F.coalesce(before, F.lit(""))), F.trim(F.coalesce(after, F.lit("")))
    return (
        F.when((b == "") != (a == ""), "critical")
        .when(b.rlike(date) & a.rlike(date) & (b != a), "critical")
        .when(F.levenshtein(b, a) <= 2, "minor")
        .otherwise("major")
    )


def replace_literals(text: Column, rules: list[tuple[str, str]]) -> Column:
    """FN-21: literal replacements, the longest pattern first, folded over the text; struct(text, patterns applied)."""
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("applied"))
    for old, new in sorted(rules, key=lambda r: (-len(r[0]), r[0])):

        def applied(s: Column, old: str = old, new: str = new) -> Column:
            hit = F.contains(s["text"], F.lit(old))
            done = F.struct(F.replace(s["text"], F.lit(old), F.lit(new)).alias("text"), F.array_append(s["applied"], F.lit(old)).alias("applied"))
            return F.when(hit, done).otherwise(s)

        state = let(state, _unary(applied))
    return state


def _unary(f: Callable[..., Column]) -> Callable[[Column], Column]:
    return lambda x: f(x)


def page_of(text: Column, first: int = 200) -> Column:
    """FN-24: struct(x, y, confidence) of a page counter "Page X of Y" (1.0) or "X of Y" / "X/Y" (0.7); null if none holds."""
    head = F.substring(text, 1, first)

    def found(pattern: str, confidence: float) -> Column:
        x = F.regexp_extract(head, pattern, 1).try_cast("int")
        y = F.regexp_extract(head, pattern, 2).try_cast("int")
        return F.when((x >= 1) & (x <= y), F.struct(x.alias("x"), y.alias("y"), F.lit(confidence).alias("confidence")))

    return F.coalesce(found(r"(?i)page\s+([0-9]{1,4})\s+of\s+([0-9]{1,4})", 1.0), found(r"(?i)([0-9]{1,4})\s*(?:of|/)\s*([0-9]{1,4})", 0.7))


def component_page(component: Column) -> Column:
    """FN-52: the page of a component id such as p12-table-3."""
    digits = F.regexp_extract(component, r"^p([0-9]+)-", 1)
    return F.when(digits != "", digits.cast("int"))


def redact(text: Column, patterns: dict[str, str]) -> Column:
    """FN-51: matches of each pattern become [name]."""
    for name, pattern in patterns.items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def shorten(text: Column, most: int, mark: str = "...") -> Column:
    """FN-31, FN-51: at most `most` characters, with a mark where some were cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def cleanup(text: Column) -> Column:
    """FN-44: check-box glyphs become [x] and [ ], runs of blanks and of blank lines fold."""
    t = F.regexp_replace(F.regexp_replace(text, "[☑☒]", "[x]"), "☐", "[ ]")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))


def cell_kind(text: Column) -> Column:
    """FN-34: what a table cell holds: empty, filler (dashes, dots, n/a), date or text."""
    t = fold_spaces(F.regexp_replace(F.coalesce(text, F.lit("")), "[*_`|]+", " "))
    return (
        F.when(t == "", "empty")
        .when(F.lower(t).rlike(r"^([-.–—/ ]+|n/?a|nil|none)$"), "filler")
        .when(t.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"), "date")
        .otherwise("text")
    )


def line_kind(line: Column) -> Column:
    """FN-22: struct(text, heading, emphasised) of a Markdown line without its marks."""
    heading, bold = line.rlike(r"^\s{0,3}#{1,6}\s"), line.rlike(r"^\s*\*\*.+\*\*\s*$")
    bare = F.regexp_replace(F.regexp_replace(line, r"^\s{0,3}#{1,6}\s+", ""), r"\*\*", "")
    return F.struct(fold_spaces(bare).alias("text"), heading.alias("heading"), (heading | bold).alias("emphasised"))


# What a page's dates and quantities look like.
_DATE = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"
_QUANTITY = r"(?i)(?:qty|quantity|weight|volume)[:\s]*(-?[\d,.]+)\s*(?:kg|g|ml|l|mg)\b"


def validated(page: Column, year: int) -> Column:
    """FN-9: struct(checked, passed, failures) of three checks of a page's text: dates from 2000 to the year after
    `year` (two digits below 50 are 20xx), quantities from 0 to a million, over 20 characters.

    failures: rule and value (the year, the quantity, the length), in that order. A null page is empty.
    """
    text = F.coalesce(page, F.lit(""))
    century = lambda y: F.when(F.length(y) > 2, 0).when(y.cast("int") < 50, 2000).otherwise(1900)
    years = F.transform(F.regexp_extract_all(text, F.lit(_DATE), F.lit(3)), lambda y: (y.cast("int") + century(y)).cast("double"))
    amounts = F.transform(F.regexp_extract_all(text, F.lit(_QUANTITY), F.lit(1)), lambda q: F.replace(q, F.lit(","), F.lit("")).try_cast("double"))
    length = F.length(F.btrim(text, F.lit(" \t\r\n\f\x0b"))).cast("double")
    checks = (
        ("date", F.filter(years, lambda y: (y < 2000) | (y > year + 1))),
        ("quantity", F.filter(amounts, lambda q: (q < 0) | (q > 1_000_000))),
        ("length", F.filter(F.array(length), lambda n: n <= 20)),
    )
    failed = [F.transform(bad, lambda x, r=rule: F.struct(F.lit(r).alias("rule"), x.alias("value"))) for rule, bad in checks]
    passed = sum((F.when(F.size(bad) == 0, 1).otherwise(0) for _, bad in checks), F.lit(0))
    return F.struct(F.lit(3).alias("checked"), passed.alias("passed"), F.concat(*failed).alias("failures"))


# Lines of a page that say nothing about its section.
_NO_HEADER = r"^(format no|printed by|printed on|this document is electronically issued)"
_COUNTER = r"(?i)\bpage\s+(\d+)\s+of\s+(\d+)\b"
_LINES = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def plain_line(line: Column) -> Column:
    """WIN-3: a line without tags, Markdown marks and anything but letters, digits and :/.-, in lower case, spaces folded."""
    bare = F.regexp_replace(F.regexp_replace(line, "<[^>]+>", " "), "[^A-Za-z0-9:/.-]+", " ")
    return F.lower(F.trim(bare))


def packet_page(text: Column) -> Column:
    """WIN-3: struct(x, y, lines, tokens, heading) of a page: its counter "page x of y", its first three header lines of
    the first 24 (without counters and printers' notes), their words of over two letters, and its first "#" line of 20."""
    raw = F.split(F.coalesce(text, F.lit("")), _LINES)
    lines = F.slice(F.filter(F.transform(F.slice(raw, 1, 24), plain_line), lambda x: (x != "") & ~x.rlike(_NO_HEADER) & ~x.rlike(_COUNTER)), 1, 3)
    tokens = F.filter(F.array_distinct(F.flatten(F.transform(lines, lambda x: F.split(x, " ")))), lambda x: F.length(x) > 2)
    number = lambda n: F.regexp_extract(F.coalesce(text, F.lit("")), _COUNTER, n).try_cast("int")
    heading = F.get(F.filter(F.transform(F.slice(raw, 1, 20), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("#"))), F.lit(0))
    return F.struct(number(1).alias("x"), number(2).alias("y"), lines.alias("lines"), tokens.alias("tokens"), F.nullif(plain_line(heading), F.lit("")).alias("heading"))


def normalised_record(key: Column, value: Column, words: list[str], allowed: list[str]) -> Column:
    """FN-7: struct(key, value, reasons, is_placeholder, allowed) of a key-value pair: its key as a slug (FN-2), its value
    as the key suggests (FN-5), and whether that is a placeholder (FN-6)."""
    v = normalise_field(key, value)
    p = placeholder(v["value"], words, allowed)
    return F.struct(slug(key).alias("key"), v["value"].alias("value"), v["reasons"].alias("reasons"), p["is_placeholder"].alias("is_placeholder"), p["allowed"].alias("allowed"))
