"""RUL-7: whole banks in one pass, held against a plain loop over rules and rows."""

import random
import re

import pytest

from ledgerlens.plans import dsl

FIELDS = "doc_id string, page int, ordinal int, field string, entity string, value string"
NUMBER = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*")


def number(x):
    return float(x) if x is not None and NUMBER.fullmatch(x) else None


def compared(s, t, kind, tol):
    if s is None or t is None:
        return "indeterminate"
    base = {"percent": max(abs(s), abs(t)), "relative": abs(t)}.get(kind, 1.0)
    if base == 0:
        return "indeterminate"
    good = s == t if kind is None else abs(s - t) <= (tol if kind == "absolute" else base * (tol / 100 if kind == "percent" else tol))
    return "pass" if good else "open"


def key(strategy, e):
    if e is None:
        return None
    if strategy == "exact":
        return e
    if strategy == "normalise":
        return " ".join(e.lower().split()) or None
    if strategy == "batch_id":
        return re.sub(r"\s+", "", e).upper() or None
    m = re.search("[0-9]+", e)
    return re.sub("^0+(?=.)", "", m[0]) if m else None


def plain(bank, fields, pages):
    out = []
    for r in bank:
        own = [f for f in fields if f[3] == r.source_field]
        if r.scope == "same_page":
            good = {(f[0], f[1]) for f in own if f[5] is not None and f[5].strip(" ")}
            out += [(r.id, r.severity, *p, "open") for p in pages if p not in good] or ([] if pages else [(r.id, r.severity, None, None, "unevaluated")])
        elif r.scope == "page_aggregate":
            for d in {f[0] for f in own}:
                values = [f[5] for f in own if f[0] == d]
                wanted = sorted((f[1], f[2], f[5]) for f in fields if f[3] == r.target_field and f[0] == d)
                expected = number(wanted[0][2]) if wanted else None
                numbers = [number(v) for v in values]
                if expected is None or r.aggregation != "count" and None in numbers:
                    status = "unevaluated"
                else:
                    actual = {"count": lambda: sum(v is not None for v in values), "sum": lambda: sum(numbers), "min": lambda: min(numbers), "max": lambda: max(numbers), "avg": lambda: sum(numbers) / len(numbers)}[r.aggregation]()
                    status = compared(float(actual), expected, r.tol_kind, r.tolerance)
                out.append((r.id, r.severity, d, None, status))
        elif r.scope == "cross_document":
            targets = [f for f in fields if f[3] == r.target_field]
            for f in own:
                k = key(r.strategy, f[4])
                met = sorted(((t[1], t[2], t[0]), t[5]) for t in targets if k is not None and key(r.strategy, t[4]) == k)
                if not met:
                    statuses = [{"flag_as_unevaluated": "unevaluated", "flag_as_indeterminate": "indeterminate", "treat_as_pass": "pass"}[r.fallback]]
                elif r.multiplicity == "error" and len(met) > 1:
                    statuses = ["indeterminate"]
                else:
                    statuses = [compared(number(f[5]), number(v), r.tol_kind, r.tolerance) for _, v in (met if r.multiplicity == "all" else met[:1])]
                out += [(r.id, r.severity, f[0], f[1], s) for s in statuses]
    ranks = ["observation", "info", "minor", "major", "critical"]
    for r in (r for level in dsl.levels(bank) for r in level):
        groups = {}
        by = r.group_by or ("doc_id",)
        for f in out:
            if f[0] in r.parts:
                groups.setdefault((f[2] if "doc_id" in by else None, f[3] if "page" in by else None), []).append(f)
        for g, fs in groups.items():
            has = {f[4] for f in fs}
            status = "open" if "open" in has else "indeterminate" if "indeterminate" in has else "unevaluated" if "unevaluated" in has and "pass" not in has else "pass"
            out.append((r.id, max([r.severity, *(f[1] for f in fs)], key=ranks.index), *g, status))
    return sorted(out, key=str)


def some_bank(rnd, n):
    names, bank = [f"f{i}" for i in range(6)], []
    for i in range(n):
        scope = rnd.choice(["same_page", "page_aggregate", "cross_document"])
        kind = rnd.choice([None, "absolute", "percent", "relative"])
        bank.append(
            dsl.Rule(
                f"r{i}", "1.0", scope, rnd.choice(["info", "minor", "critical"]), rnd.choice(names), rnd.choice(names), rnd.choice(dsl.STRATEGIES), rnd.choice(dsl.AGGREGATIONS), kind,
                rnd.choice([1.0, 5.0]) if kind else 0.0, rnd.choice(dsl.MULTIPLICITIES), rnd.choice(["flag_as_unevaluated", "flag_as_indeterminate", "treat_as_pass"]),
            )
        )
    ids = [r.id for r in bank]
    for i in range(n // 5):
        s = dsl.Rule(f"s{i}", "1.0", "synthesis", rnd.choice(["info", "major"]), parts=tuple(rnd.sample(ids, k=min(3, len(ids)))), group_by=rnd.choice([(), ("doc_id", "page"), ("page",)]))
        bank.append(s)
        ids.append(s.id)
    return bank


def some_fields(rnd, docs=4, each=14):
    out = []
    for d in range(docs):
        for o in range(each):
            entity = rnd.choice([None, "Lot 07", " lot  07", "LOT07", "step 7", "B1", ""])
            out.append((f"d{d}", rnd.randint(1, 4), o, f"f{rnd.randint(0, 5)}", entity, rnd.choice([None, "", "1", "2.5", "-3", "7", "x", " 4 "])))
    return out


def frames(spark, fields, pages):
    return {"fields": spark.createDataFrame(fields, FIELDS), "pages": spark.createDataFrame(pages, "doc_id string, page int")}


def found(df):
    return sorted((tuple(r) for r in df.select("rule_id", "severity", "doc_id", "page", "status").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_bank_of_200_rules(spark, seed):
    rnd = random.Random(seed)
    bank, fields = some_bank(rnd, 200), some_fields(rnd)
    pages = sorted({(f[0], f[1]) for f in fields} | {("d9", 1)})
    want = plain(bank, fields, pages)
    assert found(dsl.evaluate(bank, frames(spark, fields, pages))) == want and {x[4] for x in want} == {"open", "pass", "indeterminate", "unevaluated"}
    assert found(dsl.evaluate(bank, frames(spark, [], []))) == plain(bank, [], [])


def scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") + df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


def test_scans_do_not_follow_the_rules(spark, tmp_path):
    rnd = random.Random(3)
    fields = some_fields(rnd)
    tables = {n: (t.write.parquet(str(tmp_path / n)), spark.read.parquet(str(tmp_path / n)))[1] for n, t in frames(spark, fields, [("d0", 1)]).items()}
    for scope in ("same_page", "page_aggregate", "cross_document"):
        bank = [r for r in some_bank(rnd, 700) if r.scope == scope][:200]
        bank = [dsl.Rule(**{**r.__dict__, "multiplicity": "first"}) for r in bank]
        assert len(bank) == 200 and scans(dsl.evaluate(bank, tables)) == scans(dsl.evaluate(bank[:2], tables)) <= 4
        plan = dsl.evaluate(bank, tables)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_levels():
    a, b = (dsl.Rule(x, "1.0", "synthesis", parts=(y,)) for x, y in (("a", "b"), ("b", "leaf")))
    assert [[r.id for r in level] for level in dsl.levels([a, b])] == [["b"], ["a"]]
    with pytest.raises(ValueError, match="made of each other"):
        dsl.levels([a, dsl.Rule("b", "1.0", "synthesis", parts=("a",))])
