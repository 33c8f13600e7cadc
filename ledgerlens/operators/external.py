"""Ports to OCR engines and language or vision models, called from partitions.

A port is any callable from a list of request dicts to a list of answer dicts.
Failures become rows with an error instead of failing the job, answers are
matched to requests by id, and what a port leaves out is filled in.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Port = Callable[[list[dict]], list[dict]]


def _ask(port: Port, ids: list, bodies: list, size: int, tries: int, retry_size: int) -> pd.DataFrame:
    """answer and error of some requests, in their order."""
    requests = [{"id": i, **json.loads(b or "{}")} for i, b in zip(ids, bodies, strict=True)]
    answers: dict[str, str] = {}
    errors: dict[str, str] = {}
    left = requests
    for attempt in range(tries + 1):
        n = size if not attempt else retry_size
        for i in range(0, len(left), n):
            batch = left[i : i + n]
            asked = {r["id"] for r in batch}
            try:
                for a in port(batch):
                    if a.get("id") in asked:
                        answers[a["id"]] = json.dumps(a, sort_keys=True)
            except Exception as e:  # noqa: BLE001  a port's failure is data
                errors |= dict.fromkeys(asked, f"{type(e).__name__}: {e}")
        left = [r for r in left if r["id"] not in answers]
        if not left:
            break
    return pd.DataFrame({"answer": [answers.get(i) for i in ids], "error": [None if i in answers else errors.get(i, "skipped") for i in ids]}, dtype=object)


def answered(requests: DataFrame, port: Port, size: int = 15, tries: int = 2, retry_size: int = 3) -> DataFrame:
    """Requests with all their columns, and answer and error as `call` gives them.

    The other columns wait in the JVM, so nothing has to be joined to the answers by their ids. A port isn't
    deterministic, so each request is sent once however often its answer is used.
    """

    def each(ids: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        return _ask(port, ids.tolist(), bodies.tolist(), size, tries, retry_size)

    sent = F.pandas_udf(each, "answer string, error string").asNondeterministic()
    return requests.withColumn("__sent", sent("id", "body")).select(*requests.columns, "__sent.answer", "__sent.error")


def call(requests: DataFrame, port: Port, size: int = 15, tries: int = 2, retry_size: int = 3) -> DataFrame:
    """SRC-10, SRC-11, SRC-14, CLS-8, RUL-11: id, answer (JSON) and error for requests (id string, body JSON string).

    Requests go in batches of `size`; what a batch leaves unanswered is tried again in batches of retry_size, and then
    has the error "skipped" or the port's own. Each request has exactly one row in the result.
    """

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield _ask(port, df["id"].tolist(), df["body"].tolist(), size, tries, retry_size).assign(id=df["id"].tolist())[["id", "answer", "error"]]

    return requests.select("id", "body").mapInPandas(each, "id string, answer string, error string")


def split_results(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-13: successes and failures; nothing is dropped."""
    return answers.where("error IS NULL"), answers.where("error IS NOT NULL")


def backfill(requested: DataFrame, evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """RUL-14: a status for every requested rule; those without an answer are "error"."""
    return requested.join(evaluations, keys, "left").withColumn("status", F.coalesce("status", F.lit("error")))


def infer_from_checks(checks: DataFrame, keys: list[str]) -> DataFrame:
    """RUL-15: the first failing check decides; no answer at all is uncertain; no checks not_applicable.

    checks: ordinal, outcome (pass, fail or null); a row with ordinal null stands for a rule without checks."""
    failing = F.min(F.when(F.col("outcome") == "fail", F.col("ordinal")))
    return checks.groupBy(*keys).agg(
        F.when(F.count("ordinal") == 0, "not_applicable").when(failing.isNotNull(), "non_compliant").when(F.count("outcome") == 0, "uncertain").otherwise("compliant").alias("status"),
        failing.alias("decided_by"),
    )


def discoveries(found: DataFrame, known: DataFrame, factor: float = 0.85) -> DataFrame:
    """RUL-18: discovered rules whose description (trimmed, case-blind) isn't known, less sure by a factor."""
    d = lambda df: F.lower(F.trim(F.col("description")))
    old = known.select(d(known).alias("__d")).distinct()
    return found.withColumn("__d", d(found)).join(old, "__d", "left_anti").drop("__d").withColumn("confidence", F.col("confidence") * factor)
