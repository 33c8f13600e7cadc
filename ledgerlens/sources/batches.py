"""Requests to batch services of language models: JSON lines, written in shards and read on from the last one (section 2.11).

`requests` is a Python data source. Each task writes shards of its own and tells the driver their names; only when all
tasks are through does the driver list the shards in a manifest. What a failed or repeated task has written is in no
manifest, so no request is sent twice. As a stream it gives the shards listed since the checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Lines of a shard: what a service takes as one file.
LINES = 50_000
#: Keys of a JSON schema that strict services refuse.
REFUSED = ("title", "default", "examples", "$defs")
SCHEMA = "custom_id string, line string, shard string"


# ---------------------------------------------------------------- lines
def strict(schema: dict) -> dict:
    """A JSON schema without references and refused keys, its objects closed and all of their properties required."""
    named = schema.get("$defs") or {}

    def plain(x):
        if isinstance(x, list):
            return [plain(y) for y in x]
        if not isinstance(x, dict):
            return x
        if "$ref" in x:
            of = x["$ref"].rpartition("/")[2]
            return plain(named[of]) if of in named else x
        out = {k: plain(v) for k, v in x.items() if k not in REFUSED}
        if out.get("type") == "object":
            out = {"additionalProperties": False} | out
            if out.get("properties"):
                out["required"] = list(out["properties"])
        return out

    return plain(schema)


def request_lines(requests: DataFrame, model: str, temperature: float = 0.1, schema: dict | None = None, name: str = "answer", url: str = "/v1/chat/completions") -> DataFrame:
    """custom_id and line: a JSON line for each request. requests: custom_id, messages (array of role, content)."""
    body = F.to_json(F.struct(F.lit(model).alias("model"), "messages", F.lit(temperature).alias("temperature")))
    if schema is not None:
        form = {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": strict(schema)}}
        body = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(f', "response_format": {json.dumps(form)}}}'))
    head = F.to_json(F.struct(F.col("custom_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url")))
    return requests.select(F.col("custom_id").cast("string").alias("custom_id"), F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"body":'), body, F.lit("}")).alias("line"))


def results(lines: DataFrame, line: str = "value") -> DataFrame:
    """custom_id, status_code, content, error and malformed of a batch service's result lines.

    content is the first choice's text; an error has status 500 and no content; a line that can't be read has nothing
    but malformed. Blank lines are left out. Nothing else is dropped, and repeated ids come as often as they are.
    """
    kind = "custom_id string, error string, response struct<status_code: int, body: struct<choices: array<struct<message: struct<content: string>>>>>"
    got = F.from_json(line, kind)
    bad = got.isNull() | got["custom_id"].isNull()
    failed = got["error"].isNotNull()
    out = lines.where(F.trim(F.col(line)) != "")
    return out.select(
        got["custom_id"].alias("custom_id"), F.when(bad, None).when(failed, 500).otherwise(F.coalesce(got["response"]["status_code"], F.lit(500))).alias("status_code"),
        F.when(~failed, F.get(got["response"]["body"]["choices"], F.lit(0))["message"]["content"]).alias("content"), got["error"].alias("error"), bad.alias("malformed"),
    )


def answered(requests: DataFrame, got: DataFrame) -> DataFrame:
    """Every request once, with status_code, content and error; those without a readable result have the error "no result"."""
    best = got.where("NOT malformed").groupBy("custom_id").agg(F.min_by(F.struct("status_code", "content", "error"), F.struct("status_code", "content", "error")).alias("r"))
    out = requests.select(F.col("custom_id").cast("string").alias("custom_id")).distinct().join(best, "custom_id", "left")
    return out.select("custom_id", "r.status_code", "r.content", F.when(F.col("r").isNull(), "no result").otherwise(F.col("r.error")).alias("error"))


# ---------------------------------------------------------------- the data source
@dataclass
class Written(WriterCommitMessage):
    """The shards of one task, and how many lines each has."""

    shards: list[tuple[str, int]]


@dataclass
class Shard(InputPartition):
    """A shard to read."""

    name: str


def _store(path: str):
    """A file system of any store that Arrow knows, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[tuple[int, str]]:
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    return sorted((int(f.base_name.removesuffix(".json")), f.path) for f in found if f.base_name.endswith(".json"))


def shards(path: str) -> list[str]:
    """The names of all shards that count, in the order in which they were listed."""
    store, _ = _store(path)
    out = []
    for _, p in _manifests(path):
        with store.open_input_stream(p) as f:
            out += [name for name, _ in json.loads(f.read())["shards"]]
    return out


class _Writer(DataSourceWriter):
    def __init__(self, path: str, lines: int, overwrite: bool) -> None:
        self.path, self.lines, self.overwrite = path, lines, overwrite

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/shards", recursive=True)
        done, out, n, name = [], None, 0, ""
        try:
            for row in iterator:
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.jsonl", 0
                    out = store.open_output_stream(f"{root}/shards/{name}")
                out.write((row["line"] + "\n").encode())
                n += 1
                if n >= self.lines:
                    out.close()
                    done.append((name, n))
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written([*done, (name, n)] if out is not None else done)

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the tasks' shards in a manifest, which appears as a whole or not at all."""
        store, root = _store(self.path)
        store.create_dir(f"{root}/manifests", recursive=True)
        before = _manifests(self.path)
        listed = sorted(s for m in messages if m is not None for s in m.shards)
        number = before[-1][0] + 1 if before else 0
        name = f"{root}/manifests/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(name) as f:
            f.write(json.dumps({"shards": listed}).encode())
        if self.overwrite:
            for _, p in before:
                store.delete_file(p)
        store.move(name, f"{root}/manifests/{number:09d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for name, _ in (s for m in messages if m is not None for s in m.shards):
            store.delete_file(f"{root}/shards/{name}")


def _read(path: str, shard: str) -> Iterator[tuple[str, str, str]]:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/shards/{shard}") as f:
        rest = b""
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield json.loads(line)["custom_id"], line.decode(), shard


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Shard]:
        return [Shard(s) for s in shards(self.path)] or [Shard("")]

    def read(self, partition: Shard) -> Iterator[tuple[str, str, str]]:
        return _read(self.path, partition.name) if partition.name else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets count shards, so a restarted query goes on after the last shard that its checkpoint has."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"shards": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"shards": len(shards(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(s) for s in shards(self.path)[start["shards"] : end["shards"]]]

    def read(self, partition: Shard) -> Iterator[tuple[str, str, str]]:
        return _read(self.path, partition.name)

    def commit(self, end: dict) -> None:
        pass


class RequestShards(DataSource):
    """Options: path, and lines (of a shard). Rows: custom_id, line, and, when read, shard."""

    @classmethod
    def name(cls) -> str:
        return "request_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("lines", LINES)), overwrite)


def write_requests(lines: DataFrame, path: str, shard_lines: int = LINES, mode: str = "append") -> None:
    """Writes request_lines() as shards; several of one id count once, so a file has no id twice."""
    lines.sparkSession.dataSource.register(RequestShards)
    one = lines.groupBy("custom_id").agg(F.min("line").alias("line"))
    one.select("custom_id", "line", F.lit(None).cast("string").alias("shard")).write.format("request_shards").option("path", path).option("lines", shard_lines).mode(mode).save()


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """custom_id, line and shard of all shards that count."""
    spark.dataSource.register(RequestShards)
    return spark.read.format("request_shards").option("path", path).load()


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream, a shard at a time and each once."""
    spark.dataSource.register(RequestShards)
    return spark.readStream.format("request_shards").option("path", path).load()


def sent(submitted: Column) -> Column:
    """Whether a batch job has ended, by its status."""
    return submitted.isin("completed", "failed", "expired", "cancelled")
