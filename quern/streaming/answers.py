"""Answers as events: what a chat client reads while a model writes, kept so that a restart repeats nothing.

An answer is ``sources``, then ``text`` as often as the model hands out a part, then ``done``. A question of a view without articles is one ``error``. A
failure is ``error`` and ``done`` after what was said before it. Events of a conversation's question are numbered from 0.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from quern.sources.pdf import file_system

EVENT = "question_id string, seq bigint, type string, data string"
PREPARED = "question_id string, sources array<string>, messages string, trouble string"
#: What a client is told.
NO_ARTICLES, FAILED = "Keine Wiki-Artikel für diese Sicht verfügbar.", "Error generating response."


def events_of(sources: list[str] | None, messages: list[dict], trouble: str | None, call: Callable[[list[dict]], Iterator[str]]) -> Iterator[tuple[str, dict]]:
    """(type, data) of one answer. ``sources`` None: there is nothing to answer from; ``trouble``: preparing failed. Empty parts are no events."""
    if trouble is not None:
        yield "error", {"text": FAILED}
        yield "done", {}
        return
    if sources is None:
        yield "error", {"text": NO_ARTICLES}
        return
    yield "sources", {"files": sources}
    try:
        for part in call(messages):
            if part:
                yield "text", {"text": part}
    except Exception:  # noqa: BLE001  the client is told that it failed, not why
        yield "error", {"text": FAILED}
    yield "done", {}


def answer_events(prepared: DataFrame, call: Callable[[list[dict]], Iterator[str]]) -> DataFrame:
    """Events (question_id, seq, type, data as JSON) of questions as in PREPARED; works on streams too.

    ``call(messages)`` yields parts; wrap it by ``provider.retrying_stream`` to try again what fails before its first part. One task writes an
    answer, row after row, as the parts come.
    """

    def run(batches):
        import pyarrow as pa

        names = [c.split(" ")[0] for c in EVENT.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                parts = events_of(row["sources"], json.loads(row["messages"] or "[]"), row["trouble"], call)
                for seq, (kind, data) in enumerate(parts):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (row["question_id"], seq, kind, json.dumps(data, ensure_ascii=False)), strict=True))], pa.schema([("question_id", pa.string()), ("seq", pa.int64()), ("type", pa.string()), ("data", pa.string())]))

    return prepared.select("question_id", "sources", "messages", "trouble").mapInArrow(run, EVENT)


@dataclass
class Written(WriterCommitMessage):
    """A task's pending file."""

    path: str
    events: int


class _Files:
    """Writing of pending files by tasks, and what makes them count."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def pending(self, rows: Iterator) -> Written:
        system, root = file_system(self.path)
        system.create_dir(f"{root}/pending", recursive=True)
        path, n = f"{root}/pending/{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(path) as f:
            for r in rows:  # as events come: a reader of the pending file sees an answer grow
                f.write((json.dumps({"question_id": r["question_id"], "seq": r["seq"], "type": r["type"], "data": json.loads(r["data"])}, ensure_ascii=False) + "\n").encode())
                f.flush()
                n += 1
        return Written(path, n)

    def take(self, messages: list[Written | None], batch: str) -> None:
        """Let a batch's files count. They are those its first finished attempt left: a batch that counts already drops later ones."""
        from pyarrow import fs

        system, root = file_system(self.path)
        target, mark = f"{root}/events/batch={batch}", f"{root}/events/batch={batch}/_DONE"
        if system.get_file_info(mark).type != fs.FileType.NotFound:
            self.drop(messages)
            return
        system.create_dir(target, recursive=True)
        for old in system.get_file_info(fs.FileSelector(target)):  # of a commit that died
            system.delete_file(old.path)
        for k, m in enumerate(m for m in messages if m and m.events):
            system.copy_file(m.path, f"{target}/part-{k:05d}.jsonl")
        with system.open_output_stream(mark):
            pass
        self.drop(messages)

    def drop(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, _ = file_system(self.path)
        for m in messages:
            if m and system.get_file_info(m.path).type != fs.FileType.NotFound:
                system.delete_file(m.path)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, options):
        self.files = _Files(options)

    def write(self, iterator):
        return self.files.pending(iterator)

    def commit(self, messages, batchId):  # noqa: N803  Spark's name
        self.files.take(messages, str(batchId))

    def abort(self, messages, batchId):  # noqa: N803, ARG002
        self.files.drop(messages)


class _BatchWriter(DataSourceWriter):
    def __init__(self, options):
        self.files, self.batch = _Files(options), options.get("batch") or uuid.uuid4().hex

    def write(self, iterator):
        return self.files.pending(iterator)

    def commit(self, messages):
        self.files.take(messages, self.batch)

    def abort(self, messages):
        self.files.drop(messages)


class AnswerEvents(DataSource):
    """Format ``answer_events``: a sink of events below the option ``path``, for streams and for batches (option ``batch``: its name).

    A batch counts as a whole, once, when its ``_DONE`` is there; one that is run again after it counted leaves what it has. Rows of a task stay in order.
    """

    @classmethod
    def name(cls) -> str:
        return "answer_events"

    def schema(self) -> str:
        return EVENT

    def writer(self, schema, overwrite):  # noqa: ARG002
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite):  # noqa: N802, ARG002  Spark's name
        return _StreamWriter(dict(self.options))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the batches that count: question_id, seq, type, data."""
    from pyarrow import fs

    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/events", recursive=True, allow_not_found=True))
    done = {f.path.rsplit("/", 1)[0] for f in found if f.path.endswith("/_DONE")}
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    paths = [scheme + d for d in sorted(done) if any(f.path.startswith(d + "/part-") for f in found)]
    if not paths:
        return spark.createDataFrame([], EVENT)
    return spark.read.schema("question_id string, seq bigint, type string, data string").option("pathGlobFilter", "part-*.jsonl").json(paths)


def server_sent(row: dict) -> str:
    """An event as a browser reads it."""
    return "data: " + json.dumps({"type": row["type"]} | json.loads(row["data"]), ensure_ascii=False) + "\n\n"


def answer_stream(spark: SparkSession, questions: str, target: str, checkpoint: str, prepare: Callable[[str, list[dict]], tuple[list[str], list[dict]] | None], call: Callable[[list[dict]], Iterator[str]], files_at_once: int = 100) -> None:
    """Answer the questions (JSON lines: question_id, question, history) that arrived since the last run; their events go to ``target``.

    ``prepare(question, history)`` gives sources and messages, as ``retrieval.prepared`` does, or None without articles. A batch holds the questions of
    ``files_at_once`` files at most. A batch that died is answered anew as a whole; one that counts is never asked again.
    """
    spark.dataSource.register(AnswerEvents)
    asked = spark.readStream.schema("question_id string, question string, history string").option("maxFilesPerTrigger", files_at_once).json(questions)

    def take(batch: DataFrame, number: int) -> None:
        rows = []
        for r in batch.collect():  # short texts that people typed
            try:
                got = prepare(r["question"], json.loads(r["history"] or "[]"))
                rows.append((r["question_id"], None if got is None else got[0], json.dumps(got[1] if got else [], ensure_ascii=False), None))
            except Exception as e:  # noqa: BLE001
                rows.append((r["question_id"], [], "[]", f"{type(e).__name__}: {e}"))
        prepared = spark.createDataFrame(rows, PREPARED)
        answer_events(prepared.repartition("question_id"), call).write.format("answer_events").mode("append").option("path", target).option("batch", number).save()

    asked.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
