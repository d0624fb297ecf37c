"""Answers as events: their order, errors, and that a restart repeats nothing."""

from __future__ import annotations

import json

import pytest

from quern.operators import retrieval
from quern.streaming import answers


def parts(messages):
    """A reply in parts, made of the question; ``!`` breaks off after the second part, ``?`` before the first."""
    q = messages[-1]["content"]
    for k in range(4):
        if q == "?" or (q == "!" and k == 2):
            raise OSError("gone")
        yield f"{q} {k} " if k != 1 else ""


def prepare(question, history):
    if question == "none":
        return None
    if question == "broken":
        raise ValueError("no route")
    return ["a", "b"], [*history, {"role": "user", "content": question}]


def of(spark, target, question):
    return [(r["type"], json.loads(r["data"])) for r in answers.read_events(spark, target).filter(f"question_id = '{question}'").orderBy("seq").collect()]


def ask(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"question_id": i, "question": q, "history": "[]"}) for i, q in rows))


def test_events_come_in_order(spark, tmp_path):
    target, run = str(tmp_path / "out"), lambda: answers.answer_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), prepare, parts)
    ask(tmp_path / "in", "1", [("q1", "hello"), ("q2", "!"), ("q3", "?"), ("q4", "none"), ("q5", "broken")])
    run()
    sources, failed, done = ("sources", {"files": ["a", "b"]}), ("error", {"text": answers.FAILED}), ("done", {})
    text = lambda t: ("text", {"text": t})
    assert of(spark, target, "q1") == [sources, text("hello 0 "), text("hello 2 "), text("hello 3 "), done]
    assert of(spark, target, "q2") == [sources, text("! 0 "), failed, done]
    assert of(spark, target, "q3") == [sources, failed, done]
    assert of(spark, target, "q4") == [("error", {"text": answers.NO_ARTICLES})]
    assert of(spark, target, "q5") == [failed, done]
    n = answers.read_events(spark, target).count()
    run()  # nothing new
    ask(tmp_path / "in", "2", [("q6", "later")])
    run()
    assert answers.read_events(spark, target).count() == n + 5 and len(of(spark, target, "q1")) == 5
    assert not list((tmp_path / "out" / "pending").iterdir())


def test_a_batch_that_died_is_answered_once(spark, tmp_path, monkeypatch):
    target, calls = str(tmp_path / "out"), spark.sparkContext.accumulator(0)

    def counted(messages):
        calls.add(1)
        yield from parts(messages)

    run = lambda: answers.answer_stream(spark, str(tmp_path / "in"), target, str(tmp_path / "checkpoint"), prepare, counted)
    ask(tmp_path / "in", "1", [("q1", "hello")])
    with monkeypatch.context() as m:
        m.setattr(answers, "answer_events", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            run()
    assert answers.read_events(spark, target).isEmpty()
    run()
    assert len(of(spark, target, "q1")) == 5 and calls.value == 1


def test_a_batch_counts_once_whatever_is_written_again(spark, tmp_path):
    spark.dataSource.register(answers.AnswerEvents)
    rows = spark.createDataFrame([("q", k, "text", json.dumps({"text": str(k)})) for k in range(50)], answers.EVENT)
    write = lambda df: df.coalesce(1).write.format("answer_events").mode("append").option("path", str(tmp_path)).option("batch", "7").save()
    write(rows)
    write(rows.limit(3))
    got = answers.read_events(spark, str(tmp_path)).collect()
    assert [r["seq"] for r in got] == list(range(50)) and not list((tmp_path / "pending").iterdir())
    (tmp_path / "events" / "batch=7" / "_DONE").unlink()  # as if the commit had died before its last step
    assert answers.read_events(spark, str(tmp_path)).isEmpty()
    write(rows)
    assert answers.read_events(spark, str(tmp_path)).count() == 50


def test_the_sink_takes_a_stream(spark, tmp_path):
    spark.dataSource.register(answers.AnswerEvents)
    prepared = spark.createDataFrame([(f"q{k}", ["a"], json.dumps([{"role": "user", "content": "x"}]), None) for k in range(3)], answers.PREPARED)
    prepared.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(answers.PREPARED).json(str(tmp_path / "in"))
    query = answers.answer_events(stream, parts).writeStream.format("answer_events").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    for _ in range(2):
        query.trigger(availableNow=True).start().awaitTermination()
    assert answers.read_events(spark, str(tmp_path / "out")).groupBy("type").count().orderBy("type").collect() == [("done", 3), ("sources", 3), ("text", 9)]


def test_parts_of_one_answer(spark):
    articles = spark.createDataFrame([("a.md", "Alpha"), ("_index.md", "x")], "name string, content string")
    nodes = spark.createDataFrame([], "id bigint, label string, name string, aliases array<string>, props map<string,string>, ord bigint")
    edges = spark.createDataFrame([], "id bigint, src bigint, dst bigint, rel string, props map<string,string>, ord bigint")
    get = lambda a, call: list(retrieval.answer_parts("Was?", a, nodes, edges, call, lambda m: iter(["x", "", "y"])))
    assert get(articles, lambda m: "a.md") == [("sources", {"files": ["a"]}), ("text", {"text": "x"}), ("text", {"text": "y"}), ("done", {})]
    assert get(articles.filter("name = '_index.md'"), lambda m: "a.md") == [("error", {"text": answers.NO_ARTICLES})]
    assert [k for k, _ in get(articles, lambda m: 1 / 0)] == ["error", "done"]
    assert answers.server_sent({"type": "text", "data": '{"text": "ä"}'}) == 'data: {"type": "text", "text": "ä"}\n\n'
