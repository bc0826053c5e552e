"""Transcripts, clippings, archives and scopes."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators.scope import ANCHORED, Scope, plan
from corvane.sources import transcripts as T


def lines(*entries):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries)


def test_chat_dialect(spark):
    talk = lines(
        {"type": "user", "sessionId": "s1", "cwd": "/w", "timestamp": "t1", "message": {"content": " hi<system-reminder>x\ny</system-reminder> "}},
        "not json", "", {"type": "summary"}, {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "assistant", "timestamp": "t2", "message": {"content": [{"type": "thinking", "thinking": "z"}, {"type": "tool_use", "id": 1}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "r"}]}}, {"type": "user", "message": {"content": "<observed_from_primary_session> echo"}},
        {"type": "assistant", "timestamp": "t3", "message": {"content": [{"type": "tool_use", "id": 2}, {"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}},
        {"type": "assistant", "timestamp": "t4", "message": {"content": [{"type": "text", "text": "[3]"}]}}, {"type": "user", "timestamp": "t5", "message": {"content": "[1, 2]"}},
    )
    silent = lines({"type": "assistant", "message": {"content": [{"type": "text", "text": "alone"}]}})
    got = T.chat_turns(spark.createDataFrame([("a", talk), ("b", silent), ("c", "")], "path string, value string")).orderBy("path", "turn").collect()
    assert [(r.turn, r.speaker, r.text, r.omitted) for r in got] == [(0, "owner", "hi", 0), (1, "assistant", "one\ntwo", 2), (2, "assistant", "[3]", 0), (3, "owner", "[1, 2]", 0)]
    assert {(r.path, r.session_id, r.cwd) for r in got} == {("a", "s1", "/w")} and got[3].at == "t5"


def test_rollout_dialect(spark):
    item = lambda **p: {"type": "response_item", "timestamp": "t", "payload": p}
    talk = lines(
        {"type": "session_meta", "payload": {"id": "s2", "cwd": "/x"}}, item(type="message", role="developer", content=[{"type": "input_text", "text": "rules"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "<environment_context>e</environment_context> do it"}]), item(type="reasoning"), item(type="function_call"), item(type="web_search_call"),
        item(type="message", role="assistant", content=[{"type": "output_text", "text": "done"}]), {"type": "event", "payload": 3},
    )
    got = T.rollout_turns(spark.createDataFrame([("a", talk)], "path string, value string")).orderBy("turn").collect()
    assert [(r.session_id, r.cwd, r.speaker, r.text, r.omitted) for r in got] == [("s2", "/x", "owner", "do it", 0), ("s2", "/x", "assistant", "done", 2)]


def test_files_clippings_and_archives(spark, tmp_path):
    for root, text in (("live", "abc"), ("old", "abc"), ("old2", "abcd")):
        (tmp_path / root).mkdir()
        (tmp_path / root / "s.jsonl").write_text(text)
    files = T.read_files(spark, f"{tmp_path}/*/")
    assert [r.value for r in T.larger_files(files, ["/old/", "/live/"]).collect()] == ["abcd"]
    assert "/live/" in T.larger_files(files.where("value = 'abc'"), ["/old/", "/live/"]).first().path
    clips = spark.createDataFrame([("a.json", '{"url": "u", "n": 1}'), ("b.json", "{broken"), ("c.txt", "  "), ("d.json", '{"note": " "}'), ("e.json", "[1]")], "path string, value string")
    got = {r.path: (r.url, r.note) for r in T.clippings(clips).collect()}
    assert got == {"a.json": ("u", None), "b.json": (None, "{broken"), "e.json": (None, "[1]")}
    a = T.archives(spark.createDataFrame([("x", json.dumps({"format": "f", "source_key": "k", "messages": [{"id": "1", "text": "t"}, {"id": None, "text": "u"}]})), ("y", "{oops")], "path string, value string"))
    assert [(r.source_key, r.ordinal, r.text) for r in T.archive_messages(a).orderBy("ordinal").collect()] == [("k", 0, "t"), ("k", 1, "u")]
    assert [r.path for r in a.where("a.broken is not null").collect()] == ["y"]


def test_scope(spark):
    rows = spark.createDataFrame([("node", None, None, "2024-01-01 00:00:00.000001"), ("evidence", "0a" * 4 + "-0000-0000-0000-" + "0" * 12, "user", "2024-01-01 00:00:00"), ("evidence", "x", "tool", None)], "layer string, source_id string, role string, at string").withColumn("at", F.col("at").cast("timestamp"))
    n = lambda **k: Scope.of(**k).apply(rows).count()
    assert (n(), n(layer="nodes"), n(role="user"), n(source_id=("0A" * 4 + "-0000-0000-0000-" + "0" * 12)), n(until="2024-01-01T01:00:00+01:00"), n(start="2024-01-01T00:00:00.000001Z")) == (3, 1, 1, 1, 1, 1)
    for bad in ({"layer": "x"}, {"layer": "nodes", "role": "user"}, {"source_id": "nope"}, {"start": "2024-01-01"}, {"start": "2024-01-01T00:00:00.0000001Z"}, {"start": "2024-01-01T00:00:00.000002Z", "until": "2024-01-01T00:00:00.000001Z"}):
        with pytest.raises(ValueError):
            Scope.of(**bad)
    assert plan(False) [0] == "exact_lookup" and plan(True) == ANCHORED and plan(False, -1) == []
