"""Log sources: defaults, order, broken lines, and the claims of a trace."""

import json

from kairoscope.sources import logs


def test_chat_turns(spark, tmp_path):
    lines = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "session_id": "s2"}, {"role": "user", "content": "c"}, {"role": "user", "content": "d", "turn_index": 9, "project_id": "p9"}]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\n\nno json\n")
    got = logs.chat_turns(spark, str(tmp_path / "x.jsonl"), source_agent="me").collect()
    assert {(r.content, r.project_id, r.session_id, r.turn_index, r.source_agent) for r in got if r._corrupt is None} == {("a", "cli", "chat-ingest-0", 0, "me"), ("b", "cli", "s2", 1, "me"), ("c", "cli", "chat-ingest-2", 2, "me"), ("d", "p9", "chat-ingest-3", 9, "me")}
    assert [(r._corrupt, r.turn_index) for r in got if r._corrupt] == [("no json", None)]
    (tmp_path / "x.json").write_text(json.dumps(lines, indent=1))
    assert {(r.content, r.project_id, r.session_id, r.turn_index) for r in logs.chat_turns(spark, str(tmp_path / "x.json"), "p", "s", array=True).collect()} == {("a", "p", "s", 0), ("b", "p", "s", 1), ("c", "p", "s", 2), ("d", "p9", "s", 9)}


def test_trace_claims(spark, tmp_path):
    when = "1970-01-01T00:00:02Z"
    rows = [
        {"type": "conversation_relation", "project_id": "p", "session_id": "s", "turn_index": 3, "entity_name": "E", "entity_type": "tool", "content": "t", "captured_at": when},
        {"type": "research_claim", "project_id": "p", "source_key": "k", "content_hash": "h", "subject": "A", "predicate": "USES", "object": "B", "object_kind": "tool", "content": "c", "captured_at": when},
        {"type": "research_relation", "project_id": "p", "source_key": "k", "content_hash": "h", "source_kind": "research_chunk", "entity_name": "E", "entity_type": "tool", "predicate": "ABOUT", "content": "c", "captured_at": when},
        {"type": "query", "query_id": "q", "query": "what", "project_id": "p"},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    trace = logs.read_trace(spark, str(tmp_path / "t.jsonl"))
    assert trace.count() == 4
    assert {tuple(r) for r in logs.trace_claims(trace).collect()} == {
        ("p", "conversation_turn", "s:3", "MENTIONS", "tool", "E", 2_000_000, "conversation_turn", "s:3", "t"),
        ("p", "unknown", "A", "USES", "tool", "B", 2_000_000, "research_finding", "k:h", "c"),
        ("p", "research_chunk", "k:h", "ABOUT", "tool", "E", 2_000_000, "research_chunk", "k:h", "c"),
    }
