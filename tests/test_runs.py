"""Runs, tasks and chains of lost frames against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import runs, tasks as op
from tidemill.operators.state import fingerprint
from tidemill.sources import records, tasks as src


def test_summary_of_records(spark, tmp_path):
    call = {"who": "agent", "wall_ms": 10.0, "prompt_eval_ms": 2.0, "prompt_tokens": 7, "load_ms": 1.0, "dropped_calls": 1}
    verdict = {"success": True, "unexpected_writes": 2, "policy_violations": ["late"], "policy_blocks": [], "auth_blocks": 1, "db_match": True, "values": {}}
    rows = [
        {"task_id": "a", "status": "completed", "termination": "agent_stop", "wall_seconds": 3.0, "verdict": verdict, "llm_calls": [call, call | {"format_error": "repeat", "prompt_tokens": 0}, {"who": "user", "wall_ms": 5.0}]},
        {"task_id": "a", "status": "truncated", "termination": "cut_off", "wall_seconds": 4.0, "verdict": None, "llm_calls": [call | {"format_error": "empty"}]},
        {"task_id": "b", "status": "infra_error", "termination": "infra", "wall_seconds": 99.0, "llm_calls": [call]},
    ]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "episodes.jsonl").write_text("\n".join(map(json.dumps, rows)))
    r = runs.summary(records.episodes(spark, str(tmp_path / "r"))).first().asDict()
    expected = {"run_id": "r", "episodes": 3, "infra_errors": 1, "truncated": 1, "successes": 1, "successes_with_unexpected_writes": 1, "unexpected_writes": 2, "policy_violations": 1, "policy_blocks": 0}
    expected |= {"auth_blocks": 1, "format_errors": 1, "held_claims": 0, "held_repeats": 1, "confirmation_requests": 0, "dropped_calls": 3, "seconds_per_episode": 3.5, "agent_calls_per_episode": 1.5}
    expected |= {"agent_call_ms": 10.0, "agent_prompt_eval_ms": 2.0, "agent_prompt_tokens_max": 7, "agent_calls_without_prompt_tokens": 1, "user_call_ms": 5.0, "model_load_ms_total": 3.0}
    expected |= {"terminations": ["agent_stop=1", "cut_off=1", "infra=1"], "by_task": ["a=1/2"], "tasks_without_valid_trials": ["b"]}
    assert r == expected
    g = runs.guard_statistics(records.episodes(spark, str(tmp_path / "r"))).first()
    assert (g.violations, g.held_repeats, g.held_stalls, g.replies, g.seconds, g.get_order_ms) == (1, 1, 0, 0, 3.5, 0.0)
    s = runs.simulator_counts(records.episodes(spark, str(tmp_path / "r")), 100).first()
    assert (s.utterances, s.format_utterances, s.max_prompt_tokens) == (1, 0, 0)


def test_lost_frames_are_those_of_the_chain(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.random()) for k in range(30) for i in range(rng.randint(1, 300))]
    enter, leave = 0.02 * 0.2 / 0.98, 0.2
    expected, bad = {}, False
    for k, i, u in rows:
        bad = u < 0.02 if i == 0 else u < (1 - leave if bad else enter)
        expected[k, i] = bad
    found = runs.lost_frames(spark.createDataFrame(rows, "k long, i long, u double").repartition(3), "k", "i", "u", 0.02, 5)
    assert {(r.k, r.i): r.lost for r in found.collect()} == expected and any(expected.values())
    with pytest.raises(ValueError):
        runs.lost_frames(found, "k", "i", "lost", 0.9, 1)


def test_markdown_keeps_cells_in_place(spark):
    df = spark.createDataFrame([("b", "x|y"), ("a", None), ("c", "1\n2")], "run string, note string")
    lines = [r.line for r in runs.markdown(df, "run").orderBy("place").collect()]
    assert lines == ["| run | note |", "|---|---|", "| a | - |", r"| b | x\|y |", "| c | 1 2 |"]


TASKS = [
    {"id": "t1", "type": "action", "customer_id": "1", "user": {"reason": "r", "known": "k"}, "gold_actions": [{"tool": "cancel_order", "args": {"order_id": "10"}}, {"tool": "cancel_order", "args": {"order_id": "10"}}]},
    {"id": "t2", "type": "action", "customer_id": "1", "user": {"reason": "2026-09-02", "known": "k"}, "gold_actions": [{"tool": "cancel_order", "args": {"order_id": "10"}}], "required_values": [{"label": "day", "kind": "date", "value": "2026-09-02"}]},
    {"id": "t3", "type": "refusal", "customer_id": "9", "user": {"reason": "CJ", "known": "k"}, "required_values": [{"label": "by", "kind": "text", "value": "C J"}]},
    {"id": "t3", "type": "lookup", "customer_id": "2", "user": {"reason": "r", "known": "k", "script": ["a", "b ##", " "]}, "injection": "coupon"},
]


def test_tasks_are_read_and_checked(spark, tmp_path):
    (tmp_path / "dev.json").write_text("\ufeff" + json.dumps(TASKS))
    t = src.tasks(spark, str(tmp_path / "dev.json"))
    assert t.count() == 4 and {r.file for r in t.collect()} == {"dev.json"}
    assert sorted((r.id, r.problem) for r in op.shape_problems(t).collect()) == [
        ("t3", "injection_values"), ("t3", "no_forbidden_action"), ("t3", "no_required_value"), ("t3", "repeated_id"), ("t3", "script_has_end_mark"), ("t3", "script_lines"),
    ]
    customers = spark.createDataFrame([("1",), ("2",)], "customer_id string")
    orders = spark.createDataFrame([("10", 500), ("11", 0)], "order_id string, discount int")
    found = sorted((r.id, r.problem) for r in op.setting_problems(t, customers, orders).collect())
    assert found == [("t1", "discount:10"), ("t2", "discount:10"), ("t2", "given_away:day"), ("t3", "given_away:by"), ("t3", "unknown_customer")]
    state = spark.createDataFrame([(10, 1, "O"), (11, 2, "O")], "o long, c long, s string")
    replay = op.gold_replay(t, state, "o", "c", "s", "O")
    assert sorted((r.id, r.place, r.code) for r in replay.collect()) == [("t1", 0, None), ("t1", 1, "not_cancellable"), ("t2", 0, None)]
    hashes = {r.id: (r.problems, r.hash) for r in op.gold_hashes(t.filter("id <> 't3'"), replay, state, "o", {"s": F.lit("C")}, ["o", "c", "s"]).collect()}
    after = spark.createDataFrame([(10, 1, "C"), (11, 2, "O")], state.schema)
    assert hashes == {"t1": (1, None), "t2": (0, fingerprint("x", after, ["o", "c", "s"]).first().hash)}
