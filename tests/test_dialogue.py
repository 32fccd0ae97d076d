"""Invented values, values never heard, keys of calls, the consent gate and its exchanges, on small made-up conversations."""

import json

from pyspark.sql import functions as F

from tidemill.operators import confirm, invented


def test_values_from_nowhere_and_told_too_late(spark):
    said = [
        (1, 1, "I am Kim, 010-2345-9101, order O-91001."),
        (1, 3, "58,300원 right? ###STOP###"),
        (2, 1, "It was O-91999 and 61,000원, 61,000."),
        (3, 1, "Is it 58,300원?"),
        (4, 3, "I ordered on 9월 11일 for 58,300원, number ends in 9101; mail a.b@x.org"),
        (5, 1, "Today is 9월 14일, 2026, item 12"),
        (6, 1, None),
        (7, 1, "number 345"),
    ]
    told = [
        (1, -1, "Kim, phone 01023459101, order O-91001"),
        (1, 2, "The refund is 58,300원."),
        (3, 1, "The refund is 58,300원."),
        (3, 2, "The refund is 58,300원."),
        (4, 2, json.dumps({"ordered_at": "2026-09-11T10:20:00+09:00", "total_won": 58300, "phone": "010-0000-9101"})),
        (5, -1, "today: 2026-09-14"),
        (8, -1, "91999 61000"),
    ]
    found = invented.invented(spark.createDataFrame(said, "conv int, at int, text string"), spark.createDataFrame(told, "conv int, at int, text string"))
    assert {(r.conv, r.at): r.missing for r in found.collect()} == {(2, 1): ["num:61000", "num:91999"], (3, 1): ["num:58300"], (4, 3): ["email:a.b@x.org"]}


def test_parts_of_longer_numbers_count_by_windows(spark):
    said = spark.createDataFrame([(1, 5, "12345"), (1, 5, "3456 9999"), (1, 1, "3456")], "conv int, at int, text string")
    told = spark.createDataFrame([(1, 2, "0123456"), (1, 3, "x" * 50 + "7" * 3000), (2, 0, "9999")], "conv int, at int, text string")
    assert sorted((r.at, r.missing) for r in invented.invented(said, told).collect()) == [(1, ["num:3456"]), (5, ["num:9999"])]


def test_ends(spark):
    episodes = [(1, False, "user_stop", 1, 1), (2, False, "user_stop", 1, 0), (3, False, "max_turns", 0, 1), (4, True, "user_stop", 1, 1), (5, False, "user_stop", 0, 0)]
    values = [(1, "number", "500"), (1, "number", "70"), (2, "number", "500"), (3, "number", "9"), (4, "number", "9")]
    texts = [(1, "it is 500"), (1, "or 700"), (2, "1"), (2, "500원"), (3, "none"), (5, "x")]
    found = invented.ends(
        spark.createDataFrame(episodes, "conv int, infra boolean, termination string, gold int, missing_writes int"), spark.createDataFrame(values, "conv int, kind string, value string"), spark.createDataFrame(texts, "conv int, text string")
    )
    assert sorted(map(tuple, found.collect())) == [(1, True, True, True), (2, False, False, False), (3, True, False, None), (4, None, None, None), (5, None, None, None)]


def test_equal_calls_have_equal_keys(spark):
    calls = [
        ("request_return", '{"order_id": "O-1", "line_nos": [2, 1]}', 1),
        ("request_return", '{ "line_nos":[1,2], "order_id":"O-1", "note": null}', 1),
        ("request_return", '{"order_id": "O-1", "line_nos": [1]}', 2),
        ("create_ticket", '{"category": "x", "body": "one"}', 3),
        ("create_ticket", '{"body": "two", "category": "x"}', 3),
        ("transfer_to_human", '{"reason": "a", "summary": "b"}', 4),
        ("transfer_to_human", "{}", 4),
        ("cancel_order", '{"order_id": "O-1", "reason": "a"}', 5),
        ("cancel_order", '{"order_id": "O-1", "reason": "b"}', 6),
    ]
    found = spark.createDataFrame(calls, "tool string, args string, same int").select("same", confirm.call_key(F.col("tool"), F.col("args")).alias("key")).distinct().collect()
    assert sorted(r.same for r in found) == [1, 2, 3, 4, 5, 6] and len({r.key for r in found}) == 6


def test_the_gate_asks_first_and_runs_once(spark):
    def outcomes(*calls):
        df = spark.createDataFrame([(1, k, turn, key, yes, ok) for k, (turn, key, yes, ok) in enumerate(calls)], "conv int, at int, turn long, key string, consent boolean, ok boolean")
        return [r.outcome for r in confirm.gate(df).orderBy("at").collect()]

    assert outcomes((1, "a", True, True), (2, "a", True, True), (2, "a", True, True), (3, "a", True, True)) == ["preview", "ran", "preview", "ran"]
    assert outcomes((1, "a", False, True), (2, "a", False, True), (4, "a", True, True)) == ["preview", "preview", "preview"]
    assert outcomes((1, "a", False, True), (1, "b", False, True), (2, "b", True, True), (2, "a", True, True)) == ["preview", "preview", "ran", "ran"]
    assert outcomes((1, "a", False, False), (2, "a", True, True), (3, "a", True, False), (4, "a", True, True)) == ["refused", "preview", "refused", "preview"]
    assert outcomes((1, "a", None, True), (2, "a", None, True)) == ["preview", "preview"]


def test_exchanges(spark):
    show = lambda order, **won: f"{confirm.PREVIEW}: ask\n" + json.dumps({"tool": "cancel_order", "arguments": {"order_id": order}, "preview": won})
    rows = [
        ("user", "취소해 주세요", None), ("assistant", "one moment", None), ("tool", show("O-1", refund_won=38900, return_fee_won=0), "cancel_order"), ("tool", show("O-1", refund_won=38900), "cancel_order"), ("assistant", "38,900원을 환불할까요?", None),
        ("user", "네, 진행해 주세요", None), ("tool", '{"order_id": "O-1"}', "cancel_order"), ("tool", "Error: [x] y", "cancel_order"), ("tool", "{}", "get_order"), ("tool", show("O-2", refund_won=5), "cancel_order"), ("assistant", "6원", None),
        ("user", "아니요", None), ("tool", show("O-3"), "cancel_order"),
    ]
    m = spark.createDataFrame([(1, k, *r, True, False, False) for k, r in enumerate(rows)], "conv int, at int, role string, content string, tool string, delivered boolean, harness boolean, calls boolean")
    found = confirm.exchanges(m).orderBy("turn").collect()
    assert [(r.turn, r.previews, r.repeats, r.amounts, r.said_amounts, r.kind, r.ran) for r in found] == [(1, 2, 1, [38900, 38900], True, "consent", 1), (2, 1, 0, [5], False, "refusal", 0), (3, 1, 0, [], None, "none", 0)]
    assert [r.reply for r in found] == ["38,900원을 환불할까요?", "6원", None]
    s = confirm.statistics(confirm.exchanges(m)).first()
    assert (s.exchanges, s.consent, s.refusal, s.none, s.repeats, s.consent_unrun, s.amounts_said, s.with_amounts) == (3, 1, 1, 1, 1, 0, 1, 2)


def test_episodes_tell_what_a_simulated_customer_could_know(spark, tmp_path):
    from tidemill.sources import records

    def episode(task, turns, **more):
        """Turns of (agent's message, tool results before it was sent, customer's answer)."""
        messages, heard, calls = [], [], [{"who": "agent", "index": 0, "text": "91999"}]
        for k, (agent, results, answer) in enumerate(turns):
            messages += [{"role": "tool", "content": r} for r in results] + [{"role": "assistant", "content": agent}]
            messages += [{"role": "user", "content": "note 77777", "harness": True}] if k == 1 else []
            heard += [{"role": "user", "content": agent}, {"role": "assistant", "content": answer}]
            messages.append({"role": "user", "content": answer})
            calls.append({"who": "user", "index": 2 * k + 1, "text": answer})
        return {"task_id": task, "trial": 0, "status": "done", "messages": messages, "user_messages": heard, "llm_calls": calls[::-1]} | more

    rows = [
        episode("known", [("hello", [], "order O-91001"), ("it is 58,300원", [], "58,300원? ###STOP###")]),
        episode("made-up", [("hello", [], "order O-91999 of 61,000원"), ("well", [], "###STOP###")]),
        episode("too-early", [("hello", [], "is it 58,300원?"), ("58,300원", [], "thanks")]),
        episode("result", [("hello", [], "what is it?"), ("I see", ['{"total_won": 58300}'], "58,300원?")]),
        episode("late-result", [("hello", [], "58,300원?"), ("I see", ['{"total_won": 58300}'], "77777?")]),
        episode("broken", [("hello", [], "88888")], status="infra_error"),
    ]
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "episodes.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    prompts = spark.createDataFrame([("known", "your order is O-91001"), ("other", "91999")], "task_id string, text string")
    said, texts = records.simulated(records.episodes(spark, str(tmp_path / "run")), prompts)
    missing = invented.invented(said, texts).join(said, ["conv", "at"])
    assert {(r.conv.split("/")[1], r["index"]): r.missing for r in missing.collect()} == {("made-up", 1): ["num:61000", "num:91999"], ("too-early", 1): ["num:58300"], ("late-result", 1): ["num:58300"], ("late-result", 3): ["num:77777"]}
