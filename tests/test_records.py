import json

from pyspark.sql import functions as F

from tidemill.sources import records as src


def episode(task, trial, values, **more):
    base = {"task_id": task, "trial": trial, "status": "done", "termination": "agent_stop", "verdict": {"success": True, "db_match": True, "values": values}}
    return base | more


def test_records(spark, tmp_path):
    calls = [{"name": "find_customer", "ok": True, "agent_call": 1}, {"name": "get_order", "ok": False, "agent_call": 1}]
    llm = [{"who": "agent", "index": 1, "format_error": "unbacked_claim"}, {"who": "agent", "index": 5, "format_error": "unbacked_claim"}, {"who": "agent", "index": 3, "format_error": "empty"}, {"who": "user", "index": 2, "format_error": "unbacked_claim"}]
    rows = [
        episode("a", 0, {}, tool_calls=calls, llm_calls=llm, voice=[{"said": "x", "heard": "y"}]),
        episode("a", 1, {"total": False, "date": True}),
        episode("b", 0, {"total": True}, termination="cut_off"),
        episode("b", 1, {}, status="infra_error", verdict=None),
    ]
    run = tmp_path / "run-1"
    run.mkdir()
    (run / "episodes.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    df = src.episodes(spark, str(run))
    assert df.count() == 4 and {r.run_id for r in df.collect()} == {"run-1"} and src.judged(df).count() == 3
    assert {(r.task_id, r.trial): r.success for r in src.with_success(df).collect()} == {("a", 0): True, ("a", 1): False, ("b", 0): False, ("b", 1): False}
    assert [(r.task_id, r.trial, r.missed) for r in src.missed_values(df).collect()] == [("a", 1, ["total"])]
    assert [(r.said, r.heard) for r in src.utterances(df).collect()] == [("x", "y")]
    assert {r.task_id: r.share for r in src.identified(df).collect()} == {"a": 0.5, "b": 0.0}
    assert src.fired(df).filter("trial = 0 AND task_id = 'a'").first().fired == ["retry"]
    assert [(r["index"], r["next"]) for r in src.after_held_claims(df).orderBy("index").collect()] == [(1, "reply"), (5, "end")]
    out = str(tmp_path / "out" / "run-2")
    src.append(df.drop("run_id"), out)
    src.append(df.drop("run_id"), out)
    assert src.episodes(spark, out).count() == 8
    assert src.copy_once(df, str(tmp_path / "t")) and not src.copy_once(df, str(tmp_path / "t"))


def test_manifests_tell_test_runs(spark, tmp_path):
    for run, text in {"r1": {"run_id": "one", "tasks_file": "tasks/dev.yaml", "task_sha256": {"dev-1": "x"}, "config": {"errors": "E1"}}, "r2": {"tasks_file": "C:\\\\tasks\\\\my-test.yaml"}, "r3": {"task_sha256": {"test-1": "y"}}, "r4": {"tasks_file": "tests/dev.yaml"}}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "manifest.json").write_text(json.dumps(text, indent=1))
    m = src.manifests(spark, f"{tmp_path}/*/manifest.json")
    found = {r.run_id: r.t for r in m.select("run_id", src.is_test_run(F.col("tasks_file"), F.col("task_sha256")).alias("t")).collect()}
    assert found == {"one": False, "r2": True, "r3": True, "r4": False}
    assert m.filter("run_id = 'one'").first().config == {"errors": "E1"}
