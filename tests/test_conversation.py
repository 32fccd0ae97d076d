import random

from pyspark.sql import functions as F

from tidemill.operators import conversation as op
from tidemill.streaming.sessions import sessions

ROWS = [
    (1, 0, "assistant", "hello"),
    (1, 1, "user", "a"),
    (1, 2, "assistant", "same  text"),
    (1, 3, "user", "b"),
    (1, 4, "assistant", "same text"),
    (1, 5, "assistant", "same text "),
    (2, 0, "user", "a"),
    (2, 1, "assistant", " "),
    (2, 2, "user", None),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_replies_exchanges_and_divergence(spark):
    m = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted((r.conv_id, r.turn) for r in op.delivered(m, F.col("text") == "hello").collect()) == [(1, 2), (1, 4), (1, 5)]
    assert [(r.conv_id, r.loops) for r in op.loops(m.filter("role = 'assistant' AND trim(text) <> ''")).collect()] == [(1, True)]
    e = {(r.conv_id, r.exchange): (r.said, r.reply, r.answer) for r in op.exchanges(m).collect()}
    assert e[1, 1] == ("a", "same  text", "b") and e[1, 2] == ("b", "same text ", None) and e[2, 1] == ("a", " ", None)
    pairs = spark.createDataFrame([(1, 2), (1, 1)], "a long, b long")
    assert [tuple(r) for r in op.first_divergence(pairs, m, m).collect()] == [(1, 2, 0, "assistant")]
    seen = {(r.conv_id, r.turn): r.n for r in op.visible_before(m, F.length("text"), "n").collect()}
    assert seen[1, 0] == 0 and seen[1, 2] == 6 and seen[2, 2] == 2


def test_fold_ends_at_its_limits(spark):
    m = spark.createDataFrame(ROWS + [(3, k, "user", "x") for k in range(25)] + [(4, k, "assistant", "{\"name\": \"t\", \"arguments\": {}}") for k in range(9)], SCHEMA)
    found = {r.conv_id: r for r in op.fold(op.events(m)).collect()}
    one = found[1]  # the second 'same text' of a turn is held once, then delivered
    assert (one.customer_turns, one.calls, one.replies, one.repeats, one.ended) == (2, 4, 3, 1, "answered")
    assert (found[2].replies, found[2].formats, found[2].ended) == (0, 1, "open")
    assert (found[3].customer_turns, found[3].ended) == (20, "max_user_turns")
    assert (found[4].calls, found[4].formats, found[4].ended) == (3, 3, "agent_format_error")


def test_fold_is_the_step_again_and_again(spark):
    rng = random.Random(13)
    kinds = ["user", "reply", "reply", "reply", "format", "claim", "stall", "error", "other"]
    rows = [(c, t, "user" if (k := rng.choice(kinds)) == "user" else "tool" if k in ("error", "other") else "assistant", k, rng.randrange(3)) for c in range(200) for t in range(rng.randint(1, 60))]
    limits = op.Limits(turns=9, calls=25, errors=5)
    found = {r.conv_id: r.asDict() for r in op.fold(spark.createDataFrame(rows, "conv_id long, turn long, role string, kind string, said long"), limits).collect()}
    states = {}
    for c, _, role, kind, said in rows:
        op.step(states.setdefault(c, op.new_state()), role, kind, said, limits)
    assert found == {c: {"conv_id": c} | op.outcome(s) for c, s in states.items()}
    assert {"max_user_turns", "max_agent_calls", "agent_format_error", "unbacked_claim", "tool_errors", "answered", "open"} <= {r["ended"] for r in found.values()}


def test_stalls_and_leaked_calls(spark):
    texts = {"확인해 보겠습니다.": "stall", "잠시만 기다려 주세요": "stall", "확인해 보겠습니다. 번호를 알려 주세요": "reply", "처리해 드리겠습니다?": "reply", "<tool_call>": "format", "": "format", "hello": "reply"}
    df = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], SCHEMA)
    assert [r.kind for r in op.events(df).orderBy("turn").collect()] == list(texts.values())


def test_stream_and_batch_agree(spark, tmp_path):
    parts = [[r for r in ROWS if r[1] < 3], [r for r in ROWS if r[1] >= 3]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    q = sessions(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.conv_id: (r.customer_turns, r.replies, r.ended) for r in spark.table("folded").collect()}
    batch = {r.conv_id: (r.customer_turns, r.replies, r.ended) for r in op.fold(op.events(spark.createDataFrame(ROWS, SCHEMA))).collect()}
    assert last[2] == batch[2] and last[1][:2] == batch[1][:2]
