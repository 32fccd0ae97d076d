"""Runs and tasks: an order is an episode of its priority's run, its lines are calls; a customer has a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import runs as op
from tidemill.operators import tasks as op_tasks
from tidemill.registry import query, table
from tidemill.sources import records
from tidemill.sources import tasks as source

LIMIT = 4000


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the shape of ``records.EPISODE``, as far as the queries read it."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    who = F.when(n % 3 == 0, "user").otherwise("agent")
    error = F.when(k % 11 == 0, "stall").when(k % 11 == 1, "unbacked_claim").when(k % 11 == 2, "repeat").when(k % 11 == 3, "empty")
    said = F.when(k % 5 == 0, "네 감사합니다 ###STOP###").when(k % 5 == 1, "네 ## 그리고").when(k % 5 == 2, "<think>음</think>").when(k % 5 == 3, "漢字です").otherwise("확인해 보겠습니다.")
    llm = F.struct(
        n.cast("long").alias("index"), who.alias("who"), F.when(n == 1, error).alias("format_error"), said.alias("text"), F.when(k % 7 == 0, "length").otherwise("stop").alias("finish_reason"),
        F.when(k % 13 == 0, F.array(F.lit("call"))).otherwise(F.array().cast("array<string>")).alias("tool_calls"), (n - 1).cast("long").alias("dropped_calls"),
        F.when(k % 17 != 0, F.col("l_partkey").cast("long") % 5000).alias("prompt_tokens"), F.col("l_quantity").cast("double").alias("wall_ms"), n.cast("double").alias("prompt_eval_ms"), F.lit(1.0).alias("load_ms"),
    )
    tool = F.struct(
        n.cast("long").alias("index"), F.when(n % 2 == 0, "get_order").otherwise("track_shipment").alias("name"), (F.col("l_returnflag") != "R").alias("ok"),
        F.when(F.col("l_returnflag") == "R", "confirmation_required").alias("error_code"), F.when(n != 4, F.col("l_quantity").cast("double")).alias("ms"),
    )
    message = F.struct(n.cast("long").alias("index"), F.when(n % 2 == 1, "assistant").otherwise("user").alias("role"), said.alias("content"), (F.col("l_linestatus") == "F").alias("delivered"))
    calls = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.sort_array(F.collect_list(x)).alias(name) for x, name in ((llm, "llm_calls"), (tool, "tool_calls"), (message, "messages"))))
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    verdict = F.struct(
        (F.col("o_orderstatus") == "F").alias("success"), (key % 3).cast("long").alias("unexpected_writes"), F.when(key % 4 == 0, F.array(F.lit("late"), F.lit("owner"))).otherwise(F.array().cast("array<string>")).alias("policy_violations"),
        F.when(key % 6 == 0, F.array(F.lit("late"))).alias("policy_blocks"), (key % 2).cast("long").alias("auth_blocks"),
    )
    return o.join(calls, key == F.col("l_orderkey"), "left").select(
        F.col("o_orderpriority").alias("run_id"),
        (F.col("o_custkey") % 40).cast("string").alias("task_id"),
        F.when(F.col("o_custkey") % 40 == 7, "infra_error").when(key % 29 == 0, "infra_error").when(key % 7 == 0, "truncated").otherwise("completed").alias("status"),
        F.when(key % 5 == 0, "customer_stop").when(key % 5 == 1, "unbacked_claim").otherwise("agent_stop").alias("termination"),
        F.when(key % 19 != 0, verdict).alias("verdict"),
        "llm_calls",
        "tool_calls",
        "messages",
        (F.col("o_totalprice") / 1000).alias("wall_seconds"),
    )


_EPISODES = (
    "e AS (SELECT o_orderkey AS k, o_orderpriority AS run_id, (o_custkey % 40)::VARCHAR AS task_id, CASE WHEN o_custkey % 40 = 7 OR o_orderkey % 29 = 0 THEN 'infra_error' WHEN o_orderkey % 7 = 0 THEN 'truncated' ELSE 'completed' END AS status, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'customer_stop' WHEN 1 THEN 'unbacked_claim' ELSE 'agent_stop' END AS termination, o_orderkey % 19 <> 0 AS judged, o_orderkey % 19 <> 0 AND o_orderstatus = 'F' AS success, o_totalprice / 1000 AS seconds FROM orders), "
    "v AS (SELECT * FROM e WHERE status <> 'infra_error'), "
    "c AS (SELECT v.run_id, k, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN 'user' ELSE 'agent' END AS who, CASE WHEN l_linenumber = 1 THEN CASE k % 11 WHEN 0 THEN 'stall' WHEN 1 THEN 'unbacked_claim' WHEN 2 THEN 'repeat' WHEN 3 THEN 'empty' END END AS error, "
    "CASE WHEN k % 17 <> 0 THEN l_partkey % 5000 END AS tokens, l_quantity::DOUBLE AS ms, l_returnflag AS flag, l_linestatus AS line FROM v JOIN lineitem ON l_orderkey = k)"
)
_PER_CALL = (
    "coalesce(count(*) FILTER (who = 'agent' AND error = 'empty'), 0) AS format_errors, count(*) FILTER (who = 'agent' AND error = 'unbacked_claim') AS held_claims, count(*) FILTER (who = 'agent' AND error = 'repeat') AS held_repeats, "
    "count(*) FILTER (flag = 'R') AS confirmation_requests, coalesce(sum(n - 1) FILTER (who = 'agent'), 0)::BIGINT AS dropped_calls, round(avg(ms) FILTER (who = 'agent'), 1) AS agent_call_ms, round(avg(n::DOUBLE) FILTER (who = 'agent'), 1) AS agent_prompt_eval_ms, "
    "coalesce(max(tokens) FILTER (who = 'agent'), 0)::BIGINT AS agent_prompt_tokens_max, count(*) FILTER (who = 'agent' AND coalesce(tokens, 0) = 0) AS agent_calls_without_prompt_tokens, coalesce(round(avg(ms) FILTER (who = 'user'), 1), 0.0) AS user_call_ms, "
    "round(count(*)::DOUBLE, 1) AS model_load_ms_total"
)


@query(
    f"WITH {_EPISODES}, a AS (SELECT run_id, {_PER_CALL} FROM c GROUP BY run_id), "
    "b AS (SELECT run_id, count(*) AS episodes, count(*) FILTER (status = 'infra_error') AS infra_errors, count(*) FILTER (status = 'truncated') AS truncated FROM e GROUP BY run_id), "
    "d AS (SELECT run_id, count(*) FILTER (success) AS successes, count(*) FILTER (success AND k % 3 > 0) AS successes_with_unexpected_writes, coalesce(sum(k % 3) FILTER (judged), 0)::BIGINT AS unexpected_writes, "
    "2 * count(*) FILTER (judged AND k % 4 = 0) AS policy_violations, count(*) FILTER (judged AND k % 6 = 0) AS policy_blocks, coalesce(sum(k % 2) FILTER (judged), 0)::BIGINT AS auth_blocks, round(avg(seconds), 1) AS seconds_per_episode, "
    "round((SELECT count(*) FROM c WHERE c.run_id = v.run_id AND who = 'agent') / count(*), 1) AS agent_calls_per_episode FROM v GROUP BY run_id), "
    "t AS (SELECT run_id, task_id, count(*) FILTER (status <> 'infra_error') AS n, count(*) FILTER (status <> 'infra_error' AND success) AS s FROM e GROUP BY 1, 2), "
    "u AS (SELECT run_id, string_agg(task_id || '=' || s || '/' || n, ' ' ORDER BY task_id || '=' || s || '/' || n) FILTER (n > 0) AS by_task, coalesce(string_agg(task_id, ' ' ORDER BY task_id) FILTER (n = 0), '') AS tasks_without_valid_trials FROM t GROUP BY run_id), "
    "x AS (SELECT run_id, string_agg(w, ' ' ORDER BY w) AS terminations FROM (SELECT run_id, termination || '=' || count(*) AS w FROM e GROUP BY run_id, termination) GROUP BY run_id) "
    "SELECT * FROM b JOIN d USING (run_id) JOIN a USING (run_id) JOIN u USING (run_id) JOIN x USING (run_id)"
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of each run: endings, successes by task, writes, violations, held replies, times of calls."""
    found = op.summary(episodes(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, " ") for c in ("by_task", "tasks_without_valid_trials", "terminations")})


_REPLIES = "r AS (SELECT run_id, k FROM c WHERE n % 2 = 1 AND line = 'F')"


@query(
    f"WITH {_EPISODES}, {_REPLIES}, y AS (SELECT run_id, count(*) AS replies, count(*) FILTER (k % 5 = 4) AS stall_replies, count(*) FILTER (k % 5 = 3) AS other_script FROM r GROUP BY run_id), "
    "b AS (SELECT run_id, coalesce(sum(k % 3) FILTER (judged), 0)::BIGINT AS unexpected_writes, 2 * count(*) FILTER (judged AND k % 4 = 0) AS violations, count(*) FILTER (termination = 'unbacked_claim') AS format_and_claim_endings, round(avg(seconds), 6) AS seconds FROM v GROUP BY run_id), "
    "d AS (SELECT run_id, count(*) FILTER (who = 'agent' AND error = 'unbacked_claim') AS held_claims, count(*) FILTER (who = 'agent' AND error = 'stall') AS held_stalls, count(*) FILTER (who = 'agent' AND error = 'repeat') AS held_repeats, "
    "count(*) FILTER (n % 2 = 0) AS get_order_calls, count(*) FILTER (n % 2 = 0 AND flag <> 'R') AS get_order_ok, count(*) FILTER (n % 2 = 1) AS track_shipment_calls, count(*) FILTER (n % 2 = 1 AND flag <> 'R') AS track_shipment_ok, "
    "round(avg(ms) FILTER (who = 'agent'), 6) AS agent_ms, round(avg(tokens) FILTER (who = 'agent'), 6) AS prompt_tokens, round(avg(ms) FILTER (n % 2 = 0 AND n <> 4), 6) AS get_order_ms FROM c GROUP BY run_id) "
    "SELECT * FROM b JOIN d USING (run_id) JOIN y USING (run_id)"
)
def guard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guards of each run did and what they let through."""
    return op.guard_statistics(episodes(spark, sf_dir))


@query(
    f"WITH {_EPISODES} SELECT run_id, count(*) AS utterances, count(*) FILTER (k % 5 = 3) AS other_language, count(*) FILTER (k % 5 = 2 OR k % 7 = 0 OR k % 13 = 0 OR k % 5 = 1) AS format_utterances, "
    "count(*) FILTER (k % 5 = 2) AS think_tag, count(*) FILTER (k % 7 = 0) AS cut_off, count(*) FILTER (k % 13 = 0) AS tool_call, count(*) FILTER (k % 5 = 1) AS broken_end, "
    f"coalesce(max(tokens), 0)::BIGINT AS max_prompt_tokens, count(*) FILTER (tokens > 0.95 * {LIMIT}) AS prompts_over_limit FROM c WHERE who = 'user' GROUP BY run_id"
)
def simulator_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the simulated customer of each run: scripts, problems of form, prompts near the limit."""
    return op.simulator_counts(episodes(spark, sf_dir), LIMIT)


@query(
    "WITH r AS (SELECT o_orderpriority AS run, count(*) AS orders, max(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END) AS status FROM orders GROUP BY 1) "
    "SELECT 1::BIGINT AS place, '| run | orders | status |' AS line UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY run) + 2, '| ' || run || ' | ' || orders || ' | ' || coalesce(status, '-') || ' |' FROM r"
)
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table as lines of Markdown."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"))
    return op.markdown(o.agg(F.count("*").alias("orders"), F.max(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus"))).alias("status")), "run")


_DRAW = "('0x' || substr(md5(p_partkey || ':' || frame), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(
    f"WITH RECURSIVE d AS (SELECT p_partkey, frame, {_DRAW} AS u FROM (SELECT p_partkey, unnest(range(0, 40 + p_size)) AS frame FROM part)), "
    "r AS (SELECT p_partkey, frame, u < 0.1 AS lost FROM d WHERE frame = 0 UNION ALL SELECT d.p_partkey, d.frame, d.u < CASE WHEN r.lost THEN 0.8 ELSE 0.1 * 0.2 / 0.9 END FROM r JOIN d ON d.p_partkey = r.p_partkey AND d.frame = r.frame + 1) "
    "SELECT p_partkey, count(*) AS frames, count(*) FILTER (lost) AS lost, min(frame) FILTER (lost) AS first FROM r GROUP BY p_partkey"
)
def lost_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a chain of good and bad states loses: how many of each utterance, and the first."""
    frames = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_size").cast("long") + 39)).alias("frame"))
    digest = F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), F.col("frame").cast("string")))
    draws = frames.withColumn("draw", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)))
    lost = op.lost_frames(draws, "p_partkey", "frame", "draw", rate=0.1, burst=5)
    return lost.groupBy("p_partkey").agg(F.count("*").alias("frames"), F.count_if("lost").alias("lost"), F.min(F.when(F.col("lost"), F.col("frame"))).alias("first"))


@query("SELECT c_mktsegment || '-' || c_nationkey AS run_id, bool_or(c_custkey % 97 = 3) OR c_nationkey % 5 = 0 AS test FROM customer GROUP BY c_mktsegment, c_nationkey")
def held_back_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which manifests are of held-back tasks."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 97 == 3, "test-").otherwise("dev-test-"), F.col("c_custkey").cast("string"))
    runs = c.groupBy("c_mktsegment", "c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(name, F.lit("hash")))).alias("tasks"))
    file = F.concat(F.lit("tests/"), F.when(F.col("c_nationkey") % 5 == 0, "my-test.v2").otherwise("dev"), F.lit(".yaml"))
    return runs.select(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("run_id"), records.is_test_run(file, F.col("tasks")).alias("test"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each customer in the shape of ``source.TASK``: cancels the customer's first and second order, twice the
    first in some tasks, and tells an amount."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))
    k = F.col("c_custkey")
    args = lambda c: F.to_json(F.struct(F.col(c).cast("string").alias("order_id")))
    act = lambda c: F.struct(F.lit("cancel_order").alias("tool"), args(c).alias("args"))
    none = F.array().cast(source.TASK["gold_actions"].dataType)
    actions = F.when(F.col("least").isNull() | (k % 6 == 5), none).when(k % 4 == 0, F.array(act("least"), act("least"))).otherwise(F.array(act("least"), act("most")))
    user = F.struct(
        F.lit("plain").alias("persona"), F.lit("cancel").alias("reason"), F.when(k % 5 == 0, F.format_number(k + 70000, 0)).when(k % 5 == 1, F.concat(F.lit("O-"), (k + 70000).cast("string"))).otherwise("nothing").alias("known"),
        F.lit(None).cast("string").alias("unknown"), F.lit(None).cast("string").alias("rules"), F.when(k % 10 == 9, F.array(F.lit("a"), F.lit("b ##"), F.lit("c"))).when(k % 10 == 8, F.array(F.lit("a"))).alias("script"),
    )
    value = F.struct(F.lit("total").alias("label"), F.lit("number").alias("kind"), (k + 70000).cast("string").alias("value"))
    return table(spark, sf_dir, "customer").join(first, k == F.col("o_custkey"), "left").select(
        F.concat(F.lit("dev-"), F.when(k % 50 == 49, k - 1).otherwise(k).cast("string")).alias("id"),
        F.when(k % 6 == 5, "lookup").when(k % 6 == 4, "refusal").otherwise("action").alias("type"),
        F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("customer_id"),
        user.alias("user"),
        actions.alias("gold_actions"),
        (k % 9 != 0).alias("gold_verified"),
        none.alias("forbidden_actions"),
        F.when(k % 3 == 0, F.array().cast(source.TASK["required_values"].dataType)).otherwise(F.array(value)).alias("required_values"),
        F.when(k % 10 == 9, "coupon").alias("injection"),
    )


_TASKS = (
    "f AS (SELECT o_custkey, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders GROUP BY 1), "
    "t AS (SELECT c_custkey AS k, 'dev-' || CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 ELSE c_custkey END AS id, CASE c_custkey % 6 WHEN 5 THEN 'lookup' WHEN 4 THEN 'refusal' ELSE 'action' END AS type, least, most, "
    "least IS NOT NULL AND c_custkey % 6 <> 5 AS gold, c_custkey % 3 <> 0 AS tells FROM customer LEFT JOIN f ON o_custkey = c_custkey)"
)


@query(
    f"WITH {_TASKS} SELECT id, 'no_required_value' AS problem FROM t WHERE type IN ('lookup', 'refusal') AND NOT tells UNION ALL SELECT id, 'no_forbidden_action' FROM t WHERE type = 'refusal' "
    "UNION ALL SELECT id, 'no_gold_action' FROM t WHERE type = 'action' AND NOT gold UNION ALL SELECT id, 'script_without_injection' FROM t WHERE k % 10 = 8 "
    "UNION ALL SELECT id, unnest(CASE WHEN type <> 'lookup' THEN ['injection_is_no_lookup', 'script_has_end_mark'] ELSE ['script_has_end_mark'] END) FROM t WHERE k % 10 = 9 UNION ALL SELECT id, 'injection_values' FROM t WHERE k % 10 = 9 AND NOT tells "
    "UNION ALL SELECT id, 'repeated_id' FROM t GROUP BY id HAVING count(*) > 1"
)
def task_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on their own form that tasks break."""
    return op_tasks.shape_problems(tasks(spark, sf_dir))


@query(
    f"WITH {_TASKS}, o AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), "
    "a AS (SELECT id, least AS key FROM t WHERE gold UNION ALL SELECT id, most FROM t WHERE gold AND k % 4 <> 0 AND most <> least) "
    "SELECT id, 'unknown_customer' AS problem FROM t WHERE k % 7 = 0 UNION ALL SELECT id, 'given_away:total' FROM t WHERE tells AND k % 5 = 0 UNION ALL SELECT id, 'discount:' || key FROM a WHERE key IN (SELECT o_orderkey FROM o)"
)
def task_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tasks get wrong about customers, orders and the texts that their customers know."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 5).otherwise(0).alias("discount"))
    return op_tasks.setting_problems(tasks(spark, sf_dir), c, o)


_ACTS = "a AS (SELECT id, k, 0 AS place, least AS key FROM t WHERE gold UNION ALL SELECT id, k, 1, CASE WHEN k % 4 = 0 THEN least ELSE most END FROM t WHERE gold)"
_CODE = "CASE WHEN k % 9 = 0 THEN 'not_verified' WHEN k % 7 = 0 THEN 'not_owner' WHEN (place = 1 AND key = (SELECT least FROM t WHERE t.k = a.k)) OR o_orderstatus <> 'O' THEN 'not_cancellable' END"
_REPLAY = f"r AS (SELECT id, k, place, key, {_CODE} AS code FROM a JOIN orders ON o_orderkey = key)"


def _replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = tasks(spark, sf_dir).withColumn("id", F.concat("id", F.lit("/"), "customer_id"))
    state = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return t, state, op_tasks.gold_replay(t, state, "o_orderkey", "o_custkey", "o_orderstatus", "O")


_ID = "id || '/' || CASE WHEN k % 7 = 0 THEN 'x' ELSE '' END || k"


@query(f"WITH {_TASKS}, {_ACTS}, {_REPLAY} SELECT {_ID} AS id, place, key::VARCHAR AS o_orderkey, code FROM r")
def gold_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writes that tasks expect, in order, with the code of those that the rules refuse."""
    return _replay(spark, sf_dir)[2]


_BITS = "('0x' || substr(sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || length(o_custkey::VARCHAR) || ':' || o_custkey || length({0}) || ':' || {0}), 1, 15))::BIGINT"


@query(
    f"WITH {_TASKS}, {_ACTS}, {_REPLAY}, p AS (SELECT k, count(code) AS problems FROM r GROUP BY k), h AS (SELECT sum({_BITS.format('o_orderstatus')})::HUGEINT AS total FROM orders), "
    f"d AS (SELECT k, sum({_BITS.format(repr('C'))} - {_BITS.format('o_orderstatus')})::HUGEINT AS delta FROM r JOIN orders ON o_orderkey = key WHERE code IS NULL GROUP BY k) "
    f"SELECT {_ID} AS id, coalesce(problems, 0) AS problems, CASE WHEN coalesce(problems, 0) = 0 THEN (total + coalesce(delta, 0))::VARCHAR END AS hash FROM h, t LEFT JOIN p USING (k) LEFT JOIN d USING (k)"
)
def gold_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of the state that each task's expected writes lead to."""
    t, state, replay = _replay(spark, sf_dir)
    return op_tasks.gold_hashes(t, replay, state, "o_orderkey", {"o_orderstatus": F.lit("C")}, ["o_orderkey", "o_custkey", "o_orderstatus"])
