"""Runs of episodes: their summary, statistics of guards and of the simulated customer, tables as Markdown, lost frames.

Records are nested; each table of values is one pass over them. What is counted within an episode (calls, messages) is
folded inside its row before rows are added up, so nothing is exploded and nothing but a row for each run is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.unicode import nfkc
from tidemill.operators.conversation import SCRIPT, is_stall

# Reasons for which a reply was held that are no error of format, and what a customer must not write.
HELD = ("stall", "unbacked_claim", "repeat")
CONFIRM_CODE = "confirmation_required"
THINK_TAG = r"</?think>"
END_LEFTOVER = r"(?i)#{2,}|(?<![A-Za-z])STOP(?![A-Za-z])|OUT[-_ ]?OF[-_ ]?SCOPE"
PROMPT_SHARE = 0.95


def _calls(who: str) -> Column:
    return F.filter("llm_calls", lambda c: c["who"] == who)


def _count(array: Column, test) -> Column:
    """How many entries pass; none of a null array."""
    return F.coalesce(F.size(F.filter(array, lambda x: F.coalesce(test(x), F.lit(False)))), F.lit(0)).cast("long")


def _total(array: Column, value) -> Column:
    """Sum over entries, nulls as zero; 0 of a null array."""
    return F.coalesce(F.aggregate(array, F.lit(0.0), lambda t, x: t + F.coalesce(value(x), F.lit(0)).cast("double")), F.lit(0.0))


def _mean(total: str, count: str | Column) -> Column:
    n = F.sum(count)
    return F.when(n > 0, F.round(F.sum(total) / n, 1)).otherwise(0.0)


def summary(records: DataFrame) -> DataFrame:
    """One row for each run: counts of endings, successes, writes, violations, held replies, and times of calls.

    Episodes lost to the infrastructure count in ``episodes``, ``infra_errors`` and ``terminations`` only; a task all of
    whose trials were lost is named in ``tasks_without_valid_trials``. Without calls, means and maxima are 0.
    """
    valid = F.col("status") != "infra_error"
    agent, user, v = _calls("agent"), _calls("user"), F.col("verdict")
    held = lambda kind: _count(agent, lambda c: c["format_error"] == kind)
    within = {
        "seconds": F.coalesce("wall_seconds", F.lit(0.0)),
        "passed": F.coalesce(v["success"], F.lit(False)).cast("long"),
        "writes": F.coalesce(v["unexpected_writes"], F.lit(0)),
        "violations": F.greatest(F.size(v["policy_violations"]), F.lit(0)),
        "blocks": F.greatest(F.size(v["policy_blocks"]), F.lit(0)),
        "auth": F.coalesce(v["auth_blocks"], F.lit(0)),
        "format": _count(agent, lambda c: c["format_error"].isNotNull() & ~c["format_error"].isin(*HELD)),
        "claims": held("unbacked_claim"),
        "repeats": held("repeat"),
        "confirms": _count(F.col("tool_calls"), lambda t: t["error_code"] == CONFIRM_CODE),
        "dropped": _total(agent, lambda c: c["dropped_calls"]),
        "agents": _count(agent, lambda c: F.lit(True)),
        "users": _count(user, lambda c: F.lit(True)),
        "agent_ms": _total(agent, lambda c: c["wall_ms"]),
        "eval_ms": _total(agent, lambda c: c["prompt_eval_ms"]),
        "user_ms": _total(user, lambda c: c["wall_ms"]),
        "load_ms": _total(agent, lambda c: c["load_ms"]) + _total(user, lambda c: c["load_ms"]),
        "tokens": F.coalesce(F.array_max(F.transform(agent, lambda c: c["prompt_tokens"])), F.lit(0)),
        "unknown": _count(agent, lambda c: F.coalesce(c["prompt_tokens"], F.lit(0)) == 0),
    }
    rows = records.select("run_id", "task_id", "status", "termination", valid.cast("long").alias("valid"), *(F.when(valid, c).otherwise(0).alias(k) for k, c in within.items()))
    add = lambda c: F.sum(c).cast("long")
    tasks = rows.groupBy("run_id", "task_id").agg(F.sum("valid").alias("n"), F.sum("passed").alias("c"))
    by_task = tasks.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.concat("task_id", F.lit("="), "c", F.lit("/"), "n")))).alias("by_task"),
        F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("task_id")))).alias("tasks_without_valid_trials"),
    )
    endings = rows.groupBy("run_id", "termination").agg(F.count("*").alias("k"))
    endings = endings.groupBy("run_id").agg(F.array_sort(F.collect_list(F.concat("termination", F.lit("="), "k"))).alias("terminations"))
    found = rows.groupBy("run_id").agg(
        F.count("*").alias("episodes"),
        F.count_if(F.col("status") == "infra_error").alias("infra_errors"),
        F.count_if(F.col("status") == "truncated").alias("truncated"),
        add("passed").alias("successes"),
        F.count_if((F.col("passed") == 1) & (F.col("writes") > 0)).alias("successes_with_unexpected_writes"),
        add("writes").alias("unexpected_writes"),
        add("violations").alias("policy_violations"),
        add("blocks").alias("policy_blocks"),
        add("auth").alias("auth_blocks"),
        add("format").alias("format_errors"),
        add("claims").alias("held_claims"),
        add("repeats").alias("held_repeats"),
        add("confirms").alias("confirmation_requests"),
        add("dropped").alias("dropped_calls"),
        _mean("seconds", "valid").alias("seconds_per_episode"),
        _mean("agents", "valid").alias("agent_calls_per_episode"),
        _mean("agent_ms", "agents").alias("agent_call_ms"),
        _mean("eval_ms", "agents").alias("agent_prompt_eval_ms"),
        F.max("tokens").cast("long").alias("agent_prompt_tokens_max"),
        add("unknown").alias("agent_calls_without_prompt_tokens"),
        _mean("user_ms", "users").alias("user_call_ms"),
        F.round(F.sum("load_ms"), 1).alias("model_load_ms_total"),
    )
    return found.join(endings, "run_id").join(by_task, "run_id")


def guard_statistics(records: DataFrame) -> DataFrame:
    """One row for each run of what its guards did: held replies by kind, stalls and other scripts that were delivered,
    reads by tool, endings over format and claims, times."""
    agent = _calls("agent")
    valid = records.filter("status <> 'infra_error'")
    said = F.filter("messages", lambda m: (m["role"] == "assistant") & F.coalesce(m["delivered"], F.lit(True)) & (F.trim(m["content"]) != ""))
    calls = lambda name, ok=False: _count(F.col("tool_calls"), lambda t: (t["name"] == name) & (t["ok"] if ok else F.lit(True)))
    held = lambda kind: F.sum(_count(agent, lambda c: c["format_error"] == kind))
    told = F.sum(_count(agent, lambda c: c["prompt_tokens"].isNotNull()))
    orders = F.filter("tool_calls", lambda t: (t["name"] == "get_order") & t["ms"].isNotNull())
    share = lambda total, n: F.when(n > 0, F.round(total / n, 6)).otherwise(0.0)
    return valid.groupBy("run_id").agg(
        F.sum(F.coalesce("verdict.unexpected_writes", F.lit(0))).alias("unexpected_writes"),
        F.sum(F.greatest(F.size("verdict.policy_violations"), F.lit(0))).alias("violations"),
        F.count_if(F.col("termination").isin("agent_format_error", "unbacked_claim")).alias("format_and_claim_endings"),
        F.sum(_count(said, lambda m: is_stall(m["content"]))).alias("stall_replies"),
        F.sum(_count(said, lambda m: F.regexp_count(m["content"], F.lit(SCRIPT)) >= 2)).alias("other_script"),
        F.sum(_count(said, lambda m: F.lit(True))).alias("replies"),
        held("unbacked_claim").alias("held_claims"),
        held("stall").alias("held_stalls"),
        held("repeat").alias("held_repeats"),
        *(F.sum(calls(n, ok)).alias(f"{n}_{'ok' if ok else 'calls'}") for n in ("get_order", "track_shipment") for ok in (False, True)),
        share(F.sum("wall_seconds"), F.count("*")).alias("seconds"),
        share(F.sum(_total(agent, lambda c: c["wall_ms"])), F.sum(_count(agent, lambda c: F.lit(True)))).alias("agent_ms"),
        share(F.sum(_total(agent, lambda c: c["prompt_tokens"])), told).alias("prompt_tokens"),
        share(F.sum(_total(orders, lambda t: t["ms"])), F.sum(_count(orders, lambda t: F.lit(True)))).alias("get_order_ms"),
    )


def format_problems(text: Column, cut: Column, called: Column) -> Column:
    """What is wrong with the form of a simulated customer's message: kinds, in a fixed order. ``text`` is without its
    mark of an end."""
    kinds = [("think_tag", text.rlike(THINK_TAG)), ("cut_off", cut), ("tool_call", called), ("broken_end", text.rlike(END_LEFTOVER))]
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in kinds)))


def simulator_counts(records: DataFrame, limit: int) -> DataFrame:
    """One row for each run of what its simulated customer did: messages, other scripts, problems of form, the longest
    prompt, and prompts over PROMPT_SHARE of ``limit`` tokens."""
    from tidemill.functions.text import without_ending

    users = records.filter("status <> 'infra_error'").select("run_id", F.inline(F.transform(_calls("user"), lambda c: F.struct(c["text"].alias("text"), c["finish_reason"].alias("finish"), c["tool_calls"].alias("calls"), c["prompt_tokens"].alias("tokens")))))
    left = without_ending(nfkc(F.coalesce("text", F.lit(""))))
    found = users.withColumn("problems", format_problems(left, F.col("finish") == "length", F.size("calls") > 0)).withColumn("left", left)
    return found.groupBy("run_id").agg(
        F.count("*").alias("utterances"),
        F.count_if(F.regexp_count("left", F.lit(SCRIPT)) >= 2).alias("other_language"),
        F.count_if(F.size("problems") > 0).alias("format_utterances"),
        *(F.count_if(F.array_contains("problems", kind)).alias(kind) for kind in ("think_tag", "cut_off", "tool_call", "broken_end")),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("max_prompt_tokens"),
        F.count_if(F.col("tokens") > PROMPT_SHARE * limit).alias("prompts_over_limit"),
    )


def markdown(table: DataFrame, order: str, empty: str = "-") -> DataFrame:
    """(place, line): a table as lines of Markdown in the order of a column: names, rule, rows. Null cells show ``empty``;
    bars and line ends in cells are made harmless. For result tables, which have a row for each run."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(empty)), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    lined = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, table.columns)), F.lit(" |"))
    rows = table.select((F.row_number().over(Window.orderBy(order)) + 2).cast("long").alias("place"), lined.alias("line"))
    head = [(1, f"| {' | '.join(table.columns)} |"), (2, "|" + "---|" * len(table.columns))]
    return table.sparkSession.createDataFrame(head, "place long, line string").union(rows)


def lost_frames(draws: DataFrame, key: str, frame: str, draw: str, rate: float, burst: float) -> DataFrame:
    """(key, frame, lost): frames lost by a chain of a good and a bad state, in bursts of ``burst`` frames on average, so that
    a share of ``rate`` is lost; all frames in the bad state are. Frame 0 starts from the share itself; the draw of
    each later frame, a number from 0 to 1, moves the state.

    A draw below the chance of turning bad makes any state bad, one at or above the chance of staying bad makes any good,
    and one between leaves it as it is: so the state is that of the last draw that decided, a window, not a loop.
    """
    leave = 1 / burst
    enter = rate * leave / (1 - rate)
    if not 0 < rate < 1 or burst < 1 or enter > 1 - leave:
        raise ValueError("rate and burst: a share, and at least one frame, such that good frames turn bad less often than bad ones stay")
    u, first = F.col(draw), F.col(frame) == 0
    decided = F.when(first, u < rate).when(u < enter, True).when(u >= 1 - leave, False)
    state = F.last(decided, ignorenulls=True).over(Window.partitionBy(key).orderBy(frame))
    return draws.select(key, frame, state.alias("lost"))
