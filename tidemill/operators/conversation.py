"""Conversations as ordered rows: delivered replies, turns, divergence, visibility, limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Promises to act, requests to the customer, letters of other scripts.
PROMISE = r"(확인|조회|처리|접수|진행|발급|변경|취소|연결|검토)\s*(해|하)\s*(보|드리)?\s*겠습니다|잠시만|기다려\s*주"
ASKS = r"[?？]|알려\s*주|말씀해\s*주|불러\s*주|입력해\s*주"
SCRIPT = r"[\u4e00-\u9fff\u3040-\u30ff]"


def in_order(conv: str = "conv_id", turn: str = "turn"):
    return Window.partitionBy(conv).orderBy(turn)


def delivered(messages: DataFrame, greeting: Column) -> DataFrame:
    """Assistant messages a customer saw: blank ones and a leading greeting left out; later greetings stay."""
    own = messages.filter((F.col("role") == "assistant") & (F.trim("text") != ""))
    return own.withColumn("_n", F.row_number().over(in_order())).filter(~((F.col("_n") == 1) & greeting)).drop("_n")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_stall(text: Column) -> Column:
    """A promise to act, with nothing that the customer is asked for."""
    return text.rlike("(?U)" + PROMISE) & ~text.rlike("(?U)" + ASKS)


def loops(messages: DataFrame) -> DataFrame:
    """(conv_id, loops): the last three replies say the same."""
    last = messages.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("_n <= 3")
    same = (F.count("*") == 3) & (F.count_distinct(collapsed(F.col("text"))) == 1)
    return last.groupBy("conv_id").agg(same.alias("loops"))


def turns(messages: DataFrame) -> DataFrame:
    """Messages with ``exchange``: how many customer messages there are up to and with each."""
    return messages.withColumn("exchange", F.sum((F.col("role") == "user").cast("long")).over(in_order()))


def exchanges(messages: DataFrame) -> DataFrame:
    """(conv_id, exchange, said, reply, answer): each customer message, the last reply to it, the next customer message."""
    t = turns(messages).filter("exchange > 0")
    one = t.groupBy("conv_id", "exchange").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("said"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply"),
    )
    return one.withColumn("answer", F.lead("said").over(Window.partitionBy("conv_id").orderBy("exchange")))


def first_divergence(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, turn, side): the first turn at which two conversations differ; a missing message differs. No row if none.

    ``pairs`` has (a, b); both sides are joined to their pair, then to each other by pair and turn.
    """
    x = pairs.join(left, F.col("a") == F.col("conv_id")).select("a", "b", "turn", "role", "text")
    y = pairs.join(right, F.col("b") == F.col("conv_id")).select("a", "b", "turn", F.col("role").alias("role_b"), F.col("text").alias("text_b"))
    both = x.join(y, ["a", "b", "turn"], "full_outer").filter(~(F.col("role").eqNullSafe(F.col("role_b")) & F.col("text").eqNullSafe(F.col("text_b"))))
    side = F.coalesce("role", "role_b")
    return both.groupBy("a", "b").agg(F.min(F.struct("turn", side.alias("side"))).alias("_f")).select("a", "b", "_f.turn", "_f.side")


def visible_before(messages: DataFrame, value: Column, out: str) -> DataFrame:
    """Adds what earlier messages of the conversation hold: the sum of ``value`` over the rows strictly before."""
    return messages.withColumn(out, F.coalesce(F.sum(value).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


@dataclass(frozen=True)
class Limits:
    """Where a conversation ends (customer messages, calls of the agent, failed tools), and how often in a turn a reply of a
    kind is held and asked for again. What is beyond that: a reply of bad form or with a claim ends the conversation, one
    that stalls or repeats is delivered."""

    turns: int = 20
    calls: int = 30
    errors: int = 10
    format: int = 2
    claim: int = 2
    stall: int = 2
    repeat: int = 1


# Fixed value: a tool call written out in a reply.
LEAKED = r"(?s)</?tool_call>|^\s*\{.*\"name\"\s*:.*\"(?:arguments|parameters)\"\s*:.*\}\s*$"
#: Counters of a conversation, those of the turn, what was delivered last, who spoke last, and how it ended ('' if it has not).
COUNTERS = ("turns", "calls", "replies", "formats", "claims", "stalls", "repeats", "errors")
IN_TURN = ("format", "claim", "stall", "repeat")
OUTCOME = "customer_turns long, calls long, replies long, formats long, claims long, stalls long, repeats long, tool_errors long, ended string"
_OUT = dict(zip(COUNTERS, ("customer_turns", "calls", "replies", "formats", "claims", "stalls", "repeats", "tool_errors")))


def events(messages: DataFrame, problem: Column | None = None, failed: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, kind, said): what the fold reads of each message. ``problem`` says what is wrong with a reply
    (format, claim, stall, or null); by default blank replies and written-out calls are of bad form, and promises
    stall. ``failed`` says of a tool's message that it failed. Spaces don't count in what is said."""
    text = F.coalesce("text", F.lit(""))
    own = F.when((F.trim(text) == "") | text.rlike(LEAKED), "format").when(is_stall(text), "stall") if problem is None else problem
    bad = F.lit(False) if failed is None else failed
    kind = F.when(F.col("role") == "assistant", F.coalesce(own, F.lit("reply"))).when(F.col("role") == "user", "user").when(bad, "error").otherwise("other")
    return messages.select("conv_id", "turn", "role", kind.alias("kind"), F.xxhash64(collapsed(text)).alias("said"))


def fold(read: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(conv_id, *OUTCOME) of ``events``: each conversation read once, in order, under limits, in the JVM. A conversation's
    events (a few bytes each, no texts) are one row. Nothing counts after an end; without one, a conversation whose last
    message is a delivered reply is 'answered', any other 'open'."""
    zero = {c: F.lit(0).cast("long") for c in (*COUNTERS, *(f"in_{c}" for c in IN_TURN))}
    start = F.struct(*(v.alias(c) for c, v in zero.items()), F.lit(None).cast("long").alias("last"), F.lit("").alias("role"), F.lit("").alias("ended"))

    def advance(state: Column, x: Column) -> Column:
        kind, agent = x["kind"], x["kind"].isin("format", "claim", "stall", "reply")
        over = agent & (state["calls"] >= limits.calls)
        stalls = (kind == "stall") & (state["in_stall"] < limits.stall)
        repeats = kind.isin("reply", "stall") & ~stalls & F.coalesce(x["said"] == state["last"], F.lit(False)) & (state["in_repeat"] < limits.repeat)
        held = {"format": kind == "format", "claim": kind == "claim", "stall": stalls, "repeat": repeats}
        reply = agent & ~(held["format"] | held["claim"] | stalls | repeats)
        enough = (kind == "user") & (state["turns"] >= limits.turns)
        ended = (
            F.when(enough, "max_user_turns")
            .when(over, "max_agent_calls")
            .when(held["format"] & (state["in_format"] >= limits.format), "agent_format_error")
            .when(held["claim"] & (state["in_claim"] >= limits.claim), "unbacked_claim")
            .when((kind == "error") & (state["errors"] + 1 >= limits.errors), "tool_errors")
            .otherwise("")
        )
        counted = {"turns": (kind == "user") & ~enough, "calls": agent, "replies": reply, "formats": held["format"], "claims": held["claim"], "stalls": stalls, "repeats": repeats, "errors": kind == "error"}
        after = {c: state[c] + F.when(hit & ~over, 1).otherwise(0) for c, hit in counted.items()}
        after |= {f"in_{c}": F.when(kind == "user", 0).otherwise(state[f"in_{c}"] + F.when(held[c], 1).otherwise(0)).cast("long") for c in IN_TURN}
        after |= {"last": F.when(reply, x["said"]).otherwise(state["last"]), "role": F.when(reply, "reply").otherwise(x["role"]), "ended": ended}
        return F.struct(*(F.when(state["ended"] != "", state[c]).otherwise(v).alias(c) for c, v in after.items()))

    listed = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "kind", "said"))).alias("log"))
    end = listed.select("conv_id", F.aggregate("log", start, advance).alias("s"))
    ended = F.when(F.col("s.ended") != "", F.col("s.ended")).when(F.col("s.role") == "reply", "answered").otherwise("open")
    return end.select("conv_id", *(F.col(f"s.{c}").alias(name) for c, name in _OUT.items()), ended.alias("ended"))


def new_state() -> dict:
    return {c: 0 for c in (*COUNTERS, *(f"in_{c}" for c in IN_TURN))} | {"last": None, "role": "", "ended": ""}


def step(state: dict, role: str, kind: str, said: int, limits: Limits = Limits()) -> None:
    """One event of ``events`` for a state that is kept between batches; as ``fold``, nothing changes after an end."""
    if state["ended"]:
        return
    state["role"] = role
    if kind == "user":
        state |= {f"in_{c}": 0 for c in IN_TURN}
        if state["turns"] >= limits.turns:
            state["ended"] = "max_user_turns"
        else:
            state["turns"] += 1
    elif kind == "error":
        state["errors"] += 1
        state["ended"] = "tool_errors" if state["errors"] >= limits.errors else ""
    elif kind != "other":
        if state["calls"] >= limits.calls:
            state["ended"] = "max_agent_calls"
            return
        state["calls"] += 1
        if kind == "stall" and state["in_stall"] >= limits.stall:
            kind = "reply"
        if kind == "reply" and said == state["last"] and state["in_repeat"] < limits.repeat:
            kind = "repeat"
        if kind == "reply":
            state |= {"replies": state["replies"] + 1, "last": said, "role": "reply"}
            return
        if kind in ("format", "claim") and state[f"in_{kind}"] >= getattr(limits, kind):
            state["ended"] = {"format": "agent_format_error", "claim": "unbacked_claim"}[kind]
        state[f"in_{kind}"] += 1
        state[f"{kind}s"] += 1


def outcome(state: dict) -> dict:
    ended = state["ended"] or ("answered" if state["role"] == "reply" else "open")
    return {name: state[c] for c, name in _OUT.items()} | {"ended": ended}
