"""Writes that wait for consent: keys of calls, the gate that previews or runs them, and the exchanges that come of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import consent
from tidemill.functions.text import holds_number
from tidemill.functions.unicode import nfkc
from tidemill.operators.calls import TOOLS

# How previews and errors begin, arguments that are free text or lists without order, keys of amounts.
PREVIEW, ERROR = "CONFIRM_REQUIRED", "Error: "
UNCOMPARED = {"create_ticket": ("body",), "transfer_to_human": ("reason", "summary")}
UNORDERED = {"request_return": ("line_nos",)}
AMOUNTS = ("refund_won", "return_fee_won", "amount_won")


def call_key(tool: Column, args: Column) -> Column:
    """What a customer consents to: the tool and its arguments in the order of their names, without nulls and free text, lists
    without order sorted. Two calls mean the same if their keys are equal. Arguments that aren't an object give null."""
    listed = lambda table, k: F.coalesce(*(F.when(tool == t, k.isin(*names)) for t, names in table.items()), F.lit(False))
    kept = F.map_filter(F.from_json(args, "map<string,string>"), lambda k, v: v.isNotNull() & ~listed(UNCOMPARED, k))
    plain = F.transform_values(kept, lambda k, v: F.when(listed(UNORDERED, k), F.to_json(F.array_sort(F.from_json(v, "array<int>")))).otherwise(v))
    return F.concat(tool, F.lit(" "), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(plain)))))


def gate(calls: DataFrame) -> DataFrame:
    """(conv, at, key, outcome) of write calls (conv, at, turn, key, consent, ok).

    ``turn`` counts the customer's messages so far, ``consent`` says whether the last one consents, ``ok`` whether the tool
    would take the call. A call runs if the same call (by key) was previewed in the turn before, and not run since, and the
    customer consented; else it is previewed, or refused if the tool does so. Each key is a small automaton over its calls."""
    listed = calls.groupBy("conv", "key").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "consent", "ok"))).alias("calls"))
    start = F.struct(F.lit(-1).cast("long").alias("pending"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        due = (a["pending"] == x["turn"] - 1) & F.coalesce(x["consent"], F.lit(False))
        pending = F.when(due, F.lit(-1).cast("long")).when(x["ok"], x["turn"].cast("long")).otherwise(a["pending"])
        outcome = F.when(~x["ok"], "refused").when(due, "ran").otherwise("preview")
        return F.struct(pending.alias("pending"), F.concat(a["out"], F.array(outcome)).alias("out"))

    each = listed.select("conv", "key", F.explode(F.arrays_zip("calls", F.aggregate("calls", start, step, lambda a: a["out"]).alias("out"))).alias("z"))
    return each.select("conv", "z.calls.at", "key", F.col("z.out").alias("outcome"))


def turns(messages: DataFrame) -> DataFrame:
    """``messages`` with ``turn``: how many messages the customer has said so far. Notes of the harness aren't the customer's."""
    mine = (F.col("role") == "user") & ~F.col("harness")
    return messages.withColumn("turn", F.count(F.when(mine, 1)).over(Window.partitionBy("conv").orderBy("at")))


def exchanges(messages: DataFrame) -> DataFrame:
    """(conv, turn, previews, repeats, amounts, reply, said_amounts, answer, kind, ran): each turn in which calls were previewed.

    ``messages`` are (conv, at, role, content, tool, delivered, harness, calls). ``repeats`` are previews of a call that the turn had
    already; ``amounts`` those above zero in the previews; ``reply`` the last delivered message without calls after the
    first preview, and whether it says all the amounts; ``answer`` the customer's next message and its kind ('none' if the
    conversation ended); ``ran`` how many writes ran in the turn of the answer."""
    m, content = turns(messages), F.col("content")
    preview = (F.col("role") == "tool") & F.coalesce(content.startswith(PREVIEW), F.lit(False))
    ran = (F.col("role") == "tool") & F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)) & ~preview & ~F.coalesce(content.startswith(ERROR), F.lit(False))
    body = F.when(preview, F.regexp_replace(content, r"^[^\n]*\n?", ""))
    own = m.select("*", preview.alias("preview"), ran.alias("ran"), body.alias("body"), F.min(F.when(preview, F.col("at"))).over(Window.partitionBy("conv", "turn")).alias("first"))
    won = F.array_compact(F.array(*(F.get_json_object("body", f"$.preview.{k}").try_cast("bigint") for k in AMOUNTS)))
    reply = (F.col("role") == "assistant") & (content != "") & F.col("delivered") & ~F.col("calls") & (F.col("at") > F.col("first"))
    by = own.groupBy("conv", "turn").agg(
        F.count_if("preview").alias("previews"),
        (F.count_if("preview") - F.count_distinct(call_key(F.get_json_object("body", "$.tool"), F.get_json_object("body", "$.arguments")))).alias("repeats"),
        F.array_sort(F.flatten(F.collect_list(F.filter(won, lambda x: x > 0)))).alias("amounts"),
        F.max_by("content", F.when(reply, F.col("at"))).alias("reply"),
        F.max(F.when((F.col("role") == "user") & ~F.col("harness"), content)).alias("said"),
        F.count_if("ran").alias("ran"),
    )
    order = Window.partitionBy("conv").orderBy("turn")
    met = by.select("conv", "turn", "previews", "repeats", "amounts", "reply", F.lead("said").over(order).alias("answer"), F.coalesce(F.lead("ran").over(order), F.lit(0)).alias("ran")).filter("previews > 0")
    met = met.withColumn("plain", nfkc(F.col("reply")))
    tells = F.forall("amounts", lambda n: holds_number(F.col("plain"), n))
    kind = F.when(F.col("answer").isNull(), "none").otherwise(consent.kind(F.col("answer")))
    return met.select("conv", "turn", "previews", "repeats", "amounts", "reply", F.when(F.size("amounts") > 0, tells).alias("said_amounts"), "answer", kind.alias("kind"), "ran")


def statistics(found: DataFrame) -> DataFrame:
    """Counts over exchanges: by kind of answer, repeated previews, consent that led to no write, replies that say the amounts."""
    kinds = ("consent", "refusal", "question", "other", "none")
    return found.agg(
        F.count("*").alias("exchanges"),
        *(F.count_if(F.col("kind") == k).alias(k) for k in kinds),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("repeats"),
        F.count_if((F.col("kind") == "consent") & (F.col("ran") == 0)).alias("consent_unrun"),
        F.count_if("said_amounts").alias("amounts_said"),
        F.count("said_amounts").alias("with_amounts"),
    )
