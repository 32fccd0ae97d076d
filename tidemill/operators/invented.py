"""Values that a customer states though nothing said so before, and values that a customer never hears."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import tokens
from tidemill.operators.tasks import value_found


def sources(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv, token, since): what texts (conv, at, text) tell, and from when on.

    Part of a longer number counts: each number is cut into all its windows of the lengths that the conversation's ``wanted``
    (conv, token) numbers have, so that parts are found by equality. A number of n digits makes at most n windows for a length."""
    each = texts.select("conv", "at", F.explode(tokens(F.col("text"), source=True)).alias("token")).groupBy("conv", "token").agg(F.min("at").alias("since"))
    lengths = wanted.filter(F.col("token").startswith("num:")).select("conv", (F.length("token") - 4).alias("n")).distinct()
    numbers = each.filter(F.col("token").startswith("num:")).select("conv", F.substring("token", 5, 1 << 20).alias("digits"), "since")
    longer = numbers.join(lengths, "conv").filter(F.length("digits") > F.col("n"))
    places = F.sequence(F.lit(1), F.length("digits") - F.col("n") + 1)
    windows = longer.select("conv", F.explode(F.transform(places, lambda k: F.concat(F.lit("num:"), F.substring(F.col("digits"), k, F.col("n"))))).alias("token"), "since")
    return each.union(windows).groupBy("conv", "token").agg(F.min("since").alias("since"))


def invented(utterances: DataFrame, texts: DataFrame) -> DataFrame:
    """(conv, at, missing): the sorted values of each utterance (conv, at, text) that no text (conv, at, text) before it tells.

    Texts come before an utterance if their ``at`` is smaller; what holds from the start (a prompt) has the least. Utterances
    without such values give no row."""
    said = utterances.select("conv", "at", F.explode(tokens(F.col("text"))).alias("token"))
    met = said.join(sources(texts, said.select("conv", "token")), ["conv", "token"], "left")
    missing = met.filter(F.col("since").isNull() | (F.col("since") >= F.col("at")))
    return missing.groupBy("conv", "at").agg(F.sort_array(F.collect_set("token")).alias("missing"))


def unheard(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(conv): conversations in which some required value (conv, kind, value) is in none of the texts (conv, text)."""
    found = values.join(texts.select("conv", "text"), "conv").filter(value_found(F.col("kind"), F.col("value"), F.col("text"))).select("conv", "kind", "value").distinct()
    return values.join(found, ["conv", "kind", "value"], "left_anti").select("conv").distinct()


def ends(episodes: DataFrame, values: DataFrame, texts: DataFrame) -> DataFrame:
    """(conv, never_heard, stopped_before, stopped_with_writes) of episodes (conv, infra, termination, gold, missing_writes).

    Whether the customer never heard some required value, and stopped before hearing all: null without required values.
    Whether it stopped with expected writes left: null where no write is expected. Infrastructure errors are null throughout."""
    lacking = unheard(values, texts).withColumn("lacks", F.lit(True))
    asked = values.select("conv").distinct().withColumn("asked", F.lit(True))
    e = episodes.join(asked, "conv", "left").join(lacking, "conv", "left")
    stop, lacks = F.col("termination") == "user_stop", F.coalesce("lacks", F.lit(False))
    counts = ~F.col("infra") & F.coalesce("asked", F.lit(False))
    return e.select(
        "conv",
        F.when(counts, lacks).alias("never_heard"),
        F.when(counts, stop & lacks).alias("stopped_before"),
        F.when(~F.col("infra") & (F.col("gold") > 0), stop & (F.col("missing_writes") > 0)).alias("stopped_with_writes"),
    )
