"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import WORD, cut

#: Most repetitions of a document, and most of a source's target over its size.
MOST = 3
#: Sources up to which the table of rates is broadcast (64 bytes a row at most, besides the name); beyond, it is joined by key.
BROADCAST_SOURCES = 10_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranks(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, from 0 by source in code-point order, null last: ranges of sources are ordered each by
    its own task, and begin at the number of sources in the ranges before."""
    order = F.col("source").asc_nulls_last()
    ranges = cut(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, not each source
    begins = ranges.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ranges.join(F.broadcast(begins), "part").select("source", "source_size", (F.col("begin") + within - 1).cast("long").alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from one row per (source, source_size).

    Weights 1, 2, 3, repeating, by the source's place in code-point order, null last. All sizes together are
    shared by weight; a target stops at MOST times its source's size and the excess is shared anew until none is
    above. Each round is one sum over all sources: a source stops if its limit is no more than its part of what is left
    to those that had not stopped. An empty table gives an empty result.
    """
    ranked = cut(ranks(sizes).withColumn("weight", F.col("place") % 3 + 1))
    size, weight = F.col("source_size"), F.col("weight")
    left, among, stops = 0, 0, F.lit(False)
    while True:
        row = ranked.select(F.sum(size), F.sum(F.when(stops, MOST * size).otherwise(0)), F.sum(F.when(~stops, weight).otherwise(0))).first()
        now = (row[0] or 0) - (row[1] or 0), row[2] or 0
        if now == (left, among) or not now[1]:
            break
        left, among = now
        stops = (MOST * size).cast("double") * F.lit(float(among)) <= weight.cast("double") * F.lit(float(left))
    shared = weight.cast("double") * F.lit(float(left)) / F.lit(float(among or 1))
    return ranked.select("source", "source_size", F.when(stops, (MOST * size).cast("double")).otherwise(shared).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and seed only: 52 bits of an MD5 hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def _free(name: str, docs: DataFrame) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """(key, size, source_size, target, rate, copies): how often the mix takes each row.

    copies = floor(rate) plus one if the key's draw is below the fraction, rate = target / source_size, so no row
    is taken more than MOST times and reruns agree. A null text has size 0; a null source is a source of its own;
    a source without words has rate 0. Rows with equal keys share a draw; rows stay one to one.
    """
    slim = cut(docs.select(docs[key].alias("id"), docs[source].alias("source"), word_count(docs[text]).alias("size")))
    rates = cut(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "of"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    return (
        slim.join(rates, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (draw(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
        .select(F.col("id").alias(key), "size", "source_size", "target", "rate", "copies")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan`` takes it, columns unchanged."""
    of, size, target, n, copy = (_free(x, docs) for x in ("mix_of", "mix_size", "mix_target", "mix_copies", "mix_copy"))
    sized = docs.groupBy(docs[source].alias("source")).agg(F.sum(word_count(docs[text])).alias("source_size"))
    rates = cut(targets(sized).toDF(of, size, target))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rate = F.when(F.col(size) > 0, F.least(F.col(target) / F.col(size), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(docs[key], seed) < rate - F.floor(rate)).cast("int")).cast("int")
    return (
        docs.join(rates, docs[source].eqNullSafe(F.col(of)))
        .withColumn(n, copies)
        .filter(F.col(n) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
        .select(*(docs[c] for c in docs.columns))
    )


