"""State algebra over snapshots of orders: dumps, differences, fingerprints, first-wins deduplication, stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import state as op
from tidemill.registry import query, table

_A = "a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)"
_B = "b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 50 <> 7)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    changed = o.filter("o_orderkey % 50 <> 7").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")))
    return o.select(*columns), changed.select(*columns)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS o_orderdate, round(o_totalprice * 100)::BIGINT AS cents FROM orders")
def state_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain rows of a table in key order: free text left out, times as ISO seconds in UTC."""
    o = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return op.dump(o, ["o_orderkey"], ignored=["o_orderpriority", "o_totalprice"])


@query(f"WITH {_A}, {_B} SELECT 'only_expected' AS side, * FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_actual', * FROM (FROM b EXCEPT FROM a)")
def state_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one of two snapshots has."""
    return op.difference(*_snapshots(spark, sf_dir))


@query(f"WITH {_A}, {_B} SELECT 'orders' AS name, NOT EXISTS ((FROM a EXCEPT ALL FROM b) UNION ALL (FROM b EXCEPT ALL FROM a)) AS equal UNION ALL SELECT 'self', true")
def state_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two snapshots hold the same rows, each as often."""
    a, b = _snapshots(spark, sf_dir)
    return op.equality("orders", a, b).union(op.equality("self", a, a))


_YEAR = "SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = {0}"


@query(f"SELECT l_partkey, count(*) AS surplus FROM ({_YEAR.format(1995)} EXCEPT ALL {_YEAR.format(1996)}) GROUP BY l_partkey")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made more often than expected, with how often more."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"))
    done, gold = (l.filter(F.col("y") == y).select("l_partkey") for y in (1995, 1996))
    return op.surplus(done, gold)


@query(f"SELECT l_partkey, count(*) AS surplus FROM ({_YEAR.format(1996)} EXCEPT ALL {_YEAR.format(1995)}) GROUP BY l_partkey")
def bag_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calls that were not made, or not often enough."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"))
    return op.surplus(l.filter("y = 1996").select("l_partkey"), l.filter("y = 1995").select("l_partkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40)")
def forbidden_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked calls whose key is in the forbidden set."""
    l = table(spark, sf_dir, "lineitem")
    forbidden = l.filter("l_returnflag = 'A' AND l_quantity > 40").select("l_partkey", "l_suppkey")
    return l.filter("l_returnflag = 'R'").join(forbidden, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that every run has."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return op.in_all(o, "o_orderpriority", ["o_custkey"], 2)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each key in a stated order."""
    return op.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT text, min(doc_id) AS doc_id, (SELECT count(DISTINCT text) FROM documents) AS texts FROM documents GROUP BY text ORDER BY doc_id LIMIT 40")
def first_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First forty distinct texts with the number of all; ids and digests are compared, texts fetched at the end."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    first = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    total = first.agg(F.count("*").alias("texts"))
    top = first.orderBy("doc_id").limit(40).select("doc_id")
    return d.join(F.broadcast(top), "doc_id").crossJoin(F.broadcast(total)).select("text", "doc_id", "texts")


@query(
    f"WITH {_A}, r AS (SELECT o_orderkey, o_custkey, 'Z' AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 3) "
    "SELECT * FROM r UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)"
)
def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with the rows of a rerun in place of its own."""
    a, _ = _snapshots(spark, sf_dir)
    return op.stitch(a, a.filter("o_orderkey % 10 = 3").withColumn("o_orderstatus", F.lit("Z")), ["o_orderkey"])


@query(f"WITH {_A}, {_B} SELECT o_orderkey FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def not_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a rerun that the record lacks; no rows if it is a subset."""
    a, b = _snapshots(spark, sf_dir)
    return a.join(b, "o_orderkey", "left_anti").select("o_orderkey")


@query(
    "SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS hash FROM orders"
)
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each row, columns in a fixed order."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", op.row_hash(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("hash"))


@query(
    "SELECT 'orders' AS name, count(*) AS n, sum(('0x' || substr(sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || length(o_custkey::VARCHAR) || ':' || o_custkey || length(o_orderstatus) || ':' || o_orderstatus), 1, 15))::BIGINT)::HUGEINT::VARCHAR AS hash FROM orders"
)
def state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of a table that doesn't depend on the order of its rows: added up in parallel, no sort, no list."""
    return op.fingerprint("orders", table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT 'orders' AS name, count(*) AS n, max(o_orderdate) AS latest, max(o_orderdate) < TIMESTAMP '2000-01-01' AS before_clock FROM orders")
def clock_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every time in the data lies before the clock."""
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest")).select(
        F.lit("orders").alias("name"), "n", "latest", (F.col("latest") < F.lit("2000-01-01").cast("timestamp")).alias("before_clock")
    )


@query("SELECT p_partkey, sha256(concat_ws('|', 'ch-1', p_partkey, p_name)) AS cache_key, p_partkey % 3 = 0 AS cached FROM part")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys from channel, seed and text, and whether the cache has them."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", F.lit("ch-1"), F.col("p_partkey"), F.col("p_name")), 256).alias("cache_key"))
    cache = p.filter("p_partkey % 3 = 0").select("cache_key", F.lit(True).alias("cached"))
    return p.join(cache, "cache_key", "left").select("p_partkey", "cache_key", F.coalesce("cached", F.lit(False)).alias("cached"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('seed-7:' || o_orderkey::VARCHAR), o_orderkey) AS place FROM orders QUALIFY place <= 40")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty rows without replacement, the same for a seed: a top-k by hash, so that no full sort is needed."""
    return op.sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 40, "seed-7")


@query(
    "SELECT o_orderkey, 'B' || lpad((row_number() OVER (ORDER BY md5('blind-1:' || o_orderkey::VARCHAR), o_orderkey))::VARCHAR, 2, '0') AS label FROM orders "
    "QUALIFY row_number() OVER (ORDER BY md5('blind-1:' || o_orderkey::VARCHAR), o_orderkey) <= 25"
)
def blinded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample in an order that says nothing of its origin, with blind labels."""
    s = op.sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 25, "blind-1")
    return s.select("o_orderkey", F.concat(F.lit("B"), F.lpad(F.col("place").cast("string"), 2, "0")).alias("label"))


@query(
    "WITH u AS (SELECT o_custkey AS customer, (o_orderkey % 7 + 1)::BIGINT AS n FROM orders), m AS (SELECT DISTINCT customer FROM u) "
    "SELECT customer, min(k) AS free FROM m, (SELECT unnest(range(1, 9)) AS k) WHERE NOT EXISTS (FROM u WHERE u.customer = m.customer AND u.n = k) GROUP BY customer"
)
def free_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest number from 1 that each customer hasn't used."""
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 7 + 1).alias("n"))
    return op.free_number(used, "customer", "n")
