"""Reliability statistics over orders: a customer is a task, an order a trial, status F a success."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import compare, ranks
from tidemill.operators import reliability as op
from tidemill.registry import query, table

_TRIALS = "SELECT o_custkey AS task, o_orderpriority AS run, o_orderstatus = 'F' AS passed, o_totalprice, o_orderkey, o_orderdate FROM orders"
_BY_TASK = f"t AS ({_TRIALS}), b AS (SELECT task, count(*) AS n, count(*) FILTER (passed) AS c FROM t GROUP BY task)"


def _choose(k: str, n: str = "n", c: str = "c") -> str:
    """DuckDB: C(c, k) / C(n, k) as a product."""
    return f"list_reduce(list_prepend(1.0::DOUBLE, [greatest({c} - i, 0)::DOUBLE / ({n} - i) for i in range(0, {k})]), lambda x, y: x * y)"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task"),
        F.col("o_orderpriority").alias("run"),
        (F.col("o_orderstatus") == "F").alias("passed"),
        "o_orderkey",
        "o_totalprice",
        "o_orderdate",
    )


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs: orders of urgent or high priority, and the others."""
    t = trials(spark, sf_dir)
    first = F.col("run") <= "2-HIGH"
    return op.trials_by_task(t.filter(first), "task", "passed"), op.trials_by_task(t.filter(~first), "task", "passed")


_HALVES = (
    "a AS (SELECT task, count(*) AS n, count(*) FILTER (passed) AS c FROM t WHERE run <= '2-HIGH' GROUP BY task), "
    "z AS (SELECT task, count(*) AS n, count(*) FILTER (passed) AS c FROM t WHERE run > '2-HIGH' GROUP BY task)"
)


@query(f"WITH {_BY_TASK} SELECT task, n, c FROM b")
def trials_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials and successes of each task."""
    return op.trials_by_task(trials(spark, sf_dir), "task", "passed")


@query(f"WITH {_BY_TASK} SELECT task, round({_choose('2')}, 9) AS value FROM b WHERE n >= 2")
def pass_hat_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pass^2 of each task with two trials or more."""
    by = op.trials_by_task(trials(spark, sf_dir), "task", "passed").filter("n >= 2")
    return by.select("task", F.round(op.pass_hat_k(F.col("n"), F.col("c"), F.lit(2)), 9).alias("value"))


@query(f"WITH {_BY_TASK} SELECT 3 AS k, count(*) AS tasks, round(avg({_choose('3')}), 9) AS value FROM b WHERE n >= 3")
def pass_k_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pass^3 over the tasks with three trials or more."""
    return op.pass_k(op.trials_by_task(trials(spark, sf_dir), "task", "passed"), 3).withColumn("value", F.round("value", 9))


@query(
    f"WITH {_BY_TASK}, m AS (SELECT * FROM b WHERE n >= 4), k AS (SELECT unnest(range(1, (SELECT min(n) FROM m) + 1))::INTEGER AS k) "
    f"SELECT k, round(avg({_choose('k')}), 9) AS value FROM m, k GROUP BY k"
)
def pass_k_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pass^k for every k up to the smallest number of trials, over tasks with four or more."""
    by = op.trials_by_task(trials(spark, sf_dir), "task", "passed").filter("n >= 4")
    return op.pass_k_table(by).withColumn("value", F.round("value", 9))


@query(
    f"WITH t AS ({_TRIALS}), {_HALVES} SELECT a.task, round({_choose('1', 'z.n', 'z.c')} - {_choose('1', 'a.n', 'a.c')}, 9) AS difference FROM a JOIN z USING (task)"
)
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of pass^1 between two runs, for tasks that both have."""
    return op.paired(*_both(spark, sf_dir), "task", 1).withColumn("difference", F.round("difference", 9))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two runs, of the tasks that both have."""
    a, z = _halves(spark, sf_dir)
    return a.join(z.select("task"), "task", "left_semi"), z.join(a.select("task"), "task", "left_semi")


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.trials_by_task(trials(spark, sf_dir), "task", "passed").select("task", (F.col("c") / F.col("n")).alias("rate"))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, z = _both(spark, sf_dir)
    return a.join(z.withColumnsRenamed({"n": "n2", "c": "c2"}), "task")


@query()
def bootstrap_pass_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of mean pass^1 over 10,000 resamples of the tasks."""
    return op.resampled(_rates(spark, sf_dir), "task", op.mean_of("rate"))


@query()
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean paired difference between two runs, resampled by task."""
    return op.resampled(op.paired(*_both(spark, sf_dir), "task", 1), "task", op.mean_of("difference"))


@query()
def bootstrap_pooled_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two pooled ratios, sums taken anew in each resample."""
    return op.resampled(_sums(spark, sf_dir), "task", op.pooled_ratio("c", "n", "c2", "n2"), seed=20261005)


@query(
    f"WITH {_BY_TASK}, {_HALVES}, p AS (SELECT a.n, a.c, z.n AS n2, z.c AS c2 FROM a JOIN z USING (task)) "
    "SELECT 'pass_1' AS statistic, round(avg(c / n), 9) AS point FROM b UNION ALL SELECT 'paired', round(avg(c2 / n2 - c / n), 9) FROM p "
    "UNION ALL SELECT 'pooled_ratio', round(sum(c2) / sum(n2) - sum(c) / sum(n), 9) FROM p"
)
def resampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of the three resamplings over the tasks as they are, by the same functions, without draws."""
    none = [
        ("pass_1", _rates(spark, sf_dir), op.mean_of("rate")),
        ("paired", op.paired(*_both(spark, sf_dir), "task", 1), op.mean_of("difference")),
        ("pooled_ratio", _sums(spark, sf_dir), op.pooled_ratio("c", "n", "c2", "n2")),
    ]
    points = [op.resampled(df, "task", f, draws=40).select(F.lit(name).alias("statistic"), F.round("point", 9).alias("point")) for name, df, f in none]
    return points[0].union(points[1]).union(points[2])


_SEGMENTS = (
    "d AS (SELECT c_mktsegment AS segment, round(avg(CASE WHEN run <= '2-HIGH' THEN passed::INTEGER END) - avg(CASE WHEN run > '2-HIGH' THEN passed::INTEGER END), 6) AS d "
    "FROM t JOIN customer ON c_custkey = task GROUP BY 1)"
)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("segment")), "task")
    one = F.col("run") <= "2-HIGH"
    rate = lambda side: F.avg(F.when(side, F.col("passed").cast("int")))
    return t.groupBy("segment").agg(F.round(rate(one) - rate(~one), 6).alias("d"))


@query(
    f"WITH t AS ({_TRIALS}), {_SEGMENTS}, s AS (SELECT list(d) AS d FROM d WHERE d <> 0), "
    "m AS (SELECT d, unnest(range(0, (2 ** len(d))::BIGINT)) AS m FROM s) "
    "SELECT round(avg((abs(list_sum([CASE WHEN (m >> (i - 1)) & 1 = 1 THEN -d[i] ELSE d[i] END for i in range(1, len(d) + 1)])) >= abs(list_sum(d)) - 1e-9)::INTEGER), 9) AS p, "
    "max(len(d))::INTEGER AS n FROM m"
)
def sign_flip_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact two-sided p of the mean difference by market segment, all sign patterns counted in SQL."""
    return op.sign_flip_exact_sql(_segments(spark, sf_dir), "d").withColumn("p", F.round("p", 9))


@query(
    f"WITH t AS ({_TRIALS}), {_SEGMENTS}, s AS (SELECT list(d) AS d FROM d WHERE d <> 0), "
    "m AS (SELECT d, unnest(range(0, (2 ** len(d))::BIGINT)) AS m FROM s) "
    "SELECT round(avg((abs(list_sum([CASE WHEN (m >> (i - 1)) & 1 = 1 THEN -d[i] ELSE d[i] END for i in range(1, len(d) + 1)])) >= abs(list_sum(d)) - 1e-9)::INTEGER), 9) AS p, "
    "max(len(d)) AS n, true AS exact FROM m"
)
def sign_flip_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same p by sums of two halves held against each other."""
    return op.sign_flip(_segments(spark, sf_dir), "segment", "d").withColumn("p", F.round("p", 9))


@query()
def sign_flip_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p by drawn sign patterns, for more differences than can be enumerated."""
    return op.sign_flip(op.paired(*_both(spark, sf_dir), "task", 1), "task", "difference")


@query(
    "WITH p AS (SELECT a.o_custkey AS task, a.o_orderkey % 4 AS trial, any_value(a.o_orderstatus = 'F') AS base, any_value(a.o_totalprice > 150000) AS arm, "
    "any_value(a.o_orderpriority = '1-URGENT') AS fired FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) AS r FROM orders) a WHERE r = 1 GROUP BY 1, 2), "
    "n AS (SELECT *, count(*) OVER (PARTITION BY task) AS trials, (SELECT count(DISTINCT task) FROM p) AS tasks FROM p) "
    "SELECT fired, count(*) AS pairs, sum(arm::INTEGER - base::INTEGER)::BIGINT AS net, round(sum((arm::INTEGER - base::INTEGER) / (tasks * trials)), 9) AS share FROM n GROUP BY fired"
)
def negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a pass^1 difference comes from pairs in which the device fired."""
    first = Window.partitionBy("o_custkey", F.col("o_orderkey") % 4).orderBy("o_orderkey")
    pairs = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(first)).filter("r = 1")
    pairs = pairs.select(
        F.col("o_custkey").alias("task"),
        (F.col("o_orderstatus") == "F").alias("base"),
        (F.col("o_totalprice") > 150000).alias("arm"),
        (F.col("o_orderpriority") == "1-URGENT").alias("fired"),
    )
    return op.negative_control(pairs, "task", "fired", "base", "arm").withColumn("share", F.round("share", 9))


@query(
    "SELECT o_orderpriority AS run, o_orderstatus AS ending, count(*) AS episodes, count(*) FILTER (o_totalprice > 200000) AS truncated, "
    "round(avg(o_totalprice), 4) AS mean_cost, max(o_totalprice) AS max_cost, grouping(o_orderpriority, o_orderstatus)::INTEGER AS level "
    "FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())"
)
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by ending with subtotals: every block of the result table in one pass over the episodes."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("ending"), "o_totalprice")
    return spark.sql(
        "SELECT run, ending, count(*) AS episodes, count_if(o_totalprice > 200000) AS truncated, round(avg(o_totalprice), 4) AS mean_cost, "
        "max(o_totalprice) AS max_cost, cast(grouping_id(run, ending) AS int) AS level FROM {t} GROUP BY GROUPING SETS ((run, ending), (run), ())",
        t=t,
    )


@query(
    "SELECT count(*) AS episodes, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors, "
    "round(avg(value) FILTER (event_type = 'purchase'), 6) AS mean_purchase, max(value) AS largest, median(value) AS middle FROM events"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, means and extremes of a run in one aggregation, and its median by ranks."""
    e = table(spark, sf_dir, "events")
    counts = e.agg(
        F.count("*").alias("episodes"),
        F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("mean_purchase"),
        F.max("value").alias("largest"),
    )
    middle = ranks.medians(e, F.col("value")).select(F.col("median").alias("middle"))
    return counts.join(F.broadcast(middle), F.lit(True), "left")


@query(
    "WITH g AS (SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) AS n, median(value) AS middle, max(value) AS largest FROM events) "
    "SELECT 'error_share' AS gate, round(errors / n, 6) AS value, errors * 4 <= n AS passed FROM g UNION ALL SELECT 'middle_value', round(middle, 6), middle < 100 FROM g "
    "UNION ALL SELECT 'largest_value', round(largest, 6), largest > 0 FROM g"
)
def smoke_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds over aggregates of a run: (gate, value, passed)."""
    e = F.count_if(F.col("event_type") == "error")
    events = table(spark, sf_dir, "events")
    middle = ranks.medians(events, F.col("value")).select(F.col("median").alias("middle"))
    found = events.agg(e.alias("errors"), F.count("*").alias("n"), F.max("value").alias("largest")).join(F.broadcast(middle), F.lit(True), "left")
    gate = lambda name, v, ok: F.struct(F.lit(name).alias("gate"), F.round(v, 6).alias("value"), ok.alias("passed"))
    c = F.col
    gates = F.array(
        gate("error_share", c("errors") / c("n"), c("errors") * 4 <= c("n")),
        gate("middle_value", c("middle"), c("middle") < 100),
        gate("largest_value", c("largest"), c("largest") > 0),
    )
    return found.select(F.inline(gates))


@query(
    f"WITH {_BY_TASK} SELECT task FROM (SELECT task FROM t WHERE run <= '2-HIGH' GROUP BY task HAVING count(*) >= 3) "
    "WHERE task IN (SELECT task FROM t WHERE run > '2-HIGH' GROUP BY task HAVING count(*) >= 3)"
)
def usable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with three judged trials or more in both runs."""
    a, z = _halves(spark, sf_dir)
    return a.filter("n >= 3").join(z.filter("n >= 3"), "task", "left_semi").select("task")


@query(
    "WITH r AS (SELECT o_orderpriority AS run, round(avg((o_orderstatus = 'F')::INTEGER), 9) AS pass1, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT run, pass1, n FROM r ORDER BY pass1 DESC, run LIMIT 1"
)
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with the highest pass^1; ties keep the order of names."""
    r = trials(spark, sf_dir).groupBy("run").agg(F.round(F.avg(F.col("passed").cast("int")), 9).alias("pass1"), F.count("*").alias("n"))
    return r.orderBy(F.desc("pass1"), "run").limit(1)


@query(
    "WITH e AS (SELECT *, (event_type = 'error') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, "
    "row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS j FROM events), "
    "g AS (SELECT user_id, k - j AS island, count(*) AS length, max(k) AS pos FROM e WHERE bad GROUP BY 1, 2) "
    "SELECT user_id, max(length) AS longest, coalesce(min(pos - length + 3) FILTER (length >= 3), 0) AS stops_at FROM g GROUP BY user_id"
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of consecutive failures of each user, and where a stop after three in a row would come (0: never)."""
    bad = F.col("event_type") == "error"
    order = ("ts", "event_id")
    e = table(spark, sf_dir, "events").select(
        "user_id",
        bad.alias("bad"),
        F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).alias("k"),
        F.row_number().over(Window.partitionBy("user_id", bad).orderBy(*order)).alias("j"),
    )
    g = e.filter("bad").groupBy("user_id", (F.col("k") - F.col("j")).alias("island")).agg(F.count("*").alias("length"), F.max("k").alias("pos"))
    stop = F.min(F.when(F.col("length") >= op.FAILURES, F.col("pos") - F.col("length") + op.FAILURES))
    return g.groupBy("user_id").agg(F.max("length").alias("longest"), F.coalesce(stop, F.lit(0)).alias("stops_at"))


@query(
    "WITH l AS (SELECT l_returnflag AS condition, l_linestatus AS metric_a, l_quantity > 25 AS hit_a, l_discount > 0.05 AS hit_b FROM lineitem) "
    "SELECT condition, 'quantity' AS metric, count(*) FILTER (hit_a) AS num, count(*) AS den FROM l GROUP BY 1 UNION ALL "
    "SELECT condition, 'discount', count(*) FILTER (hit_b), count(*) FROM l GROUP BY 1"
)
def metric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerator and denominator of each metric by condition, unpivoted after one aggregation."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("condition")).agg(
        F.count_if(F.col("l_quantity") > 25).alias("a"), F.count_if(F.col("l_discount") > 0.05).alias("b"), F.count("*").alias("den")
    )
    return l.select("condition", "den", F.expr("stack(2, 'quantity', a, 'discount', b) AS (metric, num)"))


@query(
    "WITH c AS (SELECT o_orderpriority AS run, 'status' AS k, min(o_orderstatus) AS v FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'year', max(year(o_orderdate))::VARCHAR FROM orders GROUP BY 1 "
    "UNION ALL SELECT '1-URGENT', 'voice', 'on'), a AS (SELECT * FROM c WHERE run = '1-URGENT'), b AS (SELECT * FROM c WHERE run = '5-LOW') "
    "SELECT coalesce(a.k, b.k) AS setting, coalesce(a.v, 'default') AS base, coalesce(b.v, 'default') AS other FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.v, 'default') IS DISTINCT FROM coalesce(b.v, 'default')"
)
def setup_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in which two runs differ; a setting that one lacks has its default there."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.min("o_orderstatus").alias("status"), F.max(F.year("o_orderdate")).cast("string").alias("year"))
    voice = F.when(F.col("run") == "1-URGENT", "on")
    c = o.select("run", F.explode(F.map_filter(F.create_map(F.lit("status"), F.col("status"), F.lit("year"), F.col("year"), F.lit("voice"), voice), lambda k, v: v.isNotNull())).alias("setting", "v"))
    return compare.settings_apart(c.filter("run = '1-URGENT'"), c.filter("run = '5-LOW'"), "setting", "v", "default")
