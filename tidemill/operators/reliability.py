"""Reliability of repeated trials: pass^k, resampling intervals, sign-flip tests, controls."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESAMPLES, EXACT_MOST, DRAWS, SLACK = 10_000, 20, 20_000, 1e-9
SEED, FLIP_SEED = 20260919, 20261024
#: Failures in a row after which a run stops.
FAILURES = 3


def success(verdict: Column, ending_judged: Column, state_equal: Column, values: Column) -> Column:
    """A trial succeeds if it was judged, ended in a judged way, left the right state and said every value.

    No values to say counts as all said.
    """
    said = F.forall(F.map_values(values), lambda v: v)
    return verdict.isNotNull() & F.coalesce(ending_judged & state_equal & said, F.lit(False))


def trials_by_task(trials: DataFrame, task: str, passed: str) -> DataFrame:
    """(task, n, c): trials and successes of each task. One partial aggregation, one row a task."""
    return trials.groupBy(task).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("c"))


def pass_hat_k(n: Column, c: Column, k: Column) -> Column:
    """Chance that k trials drawn without replacement all pass: C(c, k) / C(n, k), as a product.

    Null unless 1 <= k <= n and 0 <= c <= n.
    """
    product = F.aggregate(F.sequence(F.lit(0), (k - 1).cast("int")), F.lit(1.0), lambda acc, i: acc * F.greatest(c - i, F.lit(0)) / (n - i))
    return F.when((k >= 1) & (k <= n) & (c >= 0) & (c <= n), product)


def pass_k(by_task: DataFrame, k: int) -> DataFrame:
    """One row (k, tasks, value): mean over the tasks with k trials or more; NaN if there are none."""
    return (
        by_task.filter(F.col("n") >= k)
        .agg(F.count("*").alias("tasks"), F.coalesce(F.avg(pass_hat_k(F.col("n"), F.col("c"), F.lit(k))), F.lit(float("nan"))).alias("value"))
        .select(F.lit(k).alias("k"), "tasks", "value")
    )


def pass_k_table(by_task: DataFrame) -> DataFrame:
    """(k, value) for k from 1 to the smallest number of trials, over all tasks; no rows without tasks.

    Tasks are first counted by (n, c), so what is expanded by k has one row for each distinct pair.
    """
    pairs = by_task.groupBy("n", "c").agg(F.count("*").alias("tasks"))
    least = by_task.agg(F.min("n").alias("least"))
    each = pairs.crossJoin(F.broadcast(least)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("least").cast("int"))))
    value = F.sum(pass_hat_k(F.col("n"), F.col("c"), F.col("k")) * F.col("tasks")) / F.sum("tasks")
    return each.groupBy("k").agg(value.alias("value"))


@lru_cache(1)
def _recurrence() -> int:
    """The polynomial over two elements, bits as coefficients, that the bits of the generator's words follow, found from the words
    themselves (Berlekamp and Massey)."""
    words = _words(random.Random(1).getstate()[1][:-1], 2 * _DEGREE + 1)
    now, last, degree, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate((words[1:] & np.uint32(1)).tolist()):
        seen = seen << 1 | bit
        if (now & seen).bit_count() & 1:
            before = now
            now ^= last << gap
            if 2 * degree <= n:
                degree, last, gap = n + 1 - degree, before, 0
        gap += 1
    if degree != _DEGREE:
        raise RuntimeError("the generator is not the one that is known")
    return int(bin(now)[2:].zfill(degree + 1)[::-1], 2)


def _words(key: Iterable[int], count: int) -> np.ndarray:
    """The generator's 624 words and those that follow, before they are mixed into outputs."""
    source, parts = np.random.MT19937(), [np.array(list(key), np.uint32)]
    source.state = {"bit_generator": "MT19937", "state": {"key": parts[0], "pos": _STATE}}
    for _ in range(-(-count // _STATE)):
        source.random_raw(_STATE)
        parts.append(source.state["state"]["key"].copy())
    return np.concatenate(parts)


def _ahead(key: Iterable[int], steps: int) -> np.ndarray:
    """The 624 words so many outputs later: x ** steps modulo the recurrence says which words add up to each."""
    rule, power = _recurrence(), 1
    for bit in bin(steps)[2:]:
        power = int("0".join(bin(power)[2:]), 2) << (bit == "1")
        while (over := power.bit_length() - 1 - _DEGREE) >= 0:
            power ^= rule << over
    words, out = _words(key, _DEGREE), np.zeros(_STATE, np.uint32)
    for k in np.flatnonzero(np.array(list(bin(power)[:1:-1])) == "1").tolist():
        out ^= words[k : k + _STATE]
    return out


#: Words of the generator's state, and the degree of its recurrence. Outputs that are rather drawn than leapt over.
_STATE, _DEGREE, _NEAR = 624, 19937, 1 << 24


class Draws:
    """The 32-bit outputs of Python's generator for a seed, in order, as arrays: what is published with a seed can then be
    drawn again a few thousand times faster, and from any output on, so that many tasks draw parts of one sequence."""

    def __init__(self, seed: int, skip: int = 0):
        *key, at = random.Random(seed).getstate()[1]
        self.source = np.random.MT19937()
        words = np.array(key, np.uint32)
        if skip >= _NEAR:  # a fresh generator has used up its words
            words, skip = _ahead(key, skip), 0
        self.source.state = {"bit_generator": "MT19937", "state": {"key": words, "pos": at}}
        self.left = np.zeros(0, np.uint32)
        if skip:
            self.source.random_raw(skip)

    def raw(self, count: int) -> np.ndarray:
        """The next outputs."""
        return self.source.random_raw(count).astype(np.uint32)

    def below(self, n: int, count: int) -> np.ndarray:
        """``count`` places below n, as so many single choices among n: the high bits of each output that are below n."""
        bits = _bits(n)
        parts, have = [np.zeros(0, np.uint32)], 0
        while have < count:
            raw = self.left if len(self.left) else self.raw(max(1024, int((count - have) * (1 << bits) / n)))
            places = raw >> np.uint32(32 - bits)
            kept = np.flatnonzero(places < n)[: count - have]
            have += len(kept)
            self.left = raw[kept[-1] + 1 :] if have == count else raw[:0]
            parts.append(places[kept])
        return np.concatenate(parts).astype(np.int64)

    def heads(self, count: int) -> np.ndarray:
        """``count`` times whether a number from 0 to 1 is below a half: the first bit of the first of its two outputs."""
        return self.source.random_raw(2 * count)[::2] < 1 << 31


def _bits(n: int) -> int:
    if n.bit_length() > 32:
        raise ValueError("more than 2**32 - 1 rows to draw from")
    return n.bit_length()


#: Sums of a frame's columns, an array each with a value for each of several draws, and the number of rows to the statistic of each;
#: nan where it is undefined.
Statistic = Callable[[dict[str, np.ndarray], int], np.ndarray]
#: Outputs drawn at a time; parts that a sequence is drawn in, and outputs up to which it is one part.
_AT_ONCE, PARTS, _ONE_PART = 1 << 22, 96, 1 << 25


def _parts(outputs: int) -> int:
    return PARTS if outputs > _ONE_PART else 1


def _packed(values: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(at, body): the columns as doubles, row after row in the order of ``order``, packed by batches; sorted by ``at``, they follow
    one another. One row of nulls more, so that there is a row if there are no values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"at": pa.array([part + n], pa.int64()), "body": pa.array([rows.tobytes()], pa.binary())})
            n += 1

    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    packed = values.orderBy(F.col(order).asc_nulls_last()).select(*doubles).mapInArrow(run, "at long, body binary")
    return packed.union(values.sparkSession.range(1).select(F.lit(None).cast("long"), F.lit(None).cast("binary")))


def _unpacked(t: pa.Table, width: int) -> np.ndarray:
    t = t.filter(pc.is_valid(t.column("at"))).sort_by("at")
    return np.frombuffer(b"".join(x.as_py() for x in t.column("body")), np.float64).reshape(-1, width)


def _in_parts(values: DataFrame, order: str, columns: list[str], work: Callable[[int, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``work`` of each of PARTS parts, in a task of its own, on all rows, packed."""

    def run(t: pa.Table) -> pa.Table:
        found = work(t.column("part")[0].as_py(), _unpacked(t, len(columns)))
        return pa.table({k: pa.array(v) for k, v in found.items()})

    parts = values.sparkSession.range(PARTS).select(F.col("id").cast("int").alias("part"))
    return _packed(values, order, columns).crossJoin(F.broadcast(parts)).groupBy("part").applyInArrow(run, schema)


def resampled(values: DataFrame, order: str, statistic: Statistic, seed: int = SEED, draws: int = RESAMPLES) -> DataFrame:
    """One row (point, low, high) for a table of one row a task: the statistic, and its 2.5 and 97.5 % order
    statistics over resamples of the tasks drawn with replacement.

    Tasks are drawn from in the order of ``order``, draw after draw from one generator, as published intervals are. Its sequence is cut
    into parts of equal length. Each task leaps to its part; outputs that choose a row are first counted, so that it is known
    which draw each part begins in; then each part sums up the rows that it chooses, by draw. Every part needs all rows, as a
    choice may be any of them (8 bytes a value, packed). Draws for which the statistic is undefined are dropped. nan if there are no rows,
    or the point is undefined.
    """
    columns = [c for c in values.columns if c != order]

    def reach(n: int) -> int:
        """Outputs of which, but for a chance below 1e-30, enough choose a row."""
        wanted, chance = draws * n, n / (1 << _bits(n))
        return int((wanted + 12 * math.sqrt(wanted * (1 - chance))) / chance) + 1000

    def chosen(part: int, n: int) -> Iterator[np.ndarray]:
        """Places that the outputs of a part choose."""
        whole, bits = reach(n), _bits(n)
        of = _parts(whole)
        begin, end = (whole * min(k, of) // of for k in (part, part + 1))
        source = Draws(seed, begin) if begin < end else None
        for k in range(begin, end, _AT_ONCE):
            places = source.raw(min(_AT_ONCE, end - k)) >> np.uint32(32 - bits)
            yield places[places < n].astype(np.intp)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for part, n in zip(t.column("part").to_pylist(), t.column("n").to_pylist()):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "kept": pa.array([sum(map(len, chosen(part, n))) if n else 0], pa.int64())})

    def add(t: pa.Table) -> pa.Table:
        rows, part, at = _unpacked(t, len(columns)), t.column("part")[0].as_py(), t.column("start")[0].as_py()
        n, ids, sums, each = len(rows), [], [], np.ascontiguousarray(rows.T)
        if not part:
            ids, sums = [np.array([-1])], [rows.sum(axis=0)[None]]
        for places in chosen(part, n) if n else ():
            places = places[: max(0, draws * n - at)]
            if not len(places):
                break
            first, last = at // n, (at + len(places) - 1) // n
            edges = np.maximum(np.arange(first, last + 1) * n - at, 0)
            ids.append(np.arange(first, last + 1))
            sums.append(np.stack([np.add.reduceat(c[places], edges) for c in each], axis=1))
            at += len(places)
        sums = np.concatenate([np.zeros((0, len(columns))), *sums])
        return pa.table({"draw": pa.array(np.concatenate([np.zeros(0, np.int64), *ids]), pa.int64()), **{f"v{k}": pa.array(sums[:, k], pa.float64()) for k in range(len(columns))}, "n": pa.array(np.full(len(sums), n), pa.int64())})

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("draw")
        n = t.column("n")[0].as_py()
        nothing = {k: pa.array([math.nan]) for k in ("point", "low", "high")}
        if not n:
            return pa.table(nothing)
        if len(t) != draws + 1:
            raise RuntimeError("too few outputs for all draws")
        found = statistic({c: np.asarray(t.column(f"v{k}")) for k, c in enumerate(columns)}, n)
        if math.isnan(found[0]):
            return pa.table(nothing)
        known = np.sort(found[1:][~np.isnan(found[1:])])
        low, high = (float(known[k]) for k in (int(0.025 * len(known)), int(0.975 * len(known)) - 1))
        return pa.table({"point": [float(found[0])], "low": [low], "high": [high]})

    session = values.sparkSession
    parts = session.range(0, PARTS, 1, PARTS).select(F.col("id").cast("int").alias("part"))
    kept = parts.join(F.broadcast(values.agg(F.count("*").alias("n"))), F.lit(True)).mapInArrow(count, "part int, kept long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    starts = kept.select("part", F.coalesce(F.sum("kept").over(before), F.lit(0)).alias("start"))
    sums = _packed(values, order, columns).crossJoin(F.broadcast(starts)).groupBy("part").applyInArrow(add, "draw long, " + "".join(f"v{k} double, " for k in range(len(columns))) + "n long")
    by_draw = sums.groupBy("draw").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(len(columns))), F.max("n").alias("n"))
    return by_draw.groupBy(F.lit(1).alias("one")).applyInArrow(finish, "point double, low double, high double")


def mean_of(column: str) -> Statistic:
    """Statistic: mean of a column."""
    return lambda sums, n: sums[column] / n


def pooled_ratio(num: str, den: str, num2: str, den2: str) -> Statistic:
    """Statistic: difference of two ratios of sums, the second less the first; undefined if either denominator is zero."""

    def statistic(sums: dict[str, np.ndarray], _: int) -> np.ndarray:
        n, d, n2, d2 = (sums[c] for c in (num, den, num2, den2))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((d != 0) & (d2 != 0), n2 / d2 - n / d, np.nan)

    return statistic


def sign_flip_p(differences: Iterable[float], exact_most: int = EXACT_MOST, draws: int = DRAWS, seed: int = FLIP_SEED) -> tuple[float, int, bool]:
    """Two-sided p of the mean difference under random signs, how many differences count, and whether it is exact.

    Zero differences say nothing. Up to ``exact_most`` of the others, the distribution of the sum is built up one
    difference at a time, sums that are equal counted together; beyond, sign patterns are drawn.
    """
    d = np.array([x for x in differences if x], np.float64)
    least = abs(math.fsum(d)) - SLACK
    if least <= 0:
        return 1.0, len(d), True
    if len(d) <= exact_most:
        sums, ways = np.zeros(1), np.ones(1)
        for x in d:
            both = np.concatenate((sums - x, sums + x))
            order = np.argsort(both)
            both, twice = both[order], np.concatenate((ways, ways))[order]
            begins = np.flatnonzero(np.diff(both, prepend=-np.inf) > SLACK / 1000)
            sums, ways = both[begins], np.add.reduceat(twice, begins)
        return float(ways[np.abs(sums) >= least].sum() / ways.sum()), len(d), True
    return (1 + _hits(d, 0, draws, seed)) / (1 + draws), len(d), False


def _hits(d: np.ndarray, begin: int, end: int, seed: int) -> int:
    """How many of the draws from ``begin`` to ``end`` have a sum that is as far from zero as the differences' own."""
    least = abs(math.fsum(d)) - SLACK
    source, hits, block = Draws(seed, 2 * begin * len(d)), 0, max(1, _AT_ONCE // len(d))
    for k in range(begin, end, block):
        plus = source.heads(min(block, end - k) * len(d)).reshape(-1, len(d))
        hits += int((np.abs(2 * (plus @ d) - d.sum()) >= least).sum())
    return hits


def sign_flip(differences: DataFrame, key: str, value: str) -> DataFrame:
    """One row (p, n, exact) for a table of one difference a task, taken in the order of ``key``. Draws are dealt out over PARTS tasks, each of
    which leaps to its part of the one sequence that they are drawn from; few differences are one task's."""

    def work(part: int, rows: np.ndarray) -> dict[str, np.ndarray]:
        d = rows[rows[:, 0] != 0, 0]
        drawn = len(d) > EXACT_MOST and abs(math.fsum(d)) > SLACK
        if not drawn:
            p, n, exact = sign_flip_p(d) if not part else (0.0, 0, True)
            return {"p": np.array([p]), "hits": np.array([0]), "n": np.array([n]), "exact": np.array([exact])}
        of = _parts(2 * DRAWS * len(d))
        begin, end = (DRAWS * min(k, of) // of for k in (part, part + 1))
        return {"p": np.array([0.0]), "hits": np.array([_hits(d, begin, end, FLIP_SEED) if begin < end else 0]), "n": np.array([len(d)]), "exact": np.array([False])}

    slim = differences.select(differences[key].alias("k"), F.coalesce(differences[value].cast("double"), F.lit(0.0)).alias("d"))
    each = _in_parts(slim, "k", ["d"], work, "p double, hits long, n long, exact boolean").agg(F.sum("hits").alias("hits"), F.max("p").alias("p"), F.max("n").alias("n"), F.bool_and("exact").alias("exact"))
    return each.select(F.when(F.col("exact"), F.col("p")).otherwise((1 + F.col("hits")) / F.lit(1.0 + DRAWS)).alias("p"), "n", "exact")


def sign_flip_exact_sql(differences: DataFrame, value: str) -> DataFrame:
    """(p, n) for few differences (12 at most) without Python: all sign patterns as bits of a number."""
    some = differences.filter(f"{value} <> 0").agg(F.collect_list(F.col(value).cast("double")).alias("d"))
    signed = "aggregate(d, struct(0D AS s, 0 AS i), (a, x) -> struct(a.s + if(shiftright(m, a.i) & 1 = 1, -x, x) AS s, a.i + 1 AS i), a -> a.s)"
    total = "abs(aggregate(d, 0D, (a, x) -> a + x))"
    return some.selectExpr("d", "explode(sequence(0, cast(pow(2, size(d)) AS int) - 1)) AS m").selectExpr(
        f"if(abs({signed}) >= {total} - {SLACK}D, 1, 0) AS hit", "size(d) AS n"
    ).agg(F.avg("hit").alias("p"), F.max("n").alias("n"))


def paired(base: DataFrame, other: DataFrame, task: str, k: int) -> DataFrame:
    """(task, difference) of pass^k between two runs, over the tasks with k trials or more in both. Both must have the same
    tasks; a task that one run lacks is an error."""
    was, now = (df.select(task, F.struct("n", "c").alias(name)) for df, name in ((base, "was"), (other, "now")))
    both = was.join(now, task, "full_outer")
    lacking = F.raise_error(F.concat(F.lit("both runs must have the same tasks: "), F.col(task).cast("string")))
    whole = F.when(F.col("was").isNull() | F.col("now").isNull(), lacking.cast("boolean")).otherwise(F.lit(True))
    value = lambda of: pass_hat_k(F.col(f"{of}.n"), F.col(f"{of}.c"), F.lit(k))
    return both.filter(whole).select(task, (value("now") - value("was")).alias("difference")).filter("difference IS NOT NULL")


def negative_control(pairs: DataFrame, task: str, fired: str, base: str, arm: str) -> DataFrame:
    """(fired, pairs, net, share): by whether the device fired, how much of the pass^1 difference comes from it.

    A pair (task, trial) adds its difference over (tasks * trials of its task); shares add up to the difference.
    """
    trials = F.count("*").over(Window.partitionBy(task))
    tasks = F.broadcast(pairs.agg(F.count_distinct(task).alias("tasks")))
    delta = F.col(arm).cast("int") - F.col(base).cast("int")
    return (
        pairs.withColumn("trials", trials)
        .crossJoin(tasks)
        .groupBy(fired)
        .agg(F.count("*").alias("pairs"), F.sum(delta).alias("net"), F.sum(delta / (F.col("tasks") * F.col("trials"))).alias("share"))
    )
