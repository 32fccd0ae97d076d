"""Mixing, sharding and quality rules against plain versions."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm import mix, neardup, quality, shard, substring

WORD = re.compile("[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "a", "the cat the cat the cat", "x y z x y z\nline\nline\n\nline ", "A#b* C|d <e> the of", "é ü\x0bß\x0cq\x1cz\x85w", "w " * 70 + "\nend", " ".join(f"w{k}" for k in range(300))]
SCHEMA = "doc_id long, text string, source string, size int, weight string"


def frame(spark, n=40):
    rng = random.Random(5)
    rows = [(k, TEXTS[k % len(TEXTS)], rng.choice(["b", "a", "é", None, "c"]), 1, "w") for k in range(n)] + [(None, "x y", None, 1, "w"), (3, "a", "b", 1, "w"), (3, "a", "b", 1, "w")]
    return spark.createDataFrame(rows, SCHEMA)


def filled(sizes):
    """Targets by resharing until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total >= 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * left / total for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, None: 5}, {"a": 1, "b": 1000, "c": 2, "d": 0}, {"z": 7}, {"a": 0}, {"a": 1, "b": 1, "c": 1, "d": 100, "e": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mix.targets(df).collect()}
    assert found == {s: pytest.approx(t) for s, t in filled(sizes).items()}


def test_plan_and_mix(spark):
    docs = frame(spark)
    rows = mix.plan(docs).collect()
    assert len(rows) == docs.count() and [sorted(map(str, x)) for x in ([tuple(r) for r in rows], [tuple(r) for r in mix.plan(docs.repartition(7)).collect()])][0] == sorted(map(str, map(tuple, mix.plan(docs.repartition(3)).collect())))
    for r in rows:
        assert math.floor(r.rate) <= r.copies <= min(3, math.floor(r.rate) + 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(WORD.findall(texts[r.doc_id] or "")) for r in rows)
    mixed = mix.mix(docs)
    assert mixed.columns == docs.columns
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    planned = collections.Counter()
    for r in rows:
        planned[r.doc_id] += r.copies
    assert taken == +planned


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.substring(F.lit("abcde"), (F.col("id") % 5 + 1).cast("int"), F.lit(1)).alias("source"))
    got = mix.plan(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken / r.target - 1) < 0.1 for r in got.collect())


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    assert mix.plan(none).collect() == mix.mix(none).collect() == quality.judge(quality.features(none)).collect() == quality.keep(none).collect() == []
    assert shard.assign(none, ["a", "b"], 5).collect() == []


def test_features(spark):
    docs = frame(spark)
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in quality.features(docs).collect():
        t = texts[r.doc_id][0]
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_votes_learn_which_documents_are_good(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    clean = lambda: " ".join(rng.choice(["the", "of", *(word() for _ in range(5))]) for _ in range(120))
    junk = [lambda: " ".join(word() + "###" for _ in range(120)), lambda: " | ".join(word() for _ in range(90)), lambda: " ".join(word().upper() + "!!" for _ in range(120))]
    rows = [(k, junk[k % 3]() if k % 8 == 0 else clean(), k % 8 != 0) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    judged = quality.judge(quality.features(docs)).join(docs, "doc_id").collect()
    assert all(r.kept == r.good for r in judged)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[2] for r in rows)


def test_expectation_maximisation_finds_planted_accuracies():
    rng = random.Random(2)
    names, right = ["a", "b", "c"], [0.9, 0.8, 0.7]
    seen = collections.Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        seen[tuple((1 if good == (rng.random() < p) else -1) if rng.random() < 0.9 else 0 for p in right)] += 1
    model = quality.expectation_maximisation(list(seen.items()), names)
    assert abs(model.good - 0.7) < 0.05
    for n, p in zip(names, right):
        on_good, on_bad = model.chances[n]
        assert on_good == pytest.approx((0.9 * (1 - p), 0.1, 0.9 * p), abs=0.06) and on_bad == pytest.approx((0.9 * p, 0.1, 0.9 * (1 - p)), abs=0.06)
    assert quality.expectation_maximisation([], names).good == pytest.approx(0.8)


@pytest.mark.parametrize("on_bad, on_good", [(0.9, 0.01), (0.3, 0.3), (0.02, 0.6)])
def test_rules_that_only_vote_bad_are_judged_by_how_they_fire(on_bad, on_good):
    rng = random.Random(3)
    names, seen = list("abcdefg"), collections.Counter()
    for _ in range(30000):
        good = rng.random() < 0.8
        honest = [1 if good == (rng.random() < 0.85) else -1 for _ in range(3)]
        seen[(*honest, *(-1 if rng.random() < (on_good if good else on_bad) else 0 for _ in range(4)))] += 1
    model = quality.expectation_maximisation(list(seen.items()), names)
    assert abs(model.good - 0.8) < 0.05
    for n in names[3:]:
        assert abs(model.chances[n][0][0] - on_good) < 0.05 and abs(model.chances[n][1][0] - on_bad) < 0.05
        fired = model.weights(n)[0]
        assert fired < -2 if on_bad > 0.5 else abs(fired) < 0.2
    assert all(model.weights(n)[0] < -1 < 1 < model.weights(n)[2] for n in names[:3])


def test_posterior_and_verdict_equal_a_plain_version(spark):
    """All votes of all documents, weighed in Python by Bayes' rule under a model fitted document by document."""
    docs = frame(spark, 400)
    counted = quality.features(docs)
    names = list(quality.rules())
    rows = counted.select("*", *(v.alias("vote_" + n) for n, v in quality.rules().items())).collect()
    left = [r for r in rows if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    assert 10 < len(left) < len(rows)
    chances = {n: quality.PRIOR for n in names}
    good = quality.GOOD

    def odds(r):
        return math.log(good / (1 - good)) + sum(math.log(chances[n][0][r["vote_" + n] + 1] / chances[n][1][r["vote_" + n] + 1]) for n in names)

    for _ in range(500):
        p = [1 / (1 + math.exp(-odds(r))) for r in left]
        tally = {n: [[2 * x for x in side] for side in quality.PRIOR] for n in names}
        for r, x in zip(left, p):
            for n in names:
                tally[n][0][r["vote_" + n] + 1] += x
                tally[n][1][r["vote_" + n] + 1] += 1 - x
        chances = {n: tuple(tuple(x / sum(side) for x in side) for side in t) for n, t in tally.items()}
        good = (sum(p) + 1.6) / (len(left) + 2)
    judged = {tuple(r[c] for c in counted.columns): r for r in quality.judge(counted).collect()}

    def weight(n, vote):
        w = [math.log(g / b) for g, b in zip(*chances[n])]
        return w[vote + 1] if w[0] <= 0 <= w[2] else 0.0

    for r in rows:
        found = judged[tuple(r[c] for c in counted.columns)]
        expected = 1 / (1 + math.exp(-math.log(good / (1 - good)) - sum(weight(n, r["vote_" + n]) for n in names)))
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert found.posterior == pytest.approx(expected, abs=1e-4) and found.base_failed == failed
        assert found.kept == (not failed and expected >= 0.5)


def test_any_column_names(spark):
    """Names that operators use themselves, in any case."""
    text = " ".join(f"w{k}" for k in range(80))
    schema = "doc_id long, text string, source string, Row string, KEPT int, n_words int, n_removed int, Slot int, _slot_key int, at int, owner string, id int, part int, place int, copies int, body string"
    rows = [(1, text, "a", "r", *range(6), "o", 7, 8, 9, 10, "b"), (2, text + " end", None, None, *[None] * 6, None, *[None] * 4, None), (None, None, "a", "q", *range(6), "o", 7, 8, 9, 10, "b")]
    docs = spark.createDataFrame(rows, schema)
    placed = shard.assign(docs, ["s", "t"], 5)
    assert placed.columns == [c for c in docs.columns if c != "Slot"] + ["slot", "shard"] and placed.count() == 3
    cleaned = substring.clean(docs)
    assert cleaned.columns == docs.columns
    given, by = ({r.doc_id: r.asDict() for r in df.collect()} for df in (docs, cleaned))
    given[2]["text"], given[None]["text"] = "end", ""
    assert by == given
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert mix.mix(docs).columns == docs.columns and neardup.deduplicate(docs).columns == docs.columns


def test_shards_are_even_stable_and_leave_little_to_move(spark):
    names = [f"s{k}" for k in range(20)]
    table = shard.lookup_table(names, 5003)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(table) == 5003
    less = shard.lookup_table(names[:-1], 5003)
    moved = sum(names[a] != names[b] for a, b in zip(table, less) if a != 19)
    assert moved < 0.25 * 5003
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            shard.lookup_table(bad)
    with pytest.raises(ValueError):
        shard.lookup_table(["a"], 10)
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id long, slot string")
    rows = shard.assign(docs, names, 101).collect()
    assert len(rows) == 3 and rows[0] == rows[1] and all(r.shard in names for r in rows)
