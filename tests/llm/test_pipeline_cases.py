"""The pipeline and its stages on odd rows: nulls, empties, ties, repeated rows, empty tables, clashing names, very long texts."""

import collections
import random

import pytest
import corpus_pipeline as pipeline
from tidemill.llm import common, lm_score, mix, ogg, shard, substring

WORDS = "the of and a to in is that it for as with was on be this by from not at".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd(spark, n=50):
    """Rows of every odd kind among plain ones; names clash with those that stages use."""
    rng = random.Random(21)
    shared = prose(rng, 70)
    plain = [prose(rng, rng.randint(60, 160)) for _ in range(n)]
    rows = [(k, t if k % 5 else f"{t} {shared} {prose(rng, 20)}", "ab"[k % 2]) for k, t in enumerate(plain)]
    rows += [(100 + k, plain[k], "c") for k in range(10)]  # exact copies
    rows += [(200 + k, plain[k] + " end", None) for k in range(5)]  # near copies
    rows += [(300, None, "a"), (301, "", "a"), (302, " \n\t ", None), (None, plain[11], "a"), (None, None, None), (3, plain[3], "b"), (3, plain[3], "b")]
    rows += [(400, prose(rng, 40_000), "b")]
    rows = [(*r, 1, 2, 3, "r", "k") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, kept int, Slot int, row string, id string").repartition(4)


def copy_of(rows, docs):
    return docs.sparkSession.createDataFrame(rows, docs.schema)


def test_stages_one_after_another(spark):
    docs = odd(spark)
    stages = dict(pipeline.STAGES)
    given = docs.collect()

    good = stages["quality_rules"](spark, docs, "")
    kept = good.collect()
    assert good.columns == docs.columns
    assert collections.Counter(kept) == collections.Counter(r for r in given if r.text and len(r.text.split()) >= 50)  # plain prose stays, repeats and all

    good = copy_of(kept, docs)
    alone = stages["near_duplicates"](spark, good, "").collect()
    ids = collections.Counter(r.doc_id for r in alone)
    # 100 and 105 are copies of what 0 and 5 begin with, not of 0 and 5
    assert ids == collections.Counter(r.doc_id for r in kept if r.doc_id is None or r.doc_id < 100 or r.doc_id in (100, 105, 400))
    assert ids[3] == 3  # rows with one key are one document

    cleaned = stages["repeated_passages"](spark, copy_of(alone, docs), "")
    found = cleaned.collect()
    assert cleaned.columns == docs.columns and len(found) == len(alone)
    before = {r.doc_id: r.text for r in alone}
    for r in found:
        changed = r.doc_id is not None and r.doc_id % 5 == 0 and 0 < r.doc_id < 400
        assert (r.text != before[r.doc_id]) == changed and r.asDict() | {"text": ""} in [x.asDict() | {"text": ""} for x in alone]

    taken = stages["source_mix"](spark, copy_of(found, docs), "").collect()
    copies, there = collections.Counter(taken), collections.Counter(found)
    assert set(copies) <= set(there) and all(copies[r] <= 3 * there[r] for r in there)

    coded = stages["tokens"](spark, copy_of(taken, docs), "").collect()
    assert collections.Counter(r.doc_id for r in coded) == collections.Counter(r.doc_id for r in taken) and all(r.n_tokens == len(r.ids) > 0 for r in coded)


def test_stages_on_empty_tables(spark):
    none = odd(spark, 12).limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0 and (name == "tokens" or out.columns == none.columns), name
    lone = odd(spark, 12).filter("text IS NULL")
    for _, stage in pipeline.STAGES:
        stage(spark, lone, "").collect()


def test_run_is_the_stages(spark, tmp_path):
    docs = odd(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    for _, stage in pipeline.STAGES:
        made = stage(spark, out, "")
        rows = made.collect()
        out = copy_of(rows, made)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in pipeline.run(spark, str(tmp_path)).collect()) == collections.Counter((r.doc_id, r.n_tokens) for r in rows)


def test_more_buckets_for_more_text(spark, monkeypatch):
    docs = odd(spark)
    few = sorted(map(str, substring.remove_repeats(docs, digest=True).collect()))
    scores = {(r.doc_id, r.n_bytes): r.score for r in lm_score.score(docs).collect()}
    assert common.width(docs, "text") == 4
    monkeypatch.setattr(common, "BUCKET", 40_000)
    assert common.width(docs, "text") > 4
    assert sorted(map(str, substring.remove_repeats(docs, digest=True).collect())) == few
    again = {(r.doc_id, r.n_bytes): r.score for r in lm_score.score(docs).collect()}
    assert again.keys() == scores.keys() and all(abs(again[k] - scores[k]) < 1e-3 * abs(scores[k]) for k in scores)


def test_many_kinds_of_bytes_do_not_stop_the_scores(spark):
    docs = spark.createDataFrame([(k, " ".join(chr(0x21 + (k * 7919 + j * j) % 0xCFFF) for j in range(300))) for k in range(40)], "doc_id long, text string")
    found = lm_score.score(docs).collect()
    assert len(found) == 40 and all(r.score < 0 for r in found)


def test_table_is_filled_by_turns():
    """Each shard in turn takes the first slot of its own order that is still free."""
    names, slots = [f"s{k}" for k in range(7)], 53
    orders = []
    for n in names:
        offset, skip = shard._number(n, "offset", slots), shard._number(n, "skip", slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for s, order in enumerate(orders):
            if len(owner) < slots:
                owner[next(x for x in order if x not in owner)] = s
    assert shard.lookup_table(names, slots) == [owner[x] for x in range(slots)]


def test_sources_in_many_ranges_and_ties(spark):
    sizes = {f"s{k:03}é" if k % 3 else f"S{k:03}": 10 if k % 4 else k for k in range(200)} | {None: 10, "": 10}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert {r.source: r.place for r in mix.ranks(df).collect()} == {s: k for k, s in enumerate(names)}
    targets = {r.source: r.target for r in mix.targets(df).collect()}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values())) and all(targets[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    open_ = {s for s, n in sizes.items() if targets[s] < 3 * n - 1e-9}
    levels = {round(targets[s] / (names.index(s) % 3 + 1), 6) for s in open_}
    assert len(levels) == 1 and all(3 * sizes[s] <= (names.index(s) % 3 + 1) * min(levels) + 1e-6 for s in sizes if s not in open_)


def test_media_features_are_of_the_samples(spark):
    texts = [None, "", "abc", "abc", "é" * 500, "\x00\xff" * 7, "long " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = {r.doc_id: r for r in ogg.read(ogg.store(docs)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        values = [b - 128 for b in payload]
        told = dict(x.split("=") for x in back[k].feature.split(";"))
        assert bytes(back[k].samples) == payload and back[k].error is None
        assert int(told["us"]) == round(len(payload) / ogg.RATE * 1e6) and int(told["packets"]) == -(-len(payload) // ogg.PACKET)
        assert (int(told["sum"]), int(told["energy"]), int(told["peak"])) == (sum(values), sum(v * v for v in values), max(map(abs, values)))
        assert int(told["turns"]) == sum((x < 0) != (y < 0) for x, y in zip(values, values[1:]))
    assert back[2].feature == back[3].feature and back[0].feature == back[1].feature
