"""Scores, substring and near-duplicate removal and the pipeline against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import lm_score, neardup, substring

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, n long, same string, id string"


def corpus(spark, seed=8, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 220))) for _ in range(14)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One\ttwo"), (None, base[0]), (7, base[1]), (7, base[1])]
    for k in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t.insert(rng.randrange(len(t)), passage)
        rows.append((k * 3 + 10, ("\n" if rng.random() < 0.2 else " ").join(t)))
    return spark.createDataFrame([(i, t, 1, "s", "i") for i, t in rows], SCHEMA).repartition(3)


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def test_repeats_go_where_a_smaller_document_has_them(spark):
    docs = corpus(spark)
    rows = docs.collect()
    first = {}
    for r in rows:
        w = words(r.text)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if r.doc_id is not None:
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
    expected = collections.Counter()
    for r in rows:
        w = words(r.text)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if r.doc_id is not None and first[tuple(w[k : k + 50])] < r.doc_id:
                gone[k : k + 50] = [True] * 50
        expected[r.doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    for size in (600, 1 << 20):
        found = substring.remove_repeats(docs, digest=True, block_bytes=size).collect()
        assert collections.Counter(map(tuple, found)) == expected
    assert sum(k[2] > 0 for k in expected) > 3
    cleaned = substring.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    digests = {(r.doc_id, hashlib.sha256(b" ".join(words(r.text))).hexdigest()) for r in cleaned.collect()}
    assert digests == {(k[0], k[3]) for k in expected}
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_cover_meets_every_shift():
    d = substring.COVER
    assert {(a - b) % substring.PERIOD for a in d for b in d} == set(range(substring.PERIOD))


def plain_components(rows):
    sets, ids = {}, set()
    for r in rows:
        w = words(r.text, True)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), None if i is None else find(i), i is None or find(i) == i) for i in sets}


@pytest.mark.parametrize("queries, met, edges", [(neardup.QUERIES, neardup.MET, neardup.EDGES), (60, 90, 2)])
def test_components(spark, monkeypatch, queries, met, edges):
    for name, value in (("QUERIES", queries), ("MET", met), ("EDGES", edges)):
        monkeypatch.setattr(neardup, name, value)
    docs = corpus(spark, seed=9)
    expected = plain_components(docs.collect())
    found = neardup.classes(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == expected[r.doc_id], r
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in expected.items() if v[2]}
    assert neardup.classes(docs.limit(0)).count() == 0


def test_only_null_and_blank_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, " \n"), (3, ""), (None, None)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(docs).collect()}
    assert found == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), None: (0, None, True)}


def test_null_text_alone_in_its_partition(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(7, None)], "doc_id long, text string").union(spark.createDataFrame([(8, text), (9, text)], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in neardup.classes(docs).collect()} == {7: 7, 8: 8, 9: 8}


def test_large_bucket_with_several_components(spark, monkeypatch):
    """One bucket whose smallest document is linked to few members: the others are found by holding outsiders against all."""
    monkeypatch.setattr(neardup, "QUERIES", 400)
    monkeypatch.setattr(neardup, "MET", 700)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for d in range(70):
        words = list(base)
        for _ in range(rng.choice([0, 2, 4, 6, 8])):
            words[rng.randrange(160)] = f"x{rng.randrange(9999)}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = plain_components(docs.collect())
    assert len({c for _, c, _ in expected.values()}) > 3
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(docs).collect()} == expected


def test_stars_find_the_smallest_id(spark):
    rng = random.Random(10)
    edges = [(k, k + 1) for k in range(100, 130)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(5, 5), (130, 100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}


def plain_scores(rows, depth=lm_score.DEPTH):
    counts = [collections.defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    tokens, coded = collections.Counter(), []
    for r in rows:
        w = words(r.text, True)
        s = b"\n" * depth + (b" ".join(w) + b" \n" if w else b"\n")
        held = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2
        coded.append((r.doc_id, w, s, held))
        if not held:
            tokens.update(w)
            tokens[None] += 1
            for i in range(depth, len(s)):
                u = 1
                for k in range(7, -1, -1):
                    for d in range(depth + 1):
                        counts[d][s[i - d : i], u][s[i] >> k & 1] += 1
                    u = 2 * u + (s[i] >> k & 1)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    below = [collections.defaultdict(float) for _ in range(depth + 1)]
    for d in range(depth, -1, -1):
        for (c, u), (a, b) in counts[d].items():
            own = kt(a, b)
            rest = below[d][c, u]
            total = own if d == depth else math.log(0.5) + max(own, rest) + math.log1p(math.exp(-abs(own - rest)))
            if d:
                below[d - 1][c[1:], u] += total

    def bit(context, u, b, d=0):
        c = context[depth - d :]
        n = counts[d].get((c, u), (0, 0))
        p = (n[b] + 0.5) / (sum(n) + 1)
        if d == depth:
            return p
        ratio = math.exp(min(700, kt(*n) - below[d].get((c, u), 0.0)))
        return (ratio * p + bit(context, u, b, d + 1)) / (ratio + 1)

    total, kinds = sum(tokens.values()), len(tokens)
    for i, w, s, held in coded:
        score = 0.0
        for k in range(depth, len(s)):
            u = 1
            for j in range(7, -1, -1):
                score += math.log10(bit(s[k - depth : k], u, s[k] >> j & 1))
                u = 2 * u + (s[k] >> j & 1)
        known = [tokens[t] for t in [*w, None]]
        yield i, held, len(w) + 1, sum(c > 0 for c in known), total, sum(math.log10((c + 1) / (total + kinds + 1)) for c in known), score


def test_scores_are_those_of_the_tree(spark):
    docs = corpus(spark, seed=11, n=12)
    expected = sorted(plain_scores(docs.collect()), key=str)
    for size in (500, 1 << 20):
        found = sorted((tuple(r)[:7] for r in lm_score.score(docs, block_bytes=size).collect()), key=str)
        assert len(found) == len(expected)
        for f, e in zip(found, expected):
            assert f[:5] == e[:5] and f[5:] == pytest.approx(e[5:], rel=1e-6)
    assert lm_score.score(docs.limit(0)).count() == 0


def test_contexts_shorten_held_out_text(spark):
    rng = random.Random(12)
    syllables = ["th", "re", "on", "ing", "es", "at", "ou", "nd"]
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(150))
    docs = spark.createDataFrame([(k, text()) for k in range(150)], "doc_id long, text string")
    bytes_ = collections.Counter(b"".join(lm_score.stream(words(r.text, True)) for r in docs.collect() if not lm_score.held_out(r.doc_id)))
    alone = sum(math.log10(bytes_[b] / bytes_.total()) for r in docs.collect() if lm_score.held_out(r.doc_id) for b in lm_score.stream(words(r.text, True)))
    held = lm_score.score(docs).filter("held_out").agg(F.sum("score").alias("s")).first()
    assert held.s > 0.7 * alone


def test_pipeline(spark, tmp_path):
    import os

    import corpus_pipeline

    if not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"):
        pytest.skip("needs the vocabulary")
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = lambda n: " ".join(rng.choice(["the", "of", *(word() for _ in range(5))]) for _ in range(n))
    passage = clean(80)
    rows = []
    for k in range(60):
        t = clean(120)
        if k % 10 == 1:
            t = rows[k - 1][1]
        elif k % 10 == 2:
            t = " | ".join(word() for _ in range(80))
        elif k % 10 in (3, 4):
            t = f"{clean(90)} {passage} {clean(90)}"
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    here, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        here = stage(spark, here, str(tmp_path))
        seen[name] = here.collect()
        if name != "tokens":
            assert here.columns == docs.columns
    assert {r.doc_id for r in seen["quality_rules"]} == {k for k in range(60) if k % 10 != 2}
    assert {r.doc_id for r in seen["near_duplicates"]} == {k for k in range(60) if k % 10 not in (1, 2)}
    assert sum(passage in r.text for r in seen["repeated_passages"]) == 1
    assert all(r.n_chars == len(r.text) for r in seen["repeated_passages"])
    assert [len(seen[k]) for k in ("source_mix", "tokens")] == [len(seen["tokens"])] * 2
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.n_tokens) for r in seen["tokens"])


def test_rows_of_one_key_are_placed_by_their_own_texts(spark):
    a, b = ("".join(f" {x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (None, a), (2, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(map(tuple, neardup.classes(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert found == sorted([(1, 56, 1, True), (2, 57, 1, False), (2, 56, 2, True), (3, 57, 2, False), (None, 56, None, True), (2, 56, 2, True)], key=repr)
    for _ in range(2):
        assert sorted(map(tuple, neardup.deduplicate(docs).collect()), key=repr) == sorted([(1, a), (2, b), (2, b), (None, a)], key=repr)
